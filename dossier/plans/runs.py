"""Terms of several words found where a text lies, for short lists of queries that ask for them.

A task walks over its rows in Arrow batches: words become numbers and runs of words the nodes of a prefix tree, so a text is read once for
all terms. What the queries of a row need is settled inside the row, and only that is sent on.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from dossier.plans.postings import _ranges

#: Places, or pairs of rows and queries, that are looked at in one step.
STEP_ITEMS = 500_000
#: Up to so many hits stand in one row that is sent on.
ROW_HITS = 10_000


class Runs:
    """The distinct runs of words as a prefix tree; a run is numbered by its place in ``listed``."""

    def __init__(self, runs: Iterable[str]) -> None:
        self.listed = sorted(set(runs))
        split = [r.split(" ") for r in self.listed]
        words = sorted({w for r in split for w in r})
        number = {w: i for i, w in enumerate(words)}
        self.words, self.size = pa.array(words, pa.string()), max(1, len(words))
        self.length = np.array([len(r) for r in split], np.int64)
        #: per depth: sorted (node of the depth before, word), and the run that ends in the node, or -1
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []
        node, depth, left = np.zeros(len(split), np.int64), 0, np.arange(len(split))
        while len(left):
            keys, at = np.unique(node[left] * self.size + [number[split[i][depth]] for i in left], return_inverse=True)
            depth += 1
            ends, last = np.full(len(keys), -1, np.int64), self.length[left] == depth
            ends[at[last]] = left[last]
            self.levels.append((keys, ends))
            node[left], left = at, left[~last]

    def found(self, held: pa.ListArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, place from 1, run) of all places where a run begins in the lists of words."""
        sizes = np.asarray(pc.fill_null(pc.list_value_length(held), 0)).astype(np.int64)
        word = np.asarray(pc.fill_null(pc.index_in(held.flatten(), value_set=self.words), -1)).astype(np.int64)
        of_row = np.repeat(np.arange(len(sizes)), sizes)
        place = _ranges(np.ones(len(sizes), np.int64), sizes)
        end = np.repeat(np.cumsum(sizes), sizes)
        at, node, found = np.arange(len(word)), np.zeros(len(word), np.int64), []
        for depth, (keys, ends) in enumerate(self.levels):
            inside = at + depth < end[at]
            at, node = at[inside], node[inside]
            known = word[at + depth] >= 0
            at, node = at[known], node[known]
            wanted = node * self.size + word[at + depth]
            node = np.searchsorted(keys, wanted)
            met = (node < len(keys)) & (keys[np.minimum(node, len(keys) - 1)] == wanted)
            at, node = at[met], node[met]
            whole = ends[node] >= 0
            found.append((at[whole], ends[node[whole]]))
        at, run = (np.concatenate([f[k] for f in found]) if found else np.zeros(0, np.int64) for k in range(2))
        return of_row[at], place[at], run


class Asked:
    """Which entries (any numbers of the caller) ask for a run; entries of a run lie side by side."""

    def __init__(self, runs: Runs, entries: Sequence[tuple]) -> None:
        """``entries``: (run, numbers...)."""
        place = {r: i for i, r in enumerate(runs.listed)}
        table = np.array([(place[e[0]], *e[1:]) for e in entries], np.int64).reshape(len(entries), -1)
        table = table[np.argsort(table[:, 0], kind="stable")] if len(table) else table
        self.values = table[:, 1:]
        self.many = np.bincount(table[:, 0], minlength=len(place)) if len(table) else np.zeros(len(place), np.int64)
        self.starts = np.cumsum(self.many) - self.many

    def of(self, run: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index into ``run``, entry) of all entries."""
        return np.repeat(np.arange(len(run)), self.many[run]), _ranges(self.starts[run], self.many[run])


def _steps(weights: np.ndarray, most: int = STEP_ITEMS) -> Iterator[tuple[int, int]]:
    """Ranges of neighbours whose weights sum to about ``most``, one at least."""
    total, at = np.cumsum(weights), 0
    while at < len(weights):
        to = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + most, "right")))
        yield at, to
        at = to


def _firsts(*keys: np.ndarray) -> np.ndarray:
    """Whether a sorted row differs from the one before."""
    first = np.ones(len(keys[0]), bool)
    if len(first):
        first[1:] = np.any([k[1:] != k[:-1] for k in keys], axis=0)
    return first


def _nested(values: pa.Array | pa.StructArray, starts: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.append(starts, len(values)), pa.int32()), values)


def role_batches(
    batches: Iterator[pa.RecordBatch], wanted: Sequence[tuple], columns: Sequence[str], by_package: bool
) -> Iterator[pa.RecordBatch]:
    """``wanted``: (query_id, role, term, run). Per query and row that holds a run of it: ``columns``, the distinct roles and the terms as sorted ``role=term``.

    With ``by_package``: (query_id, package_id, role) alone, each once per batch.
    """
    runs = Runs(w[3] for w in wanted)
    queries, roles = list(dict.fromkeys(w[0] for w in wanted)), list(dict.fromkeys(w[1] for w in wanted))
    texts = ["=".join(x for x in w[1:3] if x is not None) for w in wanted]
    labels = sorted(set(texts), key=lambda t: t.encode())
    query, role, label = ({x: i for i, x in enumerate(of)} for of in (queries, roles, labels))
    asked = Asked(runs, [(w[3], query[w[0]], role[w[1]], label[t], i) for i, (w, t) in enumerate(zip(wanted, texts, strict=True))])
    names, role_names, label_names = (pa.array(x, pa.string()) for x in (queries, roles, labels))
    for batch in batches if wanted else ():
        row, _, run = runs.found(batch.column("_w"))
        # each run once for a row
        pair = np.unique(row * max(1, len(runs.listed)) + run)
        row, run = pair // max(1, len(runs.listed)), pair % max(1, len(runs.listed))
        many = np.bincount(row, weights=asked.many[run], minlength=len(batch)).astype(np.int64)
        begins = np.searchsorted(row, np.arange(len(batch) + 1))
        package = batch.column("package_id").dictionary_encode() if by_package else None
        for low, high in _steps(many):
            at, entry = asked.of(run[begins[low]:begins[high]])
            r, (q, o, t, i) = row[begins[low]:begins[high]][at], asked.values[entry].T.reshape(4, -1)
            if by_package:
                none = len(package.dictionary)
                code = np.asarray(package.indices.fill_null(none)).astype(np.int64)[r]
                key = np.unique((code * len(queries) + q) * len(roles) + o)
                code, q, o = key // len(roles) // len(queries), key // len(roles) % len(queries), key % len(roles)
                known = pa.array(np.where(code == none, 0, code), mask=code == none)
                yield pa.RecordBatch.from_pydict({"query_id": names.take(pa.array(q)), "package_id": package.dictionary.take(known), "role": role_names.take(pa.array(o))})
                continue
            by = np.lexsort((i, t, q, r))
            r, q, o, t = r[by], q[by], o[by], t[by]
            starts = np.flatnonzero(_firsts(r, q))
            group = np.cumsum(_firsts(r, q)) - 1 if len(r) else r
            told = np.unique(group * len(roles) + o)
            role_starts = np.searchsorted(told // len(roles), np.arange(len(starts)))
            out = {"query_id": names.take(pa.array(q[starts]))} | {c: batch.column(c).take(pa.array(r[starts])) for c in columns}
            out |= {"_roles": _nested(role_names.take(pa.array(told % len(roles))), role_starts), "_labels": _nested(label_names.take(pa.array(t)), starts)}
            yield pa.RecordBatch.from_pydict(out)


def relation_batches(
    batches: Iterator[pa.RecordBatch], wanted: Sequence[tuple], cues: Sequence[tuple[str, str, str]], columns: Sequence[str], roles: tuple[str, str]
) -> Iterator[pa.RecordBatch]:
    """``wanted``: (query_id, relationship, role, term, run). ``columns`` of a row with the list of its hits in ``_hits``: for every place of a cue and
    every query of its relationship that has terms of both ``roles`` on the sides where the cue reads them, the nearest ones.

    Nearness counts words, then the longer, then the first term. A role of a query has the ends (or begins) of its terms
    in order, so the nearest to a place is looked up and no pair of a place and a term is made.
    """
    runs, cue_runs = Runs(w[4] for w in wanted), Runs(c for _, c, _ in cues)
    asking = sorted({w[:2] for w in wanted})
    # the first term of equal runs, and the order of terms at one distance
    terms: dict[tuple, str] = {}
    for q, relation, role, term, run in wanted:
        key = (run, q, relation, role)
        terms[key] = min(terms.get(key, term), term, key=str.encode)
    rated = sorted({(-len(k[0]), t.encode(), t) for k, t in terms.items()})
    rank, place = {(n, t): i for i, (n, _, t) in enumerate(rated)}, {a: i for i, a in enumerate(asking)}
    asked = Asked(runs, [(k[0], place[k[1:3]] * 2 + roles.index(k[3]), rank[-len(k[0]), t]) for k, t in terms.items()])
    relations = sorted({r for _, r in asking} | {r for r, _, _ in cues})
    relation_of = np.array([relations.index(r) for _, r in asking], np.int64)
    listed = list(dict.fromkeys(cues))
    cue_asked = Asked(cue_runs, [(c, i) for i, (_, c, _) in enumerate(listed)])
    cue_relation = np.array([relations.index(r) for r, _, _ in listed], np.int64)
    forward = np.array([d == "FORWARD" for _, _, d in listed], bool)
    term_names, query_names = pa.array([t for *_, t in rated], pa.string()), pa.array([q for q, _ in asking], pa.string())
    cue_names = [pa.array([c[k] for c in listed], pa.string()) for k in range(3)]

    def nearest(rows, width):
        """Sorted keys (row, query, role, place) with the best term of each, by ends and by begins."""
        row, at, run = rows
        of, entry = asked.of(run)
        side, tie = asked.values[entry].T.reshape(2, -1)
        group = row[of] * (2 * len(asking)) + side
        for where in (at + runs.length[run] - 1, at):
            key = group * width + where[of]
            by = np.lexsort((tie, key))
            by = by[_firsts(key[by])]
            yield key[by], tie[by]

    for batch in batches if wanted else ():
        held = batch.column("_w")
        row, at, run = runs.found(held)
        by = np.argsort(row, kind="stable")
        row, at, run = row[by], at[by], run[by]
        cue_row, begin, cue = cue_runs.found(held)
        of, entry = cue_asked.of(cue)
        cue_row, begin, end, cue = cue_row[of], begin[of], (begin + cue_runs.length[cue] - 1)[of], cue_asked.values[entry][:, 0]
        by = np.lexsort((cue, begin, cue_row))
        cue_row, begin, end, cue = cue_row[by], begin[by], end[by], cue[by]
        width = int(pc.max(pc.list_value_length(held)).as_py() or 0) + 2
        many = np.bincount(row, weights=asked.many[run], minlength=len(batch)).astype(np.int64)
        begins, cue_begins = (np.searchsorted(x, np.arange(len(batch) + 1)) for x in (row, cue_row))
        for low, high in _steps(many):
            part = slice(begins[low], begins[high])
            (ends, end_tie), (froms, from_tie) = nearest((row[part], at[part], run[part]), width)
            # queries with both roles in a row, side by side for a row and a relationship
            both = np.unique(ends // width)
            both = both[:-1][(both[1:] == both[:-1] + 1) & (both[:-1] % 2 == 0)] // 2
            q, r = both % max(1, len(asking)), both // max(1, len(asking))
            by = np.lexsort((q, relation_of[q], r))
            q, of = q[by], r[by] * len(relations) + relation_of[q[by]]
            c = np.arange(cue_begins[low], cue_begins[high])
            here = cue_row[c] * len(relations) + cue_relation[cue[c]]
            first = np.searchsorted(of, here)
            several = np.searchsorted(of, here, "right") - first
            for a, b in _steps(several):
                p, query = np.repeat(c[a:b], several[a:b]), q[_ranges(first[a:b], several[a:b])]
                base, ahead = (cue_row[p] * len(asking) + query) * 2, forward[cue[p]]
                # a forward cue has the subject before it, a reverse one the object
                before, after = base + np.where(ahead, 0, 1), base + np.where(ahead, 1, 0)
                x = np.searchsorted(ends, before * width + begin[p]) - 1
                y = np.searchsorted(froms, after * width + end[p], "right")
                met = (x >= 0) & (y < len(froms))
                met[met] = (ends[x[met]] // width == before[met]) & (froms[y[met]] // width == after[met])
                p, query, ahead, x, y = p[met], query[met], ahead[met], end_tie[x[met]], from_tie[y[met]]
                if not len(p):
                    continue
                new = _firsts(cue_row[p])
                inside = np.arange(len(p)) - np.maximum.accumulate(np.where(new, np.arange(len(p)), 0))
                starts = np.flatnonzero(inside % ROW_HITS == 0)
                hits = pa.StructArray.from_arrays(
                    [
                        query_names.take(pa.array(query)), *(n.take(pa.array(cue[p])) for n in cue_names), pa.array(begin[p], pa.int64()),
                        term_names.take(pa.array(np.where(ahead, x, y))), term_names.take(pa.array(np.where(ahead, y, x))),
                    ],
                    ["query_id", "requested_relationship", "relation_cue", "relation_direction", "cue_position", "subject_term", "object_term"],
                )
                out = {n: batch.column(n).take(pa.array(cue_row[p][starts])) for n in columns}
                yield pa.RecordBatch.from_pydict(out | {"_hits": _nested(hits, starts)})
