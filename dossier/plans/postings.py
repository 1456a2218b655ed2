"""Scores of texts for short lists of queries, by the lists of queries that ask for a term.

A task walks over its rows in Arrow batches: terms become numbers, numbers lists of queries, and sums over these lists are the scores of all
pairs of a batch. Of each group of pairs it can pass on the best alone, so neither pairs nor texts are shuffled or sorted.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Pairs of rows and queries that are looked at in one step.
STEP_PAIRS = 2_000_000


@dataclass(frozen=True)
class Postings:
    """``terms`` in order; entries ``starts[t]:starts[t + 1]`` of the other arrays are the queries that have term t."""

    queries: list[str]
    terms: list[str]
    starts: np.ndarray
    query: np.ndarray
    own: np.ndarray
    #: how often the term is asked for by the query; 0 where it only counts for the score
    asked: np.ndarray
    phrases: list[str | None]
    #: terms of its own that a text with the phrase surely holds
    least: np.ndarray
    #: packages that are left out, or that alone are looked at, as (package, query)
    named: dict[str, list[int]] | None
    only: bool


def postings(
    terms: Sequence[tuple], asked: Sequence[tuple] | None, named: Sequence[tuple] | None = None, only: bool = False
) -> Postings:
    """``terms``: (query, term, expanded, phrase). ``asked``: (query, term), all of ``terms`` if None. ``named``: (query, package)."""
    times: dict[tuple[str, str], int] = {}
    for q, t in (r[:2] for r in (terms if asked is None else asked)):
        times[q, t] = times.get((q, t), 0) + 1
    queries = sorted({q for q, _ in times if q is not None})
    place = {q: i for i, q in enumerate(queries)}
    entries, phrases, own = {}, [None] * len(queries), [set() for _ in queries]
    for q, t, expanded, phrase in terms:
        if q not in place:
            continue
        i = place[q]
        entries[t, i] = entries.get((t, i), False) or not expanded
        if not expanded:
            own[i].add(t)
        if phrase is not None and (phrases[i] is None or phrase > phrases[i]):
            phrases[i] = phrase
    for q, t in times:
        if q in place:
            entries.setdefault((t, place[q]), None)
    listed = sorted(entries)
    words = sorted({t for t, _ in listed})
    number = {t: i for i, t in enumerate(words)}
    counts = np.bincount([number[t] for t, _ in listed], minlength=len(words))
    least = [len(own[i].intersection((phrases[i] or "").split(" ")[1:-1])) for i in range(len(queries))]
    packages = None
    if named is not None:
        packages = {}
        for q, p in named:
            if q in place and p is not None:
                packages.setdefault(p, []).append(place[q])
    return Postings(
        queries, words, np.concatenate([[0], np.cumsum(counts)]).astype(np.int64), np.array([i for _, i in listed], np.int64),
        np.array([-1 if entries[e] is None else int(entries[e]) for e in listed], np.int8),
        np.array([times.get((queries[i], t), 0) for t, i in listed], np.int64), phrases, np.array(least, np.int64), packages, only,
    )


def _order(rows: pa.RecordBatch, keys: Sequence[tuple[str, bool]]) -> np.ndarray:
    """Place of each row by ``keys`` (column, nulls last)."""
    columns, sort = {}, []
    for k, (name, last) in enumerate(keys):
        null = rows.column(name).is_null()
        columns[f"n{k}"], columns[f"v{k}"] = (null if last else pc.invert(null)), rows.column(name)
        sort += [(f"n{k}", "ascending"), (f"v{k}", "ascending")]
    at = pc.sort_indices(pa.table(columns), sort_keys=sort).to_numpy()
    place = np.empty(len(at), np.int64)
    place[at] = np.arange(len(at))
    return place


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """All numbers of the ranges that begin at ``starts``, one range after the other."""
    ends = np.cumsum(sizes)
    return np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(starts - ends + sizes, sizes)


def _scored(rows: pa.RecordBatch, p: Postings, vocabulary: pa.Array, weights: tuple[int, int, int]) -> tuple[np.ndarray, ...]:
    """(row, query, score, times) of the pairs that share an asked term, each once."""
    held, n = rows.column("_t"), len(p.queries)
    sizes = np.asarray(pc.fill_null(pc.list_value_length(held), 0))
    found = pc.index_in(held.flatten(), value_set=vocabulary)
    known = np.asarray(found.is_valid())
    term = np.asarray(found.fill_null(0))[known].astype(np.int64)
    row = np.repeat(np.arange(len(rows)), sizes)[known]
    many = p.starts[term + 1] - p.starts[term]
    entry, row = _ranges(p.starts[term], many), np.repeat(row, many)
    pair = row * n + p.query[entry]
    if p.named is not None:
        package, code = rows.column("package_id").dictionary_encode(), None
        code = np.asarray(package.indices.fill_null(len(package.dictionary)))
        listed = np.zeros((len(package.dictionary) + 1, n), bool)
        for i, name in enumerate(package.dictionary.to_pylist()):
            listed[i, p.named.get(name, [])] = True
        kept = listed[code[row], p.query[entry]] == p.only
        pair, entry = pair[kept], entry[kept]
    of = len(rows) * n
    own = np.bincount(pair[p.own[entry] == 1], minlength=of)
    score = weights[0] * own + weights[1] * np.bincount(pair[p.own[entry] == 0], minlength=of)
    wanted = p.asked[entry] > 0
    if p.asked.max(initial=0) > 1:
        # entries lie in the order of terms: the first asked one tells how often a pair is asked for
        by_term = np.argsort(entry[wanted], kind="stable")
        keys, first = np.unique(pair[wanted][by_term], return_index=True)
        times = p.asked[entry[wanted][by_term][first]]
    else:
        keys = np.flatnonzero(np.bincount(pair[wanted], minlength=of))
        times = np.ones(len(keys), np.int64)
    row, query = keys // n, keys % n
    points, own = score[keys].astype(np.int64), own[keys]
    norm = rows.column("_norm")
    for i in np.flatnonzero((own >= p.least[query]) & (own >= 0)):
        phrase = p.phrases[query[i]]
        if phrase is not None and phrase in norm[int(row[i])].as_py():
            points[i] += weights[2]
    return row, query, points, times


def _best(group: np.ndarray, score: np.ndarray, place: np.ndarray, n: int) -> np.ndarray:
    """The pairs that are among the ``n`` first of their group."""
    at = np.lexsort((place, -score, group))
    sorted_ = group[at]
    begins = np.concatenate([[True], sorted_[1:] != sorted_[:-1]]) if len(at) else np.zeros(0, bool)
    nth = np.arange(len(at)) - np.maximum.accumulate(np.where(begins, np.arange(len(at)), 0))
    return at[nth < n]


def score_batches(
    batches: Iterator[pa.RecordBatch], p: Postings, columns: Sequence[str], weights: tuple[int, int, int], words: bool,
    best: int | None, by_package: bool, keys: Sequence[tuple[str, bool]],
) -> Iterator[pa.RecordBatch]:
    """``columns`` of the rows with query_id and lexical_score, and with the terms in common if ``words``; the ``best`` of each query, or of each query and package."""
    vocabulary, names = pa.array(p.terms, pa.string()), pa.array(p.queries, pa.string())
    own, wide = ([set() for _ in p.queries] for _ in range(2))
    for t, term in enumerate(p.terms):
        for e in range(p.starts[t], p.starts[t + 1]):
            if p.own[e] >= 0:
                (own if p.own[e] else wide)[p.query[e]].add(term)
    step = max(1, STEP_PAIRS // max(1, len(p.queries)))
    for batch in batches if p.queries else ():
        for at in range(0, len(batch), step):
            rows = batch.slice(at, step)
            row, query, score, times = _scored(rows, p, vocabulary, weights)
            if best is not None:
                group = query
                if by_package:
                    code = rows.column("package_id").dictionary_encode()
                    group = query * (len(code.dictionary) + 1) + np.asarray(code.indices.fill_null(len(code.dictionary)))[row]
                kept = _best(group, score, _order(rows, keys)[row], best)
                row, query, score, times = row[kept], query[kept], score[kept], times[kept]
            if len(times) and times.max() > 1:
                row, query, score = (np.repeat(x, times) for x in (row, query, score))
            out = {"query_id": names.take(pa.array(query))} | {c: rows.column(c).take(pa.array(row)) for c in columns} | {"lexical_score": pa.array(score, pa.int64())}
            if words:
                held = {int(r): rows.column("_t")[int(r)].as_py() for r in np.unique(row)}
                for name, of in (("_own", own), ("_wide", wide)):
                    out[name] = pa.array([[t for t in held[int(r)] if t in of[q]] for r, q in zip(row, query)], pa.list_(pa.string()))
            yield pa.RecordBatch.from_pydict(out)
