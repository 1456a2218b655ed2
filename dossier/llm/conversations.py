"""Repair of conversations whose turns were lost, emptied, cut, doubled or given to the wrong role.

A repaired conversation has the roles ``(s?(ua)+)?`` (an optional system turn, then user and assistant in turn). Edits of a row: Keep (0),
Rerole to user or assistant (1), Delete (2, the only one for blank and duplicate rows); Insert puts an empty user or assistant turn
anywhere (5); a truncated row that stays adds 5. Of all cheapest repairs the one counts whose edits, written as initials in order,
come first in ASCII.

The grammar has four states: nothing yet, after the system turn, after a user turn, after an assistant turn. A row is a table of the
cheapest edits from each state to each state, together with the order of their initials; tables of neighbouring rows join to a
table of the stretch. No audit of a stretch begins another one's (each row leaves exactly one letter that is not an insertion, and
insertions belong to the row behind them), so that orders join, too. The repair is found by Hirschberg's divide and conquer: forward
costs from a stretch's first state (four numbers) and backward costs to its last meet in the middle, the cheapest and then
audit-least state there is the crossing, and both halves are solved between their states, down to single rows. Space is linear
in the rows, and all stretches of a level are solved at once.

Rows are ordered by conversation and turn over the whole table, so that a conversation may be of any size: pieces of at most
``PIECE_ROWS`` consecutive rows are read at a time. Conversations inside a piece are solved there. Those at its edges send
one table for each piece, the tables of a conversation are solved as rows are, and each piece repairs its part between the states found.

A null role or text counts as one space, a null conv_id is a conversation of its own; null turns come first. Rows of one turn are ordered by a digest of role
and text, so that repeated rows are neighbours. A role is known by its first character. Rows that are not ``present`` only name their conversation: without others it has an
empty audit and no rows. Other columns are not read; empty tables give no rows. Very long texts are moved, never looked into.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from itertools import product

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dossier.plans.durable import durable
from dossier.plans.sizing import checked_broadcast

INITIALS = "sua"
START, SYSTEM, USER, ASSISTANT = range(4)
REROLE, DELETE, INSERT, CUT = 1, 2, 5, 5
#: A piece of the ordered rows has at most so many (a power of two).
PIECE_ROWS = 1 << 16
SPACES = r"[\x20\x09-\x0D]"
_FAR = 1 << 50
_TURN = {START: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
_COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
_NAMES = ("user", "assistant")


# --- tables of rows -------------------------------------------------------------------------------------


def _kept(kind: int, state: int) -> int | None:
    """The state behind a kept row of this initial."""
    if kind == 0:
        return SYSTEM if state == START else None
    return _TURN[state] if kind in (1, 2) and _TURN[state] == kind + 1 else None


def _row_table(kind: int, fault: int) -> list[list[tuple[int, str] | None]]:
    """(cost, initials) of the best way over a row from each state to each state; fault: none, truncated, to be deleted."""
    best: list[list[tuple[int, str] | None]] = [[None] * 4 for _ in range(4)]
    for state in range(4):
        at = state
        # two insertions come back to the same side of the alternation
        for inserted in range(3):
            stay = CUT if fault == 1 else 0
            ways = [(DELETE, "D", at)]
            if fault != 2:
                if (to := _kept(kind, at)) is not None:
                    ways.append((stay, "K", to))
                ways.append((REROLE + stay, "R", _TURN[at]))
            for cost, letter, to in ways:
                found = (cost + INSERT * inserted, "I" * inserted + letter)
                best[state][to] = min(best[state][to] or found, found)
            at = _TURN[at]
    return best


#: By 3 * initial (s, u, a, other) + fault; the last one is no row.
TABLES = [_row_table(kind, fault) for kind, fault in product(range(4), range(3))]
TABLES.append([[(0, "") if s == t else None for t in range(4)] for s in range(4)])
NO_ROW = len(TABLES) - 1


def _orders(table: list[list[tuple[int, str] | None]]) -> list[list[int]]:
    return [[sorted(e[1] for e in line if e).index(e[1]) if e else 9 for e in line] for line in table]


COST = np.array([[[e[0] if e else _FAR for e in line] for line in table] for table in TABLES], dtype=np.int64)
ORDER = np.array([_orders(table) for table in TABLES], dtype=np.int8)
#: Insertions that end a conversation, from each state.
TAIL = ["", "II", "I", ""]
TAIL_COST = np.array([INSERT * len(t) for t in TAIL], dtype=np.int64)


def joined(cost: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Tables of neighbouring pairs of stretches: (..., 2k, 4, 4) to (..., k, 4, 4)."""
    left, right, first, second = cost[..., ::2, :, :], cost[..., 1::2, :, :], order[..., ::2, :, :], order[..., 1::2, :, :]
    through = left[..., :, :, None] + right[..., None, :, :]
    crossing = np.argmin(np.minimum(through, _FAR) * 16 + first[..., :, :, None], axis=-2)
    total = np.minimum(np.take_along_axis(through, crossing[..., None, :], axis=-2)[..., 0, :], _FAR)
    ahead = np.take_along_axis(first, crossing, axis=-1).astype(np.int64)
    behind = np.take_along_axis(second, crossing[..., :, :], axis=-2).astype(np.int64)
    place = np.where(total < _FAR, ahead * 16 + behind, 999)
    return total, np.where(total < _FAR, np.argsort(np.argsort(place, axis=-1), axis=-1), 9).astype(np.int8)


def levels(cost: np.ndarray, order: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Tables of all stretches of 1, 2, 4 ... rows; the number of rows is a power of two."""
    out = [(cost, order)]
    while out[-1][0].shape[-3] > 1:
        out.append(joined(*out[-1]))
    return out


def crossings(tables: list[tuple[np.ndarray, np.ndarray]], start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The states before and behind each row, of the repairs from ``start`` to ``end``, one for each conversation."""
    before, behind = start[:, None], end[:, None]
    for cost, order in reversed(tables[:-1]):
        size = before.shape[1]
        who, place = np.arange(len(before))[:, None], np.arange(size)[None, :]
        forward, backward = cost[who, 2 * place, before], cost[who, 2 * place + 1, :, behind]
        middle = np.argmin(np.minimum(forward + backward, _FAR) * 16 + order[who, 2 * place, before], axis=-1)
        before, behind = np.stack([before, middle], axis=-1).reshape(-1, 2 * size), np.stack([middle, behind], axis=-1).reshape(-1, 2 * size)
    return before, behind


def ends(cost: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(last state, cost) of whole conversations, from their tables."""
    total = cost[:, START] + TAIL_COST
    end = np.argmin(total * 16 + order[:, START], axis=1)
    return end, total[np.arange(len(end)), end]


def _by_size(sizes: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(power of two, stretches that it holds), so that stretches of about one size are solved together."""
    width = np.where(sizes > 0, 1 << np.ceil(np.log2(np.maximum(sizes, 1))).astype(np.int64), 0)
    for size in np.unique(width):
        yield int(size), np.flatnonzero(width == size)


# --- rows -----------------------------------------------------------------------------------------------


def _runs(batch: pa.RecordBatch) -> np.ndarray:
    """Where the runs of a batch begin, with an end."""
    new = np.ones(batch.num_rows, dtype=bool)
    for name in ("conv_id", "piece"):
        value = np.asarray(pc.fill_null(batch.column(batch.schema.get_field_index(name)).dictionary_encode().indices, -1))
        new[1:] &= value[1:] == value[:-1]
    new[1:] = ~new[1:]
    return np.append(np.flatnonzero(new), batch.num_rows)


class Piece:
    """Consecutive rows of some runs (a conversation, or the part of it that lies in a piece)."""

    def __init__(self, batch: pa.RecordBatch):
        self.batch = batch
        column = lambda name: batch.column(batch.schema.get_field_index(name))
        flag = lambda name: np.asarray(column(name).fill_null(False).cast(pa.uint8())).astype(bool)
        n = batch.num_rows
        #: The first row of each run, with an end.
        self.first = _runs(batch)
        self.run = np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))
        self.present = flag("present")
        self.kind = np.asarray(column("kind")).astype(np.int64)
        self.has_turn = np.asarray(column("turn").is_valid())
        self.turn = np.asarray(column("turn").fill_null(0)).astype(np.int64)
        blank = self.present & flag("blank")
        digest = np.frombuffer(b"".join(column("digest").to_pylist()), dtype="<u8").reshape(n, 2)
        told = np.flatnonzero(self.present & ~blank)
        order = told[np.lexsort((told, digest[told, 1], digest[told, 0], self.run[told]))]
        again = np.zeros(n, dtype=bool)
        again[order[1:]] = (self.run[order[1:]] == self.run[order[:-1]]) & (digest[order[1:]] == digest[order[:-1]]).all(axis=1)
        if "earlier" in batch.schema.names:
            again |= self.present & ~blank & flag("earlier")
        cut = self.present & ~blank & ~again & flag("truncated")
        self.blank, self.duplicate, self.truncated = blank, again, cut
        self.type = np.where(self.present, 3 * self.kind + np.where(blank | again, 2, cut), NO_ROW)

    @property
    def runs(self) -> int:
        return len(self.first) - 1

    def counts(self) -> dict[str, np.ndarray]:
        """What is told of each run but its cost; turns by their first, last and number."""
        per_run = lambda rows: np.bincount(self.run[rows], minlength=self.runs).astype(np.int64)
        out = {"blank": per_run(self.blank), "duplicate": per_run(self.duplicate), "truncated": per_run(self.truncated)}
        here = np.flatnonzero(self.present)
        pair = self.run[here[1:]] == self.run[here[:-1]]
        out["illegal"] = per_run(here[1:][pair & ~legal(self.kind[here[:-1]], self.kind[here[1:]])])
        out["first_kind"], out["last_kind"] = self._ends(here, self.kind)
        timed = np.flatnonzero(self.present & self.has_turn)
        new = np.ones(len(timed), dtype=bool)
        new[1:] = (self.run[timed[1:]] != self.run[timed[:-1]]) | (self.turn[timed[1:]] != self.turn[timed[:-1]])
        out["turns"] = per_run(timed[new])
        out["first_turn"], out["last_turn"] = self._ends(timed, self.turn)
        return out

    def _ends(self, rows: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The values of the first and the last of ``rows`` in each run; -1 where it has none."""
        low, high = np.searchsorted(rows, self.first[:-1]), np.searchsorted(rows, self.first[1:]) - 1
        some = high >= low
        first, last = np.full(self.runs, -1, dtype=np.int64), np.full(self.runs, -1, dtype=np.int64)
        first[some], last[some] = values[rows[low[some]]], values[rows[high[some]]]
        return first, last

    def grids(self) -> Iterator[tuple[np.ndarray, np.ndarray, list[tuple[np.ndarray, np.ndarray]]]]:
        """(runs, their rows or -1, tables of their stretches) by size."""
        sizes = np.diff(self.first)
        for width, some in _by_size(sizes):
            place = np.arange(width)
            rows = np.where(place < sizes[some][:, None], self.first[:-1][some][:, None] + place, -1)
            kinds = np.where(rows >= 0, self.type[rows], NO_ROW)
            yield some, rows, levels(COST[kinds], ORDER[kinds])

    def repaired(self, start: np.ndarray | None = None, end: np.ndarray | None = None, last: np.ndarray | None = None) -> tuple[np.ndarray, list[str], pa.Array]:
        """(costs, audits, repaired turns) of the runs, between states if they are given; ``last`` tells which runs end a conversation."""
        before, behind = np.zeros(len(self.run), dtype=np.int64), np.zeros(len(self.run), dtype=np.int64)
        cost, final = np.zeros(self.runs, dtype=np.int64), np.zeros(self.runs, dtype=np.int64)
        for some, rows, tables in self.grids():
            if end is None:
                final[some], cost[some] = ends(tables[-1][0][:, 0], tables[-1][1][:, 0])
                first = np.full(len(some), START)
            else:
                first, final[some] = start[some], end[some]
            inside, (p, q) = rows >= 0, crossings(tables, first, final[some])
            before[rows[inside]], behind[rows[inside]] = p[inside], q[inside]
        audits, turns, sizes = [], [], []
        n = len(self.run)
        types, before, behind = self.type.tolist(), before.tolist(), behind.tolist()
        for run, (low, high) in enumerate(zip(self.first[:-1].tolist(), self.first[1:].tolist(), strict=True)):
            letters, count = [], len(turns)
            for row in range(low, high):
                edits = TABLES[types[row]][before[row]][behind[row]][1]
                letters.append(edits)
                state = before[row]
                for letter in edits:
                    if letter == "K":
                        turns.append((row, row))
                    elif letter in "RI":
                        state = _TURN[state]
                        # texts and the names of roles lie behind the rows
                        turns.append((n + state - USER, row if letter == "R" else n))
            tail = TAIL[final[run]] if last is None or last[run] else ""
            state = int(final[run])
            for _ in tail:
                state = _TURN[state]
                turns.append((n + state - USER, n))
            audits.append("".join(letters) + tail)
            sizes.append(len(turns) - count)
        at = np.array(turns, dtype=np.int64).reshape(-1, 2)
        column = lambda name, more: pa.concat_arrays([self.batch.column(self.batch.schema.get_field_index(name)).cast(pa.string()), pa.array(more, pa.string())])
        whole = pa.StructArray.from_arrays([column("role", list(_NAMES)).take(pa.array(at[:, 0])), column("text", [""]).take(pa.array(at[:, 1]))], names=["role", "text"])
        offsets = pa.array(np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)]).astype(np.int32))
        return cost, audits, pa.ListArray.from_arrays(offsets, whole)


def legal(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    return ((first == 0) & (second == 1)) | ((first == 1) & (second == 2)) | ((first == 2) & (second == 1))


def _gaps(first: np.ndarray, last: np.ndarray, turns: np.ndarray) -> np.ndarray:
    return np.where(turns > 0, last - first + 1 - turns, 0)


def _pieces(batches: Iterable[pa.RecordBatch], key: str = "piece") -> Iterator[pa.RecordBatch]:
    """The rows of one ``key`` after the other, whole; they lie together and are of bounded number."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        value = np.asarray(batch.column(batch.schema.get_field_index(key)))
        cuts = [0, *(np.flatnonzero(value[1:] != value[:-1]) + 1).tolist(), len(value)]
        for low, high in zip(cuts[:-1], cuts[1:], strict=True):
            if held and held[-1].column(held[-1].schema.get_field_index(key))[-1].as_py() != value[low]:
                yield _whole(held)
                held = []
            held.append(batch.slice(low, high - low))
    if held:
        yield _whole(held)


def _whole(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
    return pa.concat_batches(parts) if len(parts) > 1 else parts[0]


# --- plans ----------------------------------------------------------------------------------------------


def ordered(turns: DataFrame) -> DataFrame:
    """The rows of ``turns`` (conv_id, turn, role, text, present) in order, with what is asked of them and the piece they lie in."""
    role, text = F.coalesce("role", F.lit(" ")), F.coalesce("text", F.lit(" "))
    kind = F.instr(F.lit(INITIALS), F.substring(role, 1, 1))
    rows = turns.select(
        "conv_id", F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"), F.coalesce("present", F.lit(False)).alias("present"),
        F.unhex(F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text))).alias("digest"),
        F.when((F.length(role) > 0) & (kind > 0), kind - 1).otherwise(3).cast("int").alias("kind"),
        (~text.rlike(r"[^\x20\x09-\x0D]")).alias("blank"), (~text.rlike(rf"[.!?]{SPACES}*\z")).alias("truncated"),
    )
    sort = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), F.col("digest")]
    placed = rows.repartitionByRange(*sort).sortWithinPartitions(*sort).withColumn("place", F.monotonically_increasing_id())
    return durable(placed.withColumn("piece", F.shiftright("place", PIECE_ROWS.bit_length() - 1)))


def _inner(kind: T.DataType) -> str:
    return f"conv_id {kind.simpleString()}, piece long, last boolean, " + "".join(f"{c} long, " for c in _COUNTS) + "audit string, repaired array<struct<role:string,text:string>>"


def _of_runs(piece: Piece, columns: dict[str, np.ndarray], audits: list[str], turns: pa.Array, last: np.ndarray) -> pa.RecordBatch:
    keys = [piece.batch.column(piece.batch.schema.get_field_index(name)).take(pa.array(piece.first[:-1])) for name in ("conv_id", "piece")]
    return pa.RecordBatch.from_arrays(
        [*keys, pa.array(last), *(pa.array(columns[c]) for c in _COUNTS), pa.array(audits, pa.string()), turns], names=["conv_id", "piece", "last", *_COUNTS, "audit", "repaired"]
    )


def repaired(turns: DataFrame) -> DataFrame:
    """(conv_id, piece, last, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired) of all conversations of ``turns``.

    A conversation has one row, or several by ``piece`` if it lies on the edge of a piece: audit and repaired are then its
    parts in order, counts stand at its ``last`` part, the others hold zeros.
    """
    rows = ordered(turns)
    kind = rows.schema["conv_id"].dataType

    def inside(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in _pieces(batches):
            cut = _runs(whole)
            if len(cut) > 3:
                piece = Piece(whole.slice(int(cut[1]), int(cut[-2] - cut[1])))
                told = piece.counts()
                told["cost"], audits, repaired_turns = piece.repaired()
                told["gaps"] = _gaps(told["first_turn"], told["last_turn"], told["turns"])
                yield _of_runs(piece, told, audits, repaired_turns, np.ones(piece.runs, dtype=bool))

    def edges(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in _pieces(batches):
            cut = _runs(whole)
            yield whole.slice(0, int(cut[1]))
            if len(cut) > 2:
                yield whole.slice(int(cut[-2]))

    done = rows.mapInArrow(inside, _inner(kind))
    return done.unionByName(_over_pieces(rows.mapInArrow(edges, rows.schema), kind))


_SUMMARY = ("blank", "duplicate", "truncated", "illegal", "first_kind", "last_kind", "turns", "first_turn", "last_turn")


def _same(a: DataFrame, b: DataFrame, *names: str) -> Column:
    """The rows of two tables that agree in columns that may be null; those of ``b`` have a mark before their names."""
    out = F.lit(True)
    for name in names:
        out = out & a[name].eqNullSafe(b[f"_{name}"])
    return out


def _over_pieces(edge: DataFrame, kind: T.DataType) -> DataFrame:
    """The conversations that lie on edges of pieces."""
    edge = durable(edge)
    seen = edge.where("present and not blank").select("conv_id", "digest", "piece").distinct()
    firsts = seen.groupBy("conv_id", "digest").agg(F.min("piece").alias("first"), F.max("piece").alias("behind")).where("behind > first")
    late = checked_broadcast(firsts.select(F.col("conv_id").alias("_conv_id"), F.col("digest").alias("_digest"), "first"))
    told = edge.join(late, _same(edge, late, "conv_id", "digest"), "left").withColumn("earlier", F.col("piece") > F.col("first")).drop("_conv_id", "_digest", "first")
    told = durable(told.repartition("conv_id", "piece").sortWithinPartitions("conv_id", "piece", "place"))

    def summary(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in _pieces(batches):
            piece = Piece(whole)
            counts, cost, order = piece.counts(), np.zeros((piece.runs, 16), dtype=np.int64), np.zeros((piece.runs, 16), dtype=np.int64)
            for some, _, tables in piece.grids():
                cost[some], order[some] = tables[-1][0].reshape(-1, 16), tables[-1][1].reshape(-1, 16)
            keys = [whole.column(whole.schema.get_field_index(name)).take(pa.array(piece.first[:-1])) for name in ("conv_id", "piece")]
            yield pa.RecordBatch.from_arrays(
                [*keys, *(pa.array(counts[c]) for c in _SUMMARY), pa.array(list(cost), pa.list_(pa.int64())), pa.array(list(order), pa.list_(pa.int64()))], names=["conv_id", "piece", *_SUMMARY, "costs", "orders"]
            )

    def chain(table: pa.Table) -> pa.Table:
        table = table.combine_chunks().sort_by("piece")
        get = {c: np.asarray(table.column(c)) for c in _SUMMARY}
        n = table.num_rows
        size = 1 << max(n - 1, 0).bit_length()
        cost, order = np.repeat(COST[NO_ROW][None], size, axis=0), np.repeat(ORDER[NO_ROW][None], size, axis=0)
        cost[:n] = np.array(table.column("costs").to_pylist()).reshape(n, 4, 4)
        order[:n] = np.array(table.column("orders").to_pylist()).reshape(n, 4, 4)
        tables = levels(cost[None], order[None])
        end, total = ends(tables[-1][0][:, 0], tables[-1][1][:, 0])
        before, behind = crossings(tables, np.zeros(1, dtype=np.int64), end)
        last = np.arange(n) == n - 1
        out = {c: np.where(last, get[c].sum(), 0) for c in ("blank", "duplicate", "truncated")}
        some, timed = np.flatnonzero(get["first_kind"] >= 0), np.flatnonzero(get["turns"] > 0)
        apart = int((~legal(get["last_kind"][some[:-1]], get["first_kind"][some[1:]])).sum())
        out["illegal"] = np.where(last, get["illegal"].sum() + apart, 0)
        gaps = 0
        if len(timed):
            shared = int((get["last_turn"][timed[:-1]] == get["first_turn"][timed[1:]]).sum())
            gaps = int(get["last_turn"][timed[-1]] - get["first_turn"][timed[0]] + 1 - (get["turns"].sum() - shared))
        out["gaps"], out["cost"] = np.where(last, gaps, 0), np.where(last, total[0], 0)
        columns = {"_conv_id": table.column("conv_id"), "_piece": table.column("piece"), "_last": last, **{f"_{c}": out[c] for c in _COUNTS}, "_before": before[0, :n], "_behind": behind[0, :n]}
        return pa.table(columns)

    names = f"_conv_id {kind.simpleString()}, _piece long, _last boolean, " + "".join(f"_{c} long, " for c in _COUNTS) + "_before long, _behind long"
    tables = told.mapInArrow(summary, f"conv_id {kind.simpleString()}, piece long, " + "".join(f"{c} long, " for c in _SUMMARY) + "costs array<long>, orders array<long>")
    # one row for each conversation on the edge of a piece
    states = checked_broadcast(tables.groupBy("conv_id").applyInArrow(chain, names))
    between = told.join(states, _same(told, states, "conv_id", "piece")).drop("_conv_id", "_piece")
    between = between.repartition("conv_id", "piece").sortWithinPartitions("conv_id", "piece", "place")

    def solve(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in _pieces(batches):
            piece = Piece(whole)
            get = {c: np.asarray(whole.column(whole.schema.get_field_index(f"_{c}")).cast(pa.int64()))[piece.first[:-1]] for c in ("last", *_COUNTS, "before", "behind")}
            last = get["last"].astype(bool)
            _, audits, repaired_turns = piece.repaired(get["before"], get["behind"], last)
            yield _of_runs(piece, get, audits, repaired_turns, last)

    return between.mapInArrow(solve, _inner(kind))


def digests(parts: DataFrame) -> DataFrame:
    """One row for each conversation of ``repaired``: counts, whole audit and the SHA-256 of its lines ``role:text``.

    Conversations of one row are digested where they lie. The parts of others follow each other through one task, which holds the state
    of the hash and the audit only: a digest of a whole conversation can't be had in parts.
    """
    lines = F.array_join(F.transform("repaired", lambda t: F.concat(t["role"], F.lit(":"), t["text"])), "\n")
    several = durable(parts.where("not last").select("conv_id").distinct())
    columns = ["conv_id", *_COUNTS, "audit"]
    if several.isEmpty():
        return parts.select(*columns, F.sha2(lines, 256).alias("repaired_sha256"))
    split = checked_broadcast(several.select(F.col("conv_id").alias("_conv_id")))
    single = parts.join(split, _same(parts, split, "conv_id"), "left_anti").select(*columns, F.sha2(lines, 256).alias("repaired_sha256"))
    many = parts.join(split, _same(parts, split, "conv_id"), "left_semi").select(*columns, "piece", "last", F.size("repaired").alias("n"), lines.alias("lines"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, audit, held = hashlib.sha256(), [], False
        for batch in batches:
            for row in range(batch.num_rows):
                at = batch.slice(row, 1)
                get = dict(zip(batch.schema.names, (c[0].as_py() for c in at.columns), strict=True))
                if get["n"]:
                    state.update((("\n" if held else "") + get["lines"]).encode())
                    held = True
                audit.append(get["audit"])
                if get["last"]:
                    kept = [at.column(at.schema.get_field_index(c)) for c in ("conv_id", *_COUNTS)]
                    yield pa.RecordBatch.from_arrays([*kept, pa.array(["".join(audit)]), pa.array([state.hexdigest()])], names=[*columns, "repaired_sha256"])
                    state, audit, held = hashlib.sha256(), [], False

    return single.unionByName(many.repartition("conv_id").sortWithinPartitions("conv_id", "piece").mapInArrow(run, single.schema))

