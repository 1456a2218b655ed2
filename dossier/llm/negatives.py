"""Hard negatives of anchor vectors by exact integer inner products, several candidates to a multiplication.

The components of some candidates are biased to be non-negative and packed into separated fields of one 64-bit integer (Kronecker
substitution). One multiplication by an anchor's component serves all of them, the sum over components is the packed inner
products, and taking off the anchor's share of the bias leaves each field exact. Field widths follow from the norms in hand
(Cauchy-Schwarz); vectors too long for one field of 64 bits use the same packing over integers of any length.

All rows meet the anchors in two scans that shuffle no vector: one finds the positives of each anchor, one the negatives of each
positive. The anchors go to the tasks in blocks of at most ``ANCHOR_BYTES``, one block at a time; a task keeps the best rows of each
anchor and sends nothing else. The work is that of (anchors x rows), which the stated anchors make it.

Components are floor(``SCALE`` x) of the double x. Rows with a null label, a null vector or a null or non-finite component take no
part, and neither do rows without an id. Of several rows with one id, the one with the least label, then vector, counts. Shorter
vectors (empty ones, too) count as ended by zeros. Scores beyond 2^55 either way count as that bound. Ties go to the smaller id. An anchor
without positives, or a positive without negatives in its band, gives no rows; empty tables give none. Other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dossier.plans.durable import durable
from dossier.plans.sizing import checked_broadcast

SCALE = 256
POSITIVES, NEGATIVES = 5, 3
#: Negatives score between these hundredths of the positive's score.
LEAST, MOST = 50, 95
ANCHOR_BYTES = 32 << 20
TILE_ANCHORS, TILE_ROWS = 64, 3072
_BOUND = 1 << 55
_NONE = -(1 << 62)


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, label, embedding) of the rows that take part, one for each id."""
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    fit = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.col("embedding").cast("array<double>").alias("embedding"))
    fit = fit.where("vec_id is not null and label is not null and embedding is not null").where(finite)
    several = durable(fit.groupBy("vec_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("vec_id"))
    if several.isEmpty():
        return fit
    several = checked_broadcast(several)
    least = fit.join(several, "vec_id", "left_semi").groupBy("vec_id").agg(F.min(F.struct("label", "embedding")).alias("_least"))
    return fit.join(several, "vec_id", "left_anti").unionByName(least.select("vec_id", "_least.label", "_least.embedding"))


def components(lists: pa.Array, width: int) -> np.ndarray:
    """floor(SCALE x) of each row, ended by zeros: 64-bit integers, or Python's where they do not hold them."""
    offsets = np.asarray(lists.offsets).astype(np.int64)
    flat = np.asarray(lists.values, dtype=np.float64) if len(lists.values) else np.zeros(0)
    sizes = np.diff(offsets)
    flat = flat[offsets[0] : offsets[-1]] if len(offsets) else flat
    row = np.repeat(np.arange(len(sizes)), sizes)
    at = np.arange(len(flat)) - np.repeat(offsets[:-1] - offsets[0], sizes)
    row, at, flat = row[at < width], at[at < width], flat[at < width]
    if not len(flat) or np.abs(flat).max() < 2.0**40:
        out = np.zeros((len(sizes), width), dtype=np.int64)
        out[row, at] = np.floor(flat * SCALE)
        return out
    out = np.zeros((len(sizes), width), dtype=object)
    out[row, at] = [math.floor(x * SCALE) if abs(x) < 2.0**53 else int(x) * SCALE for x in flat.tolist()]
    return out


def _norm(rows: np.ndarray) -> int:
    """At least the greatest length of a row."""
    if rows.dtype == object:
        return math.isqrt(max((sum(x * x for x in r) for r in rows), default=0)) + 1
    return int(np.sqrt((rows.astype(np.float64) ** 2).sum(axis=1).max(initial=0)) * (1 + 1e-9)) + 1


class Packed:
    """Candidates in fields of wide integers, for anchors up to a length."""

    def __init__(self, rows: np.ndarray, longest_anchor: int):
        self.rows, self.bias = len(rows), max(0, -int(rows.min(initial=0)))
        self.bits = (longest_anchor * _norm(rows)).bit_length() + 2
        self.wide = self.bits > 64 or rows.dtype == object
        self.fields = 1 if self.wide else 64 // self.bits
        kind = object if self.wide else np.uint64
        groups = -(-len(rows) // self.fields)
        raised = np.zeros((groups * self.fields, rows.shape[1]), dtype=kind)
        raised[: len(rows)] = (rows.astype(object) if self.wide else rows) + self.bias
        self.packed = np.zeros((rows.shape[1], groups), dtype=kind)
        for field in range(self.fields):
            self.packed += raised[field::self.fields].T << kind(field * self.bits) if not self.wide else raised.T
        #: One in each field.
        self.ones = sum(1 << (field * self.bits) for field in range(self.fields))

    def scores(self, anchors: np.ndarray) -> np.ndarray:
        """Exact inner products (anchors x candidates), cut at the bound."""
        if self.wide:
            exact = anchors.astype(object) @ self.packed if anchors.shape[1] else np.zeros((len(anchors), self.rows), dtype=object)
            exact = exact - self.bias * anchors.astype(object).sum(axis=1, initial=0)[:, None]
            return np.clip(exact, -_BOUND, _BOUND).astype(np.int64)
        factors, total = anchors.astype(np.uint64), np.zeros((len(anchors), self.packed.shape[1]), dtype=np.uint64)
        for k in range(anchors.shape[1]):
            total += factors[:, k, None] * self.packed[k]
        # modulo 2^64: the bias goes, and half a field is added so that no field borrows from the next
        half = 1 << (self.bits - 1)
        shift = [((half - self.bias * s) * self.ones) % (1 << 64) for s in anchors.sum(axis=1).tolist()]
        total += np.array(shift, dtype=np.uint64)[:, None]
        out = np.empty((len(anchors), total.shape[1] * self.fields), dtype=np.int64)
        mask = np.uint64((1 << self.bits) - 1) if self.bits < 64 else np.uint64(2**64 - 1)
        for field in range(self.fields):
            part = (total >> np.uint64(field * self.bits)) & mask
            out[:, field::self.fields] = (part - np.uint64(half)).astype(np.int64)
        return np.clip(out[:, : self.rows], -_BOUND, _BOUND)


def first_per_row(row: np.ndarray, score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k best entries of each row: higher scores first, then smaller ids."""
    order = np.lexsort((ids, -score, row))
    sorted_row = row[order]
    return order[np.arange(len(order)) - np.searchsorted(sorted_row, sorted_row) < k]


def _best(scores: np.ndarray, allowed: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, score, id) of the k best allowed candidates of each row of a tile."""
    masked = np.where(allowed, scores, _NONE)
    if masked.shape[1] > k:
        least = np.partition(masked, masked.shape[1] - k, axis=1)[:, masked.shape[1] - k]
        allowed = allowed & (masked >= least[:, None])
    row, at = np.nonzero(allowed)
    row, score, found = row, scores[row, at], ids[at]
    kept = first_per_row(row, score, found, k)
    return row[kept], score[kept], found[kept]


class Kept:
    """The best entries of each slot (an anchor, or an anchor's positive) so far."""

    def __init__(self, k: int, slots: int):
        self.k, self.limit = k, max(4 * k * slots, 1 << 16)
        self.parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.held = 0

    def add(self, slot: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        self.parts.append((slot, score, ids))
        self.held += len(slot)
        if self.held > self.limit:
            self.compact()

    def compact(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        slot, score, ids = (np.concatenate([p[i] for p in self.parts] or [np.zeros(0, dtype=np.int64)]) for i in range(3))
        kept = first_per_row(slot, score, ids, self.k)
        self.parts, self.held = [(slot[kept], score[kept], ids[kept])], len(kept)
        return self.parts[0]


class Anchors:
    """A block of anchors: ids, labels and components, and the scores of the positives of each, by slot."""

    def __init__(self, table: pa.Table, width: int):
        table = table.combine_chunks()
        column = lambda name: table.column(name).combine_chunks()
        self.ids, self.label = (np.asarray(column(name)).astype(np.int64) for name in ("vec_id", "label"))
        self.rows = components(_array(column("embedding")), width)
        self.norm = _norm(self.rows)
        self.positive = np.zeros((len(self.ids), 0), dtype=np.int64)
        self.has = np.zeros((len(self.ids), 0), dtype=bool)

    def with_positives(self, anchor_id: np.ndarray, rank: np.ndarray, score: np.ndarray) -> None:
        order = np.argsort(self.ids)
        at = order[np.searchsorted(self.ids, anchor_id, sorter=order)] if len(anchor_id) else np.zeros(0, dtype=np.int64)
        self.positive, self.has = np.zeros((len(self.ids), POSITIVES), dtype=np.int64), np.zeros((len(self.ids), POSITIVES), dtype=bool)
        self.positive[at, rank - 1], self.has[at, rank - 1] = score, True


def _array(column: pa.Array | pa.ChunkedArray) -> pa.Array:
    return pa.concat_arrays(column.chunks) if isinstance(column, pa.ChunkedArray) else column


def _positives(block: Anchors, ids: np.ndarray, label: np.ndarray, rows: np.ndarray, kept: Kept) -> None:
    for value in np.intersect1d(block.label, label):
        own, at = np.flatnonzero(block.label == value), np.flatnonzero(label == value)
        packed = Packed(rows[at], block.norm)
        for begin in range(0, len(own), TILE_ANCHORS):
            tile = own[begin : begin + TILE_ANCHORS]
            row, score, found = _best(packed.scores(block.rows[tile]), ids[at] != block.ids[tile][:, None], ids[at], POSITIVES)
            kept.add(tile[row], score, found)


def _negatives(block: Anchors, ids: np.ndarray, label: np.ndarray, rows: np.ndarray, kept: Kept) -> None:
    packed, own = Packed(rows, block.norm), np.flatnonzero(block.has.any(axis=1))
    for begin in range(0, len(own), TILE_ANCHORS):
        tile = own[begin : begin + TILE_ANCHORS]
        scores, other = packed.scores(block.rows[tile]), label != block.label[tile][:, None]
        for slot in range(block.positive.shape[1]):
            wanted = block.positive[tile, slot][:, None]
            inside = other & block.has[tile, slot][:, None] & (LEAST * wanted <= 100 * scores) & (100 * scores <= MOST * wanted)
            row, score, found = _best(scores, inside, ids, NEGATIVES)
            kept.add(tile[row] * POSITIVES + slot, score, found)


def _scan(fit: DataFrame, block: Anchors, width: int, search, k: int, slots: int, columns: str) -> DataFrame:
    """The best rows of each slot, found task by task."""
    shared = fit.sparkSession.sparkContext.broadcast(block)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, kept = shared.value, Kept(k, slots)
        for batch in batches:
            ids, label = (np.asarray(batch.column(name)).astype(np.int64) for name in ("vec_id", "label"))
            rows = components(_array(batch.column("embedding")), width)
            for begin in range(0, len(ids), TILE_ROWS):
                cut = slice(begin, begin + TILE_ROWS)
                search(block, ids[cut], label[cut], rows[cut], kept)
        slot, score, found = kept.compact()
        if len(slot):
            per = slots // max(len(block.ids), 1)
            yield pa.RecordBatch.from_arrays([pa.array(block.ids[slot // per]), pa.array((slot % per + 1).astype(np.int32)), pa.array(score), pa.array(found)], names=["anchor_id", "slot", "score", "found"])

    return fit.select("vec_id", "label", "embedding").mapInArrow(run, columns)


def _ranked(found: DataFrame, keys: list[str], k: int) -> DataFrame:
    """The first k of each key over all tasks; a task sent at most k of each."""
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), "found")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def hard_negatives(vectors: DataFrame, anchor: Column, block_bytes: int = ANCHOR_BYTES) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of the rows of ``vectors`` (vec_id, label,
    embedding) that ``anchor`` tells to be anchors."""
    fit = usable(vectors)
    size = fit.where(anchor).agg(F.count(F.lit(1)).alias("n"), F.max(F.size("embedding")).alias("width")).first()
    # components behind an anchor's last meet zeros
    width = int(size["width"] or 0)
    blocks = max(1, math.ceil(size["n"] * max(width, 1) * 8 / block_bytes))
    columns = "anchor_id long, slot int, score long, found long"
    results = []
    for number in range(blocks):
        mine = fit.where(anchor).where(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == number)
        block = Anchors(mine.toArrow(), width)
        near = _ranked(_scan(fit, block, width, _positives, POSITIVES, len(block.ids), columns), ["anchor_id"], POSITIVES)
        positives = durable(near.select("anchor_id", F.col("rank").alias("slot"), F.col("found").alias("positive_id"), F.col("score").alias("positive_score")))
        told = positives.toArrow().combine_chunks()
        block.with_positives(*(np.asarray(told.column(name).combine_chunks()).astype(np.int64) for name in ("anchor_id", "slot", "positive_score")))
        hard = _ranked(_scan(fit, block, width, _negatives, NEGATIVES, len(block.ids) * POSITIVES, columns), ["anchor_id", "slot"], NEGATIVES)
        rows = hard.join(positives, ["anchor_id", "slot"]).select(
            "anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("found").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")
        )
        results.append(rows if blocks == 1 else durable(rows))
    out = results[0]
    for rows in results[1:]:
        out = out.unionByName(rows)
    return out
