"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

A text x is described by hashed words (counts, scaled to length 1), by structure statistics of the text and by metadata of the
row's size (its length class). The score is the logistic function of

    w0 + sum_i w_i x_i + 1/2 sum_f [ (sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2 ]

which holds all pairwise interactions of rank ``RANK`` in time linear in the features present (the sum-of-squares identity).
It is learnt from at most ``TRAIN_ROWS`` labelled rows, those of smallest hash, by adaptive gradient steps on the driver; the model
has a fixed size. Scoring describes every whole text in the tasks and shuffles nothing.

Labels come only from rows whose crc32(doc_id as text) mod ``FOLDS`` is not 0; labels, lang, source and doc_id are no inputs of
a score. Null and empty texts have no words and get the score of their statistics. Rows with null ids are scored and never learnt
from; labels without a document, null labels and repeated labels are allowed. Without labels of both kinds the score is their
smoothed share. Repeated rows score alike, further columns are kept.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dossier.llm.words import Words, plain, slices, word_hashes, words

BUCKETS = 1 << 14
RANK = 8
FOLDS = 5
THRESHOLD = 0.3
#: Bound of the labelled sample that the model is learnt from.
TRAIN_ROWS = 6000
EPOCHS = 6
BATCH_ROWS = 64
RATE, DECAY = 0.05, 1e-4
LENGTH_CLASSES = 24
STATISTICS = (
    "log_words", "mean_word", "long_words", "upper", "digits", "other_ascii", "beyond_ascii", "distinct_words", "top_word", "equal_neighbours",
    "bars", "exclamations", "marked_words", "capital_words", "single_bytes", "breaks", "full_stops", "longest_word",
)
_CLASS = np.zeros(256, dtype=np.int64)
_CLASS[65:91], _CLASS[97:123], _CLASS[48:58], _CLASS[128:] = 1, 2, 3, 4
_CLASS[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = 5


@dataclass
class Described:
    """Sparse and dense features of some rows: words by (row, bucket, value), metadata class and statistics by row."""

    row: np.ndarray
    bucket: np.ndarray
    value: np.ndarray
    length_class: np.ndarray
    dense: np.ndarray


def _per_row(weights: np.ndarray, edges: np.ndarray) -> np.ndarray:
    sums = np.concatenate([[0], np.cumsum(weights)])
    return sums[edges[1:]] - sums[edges[:-1]]


def describe(texts: pa.Array, begin: int, stop: int) -> Described:
    """Features of rows ``begin`` to ``stop`` of ``plain`` texts."""
    w: Words = words(texts, begin, stop)
    size = w.end - w.start
    n = np.diff(w.first)
    some = np.maximum(n, 1)
    folded = words(texts, begin, stop, lower=True)
    hashes = word_hashes(folded, 17)
    row, bucket, count = _counts(w.doc, (hashes % np.uint64(BUCKETS)).astype(np.int64))
    edges = np.searchsorted(row, np.arange(w.rows + 1))
    norm = np.sqrt(np.maximum(_per_row(count.astype(np.float64) ** 2, edges), 1))
    top = np.zeros(w.rows)
    np.maximum.at(top, row, count)

    kind = _CLASS[w.buffer]
    bytes_in = lambda mask: np.concatenate([[0], np.cumsum(mask)])
    chars = np.maximum(_per_row(size, w.first), 1)
    share = {}
    for name, mask in (("upper", kind == 1), ("digits", kind == 3), ("beyond_ascii", kind == 4), ("other_ascii", kind == 5)):
        sums = bytes_in(mask)
        per_word = sums[w.end] - sums[w.start]
        share[name] = _per_row(per_word, w.first) / chars
    first_byte = w.buffer[w.start]
    last_byte = w.buffer[np.maximum(w.end - 1, 0)]
    of_words = lambda mask: _per_row(mask, w.first) / some
    same = np.zeros(len(hashes), dtype=bool)
    same[1:] = (hashes[1:] == hashes[:-1]) & (w.doc[1:] == w.doc[:-1])
    lines = bytes_in(w.buffer == 10)
    gap_from = np.concatenate([[0], w.end[:-1]]) if len(w.end) else w.end
    longest = np.zeros(w.rows)
    np.maximum.at(longest, w.doc, size)
    dense = {
        "log_words": np.log1p(n), "mean_word": chars / some, "long_words": of_words(size > 14), **share,
        "distinct_words": np.diff(edges) / some, "top_word": top / some, "equal_neighbours": of_words(same),
        "bars": of_words((first_byte == 124) & (size == 1)), "exclamations": of_words(last_byte == 33),
        "marked_words": of_words(np.isin(last_byte, np.frombuffer(b"#$%&*@~^", dtype=np.uint8))),
        "capital_words": of_words(kind[w.start] == 1), "single_bytes": of_words(size == 1),
        "breaks": of_words(lines[w.start] - lines[gap_from] > 0) if len(w.start) else np.zeros(w.rows),
        "full_stops": of_words(last_byte == 46), "longest_word": np.log1p(longest),
    }
    length_class = np.minimum(np.log2(chars + n).astype(np.int64), LENGTH_CLASSES - 1)
    return Described(row, bucket, count / norm[row], length_class, np.column_stack([dense[s] for s in STATISTICS]).astype(np.float64))


def _counts(row: np.ndarray, bucket: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    key = np.sort(row * BUCKETS + bucket)
    at = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, dtype=np.int64)
    return key[at] // BUCKETS, key[at] % BUCKETS, np.diff(np.append(at, len(key)))


@dataclass
class Model:
    """Weights and factors of words, length classes and statistics, in this order, and the scale of the statistics."""

    bias: float
    weight: np.ndarray
    factor: np.ndarray
    mean: np.ndarray
    scale: np.ndarray

    def features(self, d: Described) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(edges, index, value) of all features present, by row."""
        rows, n_dense = d.dense.shape
        dense = np.clip((d.dense - self.mean) / self.scale, -4, 4)
        row = np.concatenate([d.row, np.arange(rows), np.repeat(np.arange(rows), n_dense)])
        index = np.concatenate([d.bucket, BUCKETS + d.length_class, np.tile(BUCKETS + LENGTH_CLASSES + np.arange(n_dense), rows)])
        value = np.concatenate([d.value, np.ones(rows), dense.ravel()])
        order = np.argsort(row, kind="stable")
        return np.searchsorted(row[order], np.arange(rows + 1)), row[order], index[order], value[order]

    def raw(self, edges, row, index, value) -> tuple[np.ndarray, np.ndarray]:
        """(w0 + linear + pairwise part, sums of factors) of rows; every row has features."""
        if len(edges) < 2:
            return np.zeros(0), np.zeros((0, RANK))
        scaled = self.factor[index] * value[:, None]
        sums = np.add.reduceat(scaled, edges[:-1])
        squares = np.add.reduceat((scaled * scaled).sum(axis=1), edges[:-1])
        linear = np.add.reduceat(self.weight[index] * value, edges[:-1])
        return self.bias + linear + 0.5 * ((sums * sums).sum(axis=1) - squares), sums

    def score(self, d: Described) -> np.ndarray:
        return _logistic(self.raw(*self.features(d))[0])


def _logistic(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def learnt(described: list[Described], labels: np.ndarray) -> Model:
    """A model of the labels; with one kind of label only, their smoothed share."""
    width = BUCKETS + LENGTH_CLASSES + len(STATISTICS)
    share = (labels.sum() + 1) / (len(labels) + 2)
    random = np.random.default_rng(7)
    dense = np.concatenate([d.dense for d in described]) if described else np.zeros((1, len(STATISTICS)))
    model = Model(float(np.log(share / (1 - share))), np.zeros(width), random.normal(0, 0.05, (width, RANK)), dense.mean(axis=0), dense.std(axis=0) + 1e-6)
    if not 0 < labels.sum() < len(labels):
        model.factor[:] = 0
        return model
    parts = [model.features(d) for d in described]
    first = np.cumsum([0] + [len(p[0]) - 1 for p in parts])
    row = np.concatenate([p[1] + f for p, f in zip(parts, first, strict=False)])
    index, value = (np.concatenate([p[k] for p in parts]) for k in (2, 3))
    edges = np.searchsorted(row, np.arange(len(labels) + 1))
    seen_w, seen_v, seen_b = np.full(width, 1e-6), np.full((width, RANK), 1e-6), 1e-6
    for _ in range(EPOCHS):
        order = random.permutation(len(labels))
        for batch in np.array_split(order, max(1, len(order) // BATCH_ROWS)):
            at = np.concatenate([np.arange(edges[r], edges[r + 1]) for r in batch])
            size = edges[batch + 1] - edges[batch]
            own, i, x = np.repeat(np.arange(len(batch)), size), index[at], value[at]
            raw, sums = model.raw(np.concatenate([[0], np.cumsum(size)]), own, i, x)
            error = (_logistic(raw) - labels[batch]) / len(batch)
            slope = error[own] * x
            unique, back = np.unique(i, return_inverse=True)
            grad_w = np.bincount(back, slope, len(unique)) + DECAY * model.weight[unique]
            pull = slope[:, None] * (sums[own] - model.factor[i] * x[:, None])
            grad_v = np.column_stack([np.bincount(back, pull[:, f], len(unique)) for f in range(RANK)]) + DECAY * model.factor[unique]
            seen_w[unique] += grad_w**2
            seen_v[unique] += grad_v**2
            seen_b += error.sum() ** 2
            model.weight[unique] -= RATE * grad_w / np.sqrt(seen_w[unique])
            model.factor[unique] -= RATE * grad_v / np.sqrt(seen_v[unique])
            model.bias -= RATE * error.sum() / np.sqrt(seen_b)
    return model


def held_out(doc_id: Column) -> Column:
    """Whether a row's labels are kept from learning; false for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> Model:
    """The model learnt from at most ``rows`` labelled rows of ``docs`` that are not held out."""
    known = labels.where("doc_id is not null and quality is not null").where(~held_out(F.col("doc_id")))
    # the sample is bounded by ``rows``, and so is what is broadcast and collected
    sample = known.select("doc_id", F.col("quality").cast("int").alias("quality")).orderBy(F.xxhash64("doc_id"), "doc_id", "quality").limit(rows)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = plain(batch.column(0))
            for begin, stop in slices(texts):
                d = describe(texts, begin, stop)
                edges = np.searchsorted(d.row, np.arange(stop - begin + 1))
                cut = lambda x, kind, e=edges: [x[a:b].astype(kind).tobytes() for a, b in zip(e[:-1], e[1:], strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(1).slice(begin, stop - begin), pa.array(cut(d.bucket, "<i2"), pa.binary()), pa.array(cut(d.value, "<f4"), pa.binary()),
                        pa.array(d.length_class, pa.int32()), pa.array([x.tobytes() for x in d.dense], pa.binary()),
                    ],
                    names=["quality", "bucket", "value", "length_class", "dense"],
                )

    texts = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").select("text", "quality")
    found = texts.mapInArrow(run, "quality int, bucket binary, value binary, length_class int, dense binary").collect()
    found.sort(key=lambda r: (bytes(r["bucket"]), bytes(r["dense"]), r["quality"]))
    described = []
    for r in found:
        bucket = np.frombuffer(r["bucket"], dtype="<i2").astype(np.int64)
        value = np.frombuffer(r["value"], dtype="<f4").astype(np.float64)
        described.append(Described(np.zeros(len(bucket), dtype=np.int64), bucket, value, np.array([r["length_class"]]), np.frombuffer(r["dense"])[None, :]))
    return learnt(_joined(described), np.array([r["quality"] for r in found], dtype=np.float64))


def _joined(rows: list[Described]) -> list[Described]:
    if not rows:
        return []
    row = np.repeat(np.arange(len(rows)), [len(d.row) for d in rows])
    join = lambda name: np.concatenate([getattr(d, name) for d in rows])
    return [Described(row, join("bucket"), join("value"), join("length_class"), join("dense"))]


def scored(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with score and predicted (1 where the score reaches ``threshold``, else 0)."""
    docs = docs.drop("score", "predicted")
    shared = docs.sparkSession.sparkContext.broadcast(model)
    text_at = docs.columns.index("text")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = plain(batch.column(text_at))
            scores = [shared.value.score(describe(texts, begin, stop)) for begin, stop in slices(texts)]
            score = np.concatenate(scores) if scores else np.zeros(0)
            columns = [*batch.columns, pa.array(score), pa.array((score >= threshold).astype(np.int32))]
            yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names, "score", "predicted"])

    added = [T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())]
    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, *added]))
