"""Toxic passages as maximum-scoring segments of word scores, and a toxicity score by extreme-value statistics.

Words are runs of ASCII letters and digits and of all characters beyond ASCII; A to Z are folded. A word scores the log-odds of its toxic
share against that of all words. Shares have Beta (two-class Dirichlet) priors in a chain: words that begin alike in their first
four characters have the share of the whole as prior, a word has that of its beginning, so that unseen forms of a toxic word are
judged by how they begin. ``DRIFT`` is taken off each word, so that plain text scores below zero.

One pass finds all maximal segments of a text (Ruzzo and Tompa, 1999): only words above zero are looked at, each joins segments at
most once. The best segment of a clean text of n words follows an extreme-value law: with E(S) = K n exp(-L S) segments of score S to be
expected (Karlin and Altschul, 1990), x = -ln E is Gumbel distributed. L and K are fitted to clean texts; every segment with
E below ``EXPECTED`` is a significant passage. A text is judged by the sum of x over its significant passages, corrected for
their number, or by its best segment if none is; a logistic curve fitted to the labels turns it into a score.

Counts come from at most ``TRAIN_ROWS`` labelled rows, those of smallest hash, gathered per bucket in the tasks; the model has a fixed size.
Curves are fitted to statistics that leave out each text's own counts. Labels come only from rows whose crc32(doc_id as text)
mod ``FOLDS`` is not ``HELD``; labels, lang, source and doc_id are no inputs of a score. Texts without words (null or empty) have no passage
and the score of the lowest statistic. Rows with null ids are scored and never learnt from; null labels and labels without a
document are skipped, repeated labels count each. Without labels of both kinds the score is their smoothed share. Repeated rows
score alike, very long texts are read whole, further columns are kept; columns named score, predicted or passages are replaced.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dossier.llm.words import MARKS, plain, slices, word_hashes, words
from dossier.plans.durable import durable

FOLDS, HELD = 3, 1
THRESHOLD = 0.7
#: Bound of the labelled sample that the model is learnt from.
TRAIN_ROWS = 20_000
#: Hash classes of words, and of beginnings behind them.
WORDS, BEGINNINGS = 1 << 20, 1 << 18
PREFIX_CHARS = 4
#: Weights of the priors, in texts.
CORPUS_PRIOR, PREFIX_PRIOR = 8.0, 6.0
DRIFT = 0.7
EXPECTED = 0.05
#: Statistics beyond say nothing more: e^-20 such segments are to be expected.
FLOOR, CEILING = -10.0, 20.0
_EULER = 0.5772156649
_PASSAGES = "array<struct<first:long,last:long,score:double,expected:double>>"


@dataclass
class Tokens:
    """Word and beginning buckets of some rows; ``first`` is each row's first word, with an end."""

    word: np.ndarray
    beginning: np.ndarray
    row: np.ndarray
    first: np.ndarray


def tokens(texts: pa.Array, begin: int, stop: int) -> Tokens:
    """Buckets of the words of rows ``begin`` to ``stop`` of ``plain`` texts."""
    w = words(texts, begin, stop, lower=True, apart=MARKS)
    word = (word_hashes(w, 29) % np.uint64(WORDS)).astype(np.int64)
    # the byte behind the fourth character, found among the bytes that begin one
    lead = np.append(np.flatnonzero((w.buffer & 0xC0) != 0x80), [len(w.buffer)] * PREFIX_CHARS)
    fourth = lead[np.minimum(np.searchsorted(lead, w.start) + PREFIX_CHARS, len(lead) - 1)]
    w.end = np.minimum(w.end, fourth)
    beginning = WORDS + (word_hashes(w, 31) % np.uint64(BEGINNINGS)).astype(np.int64)
    return Tokens(word, beginning, w.doc, w.first)


def segments(score: np.ndarray) -> list[tuple[int, int, float]]:
    """(first, behind last, score) of all maximal scoring segments, in order (Ruzzo and Tompa)."""
    above = np.flatnonzero(score > 0)
    if not len(above):
        return []
    total = np.concatenate([[0.0], np.cumsum(score)])
    held: list[tuple[int, int, float, float]] = []
    before: list[int] = []
    for at, low, high in zip(above.tolist(), total[above].tolist(), total[above + 1].tolist(), strict=True):
        first, behind = at, at + 1
        j = len(held) - 1
        while True:
            # the nearest segment that starts lower
            while j >= 0 and held[j][2] >= low:
                j = before[j]
            if j < 0 or held[j][3] >= high:
                break
            first, low = held[j][0], held[j][2]
            del held[j:], before[j:]
            j = len(held) - 1
        before.append(j)
        held.append((first, behind, low, high))
    return [(first, behind, high - low) for first, behind, low, high in held]


@dataclass
class Model:
    """Counts of toxic and all texts by bucket, and the fitted curves."""

    toxic: np.ndarray
    all: np.ndarray
    toxic_rows: int
    rows: int
    rate: float = 1.0
    log_k: float = 0.0
    slope: float = 0.0
    shift: float = 0.0

    @property
    def base(self) -> float:
        return (self.toxic_rows + 1) / (self.rows + 2)

    def of_words(self, t: Tokens, label: np.ndarray | None = None) -> np.ndarray:
        """Scores of words; with labels, each row's own counts are left out."""
        n_word, n_begin, a_word, a_begin = self.all[t.word], self.all[t.beginning], self.toxic[t.word], self.toxic[t.beginning]
        if label is not None:
            own = label[t.row]
            n_word, n_begin, a_word, a_begin = n_word - 1, n_begin - 1, a_word - own, a_begin - own
        base = self.base
        share = (a_begin + CORPUS_PRIOR * base) / (n_begin + CORPUS_PRIOR)
        share = (a_word + PREFIX_PRIOR * share) / (n_word + PREFIX_PRIOR)
        return np.log(share / (1 - share)) - np.log(base / (1 - base)) - DRIFT

    def normal(self, score: float, n: int) -> float:
        """-ln of the number of segments of at least this score to be expected in a clean text of n words."""
        return self.rate * score - self.log_k - float(np.log(max(n, 1)))

    def judge(self, score: np.ndarray) -> tuple[float, list[tuple[int, int, float, float]]]:
        """(statistic, significant passages) of one text's word scores."""
        found = segments(score)
        x = [self.normal(s, len(score)) for _, _, s in found]
        passages = [(first, behind, s, float(np.exp(-v))) for (first, behind, s), v in zip(found, x, strict=True) if v >= -np.log(EXPECTED)]
        return self.statistic(x, len(score)), passages

    def statistic(self, x: list[float], n: int) -> float:
        """What a text of n words is judged by, from the normalised scores of its segments."""
        if not x:
            return self.lowest(n)
        parts = sorted((v for v in x if v >= -np.log(EXPECTED)), reverse=True)
        if len(parts) < 2:
            return max(x)
        # the sum of the first r normalised scores, less what r segments gain by being chosen
        return float((np.cumsum(parts) - np.cumsum(np.log(np.arange(1, len(parts) + 1)))).max())

    def lowest(self, n: int) -> float:
        return self.normal(0.0, max(n, 1))

    def score(self, x: np.ndarray) -> np.ndarray:
        return _logistic(self.slope * np.clip(x, FLOOR, CEILING) + self.shift)

    def judged(self, texts: pa.Array, begin: int, stop: int, label: np.ndarray | None = None) -> tuple[np.ndarray, list]:
        t = tokens(texts, begin, stop)
        scores = self.of_words(t, label)
        found = [self.judge(scores[a:b]) for a, b in zip(t.first[:-1], t.first[1:], strict=True)]
        return np.array([x for x, _ in found], dtype=np.float64), [passages for _, passages in found]


def _logistic(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def _law(best: np.ndarray, n: np.ndarray) -> tuple[float, float]:
    """(L, ln K) such that L * best - ln(K n) is a standard Gumbel variable: maximum likelihood, L by bisection."""
    best, n = best[n > 0], n[n > 0]
    if len(best) < 2 or best.std() < 1e-9:
        return 1.0, 0.0
    spread = np.log(n)

    def at(rate: float) -> tuple[float, float]:
        # with m = exp(-L s) n, the best ln K is -ln mean(m); the slope of the likelihood in L follows
        log_m = spread - rate * best
        top = log_m.max()
        m = np.exp(log_m - top)
        return 1 / rate - best.mean() + float((best * m).sum() / m.sum()), -(top + float(np.log(m.mean())))

    low, high = 1e-3, 1e3
    for _ in range(80):
        middle = (low * high) ** 0.5
        low, high = (middle, high) if at(middle)[0] > 0 else (low, middle)
    return low, at(low)[1]


def _curve(x: np.ndarray, label: np.ndarray) -> tuple[float, float]:
    """(slope, shift) of the logistic curve, by Newton steps with smoothed labels (Platt, 1999)."""
    x = np.clip(x, FLOOR, CEILING)
    n1, n0 = label.sum(), (1 - label).sum()
    goal = np.where(label > 0, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    design, beta = np.column_stack([x, np.ones(len(x))]), np.zeros(2)
    loss = lambda b: float(np.sum(np.logaddexp(0, design @ b) - goal * (design @ b)))
    for _ in range(60):
        p = _logistic(design @ beta)
        hessian = design.T @ (design * np.maximum(p * (1 - p), 1e-9)[:, None]) + 1e-6 * np.eye(2)
        step, size = np.linalg.solve(hessian, design.T @ (goal - p)), 1.0
        while size > 1e-4 and loss(beta + size * step) > loss(beta):
            size /= 2
        beta = beta + size * step
        if np.abs(size * step).max() < 1e-9:
            break
    return float(max(beta[0], 0.0)), float(beta[1])


def held_out(doc_id: Column) -> Column:
    """Whether a row's labels are kept from learning; false for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == HELD, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> Model:
    """The model learnt from at most ``rows`` labelled rows of ``docs`` that are not held out."""
    known = labels.where("doc_id is not null and toxic is not null").where(~held_out(F.col("doc_id")))
    # the sample is bounded by ``rows``, and so is what is broadcast; a repeated id keeps to one text of its rows
    sample = known.select("doc_id", F.col("toxic").cast("int").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id", "toxic").limit(rows)
    texts = durable(docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").select("toxic", "text"))

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            label, whole = np.asarray(batch.column(0)).astype(np.int64), plain(batch.column(1))
            for begin, stop in slices(whole):
                t = tokens(whole, begin, stop)
                # a bucket counts once in a text
                key = np.unique(np.concatenate([t.row, t.row]) * (WORDS + BEGINNINGS) + np.concatenate([t.word, t.beginning]))
                bucket, own = key % (WORDS + BEGINNINGS), label[begin + key // (WORDS + BEGINNINGS)]
                found, back = np.unique(bucket, return_inverse=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(found.astype(np.int32)), pa.array(np.bincount(back, own, len(found)).astype(np.int64)), pa.array(np.bincount(back, minlength=len(found)).astype(np.int64))],
                    names=["bucket", "toxic", "n"],
                )

    kinds = {int(r["toxic"] > 0): int(r["n"]) for r in texts.groupBy((F.col("toxic") > 0).cast("int").alias("toxic")).agg(F.count(F.lit(1)).alias("n")).collect()}
    width = WORDS + BEGINNINGS
    model = Model(np.zeros(width, dtype=np.float32), np.zeros(width, dtype=np.float32), kinds.get(1, 0), sum(kinds.values()))
    if len(kinds) < 2:
        model.shift = float(np.log(model.base / (1 - model.base)))
        return model
    # at most one row for each bucket
    counted = texts.mapInArrow(count, "bucket int, toxic long, n long").groupBy("bucket").agg(F.sum("toxic").alias("toxic"), F.sum("n").alias("n")).toArrow()
    at = np.asarray(counted.column("bucket").combine_chunks())
    model.toxic[at], model.all[at] = (np.asarray(counted.column(name).combine_chunks()) for name in ("toxic", "n"))

    shared = docs.sparkSession.sparkContext.broadcast(model)

    def best(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            label, whole = np.asarray(batch.column(0)).astype(np.int64), plain(batch.column(1))
            for begin, stop in slices(whole):
                t = tokens(whole, begin, stop)
                score = shared.value.of_words(t, label[begin:stop])
                found = [[s for _, _, s in segments(score[a:b])] for a, b in zip(t.first[:-1], t.first[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(label[begin:stop]), pa.array(np.diff(t.first)), pa.array(found, pa.list_(pa.float64()))], names=["toxic", "n", "segments"])

    told = texts.mapInArrow(best, "toxic long, n long, segments array<double>").toArrow()
    label, n = (np.asarray(told.column(name).combine_chunks()).astype(np.float64) for name in ("toxic", "n"))
    found = told.column("segments").to_pylist()
    top = np.array([max(s, default=0.0) for s in found])
    model.rate, model.log_k = _law(top[label == 0], n[label == 0])
    x = np.array([model.statistic([model.normal(s, size) for s in own], size) for own, size in zip(found, n.tolist(), strict=True)])
    model.slope, model.shift = _curve(x, label)
    return model


def scored(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with score, predicted (1 where the score reaches ``threshold``, else 0) and passages: the first and last word of each
    significant passage (from 0), its score and the number of such segments to be expected in a clean text of that length."""
    docs = docs.drop("score", "predicted", "passages")
    shared = docs.sparkSession.sparkContext.broadcast(model)
    text_at = docs.columns.index("text")
    schema = T.StructType([*docs.schema.fields, T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType()), T.StructField("passages", T._parse_datatype_string(_PASSAGES))])
    kind = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64()), ("score", pa.float64()), ("expected", pa.float64())]))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = plain(batch.column(text_at))
            statistic, passages = [np.zeros(0)], []
            for begin, stop in slices(texts):
                x, found = shared.value.judged(texts, begin, stop)
                statistic.append(x)
                passages += [[(first, behind - 1, s, e) for first, behind, s, e in p] for p in found]
            score = shared.value.score(np.concatenate(statistic))
            spans = [[{"first": a, "last": b, "score": s, "expected": e} for a, b, s, e in p] for p in passages]
            columns = [*batch.columns, pa.array(score), pa.array((score >= threshold).astype(np.int32)), pa.array(spans, kind)]
            yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names, "score", "predicted", "passages"])

    return docs.mapInArrow(run, schema)
