"""Benchmark decontamination by pigeonhole edit matching over words.

Texts are compared as sequences of words without case and ASCII punctuation. A test item of n words is leaked where a
document holds it with at most n // ``WORDS_PER_ERROR`` word edits (insertions, deletions, substitutions). The item is
split into budget + 1 pieces; an occurrence within the budget leaves a piece unchanged, so exact piece hits find all
occurrences. Around the hits Myers' bit-parallel recurrence gives the smallest distance of the item to any stretch of the
document; machine words of any length hold the item's column.

A leak ends at the first end of the smallest distance; of the stretches that end there with it, the shortest is told, found by the same
recurrence backwards from the end. Items with fewer words than ``WORDS_PER_ERROR`` have no error budget and are found word for word,
wherever they stand. They name little by themselves (a one-word item is "leaked" everywhere), so a caller may ask for them only where they are
the whole document. Items without words never match. In scripts without spaces a word is a whole sentence: items of few words in them
are compared as sequences of characters, with one edit in ``UNITS_PER_ERROR`` characters.

The index of the pieces goes to the tasks in blocks of items of at most ``BLOCK_BYTES``, a pass over the documents for each block, so
the broadcast is bounded however many items there are. Documents are not shuffled. A passage in a third of all documents is verified in
the task of each document.

Null and empty texts hold nothing. Null ids, repeated rows and further columns stay as they are: each row is judged by
itself. Items repeated under several ids are reported under each.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dossier.llm.words import MARKS, plain, slices, windows, word_hashes, words

WORDS_PER_ERROR = 5
UNITS_PER_ERROR = 10
#: Characters of scripts without spaces: Thai, Lao, Myanmar, Khmer, kana and Han.
UNSPACED = re.compile("[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U0003ffff]")
BLOCK_BYTES = 16 << 20
LEAK = "array<struct<item_id: long, distance: int, first_word: int, last_word: int>>"


def myers(item: list[int], text: list[int], budget: int, anchored: bool = False) -> tuple[int, int] | None:
    """(distance, end) of the best stretch of ``text`` for ``item``, the first of equal ones; None beyond the budget.

    The stretch may start anywhere, or at the first word of ``text`` if it is ``anchored``.
    """
    places: dict[int, int] = defaultdict(int)
    for i, word in enumerate(item):
        places[word] |= 1 << i
    size = len(item)
    all_ones, top = (1 << size) - 1, 1 << (size - 1)
    plus, minus, distance, best = all_ones, 0, size, None
    for end, word in enumerate(text):
        equal = places.get(word, 0)
        vertical = equal | minus
        horizontal = (((equal & plus) + plus) ^ plus) | equal
        up = minus | (all_ones & ~(horizontal | plus))
        down = plus & horizontal
        if up & top:
            distance += 1
        elif down & top:
            distance -= 1
        up, down = (up << 1 | anchored) & all_ones, (down << 1) & all_ones
        plus = down | (all_ones & ~(vertical | up))
        minus = up & vertical
        if distance <= budget and (best is None or distance < best[0]):
            best = (distance, end)
    return best


def units(text: str) -> str:
    """The text with each character of a script without spaces as a word of its own."""
    return UNSPACED.sub(r" \g<0> ", text)


def unit_words(text: str) -> np.ndarray:
    """The word that each word of ``units(text)`` lies in."""
    runs = re.findall(r"[0-9A-Za-z\x80-\U0010ffff]+", text)
    return np.repeat(np.arange(len(runs)), [sum(map(bool, units(r).split(" "))) for r in runs])


class Pieces:
    """Items split into pieces, by piece length: sorted hashes, and for each the (item, offset) pairs that have it."""

    def __init__(self, rows: list[tuple[int, str]], per_error: int = WORDS_PER_ERROR, short: bool = True):
        texts = plain(pa.array([text for _, text in rows], pa.string()))
        w = words(texts, lower=True, apart=MARKS)
        hashes = word_hashes(w, 5)
        self.ids = [i for i, _ in rows]
        self.items = [hashes[w.first[k] : w.first[k + 1]] for k in range(len(rows))]
        self.budgets = [len(x) // per_error for x in self.items]
        long = set()
        if per_error == WORDS_PER_ERROR:
            long = {k for k, (_, text) in enumerate(rows) if not self.budgets[k] and len(UNSPACED.findall(text)) >= UNITS_PER_ERROR}
        self.units = Pieces([(rows[k][0], units(rows[k][1])) for k in sorted(long)], UNITS_PER_ERROR, short) if long else None
        self.short = short
        by_length: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
        for k, item in enumerate(self.items):
            if not len(item) or k in long:
                continue
            ends = np.linspace(0, len(item), self.budgets[k] + 2).astype(int)
            for begin, stop in zip(ends[:-1], ends[1:], strict=True):
                _, value = windows(item[begin:stop], np.zeros(stop - begin, dtype=np.int64), int(stop - begin), 13)
                by_length[int(stop - begin)].append((int(value[0]), k, int(begin)))
        self.lengths = {}
        for length, found in by_length.items():
            found.sort()
            keys = np.array([f[0] for f in found], dtype=np.uint64)
            self.lengths[length] = (keys, np.array([f[1] for f in found]), np.array([f[2] for f in found]))

    def leaks(self, hashes: np.ndarray, doc: np.ndarray, first: np.ndarray) -> dict[int, list[dict]]:
        """Leaks by row."""
        out: dict[int, list[dict]] = defaultdict(list)
        hit_rows, hit_items, hit_starts = [], [], []
        for length, (keys, items, offsets) in self.lengths.items():
            at, value = windows(hashes, doc, length, 13)
            low = np.searchsorted(keys, value, side="left")
            hit = np.flatnonzero((low < len(keys)) & (keys[np.minimum(low, len(keys) - 1)] == value))
            low, n = low[hit], np.searchsorted(keys, value[hit], side="right") - low[hit]
            each = np.repeat(np.arange(len(hit)), n)
            entry = low[each] + np.arange(len(each)) - np.repeat(np.cumsum(n) - n, n)
            hit_rows.append(doc[at[hit]][each])
            hit_items.append(items[entry])
            hit_starts.append(at[hit][each] - offsets[entry])
        if hit_rows:
            row, item, start = map(np.concatenate, (hit_rows, hit_items, hit_starts))
            order = np.lexsort((start, item, row))
            row, item, start = row[order], item[order], start[order]
            for r, k, begin, stop in self._stretches(row, item, start):
                begin = max(begin - self.budgets[k], first[r])
                stop = min(stop + len(self.items[k]) + self.budgets[k], first[r + 1])
                item, text = self.items[k].tolist(), hashes[begin:stop].tolist()
                best = myers(item, text, self.budgets[k])
                if best is None:
                    continue
                # backwards from its end, the stretch that leaves the same distance ends where it starts
                back = myers(item[::-1], text[best[1] :: -1], best[0], anchored=True)
                leak = {"item_id": self.ids[k], "distance": best[0], "first_word": int(begin - first[r] + best[1] - back[1]), "last_word": int(begin - first[r] + best[1])}
                if self.short or self.budgets[k] or len(item) == first[r + 1] - first[r]:
                    out[r].append(leak)
        return out

    def _stretches(self, row, item, start) -> Iterator[tuple[int, int, int, int]]:
        """Hits of a row and item, joined where their stretches of text overlap: (row, item, least start, largest start)."""
        if not len(row):
            return
        budget = np.array(self.budgets)[item]
        apart = (row[1:] != row[:-1]) | (item[1:] != item[:-1]) | (start[1:] - start[:-1] > 2 * budget[1:])
        begin = np.concatenate([[0], np.flatnonzero(apart) + 1])
        stop = np.append(begin[1:], len(row))
        for a, b in zip(begin.tolist(), stop.tolist(), strict=True):
            yield int(row[a]), int(item[a]), int(start[a]), int(start[b - 1])


def _blocks(items: DataFrame) -> Iterator[list[tuple[int, str]]]:
    """The items, in blocks of bounded size."""
    kept = items.where("text is not null").select(F.col("item_id").cast("long").alias("item_id"), "text")
    size = kept.agg(F.sum(F.octet_length("text") + 64)).first()[0] or 0
    blocks = -(-size // BLOCK_BYTES)
    for b in range(blocks):
        rows = kept.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b).collect()
        if rows:
            yield [(r["item_id"], r["text"]) for r in rows]


def with_leaks(docs: DataFrame, items: DataFrame, name: str = "leaks", short: bool = True) -> DataFrame:
    """``docs`` with the leaks found in each text: item, distance, first and last word. ``items`` holds (item_id, text).

    Without ``short``, items that have no error budget count only where they are the whole document.
    """
    marked = docs.withColumn(name, F.array().cast(LEAK))
    for rows in _blocks(items):
        marked = _pass(marked, docs.sparkSession.sparkContext.broadcast(Pieces(rows, short=short)), name)
    return marked


def _found(pieces: Pieces, texts) -> dict[int, list[dict]]:
    """Leaks by row of ``texts``."""
    out: dict[int, list[dict]] = {}
    for begin, stop in slices(texts):
        w = words(texts, begin, stop, lower=True, apart=MARKS)
        out |= {begin + row: leaks for row, leaks in pieces.leaks(word_hashes(w, 5), w.doc, w.first).items()}
    return out


def _pass(docs: DataFrame, pieces, name: str) -> DataFrame:
    at, text_at = docs.columns.index(name), docs.columns.index("text")
    out_type = pa.list_(pa.struct([("item_id", pa.int64()), ("distance", pa.int32()), ("first_word", pa.int32()), ("last_word", pa.int32())]))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, found = plain(batch.column(text_at)), batch.column(at).to_pylist()
            new = _found(pieces.value, texts)
            if pieces.value.units:
                held = [(i, t) for i, t in enumerate(batch.column(text_at).to_pylist()) if t and UNSPACED.search(t)]
                for k, leaks in _found(pieces.value.units, plain(pa.array([units(t) for _, t in held], pa.string()))).items():
                    row, word = held[k][0], unit_words(held[k][1])
                    new[row] = new.get(row, []) + [x | {y: int(word[x[y]]) for y in ("first_word", "last_word")} for x in leaks]
            for row, leaks in new.items():
                found[row] = found[row] + sorted(leaks, key=lambda x: (x["item_id"] is None, x["item_id"], x["first_word"]))
            columns = list(batch.columns)
            columns[at] = pa.array(found, out_type)
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    return docs.mapInArrow(run, T.StructType(docs.schema.fields))


def leaks(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, item_id, distance, first_word, last_word): a row for each stretch of a document that leaks an item."""
    found = with_leaks(docs.select("doc_id", "text"), items).select("doc_id", F.explode("leaks").alias("leak"))
    return found.select("doc_id", "leak.item_id", "leak.distance", "leak.first_word", "leak.last_word")
