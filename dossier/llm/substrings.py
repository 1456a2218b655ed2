"""Removal of word windows that an earlier document holds, behind a count-min prefilter.

1. Each block of documents counts its windows in a partial sketch of two lines of counters (at most 2 each, since only
   "once" and "more" matter). The sketch is cut into ranges of ``RANGE_CELLS`` counters; a block sends the non-zero ones.
2. Each range adds its partial sketches and answers each block with those of its cells that reach 2. No sketch is
   gathered or broadcast, its width follows the size of the corpus.
3. Blocks read their texts again. Windows whose counters both reach 2 are estimated repeated; sums never fall short,
   so no repeated window is lost. Only these are grouped exactly, by 96 bits of two independent hashes, each block having
   reduced them to one entry with its smallest document. (Two of 10^10 different windows share the bits with a chance
   of 10^-9.) The answer is the smallest document of all.
4. Blocks read their texts a third time and drop every word that such a window covers.

A window in a third of all documents is one entry per block, so no group grows with its copies; the memory of a task is
that of a block or a range. Texts are shuffled once, into blocks, and read from that shuffle three times.

Null and empty texts have no words. Null ids come after all others. Rows with the same id do not remove each other's words.
Shorter texts than a window are kept whole. An empty table gives an empty result. Further columns do not matter.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dossier.llm.packing import cuts, in_blocks, pack, text_bytes, unpack
from dossier.llm.words import plain, slices, windows, word_hashes, words

WINDOW_WORDS = 13
RANGE_CELLS = 1 << 23
LINES = 2
#: Counters of a line for each byte of text: about four for each window of usual words.
CELLS_PER_BYTE = 0.7
LAST = np.iinfo(np.int64).max


@dataclass
class Windows:
    """The windows of a block: first word (counted over the block), document row, and two hashes."""

    at: np.ndarray
    row: np.ndarray
    h1: np.ndarray
    h2: np.ndarray
    first_word: np.ndarray


def _windows(table: pa.Table, size: int) -> Windows:
    texts = plain(table["text"])
    at, row, h1, h2, first, before, docs = [], [], [], [], [np.zeros(1, dtype=np.int64)], 0, 0
    for begin, stop in slices(texts):
        w = words(texts, begin, stop)
        place, one = windows(word_hashes(w, 1), w.doc, size, 1)
        _, two = windows(word_hashes(w, 2), w.doc, size, 2)
        at.append(place + before)
        row.append(w.doc[place] + docs)
        h1.append(one)
        h2.append(two)
        first.append(w.first[1:] + before)
        before += len(w.start)
        docs += stop - begin
    join = lambda parts, kind: np.concatenate(parts) if parts else np.zeros(0, dtype=kind)
    return Windows(join(at, np.int64), join(row, np.int64), join(h1, np.uint64), join(h2, np.uint64), np.concatenate(first))


def _ids(table: pa.Table) -> np.ndarray:
    return table["doc_id"].combine_chunks().fill_null(LAST).to_numpy(zero_copy_only=False).astype(np.int64)


def _distinct(w: Windows, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order of the windows by hash, number of each ordered window's distinct value, first of each value)."""
    order = np.argsort(w.h1, kind="stable")
    a, b = w.h1[order], w.h2[order]
    if np.any((a[1:] == a[:-1]) & (b[1:] != b[:-1])):
        order = np.lexsort((w.h2, w.h1))
        a, b = w.h1[order], w.h2[order]
    new = np.ones(len(a), dtype=bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    return order, np.cumsum(new) - 1, np.flatnonzero(new)


def _sketch(table: pa.Table, size: int, ranges: int) -> pa.Table:
    w = _windows(table, size)
    block = table["block"][0].as_py()
    lines, cells = [], []
    for line, h in enumerate((w.h1, w.h2)):
        cell = np.sort(h % np.uint64(ranges * RANGE_CELLS))
        if len(cell) > 2:
            cell = np.concatenate([cell[:2], cell[2:][cell[2:] != cell[:-2]]])
        ends = np.searchsorted(cell, np.arange(ranges + 1, dtype=np.uint64) * np.uint64(RANGE_CELLS))
        for k in range(ranges):
            if ends[k] < ends[k + 1]:
                lines.append(line * ranges + k)
                cells.append(pack(cell[ends[k] : ends[k + 1]].astype(np.int64) - k * RANGE_CELLS))
    return pa.table({"line": pa.array(lines, pa.int32()), "block": pa.array([block] * len(lines), pa.int32()), "cells": pa.array(cells, pa.binary())})


def _merged(table: pa.Table) -> pa.Table:
    """Adds the partial counters of a range; answers each block with its cells that reach 2."""
    count = np.zeros(RANGE_CELLS, dtype=np.uint8)
    parts = [np.unique(unpack(x.as_py()), return_counts=True) for x in table["cells"]]
    for cell, n in parts:
        count[cell] = np.minimum(count[cell] + n.astype(np.uint8), 2)
    repeated = [cell[count[cell] == 2] for cell, _ in parts]
    out = pa.table({"line": table["line"], "block": table["block"], "cells": pa.array(map(pack, repeated), pa.binary())})
    return out.filter(pa.array([len(x) > 0 for x in repeated], pa.bool_()))


def _candidates(docs: pa.Table, answers: pa.Table, size: int, ranges: int, groups: int) -> pa.Table:
    """One entry for each distinct window of a block that is estimated repeated, dealt by its first hash."""
    if not docs.num_rows:
        return _entries([], [], [], [], [], [])
    w, ids = _windows(docs, size), _ids(docs)
    order, value, first = _distinct(w, ids)
    smallest = np.minimum.reduceat(ids[w.row[order]], first) if len(first) else ids[:0]
    h1, h2 = w.h1[order][first], w.h2[order][first]
    keep = np.ones(len(h1), dtype=bool)
    line_of = answers["line"].to_numpy()
    for line, h in enumerate((h1, h2)):
        rows = np.flatnonzero(line_of // ranges == line)
        rows = rows[np.argsort(line_of[rows], kind="stable")]
        known = [unpack(answers["cells"][int(i)].as_py()) + int(line_of[i] % ranges) * RANGE_CELLS for i in rows]
        known = np.concatenate([*known, np.array([LAST])]).astype(np.uint64)
        at = np.flatnonzero(keep)
        cell = h[at] % np.uint64(ranges * RANGE_CELLS)
        keep[at] = known[np.searchsorted(known, cell)] == cell
    at = np.flatnonzero(keep)
    h1, h2, smallest = h1[at], h2[at], smallest[at]
    ends = cuts((h1 >> np.uint64(32)) * np.uint64(groups) >> np.uint64(32), groups)
    block, out = docs["block"][0].as_py(), ([], [], [], [], [], [])
    for k in range(groups):
        if (s := slice(ends[k], ends[k + 1])).start < s.stop:
            for to, x in zip(out, (k, block, pack(at[s]), h1[s].tobytes(), (h2[s] >> np.uint64(32)).astype(np.uint32).tobytes(), smallest[s].tobytes()), strict=True):
                to.append(x)
    return _entries(*out)


def _entries(group, block, at, h1, h2, doc) -> pa.Table:
    kinds = (pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.binary())
    return pa.table({n: pa.array(v, k) for n, v, k in zip(("grp", "block", "at", "h1", "h2", "doc"), (group, block, at, h1, h2, doc), kinds, strict=True)})


def _firsts(table: pa.Table) -> pa.Table:
    """Groups entries exactly; answers a block where another one holds a smaller document."""
    read = lambda name, kind: np.concatenate([np.frombuffer(x.as_py(), dtype=kind) for x in table[name]])
    h1, h2, doc = read("h1", "<u8"), read("h2", "<u4"), read("doc", "<i8")
    at = [unpack(x.as_py()) for x in table["at"]]
    order = np.lexsort((h2, h1))
    a, b = h1[order], h2[order]
    new = np.ones(len(a), dtype=bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    first = np.flatnonzero(new)
    smallest = np.empty(len(doc), dtype=np.int64)
    smallest[order] = np.repeat(np.minimum.reduceat(doc[order], first), np.diff(np.append(first, len(a))))
    earlier, ends, out = smallest < doc, np.cumsum([0, *map(len, at)]), ([], [], [])
    for i, block in enumerate(table["block"].to_pylist()):
        s = slice(ends[i], ends[i + 1])
        if (hit := earlier[s]).any():
            for to, x in zip(out, (block, pack(at[i][hit]), smallest[s][hit].tobytes()), strict=True):
                to.append(x)
    return pa.table({"block": pa.array(out[0], pa.int32()), "at": pa.array(out[1], pa.binary()), "doc": pa.array(out[2], pa.binary())})


def _removed(docs: pa.Table, answers: pa.Table, size: int) -> pa.Table:
    names = {"doc_id": pa.int64(), "n_words": pa.int64(), "n_removed": pa.int64(), "kept": pa.string()}
    if not docs.num_rows:
        return pa.table({n: pa.array([], k) for n, k in names.items()})
    w, ids = _windows(docs, size), _ids(docs)
    order, value, first = _distinct(w, ids)
    covered = np.zeros(w.first_word[-1] + 1, dtype=np.int32)
    if len(first):
        smallest = np.minimum.reduceat(ids[w.row[order]], first)
        for at, doc in zip(answers["at"], answers["doc"], strict=True):
            smallest[unpack(at.as_py())] = np.frombuffer(doc.as_py(), dtype="<i8")
        hit = order[smallest[value] < ids[w.row[order]]]
        np.add.at(covered, w.at[hit], 1)
        np.subtract.at(covered, w.at[hit] + size, 1)
    gone = np.cumsum(covered)[:-1] > 0
    before = np.concatenate([[0], np.cumsum(gone)])
    n_removed = before[w.first_word[1:]] - before[w.first_word[:-1]]
    kept = []
    for i, text in enumerate(docs["text"]):
        found = (text.as_py() or "").encode("utf-8").split()
        if n_removed[i]:
            found = compress(found, ~gone[w.first_word[i] : w.first_word[i + 1]])
        kept.append(b" ".join(found).decode("utf-8"))
    columns = (docs["doc_id"], np.diff(w.first_word), n_removed, kept)
    return pa.table({n: c if isinstance(c, pa.ChunkedArray) else pa.array(c, k) for (n, k), c in zip(names.items(), columns, strict=True)})


def without_repeats(docs: DataFrame, size: int = WINDOW_WORDS) -> DataFrame:
    """(doc_id, n_words, n_removed, kept): the words that no repeated window covers, joined by single spaces."""
    blocks = in_blocks(docs)
    ranges = max(1, -(-int(text_bytes(docs) * CELLS_PER_BYTE) // RANGE_CELLS))
    groups = ranges * 2
    sketch = blocks.groupBy("block").applyInArrow(lambda t: _sketch(t, size, ranges), "line int, block int, cells binary")
    repeated = sketch.groupBy("line").applyInArrow(_merged, "line int, block int, cells binary")
    entries = (
        blocks.groupBy("block")
        .cogroup(repeated.groupBy("block"))
        .applyInArrow(lambda a, b: _candidates(a, b, size, ranges, groups), "grp int, block int, at binary, h1 binary, h2 binary, doc binary")
    )
    firsts = entries.groupBy("grp").applyInArrow(_firsts, "block int, at binary, doc binary")
    return (
        blocks.groupBy("block")
        .cogroup(firsts.groupBy("block"))
        .applyInArrow(lambda a, b: _removed(a, b, size), "doc_id long, n_words long, n_removed long, kept string")
    )


def windows_of(text: str, size: int = WINDOW_WORDS) -> list[tuple[str, ...]]:
    """The windows of one text, for explanations and tests."""
    found = [x.decode("utf-8") for x in text.encode("utf-8").split()]
    return [tuple(found[i : i + size]) for i in range(len(found) - size + 1)]
