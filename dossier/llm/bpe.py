"""Byte-level BPE encoding and decoding over whole texts.

A text is cut at special tokens, then by the pre-tokenizer's pattern into pieces. Each distinct piece is merged once per
worker: one list holds the ids of the parts, a second contiguous list the rank of each adjacent pair. The smallest
rank is found by a scan, its boundary deleted, and only the two neighbouring ranks are computed anew. Pieces beyond
``SCAN_PARTS`` parts keep the ranks in a heap, because scans of a long list cost the square of its length; the order
of merges (smallest rank, then leftmost) is the same.

Nothing is shuffled. A task holds the vocabulary, two bounded tables of pieces (the current and the one before) and the ids of about
``SLICE_BYTES`` of text; the tables go when it ends, since the worker lives on and serves other stages.
Null texts are encoded as empty ones: no ids. Null or repeated ``doc_id`` and further columns do not matter, one row
comes out for each row that goes in.
"""

from __future__ import annotations

import functools
import heapq
import itertools
import json
import struct
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from dossier.llm.words import bounded

SCAN_PARTS = 64
CACHED_PIECES = 100_000
CACHED_CHARS = 64
BITS = 20
MASK = (1 << BITS) - 1
NO_RANK = 1 << 60
#: Fixed value: the pre-tokenizer pattern of the byte-level vocabularies.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Characters that the ``regex`` module (Unicode 18) calls letters or numbers and Unicode 16, by which the
#: vocabularies' library cuts, leaves unassigned.
NEWER = (
    r"\u0558\u058B-\u058C\u088F\u0C5C\u0CDC\u208F\u209D-\u209F\uA7CE-\uA7CF\uA7D2\uA7D4\uA7DD\uA7E2\uA7F1\uAB6C-\uAB6D"
    r"\U000107BB-\U000107BF\U00010940-\U00010959\U00010EC5-\U00010EC7\U00010ED9-\U00010EEE\U00011B0A\U00011DB0-\U00011DDB"
    r"\U00011DE0-\U00011DE9\U00011DF1\U0001246F\U00012475-\U0001247F\U00012550-\U00012686\U00016EA0-\U00016EB8"
    r"\U00016EBB-\U00016ED3\U00016FF2-\U00016FF6\U000187F8-\U000187FF\U00018CD6-\U00018CDA\U00018D09-\U00018D20"
    r"\U00018D80-\U00018DF2\U00018E00-\U00019191\U000191A0-\U000191D2\U0001B123-\U0001B128\U0001B168\U0001D6A6"
    r"\U0001DF1F-\U0001DF24\U0001DF2B-\U0001DF81\U0001DF90-\U0001DF96\U0001DFCD-\U0001DFFF\U0001E6C0-\U0001E6DE"
    r"\U0001E6E0-\U0001E6E2\U0001E6E4-\U0001E6E5\U0001E6E7-\U0001E6ED\U0001E6F0-\U0001E6F4\U0001E6FE-\U0001E6FF"
    r"\U0002B73A-\U0002B73F\U0002B81E\U0002CEA2-\U0002CEAD\U000323B0-\U00033479\U0003D000-\U0003FC3F"
)


def _printable_bytes() -> dict[str, int]:
    """Characters that stand for bytes in the vocabulary file: printable bytes themselves, the rest from 256 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(rest)}


class BytePairs:
    """Encoder and decoder of one vocabulary file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            content = json.load(file)
        to_byte = _printable_bytes()
        vocab = content["model"]["vocab"]
        self.bytes_of = {i: bytes(to_byte[c] for c in token) for token, i in vocab.items()}
        # (left, right) -> rank and merged id in one number, ordered by rank
        self.pairs: dict[int, int] = {}
        for rank, merge in enumerate(content["model"]["merges"], 1):
            left, right = merge.split(" ") if isinstance(merge, str) else merge
            self.pairs[vocab[left] << BITS | vocab[right]] = rank << BITS | vocab[left + right]
        self.single = {b: vocab[c] for c, b in to_byte.items() if c in vocab}
        self.special = {t["content"]: t["id"] for t in content.get("added_tokens", [])}
        for token, i in self.special.items():
            self.bytes_of[i] = token.encode()
        names = sorted(self.special, key=len, reverse=True)
        self.cut = regex.compile("(" + "|".join(map(regex.escape, names)) + ")") if names else None
        self.pattern = regex.compile(PIECES)
        self.newer = regex.compile(f"[{NEWER}]")
        with_newer = PIECES.replace(r"[^\s\p{L}\p{N}]", rf"(?:[{NEWER}]|[^\s\p{{L}}\p{{N}}])")
        for kind in (r"\p{L}+", r"\p{N}+"):
            with_newer = with_newer.replace(" ?" + kind, rf" ?(?:(?![{NEWER}]){kind[:-1]})+")
        self.with_newer = regex.compile(with_newer)
        self.pieces: dict[str, bytes] = {}
        self.earlier: dict[str, bytes] = {}

    def merge(self, piece: bytes) -> list[int]:
        """Ids of one piece."""
        parts = [self.single[b] for b in piece]
        return self._by_scan(parts) if len(parts) <= SCAN_PARTS else self._by_heap(parts)

    def _by_scan(self, parts: list[int]) -> list[int]:
        of = self.pairs.get
        ranks = [of(left << BITS | right, NO_RANK) for left, right in itertools.pairwise(parts)]
        while ranks:
            least = min(ranks)
            if least == NO_RANK:
                break
            i = ranks.index(least)
            merged = parts[i] = least & MASK
            del parts[i + 1], ranks[i]
            if i < len(ranks):
                ranks[i] = of(merged << BITS | parts[i + 1], NO_RANK)
            if i:
                ranks[i - 1] = of(parts[i - 1] << BITS | merged, NO_RANK)
        return parts

    def _by_heap(self, parts: list[int]) -> list[int]:
        n = len(parts)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        of = self.pairs.get
        heap = [(r, i, parts[i], parts[i + 1]) for i in range(n - 1) if (r := of(parts[i] << BITS | parts[i + 1]))]
        heapq.heapify(heap)
        while heap:
            least, i, left, right = heapq.heappop(heap)
            j = after[i]
            if parts[i] != left or j >= n or parts[j] != right:
                continue
            parts[i], parts[j] = least & MASK, -1
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
            for k in (before[i], i):
                if k >= 0 and after[k] < n and (r := of(parts[k] << BITS | parts[after[k]])):
                    heapq.heappush(heap, (r, k, parts[k], parts[after[k]]))
        return [p for p in parts if p >= 0]

    def _ids(self, piece: str) -> bytes:
        ids = self.earlier.get(piece)
        if ids is None:
            parts = self.merge(piece.encode("utf-8"))
            ids = struct.pack(f"<{len(parts)}I", *parts)
        if len(piece) <= CACHED_CHARS:
            if len(self.pieces) >= CACHED_PIECES:
                self.earlier, self.pieces = self.pieces, {}
            self.pieces[piece] = ids
        return ids

    def forget(self) -> None:
        """Drop the tables of pieces."""
        self.pieces, self.earlier = {}, {}

    def encode(self, text: str) -> bytes:
        """Ids of a text as little-endian unsigned 32-bit integers."""
        out: list[bytes] = []
        for part in self.cut.split(text) if self.cut else [text]:
            if part in self.special:
                out.append(int(self.special[part]).to_bytes(4, "little"))
                continue
            pattern = self.pattern if part.isascii() or not self.newer.search(part) else self.with_newer
            for piece in pattern.findall(part):
                ids = self.pieces.get(piece)
                out.append(self._ids(piece) if ids is None else ids)
        return b"".join(out)

    def decode(self, ids: bytes) -> str:
        """Text of such ids; special tokens are written out, and bytes that are not UTF-8 become U+FFFD."""
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, dtype="<u4").tolist())).decode("utf-8", "replace")


@functools.cache
def tokenizer(path: str) -> BytePairs:
    return BytePairs(path)


def encoded_batches(batches: Iterable[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    """(doc_id, n_tokens, ids, decoded) of batches (doc_id, text), by parts of about ``SLICE_BYTES`` of text."""
    model = tokenizer(path)
    try:
        for part in itertools.chain.from_iterable(bounded(batch, 1) for batch in batches):
            ids = [model.encode(text.as_py() or "") for text in part.column(1)]
            counts = pa.array([len(x) // 4 for x in ids], pa.int64())
            texts = pa.array(map(model.decode, ids), pa.string())
            yield pa.RecordBatch.from_arrays([part.column(0), counts, pa.array(ids, pa.binary()), texts], names=["doc_id", "n_tokens", "ids", "decoded"])
    finally:
        model.forget()


def encoded(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, n_tokens, ids, decoded): the ids as little-endian unsigned 32-bit integers, and the text decoded from them."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(lambda b: encoded_batches(b, path), f"doc_id {kind}, n_tokens long, ids binary, decoded string")
