"""Exact n-gram Jaccard join by a pigeonhole over a partitioned universe.

A document is the set of its distinct ``SHINGLE``-word shingles, hashed to 64 bits. Two sets of sizes a and b link
when their Jaccard index reaches t per cent, that is, when they differ in at most H(a, b) = (100 - t)(a + b) / (100 + t) shingles.

* Size bands: the k-th band holds sizes whose ratio allows a link, so partners lie in the same or a neighbouring band.
  In frame k the sets of bands k and k - 1 meet, and the largest difference there is H.
* Segments: the universe of shingles is cut by hash into somewhat more than H + 1 segments. A set indexes its subset in every
  segment and, in a few segments named per frame, also that subset less each one shingle (its one-deletion
  neighbourhood). Sets of equal keys meet in buckets.
* Allocation: a set gives each segment -1 (not asked), 0 (asked for equality) or +1 (asked for one difference), such
  that the values plus one sum to more than its H; then a segment that it asks must hold each partner. What a segment costs is
  the size of its bucket, which is known once the index is built: the largest buckets are not asked, and where large ones
  remain, named segments pay for them with +1.
* A bucket does not emit its pairs. Its hub is compared with its other sets. Relative to the hub h a set x is the
  set D(x) of shingles in one of them only, and two sets differ in as many shingles as D(x) and D(y) do. Unless both link with the hub,
  sets of a hub that link share some of the first elements of D in any order, so a prefix filter over D finds their pairs. Where
  a crowd is large, elements that few of its sets have in D come first (estimated on a sample of the crowd, which decides the order
  and never the result): copies of one text with different edits, however many, meet in edits that they share and not in
  the text itself, nor in the edits of the hub. Elements of one set alone are dropped before any join.
* Candidate pairs whose counts in ``BINS`` bins already differ by more than H are dropped; the others are verified on the whole
  shingle sets; components join the links.

Copies have one set and cost nothing more. Keys travel as packed arrays, one row for a batch of documents and a range of keys.

Null and empty texts have an empty set and link with nothing. Fewer words than a shingle make one shingle of all words. Rows with a null
id get a null component and link with nothing. Repeated rows and ties share a set, hence a component, which is named by
its smallest id. Further columns do not matter. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dossier.llm.packing import pack, text_bytes, unpack
from dossier.llm.words import Words, bounded, mix, plain, slices, windows, word_hashes, words
from dossier.plans.components import connected_components
from dossier.plans.durable import durable, forget, short_lived
from dossier.plans.sizing import arrow_rows, checked_broadcast

SHINGLE = 4
PERCENT = 85
#: A range of keys holds the keys of about so much text.
RANGE_BYTES = 24 << 20
#: A task sends its keys on when it holds about so many.
KEYS_HELD = 1 << 19
#: Counts of a set that a pair is compared by before whole sets are: 256 bytes.
BINS = 256
#: Buckets from this size on are worth the one-deletion questions that replace them.
LARGE_BUCKET = 32
#: From this many sets on, the elements of a crowd are ordered by how many sets of about ``CROWD_SAMPLE`` hold them.
LARGE_CROWD = 32
CROWD_SAMPLE = 64
#: Elements in a smaller part of the sample count as held by none, so a hub's list is at most so many average sets long.
COMMON_PARTS = 32
#: Pairs come with both texts and the list of their hub, so a batch has few; they are verified by parts with about so much text on one side.
PAIR_ROWS = 1000
VERIFIED_BYTES = 2 << 20
#: A list of elements takes twice its measured size or more where it is built for a broadcast, in the driver and each executor.
ELEMENT_BYTES = 16 << 20
_LOW32 = np.uint64(0xFFFFFFFF)


def shingle_sets(w: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(shingles, row): the distinct hashed shingles of each row, ascending inside a row."""
    h = word_hashes(w, 11)
    at, value = windows(h, w.doc, size, 7)
    row = w.doc[at] if len(at) else np.zeros(0, dtype=np.int64)
    n = np.diff(w.first)
    short = np.flatnonzero((n > 0) & (n < size))
    if len(short):
        whole = []
        for i in short:
            x = n[i : i + 1].astype(np.uint64)
            for part in h[w.first[i] : w.first[i + 1]]:
                x = mix(x * np.uint64(0x9E3779B97F4A7C15) + part)
            whole.append(x)
        value, row = np.concatenate([value, *whole]), np.concatenate([row, short])
        order = np.argsort(row, kind="stable")
        value, row = value[order], row[order]
    edges = np.searchsorted(row, np.arange(w.rows + 1))
    for begin, stop in zip(edges[:-1], edges[1:], strict=True):
        value[begin:stop].sort()
    new = np.ones(len(value), dtype=bool)
    new[1:] = (value[1:] != value[:-1]) | (row[1:] != row[:-1])
    return value[new], row[new]


def set_hashes(shingles: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two independent order-free 64-bit hashes of each set."""
    out = []
    for seed in (np.uint64(3), np.uint64(0xA5A5A5A5A5A5A5A5)):
        sums = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(mix(shingles + seed), dtype=np.uint64)])
        out.append(mix(sums[edges[1:]] - sums[edges[:-1]] + seed))
    return out[0].view(np.int64), out[1].view(np.int64)


@cache
def bands(percent: int, most: int) -> np.ndarray:
    """Smallest sizes of the bands, up to a band beyond ``most``."""
    low = [1]
    while low[-1] <= most:
        low.append(low[-1] * 100 // percent + 1)
    low.append(low[-1] * 100 // percent + 1)
    return np.array(low, dtype=np.int64)


def allowed(percent: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """H: the most shingles in which linked sets of sizes a and b differ."""
    return (100 - percent) * (a + b) // (100 + percent)


def frame_plan(percent: int, low: np.ndarray, frame: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(largest size, segments, named segments) of frames; the named segments are the last ones."""
    top = low[frame + 1] - 1
    worst = allowed(percent, top, top)
    segments = worst + 1 + -(-(worst + 1) // 12)
    return top, segments, -(-segments // 24)


def surplus(percent: int, low: np.ndarray, size: np.ndarray, frame: np.ndarray) -> np.ndarray:
    """How many segments a set of a size need not ask in a frame."""
    top, segments, _ = frame_plan(percent, low, frame)
    return segments - allowed(percent, size, np.minimum(top, size * 100 // percent)) - 1


def frame_keys(shingles, edges, size, frame, percent, low):
    """Keys of sets in one frame each: (key, set, named segment or -1, whether a shingle was left out)."""
    _, segments, named = frame_plan(percent, low, frame)
    row = np.repeat(np.arange(len(size)), size)
    base = np.concatenate([[0], np.cumsum(segments)])
    segment = ((shingles >> np.uint64(32)) * segments[row].astype(np.uint64) >> np.uint64(32)).astype(np.int64) + base[row]
    count = np.bincount(segment, minlength=base[-1])
    ends = np.cumsum(count)
    mixed = mix(shingles ^ np.uint64(0x5BD1E995))
    sums = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(mixed, dtype=np.uint64)])
    content = sums[ends] - sums[ends - count]
    owner = np.repeat(np.arange(len(size)), segments)
    local = np.arange(base[-1]) - base[owner]
    place = mix((frame[owner] * (1 << 24) + local + 1).astype(np.uint64))
    name = np.maximum(local - (segments - named)[owner], -1)
    less_at = np.flatnonzero(name[segment] >= 0)
    left_out = segment[less_at]
    key = np.concatenate([mix(content + place), mix(content[left_out] - mixed[less_at] + place[left_out])])
    less = np.zeros(len(key), dtype=bool)
    less[len(content) :] = True
    return key, np.concatenate([owner, row[less_at]]), np.concatenate([name, name[left_out]]), less


def _sets(w: Words, size: int):
    shingles, row = shingle_sets(w, size)
    edges = np.searchsorted(row, np.arange(w.rows + 1))
    return shingles, edges, *set_hashes(shingles, edges)


def _describe(batches: Iterable[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = plain(batch.column(1))
        for begin, stop in slices(texts):
            shingles, edges, h1, h2 = _sets(words(texts, begin, stop, lower=True), size)
            n = np.diff(edges)
            cell = np.repeat(np.arange(len(n)) * BINS, n) + (shingles % np.uint64(BINS)).astype(np.int64)
            bins = np.minimum(np.bincount(cell, minlength=len(n) * BINS), 255).astype(np.uint8).reshape(-1, BINS)
            kept = [batch.column(k).slice(begin, stop - begin) for k in (0, 2)]
            columns = [*kept, pa.array(n), pa.array(h1), pa.array(h2), pa.array([x.tobytes() for x in bins], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "mark", "n", "h1", "h2", "bins"])


def _close(batches: Iterable[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Whether pairs may link: sets differ in at least as many shingles as the counts of their bins do."""
    for batch in batches:
        x, y = (np.frombuffer(b"".join(v.as_py() for v in batch.column(i)), dtype=np.uint8).reshape(-1, BINS).astype(np.int16) for i in (2, 3))
        n, m = batch.column(4).to_numpy(), batch.column(5).to_numpy()
        close = np.abs(x - y).sum(axis=1, dtype=np.int64) <= allowed(percent, n, m)
        yield pa.RecordBatch.from_arrays([*batch.columns[:2], batch.column(4), batch.column(5), pa.array(close)], names=["a", "b", "a_size", "b_size", "close"])


def _keys(batches: Iterable[pa.RecordBatch], size: int, percent: int, ranges: int) -> Iterator[pa.RecordBatch]:
    """The packed keys of the distinct sets of each batch, a row for each range of keys."""
    for batch in batches:
        texts = plain(batch.column(1))
        known: set[int] = set()
        found, held = [], 0
        for begin, stop in slices(texts):
            shingles, edges, h1, _ = _sets(words(texts, begin, stop, lower=True), size)
            n = np.diff(edges)
            take = np.zeros(len(n), dtype=bool)
            take[[i for i in np.unique(h1, return_index=True)[1] if n[i] and int(h1[i]) not in known]] = True
            known.update(h1[take].tolist())
            if not take.any():
                continue
            low = bands(percent, int(n.max()))
            band = np.searchsorted(low, n, side="right") - 1
            for step in (0, 1):
                # where no difference is allowed, equal sets alone link, and these share their hash
                top = low[band + step + 1] - 1
                some = take & (allowed(percent, top, top) > 0)
                if some.any():
                    sizes = n[some]
                    own = shingles[np.repeat(some, n)]
                    key, who, name, less = frame_keys(own, np.concatenate([[0], np.cumsum(sizes)]), sizes, band[some] + step, percent, low)
                    found.append((key, h1[some][who], sizes[who], (step + 2 * less + 4 * (name + 1)).astype(np.uint32)))
                    held += len(key)
            if held > KEYS_HELD:
                yield _dealt(*map(np.concatenate, zip(*found, strict=True)), ranges)
                found, held = [], 0
        if found:
            yield _dealt(*map(np.concatenate, zip(*found, strict=True)), ranges)


def pack_codes(code: np.ndarray) -> bytes:
    """Codes of keys in two bytes each, or four where a very long text names segments beyond; the first byte tells which."""
    width = 2 if int(code.max(initial=0)) < 1 << 16 else 4
    return bytes([width]) + code.astype(f"<u{width}").tobytes()


def unpack_codes(data: bytes) -> np.ndarray:
    return np.frombuffer(data, dtype=f"<u{data[0]}", offset=1)


KEYS = "range int, owners binary, sizes binary, who binary, key binary, code binary"


def _dealt(key, owner, size, code, ranges) -> pa.RecordBatch:
    owners, at, who = np.unique(owner, return_index=True, return_inverse=True)
    sizes = size[at]
    part = ((key >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32)).astype(np.int64)
    order = np.lexsort((who, part))
    part, who, key, code = part[order], who[order], key[order], code[order]
    ends = np.searchsorted(part, np.arange(ranges + 1))
    rows = []
    for k in range(ranges):
        if (s := slice(ends[k], ends[k + 1])).start < s.stop:
            present, local = np.unique(who[s], return_inverse=True)
            rows.append(
                (
                    k, owners[present].tobytes(), sizes[present].astype("<u4").tobytes(), pack(local),
                    (key[s] & _LOW32).astype("<u4").tobytes(), pack_codes(code[s]),
                )
            )
    columns = list(zip(*rows, strict=True))
    names = [x.split(" ")[0] for x in KEYS.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int32()), *[pa.array(c, pa.binary()) for c in columns[1:]]], names=names)


MEMBERS = "bucket long, owner long, size int, step int, less boolean, name int, n int, surplus int, named int, times int"


def _buckets(table: pa.Table, percent: int) -> pa.Table:
    """The sets that share a key, of each bucket with several sets; equal buckets once, with how often they occur.

    Keys are told apart by their range and 32 more bits; the few that agree by chance make candidates that fail.
    """
    rows = [{n: row[n] for n in ("owners", "sizes", "who", "code")} for row in table.select(["owners", "sizes", "who", "code"]).to_pylist()]
    key = np.concatenate([np.frombuffer(x.as_buffer(), dtype="<u4") for x in table["key"].combine_chunks()])
    codes = [unpack_codes(r["code"]) for r in rows]
    ends = np.cumsum([0] + [len(c) for c in codes])
    # keys held once are most of them
    order = np.argsort(key, kind="stable")
    key = key[order]
    same = key[1:] == key[:-1]
    shared = np.zeros(len(key), dtype=bool)
    shared[1:] |= same
    shared[:-1] |= same
    order, key = order[shared], key[shared]
    owner, size, code = (np.zeros(len(order), dtype=k) for k in (np.int64, np.uint32, np.uint32))
    source = np.searchsorted(ends, order, side="right") - 1
    for i, r in enumerate(rows):
        at = np.flatnonzero(source == i)
        if len(at):
            place = order[at] - ends[i]
            who = unpack(r["who"])[place]
            owner[at], size[at] = np.frombuffer(r["owners"], dtype="<i8")[who], np.frombuffer(r["sizes"], dtype="<u4")[who]
            code[at] = codes[i][place]
    order = np.lexsort((code, owner, key))
    key, owner, size, code = key[order], owner[order], size[order], code[order]
    new = np.ones(len(key), dtype=bool)
    new[1:] = (key[1:] != key[:-1]) | (owner[1:] != owner[:-1]) | (code[1:] != code[:-1])
    key, owner, size, code = key[new], owner[new], size[new].astype(np.int64), code[new].astype(np.int64)
    start = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, dtype=np.int64)
    rows = np.diff(np.append(start, len(key)))
    apart = np.ones(len(key), dtype=np.int64)
    apart[1:] = (key[1:] != key[:-1]) | (owner[1:] != owner[:-1])
    n = np.add.reduceat(apart, start) if len(start) else rows
    mark, times, keep = np.zeros(len(start), dtype=np.uint64), np.zeros(len(start), dtype=np.int64), n > 1
    if len(start):
        mark = np.add.reduceat(mix(mix(owner.view(np.uint64) + np.uint64(table["range"][0].as_py())) + code.astype(np.uint64)), start)
        # equal marks are equal buckets, so the first stands for all
        _, first, back = np.unique(mark, return_index=True, return_inverse=True)
        times[first] = np.bincount(back)
        keep &= times > 0
    pick = np.repeat(keep, rows)
    owner, size, code = owner[pick], size[pick], code[pick]
    low = bands(percent, int(size.max()) if len(size) else 1)
    frame = np.searchsorted(low, size, side="right") - 1 + code % 2
    each = lambda x: np.repeat(x, rows)[pick]
    columns = {
        "bucket": mix(each(mark)).view(np.int64), "owner": owner, "size": size, "step": code % 2, "less": code // 2 % 2 == 1, "name": code // 4 - 1,
        "n": each(n), "surplus": surplus(percent, low, size, frame), "named": frame_plan(percent, low, frame)[2], "times": each(times),
    }
    kinds = {"bucket": np.int64, "owner": np.int64, "less": bool}
    return pa.table({k: v.astype(kinds.get(k, np.int32)) for k, v in columns.items()})


def asked(members: DataFrame) -> DataFrame:
    """``members`` with whether their set asks the bucket.

    Equal subsets are left out from the largest bucket on while the surplus lasts, and large ones also for as many named
    segments as are not large themselves; then the one-deletion keys of the named segments are asked instead.
    """
    own = Window.partitionBy("owner", "step")
    equal, large = ~F.col("less"), F.col("n") >= LARGE_BUCKET
    down = own.orderBy(F.col("less"), F.desc("n"), "bucket", "name").rowsBetween(Window.unboundedPreceding, 0)
    spent = F.sum(F.when(equal, F.col("times")).otherwise(0)).over(down)
    taken = F.count(F.when(equal & large & (F.col("name") >= 0), 1)).over(own)
    rated = members.withColumns({"_spent": spent, "_extra": F.greatest(F.col("named") - taken, F.lit(0))})
    plain_left_out = F.col("_spent") <= F.col("surplus")
    paid = large & ~plain_left_out & (F.col("_spent") <= F.col("surplus") + F.col("_extra"))
    rated = rated.withColumn("_paid", F.max(equal & paid).over(own))
    return rated.withColumn("asked", F.when(equal, ~plain_left_out & ~paid).otherwise(F.col("_paid"))).drop("_spent", "_extra", "_paid")


def _each_set(column: pa.Array, size: int) -> Iterator[tuple[np.ndarray, int]]:
    """The shingles and first hash of each text."""
    texts = plain(column)
    for begin, stop in slices(texts):
        shingles, edges, h1, _ = _sets(words(texts, begin, stop, lower=True), size)
        for k, h in enumerate(h1.tolist()):
            yield shingles[edges[k] : edges[k + 1]], h


def _elements(batches: Iterable[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """(a, e): the shingles of the texts in the last column that are of the sets ``b``, a row each."""
    for batch in batches:
        hub, wanted, texts = batch.columns
        for begin, stop in slices(plain(texts)):
            rows = zip(hub[begin:stop].to_pylist(), wanted[begin:stop].to_pylist(), _each_set(texts[begin:stop], size), strict=True)
            found = [(a, x) for a, b, (x, h) in rows if h == b]
            if found:
                owner = np.repeat(np.array([a for a, _ in found], dtype=np.int64), [len(x) for _, x in found])
                yield pa.RecordBatch.from_arrays([pa.array(owner), pa.array(np.concatenate([x for _, x in found]).view(np.int64))], names=["a", "e"])


def held_by(only: np.ndarray, missing: np.ndarray, sampled: int, common: np.ndarray, sets: np.ndarray) -> np.ndarray:
    """How many of ``sampled`` sets of a crowd have the elements in their D, by the ascending ``common`` shingles and the sets that hold them.

    A shingle that the hub has is in D of the sets that lack it.
    """
    holds = np.zeros(len(only), dtype=np.int64)
    if len(common):
        at = np.minimum(np.searchsorted(common, only), len(common) - 1)
        holds = np.where(common[at] == only, sets[at], 0)
    return np.where(missing, sampled - holds, holds)


def _verified(batches: Iterable[pa.RecordBatch], percent: int, size: int) -> Iterator[pa.RecordBatch]:
    """Pairs by parts of a batch, since their sets and first elements take more room than their texts; nothing of a part is held after it."""
    parts = chain.from_iterable(map(lambda b: bounded(b, 5, VERIFIED_BYTES), batches))
    yield from map(lambda part: _verified_part(part, percent, size), parts)


def _verified_part(batch: pa.RecordBatch, percent: int, size: int) -> pa.RecordBatch:
    names = ["a", "b", "a_size", "b_size", "linked", "d", "first"]
    # the text of a hub comes with each of its pairs and is read once
    hubs = batch.column(4).dictionary_encode()
    hub_sets = list(_each_set(hubs.dictionary, size))
    right, linked, d, first = [], [], [], []
    pairs = zip(hubs.indices.to_pylist(), _each_set(batch.column(5), size), *[c.to_pylist() for c in batch.columns[:2]], *batch.columns[6:10], strict=True)
    for at, (y, hy), a, b, crowded, sampled, common, sets in pairs:
        x, hx = hub_sets[at]
        # other texts of the same id come along
        right.append(hx == a and hy == b)
        only = np.setxor1d(x, y, assume_unique=True)
        both = (len(x) + len(y) - len(only)) // 2
        linked.append(100 * both >= percent * (both + len(only)))
        d.append(len(only))
        if crowded.as_py():
            missing = np.isin(only, x, assume_unique=True)
            take = int(allowed(percent, len(y), len(y) * 100 // percent)) + 1
            rank = np.zeros(len(only), dtype=np.int64)
            if sampled.is_valid:
                rank = held_by(only.view(np.int64), missing, sampled.as_py(), common.values.to_numpy(), sets.values.to_numpy())
            first.append(only[np.lexsort((only, missing, rank))][:take].view(np.int64))
        else:
            first.append(())
    columns = [*batch.columns[:4], pa.array(linked, pa.bool_()), pa.array(d, pa.int64()), pa.array(first, pa.list_(pa.int64()))]
    return pa.RecordBatch.from_arrays(columns, names=names).filter(pa.array(right))


def mark_of(text: str) -> Column:
    """What tells the texts of rows of one id apart."""
    return F.xxhash64(text)


class JaccardJoin:
    """The join of one table of documents: ``documents`` describes its sets, ``links`` and ``classes`` its result."""

    def __init__(self, docs: DataFrame, percent: int = PERCENT, size: int = SHINGLE):
        self.percent, self.size = percent, size
        self.docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
        marked = self.docs.withColumn("mark", mark_of("text"))
        self.documents = durable(marked.mapInArrow(lambda b: _describe(b, size), "doc_id long, mark long, n long, h1 long, h2 long, bins binary"))

    def buckets(self) -> DataFrame:
        """(bucket, owner, asked): the sets of each bucket."""
        ranges = max(1, -(-text_bytes(self.docs) // RANGE_BYTES))
        size, percent = self.size, self.percent
        keys = self.docs.where("doc_id is not null").mapInArrow(lambda b: _keys(b, size, percent, ranges), KEYS)
        found = keys.groupBy("range").applyInArrow(lambda t: _buckets(t, percent), MEMBERS)
        # the rows of a set meet once, for what it asks and for its buckets
        members = asked(found.drop("size").repartition("owner")).select("bucket", "owner", "asked")
        return members.groupBy("bucket", "owner").agg(F.max("asked").alias("asked"))

    def _texts_of(self, rows: DataFrame, owner: str) -> DataFrame:
        """``rows`` with the text of one document of each set that ``owner`` names; other texts of its id come along.

        Few rows are looked up while the documents are scanned, so no text is shuffled; many are joined by id.
        """
        stands = self.documents.where("doc_id is not null and n > 0").groupBy(F.col("h1").alias(owner), "h2").agg(F.min("doc_id").alias("doc_id"))
        wanted = rows.join(stands.select(owner, "doc_id"), owner)
        return self.docs.join(checked_broadcast(wanted), "doc_id").select(*rows.columns, "text")

    def _orders(self, pairs: DataFrame) -> DataFrame:
        """(a, sampled, common, sets): of hubs with a large crowd, the shingles that many sets of a sample hold, ascending, and how many do.

        A sample is small against its crowd, and what is listed of it is as long as ``COMMON_PARTS`` average sets at most.
        """
        crowds = pairs.groupBy("a").agg(F.count("*").alias("_m")).where(F.col("_m") >= LARGE_CROWD)
        drawn = pairs.join(crowds, "a").where(F.pmod(F.xxhash64("b", "a"), F.col("_m")) < CROWD_SAMPLE)
        drawn = durable(drawn.select("a", "b"))
        sampled = drawn.groupBy("a").agg(F.count("*").alias("sampled"))
        size = self.size
        # texts are shorter than their shingles; where those of a crowd meet, most elements are counted before they are shuffled
        shingles = self._texts_of(drawn, "b").repartition("a").mapInArrow(lambda b: _elements(b, size), "a long, e long")
        held = shingles.groupBy("a", "e").agg(F.count("*").alias("s")).where("s > 1")
        listed = held.join(sampled, "a").where(F.col("s") * COMMON_PARTS >= F.col("sampled"))
        lists = listed.groupBy("a").agg(F.sort_array(F.collect_list(F.struct("e", "s"))).alias("_l"))
        both = sampled.join(lists, "a", "left").select("a", "sampled", F.coalesce("_l", F.array().cast("array<struct<e:bigint,s:bigint>>")).alias("_l"))
        return durable(both.select("a", "sampled", F.col("_l.e").alias("common"), F.col("_l.s").cast("array<smallint>").alias("sets")))

    def _tested(self, pairs: DataFrame, orders: DataFrame | None = None) -> DataFrame:
        """(a, b, a_size, b_size, linked, d, first): pairs verified on their whole sets, with the size of D(b) to the hub a.

        The texts meet and not the sets, which are longer and do not compress.

        Where the hub is crowded, the first elements of D follow: as many as differ between linked sets, and one. They stand in an order
        that all sets of the hub share: by ``orders`` those that fewer sets hold first, then shingles that the hub lacks before those that
        the set lacks, by hash.
        """
        pairs = durable(pairs.select("a", "b", "a_size", "b_size", "crowded"))
        left = self._texts_of(pairs.select("a").distinct(), "a").withColumnRenamed("text", "_x")
        right = self._texts_of(pairs, "b").withColumnRenamed("text", "_y")
        if orders is None:
            none = F.lit(None)
            left = left.withColumns({"sampled": none.cast("long"), "common": none.cast("array<long>"), "sets": none.cast("array<smallint>")})
        else:
            left = left.join(orders, "a", "left")
        percent, size = self.percent, self.size
        met = right.join(left, "a").select("a", "b", "a_size", "b_size", "_x", "_y", "crowded", "sampled", "common", "sets")
        kinds = "a long, b long, a_size long, b_size long, linked boolean, d long, first array<long>"
        return met.mapInArrow(lambda b: _verified(b, percent, size), kinds)

    def _rated(self, pairs: DataFrame) -> DataFrame:
        """Pairs (a, b) with their sizes and whether they may link by their bins."""
        bins = self.documents.where("doc_id is not null and n > 0").groupBy("h1").agg(F.first("n").alias("n"), F.first("bins").alias("bins"))
        left, right = (bins.select(F.col("h1").alias(n), F.col("n").alias(f"{n}_size"), F.col("bins").alias(s)) for n, s in (("a", "_x"), ("b", "_y")))
        percent = self.percent
        met = pairs.join(left, "a").join(right, "b").select("a", "b", "_x", "_y", "a_size", "b_size")
        return met.mapInArrow(lambda b: _close(b, percent), "a long, b long, a_size long, b_size long, close boolean")

    def links(self) -> DataFrame:
        """(a, b): links between sets, named by their first hash, that connect all sets that links connect.

        What a step shuffled or wrote goes before the next one starts, so the disk holds one step and not all of them.
        """
        spark = self.docs.sparkSession
        with arrow_rows(spark, PAIR_ROWS), short_lived(spark):
            needed = self._needed()
            forget(spark)
            first = durable(self._tested(needed, self._orders(needed)))
            del needed
            forget(spark)
            found = durable(first.where("linked").select("a", "b").distinct())
            elements = self._shared_elements(first)
            del first
            forget(spark)
            found = durable(found.unionByName(self._linked(self._near(elements))).distinct())
            parts = connected_components(found).select(F.col("node").alias("b"), "component")
            named = elements.join(parts, "b", "left").withColumn("component", F.coalesce("component", "b"))
            pairs = durable(self._sharing(named))
            del elements, parts, named
            forget(spark)
            return durable(found.unionByName(self._linked(pairs)).distinct())

    def _needed(self) -> DataFrame:
        """Pairs of a hub and a set that shares a bucket with it: those that may link, and all of a hub of several."""
        members = durable(self.buckets())
        # a bucket that nobody asks has no hub
        hub = F.min(F.struct(F.xxhash64("owner"), F.col("owner"))).alias("_hub")
        hubs = members.where("asked").groupBy("bucket").agg(hub).select("bucket", F.col("_hub.owner").alias("a"))
        star = members.join(hubs, "bucket").where("owner != a").select("a", F.col("owner").alias("b")).distinct()
        pairs = durable(self._rated(star))
        crowded = pairs.groupBy("a").agg((F.count("*") > 1).alias("crowded"))
        return durable(pairs.join(crowded, "a").where("close or crowded"))

    def _shared_elements(self, first: DataFrame) -> DataFrame:
        """The first elements without those of one set alone: as most are, they join nothing."""
        elements = self._first_elements(first).withColumn("_short", F.hash("at"))
        held = checked_broadcast(elements.groupBy("_short").agg(F.count("*").alias("_n")).where("_n > 1").select("_short"), ELEMENT_BYTES)
        return durable(elements.join(held, "_short").drop("_short"))

    def _near(self, elements: DataFrame) -> DataFrame:
        """Sets that share an element, each with the one of the smallest D, which may join them at once."""
        nearest = F.min(F.struct("d", "b", "size", "linked"))
        hub = elements.groupBy("at").agg(nearest.alias("_h"))
        near = elements.join(hub, "at").where((F.col("b") != F.col("_h.b")) & ~(F.col("linked") & F.col("_h.linked")))
        near = near.where(self._sizes_fit(F.col("size"), F.col("_h.size")))
        return near.select(F.least("b", "_h.b").alias("a"), F.greatest("b", "_h.b").alias("b")).distinct()

    def _linked(self, pairs: DataFrame) -> DataFrame:
        close = self._rated(pairs).where("close").withColumn("crowded", F.lit(False))
        return self._tested(close).where("linked").select("a", "b")

    def _sizes_fit(self, x: Column, y: Column) -> Column:
        return F.least(x, y) * 100 >= F.greatest(x, y) * self.percent

    def _first_elements(self, tested: DataFrame) -> DataFrame:
        """The first elements of D, with their places, of the sets of each hub that does not link with all of them.

        ``at`` stands for the hub and the element; the few that agree by chance make candidates that fail.
        """
        p, total = 100 - self.percent, 100 + self.percent
        open_hubs = tested.groupBy("a").agg(F.count("*").alias("_n"), F.min("linked").alias("_all"), F.max("b_size").alias("_most")).where("_n > 1 and not _all")
        rows = tested.join(checked_broadcast(open_hubs.select("a", "_most")), "a")
        # linked sets differ in at most ``limit`` shingles, and so do the sizes of their D
        partner = F.least(F.col("_most"), F.floor(F.col("b_size") * 100 / self.percent))
        limit = F.floor((F.col("b_size") + partner) * p / total)
        # whoever has the smaller D (y) needs ``least`` elements in common with a partner of no smaller D
        least = F.greatest(F.lit(1), F.ceil((2 * F.col("d") - limit) / 2))
        beyond = F.when(F.col("b_size") > F.col("a_size"), F.floor((F.col("b_size") - F.col("a_size")) * p / total) + 1).otherwise(0)
        least = F.when(F.col("linked"), F.greatest(least, F.ceil((F.col("d") + 1 - beyond) / 2))).otherwise(least)
        taken = F.slice("first", F.lit(1), F.least(F.col("d"), limit + 1).cast("int"))
        exploded = rows.select("a", "b", F.col("b_size").alias("size"), "linked", "d", (F.col("d") - least + 1).alias("ask"), F.posexplode(taken).alias("place", "e"))
        return exploded.withColumns({"place": F.col("place") + 1, "at": F.xxhash64("a", "e")}).drop("a", "e")

    def _sharing(self, shared: DataFrame) -> DataFrame:
        """Pairs of sets of one hub and different components that may link: a prefix filter over D."""
        p, total = 100 - self.percent, 100 + self.percent
        x = shared.select("at", *[F.col(c).alias(f"x_{c}") for c in ("b", "size", "linked", "d", "place", "component")])
        y = shared.where("place <= ask")
        need = F.ceil((F.col("d") + F.col("x_d") - F.floor((F.col("size") + F.col("x_size")) * p / total)) / 2)
        smaller = (F.col("d") < F.col("x_d")) | ((F.col("d") == F.col("x_d")) & (F.col("b") < F.col("x_b")))
        possible = 1 + F.least(F.col("d") - F.col("place"), F.col("x_d") - F.col("x_place")) >= need
        apart = F.col("component") != F.col("x_component")
        met = y.join(x, "at").where(smaller & possible & apart & self._sizes_fit(F.col("size"), F.col("x_size")))
        return met.select(F.least("b", "x_b").alias("a"), F.greatest("b", "x_b").alias("b")).distinct()

    def classes(self) -> DataFrame:
        """(doc_id, mark, n_shingles, component_id) of every document."""
        links = self.links()
        with short_lived(self.docs.sparkSession):
            parts = connected_components(links).select(F.col("node").alias("h1"), "component")
        stands = self.documents.where("doc_id is not null and n > 0").groupBy("h1", "h2").agg(F.min("doc_id").alias("first"))
        named = stands.join(parts, "h1", "left")
        linked = F.struct("component", F.lit(0).cast("long").alias("h2"))
        placed = named.withColumn("_group", F.when(F.col("component").isNull(), F.struct(F.col("h1").alias("component"), "h2")).otherwise(linked))
        smallest = placed.groupBy("_group").agg(F.min("first").alias("component_id"))
        by_set = placed.join(smallest, "_group").select("h1", "h2", "component_id")
        full = self.documents.drop("bins").join(by_set, ["h1", "h2"], "left")
        own = F.when(F.col("doc_id").isNull(), F.lit(None)).when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component_id"))
        return full.select("doc_id", "mark", F.col("n").alias("n_shingles"), own.alias("component_id"))


def joined(docs: DataFrame, percent: int = PERCENT, size: int = SHINGLE) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every document of ``docs``."""
    return JaccardJoin(docs, percent, size).classes().drop("mark")


def first_of_each(docs: DataFrame, percent: int = PERCENT, size: int = SHINGLE) -> DataFrame:
    """``docs`` with one row of each group: its smallest id, of that the text of the smallest mark, of equal ids and texts the least row.

    Rows are told apart by id and text, so a unique text stays whatever else has its id. Rows without words or id link with nothing and stay.
    """
    judged = durable(JaccardJoin(docs, percent, size).classes().where("doc_id is not null and n_shingles > 0"))
    first = judged.where("doc_id = component_id").groupBy("component_id").agg(F.min("mark").alias("first"))
    rows = judged.groupBy("doc_id", "mark", "component_id").agg(F.count(F.lit(1)).alias("n")).join(first, "component_id")
    stays = (F.col("doc_id") == F.col("component_id")) & (F.col("mark") == F.col("first"))
    rows = durable(rows.select(F.col("doc_id").alias("_id"), F.col("mark").alias("_mark"), stays.alias("stays"), "n"))
    same = lambda side: (docs["doc_id"].cast("long") == side["_id"]) & (mark_of("text") == side["_mark"])
    later = checked_broadcast(rows.where("not stays or n > 1").select("_id", "_mark"))
    kept = docs.join(later, same(later), "left_anti")
    repeated = rows.where("stays and n > 1").select("_id", "_mark")
    if repeated.isEmpty():
        return kept
    repeated = checked_broadcast(repeated)
    again = docs.join(repeated, same(repeated), "left_semi")
    least = again.groupBy("doc_id", "text").agg(F.min(F.struct(*[F.col(f"`{c}`") for c in docs.columns])).alias("_row"))
    return kept.unionByName(least.select("_row.*"))
