"""Near duplicates among embeddings by sorted projection passes.

Each pass hashes every vector, less the mean of all unit vectors, by the signs of ``HASHES`` random projections, orders all vectors lexicographically by the
concatenated signs and compares each with the ``WINDOW`` vectors that follow it. Similar vectors agree on leading signs
in some pass. Pairs are verified by their cosine in double precision; components join the verified pairs of all passes.

* Vectors that are equal in all numbers are compared once and counted as often as they occur.
* A pair that several passes meet counts in the first of them only. Each vector carries its places in all passes, so
  this is told where the pair is met, and no pair leaves a task: a task returns a count and a root for each vector.
* Only components of more vectors than a window can be counted short by windows, and these are counted exactly: their vectors
  are compared block against block, which replaces what the windows counted. Up to ``PIVOTS`` vectors of such a component are pivots; the
  vectors within half the angle of the threshold around one are its core. Any two of a core link (angles add up), so they count by the
  size of the core, and blocks that lie in one core are not compared. Cores save work only, no link depends on them. What is outside
  of cores costs the square of its number.

A task holds ``SEGMENT`` places of one order and a window of the next ones, or two blocks of ``2 * SEGMENT`` vectors, so memory is
bounded and a hot group spreads over segments and pairs of blocks. Recall is that of the method: pairs whose signs part early in every pass are missed (measured in the tests and the README). The number
of passes follows from the number of vectors and how far they spread around their mean, such that a pair at the threshold is
expected to be met with probability ``RECALL``; there are ``PASSES`` at least and no upper bound.

Vectors that are null, empty or zero, or hold null or non-finite components, link with nothing, and so do rows with a null id (their component is null);
vectors of different lengths never link. Repeated rows count as one vector, ties in the order are broken by the id. An empty table
gives an empty result. Further columns do not matter.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from dossier.llm.sharding import row_numbers
from dossier.plans.components import connected_components
from dossier.plans.durable import durable
from dossier.plans.sizing import checked_broadcast

THRESHOLD = 0.9
PASSES = 12
RECALL = 0.99
HASHES = 64
WINDOW = 1024
SEGMENT = 4096
TILE = 512
PIVOTS = 16


def _matrix(column: pa.ChunkedArray | pa.Array, size: int) -> np.ndarray:
    """Unit vectors in double precision."""
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays([c for c in column.chunks])
    x = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, size)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def passes_for(n: int, spread: float, threshold: float, window: int) -> int:
    """Passes that meet a pair at the threshold with ``RECALL`` among n vectors; ``spread`` is their mean squared distance from the mean.

    Taking the mean away keeps distances, so a pair's cosine falls as the spread does. To share a cell of a window, a pair must agree
    in as many leading signs as halve the vectors down to it.
    """
    cosine = max(1 - (1 - threshold) / spread, 0.0) if spread > 0 else 0.0
    share = (1 - math.acos(min(cosine, 1.0)) / math.pi) ** max(0.0, math.log2(max(n, 1) / window))
    return PASSES if share >= RECALL else max(PASSES, math.ceil(math.log(1 - RECALL) / math.log1p(-share)))


def _sums(batches):
    """(dim, n, total): numbers and sums of the unit vectors of a task."""
    found = {}
    for batch in batches:
        dims = batch.column(0).to_numpy()
        for size in np.unique(dims).tolist():
            x = _matrix(batch.column(1).take(pa.array(np.flatnonzero(dims == size))), size)
            n, total = found.get(size, (0, 0.0))
            found[size] = n + len(x), total + x.sum(axis=0)
    for size, (n, total) in found.items():
        yield pa.RecordBatch.from_arrays([pa.array([size], pa.int32()), pa.array([n], pa.int64()), pa.array([total], pa.list_(pa.float64()))], names=["dim", "n", "total"])


def _means(classes: DataFrame) -> dict[int, tuple[int, np.ndarray]]:
    """Number and mean of the unit vectors of each length."""
    sums = classes.select("dim", "embedding").mapInArrow(_sums, "dim int, n long, total array<double>")
    rows = sums.select("dim", "n", F.posexplode("total")).groupBy("dim", "pos").agg(F.sum("n").alias("n"), F.sum("col").alias("total")).collect()
    found: dict[int, tuple[int, np.ndarray]] = {}
    for r in rows:
        found.setdefault(r["dim"], (r["n"], np.zeros(r["dim"])))[1][r["pos"]] = round(r["total"] / r["n"], 9)
    return found


def _keys(batches, passes: int, means: dict[int, np.ndarray]):
    for batch in batches:
        dims = batch.column(1).to_numpy()
        for size in np.unique(dims):
            at = np.flatnonzero(dims == size)
            x = _matrix(batch.column(2).take(pa.array(at)), int(size)) - means[int(size)]
            for p in range(passes):
                planes = np.random.default_rng([p, int(size)]).normal(size=(int(size), HASHES))
                signs = np.packbits(x @ planes > 0, axis=1)
                key = signs.copy().view(">i8").ravel().astype(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(at), p, np.int32)), pa.array(dims[at].astype(np.int32)), pa.array(key), batch.column(0).take(pa.array(at))],
                    names=["pass", "dim", "key", "cls"],
                )


def _roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest member of each of n nodes' component under the links (a, b)."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if np.array_equal(new, label):
            return label
        label = new


def _compared(table: pa.Table, threshold: float, window: int, segment: int) -> pa.Table:
    """Counts and roots of one segment; rows beyond it are the start of the next one and only met."""
    table = table.sort_by("row")
    own = table["row"].to_numpy() // segment == table["segment"].to_numpy()
    row, run = table["row"].to_numpy(), table["dim"].to_numpy().astype(np.int64) * (1 << 16) + table["pass"].to_numpy()
    weight, cls = table["m"].to_numpy(), table["cls"].to_numpy()
    places = pa.concat_arrays(table["places"].chunks).flatten().to_numpy(zero_copy_only=False).reshape(len(row), -1)
    count = np.zeros(len(row), dtype=np.int64)
    left, right = [], []
    starts = np.flatnonzero(np.concatenate([[True], run[1:] != run[:-1]]))
    for begin, stop in zip(starts, np.append(starts[1:], len(row)), strict=True):
        number, size = int(run[begin] % (1 << 16)), int(run[begin] >> 16)
        x = _matrix(table["embedding"].slice(begin, stop - begin), size)
        for low in range(begin, stop, TILE):
            high, far = min(low + TILE, stop), min(low + TILE + window, stop)
            i, j = np.nonzero(x[low - begin : high - begin] @ x[low - begin : far - begin].T >= threshold)
            i, j = i + low, j + low
            ahead = row[j] - row[i]
            take = (ahead > 0) & (ahead <= window) & own[i]
            i, j = i[take], j[take]
            left.append(i)
            right.append(j)
            fresh = np.ones(len(i), dtype=bool)
            for q in range(number):
                fresh &= np.abs(places[i, q] - places[j, q]) > window
            count += np.bincount(i[fresh], weight[j[fresh]], len(row)).astype(np.int64) + np.bincount(j[fresh], weight[i[fresh]], len(row)).astype(np.int64)
    a, b = (np.concatenate(x) if x else np.zeros(0, dtype=np.int64) for x in (left, right))
    root = _roots(len(row), a, b)
    keep = (count > 0) | (root != np.arange(len(row)))
    return pa.table({"cls": cls[keep], "n": count[keep], "root": cls[root][keep]})


def _passes(classes: DataFrame, means: dict[int, np.ndarray], passes: int, threshold: float, window: int, segment: int) -> DataFrame:
    """(cls, n, root) of all passes, several rows a vector."""
    keys = classes.select("cls", "dim", "embedding").mapInArrow(lambda b: _keys(b, passes, means), "pass int, dim int, key long, cls long")
    placed, _ = row_numbers(keys, ["dim", "pass", "key", "cls"])
    places = placed.groupBy("cls").agg(F.array(*[F.max(F.when(F.col("pass") == p, F.col("row"))) for p in range(passes)]).alias("places"))
    rows = classes.join(places, "cls").select("*", F.posexplode("places").alias("pass", "row"))
    home = F.floor(F.col("row") / segment)
    homes = F.when((F.col("row") % segment < window) & (home > 0), F.array(home, home - 1)).otherwise(F.array(home))
    return (
        rows.withColumn("segment", F.explode(homes)).groupBy("segment")
        .applyInArrow(lambda t: _compared(t, threshold, window, segment), "cls long, n long, root long")
    )


def _assigned(left: pa.Table, right: pa.Table, threshold: float) -> pa.Table:
    """(cls, core) of the members near a pivot, by the first such pivot's name."""
    if left.num_rows == 0 or right.num_rows == 0:
        return pa.table({"cls": pa.array([], pa.int64()), "core": pa.array([], pa.int64())})
    right, size = right.sort_by("rank"), left["dim"][0].as_py()
    half = math.cos(math.acos(threshold) / 2) + 1e-9
    near = _matrix(left["embedding"], size) @ _matrix(right["embedding"], size).T >= half
    inside = near.any(axis=1)
    return pa.table({"cls": left["cls"].to_numpy()[inside], "core": right["cls"].to_numpy()[near.argmax(axis=1)[inside]]})


def _counted(table: pa.Table, threshold: float) -> pa.Table:
    """Links between two blocks of a component, or inside one block, without those inside a core."""
    block, cls, weight = table["block"].to_numpy(), table["cls"].to_numpy(), table["m"].to_numpy().astype(np.float64)
    cored, core = table["core"].combine_chunks().is_valid().to_numpy(zero_copy_only=False), table["core"].combine_chunks().fill_null(0).to_numpy()
    x = _matrix(table["embedding"], table["dim"][0].as_py())
    first, second = table["a"][0].as_py(), table["b"][0].as_py()
    left, right = np.flatnonzero(block == first), np.flatnonzero(block == second)
    count = np.zeros(len(block))
    for low in range(0, len(left), TILE):
        i = left[low : low + TILE]
        linked = x[i] @ x[right].T >= threshold
        linked &= ~cored[i][:, None] | (core[i][:, None] != core[right][None, :]) | ~cored[right][None, :]
        if first == second:
            linked &= i[:, None] != right[None, :]
        linked = linked.astype(np.float64)
        count[i] += linked @ weight[right]
        if first != second:
            count[right] += weight[i] @ linked
    keep = count > 0
    return pa.table({"cls": cls[keep], "n": np.rint(count[keep]).astype(np.int64)})


def _exact(classes: DataFrame, parts: DataFrame, threshold: float, window: int, block: int) -> DataFrame | None:
    """(cls, n): the links of all vectors in components of more vectors than a window, None if there are none."""
    sizes = durable(parts.groupBy("component").agg(F.count("*").alias("size")).where(F.col("size") > window))
    if sizes.isEmpty():
        return None
    deals = F.ceil(F.col("size") / block).cast("int").alias("deals")
    known = parts.join(checked_broadcast(sizes.select("component", deals)), "component").join(classes, "cls")
    members = durable(known.withColumn("deal", F.pmod(F.xxhash64("cls"), F.col("deals")).cast("int")))
    order = Window.partitionBy("component").orderBy(F.xxhash64(F.lit(1), F.col("cls")), "cls")
    pivots = members.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= PIVOTS)
    pivots = pivots.select("component", "rank", "cls", "embedding", F.explode(F.sequence(F.lit(0), F.col("deals") - 1)).alias("deal"))
    cores = durable(
        members.select("component", "deal", "cls", "dim", "embedding").groupBy("component", "deal")
        .cogroup(pivots.groupBy("component", "deal")).applyInArrow(lambda a, b: _assigned(a, b, threshold), "cls long, core long")
    )
    dealt, _ = row_numbers(
        members.join(cores, "cls", "left").select("component", "core", "cls", "m", "dim", "embedding"), ["component", "core", "cls"]
    )
    dealt = dealt.withColumn("block", F.floor(F.col("row") / block))
    # a block is pure if all its members of the component lie in one core
    pure = F.when((F.count("core") == F.count("*")) & (F.min("core") == F.max("core")), F.min("core")).alias("pure")
    blocks = durable(dealt.groupBy("component", "block").agg(pure))
    met = blocks.select("component", F.col("block").alias("a"), F.col("pure").alias("_p")).join(
        blocks.select("component", F.col("block").alias("b"), F.col("pure").alias("_q")), "component"
    )
    met = met.where("a <= b and not coalesce(_p = _q, false)").select("component", "a", "b")
    tasks = met.withColumn("block", F.explode(F.array_distinct(F.array("a", "b"))))
    between = (
        dealt.join(tasks, ["component", "block"]).select("component", "a", "b", "block", "cls", "m", "dim", "core", "embedding")
        .groupBy("component", "a", "b").applyInArrow(lambda t: _counted(t, threshold), "cls long, n long")
    )
    weights = dealt.where("core is not null").select("cls", "core", "m")
    inside = weights.join(weights.groupBy("core").agg(F.sum("m").alias("size")), "core").select("cls", (F.col("size") - F.col("m")).alias("n"))
    return between.unionByName(inside).groupBy("cls").agg(F.sum("n").alias("exact"))


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD, passes: int | None = None, window: int = WINDOW, segment: int = SEGMENT) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row of ``vectors`` (vec_id, embedding)."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("embedding", lambda x: x != 0)
    usable = rows.where("vec_id is not null and embedding is not null").where(finite)
    classes = durable(
        usable.distinct().groupBy("embedding").agg(F.min("vec_id").alias("cls"), F.count("*").alias("m")).select("cls", "m", F.size("embedding").alias("dim"), "embedding")
    )
    means = _means(classes)
    if passes is None:
        passes = max((passes_for(n, 1 - float(mean @ mean), threshold, window) for n, mean in means.values()), default=PASSES)
    met = durable(_passes(classes, {size: mean for size, (_, mean) in means.items()}, passes, threshold, window, segment))
    links = met.where("cls != root").select(F.col("cls").alias("a"), F.col("root").alias("b"))
    n = met.groupBy("cls").agg(F.sum("n").alias("met"))
    parts = durable(connected_components(links).select(F.col("node").alias("cls"), "component"))
    exact = _exact(classes, parts, threshold, window, 2 * segment)
    known = classes.select("cls", "m", "embedding").join(n, "cls", "left").join(parts, "cls", "left")
    # all partners that the windows met lie in the component, so the exact count replaces theirs
    known = known.withColumn("exact", F.lit(None).cast("long")) if exact is None else known.join(exact, "cls", "left")
    known = known.select(
        F.col("embedding").alias("_vector"), F.coalesce("component", "cls").alias("component"),
        (F.col("m") - 1 + F.coalesce("exact", "met", F.lit(0))).alias("n_links"),
    )
    joined = rows.join(known, F.col("vec_id").isNotNull() & (F.col("embedding") == F.col("_vector")), "left")
    component = F.when(F.col("vec_id").isNotNull(), F.coalesce("component", "vec_id"))
    return joined.select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"),
        F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"),
    )
