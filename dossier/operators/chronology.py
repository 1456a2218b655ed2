"""Chronology: explicit times, FOLLOWED_BY edges, reviewed timeline events and the projected order."""

from __future__ import annotations

import heapq
from itertools import groupby

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dossier import schemas as S
from dossier.functions.locations import explicit_time, lenient_pages, parse_audio_location
from dossier.functions.rules import violations
from dossier.functions.text import content_id
from dossier.plans.components import connected_components
from dossier.plans.durable import durable
from dossier.plans.ordering import numbered
from dossier.plans.sizing import HOT_GROUP_ROWS, checked_broadcast, hot_groups

# Texts that speak of one vessel without naming it, and texts that speak of several.
GENERIC_VESSEL = r"(?iU)\b(?:the|this)\s+(?:vessel|ship)\b"
OTHER_VESSELS = r"(?iU)\b(?:another|other)\s+(?:vessel|ship)\b|\bvessels\b|\bships\b"


def generic_vessel_passages(passages: DataFrame) -> DataFrame:
    """Passages that refer to exactly one unnamed vessel."""
    return passages.where(F.col("passage_text").rlike(GENERIC_VESSEL) & ~F.col("passage_text").rlike(OTHER_VESSELS))


def timed_events(events: DataFrame, text: str) -> DataFrame:
    """Events whose text states a clock time, with minutes since midnight and HH:MM label."""
    return (
        events.withColumn("_t", explicit_time(F.col(text)))
        .where(F.col("_t").isNotNull())
        .select(*events.columns, F.col("_t.minutes").alias("minutes"), F.col("_t.label").alias("time_label"))
    )


def followed_by_edges(timed: DataFrame, existing: DataFrame) -> DataFrame:
    """FOLLOWED_BY edges between events that are adjacent in explicit time, unless they exist already.

    ``timed``: analysis_id, node_id, minutes. ``existing``: analysis_id, source_node_id, relationship,
    target_node_id. Events are ordered by (minutes, node_id) and equal times are not linked, so each edge goes
    from the last event of one minute to the first event of the next one. Each analysis is therefore reduced
    to at most 1,440 rows before it is ordered.
    """
    minutes = timed.groupBy("analysis_id", "minutes").agg(F.min("node_id").alias("first"), F.max("node_id").alias("last"))
    window = Window.partitionBy("analysis_id").orderBy("minutes")
    pairs = minutes.withColumn("target_node_id", F.lead("first").over(window)).where(F.col("target_node_id").isNotNull())
    edges = pairs.select("analysis_id", F.col("last").alias("source_node_id"), F.lit("FOLLOWED_BY").alias("relationship"), "target_node_id")
    keys = ["analysis_id", "source_node_id", "relationship", "target_node_id"]
    fresh = edges.join(existing.select(*keys), keys, "left_anti")
    return fresh.select(
        *keys,
        content_id("analysis_edge_", [*[F.col(k) for k in keys], F.lit("explicit-time")]).alias("edge_id"),
        F.lit("DIRECT").alias("evidence_class"),
        F.lit("DETERMINISTIC_TEMPORAL").alias("edge_class"),
    )


def edge_passages(edges: DataFrame, event_passages: DataFrame) -> DataFrame:
    """(edge_id, passage_id): union of the passages of both ends (event_passages: node_id, passage_id)."""
    ends = edges.select("edge_id", F.explode(F.array("source_node_id", "target_node_id")).alias("node_id"))
    return ends.join(event_passages, "node_id").select("edge_id", "passage_id").distinct()


def first_event_edge(timed: DataFrame, subjects: DataFrame, existing: DataFrame) -> DataFrame:
    """INVOLVED_IN edge from the subject of each analysis (analysis_id, subject_node_id) to its first event."""
    first = timed.groupBy("analysis_id").agg(F.min(F.struct("minutes", "node_id")).alias("_f"))
    edges = subjects.join(first, "analysis_id").select(
        "analysis_id", F.col("subject_node_id").alias("source_node_id"), F.lit("INVOLVED_IN").alias("relationship"), F.col("_f.node_id").alias("target_node_id")
    )
    keys = ["analysis_id", "source_node_id", "relationship", "target_node_id"]
    return edges.join(existing.select(*keys), keys, "left_anti").select(
        *keys,
        content_id("analysis_edge_", [F.col(k) for k in keys]).alias("edge_id"),
        F.lit("DIRECT").alias("evidence_class"),
        F.lit("STRUCTURAL").alias("edge_class"),
    )


def _text(name: str) -> Column:
    return F.trim(F.coalesce(F.col(name).cast("string"), F.lit("")))


def normalise_timeline(events: DataFrame) -> DataFrame:
    """Reviewed events with validated phase, basis, precision and bounds, and the list of their violations.

    ``events``: event_id, analysis_id, summary, event_type, phase, time_basis, time_precision,
    event_time_start, event_time_end, relative_start_s, relative_end_s (times and offsets as text). Precision
    is never invented: bounds of another basis are dropped.
    """
    phase = F.when(_text("phase") == "", F.lit("UNASSIGNED")).otherwise(_text("phase"))
    basis = _text("time_basis")
    absolute, relative = basis == "ABSOLUTE", basis == "RELATIVE_AUDIO"
    given = _text("time_precision")
    precision = (
        F.when(absolute, F.when(given == "", F.lit("MINUTE")).otherwise(given))
        .when(relative, F.when(given == "", F.lit("RELATIVE_AUDIO")).otherwise(given))
        .otherwise(F.lit("ORDER_ONLY"))
    )
    start, end = F.try_to_timestamp(_text("event_time_start")), F.try_to_timestamp(_text("event_time_end"))
    start_s, end_s = _text("relative_start_s").try_cast("double"), _text("relative_end_s").try_cast("double")
    codes = violations(
        ("ANALYSIS_ID_MISSING", _text("analysis_id") == ""),
        ("SUMMARY_MISSING", _text("summary") == ""),
        ("UNSUPPORTED_PHASE", ~phase.isin(*S.TIMELINE_PHASES)),
        ("UNSUPPORTED_BASIS", ~basis.isin(*S.TIME_BASES)),
        ("UNSUPPORTED_PRECISION", (absolute & ~precision.isin(*S.ABSOLUTE_PRECISIONS)) | (relative & ~precision.isin(*S.RELATIVE_PRECISIONS))),
        ("START_MISSING", (absolute & (_text("event_time_start") == "")) | (relative & start_s.isNull())),
        ("START_NOT_ISO", absolute & (_text("event_time_start") != "") & start.isNull()),
        ("END_NOT_VALID", (absolute & (_text("event_time_end") != "") & end.isNull()) | (relative & (_text("relative_end_s") != "") & end_s.isNull())),
        ("END_BEFORE_START", (absolute & (end < start)) | (relative & (end_s < start_s))),
        ("START_NEGATIVE", relative & (start_s < 0)),
    )
    return events.select(
        "event_id",
        _text("analysis_id").alias("analysis_id"),
        _text("summary").alias("summary"),
        F.when(_text("event_type") == "", F.lit("EVENT")).otherwise(_text("event_type")).alias("event_type"),
        phase.alias("phase"),
        basis.alias("time_basis"),
        precision.alias("time_precision"),
        F.when(absolute, start).alias("event_time_start"),
        F.when(absolute, end).alias("event_time_end"),
        F.when(relative, start_s).alias("relative_start_s"),
        F.when(relative, end_s).alias("relative_end_s"),
        codes.alias("violations"),
    )


def timeline_order(events: DataFrame) -> DataFrame:
    """Position of every event in its analysis: absolute times, then audio offsets, then order-only events.

    ``events``: the columns of ``normalise_timeline`` plus created_at.
    """
    basis = F.when(F.col("time_basis") == "ABSOLUTE", 0).when(F.col("time_basis") == "RELATIVE_AUDIO", 1).otherwise(2)
    staged = events.withColumns(
        {
            "_basis": basis,
            "_time": F.when(basis == 0, F.coalesce("event_time_start", F.to_timestamp(F.lit("9999-12-31 23:59:59")))).when(basis == 2, F.col("created_at")),
            "_offset": F.when(basis == 1, F.coalesce("relative_start_s", F.lit(float("inf")))),
        }
    )
    order = [F.col("_basis"), F.asc_nulls_first("_time"), F.asc_nulls_first("_offset"), F.col("summary"), F.col("event_id")]
    return numbered(staged, ["analysis_id"], order, "timeline_position").drop("_basis", "_time", "_offset")


def sequence_fallback(events: DataFrame) -> DataFrame:
    """Fill missing source_sequence_index by the order of the earliest (document, page) and the label.

    ``events``: analysis_id, node_id, label, source_sequence_index, evidence_locations.
    """
    places = F.transform(
        F.filter(F.transform("evidence_locations", lenient_pages), lambda p: p.isNotNull()),
        lambda p: F.struct(p["document_id"].alias("d"), F.coalesce(p["page_start"], F.lit(10**9)).alias("p")),
    )
    first = F.coalesce(F.array_min(places), F.struct(F.lit("~").alias("d"), F.lit(10**9).alias("p")))
    missing = events.where(F.col("source_sequence_index").isNull()).withColumn("_place", first)
    ranked = numbered(
        missing, ["analysis_id"], [F.col("_place.d"), F.col("_place.p"), F.lower(F.coalesce("label", F.lit(""))), F.col("node_id")], "_rank"
    )
    kind = events.schema["source_sequence_index"].dataType
    filled = ranked.withColumn("source_sequence_index", F.col("_rank").cast(kind)).select(*events.columns)
    return events.where(F.col("source_sequence_index").isNotNull()).unionByName(filled)


# --- projected order ----------------------------------------------------------------------------------------

_LAST = (1 << 62)


def _prioritised(events: DataFrame) -> DataFrame:
    """Events once each with the parts of their priority: sequence, explicit minutes, audio start, label, id.

    Of several rows of one event the largest by all other columns in their order is kept.
    """
    key = ["analysis_id", "node_id"]
    rest = [c for c in events.columns if c not in key]
    once = events.where(_text("node_id") != "").groupBy(*key).agg(F.max(F.struct(*rest)).alias("_e")).select(*key, "_e.*").select(*events.columns)
    starts = F.filter(
        F.transform(F.coalesce("audio_evidence_locations", F.array().cast("array<string>")), parse_audio_location),
        lambda a: a.isNotNull(),
    )
    infinite = F.lit(float("inf"))
    return once.withColumns(
        {
            "relative_start_s": F.array_min(F.transform(starts, lambda a: a["start_s"])),
            "relative_end_s": F.array_max(F.transform(starts, lambda a: a["end_s"])),
            "_sequence": F.coalesce(F.col("source_sequence_index").cast("double"), infinite),
            "_minutes": F.coalesce(F.col("explicit_time_minutes").cast("double"), infinite),
            "_label": F.lower(_text("label")),
        }
    ).withColumn("_audio", F.coalesce("relative_start_s", infinite))


def _valid_links(events: DataFrame, edges: DataFrame) -> DataFrame:
    ids = events.select("analysis_id", "node_id")
    links = edges.where(F.col("source_node_id") != F.col("target_node_id")).select("analysis_id", "source_node_id", "target_node_id").distinct()
    for side in ("source", "target"):
        links = links.join(ids.withColumnRenamed("node_id", f"{side}_node_id"), ["analysis_id", f"{side}_node_id"], "left_semi")
    return links.select("analysis_id", "source_node_id", "target_node_id")


def _topological(ranks: dict, links: list[tuple]) -> tuple[list, list]:
    """(nodes in the order in which they become ready, smallest rank first; nodes held back by a cycle)."""
    after, waiting = {n: [] for n in ranks}, dict.fromkeys(ranks, 0)
    for source, target in links:
        after[source].append(target)
        waiting[target] += 1
    ready = [(ranks[n], n) for n, w in waiting.items() if w == 0]
    heapq.heapify(ready)
    order = []
    while ready:
        _, node = heapq.heappop(ready)
        order.append(node)
        for target in after[node]:
            waiting[target] -= 1
            if waiting[target] == 0:
                heapq.heappush(ready, (ranks[target], target))
    held = sorted((n for n, w in waiting.items() if w > 0), key=ranks.__getitem__)
    return order, held


def project_timeline(events: DataFrame, followed_by: DataFrame, bound: int = HOT_GROUP_ROWS) -> DataFrame:
    """Default chronology of every analysis: FOLLOWED_BY edges first, then the priority of the events.

    ``events``: analysis_id, node_id, label, source_sequence_index, explicit_time_minutes,
    explicit_time_label, audio_evidence_locations, timeline_time_conflict. ``followed_by``: analysis_id,
    source_node_id, target_node_id. Adds sequence_position, ordering_basis, relative bounds and
    ordering_conflict. Events on or behind a cycle come last and are marked.

    An analysis with at most ``bound`` events and links is ordered in one task. A larger one is ordered per
    connected component: the orders of components are independent, and merging them by the smallest next rank
    is the same as sorting by (largest rank so far in the component, position in the component).
    """
    staged = _prioritised(events)
    links = _valid_links(staged, followed_by)
    sizes = staged.select("analysis_id").unionByName(links.select("analysis_id"))
    hot = hot_groups(sizes, ["analysis_id"], bound)
    if hot.isEmpty():
        placed = _order_per_group(staged, links)
    else:
        hot = checked_broadcast(hot)
        placed = _order_per_group(
            staged.join(hot, "analysis_id", "left_anti"), links.join(hot, "analysis_id", "left_anti")
        ).unionByName(
            _order_hot(staged.join(hot, "analysis_id", "left_semi"), links.join(hot, "analysis_id", "left_semi"), bound)
        )
    linked = links.select("analysis_id", F.explode(F.array("source_node_id", "target_node_id")).alias("node_id")).distinct().withColumn("_linked", F.lit(True))
    joined = staged.join(placed, ["analysis_id", "node_id"]).join(linked, ["analysis_id", "node_id"], "left")
    basis = (
        F.when(_text("explicit_time_label") != "", F.lit("EXPLICIT_TIME"))
        .when(F.col("relative_start_s").isNotNull(), F.lit("RELATIVE_AUDIO"))
        .when(F.col("_linked").isNotNull(), F.lit("FOLLOWED_BY"))
        .when(F.col("source_sequence_index").isNotNull(), F.lit("SOURCE_ORDER"))
        .otherwise(F.lit("UNRESOLVED_ORDER"))
    )
    return joined.select(
        *events.columns,
        "relative_start_s",
        "relative_end_s",
        "sequence_position",
        basis.alias("ordering_basis"),
        "in_cycle",
        (F.coalesce("timeline_time_conflict", F.lit(False)) | F.col("in_cycle")).alias("ordering_conflict"),
    )


def timeline_conflicts(projected: DataFrame) -> DataFrame:
    """(analysis_id, conflict_type, node_id) of events on cycles and events with several explicit times."""
    kinds = violations(
        ("FOLLOWED_BY_CYCLE", F.col("in_cycle")),
        ("MULTIPLE_EXPLICIT_TIMES", F.coalesce("timeline_time_conflict", F.lit(False))),
    )
    return projected.select("analysis_id", F.explode(kinds).alias("conflict_type"), "node_id")


#: Events of small analyses that are ordered in one call.
BUCKET_ROWS = 20_000
_PRIORITY = ["_sequence", "_minutes", "_audio", "_label", "node_id"]


def _order_per_group(events: DataFrame, links: DataFrame) -> DataFrame:
    """Analyses are ordered in buckets of some BUCKET_ROWS events, because a call of a task costs more than a small analysis."""

    def order(nodes: pd.DataFrame, edges: pd.DataFrame) -> pd.DataFrame:
        linked: dict[object, list[tuple]] = {}
        for analysis, source, target in zip(edges["_analysis"], edges["source_node_id"], edges["target_node_id"]):
            linked.setdefault(analysis, []).append((source, target))
        nodes = nodes.sort_values(["analysis_id", *_PRIORITY])
        columns: dict[str, list] = {"analysis_id": [], "node_id": [], "sequence_position": [], "in_cycle": []}
        for analysis, rows in groupby(zip(nodes["analysis_id"], nodes["node_id"]), key=lambda r: r[0]):
            ranks = {n: i for i, (_, n) in enumerate(rows)}
            done, held = _topological(ranks, linked.get(analysis, []))
            columns["analysis_id"] += [analysis] * len(ranks)
            columns["node_id"] += done + held
            columns["sequence_position"] += range(1, len(ranks) + 1)
            columns["in_cycle"] += [False] * len(done) + [True] * len(held)
        return pd.DataFrame(columns)

    kinds = {f.name: f.dataType.simpleString() for f in events.schema.fields}
    schema = f"analysis_id {kinds['analysis_id']}, node_id {kinds['node_id']}, sequence_position long, in_cycle boolean"
    buckets = max(1, -(-events.count() // BUCKET_ROWS))

    def bucket(analysis: str) -> Column:
        return F.pmod(F.xxhash64(analysis), F.lit(buckets)).alias("_bucket")

    # events of no analysis have no place
    nodes = events.where("analysis_id is not null").select(bucket("analysis_id"), "analysis_id", *_PRIORITY)
    ends = links.select(bucket("analysis_id"), F.col("analysis_id").alias("_analysis"), "source_node_id", "target_node_id")
    return nodes.groupBy("_bucket").cogroup(ends.groupBy("_bucket")).applyInPandas(order, schema)


def _order_hot(events: DataFrame, links: DataFrame, bound: int) -> DataFrame:
    """Order of analyses too large for one task: a sort key per event, then distributed numbering."""
    ranked = durable(
        numbered(events.select("analysis_id", *_PRIORITY), ["analysis_id"], [F.col(c) for c in _PRIORITY], "rank").select("analysis_id", "node_id", "rank")
    )
    # Ids of nodes inside this job: (analysis, rank) is unique and short.
    named = F.struct(F.col("analysis_id"), F.col("rank"))
    ends = links
    for side in ("source", "target"):
        ends = ends.join(
            ranked.select("analysis_id", F.col("node_id").alias(f"{side}_node_id"), F.col("rank").alias(side)), ["analysis_id", f"{side}_node_id"]
        )
    ends = durable(ends.select("analysis_id", "source", "target"))
    parts = connected_components(
        ends.select(F.struct("analysis_id", F.col("source").alias("rank")).alias("a"), F.struct("analysis_id", F.col("target").alias("rank")).alias("b"))
    )
    groups = durable(
        ranked.join(parts.select(F.col("node.analysis_id").alias("analysis_id"), F.col("node.rank").alias("rank"), F.col("component.rank").alias("group")), ["analysis_id", "rank"], "left")
    )
    single = groups.where(F.col("group").isNull()).select("analysis_id", "rank", F.array("rank").alias("key"), F.lit(False).alias("in_cycle"))
    grouped = groups.where(F.col("group").isNotNull()).select("analysis_id", F.array("group").alias("path"), "rank")
    tagged = ends.join(groups.select("analysis_id", F.col("rank").alias("source"), F.array("group").alias("path")), ["analysis_id", "source"])
    keyed = single.unionByName(_keys(grouped, tagged.select("analysis_id", "path", "source", "target"), bound, prefix=0))
    # Held-back events come last, in rank order.
    final = keyed.withColumn("key", F.when(F.col("in_cycle"), F.array(F.lit(_LAST), F.col("rank"))).otherwise(F.col("key")))
    placed = numbered(final, ["analysis_id"], [F.col("key"), F.col("rank")], "sequence_position", bound)
    return placed.join(ranked, ["analysis_id", "rank"]).select("analysis_id", "node_id", "sequence_position", "in_cycle")


def _keys(nodes: DataFrame, links: DataFrame, bound: int, prefix: int) -> DataFrame:
    """(analysis_id, rank, key, in_cycle) for the groups given by ``path``.

    Groups of at most ``bound`` rows are ordered in one task each. In a larger group every event is assigned
    the largest rank among itself and everything before it: events are emitted in the order of that value, the
    event that owns the value comes first, and the others that share it form smaller groups of their own.
    """
    group = ["analysis_id", "path"]
    sizes = nodes.select(*group).unionByName(links.select(*group))
    hot = hot_groups(sizes, group, bound)
    if hot.isEmpty():
        return _keys_in_task(nodes, links, prefix)
    hot = durable(hot)
    small = _keys_in_task(nodes.join(hot, group, "left_anti"), links.join(hot, group, "left_anti"), prefix)
    big_nodes, big_links = durable(nodes.join(hot, group, "left_semi")), durable(links.join(hot, group, "left_semi"))
    chains = _chains(big_nodes, big_links)
    forked = big_links.groupBy(*group, "source").agg(F.count("*").alias("n")).where("n > 1").select(*group)
    forked = durable(forked.unionByName(chains.where("waits > 1").select(*group)).distinct())
    along = _along_chains(chains.join(forked, group, "left_anti"), prefix)
    if forked.isEmpty():
        return small.unionByName(along)
    small = small.unionByName(along)
    big_links = big_links.join(forked, group, "left_semi")
    settled, held = _dominating(chains.join(forked, group, "left_semi"), big_links)
    head = F.slice("path", 2, prefix)
    owners = settled.where(F.col("rank") == F.col("top"))
    rest = durable(settled.where(F.col("rank") != F.col("top")))
    path = F.concat(F.slice("path", 1, prefix + 1), F.array("top"))
    inner_nodes = rest.select("analysis_id", path.alias("path"), "rank")
    ends = rest.select("analysis_id", "path", "rank", "top")
    inner_links = (
        big_links.join(ends.select("analysis_id", "path", F.col("rank").alias("source"), F.col("top").alias("_a")), ["analysis_id", "path", "source"])
        .join(ends.select("analysis_id", "path", F.col("rank").alias("target"), F.col("top").alias("_b")), ["analysis_id", "path", "target"])
        .where(F.col("_a") == F.col("_b"))
        .select("analysis_id", F.concat(F.slice("path", 1, prefix + 1), F.array("_a")).alias("path"), "source", "target")
    )
    done = owners.select("analysis_id", "rank", F.concat(head, F.array("top")).alias("key"), F.lit(False).alias("in_cycle"))
    stuck = held.select("analysis_id", "rank", F.array("rank").alias("key"), F.lit(True).alias("in_cycle"))
    return small.unionByName(done).unionByName(stuck).unionByName(_keys(inner_nodes, inner_links, bound, prefix + 1))


def _chains(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """Events with the number they wait for and, if that is one, the start of their chain.

    An event that waits for one other points at it. Pointers are doubled until they reach an event that waits for none or
    several (the root), with the steps and the largest rank on the way, so a chain of n events takes log n rounds.
    ``root`` is null for events whose pointers run in a cycle.
    """
    group = ["analysis_id", "path"]
    before = links.groupBy(*group, F.col("target").alias("rank")).agg(F.count("*").alias("waits"), F.min("source").alias("_p"))
    all_nodes = durable(nodes.join(before, [*group, "rank"], "left").select(*group, "rank", F.coalesce("waits", F.lit(0)).alias("waits"), "_p"))
    single = durable(
        all_nodes.where("waits = 1").select(*group, "rank", F.col("_p").alias("root"), F.col("rank").alias("top"), F.lit(1).cast("long").alias("steps"), F.lit(False).alias("done"))
    )
    rounds = single.count().bit_length() + 1
    for _ in range(rounds):
        if single.where("not done").isEmpty():
            break
        ahead = single.select(*group, F.col("rank").alias("root"), F.col("root").alias("_root"), F.col("top").alias("_top"), F.col("steps").alias("_steps"))
        joined = single.join(ahead, [*group, "root"], "left")
        reached = F.col("_root").isNull()
        single = durable(
            joined.select(
                *group, "rank", F.coalesce("_root", "root").alias("root"), F.greatest("top", F.coalesce("_top", "top")).alias("top"),
                (F.col("steps") + F.coalesce("_steps", F.lit(0))).alias("steps"), reached.alias("done"),
            )
        )
    found = single.select(*group, "rank", F.when(F.col("done"), F.col("root")).alias("root"), "top", "steps")
    others = all_nodes.where("waits != 1").select(*group, "rank", "waits", F.col("rank").alias("root"), F.col("rank").alias("top"), F.lit(0).cast("long").alias("steps"))
    return durable(found.withColumn("waits", F.lit(1).cast("long")).select(*others.columns).unionByName(others))


def _along_chains(chains: DataFrame, prefix: int) -> DataFrame:
    """Keys of groups in which no event has several predecessors or successors: chains merge by their largest rank so far."""
    head = F.slice("path", 2, prefix)
    key = F.concat(head, F.array(F.greatest("root", "top"), F.col("steps")))
    stuck = F.col("root").isNull()
    return chains.select("analysis_id", "rank", F.when(stuck, F.array("rank")).otherwise(key).alias("key"), stuck.alias("in_cycle"))


def _dominating(chains: DataFrame, links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(settled events with the largest rank before or at them, events behind a cycle), level by level of the joints.

    Joints are the events that wait for none or several others; what lies on the chains between them follows from their roots.
    """
    group = ["analysis_id", "path"]
    root = chains.select(*group, F.col("rank").alias("source"), F.col("root"), F.col("top").alias("_way"))
    joints = chains.where("waits != 1")
    inner = links.join(joints.select(*group, F.col("rank").alias("target")), [*group, "target"], "left_semi").join(root, [*group, "source"])
    inner = durable(inner.where("root is not null").select(*group, F.col("root").alias("from"), "target", "_way"))
    state = durable(joints.select(*group, "rank", F.col("waits").alias("open"), F.col("rank").alias("top"), F.lit(False).alias("done")))
    while True:
        ready = state.where("open = 0 and not done")
        if ready.isEmpty():
            break
        told = (
            inner.join(ready.select(*group, F.col("rank").alias("from"), "top"), [*group, "from"])
            .groupBy(*group, F.col("target").alias("rank"))
            .agg(F.count("*").alias("_n"), F.max(F.greatest("top", "_way")).alias("_t"))
        )
        state = durable(
            state.join(told, [*group, "rank"], "left").select(
                *group, "rank", (F.col("open") - F.coalesce("_n", F.lit(0))).alias("open"), F.greatest("top", F.coalesce("_t", "top")).alias("top"),
                (F.col("done") | (F.col("open") == 0)).alias("done"),
            )
        )
    known = state.where("done").select(*group, F.col("rank").alias("root"), F.col("top").alias("_root_top"))
    joined = durable(chains.join(known, [*group, "root"], "left"))
    settled = joined.where("_root_top is not null").select(*group, "rank", F.greatest("top", "_root_top").alias("top"))
    return settled, joined.where("_root_top is null").select(*group, "rank")


def _keys_in_task(nodes: DataFrame, links: DataFrame, prefix: int) -> DataFrame:
    def order(n: pd.DataFrame, e: pd.DataFrame) -> pd.DataFrame:
        if n.empty:
            return pd.DataFrame({"analysis_id": [], "rank": [], "key": [], "in_cycle": []})
        head = [int(x) for x in n["path"].iloc[0]][1 : prefix + 1]
        done, held = _topological({int(r): int(r) for r in n["rank"]}, list(zip(e["source"].astype(int), e["target"].astype(int))))
        keys, top = [], -1
        for position, rank in enumerate(done):
            top = max(top, rank)
            keys.append([*head, top, position])
        return pd.DataFrame(
            {
                "analysis_id": n["analysis_id"].iloc[0],
                "rank": done + held,
                "key": keys + [[r] for r in held],
                "in_cycle": [False] * len(done) + [True] * len(held),
            }
        )

    kind = nodes.schema["analysis_id"].dataType.simpleString()
    ends = links.select(F.col("analysis_id").alias("_analysis"), F.col("path").alias("_path"), "source", "target")
    return nodes.groupBy("analysis_id", "path").cogroup(ends.groupBy("_analysis", "_path")).applyInPandas(
        order, f"analysis_id {kind}, rank long, key array<long>, in_cycle boolean"
    )
