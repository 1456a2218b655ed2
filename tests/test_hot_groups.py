"""Groups too large for one task take another route; both routes must agree."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from dossier.operators import chronology as C
from dossier.operators import coverage as V
from dossier.operators import retrieval as R
from dossier.operators import text as T
from dossier.plans.components import connected_components
from dossier.plans.containment import containing
from dossier.plans.ordering import numbered


def test_numbering_of_hot_groups(spark):
    rows = spark.range(5000).selectExpr("CASE WHEN id % 3 = 0 THEN 'hot' ELSE concat('g', id % 40) END AS k", "(id * 7919) % 5003 AS v", "id")
    order = [F.col("v"), F.col("id")]
    expected = {(r["k"], r["id"]): r["n"] for r in numbered(rows, ["k"], order, "n").collect()}
    got = {(r["k"], r["id"]): r["n"] for r in numbered(rows, ["k"], order, "n", bound=50).collect()}
    assert got == expected


def _batches(costs, max_chars, max_items):
    result, batch, items, total = [], 1, 0, 0
    for cost in costs:
        if items and (items >= max_items or total + cost > max_chars):
            batch, items, total = batch + 1, 0, 0
        items, total = items + 1, total + cost
        result.append(batch)
    return result


def test_batches_across_blocks(spark):
    rng = random.Random(3)
    rows, expected = [], {}
    for a in range(6):
        lengths = [rng.choice((0, 10, 300, 900, 4000, 20000)) for _ in range(rng.choice((1, 7, 8, 40, 333)))]
        for i, n in enumerate(lengths):
            rows.append((f"a{a}", f"d{i // 10:03d}", i % 10, f"p{i:04d}", "x" * n))
        for i, b in enumerate(_batches([n + V.ITEM_COST for n in lengths], 14000, 8)):
            expected[(f"a{a}", f"p{i:04d}")] = b
    df = spark.createDataFrame(rows, "analysis_id string, document_id string, passage_order int, passage_id string, passage_text string")
    for block in (8, 10, 37, 1000):
        got = {(r["analysis_id"], r["passage_id"]): r["batch"] for r in V.pack_batches(df, block_rows=block).collect()}
        assert got == expected, block


def _timeline(spark, seed, analyses=4, cycles=True):
    rng = random.Random(seed)
    events, edges = [], []
    for a in range(analyses):
        n = rng.choice((5, 30, 60))
        for i in range(n):
            sequence = rng.choice((None, float(rng.randint(0, 40))))
            minutes = rng.choice((None, rng.randint(0, 1439)))
            events.append((f"a{a}", f"n{i:02d}", rng.choice("xyz"), sequence, minutes, None, [], False))
        for _ in range(rng.choice((0, n // 2, n))):
            i, j = rng.randrange(n), rng.randrange(n)
            if not cycles and i > j:
                i, j = j, i
            edges.append((f"a{a}", f"n{i:02d}", f"n{j:02d}"))
    schema = "analysis_id string, node_id string, label string, source_sequence_index double, explicit_time_minutes int, explicit_time_label string, audio_evidence_locations array<string>, timeline_time_conflict boolean"
    return spark.createDataFrame(events, schema), spark.createDataFrame(edges, "analysis_id string, source_node_id string, target_node_id string"), edges


def _positions(df):
    return {(r["analysis_id"], r["node_id"]): (r["sequence_position"], r["in_cycle"]) for r in df.collect()}


def test_projected_order_is_topological(spark):
    events, edges, listed = _timeline(spark, 1, cycles=False)
    place = _positions(C.project_timeline(events, edges))
    for a, s, t in listed:
        assert s == t or place[(a, s)][0] < place[(a, t)][0]
    assert not any(cycle for _, cycle in place.values())


def test_hot_analyses_have_the_same_order(spark):
    events, edges, _ = _timeline(spark, 2, analyses=2)
    expected = _positions(C.project_timeline(events, edges))
    assert _positions(C.project_timeline(events, edges, bound=20)) == expected


def test_hot_component_is_split(spark):
    events, edges, _ = _timeline(spark, 5, analyses=1, cycles=False)
    expected = _positions(C.project_timeline(events, edges))
    assert _positions(C.project_timeline(events, edges, bound=3)) == expected


def test_cycles_are_reported(spark):
    schema = "analysis_id string, node_id string, label string, source_sequence_index double, explicit_time_minutes int, explicit_time_label string, audio_evidence_locations array<string>, timeline_time_conflict boolean"
    events = spark.createDataFrame([("a", "e1", "A", 1.0, None, None, [], False), ("a", "e2", "B", 2.0, None, None, [], False), ("a", "e3", "C", 0.0, None, None, [], True)], schema)
    edges = spark.createDataFrame([("a", "e1", "e2"), ("a", "e2", "e1")], "analysis_id string, source_node_id string, target_node_id string")
    projected = C.project_timeline(events, edges)
    assert {r["node_id"] for r in projected.where("in_cycle").collect()} == {"e1", "e2"}
    kinds = sorted((r["conflict_type"], r["node_id"]) for r in C.timeline_conflicts(projected).collect())
    assert kinds == [("FOLLOWED_BY_CYCLE", "e1"), ("FOLLOWED_BY_CYCLE", "e2"), ("MULTIPLE_EXPLICIT_TIMES", "e3")]


def test_connected_components(spark):
    rng = random.Random(4)
    pairs = [(rng.randrange(200), rng.randrange(200)) for _ in range(120)]
    parent = list(range(200))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        ra, rb = root(a), root(b)
        parent[max(ra, rb)] = min(ra, rb)
    nodes = {x for a, b in pairs if a != b for x in (a, b)}
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(pairs, "a int, b int")).collect()}
    assert got == {x: root(x) for x in nodes}


def test_containment_finds_every_phrase(spark):
    rng = random.Random(9)
    texts = [("".join(rng.choice("abc ") for _ in range(rng.randint(0, 40))), i) for i in range(60)]
    phrases = sorted({"".join(rng.choice("abc ") for _ in range(rng.choice((1, 2, 3, 9, 12)))) for _ in range(80)})
    phrases += [t[0][3:20] for t in texts if len(t[0]) > 22][:10]
    phrases = sorted(set(phrases))
    for few in (400, 3):
        df = containing(
            spark.createDataFrame(texts, "t string, i int"), "t", spark.createDataFrame([(p,) for p in phrases], "p string"), "p", few
        )
        got = sorted((r["i"], r["p"]) for r in df.collect())
        assert got == sorted((i, p) for t, i in texts for p in phrases if p and p in t)
    nothing = containing(spark.createDataFrame(texts, "t string, i int"), "t", spark.createDataFrame([("",), (None,)], "p string"), "p")
    assert nothing.count() == 0


def test_snapshot_id_ignores_order_but_not_content(spark):
    rows = [("g", f"f{i}", f"h{i}") for i in range(50)]
    def ident(values):
        df = spark.createDataFrame(values, "g string, f string, h string")
        return T.corpus_snapshot_id(df, ["g"], [F.col("f"), F.col("h")]).first()["corpus_snapshot_id"]
    assert ident(rows) == ident(rows[::-1])
    assert ident(rows) != ident(rows[:-1]) and ident(rows) != ident(rows + [rows[0]])


def test_a_long_chain_is_ordered_in_few_rounds(spark):
    """5,000 events that follow each other against their priority, a second chain and a cycle, all beyond one task."""
    n = 5000
    events = [("a", f"n{i:05d}", "x", float(n - i), None, None, [], False) for i in range(n)]
    events += [("a", f"m{i:05d}", "x", float(2 * i), None, None, [], False) for i in range(200)] + [("a", f"c{i}", "x", 1.0, None, None, [], False) for i in range(150)]
    edges = [("a", f"n{i:05d}", f"n{i + 1:05d}") for i in range(n - 1)] + [("a", f"m{i:05d}", f"m{i + 1:05d}") for i in range(199)]
    edges += [("a", f"c{i}", f"c{(i + 1) % 150}") for i in range(150)]
    schema = (
        "analysis_id string, node_id string, label string, source_sequence_index double, explicit_time_minutes int,"
        " explicit_time_label string, audio_evidence_locations array<string>, timeline_time_conflict boolean"
    )
    frames = spark.createDataFrame(events, schema), spark.createDataFrame(edges, "analysis_id string, source_node_id string, target_node_id string")
    small = {r["node_id"]: (r["sequence_position"], r["in_cycle"]) for r in C.project_timeline(*frames).collect()}
    hot = {r["node_id"]: (r["sequence_position"], r["in_cycle"]) for r in C.project_timeline(*frames, bound=100).collect()}
    assert hot == small and sum(c for _, c in hot.values()) == 150


def test_of_repeated_events_the_largest_is_kept(spark):
    rows = [("a", "n1", "x", 5.0), ("a", "n1", "y", 1.0), ("a", "n2", "z", 3.0)]
    events = spark.createDataFrame(rows, "analysis_id string, node_id string, label string, source_sequence_index double").selectExpr(
        "*", "cast(null AS int) AS explicit_time_minutes", "cast(null AS string) AS explicit_time_label", "cast(array() AS array<string>) AS audio_evidence_locations", "false AS timeline_time_conflict"
    )
    none = spark.createDataFrame([], "analysis_id string, source_node_id string, target_node_id string")
    got = [(r["node_id"], r["label"]) for r in C.project_timeline(events, none).orderBy("sequence_position").collect()]
    assert got == [("n1", "y"), ("n2", "z")]


def test_a_term_in_every_passage(spark):
    """The frequent term is not looked for where rarer ones reach the k-th best; results are those of all pairs."""
    rng = random.Random(12)
    words = [f"word{i:03d}" for i in range(200)]
    passages = [("d", f"p{i:04d}", i, " ".join(["common", *(rng.choice(words) for _ in range(rng.randint(0, 12)))])) for i in range(600)]
    queries = [(f"q{i}", " ".join(["common", *(rng.choice(words) for _ in range(n))])) for i, n in enumerate((0, 1, 3, 25))]
    df = spark.createDataFrame(passages, "document_id string, passage_id string, passage_order int, passage_text string").repartition(5)
    asked = spark.createDataFrame(queries, "query_id string, query_text string")
    for k in (7,):
        got = {(r["query_id"], r["rank"]): (r["passage_id"], r["lexical_score"]) for r in R.lexical_retrieve(df, asked, k=k).collect()}
        for query, text in queries:
            terms = set(text.split())
            scores = [(-(10 * len(terms & set(t.split())) + 20 * (text in t)), i, p) for _, p, i, t in passages if terms & set(t.split())]
            for rank, (score, _, p) in enumerate(sorted(scores)[:k], 1):
                assert got[query, rank] == (p, -score)
    pairs = R.lexical_scores(df, asked)
    assert pairs.where("query_id = 'q0'").count() == 600
