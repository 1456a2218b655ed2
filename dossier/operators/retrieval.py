"""Scopes, term expansion, lexical retrieval, similar cases and taxonomy shortlists over whole corpora."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dossier import schemas as S
from dossier.functions.locations import format_location
from dossier.functions.rules import violations
from dossier.functions.text import (
    CASE_STOP_WORDS,
    TAXONOMY_STOP_WORDS,
    clean,
    content_id,
    label_tokens,
    normalise_label,
    page_label,
    tokens,
)
from dossier.plans.containment import containing
from dossier.plans.durable import durable
from dossier.plans.postings import postings, score_batches
from dossier.plans.runs import relation_batches, role_batches
from dossier.plans.sizing import checked_broadcast, measured_bytes, spread_by

# Weights of a matched query term, a matched expansion term and the whole query found as one phrase.
TERM_WEIGHT, EXPANSION_WEIGHT, PHRASE_WEIGHT = 10, 4, 20

#: Documents and whole-case runs of an analysis are dealt out in lists of about so many; the runs meet documents by ``RUN_BLOCK`` or
#: fewer, by multiples of eight, since only then the packed bits of columnar files repeat with the runs.
SCOPE_BLOCK, RUN_BLOCK = 1024, 512


# --- scopes ---------------------------------------------------------------------------------------------


def _scope_mode(c: Column) -> Column:
    return F.upper(F.trim(F.coalesce(c, F.lit("WHOLE_CASE"))))


def resolve_scope(runs: DataFrame, selected: DataFrame, analysis_documents: DataFrame) -> DataFrame:
    """(run_id, analysis_id, document_id) rows of the effective scope of every valid run.

    ``runs``: run_id, analysis_id, scope_mode. ``selected``: run_id, document_id. ``analysis_documents``:
    analysis_id, document_id. Runs with a violation have no rows; see ``scope_violations``.

    The rows of whole cases are as many as runs times documents. They are dealt out by blocks of documents, and those of a document
    and a block of runs follow each other, again and again in the same order, so that what stores the result can encode or compress it.
    """
    bad = scope_violations(runs, selected, analysis_documents).select("run_id").distinct()
    good = runs.withColumn("_mode", _scope_mode(F.col("scope_mode"))).join(bad, "run_id", "left_anti")
    linked = analysis_documents.select("analysis_id", "document_id").distinct()
    runs_of, documents_of = _blocks(good.where(F.col("_mode") == "WHOLE_CASE"), "run_id"), _blocks(linked, "document_id")
    n = F.size("_run_id")
    even = n - n % 8
    starts = F.concat(F.when(even > 0, F.sequence(F.lit(1), even, F.lit(RUN_BLOCK))).otherwise(F.array()), F.when(n > even, F.array(even + 1)).otherwise(F.array()))
    part = lambda at: F.slice("_run_id", at, F.when(at > even, 8).otherwise(F.least(F.lit(RUN_BLOCK), even - at + 1)))
    runs_of = runs_of.select("analysis_id", F.explode(F.transform(starts, part)).alias("_run_id"))
    met = documents_of.join(checked_broadcast(runs_of), "analysis_id")
    # compiled, an explode holds all rows that a row becomes; one of an expression that is not compiled hands them on one by one
    each = lambda name: F.explode(F.transform(f"_{name}", lambda x: x[name])).alias(name)
    whole = met.select("analysis_id", "_run_id", each("document_id")).select("analysis_id", "document_id", each("run_id"))
    chosen = (
        good.where(F.col("_mode") != "WHOLE_CASE")
        .select("run_id", "analysis_id")
        .join(_chosen(selected), "run_id")
    )
    columns = ["run_id", "analysis_id", "document_id"]
    return whole.select(*columns).unionByName(chosen.select(*columns))


def _blocks(rows: DataFrame, name: str) -> DataFrame:
    """(analysis_id, _{name}): the values of an analysis as lists of about ``SCOPE_BLOCK``, nulls and repeated ones too, dealt out by list."""
    rows = rows.where("analysis_id is not null").select("analysis_id", name)
    blocks = rows.groupBy("analysis_id").agg(F.ceil(F.count(F.lit(1)) / SCOPE_BLOCK).alias("_blocks"))
    # repeated values spread as well
    placed = rows.join(checked_broadcast(blocks), "analysis_id").withColumn("_block", F.pmod(F.xxhash64(name, F.monotonically_increasing_id()), "_blocks"))
    dealt = spread_by(placed, "analysis_id", "_block")
    return dealt.groupBy("analysis_id", "_block").agg(F.collect_list(F.struct(name)).alias(f"_{name}")).drop("_block")


def _chosen(selected: DataFrame) -> DataFrame:
    return (
        selected.select("run_id", F.trim("document_id").alias("document_id"))
        .where(F.length(F.coalesce("document_id", F.lit(""))) > 0)
        .distinct()
    )


def scope_violations(runs: DataFrame, selected: DataFrame, analysis_documents: DataFrame) -> DataFrame:
    """(run_id, rule) for runs whose scope is unknown, empty, not a single document or outside the analysis."""
    linked = analysis_documents.select("analysis_id", "document_id").distinct().withColumn("_linked", F.lit(True))
    counted = (
        _chosen(selected)
        .join(runs.select("run_id", "analysis_id"), "run_id")
        .join(linked, ["analysis_id", "document_id"], "left")
        .groupBy("run_id")
        .agg(F.count(F.lit(1)).alias("_n"), F.count_if(F.col("_linked").isNull()).alias("_outside"))
    )
    joined = runs.withColumn("_mode", _scope_mode(F.col("scope_mode"))).join(counted, "run_id", "left")
    n = F.coalesce("_n", F.lit(0))
    narrow = F.col("_mode").isin("ONE_DOCUMENT", "SELECTED_DOCUMENTS")
    codes = violations(
        ("UNSUPPORTED_SCOPE_MODE", ~F.col("_mode").isin(*S.SCOPE_MODES)),
        ("SCOPE_WITHOUT_DOCUMENTS", narrow & (n == 0)),
        ("ONE_DOCUMENT_WITH_OTHER_COUNT", (F.col("_mode") == "ONE_DOCUMENT") & (n > 1)),
        ("DOCUMENT_OUTSIDE_ANALYSIS", narrow & (F.coalesce("_outside", F.lit(0)) > 0)),
    )
    return joined.select("run_id", F.explode(codes).alias("rule"))


# --- terms ----------------------------------------------------------------------------------------------


def expand_terms(normalisations: DataFrame, registry: DataFrame) -> DataFrame:
    """(term, expansion) in both directions for human-validated expressions and their code values.

    ``normalisations``: source_expression, target_code, review_status. ``registry``: code, code_value.
    """
    valid = normalisations.where(F.col("review_status") == "HUMAN_VALIDATED").select(
        clean(F.col("source_expression")).alias("a"), F.col("target_code").alias("code")
    )
    values = registry.select("code", clean(F.col("code_value")).alias("b")).where(F.col("code").isNotNull()).distinct()
    pairs = valid.distinct().join(values, "code").where((F.col("a") != "") & (F.col("b") != "")).select("a", "b").distinct()
    both = F.array(
        F.struct(F.col("a").alias("term"), F.col("b").alias("expansion")),
        F.struct(F.col("b").alias("term"), F.col("a").alias("expansion")),
    )
    return pairs.select(F.inline(both)).distinct()


def query_terms(concepts: DataFrame, normalisations: DataFrame) -> DataFrame:
    """(query_id, role, term): code values of each query component and their validated expressions.

    ``concepts``: query_id, role, code, code_value.
    """
    valid = normalisations.where(F.col("review_status") == "HUMAN_VALIDATED").select(
        F.col("target_code").alias("code"), F.col("source_expression").alias("term")
    ).distinct()
    direct = concepts.select("query_id", "role", F.col("code_value").alias("term"))
    normalised = concepts.select("query_id", "role", "code").distinct().join(valid, "code").select("query_id", "role", "term")
    return direct.unionByName(normalised).where(F.col("term").isNotNull()).distinct()


# --- lexical retrieval ------------------------------------------------------------------------------------


def _query_terms(queries: DataFrame, expansions: DataFrame | None, stop: Sequence[str]) -> DataFrame:
    """(query_id, term, expanded, phrase): the phrase of a query stands on its own terms."""
    asked = durable(queries).select(
        "query_id", tokens(F.col("query_text"), 3, stop).alias("_t"), normalise_label(F.col("query_text")).alias("_phrase")
    )
    own = asked.select("query_id", F.explode("_t").alias("term"), F.lit(False).alias("expanded"), "_phrase")
    if expansions is None:
        return durable(own)
    wide = durable(
        expansions.select(
            normalise_label(F.col("term")).alias("_from"), F.explode(tokens(F.col("expansion"), 3, stop)).alias("term")
        ).distinct()
    )
    # An expansion is active when every word of the expanded expression occurs in the query.
    needed = wide.select("_from", F.explode(tokens(F.col("_from"), 1, ())).alias("_word")).distinct()
    sizes = needed.groupBy("_from").agg(F.count(F.lit(1)).alias("_need"))
    words = asked.select("query_id", F.explode(F.array_distinct(F.split("_phrase", " "))).alias("_word"))
    active = (
        words.join(needed, "_word")
        .groupBy("query_id", "_from")
        .agg(F.count(F.lit(1)).alias("_have"))
        .join(sizes, "_from")
        .where(F.col("_have") == F.col("_need"))
        .select("query_id", "_from")
    )
    added = active.join(wide, "_from").select("query_id", "term").distinct()
    added = added.join(own.select("query_id", "term"), ["query_id", "term"], "left_anti").select(
        "query_id", "term", F.lit(True).alias("expanded"), F.lit(None).cast("string").alias("_phrase")
    )
    return durable(own.unionByName(added))


def _read(passages: DataFrame, stop: Sequence[str], *keys: str) -> DataFrame:
    """(passage_id, keys, chars, _norm, _t): passages with their normalised text and its terms."""
    text = passages.select("passage_id", *keys, F.length("passage_text").cast("long").alias("chars"), normalise_label(F.col("passage_text")).alias("_norm"))
    return text.withColumn("_t", label_tokens(F.col("_norm"), 3, stop))


#: Query lists of up to so many bytes are held by every task; longer ones are joined.
LISTED_BYTES = 16 * 1024 * 1024
_ORDER = (("document_id", False), ("passage_order", True), ("passage_id", False))


def _pairs(
    text: DataFrame, terms: DataFrame, asked: DataFrame | None = None, excluded: DataFrame | None = None, within: DataFrame | None = None,
    best: int | None = None, by_package: bool = False, words: bool = True, listed_bytes: int | None = None,
) -> DataFrame:
    """Passages and the queries of which they hold an asked term, scored where the passages lie.

    ``text``: see ``_read``. ``asked``: (query_id, term), some of ``terms``; all of them if None. ``excluded`` and ``within``: (query_id, package_id)
    that are left out, or the only ones looked at. ``best``: how many of a query, or of a query and package, are wanted; more may be returned,
    those wanted are among them. ``words``: with the own and the expanded terms in common. No pair is shuffled. Lists of queries of a
    measured size are held by the tasks, which add up the points of all pairs of a batch; longer lists are joined.
    """
    terms = durable(terms)
    lists = [terms, *(durable(x) for x in (asked, excluded, within) if x is not None)]
    if not _short(lists, listed_bytes) or (excluded is not None and within is not None):
        met = _joined_pairs(text, terms, asked, excluded, within)
        return met if words else met.drop("_own", "_wide")
    rest = iter(lists[1:])
    asked, excluded, within = (None if x is None else next(rest) for x in (asked, excluded, within))
    named = within if excluded is None else excluded
    p = postings(
        terms.select("query_id", "term", "expanded", "_phrase").collect(), asked and asked.select("query_id", "term").collect(),
        None if named is None else named.select("query_id", "package_id").collect(), within is not None,
    )
    columns = [c for c in text.columns if c not in ("_norm", "_t")]
    kinds = {f.name: f.dataType.simpleString() for f in text.schema.fields}
    schema = ", ".join(["query_id string", *(f"{c} {kinds[c]}" for c in columns), "lexical_score long", *(["_own array<string>", "_wide array<string>"] if words else [])])
    order = [k for k in _ORDER if k[0] in columns]
    weights = (TERM_WEIGHT, EXPANSION_WEIGHT, PHRASE_WEIGHT)

    def scored(batches):
        return score_batches(batches, p, columns, weights, words, best, by_package, order)

    return text.mapInArrow(scored, schema)


def _short(lists: Sequence[DataFrame], listed_bytes: int | None = None) -> bool:
    return sum(map(measured_bytes, lists)) <= (LISTED_BYTES if listed_bytes is None else listed_bytes)


def _joined_pairs(text: DataFrame, terms: DataFrame, asked: DataFrame | None, excluded: DataFrame | None, within: DataFrame | None) -> DataFrame:
    """Passages joined to the queries of which they hold an asked term, scored where the passages lie.

    See ``_pairs``. A pair meets once for each asked term that it
    shares and is kept at the first of them, so that nothing has to be brought together: no pair is shuffled.
    """
    asked = terms.select("query_id", "term") if asked is None else asked
    first = asked.groupBy("query_id").agg(F.array_sort(F.collect_list("term")).alias("_asked"))
    lists = terms.groupBy("query_id").agg(
        F.collect_list(F.when(~F.col("expanded"), F.col("term"))).alias("_own"), F.collect_list(F.when(F.col("expanded"), F.col("term"))).alias("_wide"), F.max("_phrase").alias("_phrase")
    )
    # terms of a query are bounded by the query and its active expansions
    listed = checked_broadcast(first.join(lists, "query_id"))
    met = text.withColumn("term", F.explode("_t")).join(checked_broadcast(asked), "term")
    if excluded is not None:
        met = met.join(checked_broadcast(excluded.select("query_id", "package_id").distinct()), ["query_id", "package_id"], "left_anti")
    if within is not None:
        met = met.join(checked_broadcast(within), ["query_id", "package_id"], "left_semi")
    once = met.join(listed, "query_id").where(F.col("term") == F.get(F.array_intersect("_asked", "_t"), F.lit(0)))
    hit = once.withColumns({"_own": F.array_intersect("_own", "_t"), "_wide": F.array_intersect("_wide", "_t")})
    # a whole query adds points to passages that hold one of its own terms or of their expansions
    whole = F.when(F.coalesce(F.contains("_norm", F.col("_phrase")), F.lit(False)), PHRASE_WEIGHT).otherwise(0)
    score = TERM_WEIGHT * F.size("_own") + EXPANSION_WEIGHT * F.size("_wide") + whole
    return hit.withColumn("lexical_score", score.cast("long")).drop("term", "_asked", "_norm", "_t", "_phrase")


def lexical_scores(
    passages: DataFrame,
    queries: DataFrame,
    expansions: DataFrame | None = None,
    stop: Sequence[str] = TAXONOMY_STOP_WORDS,
    excluded: DataFrame | None = None,
) -> DataFrame:
    """Every (query, passage) pair that shares a term, with its score and the passage's order keys, in the passage's task.

    ``queries``: query_id, query_text. ``excluded``: query_id, package_id of packages that a query must not find.
    """
    keys = ["document_id", "passage_order", *(["package_id"] if excluded is not None else [])]
    return _pairs(_read(passages, stop, *keys), _query_terms(queries, expansions, stop), excluded=excluded, words=False)


def _reach(text: DataFrame, terms: DataFrame) -> DataFrame:
    """``terms`` with the points of the rarer terms of their query (_rarer) and those of themselves and all more frequent ones (_rest)."""
    wanted = checked_broadcast(terms.select("term").distinct())
    times = text.select(F.explode("_t").alias("term")).join(wanted, "term").groupBy("term").agg(F.count(F.lit(1)).alias("_times"))
    points = F.when(F.col("expanded"), EXPANSION_WEIGHT).otherwise(TERM_WEIGHT)
    rated = terms.join(times, "term", "left").withColumns({"_times": F.coalesce("_times", F.lit(0)), "_points": points})
    order = Window.partitionBy("query_id").orderBy("_times", "term")
    rest = F.sum("_points").over(order.rowsBetween(0, Window.unboundedFollowing))
    rarer = F.coalesce(F.sum("_points").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return durable(rated.select("query_id", "term", "expanded", "_phrase", rest.alias("_rest"), rarer.alias("_rarer")))


def lexical_retrieve(
    passages: DataFrame,
    queries: DataFrame,
    expansions: DataFrame | None = None,
    *,
    k: int,
    max_chars: int | None = None,
    stop: Sequence[str] = TAXONOMY_STOP_WORDS,
    excluded: DataFrame | None = None,
    listed_bytes: int | None = None,
) -> DataFrame:
    """The ``k`` best passages of each query; ``max_chars`` ends the list where a prompt has no more room.

    ``passages``: document_id, passage_id, passage_order, passage_text and further columns. Queries whose lists are short (see ``_pairs``) are answered
    in one walk over the passages. Otherwise the passages that hold one of the rarer terms of a query are scored first; the k-th best of them is a bound that the result reaches. Terms so frequent that all of them and the whole
    phrase together stay below the bound need not be looked for: a passage is scored only if it holds a term that can still reach it. Queries
    whose rarer terms were enough are done, the others look for the rest. Pairs are scored in the task of their passage, which sends
    on the ``k`` best of each query.
    """
    keys = ["document_id", "passage_order", *(["package_id"] if excluded is not None else [])]
    text = _read(passages, stop, *keys)
    terms = _query_terms(queries, expansions, stop)
    excluded = None if excluded is None else durable(excluded)
    order = [F.desc("lexical_score"), "document_id", F.asc_nulls_last("passage_order"), "passage_id"]

    def best(asked: DataFrame | None, of: DataFrame) -> DataFrame:
        rank = F.row_number().over(Window.partitionBy("query_id").orderBy(*order))
        met = _pairs(text, of, asked and asked.select("query_id", "term"), excluded, best=k, listed_bytes=listed_bytes)
        return met.withColumn("rank", rank.cast("long")).where(F.col("rank") <= k)

    if _short([terms, *([] if excluded is None else [excluded])], listed_bytes):
        hits = durable(best(None, terms))
    else:
        terms = _reach(text, terms)
        # the rarer half of the points, never none of them
        rarer = F.col("_rarer") * 2 < F.col("_rarer") + F.col("_rest")
        hits = durable(best(terms.where(rarer), terms))
        bound = hits.where(F.col("rank") == k).select("query_id", F.col("lexical_score").alias("_bound"))
        needed = terms.join(checked_broadcast(bound), "query_id", "left").where(F.col("_rest") + PHRASE_WEIGHT >= F.coalesce("_bound", F.lit(0)))
        unfinished = durable(needed.where(~rarer).select("query_id").distinct())
        if not unfinished.isEmpty():
            unfinished = checked_broadcast(unfinished)
            of = terms.join(unfinished, "query_id", "left_semi")
            more = best(needed.join(unfinished, "query_id", "left_semi"), of)
            hits = durable(hits.join(unfinished, "query_id", "left_anti").unionByName(more.select(*hits.columns)))
    running = Window.partitionBy("query_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    kept = hits.withColumn("cumulative_chars", F.sum("chars").over(running))
    if max_chars is not None:
        kept = kept.where(F.col("cumulative_chars") <= max_chars)
    return kept.select(
        "query_id", "passage_id", *keys, "chars", "lexical_score", "rank", "cumulative_chars",
        F.array_sort("_own").alias("matched_query_terms"), F.array_sort("_wide").alias("matched_expansion_terms"),
    )


def retrieval_summary(queries: DataFrame, scores: DataFrame, hits: DataFrame) -> DataFrame:
    """Candidate and selected counts per query, including queries without a hit."""
    candidates = scores.groupBy("query_id").agg(F.count(F.lit(1)).alias("candidate_count"))
    found = hits.groupBy("query_id").agg(
        F.count(F.lit(1)).alias("selected_count"), F.sum("chars").cast("long").alias("selected_characters")
    )
    zero = F.lit(0).cast("long")
    return queries.select("query_id").join(candidates, "query_id", "left").join(found, "query_id", "left").select(
        "query_id",
        *[F.coalesce(c, zero).alias(c) for c in ("candidate_count", "selected_count", "selected_characters")],
    )


def scope_sizes(scopes: DataFrame, passages: DataFrame) -> DataFrame:
    """(run_id, scope_passages, scope_chars): passages are counted per document before they meet the scopes."""
    counted = passages.groupBy("analysis_id", "document_id").agg(
        F.count(F.lit(1)).alias("_n"), F.sum(F.length("passage_text")).cast("long").alias("_chars")
    )
    return scopes.join(counted, ["analysis_id", "document_id"]).groupBy("run_id").agg(
        F.sum("_n").alias("scope_passages"), F.sum("_chars").alias("scope_chars")
    )


def choose_retrieval_mode(runs: DataFrame, sizes: DataFrame, hits: DataFrame) -> DataFrame:
    """How each run obtains its passages: by its governed query or its policy (ALL reads the whole scope), whatever its size.

    ``runs``: run_id, governed_query_id, retrieval_policy. ``sizes``: see ``scope_sizes``. ``hits``: run_id.
    """
    found = hits.groupBy("run_id").agg(F.count(F.lit(1)).alias("hit_count"))
    joined = runs.join(sizes, "run_id", "left").join(found, "run_id", "left")
    n, chars = F.coalesce("scope_passages", F.lit(0)), F.coalesce("scope_chars", F.lit(0))
    mode = (
        F.when(n == 0, F.lit("NO_PASSAGES_IN_SCOPE"))
        .when(F.length(F.coalesce("governed_query_id", F.lit(""))) > 0, F.lit("GOVERNED_QUERY"))
        .when(F.col("retrieval_policy") == "ALL", F.lit("ALL_SCOPED_PASSAGES"))
        .when(F.coalesce("hit_count", F.lit(0)) > 0, F.lit("LEXICAL"))
        .otherwise(F.lit("DETERMINISTIC_NO_SUPPORT"))
    )
    return joined.select("run_id", n.cast("long").alias("scope_passages"), chars.cast("long").alias("scope_chars"), mode.alias("retrieval_mode"))


def retrieval_snapshot(hits: DataFrame, keys: Sequence[str], prefix: str = "snapshot_") -> DataFrame:
    """One frozen id per retrieval: hash of the run keys and the ``passage_id|text_sha256`` lines in passage order.

    The input is the result of a retrieval of the ``k`` best passages, so a group has at most ``k`` rows.
    """
    line = F.struct("package_id", "document_id", "passage_order", "passage_id", "text_sha256")
    lines = F.transform(F.array_sort(F.collect_list(line)), lambda h: F.concat_ws("|", h["passage_id"], h["text_sha256"]))
    grouped = hits.groupBy(*keys).agg(F.array_join(lines, "\n").alias("_m"), F.count(F.lit(1)).alias("passages"))
    return grouped.select(*keys, "passages", content_id(prefix, [*[F.col(k) for k in keys], F.col("_m")], 32).alias("retrieval_snapshot_id"))


# --- governed relationship search and role coverage -------------------------------------------------------

# Cue phrases per relationship and the direction in which they are read.
RELATION_CUES = (
    ("FOLLOWED_BY", "followed by", "FORWARD"),
    ("FOLLOWED_BY", "and then", "FORWARD"),
    ("FOLLOWED_BY", "before", "FORWARD"),
    ("FOLLOWED_BY", "led up to", "FORWARD"),
    ("FOLLOWED_BY", "after", "REVERSE"),
    ("FOLLOWED_BY", "preceded by", "REVERSE"),
    ("CONTRIBUTED_TO", "contributed to", "FORWARD"),
    ("CONTRIBUTED_TO", "led to", "FORWARD"),
    ("CONTRIBUTED_TO", "resulted in", "FORWARD"),
    ("CONTRIBUTED_TO", "caused by", "REVERSE"),
    ("CONTRIBUTED_TO", "due to", "REVERSE"),
    ("CONTRIBUTED_TO", "because of", "REVERSE"),
)


# Roles whose terms a cue relates.
RELATION_ROLES = ("SUBJECT_FACTOR", "OBJECT_EVENT")
_HITS = (
    "array<struct<query_id:string, requested_relationship:string, relation_cue:string, relation_direction:string, cue_position:bigint, "
    "subject_term:string, object_term:string>>"
)


def _sentences(passages: DataFrame) -> DataFrame:
    return passages.select(
        "passage_id", "document_id", F.posexplode(F.split(F.col("passage_text"), r"(?<=[.!?])\s+")).alias("sentence_index", "evidence_text")
    )


def _runs(words: Column, size: int) -> Column:
    """(at, run): all runs of ``size`` words with the place of their first word."""
    last = F.size(words) - size + 1
    places = F.filter(F.sequence(F.lit(1), F.greatest(last, F.lit(1))), lambda i: i <= last)
    return F.transform(places, lambda i: F.struct(i.alias("at"), F.array_join(F.slice(words, i, F.lit(size)), " ").alias("run")))


def _spaced(c: Column) -> Column:
    """Words with a space on each side, so that a part that begins and ends with a space is a run of whole words."""
    return F.concat(F.lit(" "), c, F.lit(" "))


def _cue_places(words: Column, cues: Sequence[tuple[str, str, str]]) -> Column:
    """(relationship, cue, direction, at, end) of all places of cues in a sentence."""
    by_size: dict[int, list[tuple[str, str, str]]] = {}
    for cue in cues:
        by_size.setdefault(len(cue[1].split(" ")), []).append(cue)

    def places(size: int, listed: list[tuple[str, str, str]]) -> Column:
        met = F.filter(_runs(words, size), lambda r: r["run"].isin(*{c for _, c, _ in listed}))
        one = lambda relationship, cue, direction: F.transform(
            F.filter(met, lambda r: r["run"] == cue),
            lambda r: F.struct(
                F.lit(relationship).alias("relationship"), F.lit(cue).alias("relation_cue"), F.lit(direction).alias("relation_direction"),
                r["at"].alias("at"), (r["at"] + size - 1).alias("end"),
            ),
        )
        return F.concat(*[one(*c) for c in listed])

    return F.concat(*[places(size, listed) for size, listed in sorted(by_size.items())])


def governed_relationship_query(
    passages: DataFrame, queries: DataFrame, terms: DataFrame, cues: Sequence[tuple[str, str, str]] = RELATION_CUES, listed_bytes: int | None = None
) -> DataFrame:
    """Sentences in which a subject term, a relation cue and an object term follow each other.

    ``queries``: query_id, relationship. ``terms``: query_id, role (SUBJECT_FACTOR, OBJECT_EVENT), term of any number of words.
    For every place of a cue the nearest term before it and the nearest term after it are taken (counted in words, then
    the longer, then the first term), so a place gives at most one row per query. FORWARD cues read subject - cue -
    object, REVERSE cues the other way. A task reads a sentence once for all terms and settles its places there (``plans.runs``); lists of terms
    above ``listed_bytes`` are joined.
    """
    # Sentences without any cue are dropped before anything else.
    norm = normalise_label(F.col("evidence_text"))
    sentences = _sentences(passages).withColumn("_spaced", _spaced(norm)).where(F.rlike("_spaced", F.lit("|".join(rf" \Q{c}\E " for _, c, _ in cues))))
    wanted = durable(
        terms.join(queries, "query_id").where(F.col("role").isin(*RELATION_ROLES)).select(
            "query_id", "relationship", "role", "term", _spaced(normalise_label(F.col("term"))).alias("_run")
        ).where(F.trim("_run") != "").distinct()
    )
    result = ["query_id", "requested_relationship", "passage_id", "document_id", "sentence_index", "subject_term", "relation_cue", "cue_position", "relation_direction", "object_term", "evidence_text"]
    if _short([wanted], listed_bytes):
        asked = [tuple(r) for r in wanted.where("relationship IS NOT NULL").withColumn("_run", F.trim("_run")).collect()]
        read = sentences.where(F.col("passage_id").isNotNull()).select(
            "passage_id", "document_id", F.col("sentence_index").cast("long").alias("sentence_index"), "evidence_text", F.split(F.trim("_spaced"), " ").alias("_w")
        )
        columns = ["passage_id", "document_id", "sentence_index", "evidence_text"]

        def related(batches):
            return relation_batches(batches, asked, cues, columns, RELATION_ROLES)

        hits = read.mapInArrow(related, f"passage_id string, document_id string, sentence_index long, evidence_text string, _hits {_HITS}")
        # the text of a sentence is digested once for all its rows
        rows = hits.withColumn("evidence_text_sha256", F.sha2("evidence_text", 256)).select(*columns, "evidence_text_sha256", F.inline("_hits"))
        return rows.select(*result, "evidence_text_sha256")
    return _joined_relationships(passages, sentences, wanted, cues).withColumn("evidence_text_sha256", F.sha2("evidence_text", 256)).select(*result, "evidence_text_sha256")


def _joined_relationships(passages: DataFrame, sentences: DataFrame, wanted: DataFrame, cues: Sequence[tuple[str, str, str]]) -> DataFrame:
    """See ``governed_relationship_query``. Sentences meet the terms that they contain and find places and distances where they lie;
    only the nearest terms are brought together, and the sentences are read again for the rows found.
    """
    ids = ["passage_id", "document_id", "sentence_index"]
    wanted = checked_broadcast(wanted)
    met = containing(sentences.select(*ids, "_spaced"), "_spaced", wanted.select("_run"), "_run")
    # places of cues and of the term are found once for a sentence and a term, and then serve all its queries
    words, run = F.split(F.trim("_spaced"), " "), F.split(F.trim("_run"), " ")
    length = F.size("_words")
    start = F.filter(
        F.sequence(F.lit(1), F.greatest(F.size("_w") - length + 1, F.lit(1))),
        lambda i: (F.element_at("_w", i) == F.get("_words", F.lit(0))) & (F.slice("_w", i, length) == F.col("_words")),
    )
    placed = met.select(*ids, "_run", words.alias("_w"), run.alias("_words")).select(
        *ids, "_run", _cue_places(F.col("_w"), cues).alias("_cues"), start.alias("_from"), length.alias("_n")
    )
    found = placed.join(wanted, "_run").select(
        "query_id", *ids, "role", "term", F.length(F.trim("_run")).alias("_l"), "_from", "_n",
        F.inline(F.filter("_cues", lambda c: c["relationship"] == F.col("relationship"))),
    )
    first_role = F.when(F.col("relation_direction") == "FORWARD", F.lit("SUBJECT_FACTOR")).otherwise(F.lit("OBJECT_EVENT"))
    before = F.col("at") - (F.array_max(F.filter("_from", lambda i: i + F.col("_n") - 1 < F.col("at"))) + F.col("_n") - 1)
    after = F.array_min(F.filter("_from", lambda i: i > F.col("end"))) - F.col("end")
    near = found.withColumn("_d", F.when(F.col("role") == first_role, before).otherwise(after)).where("_d is not null")
    nearest = F.struct(F.col("_d"), (-F.col("_l")).alias("_l"), F.col("term"))
    rows = near.groupBy("query_id", "relationship", *ids, "relation_cue", "relation_direction", F.col("at").alias("cue_position")).agg(
        F.min(F.when(F.col("role") == "SUBJECT_FACTOR", nearest)).alias("_subject"),
        F.min(F.when(F.col("role") == "OBJECT_EVENT", nearest)).alias("_object"),
    ).where(F.col("_subject").isNotNull() & F.col("_object").isNotNull())
    texts = _sentences(passages).drop("document_id")
    return texts.join(checked_broadcast(rows), ["passage_id", "sentence_index"]).select(
        "query_id",
        F.col("relationship").alias("requested_relationship"),
        "passage_id",
        "document_id",
        F.col("sentence_index").cast("long").alias("sentence_index"),
        F.col("_subject.term").alias("subject_term"),
        "relation_cue",
        F.col("cue_position").cast("long").alias("cue_position"),
        "relation_direction",
        F.col("_object.term").alias("object_term"),
        "evidence_text",
    )


def role_matches(passages: DataFrame, terms: DataFrame) -> DataFrame:
    """(query_id, role, term, package_id, document_id, passage_id) for terms found as whole words in a passage, each once."""
    wanted = checked_broadcast(terms.select("query_id", "role", "term", _spaced(normalise_label(F.col("term"))).alias("_run")).where(F.trim("_run") != "").distinct())
    words = passages.select("package_id", "document_id", "passage_id", _spaced(normalise_label(F.col("passage_text"))).alias("_spaced"))
    met = containing(words, "_spaced", wanted.select("_run"), "_run")
    return met.join(wanted, "_run").select("query_id", "role", "term", "package_id", "document_id", "passage_id")


def role_coverage_retrieve(passages: DataFrame, terms: DataFrame, listed_bytes: int | None = None) -> DataFrame:
    """Matching passages of packages in which every role of the query occurs.

    Returns query, package, document, passage, the number of matched roles, whether the passage alone has all
    roles, and the matched terms as ``role=term`` strings. The matches of one passage are bounded by the terms of the query.

    Passages are read twice, for the roles of packages and for the rows (``plans.runs``): matches are settled where the passage lies, and only those of
    repeated keys are brought together. Lists of terms above ``listed_bytes`` are joined.
    """
    keys = ["query_id", "package_id", "document_id", "passage_id"]
    wanted = durable(terms.select("query_id", "role", "term", normalise_label(F.col("term")).alias("_run")).where(F.col("_run") != "").distinct())
    roles = terms.where(F.length(normalise_label(F.col("term"))) > 0).groupBy("query_id").agg(F.countDistinct("role").alias("roles"))
    if _short([wanted], listed_bytes):
        asked = [tuple(r) for r in wanted.where("query_id IS NOT NULL").collect()]
        read = passages.where(F.col("package_id").isNotNull()).select(*keys[1:], F.split(normalise_label(F.col("passage_text")), " ").alias("_w"))

        def by_package(batches):
            return role_batches(batches, asked, (), True)

        def by_passage(batches):
            return role_batches(batches, asked, keys[1:], False)

        found = read.select("package_id", "_w").mapInArrow(by_package, "query_id string, package_id string, role string")
        schema = ", ".join(f"{k} string" for k in keys) + ", _roles array<string>, _labels array<string>"
        key = F.xxhash64(*keys[1:])
        # keys that come again are known by their hash; a passage that only shares the hash is grouped, too
        again = checked_broadcast(read.groupBy(key.alias("_key")).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("_key"))
        if again.isEmpty():
            matched = read.mapInArrow(by_passage, schema)
        else:
            keyed = read.withColumn("_key", key)
            matched = keyed.join(again, "_key", "left_anti").select(*read.columns).mapInArrow(by_passage, schema).unionByName(
                keyed.join(again, "_key", "left_semi").select(*read.columns).mapInArrow(by_passage, schema).groupBy(*keys).agg(
                    F.array_distinct(F.flatten(F.collect_list("_roles"))).alias("_roles"), F.array_sort(F.flatten(F.collect_list("_labels"))).alias("_labels")
                )
            )
    else:
        label = F.concat_ws("=", "role", "term")
        matched = durable(
            role_matches(passages, terms).groupBy(*keys).agg(
                F.array_distinct(F.transform(F.collect_list(F.struct("role")), lambda t: t["role"])).alias("_roles"), F.array_sort(F.collect_list(label)).alias("_labels")
            )
        )
        found = matched.select("query_id", "package_id", F.explode("_roles").alias("role"))
    complete = (
        found.distinct()
        .groupBy("query_id", "package_id")
        .agg(F.count(F.lit(1)).alias("_n"))
        .join(roles, "query_id")
        .where(F.col("_n") == F.col("roles"))
        .select("query_id", "package_id", "roles")
    )
    kept = matched.join(checked_broadcast(complete), ["query_id", "package_id"]).withColumn("matched_roles", F.size("_roles").cast("long"))
    return kept.select(*keys, "matched_roles", (F.col("matched_roles") == F.col("roles")).alias("all_roles_in_passage"), F.array_join("_labels", "; ").alias("matched_terms"))


# --- similar cases ----------------------------------------------------------------------------------------


def _kind_case(values: dict[str, int], default: int) -> Column:
    chosen = F.when(F.lit(False), F.lit(default))
    for kind, value in values.items():
        chosen = chosen.when(F.col("node_kind") == kind, F.lit(value))
    return chosen.otherwise(F.lit(default))


def focus_concepts(nodes: DataFrame) -> DataFrame:
    """The concepts of each analysis, one per normalised label, numbered by kind and label.

    ``nodes``: analysis_id, node_kind, label. Identities such as vessels and actors are never concepts.
    """
    order = {kind: i + 1 for i, kind in enumerate(S.FOCUS_ORDER)}
    listed = nodes.where(F.col("node_kind").isin(*S.FOCUS_ORDER)).select(
        "analysis_id",
        F.trim("label").alias("label"),
        "node_kind",
        normalise_label(F.col("label")).alias("normalised_label"),
        _kind_case(order, 9).alias("_order"),
        _kind_case(S.FOCUS_WEIGHTS, 1).alias("weight"),
    ).where(~F.col("normalised_label").isin("", "subject vessel"))
    unique = listed.groupBy("analysis_id", "normalised_label").agg(F.min(F.struct("_order", "label", "node_kind", "weight")).alias("_c"))
    flat = unique.select("analysis_id", "normalised_label", "_c.*")
    rank = F.row_number().over(Window.partitionBy("analysis_id").orderBy("_order", "label", "normalised_label"))
    return flat.withColumn("position", rank.cast("long")).drop("_order")


def term_weights(concepts: DataFrame) -> DataFrame:
    """(analysis_id, term, weight): the largest weight of the concepts that contain a term."""
    words = concepts.select("analysis_id", "weight", F.explode(tokens(F.col("label"), 3, CASE_STOP_WORDS)).alias("term"))
    return words.groupBy("analysis_id", "term").agg(F.max("weight").alias("weight"))


def focus_queries(concepts: DataFrame) -> DataFrame:
    """One query per analysis: its concept labels in order."""
    joined = F.transform(F.array_sort(F.collect_list(F.struct("position", "label"))), lambda c: c["label"])
    return concepts.groupBy(F.col("analysis_id").alias("query_id")).agg(F.array_join(joined, " ; ").alias("query_text"))


def _case_terms(concepts: DataFrame) -> DataFrame:
    return _query_terms(focus_queries(concepts), None, CASE_STOP_WORDS)


def _case_text(passages: DataFrame, *keys: str) -> DataFrame:
    """Passages of packages; those of no package are left out."""
    return _read(passages.where(F.col("package_id").isNotNull()), CASE_STOP_WORDS, "package_id", *keys)


def case_pairs(passages: DataFrame, concepts: DataFrame, excluded: DataFrame | None = None, best: int | None = None) -> DataFrame:
    """Every (analysis, passage) pair that shares a term, with its lexical score, in the passage's task.

    ``excluded``: query_id (the analysis), package_id. Passages of no package are left out. ``best``: a task passes on at least so many of each
    analysis and package, and need not pass on more.
    """
    text = _case_text(passages, "document_id", "passage_order", "page_start", "page_end")
    return _pairs(text, _case_terms(concepts), excluded=excluded, best=best, by_package=True, words=False).withColumnRenamed("query_id", "analysis_id")


def phrase_counts(text: DataFrame, named: DataFrame, lists: DataFrame) -> DataFrame:
    """(package_id, _phrase, analysis_id, passages): how many passages of a package contain a phrase.

    ``text``: see ``_case_text``. ``named``: analysis_id, _phrase. ``lists``: analysis_id, _terms. Passages that hold a word of the phrase share it
    with every analysis and are counted together, without ``analysis_id``; where the phrase is only a part of longer words, or has no word that
    counts, passages are compared with the terms of its analyses where they lie.
    """
    asking = named.distinct().join(lists, "analysis_id").groupBy("_phrase").agg(F.collect_list(F.struct("analysis_id", "_terms")).alias("_by"))
    held = containing(text, "_norm", named, "_phrase")
    sure = F.coalesce(F.arrays_overlap("_t", label_tokens(F.col("_phrase"), 3, CASE_STOP_WORDS)), F.lit(False))
    kind = named.schema["analysis_id"].dataType
    sharing = F.transform(F.filter("_by", lambda a: F.arrays_overlap(a["_terms"], F.col("_t"))), lambda a: a["analysis_id"])
    by = F.when(sure, F.array(F.lit(None).cast(kind))).otherwise(sharing)
    rows = held.join(checked_broadcast(asking), "_phrase").select("package_id", "_phrase", F.explode(by).alias("analysis_id"))
    return durable(rows.groupBy("package_id", "_phrase", "analysis_id").agg(F.count(F.lit(1)).alias("passages")))


def _by_analysis(counted: DataFrame, named: DataFrame) -> DataFrame:
    """Counts of ``phrase_counts`` for the analyses that have the phrase. ``named``: analysis_id, _phrase and further columns."""
    named = checked_broadcast(named)
    columns = ["package_id", "passages", *named.columns]
    sure = counted.where("analysis_id is null").drop("analysis_id").join(named, "_phrase")
    return sure.select(*columns).unionByName(counted.where("analysis_id is not null").join(named, ["analysis_id", "_phrase"]).select(*columns))


def package_index(text: DataFrame, terms: DataFrame) -> DataFrame:
    """(package_id, term, passages): in how many passages of each package a wanted term occurs."""
    wanted = checked_broadcast(terms.select("term").distinct())
    held = text.select("package_id", F.explode("_t").alias("term")).join(wanted, "term")
    return held.groupBy("package_id", "term").agg(F.count(F.lit(1)).alias("passages"))


def similar_cases(
    passages: DataFrame, concepts: DataFrame, excluded: DataFrame | None = None, *, k: int, version: str = "SIMILAR_CASES_1"
) -> DataFrame:
    """The ``k`` packages most similar to each analysis, by all passages of the corpus that share a term with it.

    Scores are sums over passages, so they follow from an index of packages: how many passages of a package hold a term, a concept or
    the whole query. Packages below the k-th concept weight of an analysis, which is what packages are ordered by first, are dropped before
    they are added up. Only the best single passage, the last but one order key, needs passages: it is looked up for the
    packages that the keys before it leave in question. No (analysis, passage) pair is shuffled.
    """
    pair = ["analysis_id", "package_id"]
    terms, text = _case_terms(concepts), _case_text(passages)
    mine = terms.withColumnRenamed("query_id", "analysis_id")
    weights = mine.select("analysis_id", "term").join(term_weights(concepts), ["analysis_id", "term"], "left")
    rated = weights.select("analysis_id", "term", F.coalesce("weight", F.lit(1)).alias("weight"))
    lists = checked_broadcast(mine.groupBy("analysis_id").agg(F.collect_list("term").alias("_terms")))
    labels = concepts.select("analysis_id", F.col("normalised_label").alias("_phrase"), "label", "weight")
    queries = mine.groupBy("analysis_id").agg(F.max("_phrase").alias("_phrase"))
    own = None if excluded is None else checked_broadcast(excluded.select(F.col("query_id").alias("analysis_id"), "package_id").distinct())

    def allowed(rows: DataFrame) -> DataFrame:
        return rows if own is None else rows.join(own, pair, "left_anti")

    counted = phrase_counts(text, labels.select("analysis_id", "_phrase").unionByName(queries.select("analysis_id", "_phrase")), lists)
    by_concept = durable(
        allowed(_by_analysis(counted, labels)).groupBy(*pair).agg(
            F.sum(F.col("weight") * F.col("passages")).alias("matched_concept_weight"), F.array_sort(F.collect_set("label")).alias("matched_concepts")
        )
    )
    # what an analysis with k packages of a concept has to reach
    nth = F.row_number().over(Window.partitionBy("analysis_id").orderBy(F.desc("matched_concept_weight")))
    floor = by_concept.select("analysis_id", F.col("matched_concept_weight").alias("_floor"), nth.alias("_nth")).where(F.col("_nth") == k).drop("_nth")
    zero, none = F.lit(0).cast("long"), F.array().cast("array<string>")
    index = package_index(text, terms).join(checked_broadcast(rated), "term")
    rows = index.select(*pair, "term", (TERM_WEIGHT * F.col("passages")).alias("_points"), (F.col("weight") * F.col("passages")).alias("_terms"))
    whole = _by_analysis(counted, queries)
    rows = allowed(rows.unionByName(whole.select(*pair, F.lit(None).cast("string").alias("term"), (PHRASE_WEIGHT * F.col("passages")).alias("_points"), zero.alias("_terms"))))
    weight = F.coalesce("matched_concept_weight", zero)
    rows = rows.join(checked_broadcast(by_concept), pair, "left").join(checked_broadcast(floor), "analysis_id", "left").where(weight >= F.coalesce("_floor", zero))
    sums = rows.groupBy(*pair).agg(
        F.sum("_points").alias("total_score"), F.sum("_terms").alias("_terms"), F.array_sort(F.collect_list("term")).alias("matched_query_terms"),
        F.first(weight).alias("matched_concept_weight"), F.first(F.coalesce("matched_concepts", none)).alias("matched_concepts"),
    )
    packages = sums.withColumn("weighted_score", F.col("total_score") + 25 * F.col("_terms") + 40 * F.col("matched_concept_weight")).drop("_terms")
    order = [
        F.desc("matched_concept_weight"), F.desc(F.size("matched_concepts")), F.desc("weighted_score"),
        F.desc(F.size("matched_query_terms")), F.desc("total_score"),
    ]
    by_analysis = Window.partitionBy("analysis_id")
    # packages that agree in all keys so far share a place
    open_ = durable(packages.withColumn("_place", F.rank().over(by_analysis.orderBy(*order))).where(F.col("_place") <= k).drop("_place"))
    met = _pairs(text, terms, within=open_.select(F.col("analysis_id").alias("query_id"), "package_id"), best=1, by_package=True, words=False)
    top = met.groupBy(F.col("query_id").alias("analysis_id"), "package_id").agg(F.max("lexical_score").alias("max_passage_score"))
    rank = F.row_number().over(by_analysis.orderBy(*order, F.desc("max_passage_score"), "package_id"))
    return (
        open_.join(top, pair)
        .withColumn("rank", rank.cast("long"))
        .where(F.col("rank") <= k)
        .withColumn("matched_expansion_terms", none)
        .withColumn("candidate_id", content_id("similar_case_", [F.col("analysis_id"), F.col("package_id"), F.lit(version)]))
    )


def top_evidence(pairs: DataFrame, documents: DataFrame, *, n: int) -> DataFrame:
    """The best ``n`` passages of each (analysis, package) with reference and location.

    ``pairs``: see ``case_pairs``; a task sends on its best ``n`` of each. ``documents``: document_id, filename.
    """
    order = [F.desc("lexical_score"), "document_id", F.asc_nulls_last("passage_order"), "passage_id"]
    rank = F.row_number().over(Window.partitionBy("analysis_id", "package_id").orderBy(*order))
    best = pairs.withColumn("evidence_rank", rank.cast("long")).where(F.col("evidence_rank") <= n)
    named = best.join(documents.select("document_id", "filename"), "document_id", "left")
    return named.select(
        "analysis_id", "package_id", "evidence_rank", "passage_id", "lexical_score",
        F.concat_ws(" · ", F.coalesce("filename", "package_id"), page_label(F.col("page_start"), F.col("page_end"))).alias("evidence_reference"),
        format_location(F.col("document_id"), F.col("page_start"), F.col("page_end")).alias("evidence_location"),
    )


def similar_case_violations(candidates: DataFrame, evidence: DataFrame, passages: DataFrame, own: DataFrame) -> DataFrame:
    """(analysis_id, rule, key): repeated or missing ranks, own packages and evidence that does not exist."""
    candidates = durable(candidates)
    ranks = candidates.groupBy("analysis_id").agg(
        F.count(F.lit(1)).alias("_n"), F.countDistinct("rank").alias("_d"), F.min("rank").alias("_lo"), F.max("rank").alias("_hi")
    )
    rank_codes = violations(
        ("RANKS_NOT_UNIQUE", F.col("_n") != F.col("_d")),
        ("RANKS_NOT_CONTIGUOUS", (F.col("_lo") != 1) | (F.col("_hi") != F.col("_n")) | (F.col("_n") != F.col("_d"))),
    )
    bad_ranks = ranks.select("analysis_id", F.explode(rank_codes).alias("rule"), F.lit("").alias("key"))
    mine = candidates.join(own, ["analysis_id", "package_id"], "left_semi").select(
        "analysis_id", F.lit("OWN_PACKAGE").alias("rule"), F.col("package_id").alias("key")
    )
    unknown = evidence.join(passages.select("passage_id"), "passage_id", "left_anti").select(
        "analysis_id", F.lit("EVIDENCE_PASSAGE_MISSING").alias("rule"), F.col("passage_id").alias("key")
    )
    return bad_ranks.unionByName(mine).unionByName(unknown)


# --- taxonomy ---------------------------------------------------------------------------------------------


#: Texts of nodes that a task compares with the registry.
TASK_TEXTS = 5_000
# Node kind -> (class of entity path, bonus).
TAXONOMY_BONUS = {
    "ContributingFactor": ("<contributing factor>", 60),
    "Recommendation": ("<safety recommendation>", 60),
    "Event": ("<event>", 45),
    "System": ("<event>", 45),
    "Vessel": ("<vessel>", 25),
}


def taxonomy_shortlist(nodes: DataFrame, registry: DataFrame, *, k: int) -> DataFrame:
    """The ``k`` registry codes that fit each node best.

    ``nodes``: node_id, node_kind, label, description. ``registry``: entity_path, entity_name, attribute_name,
    code, code_value. Score: 18 per shared word with the code value, 6 per shared word with the attribute, a
    bonus by node kind and entity path, 120 when the code value occurs in the node text and 70 when all its
    words do.

    The score is a sum of three parts: of the code phrase, of the attribute and of the class of the entity
    path. Node texts are compared with distinct phrases and distinct attributes, not with registry rows, and
    rows that score by the same parts are represented by the first ``k`` of them, which are the only ones that
    can be listed. A phrase is dropped when ``k`` rows of a better one beat everything it could reach, and rows of the same parts
    when ``k`` codes of others of the text score more, before any row is listed. A task has some ``TASK_TEXTS`` texts.
    """
    rows = _registry_rows(registry)
    text = normalise_label(F.concat_ws(" ", F.coalesce("label", F.lit("")), F.coalesce("description", F.lit(""))))
    texts = nodes.select("node_id", "node_kind", text.alias("_text")).withColumn(
        "_key", F.sha2(F.concat_ws("\u0001", "node_kind", "_text"), 256)
    )
    # Nodes of one kind with the same text share one result.
    distinct = durable(texts.select("_key", "node_kind", "_text").distinct())
    parts = -(-distinct.count() // TASK_TEXTS)
    unique = spread_by(distinct, "_key", least=parts).withColumn("_words", tokens(F.col("_text")))
    phrases = durable(_matched_phrases(unique, rows).select("_key", "node_kind", "_words", "_phrase", "_rows", "_points"))
    attributes = durable(_matched_attributes(unique, rows).select("_key", "node_kind", "_attribute", "_points"))
    bound = (
        phrases.select("_key", "_points", F.when(F.col("_rows") >= k, F.col("_points")).alias("_sure"), F.lit(0).cast("long").alias("_attribute_points"))
        .unionByName(attributes.select("_key", F.lit(0).cast("long").alias("_points"), F.lit(None).cast("long").alias("_sure"), F.col("_points").alias("_attribute_points")))
        .groupBy("_key")
        .agg(F.coalesce(F.max("_sure"), F.lit(0)).alias("_sure"), F.max("_attribute_points").alias("_most"))
    )
    reach = F.lit(0)
    for kind, (_, value) in TAXONOMY_BONUS.items():
        reach = F.when(F.col("node_kind") == kind, F.lit(value)).otherwise(reach)
    kept = phrases.join(bound, "_key").where(F.col("_points") + F.col("_most") + reach >= F.col("_sure"))

    keep = ["entity_path", "entity_name", "attribute_name", "code_value", "code"]
    bonus = F.lit(0)
    for kind, (letter, value) in TAXONOMY_BONUS.items():
        bonus = F.when((F.col("node_kind") == kind) & F.contains("_class", F.lit(letter)), F.lit(value)).otherwise(bonus)
    listed = durable(_first_rows(rows, ["_phrase", "_attribute", "_class"], k).withColumn("_attribute_words", tokens(F.col("_attribute"))))
    shared = 6 * F.size(F.array_intersect("_words", "_attribute_words"))
    own = [F.col("_key"), F.col("node_kind"), F.col("_points")]
    # what rows of the same parts score, and whether they alone fill the list: codes are listed once for the same parts
    together, alone = ["_phrase", "_attribute", "_class"], ["_attribute", "_class"]
    full = (F.count(F.lit(1)) >= k).alias("_full")
    groups = checked_broadcast(listed.groupBy(*together, "_attribute_words").agg(full))
    first = durable(_first_rows(rows, alone, k))
    by_phrase = kept.join(groups, "_phrase").select(*own, "_words", *together, "_full", (F.col("_points") + shared + bonus).cast("long").alias("score"))
    by_attribute = attributes.join(checked_broadcast(first.groupBy(*alone).agg(full)), "_attribute").select(*own, *alone, "_full", (F.col("_points") + bonus).cast("long").alias("score"))
    by_class = unique.select("_key", "node_kind").join(checked_broadcast(durable(_bonus_rows(rows, k))), "node_kind")
    filled = by_phrase.where("_full").select("_key", "score").unionByName(by_attribute.where("_full").select("_key", "score"))
    # one number for a text; without one every row may be listed
    floor = spread_by(unique.select("_key").join(filled.groupBy("_key").agg(F.max("score").alias("_floor")), "_key", "left"), "_key", least=parts)
    floor = durable(floor.withColumn("_floor", F.coalesce("_floor", F.lit(0).cast("long"))))

    def reaching(found: DataFrame) -> DataFrame:
        return spread_by(found, "_key", least=parts).join(floor, "_key").where(F.col("score") >= F.col("_floor"))

    by_phrase = reaching(by_phrase.select("_key", "score", *together)).join(checked_broadcast(listed), together)
    by_attribute = reaching(by_attribute.select("_key", "score", *alone)).join(checked_broadcast(first), alone)
    by_class = reaching(by_class)
    columns = ["_key", "score", *keep]
    candidates = by_phrase.select(*columns).unionByName(by_attribute.select(*columns)).unionByName(by_class.select(*columns))
    # A code is found at most once by attribute, once by class and once per value by phrase.
    values = rows.groupBy("entity_path", "attribute_name", "code").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 1
    short = _first_codes(candidates, ["_key"], k, values + 2)
    return texts.join(short, "_key").select(
        "node_id", "rank", "score", *keep,
        content_id("taxonomy_candidate_", [F.col("entity_path"), F.col("attribute_name"), F.col("code_value"), F.col("code")], 20).alias("candidate_id"),
    )


def _registry_rows(registry: DataFrame) -> DataFrame:
    """Registry rows, each code once per phrase, with code phrase, attribute phrase and class of the path."""
    rows = registry.select(
        *[F.coalesce(F.trim(c), F.lit("")).alias(c) for c in ("entity_path", "entity_name", "attribute_name", "code_value")],
        F.col("code"),
    )
    path = F.concat_ws(" ", normalise_label(F.col("entity_path")), normalise_label(F.col("entity_name")))

    def has(words: str) -> Column:
        return F.contains(path, F.lit(words))

    parts = {
        "_phrase": normalise_label(F.col("code_value")),
        "_attribute": normalise_label(F.col("attribute_name")),
        "_class": F.concat_ws(
            "",
            F.when(has("contributing factor"), "<contributing factor>"),
            F.when(has("safety recommendation"), "<safety recommendation>"),
            F.when(has("accident event") | has("casualty event"), "<event>"),
            F.when(has("vessel"), "<vessel>"),
        ),
    }
    key = ["entity_path", "attribute_name", "code", *parts]
    unique = rows.withColumns(parts).groupBy(*key).agg(F.min(F.struct("code_value", "entity_name")).alias("_v"))
    return durable(unique.select(*key, "_v.*"))


def _matched_phrases(unique: DataFrame, rows: DataFrame) -> DataFrame:
    """(text, phrase) pairs with their points and the number of different codes of the phrase."""
    phrases = rows.where(F.col("_phrase") != "").groupBy("_phrase").agg(
        F.countDistinct("entity_path", "attribute_name", F.coalesce("code", F.lit(""))).alias("_rows")
    ).withColumn("_code_words", tokens(F.col("_phrase")))
    shared = F.array_intersect("_words", "_code_words")
    # A pair meets once per shared word and is kept at the first of them, which needs no second shuffle.
    by_word = (
        unique.withColumn("_word", F.explode("_words"))
        .join(checked_broadcast(phrases.withColumn("_word", F.explode("_code_words"))), "_word")
        .where(F.col("_word") == F.get(shared, F.lit(0)))
        .drop("_word")
    )
    # The phrase may also occur inside longer words of the text, without any word in common.
    held = containing(unique, "_text", phrases, "_phrase")
    by_part = held.join(checked_broadcast(phrases), "_phrase").where(F.size(shared) == 0)
    every = (F.size("_code_words") > 0) & (F.size(F.array_except("_code_words", "_words")) == 0)
    points = 18 * F.size(shared) + F.when(F.contains("_text", F.col("_phrase")), 120).otherwise(0) + F.when(every, 70).otherwise(0)
    return by_word.unionByName(by_part.select(*by_word.columns)).withColumn("_points", points.cast("long"))


def _matched_attributes(unique: DataFrame, rows: DataFrame) -> DataFrame:
    """(text, attribute) pairs that share a word, with their points."""
    listed = rows.select("_attribute").distinct().withColumn("_attribute_words", tokens(F.col("_attribute")))
    shared = F.array_intersect("_words", "_attribute_words")
    return (
        unique.withColumn("_word", F.explode("_words"))
        .join(checked_broadcast(listed.withColumn("_word", F.explode("_attribute_words"))), "_word")
        .where(F.col("_word") == F.get(shared, F.lit(0)))
        .withColumn("_points", (6 * F.size(shared)).cast("long"))
        .drop("_word")
    )


def _first_rows(rows: DataFrame, parts: Sequence[str], k: int) -> DataFrame:
    """The first ``k`` codes of each combination of score parts."""
    return _first_codes(rows.withColumn("score", F.lit(0).cast("long")), parts, k).drop("rank", "score")


def _bonus_rows(rows: DataFrame, k: int) -> DataFrame:
    """The first ``k`` codes of each node kind among those that score by their class alone."""
    bonuses = F.array_compact(
        F.array(
            *[
                F.when(F.contains("_class", F.lit(letter)), F.struct(F.lit(kind).alias("node_kind"), F.lit(value).cast("long").alias("score")))
                for kind, (letter, value) in TAXONOMY_BONUS.items()
            ]
        )
    )
    return _first_codes(rows.where(F.col("_class") != "").select("*", F.inline(bonuses)), ["node_kind"], k).drop("rank")


def _first_codes(candidates: DataFrame, groups: Sequence[str], k: int, times: int | None = None) -> DataFrame:
    """The ``k`` best codes of each group, each (path, attribute, code) once with its best score.

    ``times``: how often a code can occur in a group. It allows to cut each group before codes are merged.
    """
    order = [F.desc("score"), "entity_path", "attribute_name", "code_value", F.coalesce("code", F.lit(""))]
    first = F.row_number().over(Window.partitionBy(*groups).orderBy(*order))
    if times is not None and k * times <= 1000:
        candidates = candidates.withColumn("_r", first).where(F.col("_r") <= k * times).drop("_r")
    best = candidates.groupBy(*groups, "entity_path", "attribute_name", "code").agg(
        F.min(F.struct((-F.col("score")).alias("_s"), "code_value", "entity_name")).alias("_b")
    )
    flat = best.select(
        *groups, "entity_path", "attribute_name", "code", "_b.code_value", "_b.entity_name", (-F.col("_b._s")).alias("score")
    )
    return flat.withColumn("rank", first.cast("long")).where(F.col("rank") <= k)


def grounded_shortlist(factors: DataFrame, corpus: DataFrame, *, k: int) -> DataFrame:
    """The ``k`` best taxonomy passages for each gate-eligible factor (factor_node_id, factor_label, factor_description)."""
    queries = factors.select(
        F.col("factor_node_id").alias("query_id"),
        F.concat_ws(" ", "factor_label", "factor_description").alias("query_text"),
    ).distinct()
    return lexical_retrieve(corpus, queries, k=k).withColumnRenamed("query_id", "factor_node_id")


def recent(df: DataFrame, order: Sequence[Column], n: int) -> DataFrame:
    """The first ``n`` rows: a report of the newest entries, computed as a distributed top-n."""
    return df.orderBy(*order).limit(n)
