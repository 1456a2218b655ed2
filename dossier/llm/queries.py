"""The queries of the operators with their production parameters, and SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dossier.llm import bpe, conversations, decontamination, jaccard, licences, negatives, pii, quality, sharding, substrings, toxicity, urls, vectors

SHARDS = 24
VOCABULARY = "byte_bpe_50k.json"
URL_RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def register(function):
        QUERIES[function.__name__] = function
        if sql is not None:
            ORACLES[function.__name__] = sql
        return function

    return register


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def url_rules(spark: SparkSession) -> DataFrame:
    pairs = F.array(*[F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict")) for rule, verdict in URL_RULES])
    return spark.range(1).select(F.inline(pairs))


@query()
def op3_sorted_projections(spark: SparkSession, folder: str) -> DataFrame:
    return vectors.near_duplicates(table(spark, folder, "embeddings"))


URL_SQL = r"""
WITH parsed AS (
  SELECT page_id,
    CASE WHEN url IS NULL OR strpos(url, '://') = 0 THEN '' ELSE substr(url, strpos(url, '://') + 3) END AS rest
  FROM pages),
split AS (
  SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM parsed),
rules(rule, rule_host, rule_path, verdict) AS (VALUES
  ('net/', 'net', '/', 'block'), ('example.net/en/', 'example.net', '/en/', 'allow'),
  ('example.com/de/', 'example.com', '/de/', 'block'), ('org/fr/', 'org', '/fr/', 'allow')),
pairs AS (SELECT DISTINCT host, path FROM split),
best AS (
  SELECT host, path, arg_max(rule, length(rule)) AS rule, arg_max(verdict, length(rule)) AS verdict
  FROM pairs JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
  GROUP BY host, path)
SELECT page_id, s.host, s.path, b.rule, coalesce(b.verdict, 'allow') AS verdict
FROM split s LEFT JOIN best b ON s.host = b.host AND s.path = b.path
"""


@query()
def op1_quality_fm(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    model = quality.train(docs, table(spark, folder, "labels"))
    return quality.scored(docs, model).select("doc_id", quality.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


@query()
def op2_benchmark_leaks(spark: SparkSession, folder: str) -> DataFrame:
    return decontamination.leaks(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


@query(URL_SQL)
def op4_url_filters(spark: SparkSession, folder: str) -> DataFrame:
    pages = table(spark, folder, "pages").select("page_id", "url")
    return urls.judged(pages, url_rules(spark)).select("page_id", "host", "path", "rule", "verdict")


@query()
def op5_feistel_sharding(spark: SparkSession, folder: str) -> DataFrame:
    placed = sharding.sharded(table(spark, folder, "documents"), SHARDS)
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def _licence_sql() -> str:
    """The same steps in SQL, written out from the tables of the operator."""
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    known = licences.known_sentences(licences.SENTENCES)
    keys, values = ", ".join(map(quoted, known)), ", ".join(map(quoted, known.values()))
    markers = quoted("|".join(licences.MARKERS))
    left, found = "array_to_string(list_transform(ids, lambda i: '<' || i || '>'), '')", []
    for name, sequence in licences.RULES:
        wanted = quoted("".join(f"<{i}>" for i in sequence))
        found.append(f"CASE WHEN contains({left}, {wanted}) THEN {quoted(name)} END")
        left = f"replace({left}, {wanted}, '|')"
    return f"""
WITH looked AS (
  SELECT doc_id, MAP([{keys}], [{values}]) AS known,
    string_split_regex(lower(coalesce(text, '')), {quoted(licences.SENTENCE_END)}) AS held
  FROM documents),
marked AS (SELECT doc_id, known, list_filter(held, lambda s: regexp_matches(s, {markers})) AS held FROM looked),
found AS (
  SELECT doc_id, list_filter(list_transform(held, lambda s:
    known[trim(regexp_replace(s, '[^a-z0-9]+', ' ', 'g'))]), lambda i: i IS NOT NULL) AS ids
  FROM marked),
ruled AS (
  SELECT doc_id, ids, {left} AS remains, list_filter([{", ".join(found)}], lambda x: x IS NOT NULL) AS taken FROM found)
SELECT doc_id, array_to_string(ids, ',') AS sentences, array_to_string(list_sort(list_distinct(taken)), ',') AS licences,
  (length(remains) - length(replace(remains, '<', '')))::BIGINT AS n_unmatched,
  CASE WHEN len(ids) = 0 THEN 'NONE' WHEN len(taken) = 0 THEN 'UNKNOWN' WHEN contains(remains, '<') THEN 'PARTIAL' ELSE 'KNOWN' END AS status
FROM ruled
"""


@query(_licence_sql())
def op6_licence_sentences(spark: SparkSession, folder: str) -> DataFrame:
    return licences.licences(table(spark, folder, "documents"))


REPEATS_SQL = """
WITH split AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') AS words FROM documents),
starts AS (SELECT doc_id, words, unnest(range(1, len(words) - 11)) AS place FROM split),
seen AS (SELECT doc_id, place, array_to_string(words[place:place + 12], ' ') AS run FROM starts),
firsts AS (SELECT run, min(doc_id) AS first FROM seen GROUP BY run),
covered AS (
  SELECT DISTINCT doc_id, unnest(range(place, place + 13)) AS place FROM seen JOIN firsts USING (run) WHERE first < doc_id),
gone AS (SELECT doc_id, list(place) AS gone FROM covered GROUP BY doc_id),
kept AS (
  SELECT s.doc_id, words, list_filter(range(1, len(words) + 1), lambda i: gone IS NULL OR NOT list_contains(gone, i)) AS kept
  FROM split s LEFT JOIN gone g ON s.doc_id = g.doc_id)
SELECT doc_id, len(words)::BIGINT AS n_words, (len(words) - len(kept))::BIGINT AS n_removed,
  sha256(array_to_string(list_transform(kept, lambda i: words[i]), ' ')) AS kept_sha256
FROM kept
"""


@query(REPEATS_SQL)
def op7_repeated_windows(spark: SparkSession, folder: str) -> DataFrame:
    found = substrings.without_repeats(table(spark, folder, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


@query()
def op8_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    return jaccard.joined(table(spark, folder, "documents"))


@query()
def op9_byte_pairs(spark: SparkSession, folder: str) -> DataFrame:
    found = bpe.encoded(table(spark, folder, "documents"), public_tokenizers.path(VOCABULARY))
    return found.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


@query()
def op10_disclosed_data(spark: SparkSession, folder: str) -> DataFrame:
    found = pii.with_spans(table(spark, folder, "documents").select("doc_id", "text"))
    counts = [pii.count_of(F.col("base_spans"), kind).alias(f"n_{kind}") for kind in pii.KINDS]
    return found.select("doc_id", *counts, F.sha2(pii.written(F.col("base_spans")), 256).alias("base_sha256"), pii.written(pii.all_spans()).alias("spans"))


NEGATIVES_SQL = """
WITH fit AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS parts
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same, list_dot_product(a.parts, b.parts)::BIGINT AS score
  FROM fit a JOIN fit b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0),
positives AS (
  SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5)
SELECT anchor_id, positive_id,
  (row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other_id))::INT AS rank,
  other_id AS negative_id, positive_score, score AS negative_score
FROM positives JOIN scored USING (anchor_id)
WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
QUALIFY row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other_id) <= 3
"""


@query(NEGATIVES_SQL)
def op13_packed_negatives(spark: SparkSession, folder: str) -> DataFrame:
    moved = F.expr("CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END")
    return negatives.hard_negatives(table(spark, folder, "embeddings").withColumn("label", moved), F.col("vec_id") % 50 == 0)


@query()
def op12_toxic_segments(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    model = toxicity.train(docs, table(spark, folder, "labels"))
    found = toxicity.scored(docs, model)
    return found.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted", F.size("passages").cast("long").alias("n_passages"))


def damaged(turns: DataFrame) -> DataFrame:
    """Rows dropped, emptied, cut, doubled or given to the user, by a checksum of conversation and turn; dropped ones are not ``present``."""
    told = lambda name: F.coalesce(F.col(name).cast("string"), F.lit(" "))
    fault = F.crc32(F.concat(told("conv_id"), F.lit(":"), told("turn")).cast("binary")) % 20
    role, text = F.coalesce("role", F.lit(" ")), F.coalesce("text", F.lit(" "))
    return turns.select(
        "conv_id", "turn", F.when(fault == 4, "user").otherwise(role).alias("role"),
        F.when(fault == 1, "").when(fault == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"), (fault != 0).alias("present"),
        F.explode(F.when(fault == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("_copy"),
    ).drop("_copy")


@query()
def op11_hirschberg_repair(spark: SparkSession, folder: str) -> DataFrame:
    found = conversations.digests(conversations.repaired(damaged(table(spark, folder, "conversations"))))
    return found.select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")
