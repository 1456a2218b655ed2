"""Queries of sources, tables, text preparation and privacy."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types

from dossier.functions import privacy as identifiers
from dossier.functions import text as X
from dossier.functions.rules import METADATA_RULES, TEXT_RULES, reference_work
from dossier.operators import privacy as P
from dossier.operators import text as T
from dossier.queries import bindings as B
from dossier.queries.registry import query
from dossier.sources import tables
from dossier.sources.transcripts import flatten_transcript, json_text, transcript_segments

STOP = "[" + ", ".join(f"'{w}'" for w in X.TAXONOMY_STOP_WORDS) + "]"
GAP = r"[^\pL\pN_]+"


def norm_sql(c: str) -> str:
    return rf"trim(regexp_replace(lower(coalesce({c}, '')), '{GAP}', ' ', 'g'))"


def tokens_sql(c: str, stop: str = STOP) -> str:
    return f"list_filter(list_distinct(string_split({norm_sql(c)}, ' ')), lambda w: length(w) >= 3 AND NOT list_contains({stop}, w))"


@query("SELECT c_custkey::BIGINT AS c_custkey, c_name, c_acctbal::DOUBLE AS c_acctbal, NULL::VARCHAR AS note FROM customer")
def conformed_customers(spark: SparkSession, d: str) -> DataFrame:
    """Rows as they are appended: the columns of the schema in its order and types."""
    schema = types.StructType(
        [types.StructField("c_custkey", types.LongType(), False), types.StructField("c_name", types.StringType()), types.StructField("c_acctbal", types.DoubleType()), types.StructField("note", types.StringType())]
    )
    return tables.conform(B.table(spark, d, "customer"), schema)


@query("""SELECT document_id, analysis_id, information_class FROM docs WHERE document_role = 'MAIN_REPORT' AND source_managed_by = 'CANONICAL'""", "docs")
def pruned_scan(spark: SparkSession, d: str) -> DataFrame:
    return B.docs(spark, d).where("document_role = 'MAIN_REPORT' AND source_managed_by = 'CANONICAL'").select("document_id", "analysis_id", "information_class")


@query("""SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_shipdate >= TIMESTAMP '1999-01-01 00:00:00' AND l_returnflag = 'R'""")
def pushed_scan(spark: SparkSession, d: str) -> DataFrame:
    where = (F.col("l_shipdate") >= F.lit("1999-01-01").cast("timestamp_ntz")) & (F.col("l_returnflag") == "R")
    return tables.table_scan(spark, f"{d}/lineitem.parquet", ["l_orderkey", "l_linenumber", "l_quantity"], where)


_CHANGED = "SELECT custkey, name, bal FROM (SELECT c_custkey AS custkey, c_name AS name, c_acctbal AS bal FROM customer)"


def _customer(spark: SparkSession, d: str) -> DataFrame:
    return B.table(spark, d, "customer").selectExpr("c_custkey AS custkey", "c_name AS name", "c_acctbal AS bal")


def _order_totals(spark: SparkSession, d: str) -> DataFrame:
    """New versions of customer rows: one per customer with orders, and as many new customers."""
    totals = B.table(spark, d, "orders").groupBy("o_custkey").agg(F.round(F.sum("o_totalprice"), 2).alias("bal"))
    both = F.array(F.col("o_custkey"), F.col("o_custkey") + 1_000_000)
    return totals.select(F.explode(both).alias("custkey"), F.concat(F.lit("updated "), F.col("o_custkey").cast("string")).alias("name"), "bal")


_SOURCE = """source AS (SELECT unnest([o_custkey, o_custkey + 1000000]) AS custkey, 'updated ' || o_custkey AS name, bal
    FROM (SELECT o_custkey, round(sum(o_totalprice), 2) AS bal FROM orders GROUP BY 1)),
    target AS (SELECT c_custkey AS custkey, c_name AS name, c_acctbal AS bal FROM customer)"""


@query(f"WITH {_SOURCE} SELECT * FROM target WHERE custkey NOT IN (SELECT custkey FROM source) UNION ALL SELECT * FROM source")
def upserted_customers(spark: SparkSession, d: str) -> DataFrame:
    return tables.upsert(_customer(spark, d), _order_totals(spark, d), ["custkey"])


@query(f"WITH {_SOURCE} SELECT * FROM source WHERE custkey NOT IN (SELECT custkey FROM target)")
def inserted_customers(spark: SparkSession, d: str) -> DataFrame:
    return tables.insert_if_absent(_customer(spark, d), _order_totals(spark, d), ["custkey"])


@query(f"WITH {_SOURCE} SELECT * FROM target WHERE NOT (bal < 0) UNION ALL SELECT * FROM source WHERE bal > 100000")
def replaced_slice(spark: SparkSession, d: str) -> DataFrame:
    return tables.replace_slice(_customer(spark, d), _order_totals(spark, d).where("bal > 100000"), F.col("bal") < 0)


@query("SELECT n_nationkey, n_name, n_regionkey, NULL::VARCHAR AS detected_language, NULL::DOUBLE AS language_confidence FROM nation")
def evolved_schema(spark: SparkSession, d: str) -> DataFrame:
    wanted = {"n_name": "string", "detected_language": "string", "language_confidence": "double"}
    return tables.evolve_schema(B.table(spark, d, "nation"), wanted)


_NORM = r"""trim(regexp_replace(regexp_replace(regexp_replace(replace(replace(t, chr(13) || chr(10), chr(10)), chr(13), chr(10)),
    '[ \t]+', ' ', 'g'), '\n[ \t]+', chr(10), 'g'), '\n{3,}', chr(10) || chr(10), 'g'), ' ' || chr(10) || chr(9))"""


@query(f"SELECT doc_id, {_NORM} AS normalised FROM (SELECT doc_id, replace(text, ' the ', chr(13) || chr(10) || chr(9) || '  the  ') AS t FROM documents)")
def normalised_text(spark: SparkSession, d: str) -> DataFrame:
    text = F.replace("text", F.lit(" the "), F.lit("\r\n\t  the  "))
    return B.table(spark, d, "documents").select("doc_id", X.normalise_text(text).alias("normalised"))


@query(
    rf"""SELECT doc_id, {norm_sql("text")} AS unicode_label, trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')) AS ascii_label FROM documents"""
)
def normalised_labels(spark: SparkSession, d: str) -> DataFrame:
    return B.table(spark, d, "documents").select(
        "doc_id", X.normalise_label(F.col("text")).alias("unicode_label"), X.normalise_label_ascii(F.col("text")).alias("ascii_label")
    )


@query(f"SELECT doc_id, len(t)::BIGINT AS n_tokens, array_to_string(list_sort(t), ' ') AS tokens FROM (SELECT doc_id, {tokens_sql('text')} AS t FROM documents)")
def text_tokens(spark: SparkSession, d: str) -> DataFrame:
    t = X.tokens(F.col("text"))
    return B.table(spark, d, "documents").select(
        "doc_id", F.size(t).cast("long").alias("n_tokens"), F.array_join(F.array_sort(t), " ").alias("tokens")
    )


_TEXT = "replace(text, chr(10), chr(10) || chr(10))"


def _paragraph_docs(spark: SparkSession, d: str) -> DataFrame:
    return B.docs(spark, d).select("document_id", F.replace("text", F.lit("\n"), F.lit("\n\n")).alias("text"))


# The over-long paragraphs are cut by a recursive walk, all paragraphs are packed by a fold.
_PIECES = f"""
    paras AS (SELECT doc_id, pos, trim(p, ' ' || chr(9) || chr(10)) AS p FROM (
        SELECT doc_id, unnest(string_split(n, chr(10) || chr(10))) AS p, generate_subscripts(string_split(n, chr(10) || chr(10)), 1) AS pos
        FROM (SELECT doc_id, {_NORM} AS n FROM (SELECT doc_id, {_TEXT} AS t FROM documents))) WHERE trim(p, ' ' || chr(9) || chr(10)) <> ''),"""


@query(
    f"""WITH RECURSIVE {_PIECES}
    cuts AS (SELECT doc_id, pos, p, 0::BIGINT AS begin_at, NULL::VARCHAR AS piece, 0 AS k FROM paras WHERE length(p) > 3600
        UNION ALL SELECT doc_id, pos, p, begin_at + n, substr(p, begin_at + 1, n), k + 1 FROM (
            SELECT doc_id, pos, p, begin_at, k, CASE WHEN length(p) - begin_at <= 3600 THEN length(p) - begin_at
                WHEN b > 0 THEN 3600 - b ELSE 3600 END::BIGINT AS n
            FROM (SELECT *, strpos(reverse(substr(p, begin_at + 2401, 1200)), ' .') AS b FROM cuts) WHERE begin_at < length(p))),
    pieces AS (SELECT doc_id, pos, list(trim(piece) ORDER BY k) FILTER (trim(piece) <> '') AS pieces FROM cuts WHERE k > 0 GROUP BY doc_id, pos),
    items AS (SELECT doc_id, list({{'done': coalesce(pieces, []::VARCHAR[]), 'cur': CASE WHEN pieces IS NULL THEN p ELSE '' END}} ORDER BY pos) AS items
        FROM paras LEFT JOIN pieces USING (doc_id, pos) GROUP BY doc_id),
    folded AS (SELECT doc_id, list_reduce(items, lambda s, x: CASE
        WHEN len(x.done) > 0 THEN {{'done': list_concat(CASE WHEN s.cur <> '' THEN list_append(s.done, s.cur) ELSE s.done END, x.done), 'cur': ''}}
        WHEN length(CASE WHEN s.cur <> '' THEN s.cur || chr(10) || chr(10) || x.cur ELSE x.cur END) <= 2400
            THEN {{'done': s.done, 'cur': CASE WHEN s.cur <> '' THEN s.cur || chr(10) || chr(10) || x.cur ELSE x.cur END}}
        WHEN length(CASE WHEN s.cur <> '' THEN s.cur || chr(10) || chr(10) || x.cur ELSE x.cur END) <= 3600
            THEN {{'done': list_append(s.done, CASE WHEN s.cur <> '' THEN s.cur || chr(10) || chr(10) || x.cur ELSE x.cur END), 'cur': ''}}
        ELSE {{'done': CASE WHEN s.cur <> '' THEN list_append(s.done, s.cur) ELSE s.done END, 'cur': x.cur}} END,
        {{'done': []::VARCHAR[], 'cur': ''}}) AS s FROM items),
    chunks AS (SELECT doc_id, CASE WHEN s.cur <> '' THEN list_append(s.done, s.cur) ELSE s.done END AS c FROM folded)
    SELECT 'doc_' || substr(sha256(doc_id::VARCHAR), 1, 24) AS document_id, unnest(c) AS passage_text,
        generate_subscripts(c, 1)::BIGINT AS passage_order FROM chunks"""
)
def greedy_passages(spark: SparkSession, d: str) -> DataFrame:
    return T.greedy_passages(_paragraph_docs(spark, d))


@query(
    f"""WITH paras AS (SELECT doc_id, pos, trim(p, ' ' || chr(9) || chr(10)) AS p FROM (
        SELECT doc_id, unnest(string_split(t, chr(10) || chr(10))) AS p, generate_subscripts(string_split(t, chr(10) || chr(10)), 1) AS pos
        FROM (SELECT doc_id, {_TEXT} AS t FROM documents)) WHERE trim(p, ' ' || chr(9) || chr(10)) <> ''),
    items AS (SELECT doc_id, list({{'done': CASE WHEN length(p) > 4500 THEN list_transform(range(0, length(p), 4500), lambda i: substr(p, i + 1, 4500)) ELSE []::VARCHAR[] END,
        'cur': CASE WHEN length(p) > 4500 THEN '' ELSE p END}} ORDER BY pos) AS items FROM paras GROUP BY doc_id),
    folded AS (SELECT doc_id, list_reduce(items, lambda s, x: CASE
        WHEN len(x.done) > 0 THEN {{'done': list_concat(CASE WHEN s.cur <> '' THEN list_append(s.done, s.cur) ELSE s.done END, x.done), 'cur': ''}}
        WHEN length(CASE WHEN s.cur <> '' THEN s.cur || chr(10) || chr(10) || x.cur ELSE x.cur END) <= 4500
            THEN {{'done': s.done, 'cur': CASE WHEN s.cur <> '' THEN s.cur || chr(10) || chr(10) || x.cur ELSE x.cur END}}
        ELSE {{'done': CASE WHEN s.cur <> '' THEN list_append(s.done, s.cur) ELSE s.done END, 'cur': x.cur}} END,
        {{'done': []::VARCHAR[], 'cur': ''}}) AS s FROM items),
    chunks AS (SELECT doc_id, CASE WHEN s.cur <> '' THEN list_append(s.done, s.cur) ELSE s.done END AS c FROM folded)
    SELECT 'doc_' || substr(sha256(doc_id::VARCHAR), 1, 24) AS document_id, unnest(c) AS passage_text,
        generate_subscripts(c, 1)::BIGINT AS passage_order FROM chunks"""
)
def fixed_passages(spark: SparkSession, d: str) -> DataFrame:
    return T.fixed_passages(_paragraph_docs(spark, d))


@query(
    """SELECT document_id, passage_order, text_sha256, 'passage_' || substr(sha256(document_id || '|' || coalesce(page_start::VARCHAR, '') || '|'
        || passage_order || '|' || text_sha256), 1, 24) AS passage_id FROM (SELECT document_id, page_start, sha256(passage_text) AS text_sha256,
        row_number() OVER (PARTITION BY document_id ORDER BY passage_order) AS passage_order FROM passages)""",
    "passages",
)
def passage_ids(spark: SparkSession, d: str) -> DataFrame:
    rows = B.passages(spark, d).select("document_id", "page_start", F.col("passage_order").alias("line"), "passage_text")
    return T.assign_passage_ids(rows, [F.col("line")]).select("document_id", "passage_order", "text_sha256", "passage_id")


@query("SELECT event_id, 'event_' || substr(sha256(coalesce(user_id::VARCHAR, '') || '|' || event_type || '|' || event_id || '|' || coalesce(props, '')), 1, 32) AS content_id FROM events")
def content_ids(spark: SparkSession, d: str) -> DataFrame:
    parts = [F.col(c) for c in ("user_id", "event_type", "event_id", "props")]
    return B.table(spark, d, "events").select("event_id", X.content_id("event_", parts, 32).alias("content_id"))


_HITS = ", ".join(
    "{'hits': len(list_filter(w, lambda x: x IN (" + ", ".join(f"'{v}'" for v in words) + f"))), 'language': '{code}'}}" for code, words in X.LANGUAGE_WORDS.items()
)


@query(
    f"""SELECT doc_id, CASE WHEN b.hits = 0 THEN 'UNKNOWN' ELSE b.language END AS detected_language
    FROM (SELECT doc_id, n, list_max([{_HITS}]) AS b FROM (SELECT doc_id, length({_NORM.replace("(t,", "(text,")}) AS n, string_split({norm_sql("text")}, ' ') AS w FROM documents))"""
)
def detected_languages(spark: SparkSession, d: str) -> DataFrame:
    return B.table(spark, d, "documents").select("doc_id", X.detect_language(F.col("text")).alias("detected_language"))


@query(
    """SELECT analysis_id, coalesce(min_by(lang, (-n, lang)) FILTER (lang <> 'UNKNOWN'), 'UNKNOWN') AS dominant_language FROM (
        SELECT analysis_id, CASE WHEN doc_id % 7 = 0 THEN 'UNKNOWN' ELSE lang END AS lang, count(*) AS n FROM passages GROUP BY 1, 2) GROUP BY 1""",
    "passages",
)
def dominant_languages(spark: SparkSession, d: str) -> DataFrame:
    rows = B.passages(spark, d).withColumn("detected_language", F.expr("CASE WHEN doc_id % 7 = 0 THEN 'UNKNOWN' ELSE lang END"))
    return T.dominant_language(rows, ["analysis_id"])


@query(
    """SELECT analysis_id, count(DISTINCT document_id) AS documents, count(DISTINCT CASE WHEN page_start IS NOT NULL THEN document_id || '|' || page_start END) AS pages,
        count(*) AS passages, sum(length(passage_text))::BIGINT AS characters FROM passages GROUP BY 1""",
    "passages",
)
def corpus_profiles(spark: SparkSession, d: str) -> DataFrame:
    return T.corpus_profile(B.passages(spark, d), ["analysis_id"])


@query(
    """SELECT document_id, passage_order, length(passage_text)::BIGINT AS chars, passage_text AS passage_preview,
        CASE WHEN page_start IS NULL THEN 'page unknown' WHEN page_end IS NULL OR page_end = page_start THEN 'p. ' || page_start
        ELSE 'pp. ' || page_start || '–' || page_end END AS page_reference FROM passages""",
    "passages",
)
def passage_previews(spark: SparkSession, d: str) -> DataFrame:
    return T.passage_preview(B.passages(spark, d)).drop("page_start")


_NAMES = "['Directive_2009_18.pdf', 'EU 2024-3017 text.pdf', 'MSC255_code.pdf', 'Res_A.1075_EN.pdf', 'ship_notes']"


@query(
    f"""SELECT doc_id, CASE WHEN n LIKE '%2009\\_18%' ESCAPE '\\' OR n LIKE '%2009-18%' OR n LIKE '%2009 18%' OR n LIKE '%2024\\_3017%' ESCAPE '\\' OR n LIKE '%2024-3017%' OR n LIKE '%2024 3017%' THEN 'EU_LEGISLATION'
            WHEN n LIKE '%msc.255%' OR n LIKE '%msc255%' OR n LIKE '%msc\\_255%' ESCAPE '\\' OR n LIKE '%a.1075%' OR n LIKE '%a1075%' OR n LIKE '%a\\_1075%' ESCAPE '\\' THEN 'IMO_FRAMEWORK' ELSE 'TECHNICAL_REFERENCE' END AS family,
        CASE WHEN n LIKE '%2009%' THEN 'Directive 2009/18/EC' WHEN n LIKE '%2024%' THEN 'Directive (EU) 2024/3017' WHEN n LIKE '%msc%' THEN 'MSC.255(84)' WHEN n LIKE '%a.1075%' THEN 'A.1075(28)' END AS code,
        CASE WHEN n LIKE '%2009%' THEN 'Directive 2009/18/EC' WHEN n LIKE '%2024%' THEN 'Directive (EU) 2024/3017' WHEN n LIKE '%msc%' THEN 'Casualty Investigation Code'
            WHEN n LIKE '%a.1075%' THEN 'IMO Guidelines A.1075(28)' ELSE replace(regexp_replace(f, '\\.[^.]*$', ''), '_', ' ') END AS title
    FROM (SELECT doc_id, f, lower(f) AS n FROM (SELECT doc_id, CASE WHEN doc_id % 5 = 4 THEN source || '_' || 'ship_notes.txt' ELSE {_NAMES}[doc_id % 5 + 1] END AS f FROM documents))"""
)
def classified_references(spark: SparkSession, d: str) -> DataFrame:
    names = F.expr(
        "CASE WHEN doc_id % 5 = 4 THEN concat(source, '_ship_notes.txt') ELSE element_at(array('Directive_2009_18.pdf', 'EU 2024-3017 text.pdf', 'MSC255_code.pdf', 'Res_A.1075_EN.pdf', ''), cast(doc_id % 5 + 1 AS int)) END"
    )
    return B.table(spark, d, "documents").select("doc_id", reference_work(names).alias("r")).select("doc_id", "r.*")


_TREE = """entries AS (SELECT package_id, sha256(filename || '|' || sha256) AS h FROM docs),
    leaves AS (SELECT package_id, substr(h, 1, 4) AS bucket, count(*) AS files, sha256(string_agg(h, chr(10) ORDER BY h)) AS h FROM entries GROUP BY 1, 2),
    branches AS (SELECT package_id, substr(bucket, 1, 2) AS bucket, sum(files) AS files, sha256(string_agg(h, chr(10) ORDER BY bucket)) AS h FROM leaves GROUP BY 1, 2),
    roots AS (SELECT package_id, sum(files)::BIGINT AS files, sha256(string_agg(h, chr(10) ORDER BY bucket)) AS h FROM branches GROUP BY 1)"""


@query(f"WITH {_TREE} SELECT package_id, bucket, files, h AS digest FROM leaves", "docs")
def snapshot_buckets(spark: SparkSession, d: str) -> DataFrame:
    return T.snapshot_buckets(B.docs(spark, d), ["package_id"], [F.col("filename"), F.col("sha256")])


@query(
    """WITH entries AS (SELECT package_id, doc_id, sha256(filename || '|' || sha256) AS h, sha256(filename || '|' || CASE WHEN doc_id % 90 = 1 THEN '' ELSE sha256 END) AS n FROM docs)
    SELECT DISTINCT package_id, bucket FROM (SELECT package_id, substr(h, 1, 4) AS bucket FROM entries WHERE doc_id % 90 IN (1, 2) UNION ALL SELECT package_id, substr(n, 1, 4) FROM entries WHERE doc_id % 90 = 1)""",
    "docs",
)
def changed_buckets(spark: SparkSession, d: str) -> DataFrame:
    """A later snapshot: some files have other content, some are gone."""
    docs, parts = B.docs(spark, d), [F.col("filename"), F.col("sha256")]
    later = docs.where("doc_id % 90 <> 2").withColumn("sha256", F.expr("CASE WHEN doc_id % 90 = 1 THEN '' ELSE sha256 END"))
    return T.changed_buckets(T.snapshot_buckets(docs, ["package_id"], parts), T.snapshot_buckets(later, ["package_id"], parts), ["package_id"])


@query(f"WITH {_TREE} SELECT package_id, files, 'corpus_snapshot_' || substr(sha256(files || '|' || h), 1, 32) AS corpus_snapshot_id FROM roots", "docs")
def corpus_snapshots(spark: SparkSession, d: str) -> DataFrame:
    return T.corpus_snapshot_id(B.docs(spark, d), ["package_id"], [F.col("filename"), F.col("sha256")])


@query("SELECT conv_id, turn, trim(text, ' ' || chr(10) || chr(9) || chr(13)) || chr(10) || role AS extracted FROM conversations")
def json_texts(spark: SparkSession, d: str) -> DataFrame:
    turn = F.struct(F.struct(F.col("text")).alias("content"), F.array(F.struct(F.col("role").alias("label"), F.col("turn").alias("n"))).alias("segments"), F.col("role").alias("speaker"))
    return B.table(spark, d, "conversations").select("conv_id", "turn", json_text(F.to_json(turn)).alias("extracted"))


@query(
    """SELECT audio_source_id, duration_seconds, segment_index, start_seconds, end_seconds, speaker_id, transcript_text,
        'segment_' || substr(sha256(audio_source_id || '|model|' || segment_index || '|' || sha256(transcript_text)), 1, 24) AS transcript_segment_id
    FROM (SELECT audio_source_id, (max(segment_index) OVER w)::DOUBLE AS duration_seconds, row_number() OVER (PARTITION BY audio_source_id ORDER BY segment_index) - 1 AS segment_index,
        start_seconds, end_seconds, speaker_id, transcript_text FROM segments WINDOW w AS (PARTITION BY audio_source_id))""",
    "segments",
)
def flattened_transcripts(spark: SparkSession, d: str) -> DataFrame:
    part = F.struct("segment_index", F.col("start_seconds").alias("start"), F.col("end_seconds").alias("end"), "speaker_id", F.col("transcript_text").alias("text"))
    payload = F.to_json(F.struct(F.struct(F.max("segment_index").alias("duration_seconds"), F.array_sort(F.collect_list(part)).alias("segments")).alias("response")))
    # One recording is one file and therefore one row.
    files = B.segments(spark, d).groupBy("audio_source_id").agg(payload.alias("payload"))
    rows = flatten_transcript(files).withColumn("model", F.lit("model"))
    return transcript_segments(rows, "audio_source_id", "model").drop("model", "segment_text_sha256")


# --- privacy ----------------------------------------------------------------------------------------------

_START, _END = r"^|[^\pL\pN_]", r"$|[^\pL\pN_]"


def _sql_pattern(pattern: str) -> str:
    """A pattern of the operator for an engine without look-around: the neighbours that it tests are captured instead."""
    flags = "(?i)" if pattern.startswith("(?i") else ""
    body = re.sub(r"^\(\?[iU]+\)", "", pattern)
    alone = body.removeprefix(r"(?<!\w)").removesuffix(r"(?!\w)")
    return f"{flags}({_START})({alone})({_END})" if alone != body else f"{flags}()({body})()"


_SQL_PATTERNS = {c: "(?i)" + re.sub(r"^\(\?[iU]+\)", "", identifiers.PATTERNS[c]) for c in ("EMAIL", "IMO", "MMSI", "PERSONAL_ID")}


def _spans_sql(patterns: dict[str, str]) -> str:
    """CTEs up to ``spans``: non-overlapping matches of a text with positions, by start, longest first, then category."""
    found = " UNION ALL ".join(
        f"SELECT document_id, '{c}' AS category, string_split_regex(text, '{p}') AS gaps, regexp_extract_all(text, '{p}') AS whole, regexp_extract_all(text, '{p}', 1) AS before, regexp_extract_all(text, '{p}', 2) AS hits FROM screened"
        for c, p in patterns.items()
    )
    return f"""found AS ({found}),
    placed AS (SELECT document_id, category, hit AS original, (sum(length(gap)) OVER w + sum(length(all_)) OVER w - length(all_) + length(pre))::INT AS start
        FROM (SELECT document_id, category, unnest(gaps[:len(whole)]) AS gap, unnest(whole) AS all_, unnest(before) AS pre, unnest(hits) AS hit, unnest(range(len(whole))) AS i FROM found)
        WINDOW w AS (PARTITION BY document_id, category ORDER BY i)),
    ordered AS (SELECT *, start + length(original) AS end_, row_number() OVER (PARTITION BY document_id ORDER BY start, -length(original), category) AS rn FROM placed),
    walk AS (SELECT document_id, rn, end_ AS until, TRUE AS kept FROM ordered WHERE rn = 1 UNION ALL
        SELECT o.document_id, o.rn, CASE WHEN o.start < w.until THEN w.until ELSE o.end_ END, o.start >= w.until FROM walk w JOIN ordered o ON o.document_id = w.document_id AND o.rn = w.rn + 1),
    spans AS (SELECT o.* FROM ordered o JOIN walk w USING (document_id, rn) WHERE w.kept)"""


@query(
    "SELECT document_id, category, count(*) AS matches FROM ("
    + " UNION ALL ".join(f"SELECT document_id, '{c}' AS category, unnest(regexp_extract_all(text, '{p}')) AS hit FROM screened" for c, p in _SQL_PATTERNS.items())
    + " UNION ALL SELECT document_id, 'VESSEL', unnest(regexp_extract_all(text, '(?i)master')) FROM screened) GROUP BY 1, 2",
    "screened",
)
def identifier_counts(spark: SparkSession, d: str) -> DataFrame:
    spans = P.find_identifiers(
        B.screened(spark, d).select("document_id", "text"), "text", [*_SQL_PATTERNS, "VESSEL"], {"VESSEL": ["master"]}
    )
    return spans.groupBy("document_id", "category").agg(F.count(F.lit(1)).alias("matches"))


_ALL_KINDS = ("EMAIL", "PHONE", "IMO", "MMSI", "PERSONAL_ID", "CASE_REFERENCE")


@query(
    f"""WITH RECURSIVE {_spans_sql({c: _sql_pattern(identifiers.PATTERNS[c]) for c in _ALL_KINDS})}
    SELECT document_id, start::INT AS start, end_::INT AS end, category, original, 'RULE' AS detected_by FROM spans""".replace(" AS end,", ' AS "end",'),
    "screened",
)
def identifier_spans(spark: SparkSession, d: str) -> DataFrame:
    spans = P.find_identifiers(B.screened(spark, d).select("document_id", "text"), "text", _ALL_KINDS)
    return P.resolve_overlaps(spans, ["document_id"])


@query(
    r"""WITH hits AS (SELECT document_id, text, unnest(regexp_extract_all(text, '(?i)\b[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}\b')) AS hit,
            generate_subscripts(regexp_extract_all(text, '(?i)\b[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}\b'), 1) AS pos FROM screened),
    ids AS (SELECT document_id, lower(hit) AS k, row_number() OVER (PARTITION BY document_id ORDER BY min(pos)) AS n FROM hits GROUP BY 1, 2),
    gaps AS (SELECT document_id, string_split_regex(text, '(?i)\b[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}\b') AS g FROM screened),
    parts AS (SELECT h.document_id, list('EMAIL_' || lpad(i.n::VARCHAR, 3, '0') ORDER BY h.pos) AS t FROM hits h JOIN ids i ON h.document_id = i.document_id AND lower(h.hit) = i.k GROUP BY 1)
    SELECT g.document_id, coalesce(len(t), 0)::BIGINT AS replaced,
        array_to_string(list_transform(g.g, lambda x, i: x || coalesce(t[i], '')), '') AS pseudonymised_text
    FROM gaps g LEFT JOIN parts p ON g.document_id = p.document_id""",
    "screened",
)
def pseudonymised_emails(spark: SparkSession, d: str) -> DataFrame:
    named = P.pseudonymise(B.screened(spark, d).select("document_id", "text"), "text", ["EMAIL"])
    return named.select("document_id", F.size("replacements").cast("long").alias("replaced"), "pseudonymised_text")


def _named_sql(patterns: dict[str, str]) -> str:
    """Spans with their pseudonym: numbered per document and category by the first occurrence of the lower-cased text."""
    return f"""{_spans_sql(patterns)},
    identities AS (SELECT document_id, category, lower(original) AS k, row_number() OVER (PARTITION BY document_id, category ORDER BY min(start)) AS n FROM spans GROUP BY 1, 2, 3),
    named AS (SELECT s.*, s.category || '_' || CASE WHEN n < 1000 THEN lpad(n::VARCHAR, 3, '0') ELSE n::VARCHAR END AS pseudonym
        FROM spans s JOIN identities i ON i.document_id = s.document_id AND i.category = s.category AND i.k = lower(s.original))"""


_REPLACED_KINDS = ("EMAIL", "PHONE", "PERSONAL_ID", "IMO", "MMSI")


@query(
    f"""WITH RECURSIVE {_named_sql({c: _sql_pattern(identifiers.PATTERNS[c]) for c in _REPLACED_KINDS} | {"PERSON": "(?i)()(master)()"})},
    parts AS (SELECT n.document_id, n.start, n.end_, n.pseudonym, substr(s.text, coalesce(lag(n.end_) OVER w, 0) + 1, n.start - coalesce(lag(n.end_) OVER w, 0)) AS gap
        FROM named n JOIN screened s ON s.document_id = n.document_id WINDOW w AS (PARTITION BY n.document_id ORDER BY n.start)),
    joined AS (SELECT document_id, count(*) AS replaced, string_agg(gap || pseudonym, '' ORDER BY start) AS head, max(end_) AS last FROM parts GROUP BY 1)
    SELECT s.document_id, coalesce(replaced, 0)::BIGINT AS replaced, coalesce(head || substr(s.text, last + 1), s.text) AS pseudonymised_text FROM screened s LEFT JOIN joined j ON s.document_id = j.document_id""",
    "screened",
)
def pseudonymised_documents(spark: SparkSession, d: str) -> DataFrame:
    named = P.pseudonymise(B.screened(spark, d).select("document_id", "text"), "text", ["PERSON", *_REPLACED_KINDS], {"PERSON": ["master"]})
    return named.select("document_id", F.size("replacements").cast("long").alias("replaced"), "pseudonymised_text")


@query(
    f"""WITH RECURSIVE {_named_sql({c: _sql_pattern(identifiers.PATTERNS[c]) for c in ("EMAIL", "PERSONAL_ID", "IMO", "MMSI")})}
    SELECT document_id, category, pseudonym, arg_max(original, start) AS original, count(*) AS occurrences FROM named GROUP BY 1, 2, 3""",
    "screened",
)
def pseudonym_mappings(spark: SparkSession, d: str) -> DataFrame:
    named = P.pseudonymise(B.screened(spark, d).select("document_id", "text"), "text", ["EMAIL", "PERSONAL_ID", "IMO", "MMSI"])
    return P.pseudonym_mapping(named, ["document_id"])


_RED = r"regexp_replace(regexp_replace({c}, '(?i)\b[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{{2,}}\b', '[REDACTED_EMAIL]', 'g'), '(?i)\b(?:passport|national\s+id|identity\s+card|id\s+number)\s*[:#-]?\s*[A-Z0-9-]{{4,}}\b', '[REDACTED_PERSONAL_ID]', 'g')"


def _redacted_sql(column: str) -> str:
    """Tags in their order. A number whose neighbour the one before it has taken is found in a second pass."""
    text = column
    for pattern, tag in identifiers.REDACTIONS:
        for _ in range(2 if "(?<!" in pattern else 1):
            text = f"regexp_replace({text}, '{_sql_pattern(pattern)}', '\\1{tag}\\3', 'g')"
    return text


@query(
    f"""SELECT document_id, f AS filename, t AS text, ((f <> filename)::INT + (t <> text)::INT)::BIGINT AS redaction_count
    FROM (SELECT document_id, filename, text, {_redacted_sql("filename")} AS f, {_redacted_sql("text")} AS t FROM screened)""",
    "screened",
)
def redacted_documents(spark: SparkSession, d: str) -> DataFrame:
    rows = B.screened(spark, d).select("document_id", "filename", "text")
    return P.redact_columns(rows, ["filename", "text"])


def _label_fields(spark: SparkSession, d: str) -> DataFrame:
    return B.screened(spark, d).select("analysis_id", "document_id", F.translate("text", "0123456789", "xxxxxxxxxx").alias("text"), "filename")


@query(
    "SELECT analysis_id, sum(n)::BIGINT AS redaction_count, CASE WHEN sum(n) > 0 THEN 'PASSED_WITH_AUTOMATIC_REDACTION' ELSE 'PASSED' END AS privacy_validation_status FROM ("
    + "SELECT analysis_id, (" + _RED.format(c="t") + " <> t)::INT + (" + _RED.format(c="filename") + " <> filename)::INT AS n FROM (SELECT analysis_id, filename, translate(text, '0123456789', 'xxxxxxxxxx') AS t FROM screened)) GROUP BY 1",
    "screened",
)
def redaction_statuses(spark: SparkSession, d: str) -> DataFrame:
    """Redaction over texts whose digits were masked, so that no phone pattern applies and SQL can follow."""
    return P.redaction_status(P.redact_columns(_label_fields(spark, d), ["text", "filename"]), ["analysis_id"])


def _counts_sql(table: str, column: str, rules) -> str:
    return " UNION ALL ".join(
        f"SELECT document_id, '{rule}' AS rule_id, '{label}' AS label, len(regexp_extract_all({column}, '(?i){pattern.replace(chr(39), chr(39) * 2)}'))::BIGINT AS match_count FROM {table}"
        for rule, label, pattern in rules
    )


@query(f"SELECT * FROM ({_counts_sql('screened', 'text', TEXT_RULES)}) WHERE match_count > 0", "screened")
def prescreened_texts(spark: SparkSession, d: str) -> DataFrame:
    return P.prescreen_text(B.screened(spark, d), ["document_id"])


def _titles(spark: SparkSession, d: str) -> DataFrame:
    return B.docs(spark, d).withColumn(
        "title",
        F.expr("concat(element_at(array('witness_statement_', 'vdr-bridge_audio', 'draft report ', 'patient_history', 'manual'), cast(doc_id % 5 + 1 AS int)), filename)"),
    )


_TITLES = "(SELECT document_id, ['witness_statement_', 'vdr-bridge_audio', 'draft report ', 'patient_history', 'manual'][doc_id % 5 + 1] || filename AS title FROM docs)"


@query(f"SELECT * FROM ({_counts_sql(_TITLES, 'title', METADATA_RULES)}) WHERE match_count > 0", "docs")
def prescreened_titles(spark: SparkSession, d: str) -> DataFrame:
    return P.prescreen_metadata(_titles(spark, d), ["document_id"], "title")


@query(
    f"""SELECT document_id, rule_id, label, sum(match_count)::BIGINT AS match_count, 'D' AS required_class FROM (
        {_counts_sql('screened', 'text', TEXT_RULES)} UNION ALL {_counts_sql(_TITLES, 'title', METADATA_RULES)} UNION ALL {_counts_sql('docs', 'text', TEXT_RULES)})
    WHERE match_count > 0 GROUP BY 1, 2, 3""",
    "docs", "screened",
)
def combined_findings(spark: SparkSession, d: str) -> DataFrame:
    return P.combine_findings(
        ["document_id"], P.prescreen_text(B.screened(spark, d), ["document_id"]), P.prescreen_metadata(_titles(spark, d), ["document_id"], "title"),
        P.prescreen_text(B.docs(spark, d), ["document_id"]),
    )


def gate_inputs(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """One analysis per document: class, input mode, route and the findings of the screened text."""
    rows = B.screened(spark, d).withColumn("analysis_id", F.expr("concat('single_', doc_id)"))
    analyses = rows.selectExpr(
        "analysis_id", "information_class", "CASE WHEN doc_id % 10 = 9 THEN 'DIRECT_TEXT' ELSE 'DOCUMENTS' END AS input_mode"
    )
    documents = rows.selectExpr(
        "analysis_id", "document_id", "source_managed_by", "CASE WHEN doc_id % 3 = 0 THEN 'LOCAL_FALLBACK' ELSE 'CANONICAL' END AS route", "doc_id % 11 <> 0 AS has_text"
    )
    return analyses, documents, P.prescreen_text(rows, ["analysis_id", "document_id"])


GATE_SQL = f"""found AS (SELECT document_id, count(*) AS rules FROM ({_counts_sql('screened', 'text', TEXT_RULES)}) WHERE match_count > 0 GROUP BY 1),
    facts AS (SELECT doc_id, 'single_' || doc_id AS analysis_id, information_class, CASE WHEN doc_id % 10 = 9 THEN 'DIRECT_TEXT' ELSE 'DOCUMENTS' END AS input_mode,
        source_managed_by = 'CANONICAL' AS canonical, (doc_id % 10 = 9 OR doc_id % 3 = 0) AND doc_id % 11 <> 0 AS is_screened, rules IS NOT NULL AS hit
        FROM screened LEFT JOIN found USING (document_id)),
    gate AS (SELECT doc_id, analysis_id, information_class, input_mode, CASE WHEN information_class = 'B' AND input_mode = 'DOCUMENTS' AND canonical THEN 'PUBLISHED_CANONICAL_CLASS_B_EXEMPT'
        WHEN NOT is_screened THEN 'NO_SCREENABLE_RAW_CONTENT' WHEN information_class = 'D' AND hit THEN 'DECLARED_D_WITH_STRONG_INDICATORS'
        WHEN information_class = 'D' THEN 'DECLARED_D_NO_STRONG_INDICATORS' WHEN hit THEN 'REQUIRES_CLASS_D' ELSE 'PASSED_NO_STRONG_D_INDICATOR' END AS prescreen_status FROM facts)"""


@query(
    f"""WITH {GATE_SQL} SELECT analysis_id, information_class, input_mode, prescreen_status,
        CASE WHEN prescreen_status IN ('REQUIRES_CLASS_D', 'DECLARED_D_WITH_STRONG_INDICATORS') THEN 'D' END AS required_class FROM gate""",
    "screened",
)
def prescreen_gates(spark: SparkSession, d: str) -> DataFrame:
    return P.prescreen_gate(*gate_inputs(spark, d))


@query(
    f"""WITH {GATE_SQL} SELECT document_id, passage_id FROM passages WHERE doc_id NOT IN (SELECT doc_id FROM gate WHERE prescreen_status = 'REQUIRES_CLASS_D')""",
    "screened", "passages",
)
def unblocked_passages(spark: SparkSession, d: str) -> DataFrame:
    rows = B.passages(spark, d).withColumn("analysis_id", F.expr("concat('single_', doc_id)"))
    return P.unblocked_passages(rows, P.prescreen_gate(*gate_inputs(spark, d))).select("document_id", "passage_id")


@query(
    """SELECT doc_id, s AS source_class, p AS processing_class, CASE WHEN s NOT IN ('A', 'B', 'C', 'D') THEN 'UNSUPPORTED_SOURCE_CLASS'
        WHEN NOT (s = p OR (s = 'D' AND p = 'C')) THEN 'PROCESSING_CLASS_NOT_ALLOWED' END AS violation
    FROM (SELECT doc_id, ['A', 'B', 'C', 'D', 'E'][doc_id % 5 + 1] AS s, ['A', 'B', 'C', 'D'][(doc_id // 5) % 4 + 1] AS p FROM documents)"""
)
def derivative_policies(spark: SparkSession, d: str) -> DataFrame:
    rows = B.table(spark, d, "documents").selectExpr(
        "doc_id", "element_at(array('A', 'B', 'C', 'D', 'E'), cast(doc_id % 5 + 1 AS int)) AS source_class",
        "element_at(array('A', 'B', 'C', 'D'), cast((doc_id div 5) % 4 + 1 AS int)) AS processing_class",
    )
    return P.derivative_policy(rows, "source_class", "processing_class")


_CONTRACT = {
    "EXEMPTION_ON_OTHER_CLASS": "exempt AND cls <> 'B'",
    "EXEMPTION_WITH_OTHER_OWNER": "exempt AND owner <> 'CANONICAL'",
    "ESCALATION_OF_CLASS_D": "blocked AND cls = 'D'",
    "ESCALATION_WITHOUT_REQUIRED_CLASS": "blocked AND doc_id % 13 = 0",
    "ESCALATION_DID_NOT_STOP": "blocked AND st <> 'FAILED'",
    "BLOCKED_ANALYSIS_HAS_PASSAGES": "blocked AND has_passages",
    "BLOCKED_ANALYSIS_HAS_MODEL_RUN": "blocked AND doc_id % 5 = 0",
    "BLOCKED_TEXT_NOT_PURGED": "blocked AND doc_id % 10 = 9 AND doc_id % 4 = 1",
    "BLOCKED_TEXT_WRONG_RETENTION": "blocked AND doc_id % 10 = 9 AND doc_id % 8 = 1",
    "CLASS_D_WITH_UNEXPECTED_STATUS": "cls = 'D' AND ps NOT IN ('DECLARED_D_WITH_STRONG_INDICATORS', 'DECLARED_D_NO_STRONG_INDICATORS', 'NO_SCREENABLE_RAW_CONTENT')",
    "ACTIVE_ANALYSIS_NOT_SCREENED": "cls IN ('A', 'C') AND st = 'COMPLETED' AND ps NOT IN ('PASSED_NO_STRONG_D_INDICATOR', 'NO_SCREENABLE_RAW_CONTENT')",
}
_STATUSES = ("PUBLISHED_CANONICAL_CLASS_B_EXEMPT", "REQUIRES_CLASS_D", "PASSED_NO_STRONG_D_INDICATOR", "DECLARED_D_NO_STRONG_INDICATORS", "NO_SCREENABLE_RAW_CONTENT")


@query(
    "SELECT analysis_id, rule FROM (SELECT 'single_' || doc_id AS analysis_id, unnest(list_filter(["
    + ", ".join(f"CASE WHEN {c} THEN '{r}' END" for r, c in _CONTRACT.items())
    + "], lambda x: x IS NOT NULL)) AS rule FROM (SELECT *, ps = 'PUBLISHED_CANONICAL_CLASS_B_EXEMPT' AS exempt, ps = 'REQUIRES_CLASS_D' AS blocked FROM ("
    + "SELECT doc_id, information_class AS cls, source_managed_by AS owner, ['" + "', '".join(_STATUSES) + "'][(doc_id // 4) % 5 + 1] AS ps,"
    + " CASE WHEN doc_id % 3 = 0 THEN 'COMPLETED' ELSE 'FAILED' END AS st, doc_id IN (SELECT doc_id FROM passages) AS has_passages FROM docs)))",
    "docs", "passages",
)
def prescreen_contract(spark: SparkSession, d: str) -> DataFrame:
    rows = B.docs(spark, d).withColumn("analysis_id", F.expr("concat('single_', doc_id)"))
    statuses = "array('" + "', '".join(_STATUSES) + "')"
    analyses = rows.selectExpr(
        "analysis_id", "information_class", "CASE WHEN doc_id % 10 = 9 THEN 'DIRECT_TEXT' ELSE 'DOCUMENTS' END AS input_mode",
        f"element_at({statuses}, cast((doc_id div 4) % 5 + 1 AS int)) AS prescreen_status",
        "CASE WHEN doc_id % 13 <> 0 THEN 'D' END AS required_class",
        "CASE WHEN doc_id % 3 = 0 THEN 'COMPLETED' ELSE 'FAILED' END AS status",
        "'CLASSIFICATION_PRESCREEN_BLOCKED' AS processing_stage",
        "CASE WHEN doc_id % 4 = 1 THEN 'cipher' ELSE '' END AS encrypted_text",
        "CASE WHEN doc_id % 8 = 1 THEN 'KEPT' ELSE 'ENCRYPTED_PAYLOAD_PURGED_AFTER_PRESCREEN' END AS text_retention_status",
    )
    documents = rows.select("analysis_id", "source_managed_by")
    found = B.passages(spark, d).select(F.expr("concat('single_', doc_id)").alias("analysis_id"))
    runs = rows.selectExpr("CASE WHEN doc_id % 5 = 0 THEN analysis_id ELSE concat('other_', doc_id) END AS analysis_id")
    return P.prescreen_contract_violations(analyses, documents, found, runs)
