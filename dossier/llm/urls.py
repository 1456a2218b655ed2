"""URL rules by hashed expressions.

A rule is a host and a path prefix, such as ``example.net/en/``; it fits its host and all subdomains when the url's path
starts with the rule's path. Each distinct (host, path) is expanded into its host suffixes combined with its path
prefixes that end in a slash, up to the labels and slashes of the longest rules. Expressions meet the rules on the first ``PREFIX_HEX`` hex digits of their SHA-256, the
full digests are compared next, and rules whose path goes on after its last slash are confirmed on the path itself.
Of the rules that fit the longest wins; of equally long ones a block wins over an allow.

Only (host, path) pairs are expanded and shuffled, never pages. Pages then meet the few judged pairs; a pair that many
pages share is a skewed key of a sort-merge join, which adaptive execution splits. Rules are broadcast only when their
measured size allows it, and joined by hash prefix otherwise.

A url that is null or has no ``://`` has an empty host and path. No rule fits an empty host; where none fits, the verdict
is allow and the rule null. Each row is judged by itself, so repeated rows and null ids come out as they went in, and
further columns are kept. Null rules are ignored, an empty rule table allows everything.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dossier.plans.sizing import checked_broadcast

PREFIX_HEX = 8


def host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A to Z lower-cased; empty without ``://``."""
    found = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(F.coalesce(found, F.lit("")), string.ascii_uppercase, string.ascii_lowercase)


def path(url: Column) -> Column:
    """What follows the host, up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _host_suffixes(c: Column, most: int) -> Column:
    """Suffixes of up to ``most`` labels."""
    labels = F.split(c, r"\.", -1)
    first = F.greatest(F.lit(1), F.size(labels) - most + 1)
    return F.transform(F.sequence(first, F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))


def _path_prefixes(c: Column, most: int) -> Column:
    """Prefixes of up to ``most`` slashes that end in a slash: the first parts, joined again."""
    parts = F.split(c, "/", -1)
    ends = F.filter(F.sequence(F.lit(1), F.least(F.size(parts), F.lit(most))), lambda i: i < F.size(parts))
    return F.transform(ends, lambda i: F.concat(F.array_join(F.slice(parts, F.lit(1), i), "/"), F.lit("/")))


def _rules(rules: DataFrame) -> DataFrame:
    at = F.instr("rule", "/")
    split = rules.where(F.col("rule").isNotNull() & F.col("verdict").isin("allow", "block") & (at > 1)).select(
        "rule", "verdict", F.lower(F.substring("rule", F.lit(1), at - 1)).alias("_rule_host"), F.expr("substring(rule, instr(rule, '/'))").alias("_rule_path")
    )
    anchor = F.regexp_extract("_rule_path", r"(?s)^(.*/)", 1)
    return _digests(split, F.concat(F.col("_rule_host"), F.lit(" "), anchor)).distinct()


def _digests(df: DataFrame, expression: Column) -> DataFrame:
    """``df`` with the digest of an expression and its short prefix."""
    return df.withColumn("_digest", F.sha2(expression, 256)).withColumn("_short", F.substring("_digest", 1, PREFIX_HEX))


def judged(pages: DataFrame, rules: DataFrame, url: str = "url") -> DataFrame:
    """``pages`` with host, path, rule and verdict. ``rules`` holds (rule, verdict)."""
    parsed = pages.drop("host", "path", "rule", "verdict").withColumns({"host": host(F.col(url)), "path": path(F.col(url))})
    pairs = parsed.select("host", "path").where((F.col("host") != "") & (F.col("path") != "")).distinct()
    known = _rules(rules)
    # no rule has more labels or slashes, so longer expressions cannot meet one
    most = known.agg(F.max(F.size(F.split("_rule_host", r"\.", -1))).alias("labels"), F.max(F.size(F.split("_rule_path", "/", -1))).alias("parts")).first()
    expanded = pairs.withColumn("_suffix", F.explode(_host_suffixes(F.col("host"), most["labels"] or 1))).withColumn(
        "_start", F.explode(_path_prefixes(F.col("path"), most["parts"] or 1))
    )
    expressions = _digests(expanded, F.concat("_suffix", F.lit(" "), "_start")).drop("_suffix", "_start")
    known = checked_broadcast(known).alias("r")
    fits = (F.col("e._digest") == F.col("r._digest")) & F.startswith("e.path", "r._rule_path")
    met = expressions.alias("e").join(known, F.col("e._short") == F.col("r._short")).where(fits)
    order = F.struct(F.length("r.rule").alias("n"), (F.col("r.verdict") == "block").alias("b"), F.col("r.rule"), F.col("r.verdict"))
    best = met.groupBy("e.host", "e.path").agg(F.max(order).alias("_best"))
    judgements = best.select("host", "path", F.col("_best.rule").alias("rule"), F.col("_best.verdict").alias("verdict"))
    return parsed.join(judgements, ["host", "path"], "left").withColumn("verdict", F.coalesce("verdict", F.lit("allow")))
