"""Which texts contain which phrases, as an equi-join instead of a comparison of all pairs.

A text that contains a phrase of three or more words holds the words inside it whole; any text that contains a phrase holds all its
short runs of characters (grams). Each phrase is anchored at one of these: the inner word, or the gram, that is rarest in the
texts by measure. Phrases without inner words are looked for one after the other where they are few, which costs a text less than its
grams. Texts meet the phrases at their anchors, each phrase at most once, and are verified where they lie: no text is
shuffled, read again or told apart from repeated pairs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dossier.plans.durable import durable
from dossier.plans.sizing import checked_broadcast

#: Lengths of grams; a phrase is anchored by grams of the longest that it holds.
GRAMS = (1, 2, 4)
#: Up to so many phrases without inner words are looked for directly; the pairs found are the same.
FEW_PHRASES = 400
#: Anchors are rated on this share of the texts. It decides which anchor is taken, never what is found.
RATED = 1 / 16
WORD, WHOLE = 0, -1


def containing(texts: DataFrame, text: str, phrases: DataFrame, phrase: str, few: int = FEW_PHRASES) -> DataFrame:
    """Rows of ``texts`` joined to the distinct ``phrases`` that occur in them; an empty phrase occurs nowhere."""
    inner = F.filter(_inner(F.split(F.col(phrase), " ")), lambda w: w != "")
    needles = phrases.select(phrase).where(F.length(phrase) > 0).distinct().withColumn("_inner", inner)
    short = [r[0] for r in needles.where(F.size("_inner") == 0).select(phrase).limit(few + 1).collect()]
    own = F.when(F.size("_inner") > 0, _anchors(WORD, F.col("_inner")))
    if len(short) <= few:
        own = own.otherwise(_anchors(WHOLE, F.array(phrase)))
    else:
        for size in reversed(GRAMS):
            own = own.when(F.length(phrase) >= size, _anchors(size, _grams(F.col(phrase), size)))
    offered = durable(needles.select(phrase, F.explode(own).alias("_anchor")))
    # as many kinds as there are in GRAMS, and two
    kinds = {r["kind"] for r in offered.select("_anchor.kind").distinct().collect()}
    parts = {WORD: F.split(F.col(text), " ")} | {size: _grams(F.col(text), size) for size in GRAMS}
    held = [_anchors(kind, parts[kind]) for kind in sorted(kinds - {WHOLE})]
    whole = [_anchors(WHOLE, F.filter(F.array(*map(F.lit, sorted(short))), lambda p: F.contains(F.col(text), p)))] if WHOLE in kinds else []
    several = offered.where(F.col("_anchor.kind") != WHOLE)
    rated = offered.withColumn("times", F.lit(0).cast("long"))
    if held:
        wanted = checked_broadcast(several.select("_anchor").distinct())
        some = texts.sample(RATED, seed=7).select(F.explode(F.concat(*held)).alias("_anchor"))
        times = some.join(wanted, "_anchor").groupBy("_anchor").agg(F.count(F.lit(1)).alias("times"))
        rated = offered.join(times, "_anchor", "left").withColumn("times", F.coalesce("times", F.lit(0)))
    # of equally rare anchors the longest tells most
    best = F.struct("times", (-F.length("_anchor.part")).alias("length"), "_anchor")
    rarest = checked_broadcast(rated.groupBy(phrase).agg(F.min(best)["_anchor"].alias("_anchor")))
    # without a phrase nothing is held
    spread = F.explode(F.concat(*held, *whole) if held or whole else _anchors(WORD, F.array().cast("array<string>")))
    return texts.withColumn("_anchor", spread).join(rarest, "_anchor").where(F.contains(F.col(text), F.col(phrase))).drop("_anchor")


def _anchors(kind: int, parts: Column) -> Column:
    """Distinct parts of one kind: words, whole phrases or grams of a length."""
    return F.transform(F.array_distinct(parts), lambda a: F.struct(F.lit(kind).alias("kind"), a.alias("part")))


def _inner(words: Column) -> Column:
    return F.slice(words, F.lit(2), F.greatest(F.size(words) - 2, F.lit(0)))


def _grams(c: Column, size: int) -> Column:
    """Every part of ``size`` characters of a text, found in one walk; a shorter text has none."""
    return F.regexp_extract_all(c, F.lit(f"(?s)(?=(.{{{size}}}))"), F.lit(1))
