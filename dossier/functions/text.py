"""Text expressions: every function takes and returns columns and stays inside the JVM."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Stop words of taxonomy matching.
TAXONOMY_STOP_WORDS = (
    "a", "an", "and", "are", "as", "at", "be", "by", "for", "from", "has", "have", "in", "into", "is", "of",
    "on", "or", "that", "the", "this", "to", "was", "were", "with",
)
# Stop words of case similarity.
CASE_STOP_WORDS = (
    "and", "the", "for", "from", "with", "that", "this", "into", "was", "were", "are", "has", "had", "have",
    "after", "before", "during", "vessel", "ship", "event", "finding", "factor", "safety", "system",
)
# Stop words of alert relevance.
ALERT_STOP_WORDS = (
    "with", "from", "that", "this", "were", "into", "after", "before", "during", "vessel", "ship", "event",
    "finding", "factor", "safety", "system",
)

PASSAGE_TARGET = 2400
PASSAGE_LIMIT = 3600
FIXED_LIMIT = 4500

_WORD_GAP = r"[^\p{L}\p{N}_]+"


def strip(c: Column) -> Column:
    """Remove white space of every kind at both ends."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def clean(c: Column) -> Column:
    """NULL becomes an empty string; ends are stripped."""
    return F.trim(F.coalesce(c.cast("string"), F.lit("")))


def normalise_text(c: Column) -> Column:
    """Unix line ends, single spaces, no indentation, at most one blank line, stripped ends."""
    t = F.regexp_replace(F.coalesce(c, F.lit("")), r"\r\n?", "\n")
    t = F.regexp_replace(t, r"[ \t]+", " ")
    t = F.regexp_replace(t, r"\n[ \t]+", "\n")
    t = F.regexp_replace(t, r"\n{3,}", "\n\n")
    return strip(t)


def squeeze(c: Column) -> Column:
    """Every run of white space becomes one space."""
    return F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", " "))


def normalise_label(c: Column) -> Column:
    """Lower case words separated by single spaces; letters of all scripts are kept."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), _WORD_GAP, " "))


def normalise_label_ascii(c: Column) -> Column:
    """Like ``normalise_label`` but only a-z and 0-9 are kept."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"[^a-z0-9]+", " "))


def tokens(c: Column, min_len: int = 3, stop: Iterable[str] = TAXONOMY_STOP_WORDS) -> Column:
    """Distinct words of at least ``min_len`` characters without stop words."""
    return label_tokens(normalise_label(c), min_len, stop)


def label_tokens(label: Column, min_len: int = 3, stop: Iterable[str] = TAXONOMY_STOP_WORDS) -> Column:
    """``tokens`` of a text that is already a normalised label."""
    words = F.array_distinct(F.filter(F.split(label, " "), lambda w: F.length(w) >= min_len))
    listed = [F.lit(s) for s in stop]
    return F.array_except(words, F.array(*listed)) if listed else words


def page_label(start: Column, end: Column) -> Column:
    return (
        F.when(start.isNull(), F.lit("page unknown"))
        .when(end.isNull() | (end == start), F.format_string("p. %d", start))
        .otherwise(F.format_string("pp. %d–%d", start, end))
    )


def paragraphs(c: Column) -> Column:
    parts = F.transform(F.split(c, r"\n\s*\n"), strip)
    return F.filter(parts, lambda p: F.length(p) > 0)


def chunk_greedy(c: Column, target: int = PASSAGE_TARGET, hard: int = PASSAGE_LIMIT) -> Column:
    """Passages of a text: paragraphs are packed up to ``target`` characters and never beyond ``hard``."""
    # One match per piece of an over-long paragraph: the rest if it fits, else up to the last ". " beyond
    # the target, else a hard cut.
    piece = rf"(?s).{{1,{hard}}}\z|.{{{target},{hard - 2}}}\.(?= )|.{{{hard}}}"

    def pieces(p: Column) -> Column:
        cut = F.transform(F.regexp_extract_all(p, F.lit(piece), F.lit(0)), strip)
        return F.filter(cut, lambda x: F.length(x) > 0)

    def step(state: Column, p: Column) -> Column:
        done, current = state["done"], state["current"]
        closed = F.when(F.length(current) > 0, F.concat(done, F.array(current))).otherwise(done)
        joined = F.when(F.length(current) > 0, F.concat(current, F.lit("\n\n"), p)).otherwise(p)

        def state_of(done_: Column, current_: Column) -> Column:
            return F.struct(done_.alias("done"), current_.alias("current"))

        return (
            F.when(F.length(p) > hard, state_of(F.concat(closed, pieces(p)), F.lit("")))
            .when(F.length(joined) <= target, state_of(done, joined))
            .when(F.length(joined) <= hard, state_of(F.concat(done, F.array(joined)), F.lit("")))
            .otherwise(state_of(closed, p))
        )

    return F.aggregate(
        paragraphs(normalise_text(c)),
        F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("current")),
        step,
        lambda s: F.when(F.length(s["current"]) > 0, F.concat(s["done"], F.array(s["current"]))).otherwise(s["done"]),
    )


def chunk_fixed(c: Column, max_chars: int = FIXED_LIMIT) -> Column:
    """Passages of a text under one limit; an over-long paragraph is cut every ``max_chars`` characters."""
    text = strip(F.regexp_replace(F.regexp_replace(F.coalesce(c, F.lit("")), r"\r\n?", "\n"), r"[ \t\f]+(?=\n|\z)", ""))

    def step(state: Column, p: Column) -> Column:
        done, current = state["done"], state["current"]
        joined = F.when(F.length(current) > 0, F.concat(current, F.lit("\n\n"), p)).otherwise(p)
        closed = F.when(F.length(current) > 0, F.concat(done, F.array(current))).otherwise(done)
        cuts = F.regexp_extract_all(p, F.lit(rf"(?s).{{1,{max_chars}}}"), F.lit(0))
        return (
            F.when(F.length(joined) <= max_chars, F.struct(done.alias("done"), joined.alias("current")))
            .when(F.length(p) <= max_chars, F.struct(closed.alias("done"), p.alias("current")))
            .otherwise(F.struct(F.concat(closed, cuts).alias("done"), F.lit("").alias("current")))
        )

    return F.aggregate(
        paragraphs(text),
        F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("current")),
        step,
        lambda s: F.when(F.length(s["current"]) > 0, F.concat(s["done"], F.array(s["current"]))).otherwise(s["done"]),
    )


def content_id(prefix: str, parts: Iterable[Column], digits: int = 24) -> Column:
    """Prefix plus the first hex digits of the SHA-256 of the parts joined by a bar. NULL counts as empty."""
    joined = F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])
    return F.concat(F.lit(prefix), F.substring(F.sha2(joined, 256), 1, digits))


def sha256(c: Column) -> Column:
    return F.sha2(c, 256)


# Frequent function words used to recognise a language.
LANGUAGE_WORDS = {
    "de": ("der", "die", "und", "das", "den", "von", "zu", "mit", "sich", "nicht", "auch", "ist", "ein", "eine", "für", "auf", "dem", "sch"),
    "en": ("the", "of", "and", "to", "in", "is", "that", "for", "with", "was", "on", "are", "by", "at", "from", "it", "be", "this"),
    "es": ("el", "la", "de", "que", "y", "en", "los", "las", "del", "se", "por", "con", "una", "para", "un", "es", "lo", "al"),
    "fr": ("le", "la", "les", "des", "et", "de", "un", "une", "que", "dans", "du", "est", "pour", "qui", "sur", "elle", "au", "en"),
    "it": ("il", "di", "che", "la", "per", "un", "una", "non", "con", "della", "sono", "gli", "nel", "alla", "anche", "dei", "lo", "si"),
    "nl": ("de", "het", "een", "van", "en", "dat", "niet", "zijn", "met", "voor", "op", "aan", "ook", "bij", "naar", "uit", "wordt", "om"),
    "pt": ("o", "os", "as", "da", "do", "que", "em", "um", "uma", "para", "com", "não", "por", "mais", "das", "dos", "ao", "na"),
}


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` where ``value`` is computed once per row however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def detect_language(c: Column) -> Column:
    """Language with most function words in the whole text; UNKNOWN for texts without any."""

    def best(words: Column) -> Column:
        scores = [
            F.struct(F.size(F.filter(words, lambda w: w.isin(*listed))).alias("hits"), F.lit(code).alias("language"))
            for code, listed in LANGUAGE_WORDS.items()
        ]
        return F.array_max(F.array(*scores))

    return once(
        once(F.split(normalise_label(c), " "), best),
        lambda b: F.when(b["hits"] > 0, b["language"]).otherwise(F.lit("UNKNOWN")),
    )
