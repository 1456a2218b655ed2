"""Identifier patterns, spans and replacement as JVM expressions over one text column."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

# Categories replaced by default, further categories, and the patterns of the structured ones.
DEFAULT_CATEGORIES = ("PERSON", "EMAIL", "PHONE", "PERSONAL_ID")
OPTIONAL_CATEGORIES = (
    "ORGANISATION", "VESSEL", "IMO", "MMSI", "PORT", "LOCATION", "NATIONALITY", "ROLE", "DATE_TIME",
    "CASE_REFERENCE",
)
ALL_CATEGORIES = DEFAULT_CATEGORIES + OPTIONAL_CATEGORIES
EMAIL = r"\b[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}\b"
PERSONAL_ID = r"\b(?:passport|national\s+id|identity\s+card|id\s+number)\s*[:#-]?\s*[A-Z0-9-]{4,}\b"
PATTERNS = {
    "EMAIL": "(?iU)" + EMAIL,
    "PHONE": r"(?U)(?<!\w)(?:\+?\d[\d .()\-/]{6,}\d)(?!\w)",
    "IMO": r"(?iU)\bIMO\s*[:#-]?\s*\d{7}\b",
    "MMSI": r"(?iU)\bMMSI\s*[:#-]?\s*\d{9}\b",
    "PERSONAL_ID": "(?iU)" + PERSONAL_ID,
    "CASE_REFERENCE": (
        r"(?iU)\b(?:case|file|reference|ref\.?|investigation)\s*(?:no\.?|number|#)?"
        r"\s*[:#-]?\s*[A-Z0-9][A-Z0-9._/-]{3,}\b"
    ),
}
# Tags written over identifiers in derived texts.
REDACTIONS = (
    ("(?iU)" + EMAIL, "[REDACTED_EMAIL]"),
    (r"(?U)(?<!\w)(?:\+?\d[\d\s().-]{7,}\d)(?!\w)", "[REDACTED_PHONE]"),
    ("(?iU)" + PERSONAL_ID, "[REDACTED_PERSONAL_ID]"),
)

BLOCK = 128
SPAN = "array<struct<start:int,end:int,category:string,original:string,detected_by:string>>"


def selected_categories(categories: Iterable[str]) -> list[str]:
    known = [str(c or "").strip().upper() for c in categories]
    return [c for c in dict.fromkeys(known) if c in ALL_CATEGORIES]


def _quoted(term: str) -> str:
    return r"(?iu)\Q" + term.replace(r"\E", r"\E\\E\Q") + r"\E"


def once(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once; a plain column in a lambda is computed again for each element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def in_blocks(items: Column) -> Column:
    """An array cut into arrays of at most BLOCK items. A fold that appends copies what it has, so long arrays are folded block by block."""
    last = lambda x: F.greatest(F.floor((F.size(x) - 1) / BLOCK), F.lit(0)).cast("int")
    return once(items, lambda x: F.transform(F.sequence(F.lit(0), last(x)), lambda b: F.slice(x, b * BLOCK + 1, F.lit(BLOCK))))


def running_sums(values: Column) -> Column:
    """The sums of the first 1, 2, ... values."""

    def sums(x: Column, start: Column) -> Column:
        nothing = F.struct(start.alias("at"), F.array().cast("array<int>").alias("out"))
        return F.aggregate(x, nothing, lambda s, v: F.struct((s["at"] + v).alias("at"), F.concat(s["out"], F.array(s["at"] + v)).alias("out")), lambda s: s["out"])

    def of(blocks: Column) -> Column:
        totals = F.transform(blocks, lambda x: F.aggregate(x, F.lit(0), lambda s, v: s + v))
        before = F.slice(F.concat(F.array(F.lit(0)), sums(totals, F.lit(0))), F.lit(1), F.size(blocks))
        return F.flatten(F.transform(F.arrays_zip(blocks.alias("x"), before.alias("start")), lambda b: sums(b["x"], b["start"])))

    return once(in_blocks(values), of)


def _spans_of(text: Column, pattern: str, category: str, detected_by: str) -> Column:
    """Offsets of every match: the gaps between matches come from split, the matches from extract."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)
    paired = F.arrays_zip(F.slice(gaps, 1, F.size(found)).alias("gap"), found.alias("hit"))
    ends = running_sums(F.transform(paired, lambda x: F.length(x["gap"]) + F.length(x["hit"])))
    spans = F.transform(
        F.arrays_zip(found.alias("hit"), ends.alias("end")),
        lambda x: F.struct(
            (x["end"] - F.length(x["hit"])).alias("start"), x["end"].alias("end"), F.lit(category).alias("category"),
            x["hit"].alias("original"), F.lit(detected_by).alias("detected_by"),
        ),
    )
    return F.when(F.size(found) > 0, spans.cast(SPAN)).otherwise(F.array().cast(SPAN))


def candidate_spans(
    text: Column,
    categories: Iterable[str] = DEFAULT_CATEGORIES,
    terms: Mapping[str, Iterable[str]] | None = None,
) -> Column:
    """Every match of the selected patterns and of the caller's terms, overlapping ones included."""
    text = F.coalesce(text, F.lit(""))
    listed = {str(k or "").strip().upper(): v for k, v in (terms or {}).items()}
    parts = []
    for category in selected_categories(categories):
        if category in PATTERNS:
            parts.append(_spans_of(text, PATTERNS[category], category, "RULE"))
        for term in dict.fromkeys(str(t or "").strip() for t in listed.get(category, ())):
            if term:
                parts.append(_spans_of(text, _quoted(term), category, "MANUAL"))
    if not parts:
        return F.array().cast(SPAN)
    return F.concat(*parts)


def resolve_overlaps(spans: Column) -> Column:
    """Accept spans by start, longest first, then category, rules before terms, if they begin after the last accepted end.

    Spans that agree in start, end and category hold the same text, so nothing is left to chance.
    """
    ranked = F.array_sort(
        F.transform(
            spans,
            lambda s: F.struct(
                s["start"].alias("start"),
                (s["start"] - s["end"]).alias("shortness"),
                s["category"].alias("category"),
                (s["detected_by"] != "RULE").alias("by_term"),
                s["end"].alias("end"),
                s["original"].alias("original"),
                s["detected_by"].alias("detected_by"),
            ),
        )
    )
    def accept(block: Column, until: Column) -> Column:
        return F.aggregate(
            block,
            F.struct(until.alias("until"), F.array().cast(SPAN).alias("kept")),
            lambda a, s: F.when(s["start"] < a["until"], a).otherwise(
                F.struct(
                    s["end"].alias("until"),
                    F.concat(
                        a["kept"],
                        F.array(F.struct(s["start"], s["end"], s["category"], s["original"], s["detected_by"])).cast(SPAN),
                    ).alias("kept"),
                )
            ),
        )

    def next_block(a: Column, block: Column) -> Column:
        done = accept(block, a["until"])
        return once(done, lambda d: F.struct(d["until"].alias("until"), F.concat(a["kept"], F.array(d["kept"])).alias("kept")))

    start = F.struct(F.lit(-1).alias("until"), F.array().cast(f"array<{SPAN}>").alias("kept"))
    return F.aggregate(in_blocks(ranked), start, next_block, lambda a: F.flatten(a["kept"]))


def pseudonyms(accepted: Column) -> Column:
    """Add the token of every accepted span: numbered per category by first occurrence of the lower-cased text."""

    def key(s: Column) -> Column:
        return F.concat_ws("\u0001", s["category"], F.lower(s["original"]))

    categories = F.array_distinct(F.transform(accepted, lambda s: s["category"]))

    def named(category: Column, identities: Column) -> Column:
        same = F.filter(identities, lambda k: F.startswith(k, F.concat(category, F.lit("\u0001"))))

        def token(k: Column, i: Column) -> Column:
            n = (i + 1).cast("string")
            name = F.concat(category, F.lit("_"), F.when(F.length(n) < 3, F.lpad(n, 3, "0")).otherwise(n))
            return F.struct(k.alias("key"), name.alias("value"))

        return F.transform(same, token)

    # each identity is named once, spans look their name up
    identities = F.array_distinct(F.transform(accepted, key))
    names = F.map_from_entries(once(identities, lambda x: F.flatten(F.transform(categories, lambda c: named(c, x)))))
    return once(
        names,
        lambda m: F.transform(
            accepted,
            lambda s: F.struct(
                s["start"].alias("start"), s["end"].alias("end"), s["category"].alias("category"),
                s["original"].alias("original"), s["detected_by"].alias("detected_by"), F.element_at(m, key(s)).alias("pseudonym"),
            ),
        ),
    )


def replaced(text: Column, spans: Column) -> Column:
    """The text with every span replaced by its pseudonym."""
    text = F.coalesce(text, F.lit(""))
    # The text is cut once per block, so that each span is cut out of a short part of it.
    before = F.concat(F.array(F.lit(0)), F.transform(spans, lambda s: s["end"]))
    cut = F.transform(
        F.arrays_zip(F.slice(before, F.lit(1), F.size(spans)).alias("from"), spans.alias("span")),
        lambda x: F.struct(x["from"].alias("from"), x["span"]["start"].alias("start"), x["span"]["end"].alias("end"), x["span"]["pseudonym"].alias("pseudonym")),
    )

    def written(block: Column) -> Column:
        first, last = block[0]["from"], F.element_at(block, -1)["end"]
        part = F.array(F.struct(F.substring(text, first + 1, last - first).alias("text"), first.alias("at")))
        pieces = F.transform(part, lambda p: F.transform(block, lambda s: F.concat(F.substring(p["text"], s["from"] - p["at"] + 1, s["start"] - s["from"]), s["pseudonym"])))
        return F.array_join(F.flatten(pieces), "")

    end = F.element_at(before, -1)
    whole = F.concat(F.array_join(F.transform(in_blocks(cut), written), ""), F.substring(text, end + 1, F.length(text)))
    return F.when(F.size(spans) == 0, text).otherwise(whole)


def redact(c: Column) -> Column:
    """Overwrite e-mail addresses, phone numbers and personal id numbers by tags."""
    t = F.coalesce(c, F.lit(""))
    for pattern, tag in REDACTIONS:
        t = F.regexp_replace(t, pattern, tag)
    return t
