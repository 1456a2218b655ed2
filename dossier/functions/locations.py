"""Evidence keys: document|page|page and audio|sha256|ms|ms, clocks and time ranges."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_INTEGER = r"^[ \t]*[+-]?[0-9]+[ \t]*$"


def format_location(document_id: Column, start: Column, end: Column) -> Column:
    """Missing pages are written as empty parts."""
    return F.concat_ws(
        "|",
        document_id,
        F.coalesce(start.cast("string"), F.lit("")),
        F.coalesce(end.cast("string"), F.lit("")),
    )


def parse_location(c: Column) -> Column:
    """Strict parse into (document_id, page_start, page_end, violation); violation is NULL for a good key."""
    parts = F.split(F.trim(F.coalesce(c, F.lit(""))), r"\|", -1)
    three = F.size(parts) == 3
    document = F.trim(F.get(parts, F.lit(0)))
    numeric = F.get(parts, F.lit(1)).rlike(_INTEGER) & F.get(parts, F.lit(2)).rlike(_INTEGER)
    start = F.trim(F.get(parts, F.lit(1))).try_cast("int")
    end = F.trim(F.get(parts, F.lit(2))).try_cast("int")
    violation = (
        F.when(~three, F.lit("WRONG_ARITY"))
        .when(F.length(document) == 0, F.lit("EMPTY_DOCUMENT"))
        .when(~numeric, F.lit("PAGE_NOT_INTEGER"))
        .when((start < 1) | (end < 1), F.lit("PAGE_NOT_POSITIVE"))
        .when(end < start, F.lit("PAGES_REVERSED"))
    )
    good = violation.isNull()
    return F.struct(
        F.when(good, document).alias("document_id"),
        F.when(good, start).alias("page_start"),
        F.when(good, end).alias("page_end"),
        violation.alias("violation"),
    )


def lenient_pages(c: Column) -> Column:
    """Parse (document_id, page_start, page_end) where a page that is not a number becomes NULL."""
    parts = F.split(F.coalesce(c, F.lit("")), r"\|", -1)

    def page(i: int) -> Column:
        raw = F.trim(F.get(parts, F.lit(i)))
        return F.when(raw.rlike("^[0-9]+$"), raw.try_cast("int"))

    return F.when(
        F.size(parts) == 3,
        F.struct(
            F.get(parts, F.lit(0)).alias("document_id"),
            page(1).alias("page_start"),
            page(2).alias("page_end"),
        ),
    )


def clock(seconds: Column) -> Column:
    """HH:MM:SS of a number of seconds rounded half to even; negative values count as zero."""
    whole = F.greatest(F.bround(seconds.cast("double"), 0).cast("long"), F.lit(0).cast("long"))
    hours = F.floor(whole / 3600).cast("long")
    minutes = F.floor(whole / 60).cast("long") % 60
    return F.format_string("%02d:%02d:%02d", hours, minutes, whole % 60)


def clock_floor(seconds: Column) -> Column:
    """HH:MM:SS of a number of seconds cut to whole seconds."""
    whole = F.floor(seconds).cast("long")
    return F.format_string(
        "%02d:%02d:%02d", F.floor(whole / 3600).cast("long"), F.floor(whole / 60).cast("long") % 60, whole % 60
    )


def time_range_label(start: Column, end: Column) -> Column:
    return F.concat(clock(start), F.lit("–"), clock(end))


def format_audio_location(sha: Column, start: Column, end: Column) -> Column:
    """audio|sha256|ms|ms; NULL when the hash or the range is not valid."""
    valid = F.lower(sha).rlike("^[0-9a-f]{64}$") & (start >= 0) & (end >= start)

    def ms(c: Column) -> Column:
        return F.bround(c.cast("double") * 1000, 0).cast("long").cast("string")

    return F.when(valid, F.concat_ws("|", F.lit("audio"), F.lower(sha), ms(start), ms(end)))


def parse_audio_location(c: Column) -> Column:
    """(source_sha256, start_s, end_s), or NULL for a malformed key."""
    parts = F.split(F.trim(F.coalesce(c, F.lit(""))), r"\|", -1)
    sha = F.lower(F.get(parts, F.lit(1)))
    start = F.get(parts, F.lit(2)).try_cast("long")
    end = F.get(parts, F.lit(3)).try_cast("long")
    good = (
        (F.size(parts) == 4)
        & (F.get(parts, F.lit(0)) == "audio")
        & sha.rlike("^[0-9a-f]{64}$")
        & (start >= 0)
        & (end >= start)
    )
    return F.when(
        good,
        F.struct(
            sha.alias("source_sha256"), (start / 1000.0).alias("start_s"), (end / 1000.0).alias("end_s")
        ),
    )


_RANGE = r"\[(\d{2}):(\d{2}):(\d{2})\s*[–-]\s*(\d{2}):(\d{2}):(\d{2})\]"


def time_ranges(c: Column) -> Column:
    """Envelope (start_s, end_s, violation) of every [HH:MM:SS–HH:MM:SS] mark in a text; NULL without marks."""
    text = F.coalesce(c, F.lit(""))

    def part(group: int) -> Column:
        return F.transform(F.regexp_extract_all(text, F.lit(_RANGE), F.lit(group)), lambda x: x.cast("int"))

    zipped = F.arrays_zip(
        part(1).alias("h1"), part(2).alias("m1"), part(3).alias("s1"),
        part(4).alias("h2"), part(5).alias("m2"), part(6).alias("s2"),
    )
    marks = F.transform(
        zipped,
        lambda z: F.struct(
            (z["h1"] * 3600 + z["m1"] * 60 + z["s1"]).alias("start"),
            (z["h2"] * 3600 + z["m2"] * 60 + z["s2"]).alias("end"),
            ((z["m1"] > 59) | (z["s1"] > 59) | (z["m2"] > 59) | (z["s2"] > 59)).alias("bad"),
        ),
    )
    violation = F.when(F.exists(marks, lambda m: m["bad"]), F.lit("INVALID_CLOCK")).when(
        F.exists(marks, lambda m: m["end"] < m["start"]), F.lit("RANGE_REVERSED")
    )
    return F.when(
        F.size(marks) > 0,
        F.struct(
            F.when(violation.isNull(), F.array_min(F.transform(marks, lambda m: m["start"])).cast("double")).alias("start_s"),
            F.when(violation.isNull(), F.array_max(F.transform(marks, lambda m: m["end"])).cast("double")).alias("end_s"),
            violation.alias("violation"),
        ),
    )


# Fixed value: a clock time written as HH:MM or HH.MM.
_CLOCK_TIME = r"(?<!\d)([01]?\d|2[0-3])[:.]([0-5]\d)(?!\d)"


def explicit_time(c: Column) -> Column:
    """First clock time of a text as (minutes, label); NULL without one."""
    hour = F.regexp_extract(c, _CLOCK_TIME, 1).try_cast("int")
    minute = F.regexp_extract(c, _CLOCK_TIME, 2).try_cast("int")
    return F.when(
        hour.isNotNull() & minute.isNotNull(),
        F.struct((hour * 60 + minute).alias("minutes"), F.format_string("%02d:%02d", hour, minute).alias("label")),
    )
