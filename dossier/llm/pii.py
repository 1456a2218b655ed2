"""Personal data: base patterns, and terms that the corpus shows to reveal the entities found.

Base spans are leftmost non-overlapping matches of each kind (email, ip, card, phone) in whole texts; a match that fails its
check is dropped. Positions are code points, ends exclusive.

The method is information-theoretic. The protected entities are the values found. Over all distinct lines of the corpus,
with N lines, n(e) lines that hold the entity e, n(t) that hold the term t and n(e, t) that hold both,

    disclosure(t, e) = PMI(t; e) / IC(e) = log(N n(e,t) / (n(e) n(t))) / log(N / n(e))

is the share of the information of e that t gives away: 1 when t occurs with e only, about 0 for words that occur everywhere.
In lines that hold e, terms of a disclosure of at least ``GENERALISE`` are replaced by a general word, and from ``REMOVE`` on
taken out. Estimates need ``SUPPORT`` distinct lines with both, so lines that are copied do not count again. Most values are rarer than
that, so the estimate backs off: a value stands for itself, for what it shares with others (the domain, the network, the first digits) and for its
kind, and a term that discloses any of the three is judged by the strongest. Lines without an entity are left alone, and base spans always stay.

Everything is built-in expressions and joins. The patterns are written so that the matching engine neither recurses over
long texts nor starts again inside a run of characters: a character that cannot belong to a match is first replaced by another
one of the same length. Only lines with entities that have the support are exploded into terms, and only terms met there are
counted over the corpus, by distinct (line, term). Of these, terms that are too frequent to disclose anything are recognised in one of
``HASH_CLASSES`` classes of lines (a lower bound of their count, so nothing is lost) and not counted further. A term or an
entity in a third of all rows is a partial count per task.

Null and empty texts have no spans. Rows are recognised by their id and a hash of the text, so null ids and repeated rows are
judged alike. Equal starts are ordered by kind. Further columns do not matter for spans and are kept by ``sanitised``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dossier.functions.privacy import running_sums
from dossier.plans.durable import durable
from dossier.plans.sizing import checked_broadcast

KINDS = ("email", "ip", "card", "phone")
TERM = "term"
SUPPORT = 3
GENERALISE = 0.8
REMOVE = 0.95
HASH_CLASSES = 16
SPAN = "struct<start: int, kind: int, end: int>"
_OCTET = r"0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})"


def _matches(text: Column, pattern: str) -> Column:
    """(start, end, hit) of all matches, from the lengths of the matches and of what lies between them."""
    between, hits = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), 0)
    empty = F.array().cast("array<struct<start: int, end: int, hit: string>>")
    pairs = F.arrays_zip(F.slice(between, F.lit(1), F.size(hits)).alias("gap"), hits.alias("hit"))

    ends = running_sums(F.transform(pairs, lambda p: F.length(p["gap"]) + F.length(p["hit"])))
    found = F.zip_with(hits, ends, lambda hit, end: F.struct((end - F.length(hit)).alias("start"), end.alias("end"), hit.alias("hit")))
    return F.when(F.size(hits) > 0, found).otherwise(empty)


def _luhn(digits: Column) -> Column:
    size = F.length(digits)
    values = F.transform(
        F.sequence(F.lit(1), size),
        lambda i: F.when((size - i) % 2 == 1, F.substring(digits, i, F.lit(1)).cast("int") * 2).otherwise(F.substring(digits, i, F.lit(1)).cast("int")),
    )
    total = F.aggregate(values, F.lit(0), lambda a, v: a + F.when(v > 9, v - 9).otherwise(v))
    return total % 10 == 0


def _email(text: Column) -> Column:
    # a dot that no label follows ends a host; as an underscore it is still part of a mailbox, and of nothing else
    plain = F.regexp_replace(text, r"\.(?![A-Za-z0-9-])", "_")
    mailbox = r"A-Za-z0-9._%+\-"
    return _matches(plain, rf"(?:(?<![{mailbox}])|\G)[{mailbox}]++@[A-Za-z0-9-]+\.[A-Za-z0-9.-]+")


def _ip(text: Column) -> Column:
    found = _matches(text, r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]+")
    return F.filter(found, lambda m: m["hit"].rlike(rf"^{_OCTET}\.{_OCTET}\.{_OCTET}\.{_OCTET}$"))


def _card(text: Column) -> Column:
    # of two separators in a row neither joins digits
    plain = F.regexp_replace(text, r"[\x20-](?=[\x20-])|(?<=[\x20-])[\x20-]", "_")
    found = _matches(plain, r"[0-9][0-9\x20-]*[0-9]")
    digits = lambda m: F.regexp_replace(m["hit"], r"[\x20-]", "")
    return F.filter(found, lambda m: F.length(digits(m)).between(12, 19) & _luhn(digits(m)))


def _phone(text: Column) -> Column:
    found = _matches(text, r"\+[0-9][\x20().0-9-]+[0-9]")
    return F.filter(found, lambda m: F.length(F.regexp_replace(m["hit"], "[^0-9]", "")).between(9, 15))


def _by_kind(text: Column) -> dict[str, Column]:
    """Matches by kind; texts without the characters that a kind needs are not searched."""
    none = F.array().cast("array<struct<start: int, end: int, hit: string>>")
    some = {
        "email": (F.contains(text, F.lit("@")), _email), "ip": (text.rlike(r"[0-9]\.[0-9]"), _ip),
        "card": (text.rlike(r"[0-9][\x20-]?[0-9]"), _card), "phone": (text.rlike(r"\+[0-9]"), _phone),
    }
    return {kind: F.when(needed, find(text)).otherwise(none) for kind, (needed, find) in some.items()}


def _spans(found: dict[str, Column]) -> Column:
    """All matches as (start, kind, end), by start, then kind."""

    def numbered(matches: Column, kind: int) -> Column:
        return F.transform(matches, lambda m: F.struct(m["start"].alias("start"), F.lit(kind).alias("kind"), m["end"].alias("end")))

    return F.array_sort(F.concat(*[numbered(c, KINDS.index(kind)) for kind, c in found.items()]))


def written(spans: Column) -> Column:
    """Spans as ``kind:start:end``, joined by commas."""
    names = F.array(*[F.lit(k) for k in (*KINDS, TERM, TERM)])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def count_of(spans: Column, kind: str) -> Column:
    number = KINDS.index(kind)
    return F.size(F.filter(spans, lambda s: s["kind"] == number)).cast("long")


def _row_key() -> list[Column]:
    return [F.col("doc_id").alias("_id"), F.xxhash64("_text").alias("_key")]


def _lines(docs: DataFrame, wanted: Column | None = None) -> DataFrame:
    """(_id, _key, _line, _from): distinct lines with the code point at which they start."""
    parts = F.split("_text", "\n", -1)
    ends = running_sums(F.transform(parts, lambda p: F.length(p) + 1))
    zipped = F.zip_with(parts, ends, lambda line, end: F.struct(line.alias("line"), (end - F.length(line) - 1).alias("at")))
    kept = F.filter(zipped, lambda z: wanted_line(z["line"]))
    return docs.select(*_row_key(), F.explode(kept).alias("_part")).select("_id", "_key", F.col("_part.line").alias("_line"), F.col("_part.at").alias("_from"))


def wanted_line(line: Column) -> Column:
    """Lines that may hold a base span."""
    return F.contains(line, F.lit("@")) | line.rlike(r"[0-9]")


def _terms(line: Column) -> Column:
    """Distinct terms: runs of letters in lower case."""
    return F.array_distinct(F.regexp_extract_all(F.lower(line), F.lit(r"\p{L}+"), 0))


def _without(line: Column, spans: Column) -> Column:
    """The line with its spans blanked, character for character."""
    # where spans of different kinds overlap, what the earlier ones reach counts
    starts, ends = F.transform(spans, lambda s: s["start"]), F.transform(spans, lambda s: s["end"])
    reach = F.concat(F.array(F.lit(0)), running_max(ends))
    gaps = F.zip_with(reach, F.concat(starts, F.array(F.length(line))), lambda a, b: F.struct(a.alias("from"), F.greatest(a, b).alias("to")))
    before = F.concat(F.array(F.lit(0)), F.transform(gaps, lambda g: g["to"]))
    pieces = F.zip_with(F.slice(before, F.lit(1), F.size(gaps)), gaps, lambda last, g: F.concat(F.repeat(F.lit(" "), g["from"] - last), F.substring(line, g["from"] + 1, g["to"] - g["from"])))
    return F.array_join(pieces, "")


def running_max(values: Column) -> Column:
    """The largest of the first 1, 2, ... values: of a sorted list of few spans of a line."""
    nothing = F.array().cast("array<int>")
    return F.aggregate(values, nothing, lambda s, v: F.array_append(s, F.greatest(v, F.coalesce(F.try_element_at(s, F.lit(-1)), F.lit(0)))))


def _values(kind: str) -> Column:
    """The entities of a kind, named by it: values, the part that a value shares with its neighbours, and the kind itself."""
    part = {
        "email": lambda hit: F.substring_index(hit, "@", -1), "ip": lambda hit: F.substring_index(hit, ".", 3),
        "card": lambda hit: F.left(F.regexp_replace(hit, "[^0-9]", ""), F.lit(6)), "phone": lambda hit: F.left(F.regexp_replace(hit, "[^0-9]", ""), F.lit(4)),
    }[kind]
    names = lambda m: F.array(F.concat(F.lit(f"{kind}:"), m["hit"]), F.concat(F.lit(f"{kind}/"), part(m["hit"])), F.lit(kind))
    return F.flatten(F.transform(f"_{kind}", names))


def disclosing(docs: DataFrame, support: int = SUPPORT, generalise: float = GENERALISE, remove: float = REMOVE) -> DataFrame:
    """(_id, _key, start, kind, end) of the terms to generalise (kind 4) or remove (kind 5)."""
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("_text"))
    lines = _lines(docs.where(wanted_line(F.col("_text"))))
    found = lines.withColumns({f"_{k}": c for k, c in _by_kind(F.col("_line")).items()})
    values = F.concat(*[_values(k) for k in KINDS])
    held = found.withColumn("_entities", F.array_distinct(values)).where(F.size("_entities") > 0)
    held = held.withColumn("_spans", _spans({k: F.col(f"_{k}") for k in KINDS})).withColumn("_hash", F.xxhash64("_line"))
    mentions = held.select("_id", "_key", "_from", "_line", "_hash", "_spans", F.explode("_entities").alias("_entity"))
    n_entity = mentions.groupBy("_entity").agg(F.count_distinct("_hash").alias("n_e")).where(F.col("n_e") >= support)
    supported = mentions.join(checked_broadcast(n_entity), "_entity")
    blank = _without(F.col("_line"), F.col("_spans"))
    pairs = supported.select("_entity", "n_e", "_hash", F.explode(_terms(blank)).alias("_term"))
    n_pair = pairs.groupBy("_entity", "n_e", "_term").agg(F.count_distinct("_hash").alias("n_et")).where(F.col("n_et") >= support)

    n_pair = durable(n_pair)
    every = docs.select(F.explode(F.split("_text", "\n", -1)).alias("_line")).withColumn("_hash", F.xxhash64("_line"))
    n_lines = max(1, every.select("_hash").distinct().count())
    # a term in more lines than this discloses none of its entities
    most = F.max(F.col("n_et") * F.pow(F.lit(n_lines) / F.col("n_e"), F.lit(1 - generalise)))
    wanted = durable(n_pair.groupBy("_term").agg(most.alias("_most")))

    def counted(lines: DataFrame, terms: DataFrame) -> DataFrame:
        held = lines.select("_hash", F.explode(_terms(F.col("_line"))).alias("_term"))
        return held.join(checked_broadcast(terms), "_term", "left_semi").distinct().groupBy("_term").agg(F.count("*").alias("n_t"))

    # Frequent words are told from the lines of one hash class alone: a term has at least as many lines as that.
    few = counted(every.where(F.pmod("_hash", F.lit(HASH_CLASSES)) == 0), wanted.select("_term"))
    rare = wanted.join(few, "_term", "left").where(F.coalesce("n_t", F.lit(0)) <= F.col("_most")).select("_term")
    n_term = counted(every, rare)

    n = F.lit(float(n_lines))
    share = F.log(n * F.col("n_et") / (F.col("n_e") * F.greatest("n_t", "n_et"))) / F.log(n / F.col("n_e"))
    rated = n_pair.join(n_term, "_term").where(F.col("n_e") < n_lines).withColumn("_share", share)
    flagged = rated.where(F.col("_share") >= generalise).select("_entity", "_term", (F.col("_share") >= remove).alias("_out"))

    placed = F.transform(_matches(F.lower(blank), r"\p{L}+"), lambda m: F.struct((m["start"] + F.col("_from")).alias("start"), (m["end"] + F.col("_from")).alias("end"), m["hit"].alias("hit")))
    at = supported.select("_id", "_key", "_entity", F.explode(placed).alias("_at")).withColumn("_term", F.col("_at.hit"))
    hit = at.join(checked_broadcast(flagged), ["_entity", "_term"])
    return hit.groupBy("_id", "_key", F.col("_at.start").alias("start"), F.col("_at.end").alias("end")).agg(
        (F.max(F.col("_out").cast("int")) + len(KINDS)).alias("kind")
    ).select("_id", "_key", "start", "kind", "end")


def _found(docs: DataFrame, support: int) -> DataFrame:
    """(row, text, base_spans, term_spans): each row of ``docs`` as a struct, so that no name of its columns clashes."""
    by_row = disclosing(docs, support).groupBy("_id", "_key").agg(F.array_sort(F.collect_list(F.struct("start", "kind", "end"))).alias("_terms"))
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").alias("_doc"), text.alias("text"), F.xxhash64(text).alias("_hash"))
    same = F.col("_doc").eqNullSafe(F.col("_id")) & (F.col("_hash") == F.col("_key"))
    joined = rows.join(checked_broadcast(by_row), same, "left")
    terms = F.coalesce("_terms", F.array().cast(f"array<{SPAN}>"))
    return joined.select("row", "text", _spans(_by_kind(F.col("text"))).alias("base_spans"), terms.alias("term_spans"))


def with_spans(docs: DataFrame, support: int = SUPPORT) -> DataFrame:
    """``docs`` with ``base_spans`` and ``term_spans``, arrays of (start, kind, end); columns of these names are replaced."""
    return _found(docs.drop("base_spans", "term_spans"), support).select("row.*", "base_spans", "term_spans")


def all_spans() -> Column:
    return F.array_sort(F.concat("base_spans", "term_spans"))


def _merged(spans: Column) -> Column:
    """Spans without overlaps: overlapping ones become one, of the kind that starts first."""

    def step(done: Column, s: Column) -> Column:
        last = F.element_at(done, -1)
        longer = F.struct(last["start"].alias("start"), last["kind"].alias("kind"), F.greatest(last["end"], s["end"]).alias("end"))
        overlaps = (F.size(done) > 0) & (s["start"] < F.try_element_at(done, F.lit(-1))["end"])
        return F.when(overlaps, F.concat(F.slice(done, 1, F.size(done) - 1), F.array(longer))).otherwise(F.array_append(done, s))

    return F.aggregate(spans, F.array().cast(f"array<{SPAN}>"), step)


def sanitised(docs: DataFrame, support: int = SUPPORT) -> DataFrame:
    """``docs`` with base spans replaced by their kind, disclosing terms generalised or removed, and n_chars kept true."""
    found = _found(docs, support).withColumn("spans", _merged(all_spans()))
    marks = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS], F.lit("[WORD]"), F.lit(""))
    gap_from = F.concat(F.array(F.lit(0)), F.transform("spans", lambda s: s["end"]))
    gap_to = F.concat(F.transform("spans", lambda s: s["start"]), F.array(F.length("text")))
    gaps = F.zip_with(gap_from, gap_to, lambda a, b: F.substring(F.col("text"), a + 1, b - a))
    instead = F.concat(F.transform("spans", lambda s: F.get(marks, s["kind"])), F.array(F.lit("")))
    changed = F.array_join(F.flatten(F.zip_with(gaps, instead, lambda gap, mark: F.array(gap, mark))), "")
    text = F.when(F.size("spans") == 0, F.col("row.text")).otherwise(changed)
    columns = {"text": text}
    if "n_chars" in docs.columns:
        columns["n_chars"] = F.length(text).cast(docs.schema["n_chars"].dataType)
    return found.select(*[columns.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])
