"""Ordered keyword and pattern rules. All tables here are fixed values."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values: (rule id, label, pattern) of protected record types in a text.
TEXT_RULES = (
    ("PERSONAL_ID_RECORD", "passport/national identity record",
     r"\b(?:passport|national\s+id|identity\s+card|id\s+number)\s*[:#-]?\s*[A-Z0-9-]{4,}\b"),
    ("WITNESS_RECORD", "witness statement/interview record",
     r"\b(?:witness\s+(?:statement|interview|testimony)|statement\s+of\s+witness)\b"),
    ("VDR_RAW_RECORD", "VDR raw recording/transcript",
     r"\b(?:(?:vdr|voyage\s+data\s+recorder)\s+(?:audio|recording|transcript|conversation)|"
     r"(?:audio|recording|transcript)\s+from\s+(?:the\s+)?vdr)\b"),
    ("VTS_RAW_RECORD", "VTS raw recording/transcript",
     r"\b(?:vts|vessel\s+traffic\s+service)\s+(?:audio|recording|transcript|conversation)\b"),
    ("INVESTIGATOR_WORKING_RECORD", "investigator notes/draft working record",
     r"\b(?:investigator(?:'s)?\s+(?:notes?|draft)|investigation\s+working\s+notes?|"
     r"draft\s+(?:investigation\s+)?report)\b"),
    ("MEDICAL_RECORD", "medical/health record",
     r"\b(?:medical\s+(?:record|report|history)|health\s+record|patient\s+record)\b"),
)
# Fixed values: (rule id, label, pattern) of protected record types in a file name or title.
METADATA_RULES = (
    ("WITNESS_RECORD_METADATA", "witness record filename/title",
     r"(?:witness[_\s-]*(?:statement|interview)|statement[_\s-]*of[_\s-]*witness)"),
    ("VDR_RAW_RECORD_METADATA", "VDR raw-record filename/title",
     r"(?:vdr|voyage[_\s-]*data[_\s-]*recorder).*(?:audio|recording|transcript)"),
    ("VTS_RAW_RECORD_METADATA", "VTS raw-record filename/title",
     r"(?:vts|vessel[_\s-]*traffic[_\s-]*service).*(?:audio|recording|transcript)"),
    ("INVESTIGATOR_WORKING_RECORD_METADATA", "investigator working-record filename/title",
     r"(?:investigator[_\s-]*notes?|investigation[_\s-]*working[_\s-]*notes?|draft[_\s-]*(?:investigation[_\s-]*)?report)"),
    ("MEDICAL_RECORD_METADATA", "medical-record filename/title",
     r"(?:medical|health|patient)[_\s-]*(?:record|report|history)"),
)
# File name parts that identify a reference work -> (family, code, title).
REFERENCE_RULES = (
    (("2009_18", "2009-18", "2009 18"), ("EU_LEGISLATION", "Directive 2009/18/EC", "Directive 2009/18/EC")),
    (("2024_3017", "2024-3017", "2024 3017"), ("EU_LEGISLATION", "Directive (EU) 2024/3017", "Directive (EU) 2024/3017")),
    (("msc.255", "msc255", "msc_255"), ("IMO_FRAMEWORK", "MSC.255(84)", "Casualty Investigation Code")),
    (("a.1075", "a1075", "a_1075"), ("IMO_FRAMEWORK", "A.1075(28)", "IMO Guidelines A.1075(28)")),
)
# Upper-case headline parts -> vessel type, first match wins.
VESSEL_TYPES = (
    (("CONTAINER SHIP", "CONTAINERSHIP"), "Container Ship"),
    (("BULK CARRIER",), "Bulk Carrier"),
    (("CHEMICAL TANKER",), "Chemical Tanker"),
    (("PRODUCT TANKER",), "Product Tanker"),
    (("CRUDE OIL TANKER", "OIL TANKER"), "Oil Tanker"),
    (("TANKER",), "Tanker"),
    (("LNG CARRIER",), "LNG Carrier"),
    (("LPG CARRIER",), "LPG Carrier"),
    (("RO-RO", "RORO"), "Ro-Ro"),
    (("FERRY",), "Ferry"),
    (("PASSENGER SHIP",), "Passenger Ship"),
    (("PASSENGER VESSEL",), "Passenger Vessel"),
    (("CRUISE SHIP",), "Cruise Ship"),
    (("FISHING VESSEL",), "Fishing Vessel"),
    (("FISHING BOAT",), "Fishing Vessel"),
    (("TRAWLER",), "Trawler"),
    (("TUGBOAT", "TUG BOAT"), "Tug"),
    (("TUG",), "Tug"),
    (("PILOT BOAT",), "Pilot Boat"),
    (("WORKBOAT",), "Workboat"),
    (("TOWBOAT",), "Towboat"),
    (("BARGE",), "Barge"),
    (("SAILING YACHT",), "Sailing Yacht"),
    (("YACHT",), "Yacht"),
    (("SAILBOAT",), "Sailboat"),
    (("CARGO VESSEL",), "Cargo Vessel"),
    (("CARGO SHIP", "FREIGHTER"), "Cargo Ship"),
    (("BOAT",), "Boat"),
    (("SHIP",), "Ship"),
    (("VESSEL",), "Vessel"),
)
# Upper-case headline parts -> event type, first match wins.
EVENT_TYPES = (
    (("COLLISION", "CRASH"), "Collision"),
    (("ALLISION",), "Allision"),
    (("CAPSIZE", "CAPSIZED", "CAPSIZING", "OVERTURN"), "Capsize"),
    (("RUNS AGROUND", "RAN AGROUND", "RUN AGROUND", "GROUNDED", "GROUNDING", "STRANDED"), "Grounding"),
    (("FIRE", "BURNS", "BURNING", "BLAZE"), "Fire"),
    (("EXPLOSION", "EXPLODES", "EXPLODED", "BLAST"), "Explosion"),
    (("SINKING", "SINKS", "SANK", "SUNK", "GOES DOWN"), "Sinking"),
    (("FLOOD", "FLOODING", "FLOODED"), "Flooding"),
    (("OIL SPILL", "SPILL", "POLLUTION", "LEAK"), "Pollution"),
    (("MISSING",), "Missing Person"),
    (("OVERBOARD", "MAN OVERBOARD"), "Person Overboard"),
    (("RESCUED", "RESCUE", "EVACUATED"), "Rescue"),
    (("INJURED", "HOSPITALIZED", "HURT"), "Injury"),
    (("KILLED", "DEAD", "DIES", "DEATH"), "Fatality"),
)
# Upper-case headline parts -> severity, first match wins.
SEVERITIES = (
    (("KILLED", "DEAD", "DEATH", "DIED", "FATAL", "FATALITY", "FATALITIES", "LOSS OF LIFE"), "Fatal"),
    (("HOSPITALIZED", "INJURED"), "Very Serious Casualty"),
    (("FIRE",), "Very Serious Casualty"),
    (("COLLISION",), "Very Serious Casualty"),
    (("GROUNDING",), "Very Serious Casualty"),
)
# Headline words that mean loss of life, each surrounded by spaces.
LOSS_OF_LIFE = (
    " KILLED ", " DEAD ", " DEATH ", " DIED ", " FATAL ", " FATALITY ", " FATALITIES ", " LOSS OF LIFE ",
)
# Headlines that are noise, and migration words that are noise unless a life was lost.
INLAND_WATERS = r"(?i)\b(inland|river|pond|lake|canal|waterway)\b"
NOISE_WORDS = ("SANCTIONED", "SANCTION", "WINDWARD")
MIGRATION_WORDS = ("MIGRANT", "MIGRANTS", "IMMIGRANT", "IMMIGRANTS", "IMMIGRATION", "REFUGEE", "REFUGEES", "ASYLUM")


def contains_any(c: Column, words: Sequence[str]) -> Column:
    found = F.contains(c, F.lit(words[0]))
    for word in words[1:]:
        found = found | F.contains(c, F.lit(word))
    return found


def first_label(c: Column, rules: Sequence[tuple[Sequence[str], str]], default: str) -> Column:
    """Label of the first rule with a word in ``c``."""
    label = F.when(contains_any(c, rules[0][0]), F.lit(rules[0][1]))
    for words, value in rules[1:]:
        label = label.when(contains_any(c, words), F.lit(value))
    return label.otherwise(F.lit(default))


def rule_counts(c: Column, rules: Sequence[tuple[str, str, str]]) -> Column:
    """Array of (rule_id, label, match_count) for the rules that match at least once."""
    counted = F.array(
        *[
            F.struct(
                F.lit(rule_id).alias("rule_id"),
                F.lit(label).alias("label"),
                F.regexp_count(F.coalesce(c, F.lit("")), F.lit("(?iU)" + pattern)).cast("long").alias("match_count"),
            )
            for rule_id, label, pattern in rules
        ]
    )
    return F.filter(counted, lambda r: r["match_count"] > 0)


def reference_work(filename: Column) -> Column:
    """(family, code, title) of a reference file name."""
    name = F.lower(filename)
    stem = F.regexp_replace(F.regexp_extract(filename, r"([^/]*)$", 1), r"(?<=.)\.[^.]*$", "")

    def value(i: int, default: Column) -> Column:
        words, known = REFERENCE_RULES[0]
        chosen = F.when(contains_any(name, words), F.lit(known[i]))
        for words, known in REFERENCE_RULES[1:]:
            chosen = chosen.when(contains_any(name, words), F.lit(known[i]))
        return chosen.otherwise(default)

    return F.struct(
        value(0, F.lit("TECHNICAL_REFERENCE")).alias("family"),
        value(1, F.lit(None).cast("string")).alias("code"),
        value(2, F.replace(stem, F.lit("_"), F.lit(" "))).alias("title"),
    )


def violations(*checks: tuple[str, Column]) -> Column:
    """Array of the codes whose condition is true."""
    return F.array_compact(F.array(*[F.when(condition, F.lit(code)) for code, condition in checks]))
