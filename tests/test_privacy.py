from __future__ import annotations

import time

from pyspark.sql import functions as F

from dossier.operators import privacy as P


def pseudonymised(spark, text, categories, terms=None):
    rows = spark.createDataFrame([("d", text)], "id string, text string")
    return P.pseudonymise(rows, "text", categories, terms).first()


def test_structured_identifiers(spark):
    text = "Contact john@example.org or JOHN@example.org. IMO 1234567 and MMSI 123456789 stay selectable."
    row = pseudonymised(spark, text, ["EMAIL", "IMO", "MMSI"])
    assert row["pseudonymised_text"] == "Contact EMAIL_001 or EMAIL_001. IMO_001 and MMSI_001 stay selectable."
    for r in row["replacements"]:
        assert text[r["start"] : r["end"]] == r["original"]


def test_terms_are_numbered_by_first_occurrence(spark):
    text = "Chief engineer Jane Brown told John Smith (J.S.) to inspect the pump; jane brown agreed."
    row = pseudonymised(spark, text, ["PERSON"], {"person": ["John Smith", "Jane Brown", "J.S."]})
    assert row["pseudonymised_text"] == "Chief engineer PERSON_001 told PERSON_002 (PERSON_003) to inspect the pump; PERSON_001 agreed."


def test_only_selected_categories(spark):
    assert pseudonymised(spark, "IMO 1234567 a@b.org", ["EMAIL"])["pseudonymised_text"] == "IMO 1234567 EMAIL_001"


def test_longest_of_overlapping_spans_wins(spark):
    row = pseudonymised(spark, "passport number 123456789012", ["PHONE", "PERSONAL_ID"], None)
    spans = [(r["start"], r["end"]) for r in row["replacements"]]
    assert spans == sorted(spans) and all(a[1] <= b[0] for a, b in zip(spans, spans[1:]))


def test_prescreen(spark):
    rows = spark.createDataFrame(
        [
            ("a", "Witness statement: the master described the event."),
            ("b", "The published report notes that the VDR was reviewed by investigators."),
            ("c", "VDR transcript: 10:21 bridge conversation begins."),
            ("d", "Contact: person@example.org"),
        ],
        "id string, text string",
    )
    found = {(r["id"], r["rule_id"]) for r in P.prescreen_text(rows, ["id"]).collect()}
    assert found == {("a", "WITNESS_RECORD"), ("c", "VDR_RAW_RECORD")}
    names = spark.createDataFrame([("a", "investigator_notes.txt"), ("b", "bridge_guidance.pdf")], "id string, name string")
    titles = P.prescreen_metadata(names, ["id"], "name")
    combined = {(r["id"], r["rule_id"]): r["required_class"] for r in P.combine_findings(["id"], P.prescreen_text(rows, ["id"]), titles).collect()}
    assert combined[("a", "INVESTIGATOR_WORKING_RECORD_METADATA")] == "D" and ("b", "WITNESS_RECORD") not in combined


def test_redaction(spark):
    rows = spark.createDataFrame([("mail a@b.org, call +32 475 12 34 56", "passport AB12345", "plain")], "a string, b string, c string")
    row = P.redact_columns(rows, ["a", "b", "c"]).first()
    assert (row["a"], row["b"], row["c"]) == ("mail [REDACTED_EMAIL], call [REDACTED_PHONE]", "[REDACTED_PERSONAL_ID]", "plain")
    assert row["redaction_count"] == 2


def test_a_rule_goes_before_an_equal_term(spark):
    row = pseudonymised(spark, "mail a@b.org now", ["EMAIL"], {"EMAIL": ["a@b.org", "A@B.ORG"]})
    assert [(r["original"], r["detected_by"]) for r in row["replacements"]] == [("a@b.org", "RULE")]


def test_many_matches_in_one_text(spark):
    """20,000 matches: time in proportion, and the pseudonyms of a walk over them."""
    names = [f"user{i % 7000}@site{i % 3}.example.org" for i in range(20_000)]
    text = " and ".join(names)
    df = spark.createDataFrame([(1, text), (2, ""), (3, None), (4, "x " + names[0])], "id int, text string")
    start = time.perf_counter()
    rows = {r["id"]: r for r in P.pseudonymise(df, "text", ["EMAIL"]).collect()}
    assert time.perf_counter() - start < 60
    number, out = {}, []
    for name in names:
        out.append(f"EMAIL_{number.setdefault(name, len(number) + 1):03d}")
    assert rows[1]["pseudonymised_text"] == " and ".join(out)
    assert [s["start"] for s in rows[1]["replacements"]][:2] == [0, len(names[0]) + 5]
    assert rows[2]["pseudonymised_text"] == "" and rows[4]["pseudonymised_text"] == "x EMAIL_001"
