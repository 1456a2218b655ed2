"""The shortlist equals brute force, and rows that k better codes of a text beat are not listed."""

from __future__ import annotations

import random

from dossier.functions.text import TAXONOMY_STOP_WORDS
from dossier.operators import retrieval as R

PATHS = ("Contributing Factor", "Casualty Event", "Vessel", "Safety recommendation", "Other")
WORDS = ("alpha", "beta", "gamma", "delta", "alp", "ring")


def _tables(spark):
    rng = random.Random(3)
    registry = [
        (f"{PATHS[i % 5]}/{i % 3}", f"n{i % 3}", rng.choice(WORDS), f"c{i % 150}" if i % 40 else None, " ".join(rng.choices(WORDS, k=2)) if i % 10 else rng.choice(WORDS)[:3])
        for i in range(900)
    ]
    kinds = [*R.TAXONOMY_BONUS, "Claim", None]
    nodes = [(f"x{i}", kinds[i % 7], " ".join(rng.choices(WORDS, k=3)), rng.choice([None, "ring of 7", "large"])) for i in range(40)]
    return nodes, registry, spark.createDataFrame(nodes, "node_id string, node_kind string, label string, description string"), spark.createDataFrame(
        registry, "entity_path string, entity_name string, attribute_name string, code string, code_value string"
    )


def _words(text):
    return {w for w in text.split() if len(w) >= 3 and w not in TAXONOMY_STOP_WORDS}


def test_shortlist_equals_brute_force_and_lists_few_rows(spark, monkeypatch):
    nodes, registry, node_table, registry_table = _tables(spark)
    listed, first_codes = [], R._first_codes

    def counted(candidates, groups, k, times=None):
        if groups == ["_key"]:
            listed.append(candidates.count())
        return first_codes(candidates, groups, k, times)

    monkeypatch.setattr(R, "_first_codes", counted)
    found = {(r["node_id"], r["rank"]): (r["score"], r["entity_path"], r["attribute_name"], r["code_value"], r["code"]) for r in R.taxonomy_shortlist(node_table, registry_table, k=3).collect()}
    expected, ties = {}, 0
    for node, kind, label, description in nodes:
        text = f"{label} {description or ''}".strip()
        scores = {}
        for path, _, attribute, code, value in registry:
            held, asked = _words(text), _words(value)
            letter, bonus = R.TAXONOMY_BONUS.get(kind, ("?", 0))
            told = {"<contributing factor>": "contributing factor", "<safety recommendation>": "safety recommendation", "<event>": "casualty event", "<vessel>": "vessel"}.get(letter)
            score = 18 * len(held & asked) + 6 * len(held & _words(attribute)) + (bonus if told and told in path.lower() else 0)
            score += (120 if value in text else 0) + (70 if asked and asked <= held else 0)
            key = (path, attribute, code)
            if score:
                scores[key] = min(scores.get(key, (0, "")), (-score, value))
        best = sorted((s, p, a, v, c or "", c) for (p, a, c), (s, v) in scores.items())
        ties += sum(s == best[0][0] for s, *_ in best)
        expected |= {(node, n + 1): (-s, p, a, v, c) for n, (s, p, a, v, _, c) in enumerate(best[:3])}
    assert found == expected
    # without the cut each text has rows of all attributes and classes of its phrases
    assert listed[0] < 40 * 60
    assert ties > 40
