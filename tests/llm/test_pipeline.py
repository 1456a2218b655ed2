from __future__ import annotations

import random

import pytest

import corpus_pipeline
from dossier.llm import bpe, decontamination, jaccard, pii, quality


@pytest.fixture(scope="module")
def stages(spark, folder, tmp_path_factory):
    """What each stage keeps, written and read again as the checker does."""
    docs, out = spark.read.parquet(f"{folder}/documents.parquet"), {}
    out["documents"] = docs
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp(name) / "out")
        stage(spark, docs, folder).write.parquet(path)
        docs = out[name] = spark.read.parquet(path)
    return out


def _ids(frame):
    return {r["doc_id"] for r in frame.select("doc_id").collect()}


def test_columns(stages):
    for name in ("quality", "jaccard", "decontamination", "pii"):
        assert stages[name].columns == stages["documents"].columns


def test_each_stage_judges_all_its_rows(spark, folder, stages):
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    before, after = _ids(stages["documents"]), _ids(stages["quality"])
    kept = [d in after for d in before if labels.get(d) == 1]
    gone = [d not in after for d in before if labels.get(d) == 0]
    assert sum(kept) >= 0.95 * len(kept) and sum(gone) >= 0.75 * len(gone)
    expected = {r["doc_id"] for r in jaccard.joined(stages["quality"], 80, 5).where("doc_id = component_id").collect()}
    assert _ids(stages["jaccard"]) == expected
    items = spark.read.parquet(f"{folder}/benchmark.parquet")
    leaked = _ids(decontamination.leaks(stages["jaccard"], items))
    assert _ids(stages["decontamination"]) == expected - leaked
    assert stages["pii"].count() == stages["decontamination"].count()
    left = pii.with_spans(stages["pii"]).select("base_spans").collect()
    assert all(not r["base_spans"] for r in left)


def test_tokens_are_those_of_the_kept_texts(spark, folder, stages):
    model = bpe.tokenizer(corpus_pipeline.public_tokenizers.path(corpus_pipeline.VOCABULARY))
    ids = {r["doc_id"]: bytes(r["ids"]) for r in stages["bpe"].collect()}
    texts = {r["doc_id"]: r["text"] for r in stages["pii"].collect()}
    assert {d: model.decode(i) for d, i in ids.items()} == texts
    whole = corpus_pipeline.run(spark, folder)
    assert {r["doc_id"]: bytes(r["ids"]) for r in whole.collect()} == ids


def test_odd_rows(spark, folder):
    rows = [(None, None, None, None, None), (1, "", "en", "s", 0), (2, "the stone and the water " * 20, "en", "s", 480), (2, "the stone and the water " * 20, "en", "s", 480)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in corpus_pipeline.STAGES[1:-1]:
        docs = stage(spark, docs, folder)
    assert sorted(str(r["doc_id"]) for r in docs.collect()) == ["1", "2", "None"]
    assert quality.THRESHOLD == 0.3
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), folder).count() == 0, name


def _first_of_groups(texts, n=5, percent=80):
    """Ids of the first text of each group of linked texts, by all pairs."""
    sets = {i: {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} for i, w in ((i, t.split()) for i, t in texts.items())}
    first = {i: i for i in texts}
    for a in sorted(sets):
        for b in sorted(sets):
            if a < b and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                low, high = sorted((first[a], first[b]))
                first = {i: low if f == high else f for i, f in first.items()}
    return {i for i, f in first.items() if i == f}


def test_near_copies_are_those_of_five_words_and_80_percent(spark, folder):
    """Edits that four words and 85 per cent let pass, and edits beyond both."""
    rnd, texts = random.Random(4), {}
    for n, places in ((100, [30, 70]), (1000, range(20, 965, 45)), (300, range(100, 122)), (100, [10, 30, 50]), (300, range(100, 160)), (100, [50])):
        words = [f"w{rnd.randrange(10**6)}" for _ in range(n)]
        changed = [f"x{k}" if k in set(places) else w for k, w in enumerate(words)]
        for w in (words, changed):
            texts[len(texts)] = " ".join(w)
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in texts.items()], "doc_id long, text string, lang string, source string, n_chars long")
    expected = _first_of_groups(texts)
    assert _ids(corpus_pipeline.distinct(spark, docs, folder)) == expected
    assert expected == {0, 2, 4, 6, 7, 8, 9, 10} and _first_of_groups(texts, 4, 85) == expected | {1, 3, 5}


def test_rows_are_told_apart_by_id_and_text(spark, folder):
    """A unique text stays though a copy has its id; of equal rows the least stays; columns called like results are kept."""
    text, other = " ".join(f"w{i}" for i in range(40)), " ".join(f"x{i}" for i in range(40))
    rows = [(1, text, 5.0, "a", "z"), (7, text, 6.0, "b", "z"), (7, other, 7.0, "c", "z"), (7, other, 7.0, "b", "z"), (None, text, 8.0, "d", None), (8, "", 9.0, None, "y"), (8, "", 9.0, None, "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score double, PREDICTED string, _leaks string")
    got = corpus_pipeline.distinct(spark, docs, folder)
    kept = [rows[0], rows[3], *rows[4:]]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(kept, key=str)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        found = stage(spark, docs, folder)
        assert found.columns == docs.columns, name
        told = {tuple(r)[2:] for r in found.collect()}
        assert told <= {r[2:] for r in rows}, name
    clean = corpus_pipeline.unleaked(spark, docs, folder)
    assert sorted(map(tuple, clean.collect()), key=str) == sorted(rows, key=str)
