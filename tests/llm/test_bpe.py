from __future__ import annotations

import random
import struct

import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from dossier.llm import bpe

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def _same(library, text):
    model = bpe.tokenizer(PATH)
    ids = model.encode(text)
    assert list(struct.unpack(f"<{len(ids) // 4}I", ids)) == library.encode(text, add_special_tokens=False).ids
    assert model.decode(ids) == text


def test_random_texts_equal_the_library(library):
    rnd = random.Random(1)
    letters = "abcdeé ß\n\t 's1٣2中文!?_-   \x1c\x0b<|endoftext|>😀ñıⅷ²​\u0558𖺠"
    for i in range(3000):
        text = "".join(rnd.choice(letters) for _ in range(rnd.randint(0, 30)))
        _same(library, text[:5] + "<|endoftext|>" + text[5:] if i % 7 == 0 else text)


@pytest.mark.parametrize("text", ["a" * 3000, "ab" * 2000, "中" * 1500, "The quick " * 300, "x" * (bpe.SCAN_PARTS + 1), "x" * bpe.SCAN_PARTS])
def test_long_pieces_equal_the_library(library, text):
    _same(library, text)


def test_scan_and_heap_agree():
    model, rnd = bpe.tokenizer(PATH), random.Random(2)
    for _ in range(500):
        parts = [model.single[rnd.choice(b"abcdehinort ")] for _ in range(rnd.randint(0, 60))]
        assert model._by_scan(list(parts)) == model._by_heap(list(parts))


def test_frame_keeps_every_row(spark):
    rows = [(1, "one two", "x"), (1, "one two", "x"), (None, None, None), (3, "", "y"), (4, "a<|endoftext|>b", "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    got = bpe.encoded(docs, PATH).collect()
    assert len(got) == len(rows)
    assert {(r["doc_id"], r["n_tokens"], r["decoded"]) for r in got} == {(1, 2, "one two"), (None, 0, ""), (3, 0, ""), (4, 3, "a<|endoftext|>b")}
    assert bpe.encoded(docs.limit(0), PATH).count() == 0


def test_a_task_holds_parts_of_a_batch_and_leaves_no_pieces_behind(library):
    """The worker lives on and serves other stages, whose memory the tables of pieces would take."""
    rnd = random.Random(3)
    texts = [None, "", *(" ".join(f"w{rnd.randrange(10**6)}" for _ in range(40_000)) for _ in range(12)), "end"]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(texts)], names=["doc_id", "text"])
    parts = list(bpe.encoded_batches([batch, batch.slice(0, 0)], PATH))
    assert len(parts) > 2
    rows = [r for part in parts for r in part.to_pylist()]
    assert [(r["doc_id"], r["decoded"]) for r in rows] == [(i, t or "") for i, t in enumerate(texts)]
    assert [r["n_tokens"] for r in rows] == [len(library.encode(t or "", add_special_tokens=False).ids) for t in texts]
    model = bpe.tokenizer(PATH)
    assert not model.pieces and not model.earlier
