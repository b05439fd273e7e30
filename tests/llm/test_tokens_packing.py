import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from reckon.llm import bpe, packing, token_counts

ODD = [None, "", "   ", "Don't stop, <|endoftext|> now", "ΣΑΣ ΟΔΟΣ", "日本語 テスト", "a\x1cb\x85c\xa0d", "½ ²x ẞ İ", "😀👍🏽", "word " * 5000, "x" * 3000, "same", "same"]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i if i != 3 else None, t, "clash") for i, t in enumerate(ODD)], "doc_id long, text string, n_tokens string")


def test_counts_match_the_library(spark, docs):
    tok = Tokenizer.from_file(bpe.default_path())
    want = sorted((len((t or "").encode()), n := len(tok.encode(t or "", add_special_tokens=False).ids), n > 2048) for t in ODD)
    got = token_counts.token_counts(docs).collect()
    assert sorted((r.n_bytes, r.n_tokens, r.over_limit) for r in got) == want


def test_empty_tables(spark, docs):
    assert token_counts.token_counts(docs.limit(0)).count() == 0
    assert packing.pack(docs.limit(0)).count() == 0


def test_packing_holds_each_id_once(spark, docs):
    tok = Tokenizer.from_file(bpe.default_path())
    rows = [r.asDict() for r in packing.pack(docs.repartition(2), size=64).collect()]
    want = sorted((zlib.crc32(np.array(i, "<u4").tobytes()), len(i)) for t in ODD for i in [[*tok.encode(t or "", add_special_tokens=False).ids, 1]] if len(i) <= 64)
    assert sorted((r["ids_crc32"], r["length"]) for r in rows if r["doc_tokens"] <= 64) == want
    assert sum(r["length"] for r in rows) == sum(len(tok.encode(t or "", add_special_tokens=False).ids) + 1 for t in ODD)
    sequences = {}
    for r in rows:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for pieces in sequences.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 64


def test_packing_depends_on_the_rows_alone(spark, monkeypatch):
    monkeypatch.setattr(packing, "RUN_PIECES", 150)
    rng = random.Random(3)
    rows = [(i % 300, " ".join(rng.choice("abc def ghi".split()) for _ in range(rng.choice([0, 3, 40, 200])))) for i in range(400)] + [(None, "same text")] * 60
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    key = lambda r: tuple((x is not None, x) for x in r)
    found = [sorted(packing.pack(d, size=64).collect(), key=key) for d in (docs.coalesce(1), docs.repartition(7), docs.orderBy("text").repartition(3))]
    assert found[0] == found[1] == found[2]
    runs = {r.sequence_id >> 40 for r in found[0]}
    windows = {r.sequence_id for r in found[0]}
    assert len(runs) > 2 and sum(r.length for r in found[0]) > 64 * (len(windows) - 2 * len(runs)) * 0.98
    assert len({r.sequence_id >> 40 for r in found[0] if r.doc_id is None}) > 1


def test_best_fit_is_the_tightest_window():
    rng = random.Random(1)
    for _ in range(30):
        size = rng.choice([7, 16, 100])
        lengths = [rng.randint(1, size) for _ in range(rng.randint(0, 80))]
        window, offset, made = packing.best_fit_decreasing(lengths, size)
        room = []
        for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
            fits = [c for c in room if c >= lengths[i]]
            c = min(fits) if fits else size
            assert size - offset[i] == c
            if fits:
                room.remove(c)
            room.append(c - lengths[i])
        assert made == len(room)
