from __future__ import annotations

import itertools
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from termforge.llm import packing


@pytest.fixture(scope="module")
def reference():
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return lambda text: [*t.encode(text or "", add_special_tokens=False).ids, 0]


def test_ids_equal_the_tokenizer_files(reference):
    enc = packing.encoder(packing.default_ranks_path())
    texts = ["", "a", " a  b\n\n c \t", "I'll we've 'S don't 123 4५", "ß Äöü ça İı ﬁ ½ ² 你好", "x" * 3000, "<|endoftext|> end", "  <|endoftext|>  \n<|endoftext|><|endoftext|", "a \n <|endoftext|>b", "<|ENDOFTEXT|>", "\u00a0 \u2003x \x1c y\u0301", "   ", "\r\n a", "🙂🙂 !!?? $$$ --"]
    for t in texts:
        assert packing.encode(enc, t).tolist() == reference(t)
    assert packing.encode(enc, None).tolist() == [0]


def test_round_trip(spark, reference):
    rng = np.random.default_rng(1)
    texts = [" ".join(f"word{n}" for n in rng.integers(0, 99, k)) for k in rng.integers(0, 900, 60)]
    docs = [*enumerate(texts, 1), (100, None), (101, ""), (102, texts[0]), (None, "x y")]
    df = spark.createDataFrame([(i, t, 3, 4) for i, t in docs], "doc_id long, text string, salt int, length int")
    rows = packing.pack(df).collect()
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    assert set(by_doc) == {i for i, _ in docs}
    for i, t in docs:
        ids, at = np.array(reference(t), "<u4"), 0
        for r in sorted(by_doc[i], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids) and r.length > 0
            assert r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    for pieces in by_sequence.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= packing.WINDOW
    total = sum(r.length for r in rows)
    assert len(by_sequence) <= -(-total // packing.WINDOW) + 4


def test_repeated_rows_and_empty(spark):
    df = spark.createDataFrame([(1, "a b"), (1, "a b")], "doc_id long, text string")
    rows = packing.pack(df).collect()
    assert len(rows) == 2 and len({(r.sequence_id, r.offset) for r in rows}) == 2
    assert packing.pack(df.limit(0)).collect() == []


def test_fullest_subset_is_best():
    rng = np.random.default_rng(0)
    for _ in range(60):
        counts = {int(n): int(rng.integers(1, 4)) for n in rng.integers(1, 40, 4)}
        room = int(rng.integers(1, 80))
        items = [n for n, c in counts.items() for _ in range(c)]
        best = max(s for k in range(len(items) + 1) for x in itertools.combinations(items, k) if (s := sum(x)) <= room)
        chosen = packing.fullest_subset(counts, room)
        assert sum(n * k for n, k in chosen.items()) == best
        assert all(k <= counts[n] for n, k in chosen.items())


def test_plan_uses_everything_once():
    histogram = {1023: 3, 1000: 50, 24: 40, 500: 7, 1: 10, 1024: 9}
    used = {}
    for chosen, times in packing.plan_windows(histogram):
        assert sum(n * k for n, k in chosen.items()) <= 1024
        for n, k in chosen.items():
            used[n] = used.get(n, 0) + k * times
    assert used == histogram
