from __future__ import annotations

import math
import random
from collections import Counter

import pytest

from termforge.functions import ngrams
from termforge.operators import langmodel
from termforge.sources.sinks import prediction_lines


@pytest.fixture(scope="module")
def model(spark):
    train = spark.createDataFrame([("x", "abcd"), ("x", "abcde"), ("y", "bcdef"), (None, "zzzz")], "lang string, text string")
    counts = langmodel.gram_counts(train).cache()
    return counts, langmodel.probabilities(counts).cache()


def test_probabilities(model):
    counts, p = model
    assert {r.lang: r.total for r in langmodel.totals(counts).collect()} == {"x": 6, "y": 5}
    got = {(r.lang, r.gram): r.p for r in p.collect()}
    assert got == {
        ("x", "abcd"): 3 / 6, ("x", "bcde"): 2 / 6, ("x", "cdef"): 1 / 6,
        ("y", "abcd"): 1 / 5, ("y", "bcde"): 2 / 5, ("y", "cdef"): 2 / 5,
    }
    for lang in "xy":
        assert sum(v for (a, _), v in got.items() if a == lang) == pytest.approx(1)


def test_predictions(spark, model):
    lines = [(1, "abcde"), (2, "bcdef"), (3, "zzzz"), (4, "abc"), (5, "abcdzzzz"), (6, None)]
    tests = spark.createDataFrame(lines, "line_no long, text string")
    got = langmodel.predict(tests, model[0])
    assert {r.line_no: r.label for r in got.collect()} == {1: "x", 2: "y", 3: "other", 4: "other", 5: "x", 6: "other"}
    out = {r.line_no: r.line for r in prediction_lines(tests, got).collect()}
    assert out[1] == "x abcde" and out[4] == "other abc"


@pytest.mark.parametrize("most", [10**6, 40, 0])
def test_split_models_score_alike(spark, most):
    """Few or no grams are broadcast: scores are those of the whole table of grams and languages."""
    rng = random.Random(1)
    text = lambda n, letters: "".join(rng.choice(letters) for _ in range(n))
    train = [(lang, text(60, letters)) for lang, letters in (("x", "aab"), ("y", "abc"), ("z", "bcd")) for _ in range(20)] + [("x", "aaaa" * 200)]
    lines = [(i, text(rng.randint(0, 30), "abcde")) for i in range(60)] + [(60, "aaaa" * 500), (61, None)]
    counts = langmodel.gram_counts(spark.createDataFrame(train, "lang string, text string")).cache()
    if most == 40:
        assert 1 < langmodel.frequent_from(counts.groupBy("gram").agg({"n": "sum"}).withColumnRenamed("sum(n)", "total"), most)
    p = {(r.lang, r.gram): r.p for r in langmodel.probabilities(counts).collect()}
    got = {(r.line_no, r.lang): r.score for r in langmodel.line_scores(spark.createDataFrame(lines, "line_no long, text string"), counts, most=most).collect()}
    expected = {}
    for i, t in lines:
        grams = [t[k : k + 4] for k in range(len(t) - 3)] if t else []
        known = [g for g in grams if ("x", g) in p]
        for lang in "xyz" if known else "":
            expected[i, lang] = sum(round(math.log(p[lang, g]) * 1e10) for g in known) / 1e10
    assert got.keys() == expected.keys()
    assert all(got[k] == pytest.approx(expected[k], abs=1e-6) for k in got)


def test_grams_are_of_characters(spark):
    """A window starts at every character, never inside one beyond the 16-bit range; null and short lines have none."""
    lines = [("x", "a\U0001f600bcd\U0001f600bcd"), ("x", ""), ("y", None), ("y", "abc"), ("y", "ñandú\n\u4e2d\u6587abcd"), (None, "bcde")]
    got = {(r.lang, r.gram): r.n for r in langmodel.gram_counts(spark.createDataFrame(lines, "lang string, text string")).collect()}
    assert got == Counter((lang, t[k : k + 4]) for lang, t in lines if lang and t for k in range(len(t) - 3))


def test_a_task_sums_up_its_lines(monkeypatch):
    """What leaves a task grows with its different grams, not with its lines; both ways to tell grams apart agree."""
    import pyarrow as pa

    rng = random.Random(2)
    lines = ["".join(rng.choice("abé\U0001f600\u4e2d") for _ in range(rng.randint(0, 9))) for _ in range(300)]
    keys = pa.array([i % 3 for i in range(len(lines))])
    for n in (1, 2, 4):
        expected = Counter((i % 3, t[k : k + n]) for i, t in enumerate(lines) for k in range(len(t) - n + 1))
        for table in (1 << 25, 0):
            monkeypatch.setattr(ngrams, "TABLE", table)
            by, grams, numbers = ngrams.counted(keys, lines, n)
            assert len(grams) == len(expected) and dict(zip(zip(by.to_pylist(), grams), numbers.tolist())) == expected
    twice = pa.RecordBatch.from_arrays([pa.array(["x"] * 1000), pa.array(["abcdef"] * 1000)], names=["key", "text"])
    assert [len(ngrams.counted(k, t, 4)[1]) for k, t in ngrams.blocks([twice, twice])] == [3]


def test_repeated_and_null_keys(spark):
    """Lines of one key are added up."""
    counts = spark.createDataFrame([("x", "abcd", 5), ("y", "bcde", 1)], "lang string, gram string, n long")
    lines = spark.createDataFrame([(1, "abcd"), (1, "abcdabcd"), (None, "abcd")], "line_no long, text string")
    got = {(r.line_no, r.lang): r.score for r in langmodel.line_scores(lines, counts).collect()}
    p = {"x": math.log(6 / 7), "y": math.log(1 / 3)}
    assert got == pytest.approx({(k, lang): n * p[lang] for k, n in ((1, 3), (None, 1)) for lang in p}, abs=1e-9)
