from __future__ import annotations

import math

import numpy as np

from pyspark.sql import functions as F

from termforge.llm import hardneg


def brute(rows, anchors):
    ok = {}
    for i, v, g in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[2] is None, r[2] or 0, repr(r[1]))):
        if i is not None and g is not None and v is not None and all(c is not None and math.isfinite(c) for c in v):
            ok.setdefault(i, ([math.floor(256 * c) for c in v], g))
    out = []
    for a in (i for i in ok if anchors(i)):
        others = sorted((-sum(x * y for x, y in zip(ok[a][0], v)), i) for i, (v, _) in ok.items() if i != a and len(v) == len(ok[a][0]))
        for ps, p in [(-s, i) for s, i in others if ok[i][1] == ok[a][1]][:5]:
            near = [(-s, i) for s, i in others if ok[i][1] != ok[a][1] and 50 * ps <= -100 * s <= 95 * ps][:3]
            out += [(a, p, k, i, min(ps, hardneg.MOST), min(s, hardneg.MOST)) for k, (s, i) in enumerate(near, 1)]
    return sorted(out)


def run(spark, rows, partitions=5):
    df = spark.createDataFrame([(i, v, g, "k", 1) for i, v, g in rows], "vec_id long, embedding array<double>, label int, score string, dims int").repartition(partitions)
    return sorted(tuple(r) for r in hardneg.mine(df, F.col("vec_id") % 50 == 0).collect())


def vectors(n, dims, seed, spread=0.3):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(12, dims))
    return [(int(i), (centres[i % 12] * rng.choice([0.5, 1, 2]) + rng.normal(size=dims) * spread).tolist(), int(rng.integers(0, 4))) for i in range(n)]


def test_against_brute_force_in_many_blocks(spark, monkeypatch):
    for name, value in (("BLOCK", 60), ("LEAF", 7), ("GROUP", 9)):
        monkeypatch.setattr(hardneg, name, value)
    rows = vectors(1200, 6, 1)
    assert run(spark, rows) == brute(rows, lambda i: i % 50 == 0)


def test_leaves_are_ruled_out(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(16, 8)) * 20
    x = hardneg.whole((centres[rng.integers(0, 16, 4000)] + rng.normal(size=(4000, 8)) * 0.05).tolist())
    tree = hardneg.Tree(np.arange(4000), np.zeros(4000, np.int64), x)
    up, down = tree.reach(x[:50])
    s = hardneg.products(x[:50], tree.rows)
    for i, (a, b) in enumerate(zip(tree.ends, tree.ends[1:])):
        assert (s[:, a:b].max(1) <= up[:, i]).all() and (s[:, a:b].min(1) >= down[:, i]).all()
    fifth = np.sort(s, axis=1)[:, -5]
    assert (up >= fifth[:, None]).mean() < 0.5


def test_copies_ties_and_odd_rows(spark, monkeypatch):
    for name, value in (("BLOCK", 40), ("LEAF", 8), ("GROUP", 5)):
        monkeypatch.setattr(hardneg, name, value)
    rows = vectors(300, 4, 2)
    rows += [(1000 + i, rows[3][1], i % 3) for i in range(200)]  # a third of all
    rows += [(1050, rows[3][1], 0), (1050, rows[4][1], 0), (100, None, 1), (None, [1.0] * 4, 1), (2000, [1.0] * 4, None)]
    rows += [(2050, [1.0, None, 1.0, 1.0], 1), (2051, [float("nan")] * 4, 1), (2100, [], 1), (2101, [], 1), (2102, [], 2), (2150, [1.0, 2.0], 1), (2151, [3.0, 2.0], 1), (2152, [1.5, 1.0], 2)]
    rows += [(2200, [0.0] * 4, 1), (-50, [-1.0, 0.1, 0.0, 0.2], 1), (2300, [-5.0, 0.0, 0.0, 0.0], 9), (2301, [5.0, 0.0, 0.0, 0.0], 9)]
    assert run(spark, rows) == brute(rows, lambda i: i % 50 == 0)


def test_scores_beyond_doubles_are_exact(spark):
    rng = np.random.default_rng(5)
    rows = [(int(i), (rng.normal(size=3) * 1e6).tolist(), int(i) % 2) for i in range(120)]
    assert run(spark, rows) == brute(rows, lambda i: i % 50 == 0)
    huge = [(50 * i, [1e200, 1.0 * i], i % 2) for i in range(4)]
    assert [r[5] for r in run(spark, huge)] == []


def test_empty(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert hardneg.mine(df, F.col("vec_id") % 50 == 0).collect() == []
