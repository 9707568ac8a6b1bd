from __future__ import annotations

import math

import numpy as np

from termforge.llm import coverdedup


def brute(rows, threshold=0.95):
    ok = {}
    for k, (i, v) in enumerate(rows):
        if v and all(c is not None and math.isfinite(c) for c in v) and any(v):
            ok[k] = np.array(v, float) / max(map(abs, v))
    links = {k: [m for m in ok if m != k and len(ok[m]) == len(ok[k]) and ok[k] @ ok[m] / (np.linalg.norm(ok[k]) * np.linalg.norm(ok[m])) >= threshold] for k in ok}
    out = []
    for k, (i, _) in enumerate(rows):
        seen, queue = {k}, [k]
        while queue:
            for m in links.get(queue.pop(), []):
                if m not in seen:
                    seen.add(m)
                    queue.append(m)
        c = min(rows[m][0] for m in seen)
        out.append((i, len(links.get(k, [])), c, i == c))
    return sorted(out)


def test_against_brute_force(spark):
    rng = np.random.default_rng(2)
    rows = []
    for _ in range(40):
        centre = rng.normal(size=8)
        for _ in range(int(rng.integers(1, 9))):
            rows.append((centre + rng.normal(size=8) * rng.choice([0.05, 0.15, 0.3])).tolist())
    rows += [rows[0]] * 30 + [[2 * c for c in rows[0]]] + [rows[1]] * 2
    rows += [[1e-200 * c for c in rows[3]], [1e200 * c for c in rows[4]], [1e-310] * 8]
    rows += [None, [], [0.0] * 8, [float("nan")] + [1.0] * 7, [None] + [1.0] * 7, [float("inf")] + [1.0] * 7, [1.0, 0.0], [1.0, 0.01]]
    order = rng.permutation(len(rows))
    table = [(int(i), rows[k]) for i, k in enumerate(order)]
    df = spark.createDataFrame([(i, v, 1, "k") for i, v in table], "vec_id long, embedding array<double>, label int, key string")
    got = sorted(tuple(r) for r in coverdedup.near_duplicates(df, block=50).collect())
    assert got == brute(table)


def test_empty_and_null_ids(spark):
    df = spark.createDataFrame([(None, [1.0, 0.0]), (3, None)], "vec_id long, embedding array<double>")
    assert [tuple(r) for r in coverdedup.near_duplicates(df).collect()] == [(3, 0, 3, True)]
    assert coverdedup.near_duplicates(df.limit(0)).collect() == []


def test_traversal_keeps_every_near_pair():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(300, 6))
    y = np.concatenate([x[:100] + rng.normal(size=(100, 6)) * 0.1, rng.normal(size=(100, 6))])
    t, u = (coverdedup.CoverTree(coverdedup.unit(z)[1], 0.08, leaf=4) for z in (x, y))
    u = coverdedup.CoverTree.unpacked(u.packed())
    cx, cy, label = coverdedup.compare_blocks(x, np.ones(300, int), t, y, np.ones(200, int), u, False, 0.95)
    cos = (x @ y.T) / np.outer(np.linalg.norm(x, axis=1), np.linalg.norm(y, axis=1)) >= 0.95
    assert (cx == cos.sum(1)).all() and (cy == cos.sum(0)).all()


def test_traversal_keeps_points_that_changed_owner():
    """In two dimensions finer centres take points from coarse nodes that are far from the centre's own."""
    for seed in range(60):
        a = np.random.default_rng(seed).uniform(0, 2 * np.pi, 600)
        z = np.stack([np.cos(a), np.sin(a)], 1)
        x, y = z[z[:, 1] >= 0], z[z[:, 1] < 0]
        t, u = (coverdedup.CoverTree(coverdedup.unit(b)[1], 0.08, leaf=4) for b in (x, y))
        cx, cy, _ = coverdedup.compare_blocks(x, np.ones(len(x), int), t, y, np.ones(len(y), int), u, False, 0.95)
        cos = (x @ y.T) / np.outer(np.linalg.norm(x, axis=1), np.linalg.norm(y, axis=1)) >= 0.95
        assert (cx == cos.sum(1)).all() and (cy == cos.sum(0)).all(), seed


def test_two_dimensions_in_blocks(spark):
    a = np.random.default_rng(7).uniform(0, 2 * np.pi, 300)
    table = [(i, [float(np.cos(x)), float(np.sin(x))]) for i, x in enumerate(a)]
    df = spark.createDataFrame(table, "vec_id long, embedding array<double>")
    assert sorted(tuple(r) for r in coverdedup.near_duplicates(df, block=40).collect()) == brute(table)


def test_tree_is_nested_and_prunes():
    rng = np.random.default_rng(1)
    middles = rng.normal(size=(20, 16))
    x = np.concatenate([m + rng.normal(size=(60, 16)) * 0.02 for m in middles])
    p = coverdedup.unit(x)[1]
    t = coverdedup.CoverTree(p, 0.05, leaf=4)
    assert sorted(t.order.tolist()) == list(range(len(x)))
    for depth, (centre, begin, end, radius, up) in enumerate(t.levels):
        assert begin[0] == 0 and end[-1] == len(x) and (begin[1:] == end[:-1]).all()
        for c, a, b, r, k in zip(centre, begin, end, radius, up):
            d = coverdedup.distances(p[t.order[a:b]], p[c : c + 1])[:, 0]
            assert d.max() <= r + 1e-3 and c in t.order[a:b]
            if depth:
                assert t.levels[depth - 1][1][k] <= a and b <= t.levels[depth - 1][2][k]
    near = coverdedup.near_nodes(p, t, p, t, coverdedup.reach_of(0.95))
    sizes = t.levels[-1][2] - t.levels[-1][1]
    assert (near * np.outer(sizes, sizes)).sum() < 0.2 * len(x) ** 2


def test_many_blocks_of_single_precision(spark):
    rng = np.random.default_rng(9)
    middles = rng.normal(size=(30, 12))
    table = [(i, [float(np.float32(c)) for c in middles[rng.integers(30)] + rng.normal(size=12) * rng.choice([0.02, 0.2, 1])]) for i in range(500)]
    df = spark.createDataFrame(table, "vec_id long, embedding array<float>")
    assert sorted(tuple(r) for r in coverdedup.near_duplicates(df, block=25).collect()) == brute(table)
