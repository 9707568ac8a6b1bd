"""Hard negatives by vantage-point trees: for an anchor and a positive, near rows of other labels.

Scores are inner products of whole numbers. A vector x of a block whose longest has norm M becomes
x' = (x, sqrt(M^2 - |x|^2)), an anchor q becomes (q, 0): then |x' - q'|^2 = M^2 + |q|^2 - 2 (q . x), so the
highest score is the nearest row and a window of scores is an annulus around the anchor.

Rows are dealt to blocks: cells of a vantage-point tree that is fitted on a bounded sample, cut by hash
where a cell holds too many. Each block gets a vantage-point tree of its own, whose leaves know the least
and greatest distance of their rows from every vantage point above them. A group of anchors meets the
blocks one after another; in a block each anchor visits leaves nearest first, as far as the triangle
inequality lets a leaf reach into its annulus and hold something better than the rows it has, and the
rows of a leaf are compared exactly. First the positives (an annulus without an inner bound), then the
negatives of every different window.

The anchors are a stated set of queries against all rows, in blocks: the number of comparisons is anchors
times rows where no distance rules a leaf out, as between independent directions in many dimensions.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from termforge.llm import common

SCALE, POSITIVES, NEGATIVES, LOW, HIGH = 256, 5, 3, 50, 95
#: Rows of a block and of a leaf, anchors of a group; a block and a group hold at most so many bytes of components.
BLOCK, LEAF, GROUP, BYTES = 4096, 128, 1024, 16 << 20
#: Sampled rows for the cells, and their bytes at most.
SAMPLE, SAMPLE_BYTES = 4096, 32 << 20
#: Tasks for each core.
WAVES = 4
#: Room for rounding in bounds, relative.
ROOM = 1e-6
#: Scores outside of this range count as its ends.
MOST = (1 << 63) - 2
NONE, NO_ID = -(1 << 63), (1 << 63) - 1


def whole(vectors: list, scale: float = SCALE) -> np.ndarray:
    """floor(scale * x) of each component, as doubles that hold whole numbers."""
    return np.floor(scale * np.asarray(vectors, np.float64))


def products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact inner products of whole numbers; those beyond a long count as its ends."""
    if not q.size or not x.size:
        return np.zeros((len(q), len(x)), np.int64)
    if np.abs(q).max() * np.abs(x).max() * q.shape[1] < 2.0**53:
        return (q @ x.T).astype(np.int64)
    exact = np.array([[int(c) for c in r] for r in q], object) @ np.array([[int(c) for c in r] for r in x], object).T
    return np.clip(exact, -MOST, MOST).astype(np.int64)


def augmented(x: np.ndarray, top: float) -> np.ndarray:
    """Rows with the component that lifts them all to the norm ``top``."""
    return np.hstack([x, np.sqrt(np.maximum(0.0, top * top - (x * x).sum(1)))[:, None]])


def apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    d = a - b
    return np.sqrt((d * d).sum(-1))


class Tree:
    """A vantage-point tree of a block: rows in the order of leaves, and by id within a leaf.

    For leaf i and its j-th ancestor, rows lie between near[i, j] and far[i, j] from vantage point
    above[i, j]; missing ancestors are -1.
    """

    def __init__(self, ids: np.ndarray, labels: np.ndarray, rows: np.ndarray, leaf: int = LEAF):
        self.top = float(np.sqrt((rows * rows).sum(1).max(initial=0.0)))
        points = augmented(rows, self.top)
        vantage: list[int] = []
        leaves: list[tuple[np.ndarray, list[tuple[int, float, float]]]] = []
        todo = [(np.arange(len(rows)), [])] if len(rows) else []
        while todo:
            own, chain = todo.pop()
            d = None
            if len(own) > leaf:
                at = own[-1] if not vantage else own[int(np.argmax(apart(points[own], points[vantage[-1]])))]  # away from the last one
                d = apart(points[own], points[at])
                cut = np.median(d)
                inner = d <= cut if d.min() < cut or d.max() > cut else np.zeros(len(own), bool)
                if inner.all():
                    inner = d < cut
            if d is None or not np.isfinite(d).all() or not inner.any() or inner.all():  # equal rows are not split
                leaves.append((own, chain))
                continue
            vantage.append(int(at))
            for side in (inner, ~inner):
                todo.append((own[side], [*chain, (len(vantage) - 1, float(d[side].min()), float(d[side].max()))]))
        deep = max((len(c) for _, c in leaves), default=0)
        self.above = np.full((len(leaves), deep), -1, np.int64)
        self.near, self.far = np.zeros((len(leaves), deep)), np.full((len(leaves), deep), np.inf)
        for i, (_, chain) in enumerate(leaves):
            for j, (v, lo, hi) in enumerate(chain):
                self.above[i, j], self.near[i, j], self.far[i, j] = v, lo, hi
        order = [o[np.argsort(ids[o], kind="stable")] for o, _ in leaves]
        self.ends = np.cumsum([0, *map(len, order)])
        order = np.concatenate(order) if order else np.zeros(0, np.int64)
        self.vantage = rows[vantage]
        self.ids, self.labels, self.rows = ids[order], labels[order], rows[order]

    def reach(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """By anchor and leaf, scores that no row of the leaf can be above or below, with room for rounding."""
        square = self.top**2 + (q * q).sum(1)
        up = np.full((len(q), len(self.ends) - 1), np.inf)
        down = np.full_like(up, -np.inf)
        if not len(self.vantage) or not np.isfinite(square).all():
            return up, down
        d = np.sqrt(np.maximum(0.0, square[:, None] - 2 * (q @ self.vantage.T)))
        nearest, farthest = np.zeros_like(up), np.full_like(up, np.inf)
        for j in range(self.above.shape[1]):
            has = self.above[:, j] >= 0
            to = d[:, self.above[has, j]]
            nearest[:, has] = np.maximum(nearest[:, has], np.maximum(self.near[has, j] - to, to - self.far[has, j]))
            farthest[:, has] = np.minimum(farthest[:, has], to + self.far[has, j])
        room = 1 + ROOM * square[:, None]
        return (square[:, None] - nearest**2) / 2 + room, (square[:, None] - farthest**2) / 2 - room


class Search:
    """Windows of a group of anchors, each with the best rows that it has met: score and id, best first."""

    def __init__(self, q: np.ndarray, ids: np.ndarray, labels: np.ndarray, anchor: np.ndarray, low: np.ndarray, high: np.ndarray, k: int, same: bool):
        self.q, self.ids, self.labels, self.same = q, ids, labels, same
        self.anchor, self.low, self.high = anchor, low, high
        self.score, self.found = np.full((len(anchor), k), NONE, np.int64), np.full((len(anchor), k), NO_ID, np.int64)

    def visit(self, tree: Tree) -> None:
        up, down = tree.reach(self.q)
        order = np.argsort(-up, axis=1, kind="stable")
        here = np.arange(len(self.anchor))
        for step in range(order.shape[1]):
            leaf = order[self.anchor[here], step]
            ceiling = up[self.anchor[here], leaf]
            # leaves come nearest first: once one cannot hold a better row, none that follows can
            floor = np.maximum(self.low[here], self.score[here, -1]).astype(np.float64)
            going = ceiling >= floor - ROOM * np.abs(floor)
            here, leaf = here[going], leaf[going]
            if not len(here):
                return
            high = self.high[here].astype(np.float64)
            inside = down[self.anchor[here], leaf] <= high + ROOM * np.abs(high)
            for one in np.unique(leaf[inside]):
                self._compare(tree, one, here[inside & (leaf == one)])

    def _compare(self, tree: Tree, leaf: int, some: np.ndarray) -> None:
        a, b = tree.ends[leaf], tree.ends[leaf + 1]
        anchors, back = np.unique(self.anchor[some], return_inverse=True)
        scores = products(self.q[anchors], tree.rows[a:b])
        fits = (tree.labels[a:b] == self.labels[anchors, None]) == self.same
        if self.same:
            fits &= tree.ids[a:b] != self.ids[anchors, None]
        scores, fits = scores[back], fits[back]
        scores = np.where(fits & (scores >= self.low[some, None]) & (scores <= self.high[some, None]), scores, NONE)
        k = self.score.shape[1]
        line = np.arange(len(some))
        new_score, new_id = np.full((len(some), k), NONE, np.int64), np.full((len(some), k), NO_ID, np.int64)
        for j in range(min(k, b - a)):
            at = scores.argmax(1)  # of equal scores the first, which has the smallest id
            new_score[:, j] = scores[line, at]
            new_id[:, j] = np.where(new_score[:, j] > NONE, tree.ids[a + at], NO_ID)
            scores[line, at] = NONE
        both, of = np.hstack([self.score[some], new_score]), np.hstack([self.found[some], new_id])
        best = np.lexsort((of, ~both), axis=-1)[:, :k]  # ~ turns the order round without overflow
        self.score[some], self.found[some] = np.take_along_axis(both, best, 1), np.take_along_axis(of, best, 1)


def _matrix(flat: bytes, n: int) -> np.ndarray:
    values = np.frombuffer(flat, np.float64)
    return values.reshape(n, len(values) // n if n else 0)


_PACK = "dims int, part long, n int, ids binary, labels binary, rows binary, extra binary"


def _planted(table: pa.Table, scale: float) -> pa.Table:
    """A block's rows as its tree."""
    n, dims = len(table), table["dims"][0].as_py()
    flat = table["embedding"].combine_chunks().flatten().to_numpy(zero_copy_only=False)
    ids, labels = (table[c].to_numpy().astype(np.int64) for c in ("vec_id", "label"))
    tree = pickle.dumps(Tree(ids, labels, whole(flat.reshape(n, dims), scale)))
    empty = pa.array([b""], pa.binary())
    return pa.table({"dims": pa.array([dims], pa.int32()), "part": table["part"][:1].cast(pa.int64()), "n": pa.array([n], pa.int32()), "ids": empty, "labels": empty, "rows": empty, "extra": pa.array([tree], pa.binary())})


def _packed(table: pa.Table, scale: float) -> pa.Table:
    """A group's rows as one row of flat arrays."""
    order = np.argsort(table["vec_id"].to_numpy())
    table = table.take(pa.array(order))
    n, dims = len(table), table["dims"][0].as_py()
    flat = table["embedding"].combine_chunks().flatten().to_numpy(zero_copy_only=False)
    rows = whole(flat.reshape(n, dims), scale)
    columns = {"dims": pa.array([dims], pa.int32()), "part": table["part"][:1].cast(pa.int64()), "n": pa.array([n], pa.int32())}
    columns |= {"ids": pa.array([table["vec_id"].to_numpy().astype(np.int64).tobytes()], pa.binary()), "labels": pa.array([table["label"].to_numpy().astype(np.int64).tobytes()], pa.binary()), "rows": pa.array([rows.tobytes()], pa.binary())}
    windows = table["windows"].to_pylist() if "windows" in table.column_names else []
    flat = [(i, s) for i, w in enumerate(windows) for s in w]
    columns["extra"] = pa.array([np.array(flat, np.int64).reshape(-1, 2).tobytes()], pa.binary())
    return pa.table(columns)


def packs(rows: DataFrame, scale: float, make=_packed) -> DataFrame:
    """Groups (dims, part) of ``rows`` with vec_id, label, embedding, dims, part, and maybe windows, as one row each.

    ``_parts`` keeps groups small.
    """
    return rows.groupBy("dims", "part").applyInArrow(lambda t: make(t, scale), _PACK)


def _parts(rows: DataFrame, key: list[str], most: int) -> DataFrame:
    """``rows`` with part: groups of about ``most`` rows (fewer where vectors are long) of each key, by hash of the id."""
    counts = common.written(rows.groupBy(*key).agg(F.count("*").alias("_n")), "groups")
    fits = F.greatest(F.lit(1.0), F.least(F.lit(float(most)), F.lit(float(BYTES)) / (8 * F.greatest("dims", F.lit(1)))))
    sizes = counts.select(*key, F.ceil(F.col("_n") / fits).cast("int").alias("_parts"))
    hashed = F.xxhash64("vec_id", *key)
    out = rows.join(common.small_broadcast(sizes), key)
    return out.withColumn("part", F.xxhash64(*key, F.pmod(hashed, F.col("_parts")))).drop("_parts")


def _cells(rows: DataFrame, n: int, most: int, scale: float) -> DataFrame:
    """``rows`` with cell: their place in a vantage-point tree on a bounded sample, about one for each ``most`` rows.

    The sample's rows, SAMPLE or SAMPLE_BYTES at most, are those with the smallest hash of their id.
    """
    depth = max(0, math.ceil(math.log2(max(1, n / most))))
    dims = rows.agg(F.max("dims")).first()[0] or 1
    take = max(1, min(SAMPLE, SAMPLE_BYTES // (8 * max(1, dims))))
    depth = min(depth, int(math.log2(take)) - 3 if take >= 16 else 0)
    if depth <= 0:
        return rows.withColumn("cell", F.lit(0))
    sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(take).select("embedding").collect()
    splits: dict[int, dict[int, tuple[np.ndarray, float, float]]] = {}
    of_dims: dict[int, list] = {}
    for r in sample:
        of_dims.setdefault(len(r.embedding), []).append(r.embedding)
    for d, vectors in of_dims.items():
        x = whole(vectors, scale)
        top = float(np.sqrt((x * x).sum(1).max(initial=0.0)))
        if not d or not math.isfinite(top):
            continue
        points, nodes = augmented(x, top), {}
        todo = [(1, np.arange(len(x)))]
        while todo:
            node, own = todo.pop()
            if node >= 1 << depth or len(own) < 2:
                continue
            at = own[int(np.argmax(apart(points[own], points[own[0]])))]
            dist = apart(points[own], points[at])
            cut = float(np.median(dist))
            nodes[node] = (points[at], cut)
            todo += [(2 * node, own[dist <= cut]), (2 * node + 1, own[dist > cut])]
        splits[d] = (top, nodes)

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims, cell = batch.column("dims").to_numpy(), np.zeros(batch.num_rows, np.int64)
            for d in set(dims.tolist()) & splits.keys():
                here = np.flatnonzero(dims == d)
                top, nodes = splits[d]
                flat = batch.column("embedding").take(pa.array(here)).flatten().to_numpy(zero_copy_only=False)
                points, node = augmented(whole(flat.reshape(len(here), d), scale), top), np.ones(len(here), np.int64)
                for _ in range(depth):
                    for one in np.unique(node):
                        if one in nodes:
                            at = node == one
                            far = apart(points[at], nodes[one][0]) > nodes[one][1]
                            node[at] = 2 * one + far
                cell[here] = node
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell)], names=[*batch.schema.names, "cell"])

    schema = ", ".join(f"{c} {t}" for c, t in rows.dtypes) + ", cell long"
    return rows.mapInArrow(placed, schema)


def _searched(anchors: DataFrame, blocks: DataFrame, k: int, same: bool) -> DataFrame:
    """(anchor_id, window, vec_id, score): the ``k`` best rows of every window in every task.

    Every group of anchors meets every block of its dimension: blocks are dealt into chunks, and a task
    holds one group and reads the blocks of one chunk, one at a time.
    """
    spark = anchors.sparkSession
    groups = common.small_broadcast(anchors.select("dims", F.col("part").alias("group")))
    n_groups, n_blocks = max(1, groups.count()), max(1, blocks.count())
    chunks = max(1, min(n_blocks, math.ceil(WAVES * spark.sparkContext.defaultParallelism / n_groups)))
    chunk = F.pmod(F.xxhash64("part", F.lit(1)), F.lit(chunks)).cast("int")
    left = anchors.select(F.col("part").alias("group"), F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))).alias("chunk"), F.lit(0).alias("kind"), *anchors.columns)
    right = blocks.join(groups, "dims").select("group", chunk.alias("chunk"), F.lit(1).alias("kind"), *anchors.columns)
    tasks = left.unionAll(right).repartition(min(n_groups * chunks, 20_000), "group", "chunk").sortWithinPartitions("group", "chunk", "kind", "part")

    def out(s: Search) -> pa.RecordBatch:
        at, j = np.nonzero(s.score > NONE)
        window = s.low[at] if s.same else s.window[at]
        return pa.RecordBatch.from_arrays([pa.array(s.ids[s.anchor[at]]), pa.array(window), pa.array(s.found[at, j]), pa.array(s.score[at, j])], names=["anchor_id", "window", "vec_id", "score"])

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = None
        for batch in batches:
            for r in batch.to_pylist():
                if r["kind"] == 0:
                    ids, labels, rows = np.frombuffer(r["ids"], np.int64), np.frombuffer(r["labels"], np.int64), _matrix(r["rows"], r["n"])
                    if search is not None:
                        yield out(search)
                    n = len(ids)
                    if same:
                        search = Search(rows, ids, labels, np.arange(n), np.full(n, -MOST), np.full(n, MOST), k, True)
                    else:
                        window = np.frombuffer(r["extra"], np.int64).reshape(-1, 2)
                        s = window[:, 1]
                        # LOW s <= 100 x <= HIGH s, in whole numbers and without overflow
                        low = s // 100 * LOW - (-(s % 100) * LOW) // 100
                        high = s // 100 * HIGH + s % 100 * HIGH // 100
                        search = Search(rows, ids, labels, window[:, 0], low, high, k, False)
                        search.window = s
                else:
                    search.visit(pickle.loads(r["extra"]))
        if search is not None:
            yield out(search)

    best = tasks.mapInArrow(found, "anchor_id long, window long, vec_id long, score long")
    order = Window.partitionBy("anchor_id", "window").orderBy(F.desc("score"), F.asc("vec_id"))
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def usable(rows: DataFrame, anchor: Column) -> DataFrame:
    """vec_id, label, embedding (doubles), dims, anchor: rows that take part, one of each id.

    Left out are null ids, labels and vectors, and vectors with a null or non-finite component. Of
    repeated ids the row with the smallest label and vector stays.
    """
    good = F.forall("embedding", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    own = rows.where("vec_id is not null and label is not null and embedding is not null").where(good)
    own = own.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.col("embedding").cast("array<double>").alias("embedding"), anchor.alias("anchor"))
    twice = common.written(own.groupBy("vec_id").agg(F.count("*").alias("_n")).where("_n > 1").select("vec_id"), "repeated-ids")
    if not twice.isEmpty():
        twice = common.small_broadcast(twice)
        first = own.join(twice, "vec_id", "left_semi").groupBy("vec_id").agg(F.min(F.struct("label", "embedding", "anchor")).alias("r"))
        own = own.join(twice, "vec_id", "left_anti").unionByName(first.select("vec_id", "r.*"))
    return own.withColumn("dims", F.size("embedding"))


def mine(rows: DataFrame, anchor: Column, positives: int = POSITIVES, negatives: int = NEGATIVES, scale: float = SCALE) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    ``rows`` has vec_id, label (whole numbers) and embedding; ``anchor`` tells which rows are anchors. The
    score of two rows is the inner product of floor(scale * x); higher ones come first, ties by smaller
    id. An anchor's positives are its first ``positives`` other rows of its label; for each, its first
    ``negatives`` rows of other labels with 50 positive <= 100 negative <= 95 positive are returned.

    See ``usable`` for rows that take no part and repeated ids. Vectors meet those of as many components;
    equal vectors are ordinary. Scores beyond a long count as its ends. Other columns do not matter, and
    an empty table gives no rows. Results are exact.
    """
    spark = rows.sparkSession
    own = common.written(usable(rows, anchor), "vectors")
    n = own.count()
    cells = _cells(common.spread(own.select("vec_id", "label", "embedding", "dims")), n, BLOCK, scale)
    cells = common.written(cells, "cells")
    blocks = common.written(packs(_parts(cells, ["dims", "cell"], BLOCK), scale, _planted), "blocks")
    anchors = common.written(_parts(own.where("anchor").drop("anchor"), ["dims"], GROUP), "anchors")
    near = _searched(common.written(packs(anchors, scale), "groups"), blocks, positives, True)
    near = common.written(near.select("anchor_id", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")), "positives")
    windows = near.groupBy("anchor_id").agg(F.collect_set("positive_score").alias("windows"))  # at most ``positives`` of each anchor
    asked = anchors.join(windows, anchors["vec_id"] == windows["anchor_id"]).drop("anchor_id")
    far = _searched(common.written(packs(asked, scale), "windows"), blocks, negatives, False)
    far = far.select("anchor_id", F.col("window").alias("positive_score"), F.col("rank").cast("int").alias("rank"), F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
    return near.join(far, ["anchor_id", "positive_score"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
