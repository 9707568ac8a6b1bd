"""Near-duplicate vectors by dual traversal of cover trees: exact pairs above a cosine threshold.

Equal vectors are one point with a count. Points are dealt to cells around nodes of a cover tree that
is fitted on a bounded sample (every point is in a cell); cells that lie together in the tree make a
block, and each block gets a cover tree of its own: nested nodes at halving radii, each within its
parent. Pairs of blocks, and then pairs of nodes level by level, are dropped when even their covering
radii cannot bring two members within the threshold's distance; only children of pairs that are left
are looked at. The points of what is left at the leaves are compared, by single-precision products
first and the near ones in double precision. A block pair gives counts of links and a spanning
forest of them, not the pairs.

Where all distances are about equal, as between independent directions in many dimensions, no covering
radius rules anything out: then every pair of blocks is compared, which is quadratic in the number of points.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from termforge.llm import common
from termforge.llm.graph import components

THRESHOLD = 0.95
#: Points of a block at most, and blocks that a table of fewer points is cut into all the same.
BLOCK, LEAST_BLOCKS = 8192, 6
#: Sampled points for the upper levels, and at most so many cells.
SAMPLE, MAX_CELLS = 8192, 4096
#: Nodes of no more points are not split, nor those that would be split into nodes of less on average.
LEAF, LEAST_MEAN = 24, 8
#: Block pairs that share one copy of a block, at most.
GROUP = 16
#: Points whose comparisons are one matrix product.
ROWS = 256
#: Room for rounding in bounds that are computed in single precision.
SLACK = 2e-3


def reach_of(threshold: float) -> float:
    """Distance of unit vectors at the threshold."""
    return math.sqrt(max(0.0, 2 - 2 * threshold))


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distances of unit vectors, in single precision."""
    return np.sqrt(np.maximum(0, 2 - 2 * (a @ b.T)))


class CoverTree:
    """Nested nodes: the nodes of level l cover their points within 2 / 2**l, and lie in nodes of level l - 1.

    ``order`` lists the points so that every node is a slice of it. A level has, by node, the centre
    (a point), begin and end of the slice, the actual covering radius and the parent in the level before.
    Centres of one parent are more than the level's radius apart. Nodes of few points, of a radius up to
    ``smallest``, or of points so far apart that most would be nodes by themselves, stay as they are on
    deeper levels: a matrix product compares their points faster than nodes can rule them out.
    """

    def __init__(self, points: np.ndarray, smallest: float, leaf: int = LEAF, least_mean: int = LEAST_MEAN):
        n = len(points)
        self.order = np.arange(n)
        self.levels: list[tuple[np.ndarray, ...]] = []
        if not n:
            return
        away = distances(points, points[:1])[:, 0]  # of each point of ``order`` to its node's centre
        nodes, radius, whole = [(0, 0, n, float(away.max()), 0)], 2.0, set()
        while True:
            self.levels.append(tuple(np.array([x[i] for x in nodes], k) for i, k in enumerate((np.int64, np.int64, np.int64, np.float32, np.int64))))
            radius /= 2
            below, split = [], False
            for at, (centre, begin, end, wide, _) in enumerate(nodes):
                if end - begin <= leaf or wide <= smallest or wide <= radius or begin in whole:
                    split |= end - begin > leaf and wide > smallest and begin not in whole
                    below.append((centre, begin, end, wide, at))
                    continue
                own = self.order[begin:end]
                p, best, owner, chosen = points[own], away[begin:end].copy(), np.zeros(end - begin, np.int64), [centre]
                for i in np.flatnonzero(best > radius):
                    if best[i] <= radius:
                        continue
                    if len(chosen) * least_mean >= end - begin:
                        break
                    d = distances(p, p[i : i + 1])[:, 0]
                    closer = d < best
                    best[closer], owner[closer] = d[closer], len(chosen)
                    owner[i], best[i] = len(chosen), 0.0
                    chosen.append(int(own[i]))
                else:
                    split = True
                if len(chosen) * least_mean >= end - begin:
                    whole.add(begin)
                    below.append((centre, begin, end, wide, at))
                    continue
                sort = np.argsort(owner, kind="stable")
                self.order[begin:end], away[begin:end] = own[sort], best[sort]
                ends = begin + np.cumsum(np.bincount(owner, minlength=len(chosen)))
                for k, (a, b) in enumerate(zip([begin, *ends[:-1].tolist()], ends.tolist())):
                    if b > a:
                        below.append((chosen[k], a, b, float(away[a:b].max()), at))
            if not split:
                break
            nodes = below

    def packed(self) -> bytes:
        """The tree as bytes, for tasks that compare the block with others."""
        kinds = ("<i4", "<i4", "<i4", "<f4", "<i4")
        return pickle.dumps((self.order.astype("<i4"), [tuple(x.astype(k) for x, k in zip(level, kinds)) for level in self.levels]))

    @staticmethod
    def unpacked(raw: bytes) -> CoverTree:
        tree = CoverTree.__new__(CoverTree)
        tree.order, tree.levels = pickle.loads(raw)
        return tree


def near_nodes(p: np.ndarray, t: CoverTree, q: np.ndarray, u: CoverTree, reach: float) -> np.ndarray:
    """Dual traversal: which pairs of deepest nodes may hold two points within ``reach``."""
    if not t.levels or not u.levels:
        return np.zeros((0, 0), bool)
    alive, last = None, (-1, -1)
    for step in range(max(len(t.levels), len(u.levels))):
        at = min(step, len(t.levels) - 1), min(step, len(u.levels) - 1)
        (ca, _, _, ra, up), (cb, _, _, rb, vp) = t.levels[at[0]], u.levels[at[1]]
        if alive is None:
            now = np.ones((len(ca), len(cb)), bool)
        else:  # children of live pairs; a tree that has no deeper level stands still
            rows = up if at[0] != last[0] else np.arange(len(ca))
            cols = vp if at[1] != last[1] else np.arange(len(cb))
            now = alive[np.ix_(rows, cols)]
        for i in range(0, len(ca), 1024):
            live = np.flatnonzero(now[i : i + 1024].any(0))
            if len(live):
                far = distances(p[ca[i : i + 1024]], q[cb[live]]) - ra[i : i + 1024, None] - rb[None, live] > reach + SLACK
                now[i : i + 1024, live] &= ~far
        alive, last = now, at
    return alive


def lengths_of(x: np.ndarray) -> np.ndarray:
    """Lengths in double precision, without overflow or underflow of the squares."""
    largest = np.abs(x).max(1)
    y = x / largest[:, None]
    return np.sqrt((y * y).sum(1)) * largest


def unit(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(unit vectors in double, in single precision)."""
    x = x.astype(np.float64)
    x /= np.abs(x).max(1)[:, None]
    x /= np.sqrt((x * x).sum(1))[:, None]
    return x, x.astype(np.float32)


def joined_labels(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels after the nodes of each edge (a, b) have got the smaller label, and all that had the larger one."""
    while True:
        x, y = label[a], label[b]
        apart = x != y
        if not apart.any():
            return label
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        least = np.arange(len(label))
        np.minimum.at(least, np.maximum(x, y), np.minimum(x, y))
        while (nearer := least[least] != least).any():
            least[nearer] = least[least[nearer]]
        label = least[label]


def compare_blocks(x: np.ndarray, nx: np.ndarray, t: CoverTree, y: np.ndarray, ny: np.ndarray, u: CoverTree, same: bool, threshold: float):
    """(links of each x weighted by ny, links of each y weighted by nx, component label of x then y)."""
    (dx, p), (dy, q) = unit(x), unit(y)
    near = near_nodes(p, t, q, u, reach_of(threshold))
    cx, cy, shift = np.zeros(len(x), np.int64), np.zeros(len(y), np.int64), 0 if same else len(x)
    label = np.arange(len(x) + (0 if same else len(y)))
    if not near.any():
        return cx, cy, label
    (_, a0, a1, *_), (_, b0, b1, *_) = t.levels[-1], u.levels[-1]
    q = q[u.order]
    first = 0
    while first < len(a0):  # leaves of about ROWS points that follow each other in the tree
        stop = max(first + 1, int(np.searchsorted(a1, a0[first] + ROWS, side="right")))
        begin, end = int(a0[first]), int(a1[stop - 1])
        leaves = np.flatnonzero(near[first:stop].any(0))
        first = stop
        if same:  # each pair once: a row with what follows it
            leaves = leaves[b1[leaves] > begin]
        if not len(leaves):
            continue
        if b1[leaves[-1]] - b0[leaves[0]] == (b1[leaves] - b0[leaves]).sum():
            at = np.arange(b0[leaves[0]], b1[leaves[-1]])
        else:
            at = np.concatenate([np.arange(b0[j], b1[j]) for j in leaves])
        for lo in range(begin, end, ROWS):
            rows = t.order[lo : min(end, lo + ROWS)]
            cos = p[rows] @ (q[at[0] : at[-1] + 1] if at[-1] - at[0] + 1 == len(at) else q[at]).T
            hit = np.flatnonzero(cos.max(1) >= threshold - 1e-4)
            i, j = np.nonzero(cos[hit] >= threshold - 1e-4)
            i = hit[i]
            if same:
                i, j = i[keep := at[j] > lo + i], j[keep]
            for k in range(0, len(i), 100_000):
                r, c = rows[i[k : k + 100_000]], u.order[at[j[k : k + 100_000]]]
                link = np.einsum("ij,ij->i", dx[r], dy[c]) >= threshold
                r, c = r[link], c[link]
                cx += np.bincount(r, ny[c], len(x)).astype(np.int64)
                other = np.bincount(c, nx[r], len(y)).astype(np.int64)
                if same:
                    cx += other
                else:
                    cy += other
                label = joined_labels(label, r, c + shift)
    return cx, cy, label


def points_of(vectors: DataFrame, kind: str = "<f8") -> DataFrame:
    """vec_id, key (128 bits of the components and their number) and the vector as bytes of ``kind``.

    Vectors that are null, empty, zero or hold null or non-finite components have a null key.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, packed = [], []
            for v in batch.column(1):
                a = v.as_py()
                a = np.array([math.nan if c is None else c for c in a], kind) if a else np.empty(0)
                ok = len(a) and np.isfinite(a).all() and a.any()
                raw = (a + 0.0).tobytes() if ok else None  # -0.0 becomes 0.0
                keys.append(xxhash.xxh3_128_digest(raw) if ok else None)
                packed.append(raw)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(keys, pa.binary()), pa.array(packed, pa.binary())],
                names=["vec_id", "key", "vector"],
            )

    return vectors.select(F.col("vec_id").cast("long"), "embedding").mapInArrow(
        run, "vec_id long, key binary, vector binary"
    )


def cells_of(tree: CoverTree, most: int) -> list[int]:
    """Centres of up to ``most`` nodes that cover the tree, in its order: the widest nodes are split first."""
    chosen = {(0, 0)}
    children: dict[tuple[int, int], list[tuple[int, int]]] = {}
    for depth, level in enumerate(tree.levels[1:], 1):
        for i, up in enumerate(level[4].tolist()):
            children.setdefault((depth - 1, up), []).append((depth, i))
    size = lambda x: int(tree.levels[x[0]][2][x[1]] - tree.levels[x[0]][1][x[1]])
    while True:
        for x in sorted(chosen, key=lambda x: (-size(x), x)):
            if x in children and len(chosen) - 1 + len(children[x]) <= most:
                chosen.remove(x)
                chosen.update(children[x])
                break
        else:
            break
    return [int(tree.levels[d][0][i]) for d, i in sorted(chosen, key=lambda x: (int(tree.levels[x[0]][1][x[1]]), x))]


def cell_centres(points: DataFrame, cells: int, kind: str, sample: int = SAMPLE) -> dict[int, np.ndarray]:
    """Centres of the cells by dimension, neighbours in a cover tree of a bounded sample next to each other."""
    rows = points.orderBy(F.xxhash64("rep"), "rep").limit(sample).select("vector").toPandas()["vector"]
    by_dim: dict[int, list[np.ndarray]] = {}
    for raw in rows:
        v = np.frombuffer(raw, kind)
        by_dim.setdefault(len(v), []).append(v)
    out = {}
    for dim, vs in by_dim.items():
        p = unit(np.array(vs))[1]
        out[dim] = p[cells_of(CoverTree(p, 0.1), max(1, cells * len(vs) // len(rows)))]
    return out


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD, block: int = BLOCK) -> DataFrame:
    """vec_id, n_links, component_id, kept of every vector.

    ``vectors`` has vec_id (whole numbers, or text of whole numbers) and embedding; labels and other
    columns, whatever their names, are ignored. Vectors without a direction (null, empty, zero, null or
    non-finite components) and vectors of other dimensions link with nothing; equal vectors link with
    each other. Of repeated ids each row counts as a vector; rows with a null id are left out. An empty
    table gives no rows. Long vectors are compared whole.
    """
    spark = vectors.sparkSession
    element = vectors.schema["embedding"].dataType
    kind = "<f4" if isinstance(element, T.ArrayType) and isinstance(element.elementType, T.FloatType) else "<f8"
    vectors = common.spread(vectors.where("vec_id is not null"))
    rows = common.written(points_of(vectors, kind), "vectors")
    points = (
        rows.where("key is not null")
        .groupBy("key")
        .agg(F.min("vec_id").alias("rep"), F.count("*").alias("n"), F.first("vector").alias("vector"))
    )
    points = common.written(points, "points")
    total = points.count()
    block = max(1, min(block, -(-total // LEAST_BLOCKS)))
    centres = cell_centres(points, max(1, min(MAX_CELLS, 8 * total // block)), kind)
    first, names = {}, []  # of each dimension: the number of its first cell
    for dim in sorted(centres):
        first[dim] = len(names)
        names += [dim] * len(centres[dim])
    shared = spark.sparkContext.broadcast((centres, first))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centres, first = shared.value
        for batch in batches:
            raw = batch.column(2).to_pylist()
            dims = np.array([len(r) for r in raw], np.int64) // np.dtype(kind).itemsize
            cells = -dims  # a dimension that the sample does not have: one cell
            for dim in set(dims.tolist()) & set(centres):
                at = np.flatnonzero(dims == dim)
                for i in range(0, len(at), 1024):
                    part = at[i : i + 1024]
                    p = unit(np.frombuffer(b"".join(raw[k] for k in part), kind).reshape(len(part), dim))[1]
                    cells[part] = first[dim] + np.argmax(p @ centres[dim].T, axis=1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cells)], names=["rep", "n", "vector", "cell"])

    placed = points.select("rep", "n", "vector").mapInArrow(assign, "rep long, n long, vector binary, cell long")
    placed = common.written(placed, "placed")
    # at most MAX_CELLS rows, and one for each dimension beyond the sample's
    sizes = sorted(tuple(r) for r in placed.groupBy("cell").agg(F.count("*")).collect())
    dealt, held, number = [], 0, -1  # cell, its first block, the blocks it is dealt over
    for i, (cell, n) in enumerate(sizes):
        before = sizes[i - 1][0] if i else None
        joins = i and held + n <= block and cell >= 0 and before >= 0 and names[cell] == names[before]
        parts = -(-n // block)
        if joins:
            held += n
        else:
            number, held = number + 1, n if parts == 1 else block
        dealt.append((cell, number, parts))
        number += parts - 1
    blocks_of = F.broadcast(spark.createDataFrame(dealt or [(0, 0, 1)], "cell long, first long, parts long"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, ids, ns, vs = None, [], [], []

        def done() -> pa.RecordBatch:
            data = b"".join(vs)
            p = unit(np.frombuffer(data, kind).reshape(len(ids), -1))[1]
            tree = CoverTree(p, reach_of(threshold) / 4)
            raw = [np.array(ids, "<i8").tobytes(), np.array(ns, "<i8").tobytes(), data, tree.packed(), p[tree.levels[0][0][0]].tobytes()]
            return pa.RecordBatch.from_arrays(
                [pa.array([held]), *(pa.array([r], pa.binary()) for r in raw), pa.array([float(tree.levels[0][3][0])])],
                names=["block", "ids", "counts", "data", "tree", "centre", "radius"],
            )

        for batch in batches:
            for number, rep, n, v in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if number != held:
                    if ids:
                        yield done()
                    held, ids, ns, vs = number, [], [], []
                ids.append(rep)
                ns.append(n)
                vs.append(v)
        if ids:
            yield done()

    blocks = (
        placed.join(blocks_of, "cell")
        .select((F.col("first") + F.pmod(F.xxhash64("rep"), F.col("parts"))).alias("block"), "rep", "n", "vector")
        .repartition("block")
        .sortWithinPartitions("block")
        .mapInArrow(pack, "block long, ids binary, counts binary, data binary, tree binary, centre binary, radius double")
    )
    blocks = common.written(blocks, "blocks")
    # one centre and radius for up to BLOCK points
    tops = [(r[0], np.frombuffer(r[1], "<f4"), r[2]) for r in blocks.select("block", "centre", "radius").collect()]
    shared_tops = spark.sparkContext.broadcast(tops)
    group = max(1, min(GROUP, len(tops) ** 2 // (8 * spark.sparkContext.defaultParallelism)))

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tops = shared_tops.value
        for batch in batches:
            out = []
            for own, centre, radius in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist()):
                c, partners = np.frombuffer(centre.as_py(), "<f4"), []
                for other, d, r in tops:
                    mine = own == other or (own < other) == ((own + other) % 2 == 0)  # of two blocks one has the pair
                    if mine and len(d) == len(c) and distances(c[None], d[None])[0, 0] - radius - r <= reach_of(threshold) + SLACK:
                        partners.append(other)
                out += [(own, i // group, other) for i, other in enumerate(partners)]
            cols = list(zip(*out)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["own", "share", "block"])

    tasks = blocks.select("block", "centre", "radius").repartition("block").mapInArrow(meet, "own long, share long, block long")
    tasks = common.written(tasks, "tasks")
    data = ["ids", "counts", "data", "tree"]
    others = tasks.join(blocks, "block").select("own", "share", (F.col("own") != F.col("block")).alias("other"), "block", *data)
    alone = tasks.select("own", "share").distinct().join(tasks.where("own = block").select("own", "share"), ["own", "share"], "left_anti")
    alone = alone.join(blocks.withColumnRenamed("block", "own"), "own").select("own", "share", F.lit(False).alias("other"), F.lit(None).cast("long").alias("block"), *data)
    work = others.unionAll(alone).repartition(max(1, min(4096, tasks.select("own", "share").distinct().count())), "own", "share")
    work = work.sortWithinPartitions("own", "share", "other", "block")

    def traverse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, mine = None, None
        for batch in batches:
            for i in range(batch.num_rows):
                own, share, other, number = (batch.column(k)[i].as_py() for k in range(4))
                ids, n, vs, tree = (batch.column(k)[i].as_py() for k in range(4, 8))
                ids, n = np.frombuffer(ids, "<i8"), np.frombuffer(n, "<i8")
                it = ids, n, np.frombuffer(vs, kind).reshape(len(ids), -1), CoverTree.unpacked(tree)
                if not other:  # the group's own block comes first
                    key, mine = (own, share), it
                    if number is None:
                        continue
                assert key == (own, share)
                (a, na, x, t), (b, nb, y, u) = mine, it
                cx, cy, label = compare_blocks(x, na, t, y, nb, u, not other, threshold)
                every, counts = (np.concatenate([a, b]), np.concatenate([cx, cy])) if other else (a, cx)
                hit = np.flatnonzero(counts)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(every[hit]), pa.array(counts[hit]), pa.array(every[label[hit]])],
                    names=["rep", "links", "root"],
                )

    found = common.written(work.mapInArrow(traverse, "rep long, links long, root long"), "found")
    links = found.groupBy("rep").agg(F.sum("links").alias("links"))
    roots = components(found.select(F.col("rep").alias("u"), F.col("root").alias("v")))
    classes = (
        points.select("key", "rep", "n")
        .join(links, "rep", "left")
        .join(roots.withColumnRenamed("node", "rep"), "rep", "left")
        .select("key", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("root", "rep").alias("root"))
    )
    out = rows.select("vec_id", "key").join(classes, "key", "left")
    component = F.coalesce("root", "vec_id")
    return out.select(
        "vec_id",
        F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"),
        component.alias("component_id"),
        (F.col("vec_id") == component).alias("kept"),
    )
