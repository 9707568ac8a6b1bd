"""Large batches of Boolean queries as a relation: syntax trees are rows, evaluated level by level.

Every node of a tree stands for a set of documents or, under a negation, for the complement of one; which of
the two is known from the tree alone. So a level is one aggregation: for each parent and document, count the
children that must hold it and those that must not. Complements are never built, and the plan depends on
the deepest tree of the batch, not on the number of queries.

    a AND b AND NOT c     its set: all of a, b and none of c
    NOT a AND NOT b       complement of: any of a, b
    a OR b                its set: any of a, b
    a OR NOT b            complement of: all of b and none of a
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termforge.functions import porter
from termforge.plans.boolean_parser import And, Node, Not, Or, QuerySyntaxError, Term, parse
from termforge.sources import scratch

#: Leaves of a batch that are broadcast (some 60 bytes each).
LEAVES = 500_000
#: A node: ``need`` children must hold a document where ``must`` is 1, none where it is 0; need 0 means any.
NODES = "query_id long, node int, parent int, level int, must int, need int, term string, complement boolean, error string"


def nodes_of(tree: Node) -> list[tuple[int, int, int, int, int, str | None, bool]]:
    """(node, parent, level, must, need, term, complement); the root is node 0 at level 0 below parent -1.

    ``must`` is a node's part in its parent, ``need`` what its own children must do.
    """
    rows: list[list] = []

    def signed(node: Node) -> tuple[Node, bool]:
        negated = False
        while isinstance(node, Not):
            node, negated = node.operand, not negated
        return node, negated

    def complement(node: Node) -> bool:
        node, negated = signed(node)
        if isinstance(node, Term):
            return negated
        kinds = [complement(x) for x in node.operands]
        own = all(kinds) if isinstance(node, And) else any(kinds)
        return own != negated

    def add(node: Node, parent: int, level: int, must: int) -> None:
        node, _ = signed(node)
        at = len(rows)
        rows.append([at, parent, level, must, 0, node.text if isinstance(node, Term) else None])
        if isinstance(node, Term):
            return
        kinds = [complement(x) for x in node.operands]
        if isinstance(node, And):
            wanted = [not k for k in kinds] if not all(kinds) else None
        else:
            wanted = kinds if any(kinds) else None
        # None: a document in any child's set is in the node's
        rows[at][4] = sum(wanted) if wanted else 0
        for x, must_hold in zip(node.operands, wanted or [True] * len(kinds)):
            add(x, at, level + 1, int(must_hold))

    add(tree, -1, 0, 1)
    return [(*r, complement(tree)) for r in rows]


def trees(queries: DataFrame) -> DataFrame:
    """The nodes of all queries (query_id, query), parsed where they lie; a row with an error for one that has no syntax.

    Blank and null queries have no nodes.
    """
    kinds = [pa.int64(), *[pa.int32()] * 5, pa.string(), pa.bool_(), pa.string()]
    names = [c.split()[0] for c in NODES.split(", ")]

    def parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for i, text in zip(*(c.to_pylist() for c in batch.columns)):
                try:
                    tree = parse(text or "")
                    out += [(i, *n, None) for n in nodes_of(tree)] if tree is not None else []
                except (QuerySyntaxError, RecursionError) as e:
                    out.append((i, 0, -1, 0, 1, 0, None, None, str(e)))
            columns = zip(*out) if out else [[]] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds)], names=names)

    return queries.select(F.col("query_id").cast("long"), "query").mapInArrow(parsed, NODES)


def errors(nodes: DataFrame) -> DataFrame:
    """(query_id, error) of the queries of ``trees`` that have no answers for their syntax."""
    return nodes.where("error is not null").select("query_id", "error")


def search(docs: DataFrame, postings: DataFrame, queries: DataFrame, stem: bool = False) -> DataFrame:
    """(query_id, doc_id): all answers of a batch ``queries`` (query_id, query), each once.

    ``postings`` has (term, doc_id), each pair once. Ids of queries must be unique. Blank queries and
    those without syntax (see ``errors``) answer nothing. ``stem`` is for stemmed postings.
    """
    nodes = scratch.written(trees(queries).where("error is null"), "query-nodes")
    deepest = nodes.agg(F.max("level")).first()[0]
    if deepest is None:
        return postings.where(F.lit(False)).select(F.lit(0).cast("long").alias("query_id"), "doc_id")
    leaves = nodes.where("term is not null").select("query_id", "parent", "node", "level", "must", "term")
    if stem:
        leaves = porter.stemmed(leaves)
    sized = F.broadcast(leaves) if leaves.count() <= LEAVES else leaves
    found = postings.select("term", "doc_id").join(sized, "term").select("query_id", "parent", "node", "level", "must", "doc_id")
    inner = nodes.where("term is null").select("query_id", F.col("node").alias("parent"), F.col("parent").alias("_up"), F.col("must").alias("_must"), "need")
    hits = found.where(F.col("level") == deepest)
    for level in range(deepest, 0, -1):
        # children of a node at this level: counts of those that must hold the document and of those that must not
        sums = hits.groupBy("query_id", "parent", "doc_id").agg(F.sum("must").alias("_all"), F.sum(1 - F.col("must")).alias("_none"))
        kept = sums.join(_sized(inner), ["query_id", "parent"])
        kept = kept.where((F.col("need") == 0) | ((F.col("_all") == F.col("need")) & (F.col("_none") == 0)))
        up = kept.select("query_id", F.col("_up").alias("parent"), F.col("parent").alias("node"), F.lit(level - 1).alias("level"), F.col("_must").alias("must"), "doc_id")
        hits = up.unionByName(found.where(F.col("level") == level - 1))
    roots = nodes.where("node = 0").select("query_id", "complement")
    own = hits.select("query_id", "doc_id").join(_sized(roots), "query_id")
    plain = own.where("not complement").select("query_id", "doc_id")
    # complements: every document answers all complement queries but those whose set holds it
    every = roots.where("complement").agg(F.sort_array(F.collect_list("query_id")).alias("_every")).where("size(_every) > 0")
    held = own.where("complement").groupBy("doc_id").agg(F.collect_list("query_id").alias("_held"))
    universe = docs.select("doc_id").distinct().join(held, "doc_id", "left").join(F.broadcast(every))
    left = F.array_except("_every", F.coalesce("_held", F.array().cast("array<bigint>")))
    return plain.unionAll(universe.select(F.explode(left).alias("query_id"), "doc_id"))


#: Queries that a task of ``answer_sums`` evaluates, and documents that it evaluates them on, at most about.
QUERY_CHUNK, DOC_BLOCK = 50_000, 32_768
SUMS = "query string, n_docs long, ids long, first_id long, last_id long"


def answer_sums(docs: DataFrame, postings: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, n_docs, ids, first_id, last_id): number, sum, least and greatest of the ids of each query's answers.

    For batches with very many answers: no answer is a row. Equal queries are evaluated once. Documents are dealt into
    blocks; in a block a term is a bit for each document, and a query is a few operations on such bits. ``postings`` is
    as for ``search``; every row of ``docs`` counts. Queries without answers have no row.
    """
    spark = docs.sparkSession
    asked = scratch.written(queries.where("query is not null").select("query").distinct(), "asked")
    chunks = asked.count() // QUERY_CHUNK + 1
    blocks = max(2 * spark.sparkContext.defaultParallelism, docs.count() // DOC_BLOCK + 1)
    asked = asked.withColumn("chunk", F.pmod(F.xxhash64("query"), F.lit(chunks)))
    block = F.pmod(F.xxhash64("doc_id"), F.lit(blocks)).alias("block")

    def terms_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = {(c, t) for q, c in zip(*(x.to_pylist() for x in batch.columns)) for t in _leaves(q)}
            yield pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], k) for i, k in enumerate((pa.int64(), pa.string()))], names=["chunk", "term"])

    wanted = scratch.written(asked.mapInArrow(terms_of, "chunk long, term string").distinct(), "asked-terms")
    held = postings.where("doc_id is not null").join(_sized(wanted.select("term").distinct()), "term", "left_semi")
    held = held.groupBy(block, "term").agg(F.collect_list("doc_id").alias("ids")).join(_sized(wanted), "term")
    every = docs.groupBy(block).agg(F.collect_list("doc_id").alias("ids"), F.count_if(F.col("doc_id").isNull()).alias("nulls"))
    every = every.withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(chunks - 1).cast("long"))))
    left = held.select("block", "chunk", "term", "ids", F.lit(0).cast("long").alias("nulls"))
    left = left.unionAll(every.select("block", "chunk", F.lit(None).cast("string").alias("term"), "ids", "nulls"))
    right = asked.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long")))).select("block", "chunk", "query")
    parts = 4 * blocks * chunks  # more than groups, so that few meet in a task
    both = (x.repartition(parts, "block", "chunk").groupBy("block", "chunk") for x in (left, right))
    sums = next(both).cogroup(next(both)).applyInArrow(_block_sums, SUMS).groupBy("query")
    totals = lambda x: x.agg(F.sum("n_docs").alias("n_docs"), F.sum("ids").alias("ids"), F.min("first_id").alias("first_id"), F.max("last_id").alias("last_id"))
    return totals(queries.join(totals(sums), "query").groupBy("query_id"))


def _leaves(query: str) -> set[str]:
    """The terms of a query; none if it has no syntax."""
    try:
        todo, out = [parse(query)], set()
    except (QuerySyntaxError, RecursionError):
        return set()
    while todo:
        node = todo.pop()
        if isinstance(node, Term):
            out.add(node.text)
        elif node is not None:
            todo += [node.operand] if isinstance(node, Not) else node.operands
    return out


def _block_sums(held: pa.Table, asked: pa.Table) -> pa.Table:
    """The sums of the answers of a chunk's queries in a block of documents."""
    terms, rows = held.column("term").to_pylist(), held.column("ids").combine_chunks() if held.num_rows else []
    values = {t: np.asarray(rows[i].values) for i, t in enumerate(terms) if t is not None}
    own = [i for i, t in enumerate(terms) if t is None]
    ids, times = np.unique(np.concatenate([np.asarray(rows[i].values) for i in own]) if own else np.empty(0, np.int64), return_counts=True)
    nulls = sum(held.column("nulls").to_pylist())
    size = -(-(len(ids) + 1) // 64) * 64  # the place behind the ids is for documents without one
    ids = ids.astype(np.int64)

    def bits_of(places: np.ndarray) -> np.ndarray:
        flags = np.zeros(size, bool)
        flags[places] = True
        return np.packbits(flags, bitorder="little").view(np.uint64)

    bits = {t: bits_of(np.searchsorted(ids, v)) for t, v in values.items()}
    none, named = bits_of(np.empty(0, np.int64)), bits_of(np.arange(len(ids)))
    full = bits_of(np.arange(len(ids) + (nulls > 0)))
    # what each value of each byte adds to the number and the sum
    weights = np.zeros((2, size), np.int64)
    weights[0, : len(ids)], weights[0, len(ids)], weights[1, : len(ids)] = times, nulls, times * ids
    values_of = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)
    number, total = ((w.reshape(-1, 8) @ values_of.T).ravel() for w in weights)
    starts = np.arange(size // 8) * 256

    def holds(node: Node) -> np.ndarray:
        if isinstance(node, Term):
            return bits.get(node.text, none)
        if isinstance(node, Not):
            return ~holds(node.operand)
        join = np.bitwise_and if isinstance(node, And) else np.bitwise_or
        return functools.reduce(join, map(holds, node.operands))

    out: list[tuple] = []
    for query in asked.column("query").to_pylist():
        try:
            tree = parse(query)
            found = holds(tree) & full if tree is not None else none
        except (QuerySyntaxError, RecursionError):
            continue
        at = starts + found.view(np.uint8)
        n = int(number[at].sum())
        if n == 0:
            continue
        words = np.flatnonzero(found & named)
        if len(words) == 0:
            out.append((query, n, None, None, None))
            continue
        masked = found & named
        low, high = int(masked[words[0]]), int(masked[words[-1]])
        first, last = 64 * int(words[0]) + (low & -low).bit_length() - 1, 64 * int(words[-1]) + high.bit_length() - 1
        out.append((query, n, int(total[at].sum()), int(ids[first]), int(ids[last])))
    kinds = [pa.string(), *[pa.int64()] * 4]
    return pa.Table.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], names=["query", "n_docs", "ids", "first_id", "last_id"])


def _sized(rows: DataFrame) -> DataFrame:
    """Nodes of a batch: broadcast up to LEAVES rows, counted."""
    return F.broadcast(rows) if rows.count() <= LEAVES else rows
