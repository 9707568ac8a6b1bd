"""Boolean retrieval: a batch of queries as predicates over term sets, or one query as set operations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from termforge.functions import porter
from termforge.plans.boolean_parser import And, Node, Not, Or, Term, parse, renamed, terms


def predicate(node: Node, held: Column) -> Column:
    """Whether a document whose queried terms are ``held`` (an array) answers the query."""
    if isinstance(node, Term):
        return F.array_contains(held, node.text)
    if isinstance(node, Not):
        return ~predicate(node.operand, held)
    parts = [predicate(x, held) for x in node.operands]
    return reduce(lambda a, b: a & b, parts) if isinstance(node, And) else reduce(lambda a, b: a | b, parts)


def search(docs: DataFrame, postings: DataFrame, queries: list[tuple[int, str]], stem: bool = False) -> DataFrame:
    """(query_id, doc_id) of all answers of a batch of queries, in one pass over the queried terms' postings.

    ``stem`` is for stemmed postings: the queries' words are stemmed too.
    """
    trees = [(i, t) for i, q in queries if (t := parse(q)) is not None]
    if stem:
        words = sorted(set().union(*(terms(t) for _, t in trees)))
        stems = porter.stems_of(docs.sparkSession, words)
        trees = [(i, renamed(t, stems)) for i, t in trees]
    wanted = sorted(set().union(*(terms(t) for _, t in trees))) if trees else []
    held = postings.where(F.col("term").isin(wanted)).groupBy("doc_id").agg(F.collect_set("term").alias("held"))
    rows = docs.select("doc_id").join(held, "doc_id", "left").withColumn("held", F.coalesce("held", F.array().cast("array<string>")))
    if not trees:
        return rows.where(F.lit(False)).select(F.lit(0).cast("long").alias("query_id"), "doc_id")
    hits = F.array(*(F.when(predicate(t, F.col("held")), F.lit(i).cast("long")) for i, t in trees))
    return rows.select("doc_id", hits.alias("hits")).select(F.explode("hits").alias("query_id"), "doc_id").where("query_id is not null")


def estimate(node: Node, df: dict[str, int], n: int) -> int:
    """At most so many documents answer: document frequencies of terms, the smallest operand of an AND, sums for an OR."""
    if isinstance(node, Term):
        return df.get(node.text, 0)
    if isinstance(node, Not):
        return n
    sizes = [estimate(x, df, n) for x in node.operands]
    return min(sizes) if isinstance(node, And) else min(n, sum(sizes))


def search_sets(docs: DataFrame, postings: DataFrame, query: str, dictionary: DataFrame | None = None) -> DataFrame:
    """(doc_id) of one query by set operations: semi joins for AND, anti joins for AND NOT, unions for OR.

    With a ``dictionary`` (term, df) the operands of an AND are joined in the order of their estimated
    sizes, the smallest first; only the query's own terms are looked up.
    """
    universe = docs.select("doc_id").distinct()

    def plan(node: Node) -> DataFrame:
        if isinstance(node, Term):
            return postings.where(F.col("term") == node.text).select("doc_id").distinct()
        if isinstance(node, Not):
            return universe.join(plan(node.operand), "doc_id", "left_anti")
        if isinstance(node, Or):
            return reduce(lambda a, b: a.unionAll(b), map(plan, node.operands)).distinct()
        wanted = [x for x in node.operands if not isinstance(x, Not)]
        if sizes is not None:
            wanted.sort(key=lambda x: estimate(x, *sizes))
        kept = [plan(x) for x in wanted]
        out = reduce(lambda a, b: a.join(b, "doc_id", "left_semi"), kept) if kept else universe
        for x in node.operands:
            if isinstance(x, Not):  # a difference, not a complement
                out = out.join(plan(x.operand), "doc_id", "left_anti")
        return out

    tree, sizes = parse(query), None
    if dictionary is not None and tree is not None:
        known = dictionary.where(F.col("term").isin(sorted(terms(tree)))).select("term", "df")
        sizes = {r.term: r.df for r in known.collect()}, 1 << 62  # one row for each term of the query
    return plan(tree) if tree is not None else universe.where(F.lit(False))


def result_lines(queries: DataFrame, hits: DataFrame) -> DataFrame:
    """(query_id, result): ids ascending, joined by spaces; empty for a query without answers."""
    lists = hits.groupBy("query_id").agg(F.array_join(F.array_sort(F.collect_list("doc_id")), " ").alias("result"))
    return queries.select("query_id").join(lists, "query_id", "left").select("query_id", F.coalesce("result", F.lit("")).alias("result"))
