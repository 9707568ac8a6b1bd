"""Pseudo-relevance feedback (Rocchio) over the query's own terms."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from termforge.functions.smart import exact_sum
from termforge.operators import rank
from termforge.sources import scratch

BETA, GAMMA, SET_SIZE = 0.75, 0.15, 10


def feedback_sets(scored: DataFrame, size: int = SET_SIZE) -> DataFrame:
    """(query_id, doc_id, top, low): the first and last ``size`` of each ranking; they may overlap."""
    rows = scored.select("query_id", "doc_id", F.round("score", rank.PLACES).alias("score"), "first_pos")
    w = Window.partitionBy("query_id")
    first = w.orderBy(F.desc("score"), F.asc("first_pos"), F.desc("doc_id"))
    last = w.orderBy(F.asc("score"), F.desc("first_pos"), F.asc("doc_id"))

    def end(order, top: int, low: int) -> DataFrame:  # a limited window: every task keeps its own few rows
        out = rows.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= size)
        return out.select("query_id", "doc_id", F.lit(top).alias("top"), F.lit(low).alias("low"))

    both = end(first, 1, 0).unionAll(end(last, 0, 1))
    return both.groupBy("query_id", "doc_id").agg(F.max("top").alias("top"), F.max("low").alias("low"))


def rocchio_weights(weights: DataFrame, postings: DataFrame, sets: DataFrame) -> DataFrame:
    """(query_id, term, first_pos, wq): q + beta mean(top) - gamma mean(low), each mean over SET_SIZE."""
    hits = postings.join(F.broadcast(sets), "doc_id").join(weights.select("query_id", "term"), ["query_id", "term"])
    w = rank.log_tf()
    sums = hits.groupBy("query_id", "term").agg(
        exact_sum(w * F.col("top")).alias("s_top"), exact_sum(w * F.col("low")).alias("s_low")
    )
    moved = (
        F.col("wq")
        + BETA * F.coalesce("s_top", F.lit(0.0)) / SET_SIZE
        - GAMMA * F.coalesce("s_low", F.lit(0.0)) / SET_SIZE
    )
    out = weights.join(sums, ["query_id", "term"], "left").select("query_id", "term", "first_pos", moved.alias("wq"))
    return scratch.written(out, "moved-weights")  # as small as the batch


def rerank_last_term(scored: DataFrame, weights: DataFrame, postings: DataFrame) -> DataFrame:
    """The variant in which each document's score is that of the query's last term alone.

    A document without the term scores the term's weight itself.
    """
    last = weights.groupBy("query_id").agg(F.max_by(F.struct("term", "wq"), "first_pos").alias("l"))
    last = last.select("query_id", "l.term", "l.wq")
    docs = scored.select("query_id", "doc_id", "first_pos").join(F.broadcast(last), "query_id")
    out = docs.join(postings.select("term", "doc_id", "tf"), ["term", "doc_id"], "left")
    score = F.when(F.col("tf").isNull(), F.col("wq")).otherwise(F.col("wq") * rank.log_tf())
    return out.select("query_id", "doc_id", score.alias("score"), "first_pos")
