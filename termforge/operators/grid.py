"""Retrieval experiments as a relation: every configuration is a row, and all of them are scored in one pass.

A configuration has expansion (whether queries are expanded), tf_method (a SMART document weight), with_titles
and with_courts. Postings of the queries' terms meet the documents' statistics once; each (expansion, query,
document) gets the sums that the configurations ask for, of which there are at most two for each weight, and a
configuration picks its own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from termforge.functions import smart
from termforge.functions.smart import exact_sum
from termforge.operators import rank

FLAGS = ("expansion", "tf_method", "with_titles", "with_courts")


def all_configs(spark: SparkSession, methods: str = "nlaL") -> DataFrame:
    """Every configuration of the given weights."""
    rows = [(e, m, t, c) for e in (False, True) for m in methods for t in (False, True) for c in (False, True)]
    return spark.createDataFrame(rows, "expansion boolean, tf_method string, with_titles boolean, with_courts boolean")


def scores(configs: DataFrame, weights: DataFrame, postings: DataFrame, stats: DataFrame, courts: DataFrame, court_weights: DataFrame) -> DataFrame:
    """(expansion, tf_method, with_titles, with_courts, query_id, doc_id, score, first_pos) of all matching documents.

    ``weights`` has (expansion, query_id, term, wq, first_pos), ``postings`` tf and tf_title, ``courts`` (doc_id, court)
    and ``court_weights`` (court, weight), where courts without a weight count 1. Unknown weights are an error;
    repeated configurations count once.
    """
    configs = configs.select(*FLAGS).distinct()
    asked = sorted((r.tf_method, r.with_titles) for r in configs.select("tf_method", "with_titles").distinct().collect())
    if unknown := {m for m, _ in asked} - set(smart.DOC_WEIGHTS):
        raise ValueError(f"unknown tf methods: {sorted(unknown)}")
    if not asked:
        asked = [("n", False)]  # no configuration will pick it
    sums = []
    for method, titles in asked:
        weight = smart.DOC_WEIGHTS[method](F.col("tf"), F.col("max_tf"), F.col("ave_tf"))
        sums.append(exact_sum(F.col("wq") * weight * (rank.title_factor() if titles else F.lit(1.0))))
    hits = postings.join(weights, "term").join(stats.select("doc_id", "max_tf", "ave_tf"), "doc_id")
    table = hits.groupBy("expansion", "query_id", "doc_id").agg(F.min("first_pos").alias("first_pos"), F.array(*sums).alias("sums"))
    factor = courts.join(F.broadcast(court_weights), "court", "left").select("doc_id", F.coalesce("weight", F.lit(1.0)).alias("_court"))
    table = table.join(factor, "doc_id")
    places = F.create_map(*(x for i, (m, t) in enumerate(asked) for x in (F.lit(f"{m}{int(t)}"), F.lit(i))))
    picked = configs.withColumn("_at", F.element_at(places, F.concat("tf_method", F.col("with_titles").cast("int").cast("string"))))
    rows = table.join(F.broadcast(picked), "expansion")  # at most four configurations for each weight and expansion
    score = F.get("sums", F.col("_at")) * F.when(F.col("with_courts"), F.col("_court")).otherwise(1.0)
    return rows.select(*FLAGS, "query_id", "doc_id", score.alias("score"), "first_pos")


def rankings(scored: DataFrame, k: int) -> DataFrame:
    """The first ``k`` documents of each query under each configuration, with their ranks."""
    key = F.struct(*FLAGS, "query_id").alias("query_id")
    ranked = rank.full_ranking(scored.select(key, "doc_id", "score", "first_pos"), k)
    return ranked.select("query_id.*", "rank", "doc_id", "score")


def report(configs: DataFrame, queries: DataFrame, ranked: DataFrame) -> DataFrame:
    """A row for each configuration and query: its flags, the query's text and the ids in order, blank where there are none."""
    lists = ranked.groupBy(*FLAGS, "query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "doc_id"))).alias("r"))
    line = F.array_join(F.transform("r", lambda x: x["doc_id"].cast("string")), " ")
    rows = queries.select("query_id", "query").crossJoin(F.broadcast(configs.select(*FLAGS).distinct()))  # the report's own rows
    return rows.join(lists, [*FLAGS, "query_id"], "left").select(*FLAGS, "query_id", "query", F.coalesce(line, F.lit("")).alias("result"))
