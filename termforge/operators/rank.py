"""Ranked retrieval: query weights, inner products, cosine, boosts and top-k.

All queries of a batch are scored in one plan: query terms are joined with postings and summed by
(query, document). Ranks are taken on scores rounded to six places, so that equal documents tie.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from termforge.functions import analysis, porter, smart
from termforge.functions.smart import exact_sum
from termforge.sources import scratch

PLACES = 6
TITLE_BOOST = 1.4
#: Batches of up to so many query terms are broadcast (some 100 bytes each).
BATCH_TERMS = 200_000


def query_terms(queries: DataFrame, keep: str | None = analysis.ALNUM, operator_words: tuple[str, ...] = (), stem: bool = False) -> DataFrame:
    """(query_id, term, qtf, first_pos); ``operator_words`` are dropped before folding (``AND`` in free text)."""
    rows = queries.select("query_id", F.posexplode_outer(analysis.tokens(F.col("query"))).alias("pos", "term"))
    rows = rows.where(F.col("term").isNotNull())
    if operator_words:
        rows = rows.where(~F.col("term").isin(list(operator_words)))
    if keep:
        rows = rows.where(F.col("term").rlike(keep))
    rows = rows.withColumn("term", F.lower("term"))
    if stem:
        rows = porter.stemmed(rows)
    return rows.groupBy("query_id", "term").agg(F.count("*").alias("qtf"), F.min("pos").alias("first_pos"))


def query_weights(terms: DataFrame, dictionary: DataFrame, n_docs: DataFrame, idf: str) -> DataFrame:
    """(query_id, term, qtf, first_pos, wq) of known terms; ``n_docs`` is one row with ``n``.

    The result is as small as the batch of queries. It is written once, for all its uses, and is broadcast
    where it meets postings, if the batch has at most BATCH_TERMS terms.
    """
    known = terms.join(dictionary, "term").crossJoin(F.broadcast(n_docs))
    out = known.select(
        "query_id", "term", "qtf", "first_pos", smart.query_weight(F.col("qtf"), F.col("n"), F.col("df"), idf).alias("wq")
    )
    out = scratch.written(out, "weights")
    return F.broadcast(out) if out.count() <= BATCH_TERMS else out


def scores(weights: DataFrame, postings: DataFrame, doc_weight: Column) -> DataFrame:
    """(query_id, doc_id, score, first_pos): inner products; every document with a query term has a row."""
    return (
        postings.join(weights, "term")
        .groupBy("query_id", "doc_id")
        .agg(exact_sum(F.col("wq") * doc_weight).alias("score"), F.min("first_pos").alias("first_pos"))
    )


def log_tf() -> Column:
    return 1 + F.log10("tf")


def cosine(weights: DataFrame, postings: DataFrame, norms: DataFrame) -> DataFrame:
    """lnc.ltc: inner products over the lengths of document and query; no rows for a query of length 0."""
    lengths = weights.groupBy("query_id").agg(F.sqrt(exact_sum(F.col("wq") * F.col("wq"))).alias("len_q"))
    out = scores(weights, postings, log_tf()).join(norms, "doc_id").join(F.broadcast(lengths), "query_id")
    score = F.round(F.try_divide(F.try_divide("score", "len_l"), F.col("len_q")), PLACES)
    return out.select("query_id", "doc_id", score.alias("score")).where("score is not null")


def top_k(scored: DataFrame, k: int) -> DataFrame:
    """(query_id, rank, doc_id, score): at the cut the larger id wins, the result is ordered by id among ties."""
    cut = Window.partitionBy("query_id").orderBy(F.desc("score"), F.desc("doc_id"))
    shown = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("doc_id"))
    best = scored.withColumn("_cut", F.row_number().over(cut)).where(F.col("_cut") <= k)
    return best.select("query_id", F.row_number().over(shown).alias("rank"), "doc_id", "score")


def full_ranking(scored: DataFrame, k: int | None = None) -> DataFrame:
    """(query_id, rank, doc_id, score): ties in order of the first matching query term, then descending id.

    With ``k`` every task keeps its own first k before they meet. A whole ranking is scored once, cut into
    ranges of its order and written sorted, so that no task sorts a query's whole result; a row's rank
    follows from its place in its file, the rows of the files before and the place of the query's first row.
    """
    rows = scored.select("query_id", "doc_id", F.round("score", PLACES).alias("score"), "first_pos")
    order = [F.desc("score"), F.asc("first_pos"), F.desc("doc_id")]
    if k:
        out = rows.select("query_id", F.row_number().over(Window.partitionBy("query_id").orderBy(*order)).alias("rank"), "doc_id", "score")
        return out.where(F.col("rank") <= k)
    rows = scratch.written(rows, "scored")  # range partitioning reads it twice
    cut = rows.repartitionByRange(F.asc("query_id"), *order).sortWithinPartitions(F.asc("query_id"), *order)
    placed = scratch.written(cut.select("query_id", "doc_id", "score"), "ranked").select(
        "query_id", "doc_id", "score", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_at")
    )
    files = placed.groupBy("_file").agg((F.max("_at") + 1).alias("_n"))  # a row for each file
    offsets = files.select("_file", (F.sum("_n").over(Window.orderBy("_file")) - F.col("_n")).alias("_before"))
    placed = placed.join(F.broadcast(offsets), "_file").withColumn("_place", F.col("_before") + F.col("_at"))
    heads = placed.groupBy("query_id").agg(F.min("_place").alias("_head"))  # a row for each query of the batch
    return placed.join(heads, "query_id").select("query_id", (F.col("_place") - F.col("_head") + 1).cast("int").alias("rank"), "doc_id", "score")


def title_factor(column: str = "tf_title", boost: float = TITLE_BOOST) -> Column:
    return F.when(F.col(column) > 0, boost).otherwise(1.0)


def court_boosted(scored: DataFrame, courts: DataFrame, weights: DataFrame) -> DataFrame:
    """Scores times the weight of the document's court; courts without a weight count 1."""
    w = courts.join(F.broadcast(weights), "court", "left").select("doc_id", F.coalesce("weight", F.lit(1.0)).alias("_w"))
    return scored.join(w, "doc_id").withColumn("score", F.col("score") * F.col("_w")).drop("_w")


#: The document lengths that belong to the SMART weights, as columns of ``index.doc_stats``.
LENGTHS = {"n": "len_n", "l": "len_l", "a": "len_a", "L": "len_ave"}


def smart_table(weights: DataFrame, postings: DataFrame, stats: DataFrame, methods: str = "nlaL", title: bool = False, normalised: bool = False) -> DataFrame:
    """(query_id, doc_id, first_pos, scores): a score for each of the SMART document weights n, l, a, L, in one pass.

    Postings of the queries' terms alone meet the documents' statistics. ``title`` boosts terms of the
    title; ``normalised`` (SMART's c) divides by the document's length under the same weight.
    """
    hits = postings.join(weights, "term")
    if normalised or not set(methods) <= {"n", "l"}:  # natural and logarithmic weights are of tf alone
        hits = hits.join(stats.select("doc_id", "max_tf", "ave_tf", *LENGTHS.values()), "doc_id")
    else:
        hits = hits.withColumns({"max_tf": F.lit(None).cast("long"), "ave_tf": F.lit(None).cast("double")})
    factor = title_factor() if title else F.lit(1.0)
    sums = []
    for m in methods:
        total = exact_sum(F.col("wq") * smart.DOC_WEIGHTS[m](F.col("tf"), F.col("max_tf"), F.col("ave_tf")) * factor)
        sums.append(F.try_divide(total, F.max(LENGTHS[m])) if normalised else total)
    scored = F.array(*(F.struct(F.lit(m).alias("method"), c.alias("score")) for m, c in zip(methods, sums)))
    return hits.groupBy("query_id", "doc_id").agg(F.min("first_pos").alias("first_pos"), scored.alias("scores"))


def smart_scores(weights: DataFrame, postings: DataFrame, stats: DataFrame, method: str, title: bool = False, normalised: bool = False) -> DataFrame:
    """(query_id, doc_id, score, first_pos) under one SMART document weight; see ``smart_table``."""
    out = smart_table(weights, postings, stats, method, title, normalised)
    return out.select("query_id", "doc_id", F.col("scores")[0]["score"].alias("score"), "first_pos")


def smart_rankings(table: DataFrame, k: int) -> DataFrame:
    """(tf_method, query_id, rank, doc_id, score): the first k of each query under each weight of ``smart_table``."""
    rows = table.select("query_id", "doc_id", "first_pos", F.explode("scores").alias("s"))
    key = F.struct(F.col("s.method").alias("tf_method"), "query_id").alias("query_id")
    ranked = full_ranking(rows.select(key, "doc_id", F.col("s.score").alias("score"), "first_pos"), k)
    return ranked.select("query_id.*", "rank", "doc_id", "score")


def result_lines(queries: DataFrame, ranked: DataFrame) -> DataFrame:
    """(query_id, result): ids in rank order, joined by spaces. A line is one value: for results that are read as lines."""
    lists = ranked.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "doc_id"))).alias("r"))
    line = F.array_join(F.transform("r", lambda x: x["doc_id"].cast("string")), " ")
    return queries.select("query_id").join(lists, "query_id", "left").select("query_id", F.coalesce(line, F.lit("")).alias("result"))
