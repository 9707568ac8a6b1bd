"""Inverted indexes and document statistics as DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termforge.functions import analysis, porter
from termforge.functions.smart import exact_sum

ZONES = ("content", "title", "date_posted", "court")


def _of_terms(rows: DataFrame, stem: bool, only: DataFrame | None) -> DataFrame:
    """Rows of tokens (…, term), stemmed if asked for, of all terms or of a small relation ``only`` (term)."""
    if stem:
        return porter.stemmed(rows, only=only)
    return rows if only is None else rows.join(F.broadcast(only.select("term").distinct()), "term", "left_semi")


def terms_of(docs: DataFrame, keep: str | None = analysis.ALNUM, stem: bool = False, only: DataFrame | None = None) -> DataFrame:
    """(doc_id, term), one row per token, of all terms or of those of a small relation ``only`` (a batch's query terms)."""
    return _of_terms(analysis.exploded(docs.select("doc_id", "text"), "text", keep=keep), stem, only)


def boolean_index(docs: DataFrame, keep: str | None = analysis.ALNUM, stem: bool = False, only: DataFrame | None = None) -> DataFrame:
    """(term, doc_id), each pair once."""
    return terms_of(docs, keep, stem, only).select("term", "doc_id").distinct()


def tf_index(docs: DataFrame, keep: str | None = None, stem: bool = False, only: DataFrame | None = None) -> DataFrame:
    """(term, doc_id, tf). By default punctuation is indexed too."""
    return terms_of(docs, keep, stem, only).groupBy("term", "doc_id").agg(F.count("*").alias("tf"))


def dictionary(postings: DataFrame, only: DataFrame | None = None) -> DataFrame:
    """(term, df), of all terms or of those of a small relation ``only`` (a batch's query terms)."""
    if only is not None:
        postings = postings.join(F.broadcast(only.select("term").distinct()), "term", "left_semi")
    return postings.groupBy("term").agg(F.count("*").alias("df"))


def zoned_index(cases: DataFrame, keep: str | None = None, stem: bool = False, only: DataFrame | None = None) -> DataFrame:
    """(term, doc_id, tf_content, tf_title, tf_date, tf_court) of documents with four zones; null zones are empty.

    Ids should be unique; use ``unique_cases`` first where they may not be.
    """
    long = cases.select(
        "doc_id", F.explode(F.array(*(F.struct(F.lit(z).alias("zone"), F.col(z).alias("text")) for z in ZONES))).alias("z")
    ).select("doc_id", "z.zone", "z.text")
    counts = [
        F.count_if(F.col("zone") == z).cast("int").alias(f"tf_{z.removesuffix('_posted')}") for z in ZONES
    ]
    rows = analysis.exploded(long, "text", keep=keep)
    return _of_terms(rows, stem, only).groupBy("term", "doc_id").agg(*counts)


def unique_cases(cases: DataFrame) -> DataFrame:
    """One row per id: the first in the order of content, title, date and court."""
    rest = [c for c in cases.columns if c != "doc_id"]
    return cases.groupBy("doc_id").agg(F.min(F.struct(*rest)).alias("r")).select("doc_id", "r.*")


def zone_total(postings: DataFrame) -> DataFrame:
    """(term, doc_id, tf) with tf summed over zones."""
    return postings.select(
        "term", "doc_id", (F.col("tf_content") + F.col("tf_title") + F.col("tf_date") + F.col("tf_court")).cast("long").alias("tf")
    )


def doc_norms(postings: DataFrame) -> DataFrame:
    """(doc_id, len_l): Euclidean norm of 1 + log10 tf."""
    w = 1 + F.log10("tf")
    return postings.groupBy("doc_id").agg(F.sqrt(exact_sum(w * w)).alias("len_l"))


def doc_stats(postings: DataFrame) -> DataFrame:
    """(doc_id, len_n, len_l, len_a, len_ave, max_tf, ave_tf): norms of the four tf variants."""
    # a document's terms of one tf count alike, so that all that is kept of them is how many there are
    alike = postings.groupBy("doc_id", "tf").agg(F.count("*").alias("n"))
    base = alike.groupBy("doc_id").agg(
        F.max("tf").alias("max_tf"), (F.sum(F.col("tf") * F.col("n")) / F.sum("n")).alias("ave_tf"), F.collect_list(F.struct("tf", "n")).alias("alike")
    )
    rows = base.select("doc_id", "max_tf", "ave_tf", F.explode_outer("alike").alias("a")).select("doc_id", "max_tf", "ave_tf", "a.*")
    tf, log = F.col("tf"), 1 + F.log10("tf")
    a = 0.5 + 0.5 * tf / F.col("max_tf")
    ave = log / (1 + F.log10("ave_tf"))
    norm = lambda w: F.sqrt(exact_sum(w * w, F.col("n")))
    return (
        rows.groupBy("doc_id", "max_tf", "ave_tf")
        .agg(
            F.sqrt(F.sum(tf * tf * F.col("n"))).alias("len_n"),  # whole numbers: exact as they are
            norm(log).alias("len_l"),
            norm(a).alias("len_a"),
            norm(ave).alias("len_ave"),
        )
        .select("doc_id", "len_n", "len_l", "len_a", "len_ave", "max_tf", "ave_tf")
    )
