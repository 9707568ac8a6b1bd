"""Command line: ``index`` and ``search`` over a folder of documents or a zoned CSV file, ``label`` for languages."""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from termforge.functions import analysis
from termforge.operators import boolean, boolean_batch, feedback, index, langmodel, rank
from termforge.sources import readers, scratch, sinks

MODELS = ("boolean", "cosine", "zoned", "feedback")


def build(spark: SparkSession, model: str, source: str, dictionary: str, postings: str) -> None:
    """Write the index: postings at one path; terms, documents and their lengths at the other."""
    if model in ("zoned", "feedback"):
        docs = index.unique_cases(readers.zoned_csv(spark, source))
        found = index.zoned_index(docs, stem=True)
        found = found.withColumn("tf", F.col("tf_content") + F.col("tf_title") + F.col("tf_date") + F.col("tf_court")).withColumn("tf", F.col("tf").cast("long"))
    else:
        docs = readers.directory(spark, source)
        found = index.boolean_index(docs, stem=True) if model == "boolean" else index.tf_index(docs, stem=True)
    sinks.save_index(postings, postings=found)
    found = sinks.load_index(spark, postings, "postings")
    tables = {"dictionary": index.dictionary(found), "docs": docs.select("doc_id")}
    if model == "cosine":
        tables["doc_stats"] = index.doc_norms(found)
    sinks.save_index(dictionary, **tables)


def search(spark: SparkSession, model: str, dictionary: str, postings: str, queries: str, output: str, parts: bool = False) -> None:
    """One line of ids for each query of a file; ``parts`` writes lines of any length by many tasks."""
    found, df = sinks.load_index(spark, postings, "postings"), sinks.load_index(spark, dictionary, "dictionary")
    docs, asked = sinks.load_index(spark, dictionary, "docs"), readers.queries(spark, queries)
    boolean_model = model == "boolean"
    hits = boolean_batch.search(docs, found, asked, stem=True) if boolean_model else _ranked(model, asked, docs, found, df, dictionary)
    if parts:
        hits = scratch.written(hits, "hits")  # range partitioning reads them twice
        sinks.write_result_lines(asked, hits, output, "doc_id" if boolean_model else "rank")
    else:
        lines = (boolean if boolean_model else rank).result_lines(asked, hits)
        sinks.write_lines(lines, output, "query_id", "result")


def _ranked(model: str, asked: DataFrame, docs: DataFrame, found: DataFrame, df: DataFrame, dictionary: str) -> DataFrame:
    n = docs.agg(F.count("*").alias("n"))
    if model == "cosine":
        terms = rank.query_terms(asked, keep=None, stem=True)
        norms = sinks.load_index(asked.sparkSession, dictionary, "doc_stats")
        return rank.top_k(rank.cosine(rank.query_weights(terms, df, n, "t"), found, norms), 10)
    weights = rank.query_weights(rank.query_terms(asked, analysis.ALNUM, ("AND",), stem=True), df, n, "p")
    if model == "zoned":
        return rank.full_ranking(rank.scores(weights, found, rank.log_tf()))
    scored = rank.scores(weights, found, rank.log_tf() * rank.title_factor())
    moved = feedback.rocchio_weights(weights, found, feedback.feedback_sets(scored))
    return rank.full_ranking(rank.scores(moved, found, rank.log_tf()))


def label(spark: SparkSession, train: str, test: str, output: str) -> None:
    """Each line of a file after the language that a model of labelled lines gives it."""
    model = langmodel.gram_counts(readers.labelled_lines(spark, train))
    lines = readers.numbered_lines(spark, test)
    sinks.write_lines(sinks.prediction_lines(lines, langmodel.predict(lines, model)), output, "line_no", "line")


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> None:
    parser = argparse.ArgumentParser(prog="python -m termforge", description=__doc__)
    jobs = parser.add_subparsers(dest="job", required=True)
    make = jobs.add_parser("index", help="index a folder with a file for each document, or a zoned CSV file")
    make.add_argument("-i", dest="source", required=True)
    ask = jobs.add_parser("search", help="answer a file with a query on each line")
    for job in (make, ask):
        job.add_argument("-m", dest="model", choices=MODELS, default="boolean")
        job.add_argument("-d", dest="dictionary", required=True)
        job.add_argument("-p", dest="postings", required=True)
    ask.add_argument("-q", dest="queries", required=True)
    ask.add_argument("--parts", action="store_true", help="write part files that together are the lines, an id and a blank each")
    told = jobs.add_parser("label", help="label lines with languages")
    told.add_argument("-b", dest="train", required=True)
    told.add_argument("-t", dest="test", required=True)
    for job in (ask, told):
        job.add_argument("-o", dest="output", required=True)
    given = vars(parser.parse_args(argv))
    run = {"index": build, "search": search, "label": label}[given.pop("job")]
    run(spark or SparkSession.builder.appName("termforge").getOrCreate(), **given)


if __name__ == "__main__":
    main()
