"""Sinks: persistent indexes and result files."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from termforge.sources import scratch
from termforge.sources.readers import NO_ID

RELATIONS = ("postings", "dictionary", "doc_stats", "docs")


def save_index(path: str, **relations: DataFrame) -> None:
    """Write relations as Parquet. Postings are range-partitioned and sorted by term, so that point
    look-ups prune files and row groups by their statistics."""
    for name, df in relations.items():
        if "term" in df.columns:
            df = df.repartitionByRange(F.col("term")).sortWithinPartitions("term", *(c for c in ("doc_id",) if c in df.columns))
        df.write.mode("overwrite").parquet(f"{path}/{name}")


def load_index(spark: SparkSession, path: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{path}/{name}")


#: Folders that postings are dealt to by the hash of their term.
BUCKETS = 256
#: Terms that are looked up by a broadcast (some 60 bytes each).
LOOKED_UP = 200_000


def _bucket(buckets: int):
    return F.pmod(F.xxhash64("term"), F.lit(buckets)).cast("int")


def save_postings(path: str, postings: DataFrame, buckets: int = BUCKETS) -> None:
    """Write postings for look-ups by joins: a folder for each bucket of terms, sorted by term within.

    Rows are cut into ranges of (bucket, term, doc_id), so that a very frequent term is written by several tasks.
    """
    rows = postings.withColumn("bucket", _bucket(buckets)).repartitionByRange("bucket", "term", "doc_id")
    rows.sortWithinPartitions("bucket", "term", "doc_id").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/postings")
    spark = postings.sparkSession
    spark.range(1).select(F.lit(buckets).alias("buckets")).write.mode("overwrite").parquet(f"{path}/layout")


def lookup(spark: SparkSession, path: str, terms: DataFrame) -> DataFrame:
    """The postings of the terms of a DataFrame (term), each looked up once; unknown and null terms have none.

    The join is on bucket and term: the buckets that the terms are in are known when the query runs, and only
    their folders are read. Postings are not shuffled where at most LOOKED_UP terms, which are counted, are
    looked up.
    """
    buckets = spark.read.parquet(f"{path}/layout").first()["buckets"]
    wanted = terms.select("term").where("term <> ''").distinct()
    wanted = wanted.withColumn("bucket", _bucket(buckets))
    postings = spark.read.parquet(f"{path}/postings")
    small = wanted.count() <= LOOKED_UP
    return postings.join(F.broadcast(wanted) if small else wanted, ["bucket", "term"]).drop("bucket")


def postings_of(postings: DataFrame, terms: list[str]) -> DataFrame:
    """Point look-up: the filter reaches the scan."""
    return postings.where(F.col("term").isin(terms))


def write_lines(df: DataFrame, path: str, key: str, value: str, single: bool = True) -> None:
    """One line per row in the order of ``key``: in one file (results with a line per query are small), or in
    as many as there are partitions, of which the names follow the order."""
    lines = df.orderBy(key).select(value)
    (lines.coalesce(1) if single else lines).write.mode("overwrite").text(path)


def write_result_lines(queries: DataFrame, results: DataFrame, path: str, order: str) -> None:
    """Result lines of any length, written by many tasks: no line is ever one value.

    ``results`` has query_id, doc_id and a column of the ids' order in their query (rank, or doc_id itself),
    ``queries`` all query_ids. Rows are cut into ranges of (query, order), so a query with very many answers
    is written by several tasks; the part files in the order of their names are the lines: an id and a blank each,
    and a line feed before every query but the first. ``readers.result_lines`` reads them again.
    """
    first = results.groupBy("query_id").agg(F.min(order).alias("_first"))  # a row for each query with answers
    asked = queries.select("query_id").distinct()
    none = asked.join(first, "query_id", "left_anti").select("query_id", F.lit(None).cast(results.schema[order].dataType).alias("_order"), F.lit(True).alias("_head"), F.lit("").alias("_id"))
    some = results.join(first, "query_id").select("query_id", F.col(order).alias("_order"), (F.col(order) == F.col("_first")).alias("_head"), F.col("doc_id").cast("string").alias("_id"))
    least = asked.agg(F.min("query_id").alias("_least"))
    rows = some.unionAll(none).crossJoin(F.broadcast(least))  # one row
    text = F.when(F.col("_head") & (F.col("query_id") > F.col("_least")), F.concat(F.lit("\n"), "_id")).otherwise(F.col("_id"))
    rows = rows.select("query_id", "_order", text.alias("value"))
    rows = rows.repartitionByRange("query_id", "_order").sortWithinPartitions("query_id", "_order")
    rows.select("value").write.mode("overwrite").option("lineSep", " ").text(path)


def write_directory(docs: DataFrame, path: str) -> None:
    """A file for each document (doc_id, text), in a folder of its id; tasks write them, one after another.

    Ids are unique; null texts are empty. ``readers.directory`` reads them again. Tasks make the files themselves:
    Spark's writer would sort the rows and move every file twice. A file has its name when it is whole, and a task
    that is run again makes the same names.
    """
    spark = docs.sparkSession
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    folder = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(folder)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)
    target = folder.toString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = scratch.file_system(target)
        files.create_dir(root, recursive=True)
        task, at = TaskContext.get().partitionId(), 0
        for batch in batches:
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                own = f"{root}/doc_id={NO_ID if i is None else i}"
                name = f"part-{task:05d}-{at}.txt"
                files.create_dir(own)
                fresh = f"{own}/_{uuid.uuid4().hex}"
                with files.open_output_stream(fresh) as out:
                    out.write(text + b"\n")
                files.move(fresh, f"{own}/{name}")
                at += 1
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], names=["n"])

    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    rows.mapInArrow(run, "n long").agg(F.sum("n")).collect()


def write_cases(df: DataFrame, path: str) -> None:
    """Zoned documents as CSV files with a header, as ``readers.zoned_csv`` reads them: nulls and empty texts
    stay apart (so not all fields are quoted), and blanks and line feeds at the ends of a text stay on it."""
    own = df.write.mode("overwrite").option("header", True).option("escape", '"')
    own.option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)


def prediction_lines(tests: DataFrame, predicted: DataFrame, key: str = "line_no") -> DataFrame:
    """(key, line): label, a space, and the line itself."""
    return tests.join(predicted, key).select(key, F.concat_ws(" ", "label", "text").alias("line"))
