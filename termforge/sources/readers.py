"""Sources: labelled lines, plain lines, directories of documents, zoned CSV files and query files."""

from __future__ import annotations

import itertools
import os
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

CASES = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("content", T.StringType()),
        T.StructField("title", T.StringType()),
        T.StructField("date_posted", T.StringType()),
        T.StructField("court", T.StringType()),
    ]
)


def numbered_lines(spark: SparkSession, path: str, column: str = "text", number: str = "line_no") -> DataFrame:
    """(number, column) of text files. Lines are numbered from 1 in the order of files and their lines.

    Files are read in blocks by many tasks: a line's number is the number of lines in the blocks before,
    of which there is one small row each, and its place in its own block.
    """
    lines = spark.read.text(path).select(
        F.col("value").alias(column),
        F.struct("_metadata.file_path", "_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_at"),
    )
    blocks = lines.groupBy("_block").agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.orderBy("_block")) - F.col("_n")
    blocks = blocks.select("_block", (before - F.col("_first") + 1).alias("_shift"))
    return lines.join(F.broadcast(blocks), "_block").select((F.col("_at") + F.col("_shift")).alias(number), column)


def labelled_lines(spark: SparkSession, path: str) -> DataFrame:
    """(lang, text): the first space parts the label from the text; lines without a space have a null text."""
    parts = F.split("value", " ", 2)
    return spark.read.text(path).select(F.get(parts, F.lit(0)).alias("lang"), F.get(parts, F.lit(1)).alias("text"))


#: The folder of documents without an id.
NO_ID = "__HIVE_DEFAULT_PARTITION__"


def directory(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, text) of a directory with one file per document: named by its integer id, or in a folder
    ``doc_id=N`` as ``sinks.write_directory`` writes it, where a last line feed is no part of the text.

    A task reads many small files. A plain folder is listed by a task and read by others, so that the driver
    does not hold every file's name and status; other paths are left to Spark's reader.
    """
    local = re.sub(r"^file:/*", "/", path)
    rows = _files_of(spark, local) if os.path.isdir(local) else None
    if rows is None:
        found = spark.read.option("recursiveFileLookup", "true").text(path, wholetext=True)
        rows = found.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_name").alias("name"), "value")
    folder = F.regexp_extract("path", rf"/doc_id=(-?\d+|{NO_ID})/[^/]+$", 1)
    return rows.select(
        F.when(folder != "", folder.try_cast("long")).otherwise(F.col("name").try_cast("long")).alias("doc_id"),
        F.when(folder != "", F.regexp_replace("value", r"\n\z", "")).otherwise(F.col("value")).alias("text"),
    )


def _files_of(spark: SparkSession, root: str) -> DataFrame:
    """(path, name, value) of the files below a folder; hidden ones are left out, as Spark does."""

    def shown(name: str) -> bool:
        return not (name.startswith(".") or (name.startswith("_") and "=" not in name) or name.endswith("._COPYING_"))

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _ in batches:
            with os.scandir(root) as entries:
                names = (e.name for e in entries if shown(e.name))
                while some := list(itertools.islice(names, 10_000)):
                    yield pa.RecordBatch.from_arrays([pa.array(some, pa.string())], names=["entry"])

    def files_in(path: str) -> Iterator[str]:
        if os.path.isdir(path):
            for name in filter(shown, os.listdir(path)):
                yield from files_in(f"{path}/{name}")
        else:
            yield path

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["path", "name", "value"]
        out: list[tuple[str, str, bytes]] = []
        held = 0
        for batch in batches:
            for entry in batch.column(0).to_pylist():
                for path in files_in(f"{root}/{entry}"):
                    with open(path, "rb") as f:
                        out.append((path, os.path.basename(path), f.read()))
                    held += len(out[-1][2])
                    if held > 4_000_000 or len(out) >= 5000:
                        yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out)], names=names)
                        out, held = [], 0
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out)], names=names)

    entries = spark.range(0, 1, 1, 1).mapInArrow(listed, "entry string")
    entries = entries.repartition(4 * spark.sparkContext.defaultParallelism, "entry")
    return entries.mapInArrow(read, "path string, name string, value binary").withColumn("value", F.col("value").cast("string"))


def zoned_csv(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, content, title, date_posted, court) of a CSV file with a header; fields may hold line breaks.

    Nothing between two commas is null, a pair of quotes is an empty text; blanks at the ends of a field belong to it.
    """
    return (
        spark.read.schema(CASES)
        .option("header", True)
        .option("multiLine", True)
        .option("quote", '"')
        .option("escape", '"')
        .option("nullValue", uuid.uuid4().hex)  # what a field of nothing is called on its way; by default empty texts would be null too
        .csv(path)
    )


def queries(spark: SparkSession, path: str) -> DataFrame:
    """(query_id, query), one query a line."""
    return numbered_lines(spark, path, "query", "query_id")


def result_lines(spark: SparkSession, path: str) -> DataFrame:
    """(line_no, rank, doc_id) of lines of ids parted by blanks, such as ``sinks.write_result_lines`` writes.

    The text is read id by id and a line may be of any length: line feeds and ids are counted by block,
    and within a block by a running sum.
    """
    ids = spark.read.option("lineSep", " ").text(path).select(
        F.struct("_metadata.file_path", "_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_at"),
        (F.length("value") - F.length(F.replace("value", F.lit("\n"), F.lit("")))).alias("_feeds"),
        F.nullif(F.replace("value", F.lit("\n"), F.lit("")), F.lit("")).cast("long").alias("doc_id"),
    )
    sums = ids.groupBy("_block").agg(F.sum("_feeds").alias("_f"), F.count("doc_id").alias("_n"))
    before = Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)  # a row for each block of a file
    sums = sums.select("_block", *(F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"{c}_before") for c in ("_f", "_n")))
    running = Window.partitionBy("_block").orderBy("_at").rowsBetween(Window.unboundedPreceding, 0)
    ids = ids.select("*", F.sum("_feeds").over(running).alias("_f"), F.count("doc_id").over(running).alias("_n"))
    ids = ids.where("doc_id is not null").join(F.broadcast(sums), "_block")
    ids = ids.select((F.col("_f") + F.col("_f_before") + 1).alias("line_no"), (F.col("_n") + F.col("_n_before")).alias("_place"), "doc_id")
    heads = ids.groupBy("line_no").agg(F.min("_place").alias("_head"))  # a row for each line
    return ids.join(heads, "line_no").select("line_no", (F.col("_place") - F.col("_head") + 1).alias("rank"), "doc_id")


#: Characters of text that a task of ``by_document`` gets, about.
TASK_CHARS = 8_000_000


def by_document(df: DataFrame, *texts: str) -> DataFrame:
    """``df`` dealt out by doc_id, about TASK_CHARS characters of ``texts`` to a task.

    What is grouped by document and something else behind it is not shuffled again, so that texts are
    shuffled once instead of their words, and a task's groups fit in its memory.
    """
    chars = df.agg(sum(F.coalesce(F.sum(F.length(c)), F.lit(0)) for c in texts)).first()[0]
    return df.repartition(max(df.sparkSession.sparkContext.defaultParallelism, chars // TASK_CHARS + 1), "doc_id")


def spread(df: DataFrame) -> DataFrame:
    """Deal rows out anew only where the scan has fewer partitions than there are cores."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
