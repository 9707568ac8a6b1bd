"""Helpers that several operators share: samples, salted joins, partition spreading; scratch tables by name."""

from __future__ import annotations

import ctypes
import gc

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from termforge.sources.scratch import discard, file_system, mark as scratch_mark, new_path, shared_dir, written, written_path  # noqa: F401

#: Tables of ids and hashes up to this many rows are broadcast (some 20 bytes a row).
BROADCAST_ROWS = 1_000_000
#: At most so many frequent keys of a join are salted.
SALTED_KEYS = 100_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Deal rows out anew only where the scan has fewer partitions than the cluster has cores."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores * 2) if df.rdd.getNumPartitions() < cores else df


def small_broadcast(df: DataFrame) -> DataFrame:
    """``df`` to be broadcast if it has at most BROADCAST_ROWS rows, which are counted; else as it is."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def joined_salted(big: DataFrame, small: DataFrame, key: str, salt: str, per: int = 1000) -> DataFrame:
    """Inner join on ``key``, of which ``small`` has one row each, with frequent keys of ``big`` dealt over many tasks.

    Rows of a key with more than ``per`` rows are salted by column ``salt`` and its row of ``small`` is
    repeated for each salt. Only the numbers of salts of such keys are broadcast: ``per`` rises with
    the table, so that they are at most SALTED_KEYS.
    """
    counts = big.groupBy(key).agg(F.count("*").alias("_n"))
    total = counts.agg(F.sum("_n")).first()[0] or 0
    per = max(per, total // SALTED_KEYS)
    heavy = F.broadcast(counts.where(F.col("_n") > per).select(key, F.ceil(F.col("_n") / per).cast("int").alias("_salts")))
    many = F.coalesce("_salts", F.lit(1))
    big = big.join(heavy, key, "left").withColumn("_salt", F.pmod(F.xxhash64(salt), many).cast("int")).drop("_salts")
    small = small.join(heavy, key, "left").withColumn("_salt", F.explode_outer(F.sequence(F.lit(0), many - 1))).drop("_salts")
    return big.join(small, [key, "_salt"]).drop("_salt")


def give_back() -> None:
    """Return freed memory of this process to the machine: Python workers are used again by later stages,
    and what one stage has needed would stay with them."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
    if trim is not None:
        trim(0)


def trimmed(work):
    """A function over batches that gives memory back when a task has ended."""

    def run(batches):
        yield from work(batches)
        give_back()

    return run


def fold_remainder(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo the number of folds; null ids count as remainder 0."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % folds, F.lit(0))


def class_sample(rows: DataFrame, label: str, per_class: int) -> DataFrame:
    """At most ``per_class`` rows of each of the label's values, those with the smallest id hash.

    ``rows`` has doc_id and ``label``. Only ids and labels take part, so the result is small
    (``per_class`` times the number of classes) and may be broadcast.
    """
    by_hash = [F.xxhash64("doc_id"), F.col("doc_id")]
    salt = F.pmod(F.xxhash64("doc_id"), F.lit(64))
    out = rows.where(F.col(label).isNotNull())
    for keys in ([F.col(label), salt], [F.col(label)]):  # a frequent label's rows are cut in 64 parts first
        out = out.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*by_hash)))
        out = out.where(F.col("_rank") <= per_class).drop("_rank")
    return out


def one_label(labels: DataFrame, label: str) -> DataFrame:
    """doc_id and label, one row per id; of contradicting labels the largest holds."""
    return (
        labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull())
        .groupBy("doc_id")
        .agg(F.max(label).cast("int").alias(label))
    )
