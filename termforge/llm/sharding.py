"""Shuffled shards by arithmetic: a keyed permutation of row numbers says where every row goes.

Rows of a stored table are numbered in the order of its files and of their rows, which are counted, not
sorted. A Feistel network permutes the numbers 0 .. n - 1: a number is a pair (left, right) of digits
below two bases whose product is n or a little more, and each round adds a keyed hash of one digit to the
other. Numbers that fall outside go through the network again until they are inside (cycle walking), so
the permutation is one of exactly n numbers. Row number p after the permutation stands in shard
p mod shards at slot p div shards: counts of shards are at most one apart and slots have no gaps.

Nothing is shuffled, and shard and slot of a row, or the row of a shard and slot, can be computed without
the data (``locate``, ``row_at``).
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from termforge.llm import common

ROUNDS = 8
#: Row counts of up to so many files are broadcast (some 150 bytes each).
FILES = 200_000
#: Odd multipliers below 2**31 of the rounds' hash, and its word.
MIX, WORD = (0x2C1B3C6D, 0x297A2D39), (1 << 31) - 1
LAW = "rows"
_AT = "__row_no"


def bases(n: int) -> tuple[int, int]:
    """Two numbers as equal as can be, whose product is the least such one that is at least n."""
    a = max(1, math.isqrt(max(0, n - 1)) + 1)
    return a, max(1, -(-n // a))


def round_keys(seed: int) -> list[int]:
    return [(seed * 0x9E3779B1 + (i + 1) * 0x85EBCA6B) & WORD for i in range(ROUNDS)]


def hashed(x: Column, key: Column) -> Column:
    """A whole number below 2**31 of one below 2**31; products stay below 2**62."""
    y = (x.bitwiseXOR(key) * MIX[0]).bitwiseAND(F.lit(WORD))
    y = y.bitwiseXOR(F.shiftright(y, 15))
    y = (y * MIX[1]).bitwiseAND(F.lit(WORD))
    return y.bitwiseXOR(F.shiftright(y, 13))


def network(x: Column, n: int, seed: int, back: bool = False) -> Column:
    """A whole number below the product of the bases, sent through the network (or its inverse) once.

    The rounds are a fold over their keys, so that ``x`` stands in the expression once.
    """
    a, b = bases(n)
    rounds = [F.struct(F.lit(k).cast("long").alias("key"), F.lit(i % 2 == 0).alias("left")) for i, k in enumerate(round_keys(seed))]

    def step(pair: Column, r: Column) -> Column:
        def moved(to: str, by: str, base: int) -> Column:
            h = hashed(pair[by], r["key"])
            return F.pmod(pair[to] - h if back else pair[to] + h, F.lit(base).cast("long"))

        left = F.when(r["left"], moved("l", "r", a)).otherwise(pair["l"])
        right = F.when(r["left"], pair["r"]).otherwise(moved("r", "l", b))
        return F.struct(left.alias("l"), right.alias("r"))

    def pair_of(x: Column) -> Column:
        return F.struct(F.call_function("div", x, F.lit(b).cast("long")).alias("l"), (x % F.lit(b).cast("long")).alias("r"))

    # one element in a lambda, so that both digits come from one value
    start = F.transform(F.array(x.cast("long")), pair_of)[0]
    return F.aggregate(F.array(*(rounds[::-1] if back else rounds)), start, step, lambda p: p["l"] * F.lit(b).cast("long") + p["r"])


def walks(spark: SparkSession, n: int, seed: int, back: bool = False) -> int:
    """How often the network must be applied again until no number is outside: the longest walk of all
    outside numbers that an inside one is sent to; outside are fewer than the square root of n (plus one)."""
    a, b = bases(n)
    entered = network(F.col("id"), n, seed, not back) < n
    out, times = spark.range(n, a * b).where(entered).select(F.col("id").alias("x")), 0
    while not out.isEmpty():
        out = out.select(network(F.col("x"), n, seed, back).alias("x")).where(F.col("x") >= n)
        times += 1
    return times


def permuted(spark: SparkSession, x: Column, n: int, seed: int, back: bool = False) -> Column:
    """The permutation (or its inverse) of numbers 0 .. n - 1: cycle walking until every number is inside."""
    again = F.sequence(F.lit(0), F.lit(walks(spark, n, seed, back)))
    step = lambda x, i: F.when((i == 0) | (x >= n), network(x, n, seed, back)).otherwise(x)
    return F.aggregate(again, x.cast("long"), step)


def locate(rows: DataFrame, n: int, shards: int, seed: int = 0, row_no: str = "row_no") -> DataFrame:
    """``rows`` with shard and slot of the row numbers (0 .. n - 1) in column ``row_no``."""
    rest = [F.col(f"`{c}`") for c in rows.columns if c not in ("shard", "slot")]
    out = rows.select(*rest, permuted(rows.sparkSession, F.col(row_no), n, seed).alias("__x"))
    return out.select(*rest, (F.col("__x") % shards).cast("int").alias("shard"), F.expr(f"__x div {shards}L").alias("slot"))


def row_at(places: DataFrame, n: int, shards: int, seed: int = 0) -> DataFrame:
    """``places`` (shard, slot) with the number of the row that stands there, as row_no."""
    at = F.col("slot") * shards + F.col("shard")
    return places.withColumn("row_no", permuted(places.sparkSession, at, n, seed, back=True))


def numbered(spark: SparkSession, path: str) -> tuple[DataFrame, int]:
    """The rows of a Parquet table with their global numbers in column __row_no, and how many there are.

    A number is the count of rows in the files before plus the row's place in its file, however the
    files are split over tasks. Counting reads no column.
    """
    table = spark.read.parquet(path)
    meta = table.metadataColumn("_metadata")
    files = common.written(table.select(meta["file_path"].alias("__file")).groupBy("__file").agg(F.count("*").alias("__n")), "shard-files")
    n = files.agg(F.sum("__n")).first()[0] or 0
    before = F.sum("__n").over(Window.orderBy("__file")) - F.col("__n")  # a row for each file
    offsets = files.select("__file", before.alias("__before"))
    rows = table.select("*", meta["file_path"].alias("__file"), meta["row_index"].alias("__at"))
    out = rows.join(F.broadcast(offsets) if files.count() <= FILES else offsets, "__file")
    return out.select(*(F.col(f"`{c}`") for c in table.columns), (F.col("__before") + F.col("__at")).alias(_AT)), n


def shard_table(spark: SparkSession, path: str, shards: int, seed: int = 0) -> DataFrame:
    """All rows and columns of a Parquet table with shard (int, from 0) and slot (long, from 0).

    Law ``rows``: counts of shards are at most one apart. The same files give the same places, whatever
    tasks read them. Values do not matter: nulls, repeated rows and texts of any length are rows like
    others, each with a place of its own. Columns of the table called shard or slot give way to the new
    ones. An empty table gives no rows.
    """
    rows, n = numbered(spark, path)
    return locate(rows, n, shards, seed, _AT).drop(_AT)


def shard_rows(df: DataFrame, shards: int, seed: int = 0) -> DataFrame:
    """``shard_table`` of any rows: they are written to the shared folder first, which fixes their order."""
    return shard_table(df.sparkSession, common.written_path(df, "shard-rows"), shards, seed)


def write_shards(sharded: DataFrame, path: str, rows_per_file: int = 100_000) -> None:
    """Write every shard as files ``shard=S/part_no=P`` of ``rows_per_file`` rows in the order of their slots.

    This is the one shuffle of the texts; a shard is cut into many tasks.
    """
    parts = sharded.withColumn("part_no", F.expr(f"slot div {rows_per_file}L"))
    parts = parts.repartition("shard", "part_no").sortWithinPartitions("shard", "part_no", "slot")
    parts.write.partitionBy("shard", "part_no").parquet(path)
