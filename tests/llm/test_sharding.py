from __future__ import annotations

import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

from termforge.llm import queries, sharding


def plain(x, n, seed):
    """The permutation, number by number."""
    a, b = sharding.bases(n)
    while True:
        pair = [x // b, x % b]
        for k, key in enumerate(sharding.round_keys(seed)):
            y = ((pair[1 - k % 2] ^ key) * sharding.MIX[0]) % 2**31
            y ^= y >> 15
            y = (y * sharding.MIX[1]) % 2**31
            y ^= y >> 13
            pair[k % 2] = (pair[k % 2] + y) % (a, b)[k % 2]
        x = pair[0] * b + pair[1]
        if x < n:
            return x


@pytest.mark.parametrize("n", [1, 2, 3, 5, 24, 97, 1000])
def test_permutation_and_its_inverse(spark, n):
    rows = spark.range(n).select(F.col("id").alias("row_no"))
    placed = sharding.locate(rows, n, 7, seed=5)
    got = {r.row_no: (r.shard, r.slot) for r in placed.collect()}
    assert got == {i: (plain(i, n, 5) % 7, plain(i, n, 5) // 7) for i in range(n)}
    assert sorted(s * 7 + h for h, s in got.values()) == list(range(n))
    back = sharding.row_at(placed.select("shard", "slot", F.col("row_no").alias("was")), n, 7, seed=5)
    assert all(r.row_no == r.was for r in back.collect())


def test_bases_hold_every_count():
    for n in [0, 1, 2, 3, 4, 5, 99, 100, 101, 10**6 + 1, 10**12 + 7, 2**61 + 9]:
        a, b = sharding.bases(n)
        assert n <= a * b < n + max(a, 2) and a < 2**31 and abs(a - b) <= 1


def odd_rows():
    texts = [None, "", "ä€🙂", "x" * 300_000, "same", "same", "same"]
    return [(i // 2 if i % 5 else None, texts[i % 7], i, "k") for i in range(100)]


def test_odd_rows_and_clashing_columns(spark, tmp_path):
    df = spark.createDataFrame(odd_rows(), "doc_id long, text string, slot int, row_no string")
    got = sharding.shard_rows(df, 6).collect()
    assert len(got) == 100 and got[0].asDict().keys() == {"doc_id", "text", "row_no", "shard", "slot"}
    by = {}
    for r in got:
        by.setdefault(r.shard, []).append(r.slot)
    assert sorted(map(len, by.values())) == [16, 16, 17, 17, 17, 17]
    assert all(sorted(v) == list(range(len(v))) for v in by.values())
    assert sorted((r.doc_id is None, r.doc_id or 0, r.text or "") for r in got) == sorted((a is None, a or 0, b or "") for a, b, *_ in odd_rows())
    assert sharding.shard_rows(df.limit(0), 6).collect() == []


def test_places_do_not_depend_on_tasks_and_shards_are_written_in_order(spark, tmp_path):
    path = str(tmp_path / "table.parquet")
    spark.range(3000).select(F.col("id").alias("doc_id"), F.repeat(F.lit("w "), 50).alias("text")).repartition(5).write.option("parquet.block.size", 4096).parquet(path)
    first = {r.doc_id: (r.shard, r.slot) for r in sharding.shard_table(spark, path, 24).collect()}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "3000")
    try:
        again = sharding.shard_table(spark, path, 24)
        assert again.rdd.getNumPartitions() > 5
        assert {r.doc_id: (r.shard, r.slot) for r in again.collect()} == first
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    sharding.write_shards(again, str(tmp_path / "shards"), rows_per_file=50)
    for part in (0, 1, 2):
        files = list((tmp_path / "shards" / "shard=3" / f"part_no={part}").glob("*.parquet"))
        assert len(files) == 1
        slots = [r.slot for r in spark.read.parquet(str(files[0])).select("slot").collect()]
        assert slots == list(range(50 * part, min(125, 50 * part + 50)))


def test_query_against_sql(spark, tmp_path):
    df = spark.createDataFrame(odd_rows(), "doc_id long, text string, slot int, row_no string")
    df.where("length(text) < 1000 or text is null").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    c = duckdb.connect()
    c.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    got = queries.op13_shards(spark, str(tmp_path))
    assert got.dtypes == [("doc_id", "bigint"), ("size", "bigint"), ("text_crc32", "bigint"), ("law", "string"), ("shard", "int"), ("slot", "bigint"), ("grown_shard", "int")]
    got = sorted(map(tuple, got.collect()), key=repr)
    assert got == sorted(c.execute(queries.OP13_SQL).fetchall(), key=repr)
    assert {(r[1], r[2]) for r in got} == {(len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for _, t, *_ in odd_rows() if t is None or len(t) < 1000}
