from __future__ import annotations

from pyspark.sql import functions as F

from termforge.operators import rank
from termforge.sources import readers, sinks


def test_directory_round_trip(spark, tmp_path):
    rows = [(i, t) for i, t in enumerate(["one", "", None, "a\nb\n", "\n", "ü " * 500, "x\r\ny"], -2)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    sinks.write_directory(df, str(tmp_path / "d"))
    assert len(list((tmp_path / "d").glob("doc_id=*/part-*"))) == len(rows)
    got = readers.directory(spark, str(tmp_path / "d"))
    assert sorted(map(tuple, got.collect())) == [(i, t or "") for i, t in rows]


def test_directory_of_named_files(spark, tmp_path):
    for i in range(300):
        (tmp_path / str(i)).write_text(f"text {i}\n")
    got = readers.directory(spark, str(tmp_path))
    assert sorted(map(tuple, got.collect())) == [(i, f"text {i}\n") for i in range(300)]
    assert got.rdd.getNumPartitions() < 60  # many small files in a task


def test_lookup_reads_the_buckets_of_its_terms(spark, tmp_path):
    words = F.concat(F.lit("w"), (F.col("id") % 500).cast("string"))
    postings = spark.range(20_000).select(F.when(F.col("id") % 3 == 0, "hot").otherwise(words).alias("term"), F.col("id").alias("doc_id"), F.lit(1).alias("tf"))
    sinks.save_postings(str(tmp_path), postings, 32)
    terms = spark.createDataFrame([("w7",), ("w8",), ("w7",), ("none",), (None,), ("",)], "term string")
    found = sinks.lookup(spark, str(tmp_path), terms)
    assert sorted((r.term, r.doc_id) for r in found.collect()) == sorted((r.term, r.doc_id) for r in postings.where("term in ('w7', 'w8')").collect())
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "dynamicpruning" in plan.lower()
    scan = plan[: plan.index("FileScan parquet")].splitlines()
    assert not any("Exchange hashpartitioning(bucket" in x for x in scan)  # postings stay where they are
    sizes = lambda name: [m["value"] for m in _metrics(found) if m["name"] == name]
    assert max(sizes("number of partitions read")) <= 3 < len(list((tmp_path / "postings").glob("bucket=*")))
    hot = sinks.lookup(spark, str(tmp_path), spark.createDataFrame([("hot",)], "term string"))
    assert hot.count() == 6667
    assert sinks.lookup(spark, str(tmp_path), terms.limit(0)).collect() == []


def _metrics(df):
    """Metrics of the nodes of the plan that ran."""
    plan, out, todo = df._jdf.queryExecution().executedPlan(), [], []
    todo.append(plan)
    while todo:
        node = todo.pop()
        name = node.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec":
            todo.append(node.executedPlan())
            continue
        if name.endswith("QueryStageExec"):
            todo.append(node.plan())
            continue
        it = node.metrics().iterator()
        while it.hasNext():
            pair = it.next()
            metric = pair._2()
            out.append({"name": metric.name().get() if metric.name().isDefined() else pair._1(), "value": metric.value()})
        kids = node.children().iterator()
        while kids.hasNext():
            todo.append(kids.next())
    return out


def test_query_file(spark, tmp_path):
    (tmp_path / "q.txt").write_text('"the thing" AND "version of"\nthe thing\n\n"and" AND "or not" OR\n')
    rows = rank.query_terms(readers.queries(spark, str(tmp_path / "q.txt")), operator_words=("AND",)).collect()
    expected = [(1, "the", 1, 1), (1, "thing", 1, 2), (1, "version", 1, 6), (1, "of", 1, 7), (2, "the", 1, 0), (2, "thing", 1, 1), (4, "and", 1, 1), (4, "or", 2, 5), (4, "not", 1, 6)]
    assert sorted(map(tuple, rows)) == sorted(expected)


def test_zoned_csv_round_trip_of_blanks_nulls_and_empty_texts(spark, tmp_path):
    texts = ["", None, " ", "  lead", "trail \t", "\n", "x\n", "\nx", "\r", "a\r\nb", "\x00z", 'a,b\n\n,"\n', '"', ' "a" ', '""', "\\", 'a\\"b\\', "#c"]
    rows = [(i, t, t, "2000-01-01", t) for i, t in enumerate(texts)] + [(None, None, None, None, None)]
    df = spark.createDataFrame(rows, readers.CASES).repartition(3)
    sinks.write_cases(df, str(tmp_path / "c"))
    got = readers.zoned_csv(spark, str(tmp_path / "c")).collect()
    assert sorted(map(tuple, got), key=str) == sorted(rows, key=str)


def test_directory_is_not_listed_by_the_driver(spark, tmp_path):
    rows = [(i, f"text {i}") for i in range(200)] + [(None, "none")]
    sinks.write_directory(spark.createDataFrame([(7, "old")], "doc_id long, text string"), str(tmp_path / "d"))
    sinks.write_directory(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), f"file:{tmp_path}/d")
    assert not [p for p in (tmp_path / "d").rglob("*") if p.name.endswith(".crc") or p.name.startswith("_")]
    (tmp_path / "d" / "_hidden").write_text("no")
    (tmp_path / "d" / "deeper").mkdir()
    (tmp_path / "d" / "deeper" / "900").write_text("named\n")
    for path in (f"{tmp_path}/d", f"file://{tmp_path}/d"):
        got = readers.directory(spark, path)
        assert got.inputFiles() == []  # no file's status reaches the driver
        assert sorted(map(tuple, got.collect()), key=str) == sorted([*rows, (900, "named\n")], key=str)
