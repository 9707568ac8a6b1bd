from __future__ import annotations

from termforge.sources import readers, sinks


def test_round_trip_over_many_tasks(spark, tmp_path):
    sizes = {1: 0, 2: 5000, 3: 0, 4: 0, 5: 1, 6: 2, 9: 0}
    rows = [(q, k, (k * 7919) % 100_003) for q, n in sizes.items() for k in range(1, n + 1)]
    results = spark.createDataFrame(rows, "query_id long, rank int, doc_id long").repartition(7)
    asked = spark.createDataFrame([(q,) for q in sizes], "query_id long")
    path = tmp_path / "out"
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # small parts stay apart
    try:
        sinks.write_result_lines(asked, results, str(path), "rank")
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    parts = sorted(path.glob("part-*"))
    assert len(parts) > 1 and max(p.stat().st_size for p in parts) < 20_000  # the long line is cut
    lines = "".join(p.read_text() for p in parts).split("\n")
    assert [[int(x) for x in line.split()] for line in lines] == [[d for a, _, d in sorted(rows) if a == q] for q in sizes]
    number = {q: i for i, q in enumerate(sizes, 1)}
    for split in ("700", "100000000"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", split)
        try:
            got = sorted(map(tuple, readers.result_lines(spark, str(path)).collect()))
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")
        assert got == sorted((number[q], k, d) for q, k, d in rows)


def test_no_answers_and_no_queries(spark, tmp_path):
    results = spark.createDataFrame([], "query_id long, doc_id long")
    sinks.write_result_lines(spark.createDataFrame([(1,), (2,)], "query_id long"), results, str(tmp_path / "a"), "doc_id")
    assert "".join(p.read_text() for p in sorted((tmp_path / "a").glob("part-*"))).split("\n") == [" ", " "]
    assert readers.result_lines(spark, str(tmp_path / "a")).collect() == []
    sinks.write_result_lines(results.select("query_id"), results, str(tmp_path / "b"), "doc_id")
    assert readers.result_lines(spark, str(tmp_path / "b")).collect() == []
