from __future__ import annotations

import pytest

from termforge.operators import grid, index, rank

CASES = [
    (1, "license version thing thing", "license", "2001-01-01", "high"),
    (2, "thing of the version", "thing", "2002-01-01", "low"),
    (3, "license license license other", "other", "2003-01-01", "high"),
    (4, "nothing here", "none", "2004-01-01", None),
]


@pytest.fixture(scope="module")
def parts(spark):
    cases = spark.createDataFrame(CASES, "doc_id long, content string, title string, date_posted string, court string")
    zoned = index.zoned_index(cases).cache()
    postings = zoned.join(index.zone_total(zoned), ["term", "doc_id"]).select("term", "doc_id", "tf", "tf_title").cache()
    stats = index.doc_stats(postings).cache()
    plain = spark.createDataFrame([(False, 1, "license", 0.5, 0), (False, 1, "thing", 0.25, 1)], "expansion boolean, query_id long, term string, wq double, first_pos int")
    more = spark.createDataFrame([(True, 1, "license", 0.5, 0), (True, 1, "version", 0.75, 0)], plain.schema)
    weights = spark.createDataFrame([("high", 1.4)], "court string, weight double")
    return plain.unionAll(more), postings, stats, cases.select("doc_id", "court"), weights


def test_every_configuration_is_its_own_query(spark, parts):
    weights, postings, stats, courts, court_weights = parts
    got = {}
    for r in grid.scores(grid.all_configs(spark), *parts).collect():
        got.setdefault((r.expansion, r.tf_method, r.with_titles, r.with_courts), {})[r.doc_id] = (r.score, r.first_pos)
    assert len(got) == 32
    for (expansion, method, titles, with_courts), rows in got.items():
        own = rank.smart_scores(weights.where(f"expansion = {expansion}"), postings, stats, method, titles)
        if with_courts:
            own = rank.court_boosted(own, courts, court_weights)
        assert rows == {r.doc_id: (pytest.approx(r.score), r.first_pos) for r in own.collect()}


def test_chosen_configurations(spark, parts):
    schema = grid.all_configs(spark).schema
    configs = spark.createDataFrame([(True, "l", True, False), (True, "l", True, False), (False, "a", False, True)], schema)
    ranked = grid.rankings(grid.scores(configs, *parts), 2)
    assert {(r.expansion, r.tf_method) for r in ranked.collect()} == {(True, "l"), (False, "a")}
    queries = spark.createDataFrame([(1, "license"), (2, "unknown")], "query_id long, query string")
    lines = {(r.expansion, r.query_id): r.result for r in grid.report(configs, queries, ranked).collect()}
    assert lines[True, 2] == lines[False, 2] == "" and len(lines) == 4 and lines[True, 1].split()[0] == "1" and len(lines[False, 1].split()) == 2
    assert grid.scores(configs.limit(0), *parts).collect() == []
    with pytest.raises(ValueError):
        grid.scores(spark.createDataFrame([(True, "q", True, False)], schema), *parts)
