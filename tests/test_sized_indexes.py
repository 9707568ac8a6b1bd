from __future__ import annotations

from termforge.functions import porter
from termforge.operators import index, rank
from termforge.sources import readers

DOCS = [(1, "licenses and licensing of things"), (2, "the thing is licensed, the version too"), (3, None), (4, "versions Versioned version")]


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_words_are_not_shuffled(spark):
    """Texts dealt out by document: neither postings nor statistics shuffle the words once more."""
    docs = readers.by_document(spark.createDataFrame(DOCS, "doc_id long, text string"), "text")
    for df in (index.boolean_index(docs), index.tf_index(docs), index.doc_stats(index.tf_index(docs))):
        assert plan_of(df).count("Exchange hashpartitioning(") == 1
    assert index.tf_index(docs).where("term = 'version'").collect()[0].asDict() in ({"term": "version", "doc_id": 2, "tf": 1}, {"term": "version", "doc_id": 4, "tf": 1})


def test_postings_of_a_batch(spark):
    docs = spark.createDataFrame(DOCS, "doc_id long, text string")
    only = spark.createDataFrame([("version",), ("licens",), ("zzz",)], "term string")
    assert {tuple(r) for r in index.tf_index(docs, only=only).collect()} == {("version", 2, 1), ("version", 4, 1)}
    assert {tuple(r) for r in index.tf_index(docs, stem=True, only=only).collect()} == {("licens", 1, 2), ("licens", 2, 1), ("version", 2, 1), ("version", 4, 3)}


def test_stems_of_frequent_and_other_terms(spark, monkeypatch):
    docs = spark.createDataFrame(DOCS, "doc_id long, text string")
    whole = {tuple(r) for r in index.tf_index(docs, stem=True).collect()}
    monkeypatch.setattr(porter, "STEMS", 2)
    assert {tuple(r) for r in index.tf_index(docs, stem=True).collect()} == whole
    assert ("licens", 1, 2) in whole and ("thing", 2, 1) in whole


def test_weights_of_tf_alone_need_no_statistics(spark):
    postings = spark.createDataFrame([("a", 1, 10)], "term string, doc_id long, tf long")
    weights = spark.createDataFrame([(1, "a", 2.0, 0)], "query_id long, term string, wq double, first_pos int")
    stats = spark.createDataFrame([], "doc_id long, len_n double, len_l double, len_a double, len_ave double, max_tf long, ave_tf double")
    assert [r.score for r in rank.smart_scores(weights, postings, stats, "l").collect()] == [4.0]
