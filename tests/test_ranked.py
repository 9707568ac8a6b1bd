from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from termforge.operators import expand, feedback, index, rank
from tests.test_boolean import DOCS


@pytest.fixture(scope="module")
def corpus(spark):
    docs = spark.createDataFrame(DOCS, "doc_id long, text string")
    postings = index.tf_index(docs).cache()
    n = spark.createDataFrame([(5,)], "n long")
    return postings, index.dictionary(postings).cache(), n


def weights(spark, corpus, query, idf):
    _, dictionary, n = corpus
    q = spark.createDataFrame([(1, query)], "query_id long, query string")
    return rank.query_weights(rank.query_terms(q), dictionary, n, idf)


def ids(df):
    return [r.doc_id for r in df.orderBy("rank").collect()]


def test_norms(corpus):
    got = {r.doc_id: round(r.len_l, 6) for r in index.doc_norms(corpus[0]).collect()}
    assert got == {1: 1.640938, 2: 1.414214, 3: 1.783785, 4: 1.0, 5: 1.414214}


def test_cosine(spark, corpus):
    w = weights(spark, corpus, "apple cherry cherry zzz", "t")
    assert {r.term: round(r.wq, 6) for r in w.collect()} == {"apple": 0.39794, "cherry": 0.288632}
    scored = rank.cosine(w, corpus[0], index.doc_norms(corpus[0]))
    assert {r.doc_id: r.score for r in scored.collect()} == {3: 0.940001, 1: 0.493309, 2: 0.415167, 5: 0.415167}
    assert ids(rank.top_k(scored, 10)) == [3, 1, 2, 5]
    assert ids(rank.top_k(scored, 3)) == [3, 1, 5]
    line = rank.result_lines(spark.createDataFrame([(1,), (2,)], "query_id long"), rank.top_k(scored, 3))
    assert {r.query_id: r.result for r in line.collect()} == {1: "3 1 5", 2: ""}


def test_full_ranking(spark, corpus):
    w = weights(spark, corpus, "apple cherry cherry zzz", "p")
    scored = rank.scores(w, corpus[0], rank.log_tf())
    assert ids(rank.full_ranking(scored)) == [3, 1, 5, 2]
    w = weights(spark, corpus, "banana durian", "p")
    assert ids(rank.full_ranking(rank.scores(w, corpus[0], rank.log_tf()))) == [4, 5, 2, 1]


def test_term_in_every_document(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, "a")], "doc_id long, text string")
    p = index.tf_index(docs)
    q = spark.createDataFrame([(1, "a")], "query_id long, query string")
    n = spark.createDataFrame([(2,)], "n long")
    w = rank.query_weights(rank.query_terms(q), index.dictionary(p), n, "p")
    assert [r.wq for r in w.collect()] == [0.0]
    w = rank.query_weights(rank.query_terms(q), index.dictionary(p), n, "t")
    assert rank.cosine(w, p, index.doc_norms(p)).collect() == []


def test_operator_word_and_phrases(spark):
    q = spark.createDataFrame([(1, 'quiet AND "phone call" well-known OR')], "query_id long, query string")
    got = {r.term for r in rank.query_terms(q, operator_words=("AND",)).collect()}
    assert got == {"quiet", "phone", "call", "or"}


def test_smart_weights(spark, corpus):
    postings = corpus[0]
    stats = index.doc_stats(postings)
    s = {r.doc_id: r for r in stats.collect()}
    assert s[3].max_tf == 3 and s[3].ave_tf == 2.0
    assert s[1].len_n == pytest.approx(math.sqrt(5))
    w = weights(spark, corpus, "cherry", "t")
    idf = math.log10(5 / 3)
    expected = {"n": 3, "l": 1 + math.log10(3), "a": 1.0, "L": (1 + math.log10(3)) / (1 + math.log10(2))}
    for m, x in expected.items():
        got = {r.doc_id: r.score for r in rank.smart_scores(w, postings, stats, m).collect()}
        assert got[3] == pytest.approx(idf * x, abs=1e-6)


def test_zones_and_boosts(spark):
    rows = [(1, "apple pie", "apple", "2001-01-02", "High"), (2, "apple", None, None, "Low"), (2, "other", None, None, "Low")]
    cases = index.unique_cases(spark.createDataFrame(rows, "doc_id long, content string, title string, date_posted string, court string"))
    z = index.zoned_index(cases)
    got = {(r.term, r.doc_id): (r.tf_content, r.tf_title, r.tf_date, r.tf_court) for r in z.collect()}
    assert got["apple", 1] == (1, 1, 0, 0) and got["apple", 2] == (1, 0, 0, 0) and got["2001-01-02", 1] == (0, 0, 1, 0)
    assert ("other", 2) not in got and got["high", 1] == (0, 0, 0, 1)
    assert {(r.term, r.doc_id): r.tf for r in index.zone_total(z).collect()}["apple", 1] == 2
    scored = spark.createDataFrame([(1, 1, 2.0, 0), (1, 2, 2.0, 0)], "query_id long, doc_id long, score double, first_pos int")
    courts = spark.createDataFrame([("High", 1.4)], "court string, weight double")
    got = {r.doc_id: r.score for r in rank.court_boosted(scored, cases.select("doc_id", "court"), courts).collect()}
    assert got == {1: pytest.approx(2.8), 2: 2.0}
    f = {r.doc_id: r.f for r in z.where("term = 'apple'").select("doc_id", rank.title_factor().alias("f")).collect()}
    assert f == {1: 1.4, 2: 1.0}


def test_rocchio(spark, corpus):
    postings = corpus[0]
    w = weights(spark, corpus, "apple cherry", "t")
    scored = rank.scores(w, postings, rank.log_tf())
    sets = feedback.feedback_sets(scored, 1)
    got = {(r.doc_id, r.top, r.low) for r in sets.collect()}
    assert got == {(3, 1, 0), (2, 0, 1)}
    moved = {r.term: r.wq for r in feedback.rocchio_weights(w, postings, sets).collect()}
    base = {r.term: r.wq for r in w.collect()}
    assert moved["apple"] == pytest.approx(base["apple"] + 0.75 * 1 / 10)
    assert moved["cherry"] == pytest.approx(base["cherry"] + 0.75 * (1 + math.log10(3)) / 10 - 0.15 / 10)
    last = feedback.rerank_last_term(scored, w, postings)
    got = {r.doc_id: r.score for r in last.collect()}
    assert got[1] == pytest.approx(base["cherry"]) and got[3] == pytest.approx(base["cherry"] * (1 + math.log10(3)))


def test_expansion(spark):
    q = spark.createDataFrame([(1, "The Running dogs AND 42"), (2, None)], "query_id long, query string")
    d = spark.createDataFrame([("dogs", "canine"), ("dogs", "doggy")], "term string, derived string")
    plain = {r.term for r in expand.expand(q, d, ["the"], stem=False).collect()}
    assert plain == {"running", "dogs", "canine", "doggy"}
    stemmed = {r.term for r in expand.expand(q, d, ["the"]).collect()}
    assert stemmed == {"run", "dog", "canin", "doggi"}


def test_order_free_sum(spark):
    from termforge.functions.smart import exact_sum

    rows = spark.createDataFrame([(0.1,), (0.2,), (0.3,)], "x double")
    assert rows.agg(exact_sum(F.col("x")).alias("s")).first().s == pytest.approx(0.6)


@pytest.mark.parametrize("coalesce", ["false", "true"])
def test_whole_ranking_in_parts(spark, coalesce):
    """A query's results, and those of one score, are cut into several files; ranks are those of one sort."""
    rows = [(q, i, float((i * 7919) % (3 if q == 1 else 50)), i % 2) for q in (1, 2) for i in range(300)] + [(3, -5, 1.5, 0)]
    scored = spark.createDataFrame(rows, "query_id long, doc_id long, score double, first_pos int")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", coalesce)
    try:
        ranked = rank.full_ranking(scored)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert coalesce == "true" or len({f for f in ranked.inputFiles() if "ranked-" in f}) > 2
    assert rank.full_ranking(scored.limit(0)).collect() == []
    got = sorted((r.query_id, r.rank, r.doc_id, r.score) for r in ranked.collect())
    expected = []
    for q in (1, 2, 3):
        own = sorted((r for r in rows if r[0] == q), key=lambda r: (-r[2], r[3], -r[1]))
        expected += [(q, n, r[1], r[2]) for n, r in enumerate(own, 1)]
    assert got == expected


def test_a_word_of_many_occurrences(spark):
    postings = spark.createDataFrame([("w", 1, 20_000_000), ("x", 1, 1)], "term string, doc_id long, tf long")
    row = index.doc_stats(postings).collect()[0]
    assert row.len_n == pytest.approx(20_000_000) and row.max_tf == 20_000_000


def test_small_weights_are_broadcast(spark, corpus):
    w = weights(spark, corpus, "apple cherry", "t")
    plan = rank.scores(w, corpus[0], rank.log_tf())._jdf.queryExecution().optimizedPlan().toString()
    assert "strategy=broadcast" in plan


def test_lengths_by_method(spark, corpus):
    postings = corpus[0]
    stats = index.doc_stats(postings)
    w = weights(spark, corpus, "apple cherry cherry zzz", "t")
    plain = {r.doc_id: r.score for r in rank.smart_scores(w, postings, stats, "l").collect()}
    divided = {r.doc_id: r.score for r in rank.smart_scores(w, postings, stats, "l", normalised=True).collect()}
    lengths = {r.doc_id: r.len_l for r in stats.collect()}
    assert divided == {i: pytest.approx(s / lengths[i]) for i, s in plain.items()}
