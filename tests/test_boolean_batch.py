from __future__ import annotations

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from termforge.operators import boolean_batch, index
from termforge.plans.boolean_parser import And, Not, Or, Term, parse

VOCABULARY = ["apple", "banana", "cherry", "durian", "elder", "zzz"]
DOCS = [(i, " ".join(w for j, w in enumerate(VOCABULARY[:5]) if (i * 2654435761 >> j) & 1)) for i in range(1, 41)]


def holds(node, words):
    if isinstance(node, Term):
        return node.text in words
    if isinstance(node, Not):
        return not holds(node.operand, words)
    return (all if isinstance(node, And) else any)(holds(x, words) for x in node.operands)


def counted(rows, words):
    """The nodes' rows for one document, by the counting rule; whether it answers."""
    inside = {}
    for node, parent, level, must, need, term, complement in sorted(rows, key=lambda r: -r[2]):
        if term is not None:
            inside[node] = term in words
        else:
            children = [(inside[r[0]], r[3]) for r in rows if r[1] == node]
            if need == 0:
                inside[node] = any(h for h, _ in children)
            else:
                inside[node] = sum(h for h, m in children if m) == need and not any(h for h, m in children if not m)
    return inside[0] != rows[0][6]


trees = st.recursive(
    st.sampled_from(VOCABULARY).map(Term),
    lambda s: st.one_of(s.map(Not), st.lists(s, min_size=2, max_size=4).map(lambda x: And(tuple(x))), st.lists(s, min_size=2, max_size=4).map(lambda x: Or(tuple(x)))),
    max_leaves=12,
)


@given(trees, st.sets(st.sampled_from(VOCABULARY)))
@settings(max_examples=400, deadline=None)
def test_counting_children_is_evaluation(tree, words):
    assert counted(boolean_batch.nodes_of(tree), words) == holds(tree, words)


def random_query(rng, depth=3):
    if depth == 0 or rng.random() < 0.3:
        return rng.choice(["", "", "NOT "]) + rng.choice(VOCABULARY)
    parts = f" {rng.choice(['AND', 'OR'])} ".join(random_query(rng, depth - 1) for _ in range(rng.randint(2, 3)))
    return rng.choice(["", "", "NOT "]) + f"({parts})"


@pytest.fixture(scope="module")
def corpus(spark):
    docs = spark.createDataFrame([*DOCS, (99, "")], "doc_id long, text string").cache()
    return docs, index.boolean_index(docs).cache()


def test_ten_thousand_queries_in_one_plan(spark, corpus):
    rng = random.Random(3)
    queries = [(i, random_query(rng)) for i in range(10_000)]
    df = spark.createDataFrame(queries, "query_id long, query string").repartition(8)
    out = boolean_batch.search(*corpus, df)
    plan = out._jdf.queryExecution().analyzed().toString()
    few = boolean_batch.search(*corpus, spark.createDataFrame(queries[:200], "query_id long, query string"))
    assert plan.count("\n") == few._jdf.queryExecution().analyzed().toString().count("\n")
    got = {}
    for r in out.groupBy("query_id").agg({"doc_id": "collect_list"}).toLocalIterator():
        got[r[0]] = sorted(r[1])
    words = {i: set(t.split()) for i, t in [*DOCS, (99, "")]}
    for i, q in queries:
        assert got.get(i, []) == [d for d in sorted(words) if holds(parse(q), words[d])], q


def test_blank_wrong_and_unknown(spark, corpus):
    rows = [(1, ""), (2, None), (3, "apple banana"), (4, "(apple"), (5, "zzz"), (6, "NOT zzz"), (7, "APPLE"), (8, "NOT NOT apple"), (9, "apple AND NOT apple"), (10, "apple OR NOT apple")]
    df = spark.createDataFrame(rows, "query_id long, query string")
    got = {}
    for r in boolean_batch.search(*corpus, df).collect():
        got.setdefault(r.query_id, set()).add(r.doc_id)
    every = {i for i, _ in DOCS} | {99}
    apples = {i for i, t in DOCS if "apple" in t}
    assert got == {6: every, 7: apples, 8: apples, 10: every}
    assert {r.query_id for r in boolean_batch.errors(boolean_batch.trees(df)).collect()} == {3, 4}
    assert boolean_batch.search(*corpus, df.limit(0)).collect() == []
    assert boolean_batch.search(*corpus, df.where("query_id < 3")).collect() == []


def test_stems(spark):
    docs = spark.createDataFrame([(1, "licenses thing"), (2, "licensing"), (3, "things")], "doc_id long, text string")
    queries = spark.createDataFrame([(1, "license AND NOT things"), (2, "NOT licensed")], "query_id long, query string")
    rows = boolean_batch.search(docs, index.boolean_index(docs, stem=True), queries, stem=True).collect()
    assert sorted(map(tuple, rows)) == [(1, 2), (2, 3)]


def test_sums_of_answers_without_rows_of_answers(spark, monkeypatch):
    rng = random.Random(5)
    rows = [*DOCS, (99, ""), (99, ""), (-7, "apple"), (None, "apple")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    queries = [(i, random_query(rng)) for i in range(300)] + [(300, ""), (301, None), (302, "(apple"), (303, "zzz"), (303, "NOT zzz"), (304, "NOT apple AND NOT durian")]
    monkeypatch.setattr(boolean_batch, "QUERY_CHUNK", 100)
    monkeypatch.setattr(boolean_batch, "DOC_BLOCK", 4)
    monkeypatch.setattr(boolean_batch, "search", None)
    df = spark.createDataFrame(queries, "query_id long, query string")
    got = {r[0]: tuple(r)[1:] for r in boolean_batch.answer_sums(docs, index.boolean_index(docs), df).collect()}
    expected = {}
    for i, q in queries:
        if q and q != "(apple":
            expected.setdefault(i, []).extend(d for d, t in rows if holds(parse(q), set(t.split()) if d is not None else set()))
    sums = lambda x: (len(x), sum(n), min(n), max(n)) if (n := [d for d in x if d is not None]) else (len(x), None, None, None)
    assert got == {i: sums(x) for i, x in expected.items() if x}
