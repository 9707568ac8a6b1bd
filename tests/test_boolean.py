from __future__ import annotations

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from termforge.operators import boolean, index
from termforge.plans.boolean_parser import And, Not, Or, QuerySyntaxError, Term, parse, terms

DOCS = [
    (1, "apple banana banana"),
    (2, "banana cherry"),
    (3, "apple cherry cherry cherry"),
    (4, "durian"),
    (5, "banana cherry"),
]
EXPECTED = {
    "apple AND cherry": [3],
    "banana OR durian": [1, 2, 4, 5],
    "NOT cherry": [1, 4],
    "banana AND NOT apple": [2, 5],
    "NOT apple AND NOT banana": [4],
    "apple OR banana AND cherry": [1, 2, 3, 5],
    "(apple OR banana) AND cherry": [2, 3, 5],
    "zzz AND apple": [],
    "zzz OR apple": [1, 3],
    "NOT zzz": [1, 2, 3, 4, 5],
    "(durian AND apple) OR cherry": [2, 3, 5],
    "NOT (NOT apple)": [1, 3],
    "NOT NOT apple": [1, 3],
    "": [],
    "   ": [],
    "APPLE": [1, 3],
}


@pytest.fixture(scope="module")
def corpus(spark):
    docs = spark.createDataFrame(DOCS, "doc_id long, text string").cache()
    return docs, index.boolean_index(docs).cache()


def test_batch(corpus, spark):
    docs, postings = corpus
    batch = list(enumerate(EXPECTED))
    rows = boolean.search(docs, postings, batch).collect()
    got = {q: sorted(r.doc_id for r in rows if r.query_id == i) for i, q in batch}
    assert got == EXPECTED
    lines = boolean.result_lines(spark.createDataFrame(batch, "query_id long, query string"), boolean.search(docs, postings, batch))
    assert {r.query_id: r.result for r in lines.collect()} == {i: " ".join(map(str, EXPECTED[q])) for i, q in batch}


@pytest.mark.parametrize("query", ["banana AND NOT apple", "NOT apple AND NOT banana", "(durian AND apple) OR cherry", "NOT zzz", ""])
def test_set_operations(corpus, query):
    docs, postings = corpus
    assert sorted(r.doc_id for r in boolean.search_sets(docs, postings, query).collect()) == EXPECTED[query]


@pytest.mark.parametrize("query", ["apple banana", "(apple AND banana", "apple)", "AND", "apple AND", "NOT", "()"])
def test_syntax_errors(query):
    with pytest.raises(QuerySyntaxError):
        parse(query)


def test_no_queries(corpus):
    docs, postings = corpus
    assert boolean.search(docs, postings, []).collect() == []


nodes = st.recursive(
    st.sampled_from(["apple", "banana", "cherry", "durian", "zzz"]).map(Term),
    lambda inner: inner.map(Not) | st.lists(inner, min_size=2, max_size=3).map(lambda x: And(tuple(x))) | st.lists(inner, min_size=2, max_size=3).map(lambda x: Or(tuple(x))),
    max_leaves=6,
)


def text_of(node) -> str:
    if isinstance(node, Term):
        return node.text
    if isinstance(node, Not):
        return f"NOT ({text_of(node.operand)})"
    return (" AND " if isinstance(node, And) else " OR ").join(f"({text_of(x)})" for x in node.operands)


def answers(node) -> set[int]:
    if isinstance(node, Term):
        return {i for i, t in DOCS if node.text in t.split()}
    if isinstance(node, Not):
        return {i for i, _ in DOCS} - answers(node.operand)
    parts = [answers(x) for x in node.operands]
    return set.intersection(*parts) if isinstance(node, And) else set.union(*parts)


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(nodes, min_size=4, max_size=6))
def test_random_trees(corpus, trees):
    docs, postings = corpus
    rows = boolean.search(docs, postings, [(i, text_of(t)) for i, t in enumerate(trees)]).collect()
    for i, t in enumerate(trees):
        assert {r.doc_id for r in rows if r.query_id == i} == answers(t)
        assert terms(parse(text_of(t))) == terms(t)


def test_operands_by_size_and_stems(spark):
    docs = spark.createDataFrame(DOCS, "doc_id long, text string")
    postings = index.boolean_index(docs)
    for q, expected in EXPECTED.items():
        got = boolean.search_sets(docs, postings, q, index.dictionary(postings))
        assert sorted(r.doc_id for r in got.collect()) == expected, q
    sizes = {"apple": 2, "banana": 3}
    assert boolean.estimate(parse("apple AND banana"), sizes, 9) == 2 and boolean.estimate(parse("apple OR NOT x"), sizes, 9) == 9
    stemmed = index.boolean_index(docs, stem=True)
    got = boolean.search(docs, stemmed, [(1, "cherries AND apples"), (2, "NOT bananas")], stem=True)
    assert sorted(map(tuple, got.collect())) == [(1, 3), (2, 3), (2, 4)]
