from __future__ import annotations

from termforge.operators import lexicon

SENSES = [("law", "law.1"), ("law", "law.2"), ("lawyer", "lawyer.1"), ("decide", "decide.1"), ("lost", "nowhere"), ("law", "law.1")]
LEMMAS = [("law.1", "law"), ("law.1", "jurisprudence"), ("law.2", "police"), ("lawyer.1", "attorney"), ("decide.1", "decide"), ("decide.1", "determine")]
RELATED = [
    ("law.1", "law", "Lawful", 2),
    ("law.1", "law", "legalistic", 1),
    ("law.1", "jurisprudence", "jurisprudential", 1),
    ("law.2", "law", "wrong_sense", 0),
    ("law.2", "police", "policing", 1),
    ("law.2", "police", "policeman", 1),
    ("decide.1", "decide", "decisions", 3),
    ("decide.1", "determine", None, 1),
]


def tables(spark):
    return (
        spark.createDataFrame(SENSES, "word string, synset string"),
        spark.createDataFrame(LEMMAS, "synset string, lemma string"),
        spark.createDataFrame(RELATED, "synset string, lemma string, form string, position int"),
    )


def terms(df):
    out = {}
    for r in df.collect():
        out.setdefault(r.query_id, {})[r.term] = r.derived
    return out


def test_first_form_of_every_lemma_of_every_sense(spark):
    queries = spark.createDataFrame([(1, "The LAW and law decides"), (2, "decide AND lawyer 3a lost"), (3, None), (4, "the")], "query_id long, query string")
    got = terms(lexicon.expand(queries, *tables(spark), ["the"], stem=False))
    assert got == {
        1: {"law": False, "decides": False, "legalistic": True, "jurisprudential": True, "policeman": True},
        2: {"decide": False, "lawyer": False, "lost": False, "decisions": True},
    }


def test_stems_and_dictionary(spark):
    queries = spark.createDataFrame([(1, "law decide"), (2, "decision decide")], "query_id long, query string")
    got = terms(lexicon.expand(queries, *tables(spark), []))
    assert got[1] == {"law": False, "decid": False, "legalist": True, "jurisprudenti": True, "policeman": True, "decis": True}
    assert got[2] == {"decis": False, "decid": False}
    index = spark.createDataFrame([("law", 3), ("decis", 1), ("decis", 1)], "term string, df int")
    assert terms(lexicon.expand(queries, *tables(spark), [], index)) == {1: {"law": False, "decis": True}, 2: {"decis": False}}


def test_graph_of_a_vocabulary(spark):
    rows = [("decide", 9), ("decides", 2), ("decidual", 5), ("decidophobia", 5), ("other", 50), ("otherwise", 1), ("dec1de2", 9), ("decid", 99)]
    senses, lemmas, related = lexicon.graph_of(spark.createDataFrame(rows, "term string, df long"))
    assert {tuple(r) for r in senses.collect()} == {("decide", "decid/decid"), ("decides", "decid/decid"), ("decidual", "decid/decidu"), ("decidophobia", "decid/decidophobia"), ("otherwise", "other/otherwis")}
    first = {(r.lemma, r.form) for r in lexicon.first_forms(related).collect()}
    assert first == {("decide", "decidophobia"), ("decides", "decidophobia"), ("decidual", "decide"), ("decidophobia", "decide")}
    assert lemmas.count() == 5


def test_empty_graph(spark):
    senses, lemmas, related = (t.limit(0) for t in tables(spark))
    queries = spark.createDataFrame([(1, "law")], "query_id long, query string")
    assert terms(lexicon.expand(queries, senses, lemmas, related, [])) == {1: {"law": False}}
    assert lexicon.expand(queries.limit(0), *tables(spark), []).collect() == []
