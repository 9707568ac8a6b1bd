from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from termforge.functions import analysis, porter, sentences, treebank

FILLER = [(100 + i, f"Some plain words stand here at number{i}. The next ones left and follow them at once. Again it ends here, once left alone.") for i in range(60)]
DOCS = [
    *FILLER,
    *((i, f"We met Dr. Who at the house of Mr. Smith etc. and left. The end of it. Was it 3.5 p.m. yesterday?") for i in range(40)),
    (41, 'He said "stop." Then he met J. Smith. "Why?" she asked! ok'),
    (42, "It was late, etc. The end."),
    (43, None),
    (44, "  \n "),
]


@pytest.fixture(scope="module")
def learned(spark):
    docs = spark.createDataFrame(DOCS, "doc_id long, text string").cache()
    abbreviated = sentences.abbreviations(docs).cache()
    return docs, abbreviated, sentences.starters(docs, abbreviated).cache()


def test_abbreviations(learned):
    docs, abbreviated, _ = learned
    got = {r.word: r for r in abbreviated.collect()}
    assert {"dr", "mr", "etc", "p.m"} <= set(got) and not {"left", "here", "once", "it", "house", "3.5"} & set(got)
    chunks = [c for _, t in DOCS for c in (t or "").split()]
    strip = lambda c: c.lstrip("\"'(").rstrip("\"')")
    n, dots = len(chunks), sum(strip(c).endswith(".") for c in chunks)
    with_point = sum(strip(c).lower() == "p.m." for c in chunks)
    null, sure = with_point * math.log(dots / n), with_point * math.log(0.99)
    assert got["p.m"].with_point == with_point == 40 and got["p.m"].without == 0
    assert got["p.m"].score == pytest.approx(-2 * (null - sure) * math.exp(-2) * 2)


def test_starters_and_ends(learned):
    docs, abbreviated, starting = learned
    assert "the" in {r.word for r in starting.collect()}
    rows = sentences.ends(docs, abbreviated, starting).collect()
    said = {}
    for r in sorted(rows):
        text = said.setdefault(r.doc_id, [""])
        text[-1] += ("" if not text[-1] else " ") + r.chunk
        if r.ends:
            text.append("")
    assert said[1][:-1] == ["We met Dr. Who at the house of Mr. Smith etc. and left.", "The end of it.", "Was it 3.5 p.m. yesterday?"]
    assert said[41][:-1] == ['He said "stop."', "Then he met J. Smith.", '"Why?"', "she asked!", "ok"]
    assert said[42][:-1] == ["It was late, etc.", "The end."]
    assert 43 not in said and 44 not in said
    assert sentences.abbreviations(docs.limit(0)).collect() == []


@pytest.mark.parametrize(
    "chunk, ends, expected",
    [
        ("don't", False, ["do", "n't"]),
        ("Smith's", False, ["Smith", "'s"]),
        ("they'll", False, ["they", "'ll"]),
        ("cannot", False, ["can", "not"]),
        ("Gonna", False, ["Gon", "na"]),
        ("'twas", False, ["'t", "was"]),
        ("end.", True, ["end", "."]),
        ("end.", False, ["end."]),
        ('end."', True, ["end", ".", "''"]),
        ("U.S.", True, ["U.S", "."]),
        ("wait...", True, ["wait", "..."]),
        ('"quoted"', False, ["``", "quoted", "''"]),
        ('("a', False, ["(", "``", "a"]),
        ("1,000,", False, ["1,000", ","]),
        ("a,b", False, ["a", ",", "b"]),
        ("well-known", False, ["well-known"]),
        ("why?!", True, ["why", "?", "!"]),
        ("x--y", False, ["x", "--", "y"]),
        ("$5%", False, ["$", "5", "%"]),
        ("dogs'", False, ["dogs", "'"]),
        ("(see", False, ["(", "see"]),
        ("shouldn't've", False, ["shouldn't", "'ve"]),
    ],
)
def test_words(spark, chunk, ends, expected):
    df = spark.createDataFrame([(chunk, ends)], "chunk string, ends boolean")
    assert df.select(treebank.words(F.col("chunk"), F.col("ends")).alias("w")).first().w == expected


def test_words_of_documents(learned):
    docs, abbreviated, starting = learned
    rows = treebank.exploded(docs.where("doc_id in (41, 42)"), abbreviated, starting, keep=analysis.ALNUM)
    got = {i: [r.term for r in sorted(rows.collect()) if r.doc_id == i] for i in (41, 42)}
    assert got == {41: ["he", "said", "stop", "then", "he", "met", "smith", "why", "she", "asked", "ok"], 42: ["it", "was", "late", "etc", "the", "end"]}
    assert {r.term for r in porter.stemmed(rows).collect()} >= {"ask", "end"}


def test_learning_counts_chunks_once(spark):
    """Learning reads counts of equal chunks, from which texts can be left out; rows of texts are not needed again."""
    docs = spark.createDataFrame([(i, "Mr. Smith went. The end. The dog, cf. Smith. The cat ran. It sat. The") for i in range(20)], "doc_id long, text string")
    counts = sentences.counted(docs)
    assert {r.chunk: r.n for r in counts[0].collect()}["The"] == 80
    assert {(r.chunk, r.next): r.n for r in counts[1].collect()}["Mr.", "Smith"] == 20
    short = sentences.abbreviations(docs)
    none = docs.limit(0)
    assert sorted(map(tuple, sentences.abbreviations(none, counts).collect())) == sorted(map(tuple, short.collect()))
    found = sorted(map(tuple, sentences.starters(docs, short).collect()))
    assert found == sorted(map(tuple, sentences.starters(none, short, counts).collect())) and found
