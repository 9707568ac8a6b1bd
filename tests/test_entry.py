"""The driver's contract: names, and SQL counterparts on the smallest tables."""

from __future__ import annotations

import os

import duckdb
import pytest

import __spark_entry__ as entry
from termforge.plans import catalogue

SF = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def test_names():
    assert set(catalogue.QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())


@needs_data
def test_flagship(spark):
    assert entry.entry(spark).columns == ["query_id", "rank", "doc_id", "score"]


@needs_data
@pytest.mark.parametrize("name", ["tokens_stemmed", "bool_batch", "cosine_lnc_ltc_top10", "rocchio_rerank", "lm_predict_other", "index_zoned_stemmed", "bool_stemmed", "cosine_stemmed_top10", "smart_normalised", "source_lines", "source_zoned_csv", "source_queries", "index_saved", "expand_lexical", "bool_relation", "lines_boolean", "lines_ranked", "cosine_treebank_top10", "abbreviations", "grid_report", "lm_predict_large", "postings_joined", "source_directory", "query_tf", "expand_derivations"])
def test_against_sql(spark, name):
    c = duckdb.connect()
    for table in ("documents", "benchmark"):
        c.sql(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    got = catalogue.QUERIES[name](spark, SF)
    expected = c.sql(catalogue.ORACLES[name])
    names = list(got.columns)
    order = [list(expected.columns).index(n) for n in names]
    assert sorted(map(tuple, got.collect())) == sorted(tuple(r[i] for i in order) for r in expected.fetchall())


def documents(folder, rows):
    """A documents table of (doc_id, text, lang); the folder's path."""
    c = duckdb.connect()
    c.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, lang VARCHAR, source VARCHAR)")
    c.executemany("INSERT INTO documents VALUES (?, ?, ?, 'src0')", rows)
    c.execute(f"COPY documents TO '{folder}/documents.parquet' (FORMAT parquet)")
    return str(folder)


def both(spark, folder, name):
    """(rows of the plan, rows of its SQL), sorted."""
    c = duckdb.connect()
    c.sql(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet'")
    got, expected = entry.queries()[name](spark, folder), c.sql(entry.oracle_sql()[name])
    assert list(got.columns) == list(expected.columns)
    return sorted(map(tuple, got.collect()), key=repr), sorted(expected.fetchall(), key=repr)


#: No document of the held-out fold alone, a short text, and languages of every fold.
LM_ROWS = [(1, "abcdabcd", "x"), (2, "bcdefbcdef", "y"), (3, "abcde", "x"), (5, "bcdefg", "y"), (6, "abc", "x"), (10, "", "y"), (11, "qrstu", None)]


def test_other_is_predicted_on_whole_texts(spark, tmp_path):
    got, expected = both(spark, documents(tmp_path, LM_ROWS), "lm_predict_other")
    assert got == expected
    assert sorted(got) == [(1, "x"), (2, "y"), (3, "x"), (5, "y"), (6, "other"), (10, "other"), (11, "other")]


@pytest.mark.parametrize("name, size", [("lm_counts", 11), ("lm_totals", 2), ("lm_probs", 20), ("lm_scores", 8), ("lm_predict", 7), ("lm_accuracy", 6)])
def test_language_model_of_all_documents(spark, tmp_path, name, size):
    folder = documents(tmp_path, LM_ROWS)
    got, expected = both(spark, folder, name)
    assert got == expected and len(got) == size


@pytest.mark.parametrize("name", ["title_boost", "rocchio_rerank", "rocchio_last_term"])
def test_rankings_hold_every_match(spark, tmp_path, name):
    rows = [(i, "the thing\n" * (1 + i % 4) + "of " * (i % 5) + ("zzz " * i), "x") for i in range(1, 31)]
    folder = documents(tmp_path, [*rows, (31, "que la", "y"), (32, "nothing here", "x")])
    got, expected = both(spark, folder, name)
    assert got == expected
    assert {r[2] for r in got if r[0] == 1} == set(range(1, 31))
