from __future__ import annotations

import re
from collections import Counter

import duckdb
import numpy as np
import pytest

from termforge.llm import collocations, queries


def brute(rows, least=10, longest=3, top=2000, inside=50):
    out = []
    by = {}
    for text, lang in rows:
        text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0a-\x0d]", text):
            by.setdefault(lang or "und", []).append(re.findall(r"[^ \t]+", piece))
    for lang, pieces in by.items():
        f = Counter(tuple(p[i : i + k]) for p in pieces for k in range(1, longest + 1) for i in range(len(p) - k + 1))
        n = sum(map(len, pieces))
        cands = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        kept = []
        for p, a in cands.items():
            if any(len(q) > len(p) and 100 * b >= inside * a and any(q[i : i + len(p)] == p for i in range(len(q))) for q, b in cands.items()):
                continue
            score, k = min((1000000 * a * a // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
            kept.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        for i, (score, a, phrase, l, r) in enumerate(sorted(kept)[:top], 1):
            out.append((lang, i, phrase.decode(), -a, l, r, n, -score))
    return sorted(out)


def corpus():
    rng = np.random.default_rng(4)
    words = ["New", "york", "city", "of", "the", "Ä", "ß x", "🙂", "a\x00b", "la", "x" * 40]
    rows = []
    for i in range(300):
        picked = rng.choice(words, int(rng.integers(0, 30)), p=[0.2, 0.2, 0.1, 0.1, 0.15, 0.05, 0.05, 0.05, 0.02, 0.06, 0.02])
        marks = rng.choice([" ", "  ", "\t ", ", ", ". ", "\n", "\r\n", " ; "], len(picked), p=[0.6, 0.1, 0.05, 0.05, 0.05, 0.05, 0.05, 0.05])
        rows.append(("".join(w + m for w, m in zip(picked, marks)), ["en", "de", None][i % 3]))
    rows += [(None, "en"), ("", "en"), (" \t\n.;", "fr"), ("single", "es")] + [("hot line of words", "en")] * 400
    return rows + [("deep learning " * 20_000, "de")]


@pytest.mark.parametrize("longest, least", [(3, 10), (4, 3), (2, 10)])
def test_against_brute_force(spark, longest, least):
    rows = corpus()
    df = spark.createDataFrame([(t, g, "k", 1) for t, g in rows], "text string, lang string, phrase string, a int").repartition(6)
    got = sorted(tuple(r) for r in collocations.mine(df, least=least, longest=longest).collect())
    assert got == brute(rows, least, longest)
    assert got


def test_pieces_may_be_passed_on_early(spark, monkeypatch):
    rows = [(f"w{i % 7} w{i % 5} w{i % 3}. z", "en") for i in range(2000)]
    monkeypatch.setattr(collocations, "BATCH", 7)
    monkeypatch.setattr(collocations, "HELD_PIECES", 11)
    df = spark.createDataFrame(rows, "text string, lang string")
    assert sorted(tuple(r) for r in collocations.mine(df).collect()) == brute(rows)


def test_without_languages_top_and_empty(spark):
    df = spark.createDataFrame(corpus(), "text string, tag string")
    one = collocations.mine(df, lang=None, top=3).collect()
    assert [r["rank"] for r in sorted(one)] == [1, 2, 3] and {r.lang for r in one} == {"und"}
    assert sorted(map(tuple, collocations.mine(df, "tag", top=None).collect())) == brute(corpus(), top=None)
    assert collocations.mine(df.limit(0), "tag").collect() == []


def test_products_beyond_64_bits(spark):
    big = 3 * 10**11
    rows = [("en", 1, "a", big), ("en", 1, "b", 2 * big + 1), ("en", 2, "a b", big - 7), ("en", 0, "", 9 * big)]
    (r,) = collocations.scored(spark.createDataFrame(rows, "lang string, words int, phrase string, f long")).collect()
    assert r.score == 1000000 * (big - 7) ** 2 // (big * (2 * big + 1))


def test_query_against_sql(spark, tmp_path):
    rows = [(t, g) for t, g in corpus() if not t or "\x00" not in t]
    spark.createDataFrame([(i, t, g) for i, (t, g) in enumerate(rows)], "doc_id long, text string, lang string").write.parquet(str(tmp_path / "documents.parquet"))
    c = duckdb.connect(config={"temp_directory": str(tmp_path / "spill")})
    c.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    got = queries.op11_collocations(spark, str(tmp_path))
    assert got.dtypes == [("lang", "string"), ("rank", "bigint"), ("phrase", "string"), *((x, "bigint") for x in ("a", "l", "r", "n", "score"))]
    assert sorted(map(tuple, got.collect())) == sorted(c.execute(queries.OP11_SQL).fetchall())
