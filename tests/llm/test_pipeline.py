from __future__ import annotations

import os

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")
SF = "/root/testdata/sf0.001"


def check_odd_rows(spark):
    """Null ids, null texts, repeated rows and columns named like the operators' own."""
    long = "the thing is in the house of that and with this for more words here " * 4
    rows = [(1, long, "en", "s", 9, 0.5, "x"), (1, long, "en", "s", 9, 0.5, "x"), (None, long, "en", "s", None, 0.5, None), (3, None, None, None, None, None, None), (4, long, "en", None, 9, 0.5, "x"), (5, "other text entirely here now", "en", "s", 1, 0.1, "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score double, passages string")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, docs, SF)
        assert kept.columns == docs.columns
        ids = sorted((r.doc_id or 0) for r in kept.collect())
        expected = {"toxicity": [0, 1, 1, 3, 4, 5], "language_id": [0, 1, 1, 4, 5], "jaccard_join": [0, 1, 3, 5], "decontamination": [0, 1, 1, 3, 4, 5]}
        assert ids == expected[name], name
        assert stage(spark, docs.limit(0), SF).collect() == []


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_stages_take_effect(spark):
    """Every stage against the operators' own brute-force versions on the rows that it receives."""
    import math

    from termforge.llm import langid, packing, toxicity
    from tests.llm.test_classifiers import brute_segments
    from tests.llm.test_decontam import brute as contaminated
    from tests.llm.test_jaccard import brute as groups

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = sorted(docs.columns)
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        model = toxicity.fit(docs, labels) if name == "toxicity" else langid.fit(docs) if name == "language_id" else None
        before = {r.doc_id: r.text for r in docs.collect()}
        docs = corpus_pipeline.written(stage(spark, docs, SF), name)
        after = {r.doc_id: r.text for r in docs.collect()}
        assert sorted(docs.columns) == columns
        assert all(before[i] == t for i, t in after.items())
        if name == "toxicity":
            for i, t in list(before.items())[:60]:  # short ones: the definition of segments takes cubic time
                scores = [model.score(w) for w in toxicity.words_of(t)][:]
                if len(scores) > 80:
                    continue
                strength = [sum(scores[a:b]) for a, b in brute_segments(scores)]
                law = lambda s: len(scores) * model.tail_k * math.exp(-model.tail_lambda * s)  # noqa: B023, E731
                held = [s for s in strength if law(s) <= toxicity.MAX_E_VALUE]
                chance = 1 - math.exp(-law(sum(held)))
                score = model.share / (model.share + (1 - model.share) * chance) if held else 0.0
                assert (i in after) == (score < corpus_pipeline.TOXIC_FROM), i
        if name == "language_id":
            for i, t in before.items():
                rows = [v for w in langid.words_of(t) if (v := model.word(w)) is not None]
                total = sum(rows) if rows else None
                sure = total is not None and 1 / sum(math.exp(x - max(total)) for x in total) >= corpus_pipeline.LANGUAGE_FROM
                assert (i in after) == bool(sure), i
        if name == "jaccard_join":
            assert set(after) == {i for i, (_, c) in groups(list(before.items())).items() if i == c}
        if name == "decontamination":
            assert set(after) == {r[0] for r in contaminated(list(before.items()), items) if not r[5]}
        assert len(after) > 0.3 * len(before)
    check_odd_rows(spark)
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
    assert {r.doc_id for r in packed} == set(after)
    enc = packing.encoder(packing.default_ranks_path())
    assert sum(r.length for r in packed) == sum(len(packing.encode(enc, t)) for t in after.values())
