from __future__ import annotations

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from termforge.llm import common, langid, quality, textmodel, toxicity


def held_out(i, folds, rest):
    return zlib.crc32(str(i).encode()) % folds == rest


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(11)
    parts = {"en": ["th", "ing", "er", "on"], "de": ["sch", "ung", "keit", "ver"], "fr": ["eau", "oi", "ment", "é"]}
    docs, labels = [], []
    for i in range(600):
        lang = rng.choice(list(parts))
        w = ["".join(rng.choices(parts[lang], k=rng.randrange(1, 4))) for _ in range(rng.randrange(20, 120))]
        toxic, good = rng.random() < 0.25, rng.random() < 0.7
        if not good:
            w = [x + "###" for x in w] if rng.random() < 0.5 else [x for x in w[:6] for _ in range(15)]
        if toxic:
            for _ in range(3):
                w.insert(rng.randrange(len(w)), rng.choice(["vilebad", "vileugly", "nastyx"]))
        docs.append((i, " ".join(w), lang))
        labels.append((i, int(good), int(toxic)))
    return docs, labels


def frames(spark, corpus):
    docs, labels = corpus
    extra = [(9000, None, "en"), (9001, "", "en"), (9002, "12 34 !!", "de"), (None, "thing er", "en"), (9003, "schung keit " * 30000, None), docs[0]]
    d = spark.createDataFrame([(*r, 7, "s") for r in [*docs, *extra]], "doc_id long, text string, lang string, score int, word string")
    lab = spark.createDataFrame([*labels, labels[0], (None, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int")
    return d, lab


def test_toxicity(spark, corpus):
    d, lab = frames(spark, corpus)
    rows = toxicity.detect(d, toxicity.fit(d, lab)).collect()
    assert len(rows) == d.count()
    got = {r.doc_id: r for r in rows}
    wrong = [i for i, _, t in corpus[1] if (got[i].score >= 0.5) != bool(t)]
    assert not wrong
    assert got[9000].score == got[9001].score == 0 and got[9000].passages == []
    assert toxicity.detect(d.limit(0), toxicity.Model()).collect() == []
    assert all(r.score == 0 for r in toxicity.detect(d, toxicity.fit(d, lab.limit(0))).collect())


def brute_segments(scores):
    """Maximal scoring segments by their recursive definition."""
    best, span = 0.0, None
    for i in range(len(scores)):
        total = 0.0
        for j in range(i, len(scores)):
            total += scores[j]
            if total > best + 1e-12:
                best, span = total, (i, j + 1)
    if span is None:
        return []
    a, b = span
    left = brute_segments(scores[:a])
    right = [(x + b, y + b) for x, y in brute_segments(scores[b:])]
    return [*left, span, *right]


def test_segments():
    rng = np.random.default_rng(8)
    for _ in range(200):
        s = (rng.integers(-50, 50, int(rng.integers(0, 14))) + rng.random()).tolist()
        assert [(a, b) for a, b, _ in toxicity.segments(s)] == brute_segments(s)
        for a, b, x in toxicity.segments(s):
            assert x == pytest.approx(sum(s[a:b]))


def test_toxicity_scores_against_brute_force(spark, corpus):
    """Scores and passages from all segments by their definition, token scores and the law's constants."""
    d, lab = frames(spark, corpus)
    model = toxicity.fit(d, lab)
    assert min(model.tokens.values()) < 0 < max(model.tokens.values()) and 0 < model.tail_lambda <= 1
    small = d.where("doc_id < 25").dropDuplicates(["doc_id"])
    texts = {r.doc_id: r.text for r in small.collect()}
    for r in toxicity.detect(small, model).collect():
        words = re.findall(r"[^\W\d_]+", texts[r.doc_id].lower())
        scores = [model.tokens.get(w, model.background) for w in words]
        found = [(a, b, sum(scores[a:b])) for a, b in brute_segments(scores)]
        law = lambda s: len(words) * model.tail_k * math.exp(-model.tail_lambda * s)  # noqa: B023, E731
        kept = [x for x in found if law(x[2]) <= toxicity.MAX_E_VALUE]
        assert [(p.first_word, p.end_word) for p in r.passages] == [(a, b) for a, b, _ in kept]
        chance = 1 - math.exp(-law(sum(s for _, _, s in kept)))
        assert r.score == pytest.approx(model.share / (model.share + (1 - model.share) * chance) if kept else 0.0)


def test_token_scores_from_plain_counts(spark, corpus):
    """Log-odds under the prior, their margins and the choice of tokens, from distinct preceding words counted one by one."""
    d, lab = frames(spark, corpus)
    model = toxicity.fit(d, lab)
    label = {i: t for i, _, t in corpus[1] if not held_out(i, 5, 0)}
    contexts = {0: set(), 1: set()}
    for i, text, _ in corpus[0]:
        if i in label:
            words = re.findall(r"[^\W\d_]+", text.lower())
            contexts[label[i]].update(zip(["", *words], words))
    y = {k: Counter(w for _, w in v) for k, v in contexts.items()}
    n = {k: sum(c.values()) for k, c in y.items()}
    expected = {}
    for w in y[0].keys() | y[1].keys():
        prior = toxicity.PRIOR_BASE + toxicity.PRIOR_WEIGHT * (y[0][w] + y[1][w]) / (n[0] + n[1])
        p = {k: y[k][w] + prior for k in (0, 1)}
        odds = {k: math.log(p[k] / (n[k] + toxicity.PRIOR_WEIGHT - p[k])) for k in (0, 1)}
        delta, error = odds[1] - odds[0], math.sqrt(1 / p[0] + 1 / p[1])
        low, high = delta - toxicity.MARGIN * error, delta + toxicity.MARGIN * error
        if y[1][w] >= toxicity.MIN_CONTEXTS and low >= toxicity.MIN_SCORE and delta / error >= toxicity.MIN_Z:
            expected[w] = low
        elif high < toxicity.BACKGROUND:
            expected[w] = high
    assert {w for w, s in expected.items() if s > 0} and {w for w, s in expected.items() if s < 0}
    assert model.tokens == pytest.approx(expected)
    shown = [label[i] for i, *_ in corpus[0] if i in label]
    assert model.share == pytest.approx(min(0.5, max(0.01, (sum(shown) + label.get(corpus[0][0][0], 0)) / (len(shown) + (corpus[0][0][0] in label)))))


def test_tail_of_known_law(spark):
    """Lambda and K from texts whose segments are single words of drawn scores."""
    model = toxicity.Model({"a": 2.5, "b": 3.0, "c": 6.0})
    texts = [(" zz" * 200 + " ").join(["", "a", "b", ""]), "zz " * 600, (" zz" * 200 + " ").join(["", "c", ""])]
    k, decay = toxicity.tail(model, spark.createDataFrame([(t,) for t in texts], "text string"))
    n = sum(len(t.split()) for t in texts)
    assert decay == pytest.approx(4 / (0.5 + 1.0 + 4.0 + 1)) and k == pytest.approx(4 / n * math.exp(2 * decay))


def test_language_scores_against_brute_force(spark, corpus):
    """Predictions from counts of the training texts, written out plainly."""
    d, _ = frames(spark, corpus)
    model = langid.fit(d)
    train = [(t, x) for i, t, x in [*corpus[0], corpus[0][0]] if not held_out(i, 3, 1)]  # the repeated row is two rows
    langs = sorted({x for _, x in train})
    counts = {x: Counter() for x in langs}
    for t, x in train:
        counts[x].update(re.findall(r"[^\W\d_]+", t.lower()))
    seen = Counter()
    for c in counts.values():
        seen.update(c)
    known = {w for w, n in seen.items() if n > 1}
    size = {x: sum(n for w, n in c.items() if w in known) + langid.ADD * (len(known) + 1) for x, c in counts.items()}
    rows = [(7001, "thing er on schung"), (7002, "ververung ment eau oi"), (7003, "thth")]
    got = {r.doc_id: r for r in langid.identify(spark.createDataFrame(rows, "doc_id long, text string"), model).collect()}
    for i, text in rows:
        words = [w for w in text.split() if w in known]
        if len(words) < len(text.split()):
            continue  # unseen words: their back-off is tested by itself
        logs = [sum(math.log((counts[x][w] + langid.ADD) / size[x]) for w in words) for x in langs]
        best = max(range(len(langs)), key=lambda k: logs[k])  # noqa: B023
        assert got[i].lang_pred == langs[best]
        assert got[i].score == pytest.approx(1 / sum(math.exp(v - logs[best]) for v in logs))


def test_back_off_scores_against_brute_force(spark, corpus):
    """Unseen words score by their longest n-grams that any word of the training texts has, counted word by word."""
    d, _ = frames(spark, corpus)
    model = langid.fit(d)
    train = [(t, x) for i, t, x in [*corpus[0], corpus[0][0]] if not held_out(i, 3, 1)]
    langs = sorted({x for _, x in train})
    words = {x: Counter() for x in langs}
    for t, x in train:
        words[x].update(re.findall(r"[^\W\d_]+", t.lower()))
    grams = {n: {x: Counter(f"<{w}>"[k : k + n] for w in words[x] for k in range(len(w) + 3 - n)) for x in langs} for n in range(1, 6)}

    def expected(w):
        for n in range(5, 0, -1):
            text = f"<{w}>" if n > 1 else w
            keys = set().union(*grams[n].values())
            known = [text[k : k + n] for k in range(len(text) - n + 1) if text[k : k + n] in keys]
            if known:
                size = {x: sum(grams[n][x].values()) + langid.ADD * (len(keys) + 1) for x in langs}
                return [sum(math.log((grams[n][x][g] + langid.ADD) / size[x]) for g in known) / len(known) for x in langs]
        return [0.0] * len(langs)

    seen = {w for c in words.values() for w, n in c.items() if n > 1}
    unseen = ["schungthq", "ververungoi", "qqthqq", "zzéz", "qeauq", "jjj", "v", "onx"]
    assert not seen & set(unseen)
    got = {r.doc_id: r for r in langid.identify(spark.createDataFrame(list(enumerate(unseen)), "doc_id long, text string"), model).collect()}
    lengths = set()
    for i, w in enumerate(unseen):
        logs = expected(w)
        best = max(range(len(langs)), key=lambda k: logs[k])  # noqa: B023
        assert got[i].lang_pred == langs[best], w
        assert got[i].score == pytest.approx(1 / sum(math.exp(v - logs[best]) for v in logs)), w
        lengths.add(next((n for n in range(5, 0, -1) if any((f"<{w}>" if n > 1 else w)[k : k + n] in grams[n][x] for x in langs for k in range(len(w) + 3))), 0))
    assert len(lengths) >= 4  # several lengths of back-off are met


def test_many_languages_keep_all_keys(spark):
    """With very many languages the model grows with what was seen, and nothing is left out."""
    rows = [(3 * i, f"common word{chr(97 + i % 26)}{chr(97 + i // 26)} common", f"l{i:03}") for i in range(400)]
    rows = [(i, t, x) for i, t, x in rows if not held_out(i, 3, 1)]
    model = langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert len(model.langs) == len(rows) and model.rows_of(0, ["common"])[0] >= 0
    assert len(model.more) < 60 * len(rows)
    (r,) = model.rows_of(0, ["common"])
    assert model.ends[r + 1] - model.ends[r] == len(rows)


def test_letters():
    latin = "".join(map(chr, range(256)))
    for text in (latin, latin.replace("²", "a"), "abc d1e_f", "ÀÉ×÷ß²x"):
        assert textmodel.words_of(text) == textmodel.WORDS.findall(text.lower())
    assert textmodel.words_of("½ ② ² 12 _ -") == [] and textmodel.words_of("हिन्दी Ab1c naïve e\u0301t") == ["हिन्दी", "ab", "c", "naïve", "e\u0301t"]


def test_language_id(spark, corpus):
    d, _ = frames(spark, corpus)
    model = langid.fit(d)
    got = {r.doc_id: r for r in langid.identify(d, model).collect()}
    for i, _, lang in corpus[0]:
        assert got[i].lang_pred == lang and 0 <= got[i].score <= 1
    assert {got[i].lang_pred for i in (9000, 9001, 9002)} == {"und"}
    assert got[9003].lang_pred == "de"
    assert model.word("schungkeitver") is not None and model.word("\u4f60") is None
    assert {r.lang_pred for r in langid.identify(d, langid.fit(d.limit(0))).collect()} == {"und"}


def test_held_out_texts_do_not_teach(spark):
    ids = [i for i in range(200) if held_out(i, 3, 1)][:5]
    d = spark.createDataFrame([(i, "only held out words", "xx") for i in ids], "doc_id long, text string, lang string")
    assert langid.fit(d).langs == []


def test_quality_scores_over_all_pairs(spark, corpus):
    """Returned scores from every pair of a text's inputs, one by one, instead of sums of squares."""
    d, lab = frames(spark, corpus)
    machine = quality.fit(d, lab)
    rows = [(1, corpus[0][0][1]), (2, "Some Words, some 12 words | here\nsome"), (3, ""), (4, None), (5, "x " * 400 + "Y")]
    got = {r.doc_id: r.score for r in quality.rate(spark.createDataFrame(rows, "doc_id long, text string"), machine).collect()}
    for i, text in rows:
        words = (text or "").split()
        buckets = sorted({zlib.crc32(w.lower().encode()) % quality.BUCKETS for w in words})
        stats = np.array(quality.structure(text or "", words, Counter(words)))
        x = {b: quality.WORD_WEIGHT / math.sqrt(max(1, len(buckets))) for b in buckets}
        x |= {quality.BUCKETS + k: v for k, v in enumerate(np.clip((stats - machine.mean) / machine.scale, -8, 8))}
        inputs = list(x)
        raw = sum(machine.linear[a] * x[a] for a in inputs)
        raw += sum(float(machine.factors[a] @ machine.factors[b]) * x[a] * x[b] for k, a in enumerate(inputs) for b in inputs[k + 1 :])
        assert got[i] == pytest.approx(1 / (1 + math.exp(-max(-30.0, min(30.0, float(raw))))), rel=1e-6)


def test_quality(spark, corpus):
    d, lab = frames(spark, corpus)
    machine = quality.fit(d, lab)
    got = {r.doc_id: r.score for r in quality.rate(d, machine).collect()}
    held = [(i, g) for i, g, _ in corpus[1] if held_out(i, 5, 0)]
    right = sum((got[i] >= 0.3) == bool(g) for i, g in held)
    assert right >= 0.95 * len(held)
    assert all(0 <= got[i] <= 1 for i in (9000, 9001, 9002))
    assert quality.fit(d, lab.limit(0)) is None
    assert {r.score for r in quality.rate(d, None).collect()} == {0.5}
    assert quality.rate(d.limit(0), machine).collect() == []


def test_sum_of_squares_identity():
    rng = np.random.default_rng(3)
    k = quality.BUCKETS + len(quality.STATS)
    m = quality.Machine(np.zeros(len(quality.STATS)), np.ones(len(quality.STATS)), rng.normal(size=k), rng.normal(size=(k, quality.RANK)))
    buckets, stats = np.array([3, 17, 99]), rng.normal(size=len(quality.STATS))
    x = {**{int(b): quality.WORD_WEIGHT / np.sqrt(3) for b in buckets}, **{quality.BUCKETS + i: v for i, v in enumerate(stats)}}
    pairs = sum(m.factors[a] @ m.factors[b] * x[a] * x[b] for a in x for b in x if a < b)
    assert m.raw(buckets, stats) == pytest.approx(sum(m.linear[a] * v for a, v in x.items()) + pairs)


@pytest.mark.parametrize("word", ["Привет ", "ΑΒγ ", "Ếm ", "Abc "])
def test_capitals_count_at_every_length(word):
    at = quality.STATS.index("capitals")
    share = [quality.features(word * n, {})[1][at] for n in (10, 5000)]
    assert share[0] == share[1] == sum(map(str.isupper, word)) / len(word)


def test_sample_holds_every_label(spark):
    rows = [(i, f"l{i % 300:03}") for i in range(1500)] + [(None, "l000"), (2000, None)]
    df = spark.createDataFrame(rows, "doc_id long, lang string")
    got = {}
    for r in common.class_sample(df, "lang", 3).collect():
        got.setdefault(r.lang, []).append(r.doc_id)
    assert len(got) == 300 and all(len(x) == 3 for x in got.values())
    assert set(got["l007"]) == {r.doc_id for r in df.where("lang = 'l007'").orderBy(F.xxhash64("doc_id"), "doc_id").limit(3).collect()}


def test_languages_beyond_256_are_learned(spark):
    docs = [(i, f"{chr(0x4E00 + i // 8)}{chr(0x4E00 + i // 8)} " * 4, f"l{i // 8:03}") for i in range(8 * 260)]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    got = langid.identify(df, langid.fit(df, longest=1)).where("doc_id >= 8 * 257").collect()
    assert {(r.doc_id, r.lang_pred) for r in got} == {(i, x) for i, _, x in docs[8 * 257 :]}
