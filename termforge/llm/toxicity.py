"""Toxic passages by maximum-scoring segments.

Training gives every token a log-odds score under an informative Dirichlet prior (its own overall
frequency), shrunk towards 0 by a confidence margin. What is counted is not occurrences but *distinct
preceding words* of a token, so that copies and shared passages weigh as one observation. Scoring
runs the linear-time scan for all maximal scoring segments over the tokens of a text, turns segment
scores into E-values by an extreme-value law whose two constants are fitted on clean texts that the
scores were not learned from, and aggregates them.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termforge.llm import common
from termforge.llm.textmodel import training_rows, words_of

#: At most so many training texts of each label.
TRAIN_PER_CLASS = 10_000
#: Dirichlet prior: so much for every token, and so many observations dealt by overall frequency.
PRIOR_BASE = 0.5
PRIOR_WEIGHT = 1_000.0
#: Scores are shrunk by so many standard errors. Tokens that speak for toxicity need a z of at least MIN_Z and a score of
#: at least MIN_SCORE (words of a topic or language that toxic texts merely prefer are no signs); tokens that speak
#: against it more than BACKGROUND keep their own score, all others have BACKGROUND.
MARGIN = 1.0
MIN_Z = 3.0
MIN_SCORE = 2.0
MIN_CONTEXTS = 3
BACKGROUND = -0.05
#: One of so many training texts is kept out of the scores that the constants of the tail are fitted with.
TAIL_FOLDS = 4
#: Pairs of words that a task holds at a time, about.
PAIRS = 50_000
#: Segments with more than this many expected by chance in a clean text are not passages.
MAX_E_VALUE = 0.003


@dataclass
class Model:
    """Token scores, the score of all others, and the tail's constants: E = K n exp(-lambda s) segments by chance."""

    tokens: dict[str, float] = field(default_factory=dict)
    background: float = BACKGROUND
    share: float = 0.1  # of toxic texts
    tail_k: float = 1.0
    tail_lambda: float = 1.0

    def score(self, word: str) -> float:
        return self.tokens.get(word, self.background)


def segments(scores: list[float]) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (start, end, score) of a sequence, by one left-to-right scan."""
    found: list[tuple[float, float, int, int]] = []  # sum before, sum after, start, end
    total = 0.0
    for i, s in enumerate(scores):
        before, total = total, total + s
        if s <= 0:
            continue
        left, right, start = before, total, i
        while True:
            j = len(found) - 1
            while j >= 0 and found[j][0] >= left:
                j -= 1
            if j < 0 or found[j][1] >= right:
                found.append((left, right, start, i + 1))
                break
            left, start = found[j][0], found[j][2]
            del found[j:]
    return [(a, b, after - before) for before, after, a, b in found]


def sparse_segments(model: Model, words: list[str]) -> list[tuple[int, int, float]]:
    """The same segments; runs of background words enter the scan as one negative step."""
    bg, scored = model.background, {w: s for w in set(words) if (s := model.tokens.get(w)) is not None}
    if not any(s > 0 for s in scored.values()):
        return []
    at = [(i, scored[w]) for i, w in enumerate(words) if w in scored]
    steps, place, last = [], [], -1
    for i, s in at:
        if i - last > 1:
            steps.append(bg * (i - last - 1))
            place.append((last + 1, i))
        steps.append(s)
        place.append((i, i + 1))
        last = i
    return [(place[a][0], place[b - 1][1], s) for a, b, s in segments(steps)]


def judge(model: Model, text: str | None) -> tuple[float, list[tuple[int, int, float]]]:
    """(score, significant passages as word spans with their score) of one text.

    With p = 1 - exp(-E), the chance that a clean text of this length holds passages so strong (for the
    summed score of all significant segments), the score is the posterior share / (share + (1 - share) p).
    Texts without a significant passage score 0.
    """
    words = words_of(text)
    size = len(words) * model.tail_k
    kept = [
        (a, b, s) for a, b, s in sparse_segments(model, words) if size * math.exp(-model.tail_lambda * s) <= MAX_E_VALUE
    ]
    if not kept:
        return 0.0, []
    e_value = size * math.exp(-min(700.0, model.tail_lambda * sum(s for _, _, s in kept)))
    return model.share / (model.share - (1 - model.share) * math.expm1(-e_value)), kept


def fit(docs: DataFrame, labels: DataFrame, per_class: int = TRAIN_PER_CLASS) -> Model:
    """Learn from labelled documents outside the held-out fold (crc32 of the id mod 5 is 0).

    Scores come from all sampled texts. The tail's constants come from scores of the same kind without
    one of TAIL_FOLDS texts, and from the clean ones among these. Entries are words of the sample.
    """
    known = common.one_label(labels, "toxic").where(common.fold_remainder(F.col("doc_id"), 5) != 0)
    sample = common.class_sample(known.withColumn("toxic", (F.col("toxic") > 0).cast("int")), "toxic", per_class)
    texts = training_rows(docs, sample, "toxic")
    texts = texts.withColumn("kept", (F.pmod(F.xxhash64("doc_id", F.lit("tail")), F.lit(TAIL_FOLDS)) == 0).cast("int"))

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.int32(), pa.int32(), pa.string(), pa.string())

        def made(seen: set[tuple[int, int, str, str]]) -> pa.RecordBatch:
            rows = zip(*seen) if seen else ((), (), (), ())
            return pa.RecordBatch.from_arrays([pa.array(r, k) for r, k in zip(rows, kinds)], names=["toxic", "kept", "before", "word"])

        seen: set[tuple[int, int, str, str]] = set()
        for batch in batches:
            for toxic, kept, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                words = words_of(text.as_py())
                for at in range(0, len(words), PAIRS):
                    part = words[at : at + PAIRS]
                    seen.update((toxic, kept, a, w) for a, w in zip([words[at - 1] if at else "", *part], part))
                    if len(seen) >= PAIRS:
                        yield made(seen)
                        seen = set()
        yield made(seen)

    contexts = texts.select("toxic", "kept", "text").mapInArrow(common.trimmed(pairs), "toxic int, kept int, before string, word string")
    contexts = contexts.groupBy("toxic", "before", "word").agg((1 - F.min("kept")).alias("rest"))
    of = lambda toxic, what: F.sum(F.when(F.col("toxic") == toxic, what).otherwise(0))
    both = contexts.groupBy("word").agg(
        of(1, F.lit(1)).alias("y1"), of(0, F.lit(1)).alias("y0"), of(1, F.col("rest")).alias("r1"), of(0, F.col("rest")).alias("r0")
    )
    both = common.written(both, "toxic-words")
    sums = [float(x or 0) for x in both.agg(*(F.sum(c) for c in ("y1", "y0", "r1", "r0"))).first()]
    if not sums[0] or not sums[1]:
        return Model()

    def entries(y1: str, y0: str, n1: float, n0: float) -> dict[str, float]:
        prior = F.lit(PRIOR_BASE) + PRIOR_WEIGHT * (F.col(y1) + F.col(y0)) / (n1 + n0)
        p1, p0 = F.col(y1) + prior, F.col(y0) + prior
        delta = F.log(p1 / (n1 + PRIOR_WEIGHT - p1)) - F.log(p0 / (n0 + PRIOR_WEIGHT - p0))
        error = F.sqrt(1 / p1 + 1 / p0)
        low, high = delta - MARGIN * error, delta + MARGIN * error
        sign = (F.col(y1) >= MIN_CONTEXTS) & (low >= MIN_SCORE) & (delta / error >= MIN_Z)
        score = F.when(sign, low).when(high < BACKGROUND, high)
        rows = both.select("word", score.alias("score")).where("score is not null").toArrow()
        return dict(zip(rows.column(0).to_pylist(), rows.column(1).to_pylist()))

    model = Model(entries("y1", "y0", *sums[:2]))
    toxic, every = texts.agg(F.sum("toxic"), F.count("*")).first()
    model.share = min(0.5, max(0.01, toxic / every))  # the sample holds at most as many of each label
    part = Model(entries("r1", "r0", *sums[2:])) if sums[2] and sums[3] else model
    model.tail_k, model.tail_lambda = tail(part, texts.where("kept = 1 and toxic = 0"))
    return model


def tail(model: Model, clean: DataFrame) -> tuple[float, float]:
    """K and lambda of E = K n exp(-lambda s) by the segments of clean texts that score at least MIN_SCORE.

    Their excess over MIN_SCORE is exponential, so lambda is the inverse of its mean, and K follows from
    their number for each word. One more segment, with an excess of 1, stands for what was not seen.
    Lambda is at most 1, its value for exact log ratios.
    """

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, held, excess = 0, 0, 0.0
        for batch in batches:
            for text in batch.column(0):
                words = words_of(text.as_py())
                n += len(words)
                over = [s - MIN_SCORE for _, _, s in sparse_segments(model, words) if s >= MIN_SCORE]
                held += len(over)
                excess += sum(over)
        yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([held]), pa.array([excess])], names=["n", "held", "excess"])

    sums = clean.select("text").mapInArrow(common.trimmed(tally), "n long, held long, excess double").agg(F.sum("n"), F.sum("held"), F.sum("excess")).first()
    n, held, excess = (x or 0 for x in sums)
    decay = min(1.0, (held + 1) / (excess + 1))
    return (held + 1) / max(1, n) * math.exp(decay * MIN_SCORE), decay


RESULT = "struct<score:double,passages:array<struct<first_word:int,end_word:int,score:double>>>"


def detect(docs: DataFrame, model: Model, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, score and significant passages of every text, and the columns of ``keep``.

    Null and empty texts score 0 and hold no passage. Rows are judged one by one: repeated rows
    and null ids are ordinary, and very long texts are judged whole. Ids are whole numbers, or text of
    whole numbers. Columns of ``keep`` must not be called doc_id, score, passages or _text; other
    columns, whatever their names, are ignored. The model (words of the training sample) travels with
    the tasks.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf(RESULT)
    def judged(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model = shared.value
        kinds = pa.list_(
            pa.struct([("first_word", pa.int32()), ("end_word", pa.int32()), ("score", pa.float64())])
        )
        for batch in texts:
            found = [judge(model, t.as_py()) for t in batch]
            passages = [[{"first_word": a, "end_word": b, "score": x} for a, b, x in p] for _, p in found]
            yield pa.StructArray.from_arrays([pa.array([s for s, _ in found], pa.float64()), pa.array(passages, kinds)], names=["score", "passages"])
        common.give_back()

    # only texts go to the Python workers, the columns to keep stay where they are
    source = common.spread(docs.select(F.col("doc_id").cast("long"), F.col("text").alias("_text"), *keep))
    out = source.select("doc_id", judged("_text").alias("_judged"), *keep)
    return out.select("doc_id", "_judged.score", "_judged.passages", *keep)
