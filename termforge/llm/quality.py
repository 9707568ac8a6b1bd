"""Quality scores by a factorisation machine.

Inputs are hashed words, statistics of the text's structure and its length. Pairwise interactions
have low rank and are summed in linear time: the square of the sum less the sum of squares.
"""

from __future__ import annotations

import sys
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from termforge.llm import common
from termforge.llm.textmodel import training_rows

#: At most so many training texts of each label.
TRAIN_PER_CLASS = 4_000
BUCKETS = 1 << 14
RANK = 8
EPOCHS = 12
RATE = 0.02
WORD_DECAY, PAIR_DECAY = 1e-4, 1e-3
#: The score of all words together weighs like one statistic.
WORD_WEIGHT = 1.0
STATS = (
    "bias", "log words", "log characters", "distinct words", "repeats of the word before", "mean word length",
    "capitals", "punctuation", "digits", "symbols", "words with a symbol inside or at the end", "bars",
    "lines a word", "repeated lines", "longest run", "words ending a sentence",
)
SYMBOLS = frozenset("#$%&*|!@^~=<>\\{}[]_+")
CACHED = 300_000


def structure(text: str, words: list[str], counts: Counter) -> list[float]:
    """The statistics of STATS, each of the order of 1."""
    n, chars = len(words), len(text)
    if not n:
        return [1.0] + [0.0] * (len(STATS) - 1)
    lines = [x for x in text.split("\n") if x.strip()]
    repeats = run = longest = 0
    for a, b in zip(words, words[1:]):
        run = run + 1 if a == b else 0
        repeats += a == b
        longest = max(longest, run)
    upper = chars - len(text.translate(_NO_CAPITALS))
    marks = {c: k for c in SYMBOLS if (k := text.count(c))}
    symbols = sum(marks.values())
    digits = sum(text.count(c) for c in "0123456789")
    stops = text.count(". ") + text.count(".\n") + text.endswith(".")
    return [
        1.0,
        np.log1p(n) / 6,
        np.log1p(chars) / 8,
        len(counts) / n,
        repeats / n,
        (chars - n) / n / 6,
        upper / chars,
        (text.count(".") + text.count(",")) / n,
        digits / chars,
        symbols / chars,
        min(1.0, symbols / n),
        marks.get("|", 0) / n,
        len(lines) / n,
        1 - len(set(lines)) / max(1, len(lines)),
        np.log1p(longest) / 3,
        stops / n,
    ]


_NO_CAPITALS = {i: None for i in range(sys.maxunicode + 1) if chr(i).isupper()}


def features(text: str | None, cache: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
    """(distinct hashed words, statistics) of a whole text."""
    text = text or ""
    words = text.split()
    counts = Counter(words)
    buckets = set()
    for w in counts:
        b = cache.get(w)
        if b is None:
            if len(cache) >= CACHED:
                cache.clear()
            b = cache[w] = zlib.crc32(w.lower().encode("utf-8", "surrogatepass")) % BUCKETS
        buckets.add(b)
    return np.fromiter(buckets, np.int64, len(buckets)), np.array(structure(text, words, counts))


@dataclass
class Machine:
    """Weights: linear ones and rank-RANK factors, of the buckets first and then of the statistics."""

    mean: np.ndarray
    scale: np.ndarray
    linear: np.ndarray
    factors: np.ndarray

    def raw(self, buckets: np.ndarray, stats: np.ndarray) -> float:
        """Linear part plus half of (square of sums - sum of squares)."""
        x = np.clip((stats - self.mean) / self.scale, -8, 8)
        weight = WORD_WEIGHT / np.sqrt(max(1, len(buckets)))
        v, s = self.factors[buckets] * weight, self.factors[BUCKETS:] * x[:, None]
        total = v.sum(0) + s.sum(0)
        return float(
            self.linear[buckets].sum() * weight
            + self.linear[BUCKETS:] @ x
            + 0.5 * (total @ total - (v * v).sum() - (s * s).sum())
        )

    def score(self, buckets: np.ndarray, stats: np.ndarray) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.raw(buckets, stats), -30, 30))))


def train(words: list[np.ndarray], stats: np.ndarray, labels: np.ndarray, epochs: int = EPOCHS, seed: int = 7) -> Machine:
    """Logistic loss, classes weighted alike, minimised by Adam over mini-batches."""
    rng = np.random.default_rng(seed)
    mean, scale = stats.mean(0), stats.std(0) + 1e-6
    mean[0], scale[0] = 0.0, 1.0  # the bias stays 1
    x_all = np.clip((stats - mean) / scale, -8, 8)
    dim = BUCKETS + stats.shape[1]
    params = np.concatenate([np.zeros((dim, 1)), rng.normal(0, 0.02, (dim, RANK))], 1)
    m, v = np.zeros_like(params), np.zeros_like(params)
    decay = np.concatenate([np.full((dim, 1), WORD_DECAY), np.full((dim, RANK), PAIR_DECAY)], 1)
    share = max(1e-6, min(1 - 1e-6, float(labels.mean())))
    weight = np.where(labels > 0, 0.5 / share, 0.5 / (1 - share))
    step, size = 0, 64
    for _ in range(epochs):
        order = rng.permutation(len(labels))
        for at in range(0, len(order), size):
            rows = order[at : at + size]
            flat = np.concatenate([words[i] for i in rows] or [np.empty(0, np.int64)])
            doc = np.repeat(np.arange(len(rows)), [len(words[i]) for i in rows])
            w = np.array([WORD_WEIGHT / np.sqrt(max(1, len(words[i]))) for i in rows])[doc]
            x, ps, pw = x_all[rows], params[BUCKETS:], params[flat] * w[:, None]
            sums = np.zeros((len(rows), RANK + 1))
            np.add.at(sums, doc, pw)
            sums += x @ ps
            squares = np.zeros(len(rows))
            np.add.at(squares, doc, (pw[:, 1:] ** 2).sum(1))
            squares += (x**2) @ (ps[:, 1:] ** 2).sum(1)
            raw = sums[:, 0] + 0.5 * ((sums[:, 1:] ** 2).sum(1) - squares)
            error = (1 / (1 + np.exp(-np.clip(raw, -30, 30))) - labels[rows]) * weight[rows] / len(rows)
            g = np.zeros_like(params)
            pull = np.concatenate([np.ones((len(rows), 1)), sums[:, 1:]], 1)
            gw = pull[doc] * w[:, None]
            gw[:, 1:] -= params[flat, 1:] * (w**2)[:, None]
            np.add.at(g, flat, gw * error[doc][:, None])
            gs = (x * error[:, None]).T @ pull
            gs[:, 1:] -= ((x**2) * error[:, None]).sum(0)[:, None] * ps[:, 1:]
            g[BUCKETS:] += gs
            g += decay * params
            step += 1
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            params -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return Machine(mean, scale, params[:, 0].copy(), params[:, 1:].copy())


def fit(docs: DataFrame, labels: DataFrame, per_class: int = TRAIN_PER_CLASS) -> Machine | None:
    """Learn from labelled documents outside the held-out fold (crc32 of the id mod 5 is 0).

    Features of at most ``2 * per_class`` texts reach the driver. None if there is nothing to learn from.
    """
    known = common.one_label(labels, "quality").where(common.fold_remainder(F.col("doc_id"), 5) != 0)
    sample = common.class_sample(known.withColumn("quality", (F.col("quality") > 0).cast("int")), "quality", per_class)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict[str, int] = {}
        for batch in batches:
            made = [features(t.as_py(), cache) for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    batch.column(1),
                    pa.array([np.sort(b).astype("<u2").tobytes() for b, _ in made], pa.binary()),
                    pa.array([s.astype("<f8").tobytes() for _, s in made], pa.binary()),
                ],
                names=["doc_id", "quality", "words", "stats"],
            )

    rows = training_rows(docs, sample, "quality").select("doc_id", "quality", "text")
    rows = rows.mapInArrow(run, "doc_id long, quality int, words binary, stats binary").toPandas()
    rows = rows.sort_values(["doc_id", "words", "stats"]).drop_duplicates("doc_id")  # of repeated ids the same row always
    if not len(rows):
        return None
    return train(
        [np.frombuffer(w, "<u2").astype(np.int64) for w in rows["words"]],
        np.array([np.frombuffer(s, "<f8") for s in rows["stats"]]),
        rows["quality"].to_numpy(float),
    )


def rate(docs: DataFrame, machine: Machine | None, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id and score (0 to 1, higher is better) of every text, and the columns of ``keep``.

    Null texts count as empty. Without a machine (no labels) every text scores 0.5. Rows are rated
    one by one: repeated rows and null ids are ordinary, and very long texts are rated whole. Ids are
    whole numbers, or text of whole numbers. Columns of ``keep`` must not be called doc_id, score or
    _text; other columns, whatever their names, are ignored.
    """
    source = common.spread(docs.select(F.col("doc_id").cast("long"), F.col("text").alias("_text"), *keep))
    fields = [T.StructField("doc_id", T.LongType()), T.StructField("score", T.DoubleType(), False)]
    schema = T.StructType([*fields, *(source.schema[c] for c in keep)])
    shared = docs.sparkSession.sparkContext.broadcast(machine)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine, cache = shared.value, {}
        for batch in batches:
            scores = [0.5 if machine is None else machine.score(*features(t.as_py(), cache)) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(scores, pa.float64()), *(batch.column(2 + i) for i in range(len(keep)))],
                names=schema.names,
            )

    return source.mapInArrow(run, schema)
