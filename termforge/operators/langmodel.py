"""Language identification by a character n-gram multinomial model with add-one smoothing."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from termforge.functions import ngrams
from termforge.sources import scratch
from termforge.sources.scratch import frequent_from  # noqa: F401

GRAM = 4
OTHER = "other"
#: Grams that are broadcast, the most frequent (some 100 bytes each).
MODEL_GRAMS = 500_000
#: Logarithms are whole numbers of this fraction, so that sums do not depend on their order.
SCALE = 1e10


def grams_of(lines: DataFrame, key: str, n: int = GRAM) -> DataFrame:
    """(key, gram, n): counts of every line's grams. Tasks add up blocks of lines, and only those sums are shuffled."""

    def sums(batches):
        for keys, texts in ngrams.blocks(batches):
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in ngrams.counted(keys, texts, n)], names=["key", "gram", "n"])

    schema = T.StructType([T.StructField(key, lines.schema[key].dataType), T.StructField("gram", T.StringType()), T.StructField("n", T.LongType())])
    return lines.select(key, "text").mapInArrow(sums, schema).groupBy(key, "gram").agg(F.sum("n").alias("n"))


def gram_counts(train: DataFrame, n: int = GRAM) -> DataFrame:
    """(lang, gram, n) of labelled lines; labels come from the data."""
    return grams_of(train.where(F.col("lang").isNotNull()), "lang", n)


def totals(counts: DataFrame) -> DataFrame:
    """(lang, total): grams of the language plus the size of the common vocabulary."""
    size = counts.select(F.count_distinct("gram").alias("v"))
    return counts.groupBy("lang").agg(F.sum("n").alias("t")).crossJoin(F.broadcast(size)).select("lang", (F.col("t") + F.col("v")).alias("total"))


def probabilities(counts: DataFrame) -> DataFrame:
    """(lang, gram, p) over the common vocabulary; unseen pairs have count 0 before smoothing.

    The counts are pivoted by label, so that the vocabulary is not crossed with the labels in a join.
    """
    per = totals(counts).agg(F.collect_list(F.struct("lang", "total")).alias("langs"))
    seen = counts.groupBy("gram").agg(F.map_from_entries(F.collect_list(F.struct("lang", "n"))).alias("by"))
    rows = seen.crossJoin(F.broadcast(per)).select("gram", "by", F.explode("langs").alias("l"))
    n = F.coalesce(F.try_element_at("by", F.col("l.lang")), F.lit(0))
    return rows.select("l.lang", "gram", ((n + 1) / F.col("l.total")).alias("p"))


def _marks(counts: DataFrame, sums: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The model as (gram, total, marks) and one row of all languages with their logarithm of an unseen gram.

    ``marks`` has a language only where it has seen the gram, with what its logarithm is above that of an
    unseen one: the table grows with the counts, not with grams times languages.
    """
    log = lambda n: F.round(F.ln(n / F.col("total")) * SCALE).cast("long")
    langs = sums.select("lang", log(F.lit(1)).alias("least"))  # a row for each language
    seen = counts.join(F.broadcast(sums), "lang").select("gram", "n", F.struct("lang", (log(F.col("n") + 1) - log(F.lit(1))).alias("more")).alias("m"))
    grams = seen.groupBy("gram").agg(F.sum("n").alias("total"), F.collect_list("m").alias("marks"))
    return grams, langs.agg(F.collect_list(F.struct("lang", "least")).alias("langs"))


def _chunks(tests: DataFrame, key: str) -> DataFrame:
    """(key, text, chunk): lines dealt by the hash of their keys into chunks of about a block of characters."""
    total = tests.agg(F.sum(F.length("text"))).first()[0] or 0
    many = max(tests.sparkSession.sparkContext.defaultParallelism, total // ngrams.BLOCK + 1)
    return tests.select(key, "text", F.pmod(F.xxhash64(key), F.lit(many)).alias("chunk"))


def _chunk_sums(key: str, n: int):
    """A function over a chunk's lines and its known grams: (key, known, more), the sums of each key."""

    def line_sums(values: np.ndarray, w: ngrams.Windows, of: np.ndarray, keys: int) -> np.ndarray:
        """Sums by key as whole numbers of any size; ``values`` are below 2 ** 40."""
        held = np.flatnonzero(w.per_text[: len(of)])
        out = np.zeros(keys, dtype=object)
        if len(held):
            at = (np.cumsum(w.per_text) - w.per_text)[held]
            last = at[-1] + w.per_text[held[-1]]
            add = lambda v: np.add.reduceat(v[w.places[:last]], at).astype(object)
            if w.per_text.max() < 1 << 23:
                np.add.at(out, of[held], add(values))
            else:
                np.add.at(out, of[held], add(values >> 20) * (1 << 20) + add(values & ((1 << 20) - 1)))
        return out

    def sums(lines, met):
        by = lines.column(key).combine_chunks().dictionary_encode("encode")
        of, marks = by.indices.to_numpy(), met.column("marks").combine_chunks()
        # the known grams stand behind the lines, a window each
        w = ngrams.Windows(ngrams.decoded(lines.column("text").combine_chunks()) + ngrams.decoded(met.column("gram").combine_chunks()), n)
        grams = w.places[len(w.places) - len(met) :]
        known = np.zeros(w.size, dtype=np.int64)
        known[grams] = 1
        counts = line_sums(known, w, of, len(by.dictionary))
        flat, owner = marks.flatten(), grams[marks.value_parent_indices().to_numpy()]
        langs, above = flat.field("lang").dictionary_encode(), flat.field("more").to_numpy()
        more = [[] for _ in range(len(by.dictionary))]
        for i, lang in enumerate(langs.dictionary.to_pylist()):
            mine = langs.indices.to_numpy() == i
            values = np.zeros(w.size, dtype=np.int64)
            values[owner[mine]] = above[mine]
            for row, s in zip(more, line_sums(values, w, of, len(more))):
                if s:
                    row.append((lang, int(s)))
        found = np.flatnonzero(counts)
        columns = [
            by.dictionary.take(pa.array(found)),
            pa.array([int(counts[i]) for i in found], pa.int64()),
            pa.array([more[i] for i in found], pa.map_(pa.string(), pa.decimal128(38, 0))),
        ]
        return pa.table(columns, names=[key, "known", "more"])

    return sums


def line_scores(tests: DataFrame, counts: DataFrame, key: str = "line_no", n: int = GRAM, most: int | None = None) -> DataFrame:
    """(key, lang, score): summed log probability of known grams in every language; unknown grams are skipped.

    ``counts`` is ``gram_counts`` of the training lines; keys of ``tests`` are unique. Chunks of lines ask for the
    model's rows of their different grams, once each, and score their lines by them: what is joined are grams of
    chunks, not of lines. The most frequent grams, at most ``most`` (MODEL_GRAMS), are broadcast to that join.
    """
    most = MODEL_GRAMS if most is None else most
    grams, langs = _marks(counts, totals(counts))
    grams = scratch.written(grams, "model-grams")
    least = scratch.frequent_from(grams, most)
    lines = _chunks(tests, key)

    def asked(chunk, lines):
        w = ngrams.Windows(ngrams.decoded(lines.column("text").combine_chunks()), n)
        return pa.table([pa.array(np.full(w.size, chunk[0].as_py())), pa.array(w.grams(np.arange(w.size)), pa.string())], names=["chunk", "gram"])

    needed = lines.groupBy("chunk").applyInArrow(asked, "chunk long, gram string")
    frequent = F.broadcast(grams.where(F.col("total") >= least).select("gram", "marks"))
    if least == 1:
        met = needed.join(frequent, "gram")
    else:
        needed = scratch.written(needed, "asked-grams")
        rest = needed.join(frequent.select("gram"), "gram", "left_anti")
        met = needed.join(frequent, "gram").unionByName(rest.join(grams.where(F.col("total") < least).select("gram", "marks"), "gram"))
    schema = T.StructType(
        [
            T.StructField(key, tests.schema[key].dataType),
            T.StructField("known", T.LongType()),
            T.StructField("more", T.MapType(T.StringType(), T.DecimalType(38, 0))),
        ]
    )
    sums = lines.groupBy("chunk").cogroup(met.groupBy("chunk")).applyInArrow(_chunk_sums(key, n), schema)
    rows = sums.crossJoin(F.broadcast(langs)).select(key, "known", "more", F.explode("langs").alias("l"))
    unseen = F.col("known").cast("decimal(19,0)") * F.col("l.least").cast("decimal(18,0)")
    score = (unseen + F.coalesce(F.try_element_at("more", F.col("l.lang")), F.lit(0))).cast("double") / SCALE
    return rows.select(key, "l.lang", score.alias("score"))


def predict(tests: DataFrame, counts: DataFrame, key: str = "line_no", n: int = GRAM, most: int | None = None) -> DataFrame:
    """(key, label): the likeliest language, ties by name; ``other`` where no gram is known. Keys are unique."""
    best = (
        line_scores(tests, counts, key, n, most)
        .groupBy(key)
        .agg(F.min(F.struct((-F.col("score")).alias("s"), "lang")).alias("b"))
        .select(key, F.col("b.lang").alias("label"))
    )
    return tests.select(key).join(best, key, "left").select(key, F.coalesce("label", F.lit(OTHER)).alias("label"))
