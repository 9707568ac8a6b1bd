"""Sentence ends learned from a corpus without labels.

A word is an abbreviation if a point follows it far more often than chance has it: the log-likelihood ratio
of its points, scaled down for long words and for each time that it stands without one and up for points
inside. Words that begin sentences far more often than chance has it are starters. A chunk that ends in ``!``
or ``?`` ends a sentence, and so does one that ends in a point, unless it is an abbreviation or a single
letter and no capitalised starter follows.

Chunks are what blanks part. Learning is two aggregations by word; what is learned is as large as the
vocabulary's share of abbreviations and starters.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from termforge.sources import scratch

#: Fixed values of the published method: a point's probability after an abbreviation, and the two thresholds.
ALMOST, ABBREVIATION_FROM, STARTER_FROM = 0.99, 0.3, 30.0
#: Learned words that are broadcast (some 60 bytes each).
WORDS = 500_000
CLOSERS, OPENERS, FIRST_WORD = "[\"'”’)\\]}]+$", "^[\"'“‘(\\[{]+", "[\\p{L}\\p{N}]+"


def chunk_pairs(docs: DataFrame) -> DataFrame:
    """(doc_id, pos, chunk, next): chunks in order from 0, each with the one behind it; null texts have none."""
    words = F.filter(F.split(F.coalesce("text", F.lit("")), "\\s+"), lambda x: x != "")
    rows = docs.select("doc_id", words.alias("w"))
    pairs = F.arrays_zip(F.col("w").alias("chunk"), F.slice("w", F.lit(2), F.greatest(F.size("w"), F.lit(1))).alias("next"))
    out = rows.select("doc_id", F.posexplode_outer(pairs).alias("pos", "p")).where("pos is not null")
    return out.select("doc_id", "pos", F.col("p.chunk").alias("chunk"), F.col("p.next").alias("next"))


def core(chunk: Column) -> Column:
    """A chunk without quotes and brackets around it."""
    return F.regexp_replace(F.regexp_replace(chunk, CLOSERS, ""), OPENERS, "")


def _marked(pairs: DataFrame) -> DataFrame:
    """``pairs`` with dot (ends in a point), word (in lower case, without the point or marks behind it) and after (the next word).

    ``next`` may be missing, and after is so then.
    """
    out = pairs.withColumn("_core", core(F.col("chunk")))
    word = F.lower(F.regexp_replace("_core", "(?:\\.|[,;:!?]+)$", ""))
    after = [F.regexp_extract("next", FIRST_WORD, 0).alias("after")] if "next" in pairs.columns else []
    return out.select(
        *pairs.columns,
        F.col("_core").endswith(".").alias("dot"),
        F.col("_core").rlike("[!?]$").alias("loud"),
        word.alias("word"),
        *after,
    )


def counted(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(chunk, n) of all chunks and (chunk, next, n) of those with a point inside: all that learning reads of the texts.

    Both are written, so that marks are told once for equal chunks and the texts are not read again.
    """
    words = F.split(F.coalesce("text", F.lit("")), "\\s+")
    chunks = docs.select(F.explode_outer(words).alias("chunk")).where("chunk <> ''").groupBy("chunk").agg(F.count("*").alias("n"))
    chunks = scratch.written(chunks, "chunks")
    words = F.filter(words, lambda x: x != "")
    pairs = F.arrays_zip(F.col("w").alias("chunk"), F.slice("w", F.lit(2), F.greatest(F.size("w"), F.lit(1))).alias("next"))
    pairs = F.filter(pairs, lambda x: F.contains(x["chunk"], F.lit(".")) & x["next"].isNotNull())  # before rows are made of them
    pointed = docs.select(words.alias("w")).select(F.explode_outer(pairs).alias("p")).where("p is not null").groupBy("p.chunk", "p.next").agg(F.count("*").alias("n"))
    return chunks, scratch.written(pointed, "pointed")


def _times_log(n: Column, p: Column) -> Column:
    """n log p, 0 where n is."""
    return F.when(n == 0, 0.0).otherwise(n * F.ln(F.when(n == 0, 1.0).otherwise(p)))


def abbreviations(docs: DataFrame, counts: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """(word, with_point, without, score) of the words that the corpus (doc_id, text) uses as abbreviations.

    ``counts`` is ``counted`` of the corpus, if it is at hand.
    """
    marked = _marked((counts or counted(docs))[0])
    times = lambda test: F.sum(F.when(test, F.col("n")).otherwise(0))
    counts = marked.groupBy("word").agg(times(F.col("dot")).alias("with_point"), times(~F.col("dot")).alias("without"))
    n = counts.agg(F.sum(F.col("with_point") + F.col("without")).alias("_n"), F.sum("with_point").alias("_points"))  # one row
    rows = counts.where((F.col("with_point") > 0) & F.col("word").rlike("\\p{L}")).crossJoin(F.broadcast(n))
    p = F.col("_points") / F.col("_n")
    chance = F.col("with_point") * F.ln(p) + _times_log(F.col("without"), 1 - p)
    sure = F.col("with_point") * F.ln(F.lit(ALMOST)) + F.col("without") * F.ln(F.lit(1 - ALMOST))
    letters = F.length(F.replace("word", F.lit("."), F.lit("")))
    points = F.length("word") - letters
    score = -2 * (chance - sure) * F.exp(-letters) * (points + 1) * F.pow(letters, -F.col("without"))
    return rows.select("word", "with_point", "without", score.alias("score")).where(F.col("score") >= ABBREVIATION_FROM)


def _sized(words: DataFrame) -> DataFrame:
    """Learned words to be broadcast, if they are at most WORDS."""
    return F.broadcast(words) if words.count() <= WORDS else words


def _short(marked: DataFrame, abbreviated: DataFrame) -> DataFrame:
    """``marked`` with short: the word before the point is an abbreviation or a single letter."""
    known = _sized(abbreviated.select("word", F.lit(True).alias("_known")))
    single = F.col("word").rlike("^\\p{L}$")
    return marked.join(known, "word", "left").withColumn("short", F.coalesce("_known", F.lit(False)) | single).drop("_known")


def starters(docs: DataFrame, abbreviated: DataFrame, counts: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """(word, after_point, times, score): words that begin sentences, in lower case; ``counts`` as in ``abbreviations``."""
    chunks, pointed = counts or counted(docs)
    marked = _short(_marked(pointed), abbreviated)
    ends = F.col("dot") & ~F.col("short") & (F.col("after") != "")
    heads = scratch.written(marked.where(ends).groupBy(F.lower("after").alias("word")).agg(F.sum("n").alias("after_point")), "heads")
    own = F.lower(F.regexp_extract("chunk", FIRST_WORD, 0))
    times = chunks.groupBy(own.alias("word")).agg(F.sum("n").alias("times"))
    sums = chunks.agg(F.sum("n").alias("n")).crossJoin(heads.agg(F.coalesce(F.sum("after_point"), F.lit(0)).alias("breaks")))  # one row
    rows = heads.join(times, "word").crossJoin(F.broadcast(sums))
    a, both, b, n = (F.col(c).cast("double") for c in ("breaks", "after_point", "times", "n"))
    chance = _times_log(b, b / n) + _times_log(n - b, 1 - b / n)
    first, rest = both / a, (b - both) / (n - a)
    apart = _times_log(both, first) + _times_log(a - both, 1 - first) + _times_log(b - both, rest) + _times_log(n - a - b + both, 1 - rest)
    rows = rows.select("word", "after_point", "times", (-2 * (chance - apart)).alias("score"), (both / b > a / n).alias("_more"))
    return rows.where((F.col("score") >= STARTER_FROM) & F.col("_more")).drop("_more")


def ends(docs: DataFrame, abbreviated: DataFrame, starting: DataFrame) -> DataFrame:
    """(doc_id, pos, chunk, ends): all chunks, and whether a sentence ends with each; the last of a text always ends one.

    Only chunks with one of the marks that end sentences are looked at more closely.
    """
    maybe = F.col("chunk").rlike("[.!?]") & F.col("next").isNotNull()
    rows = chunk_pairs(docs).withColumn("_maybe", maybe)
    told = F.when(F.col("_maybe"), core(F.col("chunk")))  # null, as all that follows from it, for other chunks
    rows = rows.withColumn("_core", told).select(
        "doc_id", "pos", "chunk", "next", F.col("_core").endswith(".").alias("dot"), F.col("_core").rlike("[!?]$").alias("loud"),
        F.when(F.col("_maybe"), F.lower(F.regexp_replace("_core", "(?:\\.|[,;:!?]+)$", ""))).alias("word"),
        F.when(F.col("_maybe"), F.regexp_extract("next", FIRST_WORD, 0)).alias("after"),
    )
    rows = _short(rows, abbreviated).withColumn("_head", F.lower("after"))
    rows = rows.join(_sized(starting.select(F.col("word").alias("_head"), F.lit(True).alias("_starts"))), "_head", "left")
    begins = F.coalesce("_starts", F.lit(False)) & F.col("after").rlike("^\\p{Lu}")
    stop = F.col("next").isNull() | F.coalesce(F.col("loud") | (F.col("dot") & (~F.col("short") | begins)), F.lit(False))
    return rows.select("doc_id", "pos", "chunk", stop.alias("ends"))
