"""Benchmark decontamination by winnowing, in DataFrame functions only.

A window is ``span`` consecutive words of a benchmark item (the whole item where it is shorter).
Of both sides, the smallest hash among the k-grams of every window is kept, so that any window that
both hold has a kept fingerprint in common. A document's fingerprints that an item shares are
extended to the words around them; of these, runs that equal a window of an item, word by word, are
hits. Hash collisions can therefore add work but no hits, and it does not matter which of equal
hashes is kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from termforge.llm import common

SPAN = 10
GRAM = 6
#: Fingerprint tables up to this many rows are broadcast (32 bytes a row), tables of windows (of up to
#: some hundred bytes) up to a quarter of it; larger ones are shuffled.
BROADCAST_ROWS = 1_000_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def lower_ascii(text: Column) -> Column:
    """A-Z only; ``lower`` does the same, and faster, where all is ASCII."""
    return F.when(text.rlike(r"[^\x00-\x7F]"), F.translate(text, UPPER, LOWER)).otherwise(F.lower(text))


def words_of(text: Column) -> Column:
    """Words of a text; null has none."""
    return F.coalesce(F.regexp_extract_all(lower_ascii(text), F.lit(WORD), F.lit(0)), F.array().cast("array<string>"))


def _starts(n: Column, width: int) -> Column:
    """0-based starts of all runs of ``width`` in ``n`` elements."""
    return F.when(n >= width, F.sequence(F.lit(0), n - width)).otherwise(F.array().cast("array<int>"))


def fingerprints(df: DataFrame, window: int, gram: int) -> DataFrame:
    """``df`` with array ``g`` of (fp, size, pos): the leftmost smallest k-gram of every window of ``window`` words.

    Reads column ``h``, the hashes of the words. Each step is a projection of its own, since the optimizer
    would otherwise compute inner arrays once for every element of outer ones; elements are read by
    position, since slices inside a lambda would copy the whole array every time.
    """
    run = window - gram + 1
    grams = F.transform(
        _starts(F.size("h"), gram),
        lambda i: F.struct(F.xxhash64(F.lit(window), *(F.get("h", i + j) for j in range(gram))).alias("fp"), F.lit(window).alias("size"), i.alias("pos")),
    )
    df = df.withColumn("g", grams)
    if run == 1:
        return df
    least = F.transform(_starts(F.size("g"), run), lambda i: F.least(*(F.get("g", i + j) for j in range(run))))
    # a minimum stays for consecutive windows
    return df.withColumn("m", least).withColumn(
        "g", F.filter("m", lambda x, i: (i == 0) | (x["pos"] != F.get("m", i - 1)["pos"]))
    ).drop("m")


def document_prints(docs: DataFrame, sizes: dict[int, int]) -> DataFrame:
    """doc_id, th, fp, size, pos of every fingerprint, and of every document a null fp with the number of its words as pos.

    ``sizes`` has the gram of each window size.
    """
    kind = "array<struct<fp:bigint,size:int,pos:int>>"
    rows = docs.select("doc_id", F.xxhash64("text").alias("th"), words_of(F.col("text")).alias("words"))
    rows = rows.select("doc_id", "th", F.transform("words", lambda w: F.xxhash64(w)).alias("h"))
    rows = rows.withColumn("all", F.array(F.struct(F.lit(None).cast("long"), F.lit(0), F.size("h"))).cast(kind))
    for size, gram in sizes.items():
        rows = fingerprints(rows, size, gram).withColumn("all", F.concat("all", F.col("g").cast(kind)))
    # an outer explode: a filter that the optimizer infers for an inner one would compute the arrays again
    return rows.select("doc_id", "th", F.explode_outer("all").alias("g")).select("doc_id", "th", "g.*")


def _runs_at(sizes: dict[int, int]) -> Column:
    """Every run of a window's size of ``words`` that holds the k-gram of a fingerprint in ``at`` (size, pos)."""

    def runs(x: Column, size: int, gram: int) -> Column:
        first, last = F.greatest(x["pos"] - (size - gram), F.lit(0)), F.least(x["pos"], F.size("words") - size)

        def run(i: Column) -> Column:
            window = F.concat_ws(" ", *(F.get("words", i + j) for j in range(size)))
            return F.struct(F.lit(size).alias("size"), i.alias("at"), window.alias("window"))

        return F.transform(F.sequence(first, last), run)

    # a fingerprint lies in a text of at least its window's size, so that no sequence runs backwards
    of_size = [F.flatten(F.transform(F.filter("at", lambda x: x["size"] == n), lambda x: runs(x, n, g))) for n, g in sizes.items()]  # noqa: B023
    return F.concat(*of_size)


def decontaminate(docs: DataFrame, items: DataFrame, span: int = SPAN, gram: int = GRAM) -> DataFrame:
    """One row per document: which of its words lie in an occurrence of a benchmark window.

    ``docs`` needs doc_id and text, ``items`` item_id and text; ids may be of any type, and other
    columns, whatever their names, are ignored. Returns doc_id, n_words, n_hit, n_items, items_sha256,
    contaminated, and text_hash (xxhash64 of the text, which with the id names a row).

    Null and empty texts have no words and no hits. A row with a null id is an ordinary row.
    Repeated documents each get their row; repeated items count once. Without items, or without
    documents, nothing is hit. Work and rows grow with the length of a text, also where one word is
    repeated throughout text and item.
    """
    items = (
        items.select(F.col("item_id").cast("string"), words_of(F.col("text")).alias("words"))
        .where(F.size("words") > 0)
        .distinct()
        .withColumn("size", F.least(F.size("words"), F.lit(span)))
    )
    items = common.written(items, "items")
    # lengths of items with less than a window: at most span - 1 values
    short = [r[0] for r in items.where(F.col("size") < span).select("size").distinct().collect()]
    sizes = {n: min(n, gram) for n in [span, *sorted(short)]}
    prints = windows = None
    for size, k in sizes.items():
        own = items.where(F.col("size") == size)
        fps = fingerprints(own.select(F.transform("words", lambda w: F.xxhash64(w)).alias("h")), size, k)
        fps = fps.select(F.explode_outer("g.fp").alias("fp"))
        runs = F.transform(_starts(F.size("words"), size), lambda i: F.concat_ws(" ", *(F.get("words", i + j) for j in range(size))))
        runs = own.select("item_id", F.explode_outer(runs).alias("window"))
        prints, windows = (fps, runs) if prints is None else (prints.unionAll(fps), windows.unionAll(runs))
    prints = common.written(prints.where("fp is not null").distinct(), "prints")
    windows = common.written(windows.distinct(), "windows")

    docs = common.spread(docs.select("doc_id", "text"))
    found, known = document_prints(docs, sizes), prints.select("fp", F.lit(True).alias("known"))
    if prints.count() <= BROADCAST_ROWS:  # one pass gives the numbers of words and the hits
        found = found.join(F.broadcast(known), "fp", "left").where("known or fp is null")
        found = common.written(found.drop("known"), "hits")
        counts = found.where("fp is null").select("doc_id", "th", F.col("pos").cast("long").alias("n_words"))
        found = found.where("fp is not null")
    else:
        counts = docs.select("doc_id", F.xxhash64("text").alias("th"), F.size(words_of(F.col("text"))).cast("long").alias("n_words"))
        found = common.written(found.where("fp is not null").join(known, "fp", "left_semi"), "hits")

    # the texts with a shared fingerprint once more; no more positions of a text than it has words for each size
    aligned = found.groupBy("doc_id", "th").agg(F.collect_set(F.struct("size", "pos")).alias("at"))
    aligned = common.written(aligned, "aligned")
    if (aligned.agg(F.sum(F.size("at") + F.lit(4))).first()[0] or 0) <= BROADCAST_ROWS:
        aligned = F.broadcast(aligned)
    texts = docs.select("doc_id", "text", F.xxhash64("text").alias("th")).alias("t")
    same = F.col("t.doc_id").eqNullSafe(F.col("a.doc_id")) & (F.col("t.th") == F.col("a.th"))
    texts = texts.join(aligned.alias("a"), same).select("t.doc_id", "t.th", words_of(F.col("text")).alias("words"), "at")
    runs = texts.select("doc_id", "th", _runs_at(sizes).alias("r"))
    runs = runs.select("doc_id", "th", F.explode_outer("r").alias("r")).select("doc_id", "th", "r.*")
    runs = runs.where("window is not null").distinct()
    known = windows.select("window").distinct()
    if windows.count() <= BROADCAST_ROWS // 4:
        known, windows = F.broadcast(known), F.broadcast(windows)
    hits = common.written(runs.join(known, "window", "left_semi"), "windows-hit")
    # the union of a document's runs: at most as many as its words for each size
    ends = F.array_sort(F.collect_list(F.struct("at", (F.col("at") + F.col("size")).alias("end"))))
    covered = F.aggregate(
        "runs",
        F.struct(F.lit(0).alias("n"), F.lit(0).alias("to")),
        lambda a, r: F.struct(
            (a["n"] + F.greatest(r["end"] - F.greatest(r["at"], a["to"]), F.lit(0))).alias("n"), F.greatest(a["to"], r["end"]).alias("to")
        ),
        lambda a: a["n"],
    )
    hit = hits.groupBy("doc_id", "th").agg(ends.alias("runs")).select("doc_id", "th", covered.cast("long").alias("n_hit"))
    ids = hits.select("doc_id", "th", "window").distinct().join(windows, "window").groupBy("doc_id", "th").agg(F.array_sort(F.collect_set("item_id")).alias("ids"))
    both = hit["doc_id"].eqNullSafe(ids["doc_id"]) & hit["th"].eqNullSafe(ids["th"])
    return _report(counts, hit.join(ids, both).select(hit["doc_id"], hit["th"], "n_hit", "ids"))


def _report(counts: DataFrame, hit: DataFrame) -> DataFrame:
    on = counts["doc_id"].eqNullSafe(hit["doc_id"]) & counts["th"].eqNullSafe(hit["th"])
    joined = counts.join(hit, on, "left").select(counts["doc_id"], counts["th"], "n_words", "n_hit", "ids")
    ids = F.coalesce("ids", F.array().cast("array<string>"))
    n_hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    return joined.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size(ids).cast("long").alias("n_items"),
        F.sha2(F.array_join(ids, ","), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
        F.col("th").alias("text_hash"),
    )
