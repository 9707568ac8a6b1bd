"""Phrase collocations: exact counts of word n-grams, scored by their weakest cut.

1. Texts are cut into pieces, and identical pieces of a language become one row with a multiplicity, in
   the task that reads them and then over all tasks.
2. Pieces lie in hash buckets. In each, duckdb counts weighted n-grams, beyond memory on the task's own
   disk. The counts go to hash buckets of (language, n-gram) as compressed blocks of sorted n-grams, where
   duckdb adds them up the same way. An n-gram is at most as frequent as its parts, so only those of the
   least count are kept.
3. Candidates send a request for the parts of each of their cuts; requests and counts meet by a shuffle on
   (language, part). The same way longer candidates report to the ones inside them.

No list of n-grams is held in a task's memory, sent to the driver or broadcast by size unknown. duckdb's
files are spill of a running task, like Spark's own: no other task reads them, they end with it, and a
task that is lost is run again from the shuffled pieces.
"""

from __future__ import annotations

import re
import tempfile
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from termforge.llm import common

LEAST, MAX_WORDS, TOP = 10, 3, 2000
#: A shorter candidate goes if a longer one has this share of its count, in hundredths.
INSIDE = 50
SCALE = 1_000_000
NO_LANG = "und"
#: Memory of one task's duckdb, beyond which it spills, and rows of a batch that leaves it or is sorted into blocks.
MEMORY, BATCH, SORTED = "256MB", 50_000, 500_000
#: Distinct pieces, and their characters, that a reading task holds before it passes them on.
HELD_PIECES, HELD_CHARS = 200_000, 16_000_000

#: A-Z become lower case, a tab a space, and each separator a line feed; one byte each, so UTF-8 stays whole.
_BYTES = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ\t.,;:!?\x0b\x0c\x0d", b"abcdefghijklmnopqrstuvwxyz \n\n\n\n\n\n\n\n\n")
_BLANKS = re.compile(rb" {2,}")
_PIECE = pa.schema([("lang", pa.string()), ("piece", pa.string()), ("m", pa.int64())])
_BLOCK = pa.schema([("bucket", pa.int32()), ("langs", pa.list_(pa.string())), ("numbers", pa.list_(pa.int32())), ("size", pa.int32()), ("phrases", pa.binary()), ("f", pa.binary())])
_COUNT = pa.schema([("lang", pa.string()), ("words", pa.int32()), ("phrase", pa.string()), ("f", pa.int64())])


def pieces_of(text: str | None) -> list[bytes]:
    """The pieces of a text that have words, their words lower-cased and parted by one space."""
    raw = (text or "").encode("utf-8", "surrogatepass").translate(_BYTES)
    return [p for x in _BLANKS.sub(b" ", raw).split(b"\n") if (p := x.strip(b" "))]


def _distinct_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[str, Counter] = {}
    n = chars = 0

    def out() -> Iterator[pa.RecordBatch]:
        for lang, counts in held.items():
            keys = list(counts)
            for i in range(0, len(keys), BATCH):
                some = keys[i : i + BATCH]
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(some), pa.string()), pa.array(some, pa.binary()).cast(pa.string()), pa.array([counts[k] for k in some], pa.int64())], schema=_PIECE)
        held.clear()

    for batch in batches:
        for lang, text in zip(batch.column(0), batch.column(1)):
            counts = held.setdefault(lang.as_py(), Counter())
            before = len(counts)
            pieces = pieces_of(text.as_py())
            counts.update(pieces)
            n += len(counts) - before
            chars += sum(map(len, pieces)) if len(counts) > before else 0
            if n > HELD_PIECES or chars > HELD_CHARS:
                yield from out()
                n = chars = 0
    yield from out()


def distinct_pieces(docs: DataFrame, lang: str | None = "lang") -> DataFrame:
    """(lang, piece, m): the different pieces of each language and how often each occurs."""
    tag = F.coalesce(F.col(lang).cast("string"), F.lit(NO_LANG)) if lang else F.lit(NO_LANG)
    rows = common.spread(docs.select(tag.alias("lang"), F.col("text").alias("text")))
    out = rows.mapInArrow(_distinct_pieces, "lang string, piece string, m long")
    return out.groupBy("lang", "piece").agg(F.sum("m").alias("m"))


def _counted(batches: Iterator[pa.RecordBatch], schema: pa.Schema, sql: list[str], rows: int) -> Iterator[pa.RecordBatch]:
    """The rows of the last of some SQL statements over the relation ``rows``; duckdb spills to a folder that ends with the task."""
    import duckdb

    with tempfile.TemporaryDirectory(prefix="spill-") as folder:
        con = duckdb.connect(":memory:", config={"memory_limit": MEMORY, "threads": "1", "temp_directory": folder, "preserve_insertion_order": "false"})
        try:
            con.register("rows", pa.RecordBatchReader.from_batches(schema, (b.cast(schema) for b in batches if b.num_rows)))
            for statement in sql[:-1]:
                con.execute(statement)
            yield from con.sql(sql[-1]).to_arrow_reader(rows)
        finally:
            con.close()


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Compressed blocks of rows (bucket, lang, words, phrase, f), one for each bucket of a batch: its languages
    and their numbers of phrases, the sorted phrases by line, and the bytes of their counts."""
    for batch in batches:
        batch = batch.take(pc.sort_indices(batch, sort_keys=[(c, "ascending") for c in ("bucket", "lang", "phrase")]))
        bucket, f = batch.column("bucket").to_numpy(), batch.column("f").to_numpy()
        lang = batch.column("lang").dictionary_encode()
        of, names = lang.indices.to_numpy(), lang.dictionary.to_pylist()
        phrases, out = batch.column("phrase").cast(pa.string()), []
        cuts = [0, *(np.flatnonzero(np.diff(bucket)) + 1).tolist(), batch.num_rows]
        for i, j in zip(cuts, cuts[1:]):
            text = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, j - i], pa.int32()), phrases[i:j]), "\n")[0].as_buffer()
            counts = np.ascontiguousarray(f[i:j].astype("<i8").view(np.uint8).reshape(-1, 8).T).tobytes()
            turns = np.flatnonzero(np.diff(of[i:j], prepend=-1))
            own = [names[k] for k in of[i:j][turns].tolist()]
            out.append((int(bucket[i]), own, np.diff(turns, append=j - i).tolist(), text.size, pa.compress(text, "zstd", asbytes=True), pa.compress(counts, "zstd", asbytes=True)))
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), _BLOCK.types)], schema=_BLOCK)


def _opened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The counts in compressed blocks."""
    for batch in batches:
        for r in batch.to_pylist():
            n = sum(r["numbers"])
            phrases = pa.array(pa.decompress(r["phrases"], r["size"], "zstd", asbytes=True).decode().split("\n"), pa.string())
            f = np.frombuffer(pa.decompress(r["f"], 8 * n, "zstd", asbytes=True), np.uint8).reshape(8, n).T
            langs = pa.array(r["langs"], pa.string()).take(pa.array(np.repeat(np.arange(len(r["langs"])), r["numbers"])))
            words = pc.add(pc.count_substring(phrases, " "), pa.scalar(1, pa.int32()))
            yield pa.RecordBatch.from_arrays([langs, words, phrases, pa.array(np.ascontiguousarray(f).view("<i8").ravel())], schema=_COUNT)


def _ngram_sql(longest: int) -> list[str]:
    """Statements that count the n-grams of pieces: all of the greatest length at once, shorter ones from those.

    A piece's last words count as n-grams of the greatest length with nothing behind them.
    """
    names = [f"w{i}" for i in range(longest)]
    words = ", ".join(f"unnest(ws[{i + 1}:]) AS w{i}" for i in range(longest))
    grams = f"SELECT lang, {words}, m FROM (SELECT lang, string_split(piece, ' ') AS ws, m FROM rows)"
    sums = [f"CREATE TABLE g{longest} AS SELECT lang, {', '.join(names)}, sum(m) AS f FROM ({grams}) GROUP BY ALL"]
    for k in range(longest - 1, 0, -1):
        some = ", ".join(names[:k])
        sums.append(f"CREATE TABLE g{k} AS SELECT lang, {some}, sum(f) AS f FROM g{k + 1} GROUP BY ALL")
    parts = [f"SELECT lang, {k}::INTEGER AS words, concat_ws(' ', {', '.join(names[:k])}) AS phrase, f::BIGINT AS f FROM g{k} WHERE w{k - 1} IS NOT NULL" for k in range(1, longest + 1)]
    return [*sums, " UNION ALL ".join(parts)]


def _sum_sql(least: int) -> list[str]:
    """Statements that add up counts: of n-grams with the least count, and of all words together (0 words)."""
    return [
        "CREATE TABLE s AS SELECT lang, words, phrase, sum(f) AS f FROM rows GROUP BY ALL",
        f"SELECT lang, words, phrase, f::BIGINT AS f FROM s WHERE f >= {least} UNION ALL SELECT lang, 0::INTEGER, '', sum(f)::BIGINT FROM s WHERE words = 1 GROUP BY lang",
    ]


def phrase_counts(pieces: DataFrame, longest: int = MAX_WORDS, least: int = LEAST) -> DataFrame:
    """(lang, words, phrase, f): n-grams of up to ``longest`` words that occur ``least`` times, overlaps included.

    Rows of 0 words, one or more for each language, add up to its number of words.
    """
    buckets = max(int(pieces.sparkSession.conf.get("spark.sql.shuffle.partitions")), pieces.sparkSession.sparkContext.defaultParallelism)
    *tables, last = _ngram_sql(longest)
    sql = [*tables, f"SELECT (hash(lang, phrase) % {buckets})::INTEGER AS bucket, * FROM ({last})"]
    blocks = pieces.mapInArrow(
        lambda batches: _blocks(_counted(batches, _PIECE, sql, SORTED)),
        "bucket int, langs array<string>, numbers array<int>, size int, phrases binary, f binary",
    )
    return blocks.repartitionById(buckets, "bucket").mapInArrow(
        lambda batches: (b.cast(_COUNT) for b in _counted(_opened(batches), _COUNT, _sum_sql(least), BATCH)),
        "lang string, words int, phrase string, f long",
    )


def scored(counts: DataFrame, longest: int = MAX_WORDS) -> DataFrame:
    """(lang, phrase, words, a, l, r, score) of all candidates: the cut of the least score, ties to the first.

    Every cut sends requests for its two parts, which meet their counts by (lang, part). Products are
    decimals of 38 digits.
    """
    grams = counts.where("words > 0")
    cands = grams.where("words > 1").select("lang", "phrase", "words", F.col("f").alias("a"), F.split("phrase", " ").alias("w"))
    cuts = cands.select("*", F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k"))
    requests = cuts.select("lang", "phrase", "words", "a", "k", F.array_join(F.slice("w", F.lit(1), F.col("k")), " ").alias("_first"), F.array_join(F.slice("w", F.col("k") + 1, F.col("words") - F.col("k")), " ").alias("_rest"))
    known = grams.where(F.col("words") < longest)
    for part, name in (("_first", "l"), ("_rest", "r")):
        requests = requests.join(known.select("lang", F.col("phrase").alias(part), F.col("f").alias(name)), ["lang", part])
    a, l, r = (F.col(c).cast("decimal(15,0)") for c in "alr")
    cut = F.struct(F.call_function("div", a * a * F.lit(SCALE).cast("decimal(7,0)"), l * r).alias("score"), "k", "l", "r")
    best = requests.groupBy("lang", "phrase", "words", "a").agg(F.min(cut).alias("c"))
    return best.select("lang", "phrase", "words", "a", "c.l", "c.r", "c.score")


def inside_longer(cands: DataFrame, longest: int = MAX_WORDS) -> DataFrame:
    """(lang, phrase, most): for phrases inside longer candidates, the longer ones' greatest count."""
    w = F.split("phrase", " ")
    spans = [(i, n) for n in range(2, longest) for i in range(longest - n + 1)]
    if not spans:
        return cands.select("lang", "phrase", F.col("a").alias("most")).where(F.lit(False))
    inner = F.array(*(F.when(F.col("words") >= F.lit(max(n + 1, i + n)), F.array_join(F.slice(w, i + 1, n), " ")) for i, n in spans))
    rows = cands.where("words > 2").select("lang", "a", F.explode(inner).alias("phrase")).where("phrase is not null")
    return rows.groupBy("lang", "phrase").agg(F.max("a").alias("most"))


def mine(docs: DataFrame, lang: str | None = "lang", least: int = LEAST, longest: int = MAX_WORDS, top: int | None = TOP) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the ``top`` phrases of each language, or all with None.

    ``docs`` has text and a language column (None: one language). A phrase has 2 to ``longest`` words and
    count a >= ``least``; its score is floor(1000000 a a / (l r)) at its weakest cut into parts with
    counts l and r, n counts all words of the language. Phrases mostly inside a longer one are left out.
    Null texts are empty, null languages ``und``; ids do not matter and repeated rows count each; texts may
    be of any length. An empty table gives no rows.
    """
    counts = common.written(phrase_counts(distinct_pieces(docs, lang), longest, least), "phrase-counts")
    cands = common.written(scored(counts, longest), "phrases")
    totals = counts.where("words = 0").groupBy("lang").agg(F.sum("f").alias("n"))  # a row for each language
    kept = cands.join(inside_longer(cands, longest), ["lang", "phrase"], "left")
    kept = kept.where(F.col("most").isNull() | (F.lit(100) * F.col("most") < F.lit(INSIDE) * F.col("a")))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), F.asc("phrase"))
    ranked = kept.select("lang", F.row_number().over(order).cast("long").alias("rank"), "phrase", "a", "l", "r", "score")
    if top:
        ranked = ranked.where(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
