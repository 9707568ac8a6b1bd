"""Language identification, words first and character n-grams for unseen words.

A known word scores its smoothed log frequency in each language. An unseen word falls back to its
longest character n-grams that are known at all: 5-grams, else 4-grams, down to single letters.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termforge.llm import common
from termforge.llm.textmodel import training_rows, words_of

#: At most so many training texts of each language.
TRAIN_PER_LANG = 3_000
LONGEST = 5
ADD = 0.5
#: The places of so many words, and so many numbers of back-off scores, are kept by a task.
CACHED, CACHED_NUMBERS = 100_000, 1 << 21
#: Different words of a text that are looked up at a time.
WORDS = 10_000
UNDETERMINED = "und"
#: Seed of Spark's xxhash64, which names words and n-grams in the model.
SEED = 42


@dataclass
class Model:
    """Log frequencies of words (kind 0) and n-grams (kind n) by language.

    A key is the hash of its kind and text. A key has the frequency ``default`` of its kind in each
    language it was not seen in, and ``more`` on top of it in those of its slice of ``langs_of``: so the
    model grows with what was seen, not with keys times languages, and none of it is left out.
    """

    langs: list[str] = field(default_factory=list)
    default: np.ndarray = field(default_factory=lambda: np.zeros((0, 0)))
    keys: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))
    ends: np.ndarray = field(default_factory=lambda: np.zeros(1, np.int64))
    langs_of: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int32))
    more: np.ndarray = field(default_factory=lambda: np.zeros(0))

    def rows_of(self, kind: int, texts: list[str]) -> np.ndarray:
        """The rows of some words or n-grams, -1 where there is none."""
        if not len(self.keys) or not texts:
            return np.full(len(texts), -1)
        digit = str(kind)
        h = np.array([xxhash.xxh64_intdigest(digit + x, SEED) for x in texts], np.uint64)
        at = np.minimum(np.searchsorted(self.keys, h), len(self.keys) - 1)
        return np.where(self.keys[at] == h, at, -1)

    def _entries(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """How many languages have seen each row, and the places of all their entries."""
        n = self.ends[rows + 1] - self.ends[rows]
        return n, np.arange(n.sum()) + np.repeat(self.ends[rows] - (np.cumsum(n) - n), n)

    def total(self, kind: int, rows: np.ndarray, times: np.ndarray) -> np.ndarray:
        """Log frequencies by language, summed over rows of a kind."""
        n, at = self._entries(rows)
        own = np.bincount(self.langs_of[at], self.more[at] * np.repeat(times, n), len(self.langs))
        return self.default[kind] * times.sum() + own

    def backed_off(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """By unseen word the mean log frequencies of its longest n-grams that are known, and whether any is; 0 if none is."""
        size = len(self.langs)
        out, found, left = np.zeros((len(words), size)), np.zeros(len(words), bool), range(len(words))
        for n in range(len(self.default) - 1, 0, -1):
            # the marks of beginning and end alone say nothing
            wholes = [(i, f"<{words[i]}>" if n > 1 else words[i]) for i in left]
            grams = [(i, x[k : k + n]) for i, x in wholes for k in range(len(x) - n + 1)]
            rows = self.rows_of(n, [g for _, g in grams])
            of = np.array([i for i, _ in grams], np.int64)[rows >= 0]
            rows = rows[rows >= 0]
            entries, at = self._entries(rows)
            sums = np.bincount(np.repeat(of, entries) * size + self.langs_of[at], self.more[at], len(words) * size)
            times = np.bincount(of, minlength=len(words))
            hit = times > 0
            out[hit] = self.default[n] + sums.reshape(-1, size)[hit] / times[hit, None]
            found |= hit
            left = [i for i in left if not hit[i]]
            if not left:
                break
        return out, found

    def word(self, w: str) -> np.ndarray | None:
        """A word's log frequencies by language, its back-off if it is unseen; None if nothing of it is known."""
        (r,) = self.rows_of(0, [w])
        if r >= 0:
            return self.total(0, np.array([r]), np.ones(1))
        (score,), (found,) = self.backed_off([w])
        return score if found else None


class Scorer:
    """Predicts by a model; remembers where recent words are in it, and the back-off scores of those that are not."""

    def __init__(self, model: Model):
        self.model = model
        self.most = max(1, min(CACHED, CACHED_NUMBERS // max(1, len(model.langs))))
        self.scores = np.empty((self.most, len(model.langs)))
        self.places: dict[str, int] = {}  # row of the model, or -1 - row of scores
        self.unseen = 0

    def places_of(self, names: list[str]) -> np.ndarray:
        """The places of at most ``most`` words."""
        out = list(map(self.places.get, names))
        new = [i for i, x in enumerate(out) if x is None]
        if len(self.places) + len(new) > self.most:
            self.places.clear()
            self.unseen, new = 0, list(range(len(names)))
        rows = self.model.rows_of(0, [names[i] for i in new])
        unseen = np.flatnonzero(rows < 0)
        if len(unseen):
            end = self.unseen + len(unseen)
            self.scores[self.unseen : end] = self.model.backed_off([names[new[j]] for j in unseen.tolist()])[0]
            rows[unseen] = -1 - np.arange(self.unseen, end)
            self.unseen = end
        for i, r in zip(new, rows.tolist()):
            self.places[names[i]] = out[i] = r
        return np.array(out)

    def predict(self, text: str | None) -> tuple[str, float]:
        """(language, share of the posterior). No letter at all gives ``und`` with 0."""
        counts = Counter(words_of(text))
        if not counts or not self.model.langs:
            return UNDETERMINED, 0.0
        total, names, times = np.zeros(len(self.model.langs)), list(counts), np.fromiter(counts.values(), float, len(counts))
        step = min(self.most, WORDS)
        for at in range(0, len(names), step):
            part, n = self.places_of(names[at : at + step]), times[at : at + step]
            known = part >= 0
            total += self.model.total(0, part[known], n[known])
            total += n[~known] @ self.scores[-1 - part[~known]]
        best = int(np.argmax(total))
        return self.model.langs[best], float(1 / np.exp(total - total[best]).sum())


def fit(docs: DataFrame, per_lang: int = TRAIN_PER_LANG, longest: int = LONGEST) -> Model:
    """Learn from documents with a language outside the held-out fold (crc32 of the id mod 3 is 1).

    Of a repeated id the first language counts, for the texts of all its rows. The driver gets hashes and counts of the sample's words and n-grams, all of them.
    """
    known = docs.where(
        F.col("lang").isNotNull() & F.col("text").isNotNull() & (common.fold_remainder(F.col("doc_id"), 3) != 1)
    )
    sample = common.class_sample(known.groupBy("doc_id").agg(F.min("lang").alias("lang")), "lang", per_lang)
    texts = training_rows(known, sample, "lang")

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[tuple[str, str]] = Counter()
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                for w, n in Counter(words_of(text.as_py())).items():
                    counts[lang, w] += n
        keys = list(counts)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([k[0] for k in keys], pa.string()),
                pa.array([k[1] for k in keys], pa.string()),
                pa.array(list(counts.values()), pa.int64()),
            ],
            names=["lang", "word", "n"],
        )

    counted = texts.select("lang", "text").mapInArrow(common.trimmed(tally), "lang string, word string, n long")
    counted = common.written(counted.groupBy("lang", "word").agg(F.sum("n").alias("n")), "lang-words")
    langs = sorted(r[0] for r in counted.select("lang").distinct().collect())
    if not langs:
        return Model()
    # a word seen once tells little and leaves unseen words to the n-grams, as in new texts
    words = counted.where("n > 1").select("lang", F.lit(0).alias("kind"), F.col("word").alias("key"), "n")
    padded = F.concat(F.lit("<"), "word", F.lit(">"))

    def of_length(n: int):
        one = lambda i: F.struct(F.lit(n).alias("kind"), F.col("padded").substr(i, F.lit(n)).alias("key"))
        none = F.array().cast("array<struct<kind:int,key:string>>")
        return F.when(F.length("padded") >= n, F.transform(F.sequence(F.lit(1), F.length("padded") - n + 1), one)).otherwise(none)

    # words count once each: frequent words are in the table already
    grams = counted.select("lang", padded.alias("padded")).select("lang", F.explode(F.flatten(F.array(*map(of_length, range(1, longest + 1))))).alias("g"))
    grams = grams.select("lang", "g.kind", "g.key").groupBy("lang", "kind", "key").agg(F.count("*").alias("n"))
    seen = words.unionAll(grams).select("kind", F.xxhash64(F.concat(F.col("kind").cast("string"), "key")).alias("h"), "lang", "n").toArrow()
    return _model(langs, longest, seen)


def _model(langs: list[str], longest: int, seen: pa.Table) -> Model:
    """The model of rows (kind, h, lang, n)."""
    kind, n = (seen.column(c).to_numpy() for c in ("kind", "n"))
    h = seen.column("h").to_numpy().astype(np.int64).view(np.uint64)
    lang = np.searchsorted(np.array(langs, object), np.array(seen.column("lang").to_pylist(), object))
    order = np.lexsort((lang, h))
    kind, n, h, lang = kind[order], n[order].astype(float), h[order], lang[order]
    first = np.flatnonzero(np.diff(h, prepend=~h[:1])) if len(h) else np.zeros(0, np.int64)
    default = np.zeros((longest + 1, len(langs)))
    for k in range(longest + 1):
        size = np.bincount(lang[kind == k], n[kind == k], len(langs)) + ADD * ((kind[first] == k).sum() + 1)
        default[k] = np.log(ADD / size)
    return Model(langs, default, h[first], np.append(first, len(h)).astype(np.int64), lang.astype(np.int32), np.log((n + ADD) / ADD))


def identify(docs: DataFrame, model: Model, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, lang_pred, score of every text, and the columns of ``keep``.

    Null texts and texts without a letter are ``und`` with score 0. Ties go to the language first
    in alphabetical order. Rows are judged one by one: repeated rows and null ids are ordinary, and very
    long texts are judged whole. Ids are whole numbers, or text of whole numbers. Columns of ``keep`` must
    not be called doc_id, lang_pred, score or _text; other columns, whatever their names, are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("struct<lang_pred:string,score:double>")
    def judged(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        scorer = Scorer(shared.value)
        for batch in texts:
            found = [scorer.predict(t.as_py()) for t in batch]
            yield pa.StructArray.from_arrays([pa.array([x for x, _ in found], pa.string()), pa.array([p for _, p in found], pa.float64())], names=["lang_pred", "score"])
        del scorer
        common.give_back()

    # only texts go to the Python workers, the columns to keep stay where they are
    source = common.spread(docs.select(F.col("doc_id").cast("long"), F.col("text").alias("_text"), *keep))
    out = source.select("doc_id", judged("_text").alias("_judged"), *keep)
    return out.select("doc_id", "_judged.lang_pred", "_judged.score", *keep)
