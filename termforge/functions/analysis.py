"""Analysers as Column expressions: tokens, filters, folding and character n-grams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A word with inner hyphens, apostrophes, points and commas, or one other visible character.
TOKEN = r"[\p{L}\p{N}]+(?:[-'.,][\p{L}\p{N}]+)*|[^\s\p{L}\p{N}]"
ALNUM = r"^[\p{L}\p{N}]+$"
ALPHA = r"^\p{L}+$"
SENTENCE_END = r"(?<=[.!?])\s+"


def sentences(text: Column) -> Column:
    return F.split(text, SENTENCE_END)


def tokens(text: Column) -> Column:
    """All tokens of a text in order; null counts as empty."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(TOKEN), F.lit(0))


def exploded(df: DataFrame, text: str, term: str = "term", keep: str | None = ALNUM, position: str | None = None) -> DataFrame:
    """One row per token of ``text``, lower-cased, with the other columns; ``keep`` filters whole tokens.

    The explode is an outer one, since for an inner one the optimizer would tokenise twice to test
    whether there are tokens.
    """
    rest = [c for c in df.columns if c != text]
    if position:
        out = df.select(*rest, F.posexplode_outer(tokens(F.col(text))).alias(position, term))
    else:
        out = df.select(*rest, F.explode_outer(tokens(F.col(text))).alias(term))
    out = out.where(F.col(term).isNotNull())
    if keep:
        out = out.where(F.col(term).rlike(keep))
    return out.withColumn(term, F.lower(term))


def without_words(df: DataFrame, words: list[str], term: str = "term") -> DataFrame:
    """Rows whose term is none of a short list (stop words, operator words)."""
    return df.where(~F.col(term).isin(words)) if words else df


def char_ngrams(text: Column, n: int) -> Column:
    """Every window of n characters; spaces and punctuation included, nothing padded."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(f"(?s)(?=(.{{{n}}}))"), F.lit(1))
