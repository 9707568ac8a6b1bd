"""Small helpers for the text classifiers: words and sampled training rows."""

from __future__ import annotations

import re
import sys
import unicodedata

from pyspark.sql import DataFrame
from pyspark.sql import functions as F



def _ranges(kinds: str) -> str:
    """The characters of some general categories (by their first letters) as the inside of a character class."""
    out, first = [], None
    for i in range(sys.maxunicode + 2):
        inside = i <= sys.maxunicode and unicodedata.category(chr(i))[0] in kinds
        if inside and first is None:
            first = i
        elif not inside and first is not None:
            out.append(f"\\U{first:08x}-\\U{i - 1:08x}")
            first = None
    return "".join(out)


#: A letter, and letters and the marks on them; the same for lower-cased texts of ASCII and of Latin-1 (which has no marks).
WORDS = re.compile(f"[{_ranges('L')}][{_ranges('LM')}]*")
ASCII_WORDS = re.compile("[a-z]+")
LATIN_WORDS = re.compile("[a-zªµºß-öø-ÿ]+")


def words_of(text: str | None) -> list[str]:
    """Runs of letters with their marks, lower-cased; signs for numbers are no letters."""
    if not text:
        return []
    text = text.lower()
    if text.isascii():
        return ASCII_WORDS.findall(text)
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return WORDS.findall(text)
    return LATIN_WORDS.findall(text)


def training_rows(docs: DataFrame, sample: DataFrame, label: str) -> DataFrame:
    """doc_id, label and text of the sampled ids; the sample is small by construction."""
    s = F.broadcast(sample.select(F.col("doc_id"), F.col(label).alias("_label")))
    return docs.select("doc_id", "text").join(s, "doc_id").select("doc_id", F.col("_label").alias(label), "text")
