"""Treebank words: an ordered chain of rewrites that parts marks, quotes, clitics and contractions from words.

A point is parted from its word only at the end of a sentence, so the chain works on chunks (what blanks
part) and is told which of them end one. Inner points, commas in numbers and hyphens stay.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from termforge.functions import sentences

#: Fixed values, after the Penn Treebank's conventions: words that are written as one and are two.
CONTRACTIONS = [("can", "not"), ("d", "'ye"), ("gim", "me"), ("gon", "na"), ("got", "ta"), ("lem", "me"), ("more", "'n"), ("wan", "na"), ("'t", "is"), ("'t", "was")]
PLAIN_CONTRACTIONS = "(?i)^(" + "|".join(a + b for a, b in CONTRACTIONS if "'" not in a + b) + ")$"
CLITICS = "'[sSmMdD]|'ll|'LL|'re|'RE|'ve|'VE|n't|N'T|'"

#: Rewrites before and after the point of a sentence's end, in order.
OPENING = [
    (r'^"', "`` "),
    (r'([(\[{<])"', "$1 `` "),
    (r"([:,])([^\d])", " $1 $2"),
    (r"[:,]$", " $0 "),
    (r"\.\.\.", " ... "),
    (r"[;@#$%&]", " $0 "),
]
END = (r"([^.])(\.)([\])}>\"']*)$", "$1 $2 $3")
CLOSING = [
    (r"[?!]", " $0 "),
    (r"[\]\[(){}<>]", " $0 "),
    (r"--", " -- "),
    (r'"', " '' "),
    (r"([^ '])('')( |$)", "$1 $2$3"),
    (rf"([^' ])({CLITICS})( |$)", "$1 $2$3"),
    *((rf"(?i)(^| )({a})({b})( |$)", "$1$2 $3$4") for a, b in CONTRACTIONS),
]


def words(chunk: Column, ends: Column) -> Column:
    """The words of a chunk; ``ends`` tells whether it ends a sentence."""
    whole = chunk
    for pattern, to in OPENING:
        chunk = F.regexp_replace(chunk, pattern, to)
    # one alternative of two arguments, so that the chain before stands in the expression once
    chunk = F.regexp_replace(chunk, F.when(ends, F.lit(END[0])).otherwise(F.lit("$^")), F.lit(END[1]))
    for pattern, to in CLOSING:
        chunk = F.regexp_replace(chunk, pattern, to)
    # letters and numbers alone are one word, unless they are a contraction: no rewrite fits them
    plain = whole.rlike("^[\\p{L}\\p{N}]+$") & ~whole.rlike(PLAIN_CONTRACTIONS)
    return F.when(plain, F.array(whole)).otherwise(F.filter(F.split(chunk, " +"), lambda x: x != ""))


def exploded(docs: DataFrame, abbreviated: DataFrame, starting: DataFrame, keep: str | None = None) -> DataFrame:
    """(doc_id, pos, term): the words of (doc_id, text) in lower case with the number of their chunk; ``keep`` filters whole words.

    ``abbreviated`` and ``starting`` are ``sentences.abbreviations`` and ``sentences.starters`` of the corpus; queries
    are told apart by those of the index.
    """
    rows = sentences.ends(docs, abbreviated, starting)
    out = rows.select("doc_id", "pos", F.explode_outer(words(F.col("chunk"), F.col("ends"))).alias("term")).where("term is not null")
    if keep:
        out = out.where(F.col("term").rlike(keep))
    return out.withColumn("term", F.lower("term"))
