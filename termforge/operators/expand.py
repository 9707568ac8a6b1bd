"""Query expansion from a supplied table of derivations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termforge.functions import analysis, porter


def expand(queries: DataFrame, derivations: DataFrame, stop_words: list[str], stem: bool = True) -> DataFrame:
    """(query_id, term): alphabetic, non-stop query terms and their derived forms, each once, stemmed on request.

    Terms are folded before the stop-word test.
    """
    rows = analysis.exploded(queries.where(F.col("query").isNotNull()).select("query_id", "query"), "query", keep=analysis.ALPHA, position="pos")
    own = analysis.without_words(rows, ["and", *stop_words]).select("query_id", "term")
    derived = own.join(F.broadcast(derivations), "term").select("query_id", F.col("derived").alias("term"))
    both = own.unionAll(derived)
    return (porter.stemmed(both).select("query_id", "term") if stem else both).distinct()
