"""Query expansion over a lexical graph: word, its senses, their lemmas, a related form of each.

The graph is three tables of the caller:
``senses`` (word, synset), ``lemmas`` (synset, lemma) and ``related`` (synset, lemma, form, position); a form
belongs to a lemma in one of its senses. The hops are taken for the distinct words of all queries, so a
word that many queries have is followed once, and the paths meet the queries last.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from termforge.functions import analysis, porter

#: Letters that a family of words shares, in a graph made from a vocabulary.
FAMILY = 5


def first_forms(related: DataFrame) -> DataFrame:
    """(synset, lemma, form): of each lemma in a sense the form with the smallest position, ties by name."""
    first = F.min(F.struct("position", "form")).alias("f")
    return related.where("form is not null").groupBy("synset", "lemma").agg(first).select("synset", "lemma", "f.form")


def paths(words: DataFrame, senses: DataFrame, lemmas: DataFrame, related: DataFrame) -> DataFrame:
    """(term, form) of distinct ``words`` (term): the first related form of every lemma of every sense."""
    hop = words.join(senses.select(F.col("word").alias("term"), "synset").distinct(), "term")
    hop = hop.join(lemmas.select("synset", "lemma").distinct(), "synset")
    return hop.join(first_forms(related), ["synset", "lemma"]).select("term", F.lower("form").alias("form")).distinct()


def expand(
    queries: DataFrame,
    senses: DataFrame,
    lemmas: DataFrame,
    related: DataFrame,
    stop_words: list[str],
    dictionary: DataFrame | None = None,
    stem: bool = True,
) -> DataFrame:
    """(query_id, term, derived): alphabetic words of the queries that are no stop words, and their related forms.

    With ``stem`` words and forms are stemmed, once, as terms of stemmed indexes are. A term counts once for a
    query; ``derived`` tells that only forms gave it. With ``dictionary`` (term) terms that the index does not have
    are left out. Null queries have no terms; words without a sense, lemmas without a form and dangling
    references end a path; repeated rows of the graph do not matter.
    """
    rows = analysis.exploded(queries.where(F.col("query").isNotNull()).select("query_id", "query"), "query", keep=analysis.ALPHA)
    own = analysis.without_words(rows, ["and", *stop_words]).distinct()
    found = paths(own.select("term").distinct(), senses, lemmas, related)
    if stem:
        found = porter.stemmed(found, "form").distinct()
    forms = own.join(found, "term").select("query_id", F.col("form").alias("term"), F.lit(True).alias("derived"))
    kept = (porter.stemmed(own) if stem else own).select("query_id", "term", F.lit(False).alias("derived"))
    out = kept.unionAll(forms).groupBy("query_id", "term").agg(F.min("derived").alias("derived"))
    return out if dictionary is None else out.join(dictionary.select("term").distinct(), "term", "left_semi").select("query_id", "term", "derived")


def graph_of(vocabulary: DataFrame, letters: int = FAMILY) -> tuple[DataFrame, DataFrame, DataFrame]:
    """A lexical graph of a vocabulary (term, df) alone, where there is no lexicon at hand.

    Alphabetic words that begin with the same ``letters`` letters and are longer are a family; words of one stem are
    the lemmas of a sense, which is named by family and stem; and a lemma's related form is the family's most frequent word of another
    stem, ties by name. A family's two most frequent stems answer for all of its words, so no pairs are made.
    """
    words = vocabulary.where(F.col("term").rlike(analysis.ALPHA) & (F.length("term") > letters)).select("term", "df")
    words = words.join(porter.stems(words.select("term")), "term").withColumn("family", F.substring("term", 1, letters))
    senses = words.select(F.col("term").alias("word"), F.concat_ws("/", "family", "stem").alias("synset"))
    lemmas = senses.select("synset", F.col("word").alias("lemma"))
    best = words.groupBy("family", "stem").agg(F.min(F.struct((-F.col("df")).alias("d"), "term")).alias("b"))
    order = Window.partitionBy("family").orderBy("b.d", "b.term")
    two = best.select("family", "stem", F.col("b.term").alias("form"), F.row_number().over(order).alias("position")).where("position <= 2")
    other = words.join(two.withColumnRenamed("stem", "_stem"), "family").where("stem <> _stem")
    related = other.select(F.concat_ws("/", "family", "stem").alias("synset"), F.col("term").alias("lemma"), "form", "position")
    return senses, lemmas, related
