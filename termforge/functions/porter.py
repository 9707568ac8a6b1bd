"""The Porter stemmer as a chain of projections over a vocabulary: the paper of 1980, or its usual extended form.

Each step is one CASE expression over ``s``. Apply it to distinct terms and join the result back.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from termforge.sources import scratch

C, V = "[^aeiou][^aeiouy]*", "[aeiouy][aeiou]*"
#: Up to the end of the first vowels; a y at the very beginning is a consonant.
FIRST = f"^({C}{V}|[aeiou]+)"
MEASURE_0 = f"{FIRST}{C}"
MEASURE_1 = f"{FIRST}{C}{V}{C}"
EXACTLY_1 = f"{FIRST}{C}({V})?$"
HAS_VOWEL = f"^({C}[aeiouy]|[aeiou])"
#: Consonant, vowel, consonant other than w, x, y; in the extended form also a vowel and a consonant alone.
SHORT = f"^{C}[aeiouy][^aeiouwxy]"
SHORT_EXTENDED = f"({SHORT}|^[aeiou][^aeiou])"

# Fixed values of the published algorithm: suffixes and their replacements.
STEP_2 = {
    "ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "abli": "able", "alli": "al", "entli": "ent",
    "eli": "e", "ousli": "ous", "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful",
    "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble",
}
STEP_3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
STEP_4 = (
    "al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ou", "ism", "ate", "iti", "ous", "ive", "ize",
)

# Fixed values of the extended form: further suffixes, and words with a stem of their own.
STEP_2_EXTENDED = {"bli": "ble", "fulli": "ful"}
IRREGULAR = {
    "cannings": "canning", "canning": "canning", "dying": "die", "exceed": "exceed", "howe": "howe", "innings": "inning", "inning": "inning",
    "lying": "lie", "news": "news", "outings": "outing", "outing": "outing", "proceed": "proceed", "skies": "sky", "sky": "sky",
    "succeed": "succeed", "tying": "tie",
}


def _has(test: str, text: str, pattern: str) -> str:
    return f"{test}({text}, '{pattern}')"


def _cut(n: int) -> str:
    return f"left(s, length(s) - {n})"


def _suffixes(test: str, rules: dict[str, str], measure: str) -> str:
    cases = [
        f"WHEN s LIKE '%{a}' THEN CASE WHEN {_has(test, _cut(len(a)), measure)} THEN concat({_cut(len(a))}, '{b}') ELSE s END"
        for a, b in sorted(rules.items(), key=lambda r: -len(r[0]))
    ]
    return f"CASE {' '.join(cases)} ELSE s END"


def steps(test: str, extended: bool = True) -> list[str]:
    """The expressions over ``s`` in order; ``test`` names the engine's regular-expression predicate."""
    doubled = "|".join(x * 2 for x in "bcdfghjkmnpqrtvwx")
    short = SHORT_EXTENDED if extended else SHORT
    step_2 = {k: v for k, v in STEP_2.items() if k != "abli"} | STEP_2_EXTENDED if extended else STEP_2
    step_4 = {a: "" for a in STEP_4}
    ion = f"WHEN s LIKE '%ion' THEN CASE WHEN {_has(test, _cut(3), '[st]$')} AND {_has(test, _cut(3), MEASURE_1)} THEN {_cut(3)} ELSE s END"
    ies = "WHEN s LIKE '%ies' AND length(s) = 4 THEN left(s, 3) " if extended else ""
    ied = f"WHEN s LIKE '%ied' THEN CASE WHEN length(s) = 4 THEN {_cut(1)} ELSE {_cut(2)} END " if extended else ""
    y = _has(test, _cut(1), ".[^aeiouy]$|[aeiou]y$") if extended else _has(test, _cut(1), HAS_VOWEL)
    logi = f"CASE WHEN s LIKE '%logi' THEN CASE WHEN {_has(test, _cut(3), MEASURE_0)} THEN {_cut(1)} ELSE s END "
    second = _suffixes(test, step_2, MEASURE_0)
    out = [
        f"CASE {ies}WHEN s LIKE '%sses' THEN {_cut(2)} WHEN s LIKE '%ies' THEN {_cut(2)} WHEN s LIKE '%ss' THEN s WHEN s LIKE '%s' THEN {_cut(1)} ELSE s END",
        # a tilde marks stems that the next step repairs
        f"CASE {ied}WHEN s LIKE '%eed' THEN CASE WHEN {_has(test, _cut(3), MEASURE_0)} THEN {_cut(1)} ELSE s END "
        f"WHEN s LIKE '%ed' AND {_has(test, _cut(2), HAS_VOWEL)} THEN concat({_cut(2)}, '~') "
        f"WHEN s LIKE '%ing' AND {_has(test, _cut(3), HAS_VOWEL)} THEN concat({_cut(3)}, '~') ELSE s END",
        f"CASE WHEN s NOT LIKE '%~' THEN s WHEN s LIKE '%at~' OR s LIKE '%bl~' OR s LIKE '%iz~' THEN concat({_cut(1)}, 'e') "
        f"WHEN {_has(test, 's', f'({doubled})~$')} THEN {_cut(2)} WHEN {_has(test, 's', short + '~$')} THEN concat({_cut(1)}, 'e') ELSE {_cut(1)} END",
        f"CASE WHEN s LIKE '%y' AND {y} THEN concat({_cut(1)}, 'i') ELSE s END",
        # -ally loses -ly before the other suffixes are looked for
        *([f"CASE WHEN s LIKE '%alli' AND {_has(test, _cut(4), MEASURE_0)} THEN {_cut(2)} ELSE s END"] if extended else []),
        second.replace("CASE ", logi, 1) if extended else second,
        _suffixes(test, STEP_3, MEASURE_0),
        _suffixes(test, step_4, MEASURE_1).replace("CASE ", f"CASE {ion} ", 1),
        f"CASE WHEN s LIKE '%e' AND ({_has(test, _cut(1), MEASURE_1)} OR ({_has(test, _cut(1), EXACTLY_1)} AND NOT {_has(test, _cut(1), short + '$')})) THEN {_cut(1)} ELSE s END",
        f"CASE WHEN s LIKE '%ll' AND {_has(test, 's', MEASURE_1)} THEN {_cut(1)} ELSE s END",
    ]
    return out


def _whole(term: str, extended: bool) -> str:
    own = " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in IRREGULAR.items())
    regular = f"CASE WHEN length({term}) <= 2 THEN {term} ELSE s END"
    return f"CASE {term} {own} ELSE {regular} END" if extended else regular


def stems(vocabulary: DataFrame, term: str = "term", extended: bool = True) -> DataFrame:
    """(term, stem) of a DataFrame of distinct terms in lower case; words of up to two letters stay."""
    return _chain(vocabulary.select(term), term, extended)


def _chain(rows: DataFrame, term: str, extended: bool, known: str | None = None) -> DataFrame:
    """``rows`` with a column stem; where column ``known`` has it already, the steps are not taken."""
    rest = [F.col(c) for c in rows.columns if c != known]
    told = F.col(known) if known else F.lit(None).cast("string")
    out = rows.select(*rest, told.alias("_told"), F.when(told.isNull(), F.col(term)).alias("s"))
    for e in steps("regexp_like", extended):
        out = out.select(*rest, "_told", F.expr(f"CASE WHEN _told IS NULL THEN {e} END").alias("s"))
    # a generated column stops filters on stems, which would multiply the expressions of all steps
    stem = F.coalesce("_told", F.expr(_whole(term, extended)))
    return out.select(*rest, F.explode_outer(F.array(stem)).alias("stem"))


#: Stems that are broadcast, those of the most frequent terms (some 80 bytes each).
STEMS = 500_000


def stemmed(df: DataFrame, term: str = "term", extended: bool = True, only: DataFrame | None = None) -> DataFrame:
    """``df`` with its terms stemmed: the vocabulary is stemmed once and broadcast, so that no rows are shuffled.

    Of a vocabulary of more than STEMS terms the most frequent are broadcast, and the rows of the others are stemmed
    where they lie. With ``only`` (term: stems, a small relation) rows of other stems are left out, and the terms of these stems alone are looked up.
    """
    df, rest = df.where(F.col(term).isNotNull()), [c for c in df.columns if c != term]
    if only is not None:
        found = stems(df.select(term).distinct(), term, extended)
        wanted = F.broadcast(only.select(F.col("term").alias("stem")).distinct())
        found = scratch.written(found.join(wanted, "stem", "left_semi"), "stems")
        found = F.broadcast(found) if found.count() <= STEMS else found
        return df.join(found, term).select(*rest, F.col("stem").alias(term))
    vocabulary = scratch.written(df.groupBy(term).agg(F.count("*").alias("total")), "vocabulary")
    least = scratch.frequent_from(vocabulary, STEMS)
    found = stems(vocabulary.where(F.col("total") >= least).select(term), term, extended)
    told = df.join(F.broadcast(found.withColumnRenamed("stem", "_known")), term, "left")
    return _chain(told, term, extended, "_known").select(*rest, F.col("stem").alias(term))


def stems_of(spark: SparkSession, words: list[str]) -> dict[str, str]:
    """The stems of a short list of words, such as a batch of queries holds."""
    if not words:
        return {}
    found = stems(spark.createDataFrame([(w,) for w in words], "term string"))
    return {r.term: r.stem for r in found.collect()}
