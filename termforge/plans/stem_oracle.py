"""The extended Porter stemmer as SQL of its own: suffix rules in tables, measures counted in vowel patterns.

Only the oracles use it. It shares neither expressions nor tables with ``functions.porter``.
"""

from __future__ import annotations

#: (suffix, what takes its place, least measure of the stem) by step, as in the published description.
RULES = {
    "b": [("sses", "ss", 0), ("ies", "i", 0), ("ss", "ss", 0), ("s", "", 0)],
    "ally": [("alli", "al", 1)],
    "two": [
        ("ational", "ate", 1), ("tional", "tion", 1), ("enci", "ence", 1), ("anci", "ance", 1), ("izer", "ize", 1), ("bli", "ble", 1), ("alli", "al", 1),
        ("entli", "ent", 1), ("eli", "e", 1), ("ousli", "ous", 1), ("ization", "ize", 1), ("ation", "ate", 1), ("ator", "ate", 1), ("alism", "al", 1),
        ("iveness", "ive", 1), ("fulness", "ful", 1), ("ousness", "ous", 1), ("aliti", "al", 1), ("iviti", "ive", 1), ("biliti", "ble", 1), ("fulli", "ful", 1),
    ],
    "three": [("icate", "ic", 1), ("ative", "", 1), ("alize", "al", 1), ("iciti", "ic", 1), ("ical", "ic", 1), ("ful", "", 1), ("ness", "", 1)],
    "four": [
        (x, "", 2)
        for x in "al ance ence er ic able ible ant ement ment ent ou ism ate iti ous ive ize".split()
    ],
}
OWN = "skies sky,sky sky,dying die,lying lie,tying tie,news news,innings inning,inning inning,outings outing,outing outing,cannings canning,canning canning,howe howe,proceed proceed,exceed exceed,succeed succeed"


def _pattern(x: str) -> str:
    """Vowels as V and consonants as C; y is a consonant at the beginning and after a vowel."""
    return f"regexp_replace(regexp_replace(regexp_replace({x}, '(^|[aeiou])y', '\\1C', 'g'), '[aeiouy]', 'V', 'g'), '[^V]', 'C', 'g')"


def _measure(x: str) -> str:
    return f"len(regexp_extract_all({_pattern(x)}, 'V+C+'))"


def _closed(x: str) -> str:
    """Whether a stem ends in consonant, vowel and a consonant other than w, x, y, or is a vowel and a consonant."""
    return f"(regexp_matches({_pattern(x)}, 'CVC$') AND NOT regexp_matches({x}, '[wxy]$') OR {_pattern(x)} = 'VC')"


def _less(n: int, s: str = "s") -> str:
    return f"substring({s}, 1, length({s}) - {n})"


def _by_rules(source: str, step: str) -> str:
    """The longest suffix that a word has decides alone."""
    rules = ", ".join(f"('{a}', '{b}', {m})" for a, b, m in RULES[step])
    stem = "substring(v.s, 1, length(v.s) - length(r.suffix))"
    return f"""SELECT v.term, coalesce(arg_max(CASE WHEN {_measure(stem)} >= r.least THEN {stem} || r.instead ELSE v.s END, length(r.suffix)), any_value(v.s)) AS s
  FROM {source} v LEFT JOIN (VALUES {rules}) r(suffix, instead, least) ON ends_with(v.s, r.suffix) GROUP BY v.term"""


def stem_sql(source: str) -> str:
    """A query of (term, stem) over a relation of distinct terms."""
    own = ", ".join(f"('{a}', '{b}')" for a, b in (x.split() for x in OWN.split(",")))
    vowel = lambda x: f"contains({_pattern(x)}, 'V')"
    return f"""WITH w0 AS (SELECT term, term AS s FROM {source}),
w1a AS ({_by_rules("w0", "b")}),
w1 AS (SELECT term, CASE WHEN length(term) = 4 AND ends_with(term, 'ies') THEN substring(term, 1, 3) ELSE s END AS s FROM w1a),
w2a AS (SELECT term, s, CASE WHEN ends_with(s, 'ied') OR ends_with(s, 'eed') THEN NULL WHEN ends_with(s, 'ed') AND {vowel(_less(2))} THEN {_less(2)}
  WHEN ends_with(s, 'ing') AND {vowel(_less(3))} THEN {_less(3)} END AS x FROM w1),
w2 AS (SELECT term, CASE
  WHEN ends_with(s, 'ied') THEN {_less(1)[:-1]} - CASE WHEN length(s) = 4 THEN 0 ELSE 1 END)
  WHEN ends_with(s, 'eed') THEN CASE WHEN {_measure(_less(3))} > 0 THEN {_less(1)} ELSE s END
  WHEN x IS NULL THEN s
  WHEN ends_with(x, 'at') OR ends_with(x, 'bl') OR ends_with(x, 'iz') THEN x || 'e'
  WHEN length(x) > 1 AND right(x, 1) = substring(x, length(x) - 1, 1) AND contains('bcdfghjkmnpqrtvwx', right(x, 1)) THEN {_less(1, "x")}
  WHEN {_measure("x")} = 1 AND {_closed("x")} THEN x || 'e' ELSE x END AS s FROM w2a),
w3 AS (SELECT term, CASE WHEN ends_with(s, 'y') AND length(s) > 2 AND right({_pattern(_less(1))}, 1) = 'C' THEN {_less(1)} || 'i' ELSE s END AS s FROM w2),
w4 AS ({_by_rules("w3", "ally")}),
w5a AS ({_by_rules("w4", "two")}),
w5 AS (SELECT term, CASE WHEN ends_with(w4.s, 'logi') AND {_measure(_less(3, "w4.s"))} > 0 THEN {_less(1, "w4.s")} ELSE w5a.s END AS s FROM w5a JOIN w4 USING (term)),
w6 AS ({_by_rules("w5", "three")}),
w7a AS ({_by_rules("w6", "four")}),
w7 AS (SELECT term, CASE WHEN ends_with(w6.s, 'sion') OR ends_with(w6.s, 'tion') THEN CASE WHEN {_measure(_less(3, "w6.s"))} > 1 THEN {_less(3, "w6.s")} ELSE w6.s END
  ELSE w7a.s END AS s FROM w7a JOIN w6 USING (term)),
w8 AS (SELECT term, CASE WHEN ends_with(s, 'e') AND ({_measure(_less(1))} > 1 OR {_measure(_less(1))} = 1 AND NOT {_closed(_less(1))}) THEN {_less(1)} ELSE s END AS s FROM w7),
w9 AS (SELECT term, CASE WHEN ends_with(s, 'll') AND {_measure(_less(1))} > 1 THEN {_less(1)} ELSE s END AS s FROM w8)
SELECT term, coalesce(o.stem, CASE WHEN length(term) <= 2 THEN term ELSE s END) AS stem FROM w9 LEFT JOIN (VALUES {own}) o(term, stem) USING (term)"""
