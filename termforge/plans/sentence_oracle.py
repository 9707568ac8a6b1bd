"""SQL for sentence ends and Treebank words, over ``documents``, as common table expressions.

Chunks are numbered rows here and a chunk's follower is the row behind it; likelihoods are written with
their counts, and the rewrites of a word are typed anew in RE2's dialect.
"""

from __future__ import annotations


def _xlog(n: str, p: str) -> str:
    return f"CASE WHEN {n} = 0 THEN 0.0 ELSE {n} * ln({p}) END"


CHUNKS = """chunks AS (SELECT doc_id, generate_subscripts(ws, 1) - 1 AS pos, unnest(ws) AS chunk FROM (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '\\s+'), lambda x: x <> '') AS ws FROM documents)),
bare AS (SELECT *, regexp_replace(regexp_replace(chunk, '["''”’)\\]}]+$', ''), '^["''“‘(\\[{]+', '') AS core,
  lead(chunk) OVER (PARTITION BY doc_id ORDER BY pos) AS next FROM chunks),
m AS (SELECT doc_id, pos, chunk, next, right(core, 1) = '.' AS dot, right(core, 1) IN ('!', '?') AS loud,
  lower(CASE WHEN right(core, 1) = '.' THEN left(core, length(core) - 1) ELSE rtrim(core, ',;:!?') END) AS word,
  lower(regexp_extract(chunk, '[\\p{L}\\p{N}]+')) AS own, regexp_extract(next, '[\\p{L}\\p{N}]+') AS after FROM bare)"""

ABBREVIATIONS = f"""wc AS (SELECT word, count(*) FILTER (dot) AS with_point, count(*) FILTER (NOT dot) AS without FROM m GROUP BY 1),
tot AS (SELECT CAST(sum(with_point + without) AS DOUBLE) AS n, CAST(sum(with_point) AS DOUBLE) AS points FROM wc),
ab0 AS (SELECT word, with_point, without, length(replace(word, '.', '')) AS letters, length(word) - length(replace(word, '.', '')) AS inner_points,
  with_point * ln(points / n) + {_xlog('without', '1 - points / n')} AS chance, with_point * ln(0.99) + without * ln(1 - 0.99) AS sure
  FROM wc, tot WHERE with_point > 0 AND regexp_matches(word, '\\p{{L}}')),
ab AS (SELECT * FROM (SELECT word, with_point, without, -2 * (chance - sure) * exp(-letters) * (inner_points + 1) * pow(letters, -without) AS score FROM ab0) WHERE score >= 0.3)"""

STARTERS = f"""sm AS (SELECT m.*, ab.word IS NOT NULL OR regexp_full_match(m.word, '\\p{{L}}') AS short FROM m LEFT JOIN ab USING (word)),
heads AS (SELECT lower(after) AS word, count(*) AS after_point FROM sm WHERE dot AND NOT short AND after <> '' GROUP BY 1),
times AS (SELECT own AS word, count(*) AS times FROM sm GROUP BY 1),
st0 AS (SELECT word, after_point, times, CAST(after_point AS DOUBLE) AS k, CAST(times AS DOUBLE) AS b,
  (SELECT CAST(count(*) AS DOUBLE) FROM sm) AS n, (SELECT CAST(sum(after_point) AS DOUBLE) FROM heads) AS a FROM heads JOIN times USING (word)),
st1 AS (SELECT *, {_xlog('b', 'b / n')} + {_xlog('(n - b)', '1 - b / n')} AS chance,
  {_xlog('k', 'k / a')} + {_xlog('(a - k)', '1 - k / a')} + {_xlog('(b - k)', '(b - k) / (n - a)')} + {_xlog('(n - a - b + k)', '1 - (b - k) / (n - a)')} AS apart FROM st0),
starting AS (SELECT word, after_point, times, -2 * (chance - apart) AS score FROM st1 WHERE -2 * (chance - apart) >= 30 AND k / b > a / n)"""

ENDS = """ended AS (SELECT doc_id, pos, chunk, next IS NULL OR loud OR (dot AND (NOT short OR (starting.word IS NOT NULL AND regexp_matches(after, '^\\p{Lu}')))) AS ends
  FROM sm LEFT JOIN starting ON starting.word = lower(after))"""

#: The rewrites up to the point, and those after it.
_FIRST = [
    ("^\"", "`` "),
    ("([(<{\\[])\"", "\\1 `` "),
    ("([,:])([^0-9])", " \\1 \\2"),
    ("[,:]$", " \\0 "),
    ("[.][.][.]", " ... "),
    ("[#$%&;@]", " \\0 "),
]
_LAST = [
    ("[!?]", " \\0 "),
    ("[(){}<>\\[\\]]", " \\0 "),
    ("--", " -- "),
    ("\"", " '' "),
    ("([^ '])('')( |$)", "\\1 \\2\\3"),
    ("([^ '])('s|'S|'m|'M|'d|'D|'ll|'LL|'re|'RE|'ve|'VE|n't|N'T|')( |$)", "\\1 \\2\\3"),
    *((f"(?i)(^| )({a})({b})( |$)", "\\1\\2 \\3\\4") for a, b in (("can", "not"), ("d", "'ye"), ("gim", "me"), ("gon", "na"), ("got", "ta"), ("lem", "me"), ("more", "'n"), ("wan", "na"), ("'t", "is"), ("'t", "was"))),
]


def _chain(x: str, rules: list[tuple[str, str]]) -> str:
    for pattern, to in rules:
        x = f"regexp_replace({x}, '{pattern.replace(chr(39), chr(39) * 2)}', '{to.replace(chr(39), chr(39) * 2)}', 'g')"
    return x


_PARTED = "CASE WHEN ends THEN regexp_replace(x, '([^.])([.])([)>}\"''\\]]*)$', '\\1 \\2 \\3') ELSE x END"
TREEBANK = f"""t0 AS (SELECT doc_id, pos, ends, {_chain('chunk', _FIRST)} AS x FROM ended),
t1 AS (SELECT doc_id, pos, {_PARTED} AS x FROM t0),
raw AS (SELECT doc_id, unnest(list_filter(string_split(x, ' '), lambda w: w <> '')) AS t FROM (SELECT doc_id, {_chain('x', _LAST)} AS x FROM t1))"""

LEARNED = f"{CHUNKS}, {ABBREVIATIONS}, {STARTERS}"
WORDS = f"{LEARNED}, {ENDS}, {TREEBANK}"
