"""The registered query of each operator and, where SQL can express it, its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from termforge.llm import collocations, coverdedup, decontam, hardneg, htmlmain, jaccard, langid, licences, packing, quality, sharding, toxicity, urls
from termforge.llm.common import fold_remainder, table


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge_urls(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = quality.rate(docs, quality.fit(docs, table(spark, sf_dir, "labels")))
    return found.select(
        "doc_id",
        (fold_remainder(F.col("doc_id"), 5) == 0).alias("held_out"),
        "score",
        (F.col("score") >= 0.3).cast("int").alias("predicted"),
    )


def op3_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scan(table(spark, sf_dir, "documents"))


def op3_licence_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Notices anywhere in a text, also beside other words of their line."""
    return licences.scan_passages(table(spark, sf_dir, "documents"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = langid.identify(docs, langid.fit(docs))
    return found.select("doc_id", (fold_remainder(F.col("doc_id"), 3) == 1).alias("held_out"), "lang_pred", "score")


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    report = decontam.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return report.drop("text_hash")


def op6_cover_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coverdedup.near_duplicates(table(spark, sf_dir, "embeddings"))


def op7_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return htmlmain.extract(table(spark, sf_dir, "pages"))


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.group_documents(table(spark, sf_dir, "documents"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = toxicity.detect(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))
    return found.select(
        "doc_id",
        (fold_remainder(F.col("doc_id"), 5) == 0).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
        F.size("passages").alias("n_passages"),
    )


def op10_pack_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.mine(table(spark, sf_dir, "documents"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.col("label").cast("long")
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label).alias("label"))
    return hardneg.mine(rows, F.col("vec_id") % 50 == 0)


#: Shards of op13, and the key of its permutation.
SHARDS, SHARD_SEED = 24, 13


def op13_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shards by law ``rows``, which keeps no groups of equal texts together."""
    text = F.coalesce("text", F.lit(""))
    return sharding.shard_table(spark, f"{sf_dir}/documents.parquet", SHARDS, SHARD_SEED).select(
        "doc_id",
        (F.octet_length(text) + 8).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.lit(sharding.LAW).alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


OP3_SQL = f"""
WITH t(licence, text) AS (VALUES {", ".join(f"({_quoted(a)}, {_quoted(t)})" for a, t in licences.TEMPLATES)}),
u AS (
  SELECT DISTINCT doc_id, unnest(list_concat(string_split(text, chr(10)),
    list_filter(regexp_split_to_array(text, '\\n[ \\t]*\\n'), lambda p: contains(trim(p, chr(10)), chr(10))))) AS unit
  FROM documents),
uw AS (
  SELECT doc_id, unit, regexp_extract_all(translate(unit, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z]+') AS w FROM u),
up AS (SELECT doc_id, unit, x || ' ' || lead(x) OVER (PARTITION BY doc_id, unit ORDER BY i) AS p
  FROM (SELECT doc_id, unit, unnest(w) AS x, generate_subscripts(w, 1) AS i FROM uw)),
ub AS (SELECT doc_id, unit, list(DISTINCT p) AS b FROM up WHERE p IS NOT NULL GROUP BY 1, 2),
tw AS (SELECT licence, text, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z]+') AS w FROM t),
tb AS (SELECT licence, list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS b,
  list_filter(w, lambda x: regexp_full_match(x, '[0-9]+')) AS numbers FROM tw),
m AS (
  SELECT doc_id, licence, list_sort(ub.b) AS unit, 2.0 * len(list_intersect(ub.b, tb.b)) / (len(ub.b) + len(tb.b)) AS dice
  FROM ub JOIN tb ON len(ub.b) > 0 AND 2 * least(len(ub.b), len(tb.b)) >= 0.75 * (len(ub.b) + len(tb.b)) - 1e-6
    JOIN uw USING (doc_id, unit) WHERE len(list_filter(tb.numbers, lambda x: NOT list_contains(uw.w, x))) = 0),
k AS (SELECT * FROM m WHERE dice >= 0.75),
g AS (
  SELECT doc_id, count(DISTINCT unit) AS n_units, max(dice) AS score FROM k GROUP BY 1),
l AS (SELECT k.doc_id, min(licence) AS licence FROM k JOIN g ON k.doc_id = g.doc_id AND dice = score GROUP BY 1),
s AS (SELECT doc_id, string_agg(licence, ',' ORDER BY licence) AS licences FROM (SELECT DISTINCT doc_id, licence FROM k) GROUP BY 1)
SELECT d.doc_id, CAST(coalesce(n_units, 0) AS BIGINT) AS n_units, licence, CAST(coalesce(score, 0) AS DOUBLE) AS score,
  coalesce(licences, '') AS licences
FROM (SELECT DISTINCT doc_id FROM documents) d LEFT JOIN g USING (doc_id) LEFT JOIN l USING (doc_id) LEFT JOIN s USING (doc_id)
"""

OP3_PASSAGES_SQL = f"""
WITH t(licence, text) AS (VALUES {", ".join(f"({_quoted(a)}, {_quoted(t)})" for a, t in licences.TEMPLATES)}),
tw AS (SELECT licence, row_number() OVER () AS tid, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z]+') AS w FROM t),
tb AS (SELECT licence, tid, list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS wanted,
  list_filter(w, lambda x: regexp_full_match(x, '[0-9]+')) AS numbers FROM tw),
tm AS (SELECT *, len(wanted) AS m, ceil(len(wanted) * 0.6 - 1e-9) AS low, floor(len(wanted) / 0.6 + 1e-9) AS high FROM tb),
dw AS (SELECT doc_id, text, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z]+') AS w FROM documents),
dp AS (SELECT doc_id, text, i, x || ' ' || lead(x) OVER (PARTITION BY doc_id, text ORDER BY i) AS p
  FROM (SELECT doc_id, text, unnest(w) AS x, generate_subscripts(w, 1) AS i FROM dw)),
tp AS (SELECT tid, unnest(wanted) AS p FROM tm),
marks AS (SELECT DISTINCT doc_id, text, tid, i FROM dp JOIN tp USING (p)),
ends AS (SELECT a.doc_id, a.text, a.tid, a.i AS a, b.i AS b FROM marks a JOIN marks b ON a.doc_id = b.doc_id AND a.text = b.text AND a.tid = b.tid
  JOIN tm ON tm.tid = a.tid AND b.i - a.i + 1 BETWEEN low AND high),
runs AS (SELECT doc_id, text, licence, wanted, numbers, m, a, b, w[a:b + 1] AS w,
  list_transform(range(a, b + 1), lambda i: w[i] || ' ' || w[i + 1]) AS run FROM ends JOIN dw USING (doc_id, text) JOIN tm USING (tid)),
scored AS (SELECT doc_id, text, licence, a, b, 2.0 * len(list_intersect(list_distinct(run), wanted)) / (len(list_distinct(run)) + m) AS dice FROM runs
  WHERE len(list_filter(numbers, lambda x: NOT list_contains(w, x))) = 0),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, text, licence, a ORDER BY dice DESC, b) AS r FROM scored WHERE dice >= 0.75) WHERE r = 1),
kept AS (SELECT * FROM best x WHERE NOT EXISTS (SELECT 1 FROM best y WHERE y.doc_id = x.doc_id AND y.text = x.text AND y.licence <> x.licence
  AND y.dice > x.dice AND y.a <= x.b AND x.a <= y.b)),
top AS (SELECT doc_id, licence, dice FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY dice DESC, licence) AS r2 FROM kept) WHERE r2 = 1),
s AS (SELECT doc_id, string_agg(licence, ',' ORDER BY licence) AS licences FROM (SELECT DISTINCT doc_id, licence FROM kept) GROUP BY 1)
SELECT d.doc_id, licence, CAST(coalesce(dice, 0) AS DOUBLE) AS score, coalesce(licences, '') AS licences
FROM (SELECT DISTINCT doc_id FROM documents) d LEFT JOIN top USING (doc_id) LEFT JOIN s USING (doc_id)
"""

OP5_SQL = """
WITH w AS (
  SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), []) AS ws FROM documents),
b AS (
  SELECT DISTINCT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS ws FROM benchmark),
bw AS (
  SELECT item_id, least(10, len(ws)) AS n,
    unnest(list_transform(range(1, len(ws) - least(10, len(ws)) + 2),
      lambda i: array_to_string(ws[i:i + least(10, len(ws)) - 1], ' '))) AS win
  FROM b WHERE len(ws) > 0),
sizes AS (SELECT DISTINCT n FROM bw),
dl AS (
  SELECT doc_id, i, list(x) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 9 FOLLOWING) AS l
  FROM (SELECT doc_id, unnest(ws) AS x, generate_subscripts(ws, 1) AS i FROM w)),
dw AS (SELECT doc_id, n, i, array_to_string(l[1:n], ' ') AS win FROM dl, sizes WHERE len(l) >= n),
hits AS (SELECT DISTINCT doc_id, item_id, i, dw.n AS n FROM dw JOIN bw ON dw.win = bw.win AND dw.n = bw.n),
pos AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hits) GROUP BY 1),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item_id FROM hits) GROUP BY 1)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AS contaminated
FROM w LEFT JOIN pos USING (doc_id) LEFT JOIN its USING (doc_id)
"""

OP6_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (
  SELECT a.vec_id AS u, b.vec_id AS v FROM v a JOIN v b ON len(a.e) = len(b.e) AND a.vec_id <> b.vec_id
  WHERE list_cosine_similarity(a.e, b.e) >= 0.95),
reach(vec_id, r) AS (
  SELECT vec_id, vec_id FROM embeddings
  UNION
  SELECT links.v, reach.r FROM reach JOIN links ON links.u = reach.vec_id)
SELECT e.vec_id, CAST(coalesce(n, 0) AS BIGINT) AS n_links, c AS component_id, e.vec_id = c AS kept
FROM embeddings e LEFT JOIN (SELECT u AS vec_id, count(*) AS n FROM links GROUP BY 1) USING (vec_id)
JOIN (SELECT vec_id, min(r) AS c FROM reach GROUP BY 1) USING (vec_id)
"""

OP8_SQL = """
WITH RECURSIVE w AS (
  SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\\x20\\x09-\\x0D]+'), []) AS ws FROM documents),
l AS (
  SELECT doc_id, n, i, list(x) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING) AS l
  FROM (SELECT doc_id, len(ws) AS n, unnest(ws) AS x, generate_subscripts(ws, 1) AS i FROM w)),
s AS (SELECT DISTINCT doc_id, array_to_string(l, ' ') AS sh FROM l WHERE len(l) = 5 OR (n < 5 AND i = 1)),
sizes AS (SELECT doc_id, count(*) AS k FROM s GROUP BY 1),
common AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS c FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (
  SELECT u, v FROM common JOIN sizes a ON a.doc_id = u JOIN sizes b ON b.doc_id = v WHERE 100 * c >= 75 * (a.k + b.k - c)),
reach(doc_id, r) AS (
  SELECT doc_id, doc_id FROM sizes
  UNION
  SELECT links.v, reach.r FROM reach JOIN links ON links.u = reach.doc_id)
SELECT w.doc_id, CAST(coalesce(k, 0) AS BIGINT) AS n_shingles, coalesce(c, w.doc_id) AS component_id
FROM w LEFT JOIN sizes USING (doc_id) LEFT JOIN (SELECT doc_id, min(r) AS c FROM reach GROUP BY 1) USING (doc_id)
"""


OP11_SQL = f"""
WITH p AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[.,;:!?\\x0A-\\x0D]')) AS x FROM documents),
w AS (SELECT lang, regexp_extract_all(x, '[^\\x20\\x09]+') AS w FROM p),
g AS (SELECT lang, unnest(w) AS w0, unnest(w[2:]) AS w1, unnest(w[3:]) AS w2 FROM w),
f AS (
  SELECT lang, 1 AS words, w0 AS phrase, count(*) AS f FROM g WHERE w0 IS NOT NULL GROUP BY 1, 3
  UNION ALL SELECT lang, 2, w0 || ' ' || w1, count(*) FROM g WHERE w1 IS NOT NULL GROUP BY 1, 3
  UNION ALL SELECT lang, 3, w0 || ' ' || w1 || ' ' || w2, count(*) FROM g WHERE w2 IS NOT NULL GROUP BY 1, 3),
n AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM f WHERE words = 1 GROUP BY 1),
c AS (SELECT lang, words, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE words > 1 AND f >= {collocations.LEAST}),
key AS (SELECT lang || chr(10) || phrase AS id, f FROM f WHERE f >= {collocations.LEAST}),
cuts AS (SELECT c.*, k, lang || chr(10) || array_to_string(w[:k], ' ') AS first, lang || chr(10) || array_to_string(w[k + 1:], ' ') AS rest FROM c, range(1, {collocations.MAX_WORDS}) r(k) WHERE k < words),
s AS (SELECT c.lang, c.words, c.phrase, c.a, k, x.f AS l, y.f AS r, CAST(1000000 * CAST(c.a AS HUGEINT) * c.a // (CAST(x.f AS HUGEINT) * y.f) AS BIGINT) AS score
  FROM cuts c JOIN key x ON x.id = c.first JOIN key y ON y.id = c.rest),
b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) AS i FROM s) WHERE i = 1),
inner_of AS (SELECT lang, unnest([array_to_string(w[1:2], ' '), array_to_string(w[2:3], ' ')]) AS phrase, a FROM c WHERE words = 3),
most AS (SELECT lang, phrase, max(a) AS most FROM inner_of GROUP BY 1, 2),
ranked AS (SELECT lang, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, score
  FROM b LEFT JOIN most m USING (lang, phrase) WHERE most IS NULL OR 100 * most < {collocations.INSIDE} * a)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN n USING (lang) WHERE rank <= {collocations.TOP}
"""

OP12_SQL = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (
  SELECT a.vec_id AS anchor_id, a.label AS own, b.vec_id, b.label, CAST(list_dot_product(CAST(a.e AS DOUBLE[]), CAST(b.e AS DOUBLE[])) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE a.vec_id % 50 = 0),
near AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM (
    SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) AS i FROM p WHERE label = own) WHERE i <= 5),
far AS (
  SELECT anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank,
    vec_id AS negative_id, positive_score, score AS negative_score
  FROM near JOIN p USING (anchor_id) WHERE label <> own AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score)
SELECT * FROM far WHERE rank <= 3
"""


def _round_sql(x: str, key: int) -> str:
    """The network's hash of a digit."""
    low = f"((xor({x}, {key}) * {sharding.MIX[0]}) & {sharding.WORD})"
    mixed = f"xor({low}, {low} >> 15)"
    low = f"(({mixed} * {sharding.MIX[1]}) & {sharding.WORD})"
    return f"xor({low}, {low} >> 13)"


def _network_sql(rows: str) -> str:
    """Columns i, x of ``rows`` with x sent through the network once; ``d`` has n and the bases a, b."""
    out = f"SELECT i, n, a, b, x // b AS l, x % b AS r FROM ({rows}) CROSS JOIN d"
    for k, key in enumerate(sharding.round_keys(SHARD_SEED)):
        moved = f"(l + {_round_sql('r', key)}) % a AS l, r" if k % 2 == 0 else f"l, (r + {_round_sql('l', key)}) % b AS r"
        out = f"SELECT i, n, a, b, {moved} FROM ({out})"
    return f"SELECT i, l * b + r AS x FROM ({out})"


#: Rows are numbered as they lie in the table; crc32 by a table of 256 remainders over the bytes of the text.
OP13_SQL = f"""
WITH RECURSIVE d AS (
  SELECT n, a, greatest(1, CAST(ceil(n / CAST(a AS DOUBLE)) AS BIGINT)) AS b FROM (
    SELECT count(*) AS n, greatest(1, CAST(ceil(sqrt(count(*))) AS BIGINT)) AS a FROM documents)),
rows_of AS (SELECT row_number() OVER () - 1 AS i, doc_id, coalesce(text, '') AS text FROM documents),
walk(i, x) AS (
  {_network_sql("SELECT i, i AS x FROM rows_of")}
  UNION ALL
  {_network_sql("SELECT i, x FROM walk CROSS JOIN d WHERE x >= n")}),
t AS (SELECT list_transform(range(256), lambda v: list_reduce(list_prepend(v, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS remainders),
bytes AS (SELECT i, list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda h: CAST('0x' || h AS BIGINT)) AS b FROM rows_of),
sums AS (SELECT i, xor(list_reduce(list_prepend(4294967295, b), lambda c, x: xor(c >> 8, remainders[(xor(c, x) & 255) + 1])), 4294967295) AS text_crc32 FROM bytes CROSS JOIN t)
SELECT doc_id, CAST(strlen(text) + 8 AS BIGINT) AS size, text_crc32, 'rows' AS law, CAST(x % {SHARDS} AS INTEGER) AS shard, CAST(x // {SHARDS} AS BIGINT) AS slot,
  CAST(NULL AS INTEGER) AS grown_shard
FROM rows_of JOIN sums USING (i) JOIN walk USING (i) CROSS JOIN d WHERE x < n
"""

QUERIES = {
    "op1_url_filter": op1_url_filter,
    "op2_quality": op2_quality,
    "op3_licence_scan": op3_licence_scan,
    "op3_licence_passages": op3_licence_passages,
    "op4_language_id": op4_language_id,
    "op5_decontaminate": op5_decontaminate,
    "op6_cover_tree": op6_cover_tree,
    "op7_main_text": op7_main_text,
    "op8_jaccard_join": op8_jaccard_join,
    "op9_toxicity": op9_toxicity,
    "op10_pack_sequences": op10_pack_sequences,
    "op11_collocations": op11_collocations,
    "op12_hard_negatives": op12_hard_negatives,
    "op13_shards": op13_shards,
}

ORACLES: dict[str, str] = {
    "op3_licence_scan": OP3_SQL,
    "op3_licence_passages": OP3_PASSAGES_SQL,
    "op5_decontaminate": OP5_SQL,
    "op6_cover_tree": OP6_SQL,
    "op8_jaccard_join": OP8_SQL,
    "op11_collocations": OP11_SQL,
    "op12_hard_negatives": OP12_SQL,
    "op13_shards": OP13_SQL,
}
