from __future__ import annotations

import duckdb

from termforge.functions import analysis, porter
from termforge.plans.stem_oracle import stem_sql
from termforge.sources import readers, sinks

# examples of the 1980 paper
STEMS = {
    "caresses": "caress", "ponies": "poni", "ties": "ti", "caress": "caress", "cats": "cat", "feed": "feed", "agreed": "agre",
    "plastered": "plaster", "bled": "bled", "motoring": "motor", "sing": "sing", "conflated": "conflat", "troubled": "troubl",
    "sized": "size", "hopping": "hop", "tanned": "tan", "falling": "fall", "hissing": "hiss", "fizzed": "fizz", "failing": "fail",
    "filing": "file", "happy": "happi", "sky": "sky", "relational": "relat", "conditional": "condit", "rational": "ration",
    "valenci": "valenc", "digitizer": "digit", "conformabli": "conform", "radicalli": "radic", "differentli": "differ", "vileli": "vile",
    "analogousli": "analog", "vietnamization": "vietnam", "predication": "predic", "operator": "oper", "feudalism": "feudal",
    "decisiveness": "decis", "hopefulness": "hope", "callousness": "callous", "formaliti": "formal", "sensitiviti": "sensit",
    "sensibiliti": "sensibl", "triplicate": "triplic", "formative": "form", "formalize": "formal", "electriciti": "electr",
    "electrical": "electr", "hopeful": "hope", "goodness": "good", "revival": "reviv", "allowance": "allow", "inference": "infer",
    "airliner": "airlin", "gyroscopic": "gyroscop", "adjustable": "adjust", "defensible": "defens", "irritant": "irrit",
    "replacement": "replac", "adjustment": "adjust", "dependent": "depend", "adoption": "adopt", "communism": "commun",
    "activate": "activ", "homologous": "homolog", "effective": "effect", "bowdlerize": "bowdler", "probate": "probat", "rate": "rate",
    "cease": "ceas", "controll": "control", "roll": "roll", "is": "is", "as": "as",
}


def test_porter(spark):
    words = spark.createDataFrame([(w,) for w in STEMS], "term string")
    assert {r.term: r.stem for r in porter.stems(words, extended=False).collect()} == STEMS


#: Known forms of the extended stemmer.
EXTENDED = {
    "dies": "die", "died": "die", "dying": "die", "flies": "fli", "ties": "tie", "ponies": "poni", "cried": "cri", "enjoy": "enjoy", "say": "say", "happy": "happi",
    "by": "by", "aged": "age", "skies": "sky", "news": "news", "proceed": "proceed", "nationally": "nation", "hopefully": "hope", "possibly": "possibl", "geology": "geolog",
    "succeed": "succeed",
}


def test_extended_porter(spark):
    words = spark.createDataFrame([(w,) for w in EXTENDED], "term string")
    got = {r.term: r.stem for r in porter.stems(words).collect()}
    assert got == EXTENDED


def test_porter_against_rule_tables(spark):
    """Words of beginnings and endings, by the expressions and by the tables of the SQL counterpart."""
    starts = "a o ag y sk d cr happ fall fil ration condit geo str syz toy empl oy ab tr v vv é ñj yb".split()
    ends = "sses ies s eed ed ing y alli ational tional bli logi fulli ation alism icate ful ance ement ment ion sion e ll ied ly iness".split()
    words = sorted({a + b + c for a in starts for b in ["", *ends] for c in ("", "s", "ed", "ly")})
    got = {r.term: r.stem for r in porter.stems(spark.createDataFrame([(w,) for w in words], "term string")).collect()}
    c = duckdb.connect()
    c.execute("CREATE TABLE voc (term VARCHAR)")
    c.executemany("INSERT INTO voc VALUES (?)", [(w,) for w in words])
    assert got == dict(c.sql(stem_sql("voc")).fetchall())


def test_lines_of_several_files_and_blocks(spark, tmp_path):
    (tmp_path / "x").mkdir()
    lines = [f"line {i}" * (i % 7) for i in range(3000)]
    (tmp_path / "x" / "part-0").write_text("\n".join(lines[:2000]) + "\n")
    (tmp_path / "x" / "part-1").write_text("\n".join(lines[2000:]))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "5000")
    try:
        got = sorted(tuple(r) for r in readers.numbered_lines(spark, str(tmp_path / "x")).collect())
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert got == list(enumerate(lines, 1))


def test_token_filters(spark):
    df = spark.createDataFrame([(1, "Well-known, 3.5 Cats. don't İ"), (2, None), (3, "")], "doc_id long, text string")
    keep = lambda k: sorted(r.term for r in analysis.exploded(df, "text", keep=k).collect())
    assert keep(analysis.ALNUM)[:1] == ["cats"] and len(keep(analysis.ALNUM)) == 2
    assert keep(None)[:4] == [",", ".", "3.5", "cats"]
    rows = analysis.exploded(df, "text", keep=None, position="pos").orderBy("pos").collect()
    assert [r.term for r in rows][:2] == ["well-known", ","]
    assert [r.term for r in analysis.without_words(analysis.exploded(df, "text"), ["cats"]).collect()] != []


def test_ngrams(spark):
    df = spark.createDataFrame([("abcde",), ("abc",), ("a\nbcd",), (None,), ("நன்றி",)], "text string")
    got = [r.g for r in df.select(analysis.char_ngrams(df.text, 4).alias("g")).collect()]
    assert got[0] == ["abcd", "bcde"] and got[1] == [] and got[2] == ["a\nbc", "\nbcd"] and got[3] == [] and len(got[4]) == 2


def test_sources_and_sinks(spark, tmp_path):
    docs = tmp_path / "docs"
    docs.mkdir()
    (docs / "12").write_text("one two\nthree")
    (docs / "7").write_text("four")
    assert {r.doc_id: r.text for r in readers.directory(spark, str(docs)).collect()} == {12: "one two\nthree", 7: "four"}
    (tmp_path / "train.txt").write_text("x ab cd\ny ef\n")
    assert {(r.lang, r.text) for r in readers.labelled_lines(spark, str(tmp_path / "train.txt")).collect()} == {("x", "ab cd"), ("y", "ef")}
    (tmp_path / "q.txt").write_text("a AND b\n\nc\n")
    assert [(r.query_id, r.query) for r in readers.queries(spark, str(tmp_path / "q.txt")).collect()] == [(1, "a AND b"), (2, ""), (3, "c")]
    (tmp_path / "c.csv").write_text('document_id,content,title,date_posted,court\n5,"two\nlines ""q""",t,2001,High\n')
    row = readers.zoned_csv(spark, str(tmp_path / "c.csv")).collect()[0]
    assert (row.doc_id, row.content, row.court) == (5, 'two\nlines "q"', "High")
    p = spark.createDataFrame([("b", 1), ("a", 2)], "term string, doc_id long")
    sinks.save_index(str(tmp_path / "ix"), postings=p)
    back = sinks.load_index(spark, str(tmp_path / "ix"), "postings")
    assert [r.doc_id for r in sinks.postings_of(back, ["a"]).collect()] == [2]
    sinks.write_lines(spark.createDataFrame([(2, ""), (1, "3 4")], "query_id long, result string"), str(tmp_path / "out"), "query_id", "result")
    assert next((tmp_path / "out").glob("part-*")).read_text() == "3 4\n\n"
