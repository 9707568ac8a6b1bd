from __future__ import annotations

import itertools
import math
import random
import time

import pytest

from termforge.llm import htmlmain, urls

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="</p><p>no";</script></head><body>
<nav><ul><li><a href="/a">Home</a></li><li><a href="/b">News</a></li></ul></nav><div class="ad">Buy now, it is cheap and good for you all.</div>
<header><h1>Site name</h1></header><div class="cookie-notice">We use cookies to make this site better.</div>
<article><h1>Title &amp; more</h1><p>First paragraph  with
 <b>bold</b> text&nbsp;here.<p>Second one &lt;p&gt; is<br>unclosed.<form><label>Mail</label><input></form>
<p>Third paragraph after a form.</p><section class="comments"><p>A reader says many things at length, and more.</p></section></article>
<aside><p>Related reading that nobody asked for, truly.</p></aside><footer>&copy; 2020</footer></body></html>"""


def test_main_text():
    expected = "Title & more\nFirst paragraph with bold text here.\nSecond one <p> is unclosed.\nThird paragraph after a form."
    assert htmlmain.main_text(PAGE) == expected
    cut = PAGE[: PAGE.index("paragraph after") + 9] + "<b"
    assert htmlmain.main_text(cut) == expected.replace(" after a form.", "")


def test_without_hints():
    text = "This sentence is long enough to count as the content of a page, isn't it? " * 3
    page = f"<div><a href=x>Menu</a> <a href=y>More</a></div><div><p>{text}</p><p>{text}</p></div><div><a href=z>Next</a></div>"
    assert htmlmain.main_text(page) == "\n".join([text.strip()] * 2)


@pytest.mark.parametrize("page", [None, "", "<", "<p", "</p>", "<!-- open", "<script>x", "a < b", "<a href='x>y", "<p>" * 2000, "&#x110000;&bogus;&amp"])
def test_odd_pages(page):
    assert isinstance(htmlmain.main_text(page), str)


def test_minimum_cut_is_minimal():
    rng = random.Random(4)
    for _ in range(40):
        n = rng.randrange(1, 8)
        z = [rng.uniform(-3, 3) for _ in range(n)]
        edges = [(i, j, rng.uniform(0, 2)) for i in range(n) for j in range(i + 1, n) if rng.random() < 0.5]
        cost = lambda x: sum(abs(a) for a, k in zip(z, x) if k != (a > 0)) + sum(w for i, j, w in edges if x[i] != x[j])
        assert cost(htmlmain.minimum_cut(z, edges)) == pytest.approx(min(cost(x) for x in itertools.product([False, True], repeat=n)))


def test_long_and_deep_pages():
    n, said = 20_000, "This is a sentence of some length. "
    pages = [
        "<div>" + "".join(f"<p>{said * (i % 3)}word</p><a href=x>link {i}</a>" for i in range(n // 2)) + "</div>",
        "<div>x " * n, "<p>" + "<i>" * n + "</b>x" * n, "<table>" + "<i>" * n + "<p>x" * n, "<a '" * n + ">",
    ]
    began = time.perf_counter()
    texts = [htmlmain.main_text(p) for p in pages]
    chain = [100.0 if i == 0 else -0.001 for i in range(n)]
    kept = htmlmain.minimum_cut(chain, [(i - k, i, w) for k, w in ((1, 1 / 3), (2, 0.8)) for i in range(k, n)])
    assert time.perf_counter() - began < 20
    assert texts[0].count(said.strip()) == 2 * len([i for i in range(n // 2) if i % 3 == 2]) + len([i for i in range(n // 2) if i % 3 == 1])
    assert sum(kept) == 1


def test_extract(spark):
    rows = [(1, "u", PAGE, "t"), (2, None, None, "t"), (None, "v", "", None), (1, "u", PAGE, "t")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = htmlmain.extract(df).collect()
    assert sorted((r.page_id or 0, r.n_chars > 0) for r in got) == [(0, False), (1, True), (1, True), (2, False)]
    assert all(len(r.text) == r.n_chars for r in got)
    assert htmlmain.extract(df.limit(0)).collect() == []


def test_split_url():
    assert urls.split_url("http://A.Example.NET/En/x?q#f") == ("a.example.net", "/En/x")
    assert urls.split_url("https://x.org?y/z") == ("x.org", "")
    assert urls.split_url("//x.org/a") == urls.split_url(None) == urls.split_url("") == ("", "")
    assert urls.split_url("a://b://c/d") == ("b:", "//c/d")


def test_rules():
    rule = lambda u: urls.match_rule(*urls.split_url(u))
    assert rule("http://a.example.net/en/1") == ("example.net/en/", "allow")
    assert rule("http://a.example.net/de/1") == ("net/", "block")
    assert rule("http://badexample.net/en/1") == ("net/", "block")
    assert rule("http://example.com/de/") == ("example.com/de/", "block")
    assert rule("http://x.org/fr/1") == ("org/fr/", "allow")
    assert rule("http://net") is None and rule("http://example.com/en/") is None


def test_segmentation_against_all_splits():
    model = urls.fit()

    def value(parts):
        return sum(model.words.get(w, model.unknown(len(w))) for w in parts)

    for name in ("casinowin", "freebets", "dailynews", "adstrack", "qzthth"):
        n = len(name)
        best = max(
            value([name[a:b] for a, b in zip((0, *cuts), (*cuts, n))])
            for k in range(n)
            for cuts in itertools.combinations(range(1, n), k)
        )
        assert value(model.segment(name)) == pytest.approx(best)
    assert model.segment("casinowin") == ["casino", "win"]
    began = time.perf_counter()
    long = model.segment("q" * 30_000 + "prescription" + "z" * 30_000)
    assert long == ["q" * 30_000, "prescription", "z" * 30_000] and time.perf_counter() - began < 20


def test_words_learned_from_pages(spark):
    said = "<p>We sell <b>flowers</b> and mortgage&nbsp;calculators</p><script>hidden words</script>"
    rows = [(i, f"http://site{'abcdefgh'[i % 8]}.com/", said) for i in range(24)] + [(30 + i, "http://buyflowers.com/", "buyflowers " * 50) for i in range(9)]
    pages = spark.createDataFrame([*rows, (99, None, None), (100, "http://x.com", "")], "page_id long, url string, html string")
    model = urls.fit(pages)
    assert model.segment("mortgagecalculators") == ["mortgage", "calculators"] and model.segment("sellflowers") == ["sell", "flowers"]
    # a site's own name is on one host however often it is said, and hidden text is no text
    assert "buyflowers" not in model.words and "hidden" not in model.words and "nbsp" not in model.words
    assert urls.fit(pages.limit(0)).words.keys() == urls.fit().words.keys()


def test_scores_against_all_splits(spark):
    """The returned score from the best of all splits, the words' evidence and the prior."""
    model = urls.fit()
    rows = [(1, "http://freebets.com/casinowin/x"), (2, "http://dailynews.org/adstrack"), (3, "http://qzq.net/")]
    got = {r.page_id: r.block_score for r in urls.judge_urls(spark.createDataFrame(rows, "page_id long, url string"), model=model).collect()}
    value = lambda parts: sum(model.words.get(w, model.unknown(len(w))) for w in parts)
    for i, url in rows:
        odds = model.prior
        for token in urls.TOKENS.findall(url.split("//")[1]):
            if token not in urls.NEUTRAL:
                n = len(token)
                splits = ([token[a:b] for a, b in zip((0, *cuts), (*cuts, n))] for k in range(n) for cuts in itertools.combinations(range(1, n), k))
                odds += sum(model.evidence.get(w, 0.0) for w in max(splits, key=value))
        assert got[i] == pytest.approx(1 / (1 + math.exp(-odds)))


def test_verdicts(spark):
    rows = [(1, "http://www.bestcasinowin.com/en/"), (2, "http://dailynews.com/a"), (3, None), (4, "http://cheap-pills.example.net/en/"), (None, "x"), (1, "")]
    df = spark.createDataFrame([(*r, "h", 1) for r in rows], "page_id long, url string, host string, verdict int")
    got = [(r.page_id, r.host, r.rule, r.verdict) for r in urls.judge_urls(df).collect()]
    assert (1, "www.bestcasinowin.com", None, "block") in got and (2, "dailynews.com", None, "allow") in got
    assert (3, "", None, "allow") in got and (4, "cheap-pills.example.net", "example.net/en/", "allow") in got
    assert len(got) == 6 and urls.judge_urls(df.limit(0)).collect() == []
