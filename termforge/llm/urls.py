"""URL filter: explicit host and path rules, then naive Bayes over segmented words.

Host labels and path tokens are split into words by a unigram model (Viterbi over word
probabilities, with a length penalty for unknown words), and a multinomial naive Bayes model
scores the words. Word probabilities come from the texts of all pages: on how many hosts a word
stands, so that neither copies nor the own name of a site, which is what is to be split, make a
word frequent. The verdicts' model is trained on the fixed examples below, as no urls are labelled.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termforge.llm import common

# The training examples, one host and path a line.
BLOCK_EXAMPLES = """
ads track banner click | ad server pixel | track ads click | pop under ads | adult cams live | adult video xxx
best casino win | big win slots | casino bonus free spins | online casino win jackpot | live casino | casino games bet
bet win | free bets | sports bets bonus | betting tips bets | free bet offers | bet now odds
cheap pills | cheap pills online pharmacy | viagra pills cheap | buy cheap meds | diet pills | pills no prescription
cheap replica watches | replica bags cheap | cheap loans fast cash | payday loans now | fast cash loans | easy money fast
click track pixel | cash prize winner | lottery winner prize | free iphone winner | free gift cards | crack keygen download
download free crack serial | hot singles dating | hookup dating adult | porn tube free | porn videos xxx | sex cams
comment spam | doorway spam farm | link farm spam | spam links | spam mailer | weight loss pills | work from home cash | xxx tube | miracle cure pills | earn money fast | crypto doubler bonus
torrent crack warez | warez serial keygen | poker casino poker | poker chips bonus | slots free spins | track pixel beacon
""".replace("\n", " | ")
ALLOW_EXAMPLES = """
about us contact | academy courses online | archive of articles | art museum | blog post | book reviews | business news today
city council | code docs | community forum help | computer science department | cook book recipes | daily news
data science journal | developer guide docs | digital library | docs api reference | education blog | encyclopedia article
family health guide | film review | food recipes home | free software foundation | garden home guide | green energy report
health news | help center | history of science | history museum | home page | house garden | image gallery | index page
job search | language school | law review | library catalog | local news today | magazine article | main page | map of the city
math course | medical journal | mobile phone review | music review | nature journal | news | news archive | open data portal
open source project | paper archive | photo blog | press release | product manual | public library | question answer
research institute | school district | science daily | shop home | site map | sport news | story archive | student union
support page | team blog | tech blog | the daily post | the times news | travel guide | tutorial page | university press
user manual | video lecture | weather report | web design guide | wiki page | world news | writers blog | free press
online course | online shop | download page | win the day sports | best books | game reviews | live music | phone cases
""".replace("\n", " | ")
#: Parts of a host that say nothing about its content.
NEUTRAL = frozenset("com de edu en es example fr html http https m net org ref source utm www".split())
#: (rule, verdict): host, then path. A rule fits its host and all subdomains if the path starts with the rule's.
RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))
BLOCK_PRIOR = 0.2
ALPHA = 0.5
#: Words of the unigram model: on at least so many hosts, and at least this share of all (host, word) pairs, so that
#: there are no more than 1 / LEAST_SHARE of them. The examples' words have EXAMPLE_SHARE of the probability.
LEAST_HOSTS, LEAST_SHARE, EXAMPLE_SHARE = 2, 1 / 500_000, 0.02
MARKUP = re.compile(r"<(?:script|style)\b.*?</(?:script|style)|<[^>]*>|&[a-z]+;", re.S | re.I)
CACHED = 100_000
UPPER_TO_LOWER = {i: i + 32 for i in range(ord("A"), ord("Z") + 1)}
AFTER_SCHEME = re.compile(r"://([^/?#]*)([^?#]*)", re.S)
TOKENS = re.compile(r"[a-z]+")


def split_url(url: str | None) -> tuple[str, str]:
    """(host, path): after the first ``://``; null or no ``://`` gives both empty."""
    m = AFTER_SCHEME.search(url) if url else None
    return (m.group(1).translate(UPPER_TO_LOWER), m.group(2)) if m else ("", "")


def match_rule(host: str, path: str, rules=RULES) -> tuple[str, str] | None:
    """The longest rule that fits."""
    fits = []
    for rule, verdict in rules:
        h, slash, p = rule.partition("/")
        if (host == h or host.endswith("." + h)) and path.startswith(slash + p):
            fits.append((len(rule), rule, verdict))
    return max(fits)[1:] if fits else None


@dataclass
class Model:
    words: dict[str, float] = field(default_factory=dict)  # log probability
    total: float = 1.0
    evidence: dict[str, float] = field(default_factory=dict)  # log P(w | block) - log P(w | allow)
    prior: float = 0.0
    longest: int = 1

    def unknown(self, size: int) -> float:
        """Log probability of an unknown word: the longer the rarer, yet likelier than several unknown pieces."""
        return -math.log(self.total * 10) - 1.5 * size

    def segment(self, name: str) -> list[str]:
        """The most probable split of a name into words, of which unknown ones may have any length.

        Time grows with the name's length times that of the longest known word: an unknown piece grows
        letter by letter at a constant cost.
        """
        begin, longest = self.unknown(0), self.longest
        best: list[tuple[float, int]] = [(0.0, 0)]  # of each prefix: the value and the last word's beginning
        piece = (-math.inf, 0)  # the best split that ends in an unknown piece
        for end in range(1, len(name) + 1):
            piece = max((piece[0] - 1.5, piece[1]), (best[-1][0] + begin - 1.5, end - 1))
            here = piece
            for start in range(max(0, end - longest), end):
                p = self.words.get(name[start:end])
                if p is not None:
                    here = max(here, (best[start][0] + p, start))
            best.append(here)
        out, end = [], len(name)
        while end:
            out.append(name[best[end][1] : end])
            end = best[end][1]
        return out[::-1]

    def block_odds(self, host: str, path: str, cache: dict[str, float]) -> float:
        """Log-odds of blocking by the words of host and path; unknown and neutral words say nothing."""
        odds = self.prior
        for token in TOKENS.findall(host) + TOKENS.findall(path.translate(UPPER_TO_LOWER)):
            if token in NEUTRAL:
                continue
            s = cache.get(token)
            if s is None:
                if len(cache) >= CACHED:
                    cache.clear()
                s = cache[token] = sum(self.evidence.get(w, 0.0) for w in self.segment(token))
            odds += s
        return odds


def host_words(pages: DataFrame) -> DataFrame:
    """(word, hosts): on how many hosts a word stands in the text of a page, of all pages."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: set[tuple[str, str]] = set()
            for url, html in zip(batch.column(0).to_pylist(), batch.column(1)):
                host = split_url(url)[0]
                seen.update((host, w) for w in set(TOKENS.findall(MARKUP.sub(" ", html.as_py() or "").lower())))
            rows = list(zip(*seen)) or [(), ()]
            yield pa.RecordBatch.from_arrays([pa.array(r, pa.string()) for r in rows], names=["host", "word"])

    found = common.spread(pages.select("url", "html")).mapInArrow(run, "host string, word string")
    found = found.select(F.xxhash64("host").alias("host"), "word").distinct()
    return found.groupBy("word").agg(F.count("*").alias("hosts"))


def fit(pages: DataFrame | None = None) -> Model:
    """The unigram model of all pages' texts (of the examples alone without any), and naive Bayes of the examples.

    At most 1 / LEAST_SHARE words reach the driver, however many pages there are.
    """
    block, allow = Counter(TOKENS.findall(BLOCK_EXAMPLES)), Counter(TOKENS.findall(ALLOW_EXAMPLES))
    both = block + allow
    examples = sum(both.values())
    shares, total = {w: n / examples for w, n in both.items()}, float(examples)
    if pages is not None:
        counts = common.written(host_words(pages), "host-words")
        total = float(counts.agg(F.sum("hosts")).first()[0] or 0)
        least = max(LEAST_HOSTS, total * LEAST_SHARE)
        learned = {r[0]: r[1] / total * (1 - EXAMPLE_SHARE) for r in counts.where(F.col("hosts") >= least).collect()} if total else {}
        shares = {w: learned.get(w, 0.0) + EXAMPLE_SHARE * shares.get(w, 0.0) for w in learned.keys() | shares.keys()}
        total = max(total, examples / EXAMPLE_SHARE)
    model = Model({w: math.log(p) for w, p in shares.items()}, total, longest=max(map(len, shares)))
    nb, na, size = sum(block.values()), sum(allow.values()), len(both)
    for w in both:
        model.evidence[w] = math.log((block[w] + ALPHA) / (nb + ALPHA * size)) - math.log(
            (allow[w] + ALPHA) / (na + ALPHA * size)
        )
    model.prior = math.log(BLOCK_PRIOR / (1 - BLOCK_PRIOR))
    return model


def judge_urls(pages: DataFrame, rules=RULES, model: Model | None = None) -> DataFrame:
    """page_id, host, path, rule, verdict, block_score of every url.

    Without a ``model``, one is fitted on the pages if they have an html column. A null url has empty
    host and path and is judged like any other (allowed, by the prior). Rows are judged one by one:
    repeated rows and null ids are ordinary. Ids are whole numbers, or text of whole numbers; other
    columns, whatever their names, are ignored. Long urls take time in proportion to their length.
    """
    shared = pages.sparkSession.sparkContext.broadcast(model or fit(pages if "html" in pages.columns else None))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, cache = shared.value, {}
        for batch in batches:
            cols: tuple[list, ...] = ([], [], [], [], [])
            for url in batch.column(1).to_pylist():
                host, path = split_url(url)
                odds = model.block_odds(host, path, cache)
                rule = match_rule(host, path, rules)
                verdict = rule[1] if rule else ("block" if odds > 0 else "allow")
                for c, x in zip(cols, (host, path, rule[0] if rule else None, verdict, 1 / (1 + math.exp(-max(-30.0, min(30.0, odds)))))):
                    c.append(x)
            kinds = (pa.string(),) * 4 + (pa.float64(),)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(c, k) for c, k in zip(cols, kinds))],
                names=["page_id", "host", "path", "rule", "verdict", "block_score"],
            )

    source = common.spread(pages.select(F.col("page_id").cast("long"), "url"))
    return source.mapInArrow(run, "page_id long, host string, path string, rule string, verdict string, block_score double")
