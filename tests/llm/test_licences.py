from __future__ import annotations

import math
import random
import re

from termforge.llm import licences


def pairs(text):
    w = re.findall("[0-9a-z]+", text.lower())
    return set(zip(w, w[1:]))


def numbers(text):
    return {x for x in re.findall("[0-9a-z]+", text.lower()) if x.isdigit()}


def brute(texts):
    units = {u for t in texts if t is not None for u in t.split("\n") + [p for p in re.split(r"\n[ \t]*\n", t) if "\n" in p.strip("\n")]}
    best, ids, hit = (0.0, None), set(), set()
    for u in units:
        for name, t in licences.TEMPLATES:
            a, b = pairs(u), pairs(t)
            dice = 2 * len(a & b) / (len(a) + len(b)) if a else 0
            if dice >= licences.THRESHOLD and numbers(t) <= numbers(u):
                ids.add(name)
                hit.add(frozenset(a))
                best = max(best, (dice, name), key=lambda x: (x[0], [-ord(c) for c in x[1] or ""]))
    return len(hit), best[1], best[0], ",".join(sorted(ids))


def test_against_brute_force(spark):
    mit = next(t for a, t in licences.TEMPLATES if a == "MIT" and len(t) > 200)
    rows = [
        (1, "prose here\nLicensed under the Apache License, Version 2.0.\nmore"),
        (2, "RELEASED under the MIT license!\n\nAll rights reserved"),
        (3, "\n".join(mit[i : i + 60] for i in range(0, len(mit), 60)).replace("person", "person at all")),
        (4, "wrapped notice:\n\nThis work is licensed\nunder the GNU General\nPublic License, version 3.\n\nend"),
        (5, None), (6, ""), (7, "license " * 5000), (None, "All rights reserved."),
        (8, "This work is licensed under the GNU Lesser General Public License, version 3."),
        (9, "This work is licensed under the GNU General Public License, version 2."),
        (10, "This work is licensed under the GNU General Public License, version 9."),
    ]
    twice = [*rows, rows[0], (2, "Licensed under CC BY-NC 4.0.")]
    df = spark.createDataFrame([(*r, "x", 1) for r in twice], "doc_id long, text string, licence string, n int")
    got = {r.doc_id: (r.n_units, r.licence, round(r.score, 9), r.licences) for r in licences.scan(df).collect()}
    expected = {}
    for i in {r[0] for r in twice}:
        a, b, c, d = brute([t for j, t in twice if j == i])
        expected[i] = (a, b, round(c, 9), d)
    assert got == expected
    assert licences.scan(df.limit(0)).collect() == []


def test_passages(spark):
    mit = next(t for a, t in licences.TEMPLATES if a == "MIT" and len(t) > 200)
    rows = [
        (1, "Copyright 2024 Acme Corp. All rights reserved."),
        (2, "Released under the MIT License. See LICENSE for details."),
        (3, "words of prose " * 300 + mit.replace("person", "person at all") + " and more prose" * 300),
        (4, "This work is licensed under the GNU General Public License, version 2."),
        (5, "It is\nlicensed under the GNU Lesser General Public\nLicense, version 2.1, as said"),
        (6, "This work is licensed under the GNU General Public License, version 9."),
        (7, "See: licensed under CC BY-NC 4.0. Licensed under the Apache License, Version 2.0."),
        (8, None), (9, ""), (10, "license " * 3000), (None, "All rights reserved."), (1, "so it is released under the BSD license here"),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in licences.scan_passages(df).collect()}
    assert {i: r.licences for i, r in got.items()} == {
        1: "All-Rights-Reserved,BSD", 2: "MIT", 3: "MIT", 4: "GPL-2.0", 5: "LGPL-2.1", 6: "", 7: "Apache-2.0,CC-BY-NC-4.0",
        8: "", 9: "", 10: "", None: "All-Rights-Reserved",
    }
    assert got[2].score == got[4].score == 1 and got[8].licence is None and got[8].score == 0
    assert 0.75 <= got[3].score < 1 and got[1].licence == "All-Rights-Reserved"
    assert licences.scan_passages(df.limit(0)).collect() == []


def test_passages_against_every_run(spark):
    rng = random.Random(5)
    templates = [("A", "one two three four version 2"), ("B", "six seven eight one two")]
    texts = [" ".join(rng.choices("one two three four version 2 six seven eight".split(), k=rng.randrange(1, 9)) + rng.choice([[], "one two three four version 2".split()]) + rng.choices(["six", "x", "y"], k=3)) for _ in range(60)]
    got = {r.doc_id: round(r.score, 9) for r in licences.scan_passages(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), templates).collect()}
    for i, text in enumerate(texts):
        w, best = text.split(), 0.0
        for name, t in templates:
            m = len(pairs(t))
            for a in range(len(w)):
                for b in range(a + 2, min(len(w), a + 1 + math.floor(m * 5 / 3)) + 1):
                    run = pairs(" ".join(w[a:b]))
                    dice = 2 * len(run & pairs(t)) / (len(run) + m)
                    if dice >= 0.75 and (name == "B" or "2" in w[a:b]):
                        best = max(best, dice)
        assert got[i] == round(best, 9), text
