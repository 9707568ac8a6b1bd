from __future__ import annotations

import hashlib
import random
import re

from termforge.llm import decontam

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, span=10):
    out = []
    for doc_id, text in docs:
        w, hit, ids = words(text), set(), set()
        for item_id, t in items:
            b = words(t)
            n = min(span, len(b))
            windows = {tuple(b[i : i + n]) for i in range(len(b) - n + 1)} if n else set()
            for i in range(len(w) - n + 1 if n else 0):
                if tuple(w[i : i + n]) in windows:
                    hit.update(range(i, i + n))
                    ids.add(str(item_id))
        digest = hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest()
        out.append((doc_id, len(w), len(hit), len(ids), digest, bool(hit)))
    return sorted(out, key=repr)


def test_against_brute_force(spark):
    rng = random.Random(3)
    vocabulary = ["a", "be", "Ce", "dé", "É", "f9", "g", "h"]
    text = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(i, text(n)) for i, n in enumerate([30, 14, 10, 12, 3, 9, 0])] + [(7, None), (0, None)]
    items += [items[0], (100, items[1][1])]
    docs = [(i, text(rng.randrange(0, 120))) for i in range(30)]
    docs += [(40, f"{text(9)} {items[0][1]} {text(5)}, {items[2][1].upper()}"), (41, None), (42, ""), (None, items[3][1]), (43, "!!! ...")]
    docs += [(44, (items[1][1] + " ") * 300), docs[30]]
    d = spark.createDataFrame([(a, b, 1, "x") for a, b in docs], "doc_id long, text string, item int, fp string")
    i = spark.createDataFrame([(a, b, "y") for a, b in items], "item_id long, text string, doc_id string")
    got = sorted((tuple(r) for r in decontam.decontaminate(d, i).drop("text_hash").collect()), key=repr)
    assert got == brute(docs, items)


def test_empty_tables(spark):
    d = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    i = spark.createDataFrame([(1, "a b c")], "item_id long, text string")
    assert [r.n_hit for r in decontam.decontaminate(d, i).collect()] == [3]
    assert [(r.n_words, r.contaminated) for r in decontam.decontaminate(d, i.limit(0)).collect()] == [(3, False)]
    assert decontam.decontaminate(d.limit(0), i).collect() == []
