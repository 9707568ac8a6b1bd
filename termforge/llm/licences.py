"""Licence scan by Dice coefficient of word bigrams, in DataFrame functions only.

Units of a text (its lines, and its paragraphs of several lines) and licence templates are
normalised to words; a template is a candidate only for units whose number of distinct bigrams
could reach the threshold at all, and candidates are compared by their bigram sets.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from termforge.llm import common
from termforge.llm.decontam import lower_ascii

THRESHOLD = 0.75
WORD = "[0-9a-z]+"
#: Words that ordinary texts hold too often to tell a licence.
COMMON = frozenset(
    "a above all and any appear as at be by can cc copy either following for form from free full in including international is may of on or "
    "possible provided public published purpose related released source subject that terms the this to under use v version was with work you".split()
)

# Usual notices and the opening or characteristic paragraphs of licences.
TEMPLATES = [
    ("AGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("All-Rights-Reserved", "All rights reserved."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0'),
    ("BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("BSD", "Released under the BSD License."),
    ("BSD", "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS AS IS AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC0-1.0", "To the extent possible under law, the author has dedicated all copyright and related and neighboring rights to this software to the public domain worldwide."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("LGPL-2.1", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("LGPL-2.1", "This work is licensed under the GNU Lesser General Public License, version 2.1."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("LGPL-3.0", "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
]


def _bigrams(df: DataFrame, text: str) -> DataFrame:
    """``df`` with ``bigrams`` (distinct word pairs in order) and ``numbers`` instead of the text column."""
    keep = [c for c in df.columns if c != text]
    words = F.regexp_extract_all(lower_ascii(F.col(text)), F.lit(WORD), F.lit(0))
    pairs = F.transform(
        F.when(F.size("w") >= 2, F.sequence(F.lit(0), F.size("w") - 2)).otherwise(F.array().cast("array<int>")),
        lambda i: F.concat_ws(" ", F.get("w", i), F.get("w", i + 1)),
    )
    numbers = F.filter(F.array_distinct("w"), lambda x: x.rlike("^[0-9]+$"))
    return df.select(*keep, words.alias("w")).select(*keep, F.array_distinct(pairs).alias("bigrams"), numbers.alias("numbers"))


def units(text: Column) -> Column:
    """Lines, and paragraphs (parted by empty lines) of more than one line."""
    lines = F.split(text, "\n")
    paragraphs = F.filter(F.split(text, r"\n[ \t]*\n"), lambda p: F.trim(p, F.lit("\n")).contains("\n"))
    return F.array_distinct(F.concat(lines, paragraphs))


def telling_words(templates: list[tuple[str, str]], threshold: float) -> list[str]:
    """Words of which every matching unit holds at least one.

    A match needs more than a share of the template's bigrams, threshold / (4 - 2 threshold) of unit and
    template together and so threshold / (2 - threshold) of the template's own. Words are chosen, the
    longest first, until the bigrams with a chosen word are more than a match may lack.
    """
    chosen: set[str] = set()
    for _, text in templates:
        w = re.findall(WORD, text.lower())
        pairs = set(zip(w, w[1:]))
        spare = len(pairs) * (1 - threshold / (2 - threshold))
        for x in sorted(set(w), key=lambda x: (x not in chosen, x in COMMON, -len(x), x)):
            if sum(a in chosen or b in chosen for a, b in pairs) > spare + 1e-9:
                break
            chosen.add(x)
    return sorted(chosen)


def _tells(text: Column, words: list[str]) -> Column:
    """Whether a text holds one of the words anywhere; it is lower-cased once for all of them.

    The lambda binds the lower-cased text: as a column of its own, the optimizer would push the filter
    below it and lower-case the text for every word. ``lower`` also folds some letters beyond ASCII
    into a-z, so more may pass than hold a word, and never less.
    """
    any_of = lambda x: F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(x, w))
    return F.get(F.transform(F.array(F.lower(text)), any_of), F.lit(0))


def scan(docs: DataFrame, templates: list[tuple[str, str]] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, n_units (that match a template), licence and score of the best match, licences (all, sorted).

    A unit must hold the template's numbers, which tell versions apart. Every document has a row. Null
    and empty texts and texts without a licence have n_units 0, null licence, score 0 and an empty
    ``licences``. Of equal scores the licence first in the alphabet holds. Repeated rows of one id
    count as one document, whose units are those of all its rows; a null id is an id of its own, and
    ids may be of any type. Other columns, whatever their names, are ignored. Texts of any length are
    scanned whole, unit by unit. Templates are a fixed, small list and may be broadcast.
    """
    spark = docs.sparkSession
    docs = common.spread(docs.select("doc_id", "text"))
    known = spark.createDataFrame([(i, a, t) for i, (a, t) in enumerate(templates)], "template int, licence string, text string")
    known = _bigrams(known, "text").withColumn("m", F.size("bigrams")).where("m > 0")
    # sizes n that can reach the threshold: 2 min(n, m) >= threshold (n + m)
    low = F.ceil(F.col("m") * threshold / (2 - threshold) - 1e-9).cast("int")
    high = F.floor(F.col("m") * (2 - threshold) / threshold + 1e-9).cast("int")
    by_size = known.select(
        "licence", "m", F.col("bigrams").alias("wanted"), F.col("numbers").alias("needed"), F.explode(F.sequence(F.greatest(low, F.lit(1)), high)).alias("n")
    )
    everyone = docs.select("doc_id").distinct()
    # most texts, and most units of the others, hold no telling word and need no bigrams
    words = telling_words(templates, threshold)
    # an outer explode: for an inner one the optimizer would compute the units twice, to test their number
    found = docs.where(_tells(F.col("text"), words)).select("doc_id", F.explode_outer(units(F.col("text"))).alias("unit"))
    found = _bigrams(found.where(_tells(F.col("unit"), words)), "unit")
    matches = (
        # a key that cannot be null: else a test for null would be pushed down and compute the arrays again
        found.select("doc_id", "bigrams", "numbers", F.coalesce(F.size("bigrams"), F.lit(0)).alias("n"))
        .join(F.broadcast(by_size), "n")
        .select(
            "doc_id",
            "licence",
            F.xxhash64(F.array_sort("bigrams")).alias("unit"),
            (2 * F.size(F.array_intersect("bigrams", "wanted")) / (F.col("n") + F.col("m"))).alias("dice"),
            (F.size(F.array_except("needed", "numbers")) == 0).alias("versioned"),
        )
        .where((F.col("dice") >= threshold) & F.col("versioned"))
    )
    best = matches.groupBy("doc_id").agg(
        F.count_distinct("unit").alias("n_units"),
        F.max("dice").alias("score"),
        F.array_sort(F.collect_set("licence")).alias("ids"),
        F.collect_set(F.struct("dice", "licence")).alias("pairs"),
    )
    best = best.select(
        "doc_id",
        "n_units",
        "score",
        F.array_min(F.transform(F.filter("pairs", lambda p: p["dice"] == F.col("score")), lambda p: p["licence"])).alias("licence"),
        F.array_join("ids", ",").alias("licences"),
    )
    out = everyone.join(best, everyone["doc_id"].eqNullSafe(best["doc_id"]), "left")
    return out.select(
        everyone["doc_id"],
        F.coalesce("n_units", F.lit(0).cast("long")).alias("n_units"),
        "licence",
        F.coalesce("score", F.lit(0.0)).alias("score"),
        F.coalesce("licences", F.lit("")).alias("licences"),
    )


def scan_passages(docs: DataFrame, templates: list[tuple[str, str]] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, licence and score of the best match, licences (all, sorted), wherever in a text a notice stands.

    Every run of words of a template's size range is compared, across sentences and lines. Only runs that
    begin and end with a bigram of the template are: others score no more than the one inside them. A run
    must hold the template's numbers, and of overlapping runs of different licences the best holds.
    Rows, nulls and repeated ids are as in ``scan``.
    """
    spark = docs.sparkSession
    docs = common.spread(docs.select("doc_id", "text"))
    everyone = docs.select("doc_id").distinct()
    known = []
    for licence, text in templates:
        w = re.findall(WORD, text.lower())
        wanted = sorted({f"{a} {b}" for a, b in zip(w, w[1:])})
        m = len(wanted)
        low, high = math.ceil(m * threshold / (2 - threshold) - 1e-9), math.floor(m * (2 - threshold) / threshold + 1e-9)
        known.append((licence, wanted, sorted({x for x in w if x.isdigit()}), m, low, high))
    known = spark.createDataFrame(known, "licence string, wanted array<string>, numbers array<string>, m int, low int, high int")
    found = docs.where(_tells(F.col("text"), telling_words(templates, threshold)))
    found = found.select("doc_id", F.xxhash64("text").alias("row"), F.regexp_extract_all(lower_ascii(F.col("text")), F.lit(WORD), F.lit(0)).alias("w"))
    pairs = F.zip_with("w", F.slice("w", 2, F.greatest(F.size("w"), F.lit(1))), lambda a, b: F.concat(a, F.lit(" "), b))
    # the last word has no follower and its pair is null
    found = found.select("doc_id", "row", F.filter(pairs, lambda p: p.isNotNull()).alias("b"))
    shared = lambda c: F.size(F.array_intersect(c, "wanted"))
    found = found.join(F.broadcast(known), F.size("b") >= F.col("low")).where(shared("b") >= F.col("low"))
    starts = F.filter(F.transform("b", lambda p, i: F.when(F.array_contains("wanted", p), i)), lambda i: i.isNotNull())
    found = found.withColumn("first", F.explode_outer(starts)).withColumn("near", F.slice("b", F.col("first") + 1, F.col("high")))
    found = found.drop("b").where(shared("near") >= F.col("low"))
    ends = F.filter(F.transform("near", lambda p, i: F.when(F.array_contains("wanted", p), i + 1)), lambda i: i >= F.col("low"))
    found = found.withColumn("n", F.explode_outer(ends)).where("n is not null").withColumn("run", F.slice("near", 1, F.col("n")))
    dice = 2 * shared("run") / (F.size(F.array_distinct("run")) + F.col("m"))
    words = F.split(F.array_join("run", " "), " ")
    found = found.where(F.size(F.array_except("numbers", words)) == 0).withColumn("dice", dice).where(F.col("dice") >= threshold)
    # the best run of every first word, the shortest of equal ones
    best = found.groupBy("doc_id", "row", "licence", "first").agg(
        F.max(F.struct("dice", (-F.col("n")).alias("less"))).alias("x")
    )
    runs = best.groupBy("doc_id", "row").agg(
        F.collect_list(F.struct("licence", "first", (F.col("first") - F.col("x.less")).alias("end"), F.col("x.dice").alias("dice"))).alias("runs")
    )

    def beaten(r: Column) -> Column:
        return F.exists(
            "runs", lambda o: (o["licence"] != r["licence"]) & (o["dice"] > r["dice"]) & (o["first"] < r["end"]) & (r["first"] < o["end"])
        )

    kept = runs.select("doc_id", F.explode_outer(F.filter("runs", lambda r: ~beaten(r))).alias("r")).where("r is not null")
    best = kept.groupBy("doc_id").agg(
        F.min(F.struct((-F.col("r.dice")).alias("less"), "r.licence")).alias("x"), F.array_sort(F.collect_set("r.licence")).alias("ids")
    )
    out = everyone.join(best, everyone["doc_id"].eqNullSafe(best["doc_id"]), "left")
    return out.select(
        everyone["doc_id"],
        F.col("x.licence").alias("licence"),
        F.coalesce(-F.col("x.less"), F.lit(0.0)).alias("score"),
        F.coalesce(F.array_join("ids", ","), F.lit("")).alias("licences"),
    )
