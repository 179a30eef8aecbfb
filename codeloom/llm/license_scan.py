"""License scans: MinHash bands over overlapping text windows, then exact
shingle containment (native).

A template of L words is looked for in windows of 1.5 L words that start every
0.5 L words, so some window covers any place where it stands. Templates are
short notices and whole license texts, so windows have from nine to thousands
of words. Windows and templates are sets of word shingles; the MinHash values
of a window are single bands. A window that holds ``containment`` of a
template has at least the Jaccard similarity ``_floor`` with it, and so many
bands are taken that all of them miss with chance ``MISS`` at most. Retrieved
pairs are confirmed by exact containment.

Most texts hold no license at all. A text can only match a template if it
holds a word of each of its anchor sets: a set is chosen so that the shingles
without any of its words are fewer than ``containment`` of the template, and
long templates have several sets. This test loses nothing. Long texts go in
chunks of ``CHUNK`` words with as many more as the longest window needs, so no
row grows beyond a bound but the text's own words.
"""

from __future__ import annotations

import re
from functools import lru_cache, reduce
from math import ceil, log
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS

WIDTH = 3
CONTAINMENT = 0.8
#: Chance that all bands miss a window at the threshold.
MISS = 1e-6

#: Words of a chunk in which windows start.
CHUNK = 8192
#: Anchor sets of a template, at most.
SETS = 4

#: Short public notices by the name of their license.
NOTICES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "MIT": "Released under the MIT License.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "BSD": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "MIT-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction",
    "Apache-2.0-notice": "you may not use this file except in compliance with the License. You may obtain a copy of the License at",
    "GPL-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
    "ISC-grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "All-rights-reserved": "All rights reserved. No part of this publication may be reproduced",
}
#: Notices and whole texts; the latter are named by their SPDX id and ``text``.
TEMPLATES = NOTICES | {f"{p.stem} text": p.read_text("utf-8") for p in sorted((Path(__file__).parent / "license_texts").glob("*.txt"))}
_COMMON = {"the", "a", "of", "to", "and", "or", "in", "is", "with", "under", "this", "at", "by", "be", "for", "you", "any", "it", "as", "on", "are", "not", "may", "that"}


def words_of(text: str) -> list[str]:
    return re.findall(r"[a-z0-9]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text))


def template_shingles(text: str, width: int = WIDTH) -> list[str]:
    w = words_of(text)
    return list(dict.fromkeys(" ".join(w[i : i + width]) for i in range(max(1, len(w) - width + 1))))


@lru_cache(4096)
def anchor_sets(text: str, containment: float = CONTAINMENT, width: int = WIDTH, most: int = SETS) -> tuple[tuple[str, ...], ...]:
    """Disjoint sets of words; any text that holds ``containment`` of the
    shingles has a word of each. At least one set, if the text has words."""
    shingles = [set(s.split()) for s in template_shingles(text, width)]
    allowed = ceil(containment * len(shingles)) - 1  # shingles that may lack the words of a set
    used: set[str] = set()
    out: list[tuple[str, ...]] = []
    while len(out) < most:
        left, chosen = shingles, []
        while len(left) > allowed:
            counts: dict[str, int] = {}
            for s in left:
                for w in s - used:
                    counts[w] = counts.get(w, 0) + 1
            if not counts:
                break
            best = max(counts, key=lambda w: (w not in _COMMON, min(len(w), 7), counts[w], len(w), w))
            chosen.append(best)
            used.add(best)
            left = [s for s in left if best not in s]
        if len(left) > allowed or out and (len(chosen) > 60 or _COMMON & set(chosen)):
            break
        out.append(tuple(sorted(chosen)))
    return tuple(out)


def anchors(text: str, containment: float = CONTAINMENT, width: int = WIDTH) -> list[str]:
    """Words one of which stands in any text that holds ``containment`` of the shingles."""
    return list(anchor_sets(text, containment, width, 1)[0])


def joint_anchors(templates: list[str], containment: float = CONTAINMENT) -> list[str]:
    """Few words, one of which stands in any text that may match any template."""
    left = [[set(x.split()) for x in template_shingles(t)] for t in templates]
    allowed = [ceil(containment * len(x)) - 1 for x in left]
    chosen: list[str] = []
    while any(len(x) > n for x, n in zip(left, allowed)):
        gain: dict[str, float] = {}
        for x, n in zip(left, allowed):
            if len(x) > n:
                counts: dict[str, int] = {}
                for s in x:
                    for w in s:
                        counts[w] = counts.get(w, 0) + 1
                for w, c in counts.items():
                    gain[w] = gain.get(w, 0) + min(1.0, c / (len(x) - n))
        best = max(gain, key=lambda w: (w not in _COMMON, len(w) > 6, gain[w], len(w), w))
        chosen.append(best)
        left = [[s for s in x if best not in s] for x in left]
    return sorted(chosen)


def _pattern(words: list[str]) -> str:
    """An expression for any of the words, branching once a letter."""
    tails: dict[str, list[str]] = {}
    for w in words:
        tails.setdefault(w[:1], []).append(w[1:])
    parts = [re.escape(c) + (_pattern(t) if t != [""] else "") for c, t in sorted(tails.items()) if c]
    inner = parts[0] if len(parts) == 1 else "(?:" + "|".join(parts) + ")"
    return f"(?:{inner})?" if "" in tails and parts else inner if parts else ""


def _floor(size: int, words: int, containment: float) -> float:
    """Least Jaccard similarity of a matching window of so many words."""
    held = ceil(containment * size)
    return held / (words - WIDTH + 1 + size - held)


def _lowered(text: str) -> Column:
    return F.translate(F.col(text), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


class _Kind:
    """Templates with one window length: its step, bands and anchor sets."""

    def __init__(self, window: int):
        self.window, self.step, self.bands = window, 1 << 30, 1
        self.sets: list[tuple[tuple[str, ...], ...]] = []

    def possible(self, words: Column) -> Column:
        """Whether an array of words may hold one of the templates."""
        one = lambda sets: reduce(lambda a, b: a & b, (F.arrays_overlap(words, F.array(*map(F.lit, s))) for s in sets))
        return reduce(lambda a, b: a | b, map(one, self.sets))


def _kinds(templates: dict[str, str]) -> tuple[list[tuple[str, int, list[str]]], list[_Kind]]:
    """(license, window, shingles) of each template with words, and the kinds."""
    rows, kinds = [], {}
    for name, text in templates.items():
        s, n = template_shingles(text), len(words_of(text))
        if not n:
            continue
        window = max(WIDTH, ceil(1.5 * n))
        k = kinds.setdefault(window, _Kind(window))
        k.step = min(k.step, max(1, n // 2))
        k.bands = max(k.bands, ceil(log(MISS) / log(1 - _floor(len(s), window, CONTAINMENT) + 1e-12)))
        sets = anchor_sets(text)
        if sets not in k.sets:
            k.sets.append(sets)
        rows.append((name, window, s))
    return rows, list(kinds.values())


def _bands(shingles: str, most: int) -> Column:
    hashed = F.array(F.transform(shingles, lambda s: F.xxhash64(s)))  # bound to a variable: hashed once, not once a band
    minima = lambda hs: F.transform(F.sequence(F.lit(1), F.lit(most)), lambda j: F.array_min(F.transform(hs, lambda h: F.xxhash64(h, j))))
    return F.transform(hashed, minima)[0]


def scan(docs: DataFrame, templates: dict[str, str] | None = None) -> DataFrame:
    """doc_id, license, first_word, last_word, containment for every window of
    every text that holds at least ``CONTAINMENT`` of a template's shingles.

    Words are runs of a-z and 0-9 after lower-casing A-Z, counted from 0; a
    window near the end of a text is shorter. Null, empty and word-less texts
    give no rows, nor does an empty table; repeated rows repeat their matches
    once each (equal rows are not told apart). Other columns are ignored.
    """
    spark = docs.sparkSession
    templates = TEMPLATES if templates is None else templates
    rows, kinds = _kinds(templates)
    if not kinds:
        return spark.createDataFrame([], "doc_id long, license string, first_word int, last_word int, containment double")
    table = spark.createDataFrame(rows, "license string, window int, needed array<string>")
    pieces = joint_anchors([t for t in templates.values() if words_of(t)])
    kept = docs.select("doc_id", "text").filter(F.col("text").rlike(rf"(?i)(?<![a-z0-9]){_pattern(pieces)}(?![a-z0-9])"))
    kept = kept.select("doc_id", F.regexp_extract_all(_lowered("text"), F.lit("[a-z0-9]+"), F.lit(0)).alias("w"))
    longest = max(k.window for k in kinds)
    chunks = F.transform(
        F.sequence(F.lit(0), F.greatest(F.lit(0), F.size("w") - 1), F.lit(CHUNK)),
        lambda i: F.struct(i.alias("at"), F.size("w").alias("n"), F.slice("w", i + 1, CHUNK + longest).alias("part")),
    )
    chunk = kept.select("doc_id", F.explode(chunks).alias("c")).select("doc_id", "c.at", "c.n", F.col("c.part").alias("w"))

    def windows(k: _Kind) -> Column:
        """Windows that start in the chunk and may match."""
        first = F.ceil(F.col("at") / k.step).cast("int") * k.step
        last = F.least(F.greatest(F.lit(0), F.col("n") - F.lit(max(1, k.window - k.step))), F.col("at") + CHUNK - 1)
        starts = F.when(first <= last, F.sequence(first, F.greatest(first, last), F.lit(k.step))).otherwise(F.array().cast("array<int>"))
        all_ = F.transform(starts, lambda i: F.struct(i.alias("first"), F.lit(k.window).alias("window"), F.slice("w", i - F.col("at") + 1, k.window).alias("part")))
        return F.when(k.possible(F.col("w")), F.filter(all_, lambda x: k.possible(x["part"]))).otherwise(F.filter(all_, lambda x: F.lit(False)))

    spread = chunk.select("doc_id", F.explode(F.concat(*map(windows, kinds))).alias("x")).select("doc_id", "x.first", "x.window", "x.part")
    shingles = F.array_distinct(
        F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("part") - WIDTH + 1)), lambda i: F.array_join(F.slice("part", i, WIDTH), " "))
    )
    most = max(k.bands for k in kinds)
    index = table.select("license", "window", F.posexplode(_bands("needed", most)).alias("band", "value"))
    small = len(rows) * most <= BROADCAST_ROWS  # grows with the templates alone
    index, table = (F.broadcast(index), F.broadcast(table)) if small else (index, table)
    spread = spread.withColumn("held", shingles)
    found = (
        spread.select("doc_id", "first", "window", "held", F.size("part").alias("length"), F.posexplode(_bands("held", most)).alias("band", "value"))
        .join(index, ["window", "band", "value"])
        .dropDuplicates(["doc_id", "first", "license"])
        .join(table.select("license", "needed"), "license")
        .withColumn("containment", F.size(F.array_intersect("held", "needed")) / F.size("needed"))
        .filter(F.col("containment") >= CONTAINMENT)
    )
    return found.select("doc_id", "license", F.col("first").alias("first_word"), (F.col("first") + F.col("length") - 1).alias("last_word"), "containment").distinct()


def licenses(docs: DataFrame, templates: dict[str, str] | None = None) -> DataFrame:
    """doc_id, license, windows long, containment (the best): one row for each
    license found in a document."""
    return scan(docs, templates).groupBy("doc_id", "license").agg(F.count("*").alias("windows"), F.max("containment").alias("containment"))


def oracle() -> str:
    """The same without bands or anchors: every place of a template's shingle,
    all windows over it, and their distinct shingles, in SQL."""
    steps: dict[int, int] = {}
    for text in TEMPLATES.values():
        n = len(words_of(text))
        w = max(WIDTH, ceil(1.5 * n))
        steps[w] = min(max(1, n // 2), steps.get(w, 1 << 30))
    rows = []
    for name, text in TEMPLATES.items():
        w = max(WIDTH, ceil(1.5 * len(words_of(text))))
        rows.append(f"('{name}', {w}, {steps[w]}, {template_shingles(text)!r})")
    return f"""
    with t(license, win, step, needed) as (values {', '.join(rows)}),
    s as (select license, win, step, len(needed) as size, unnest(needed) as shingle from t),
    d as (
      select row_number() over () as r, doc_id,
        regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z0-9]+') as w from documents),
    p as (
      select r, doc_id, len(w) as n, unnest(generate_series(0, greatest(0, len(w) - {WIDTH}))) as pos, w from d where len(w) > 0),
    h as (
      select r, doc_id, n, pos, license, win, step, size, shingle from p join s on shingle = array_to_string(w[pos + 1 : pos + {WIDTH}], ' ')),
    f as (
      select *, unnest(generate_series(cast(ceil(greatest(0, pos + {WIDTH} - win) / step) as bigint) * step, least(pos, greatest(0, n - greatest(1, win - step))), step)) as first
      from h),
    m as (
      select distinct doc_id, license, first, share from (
        select r, doc_id, license, first, count(distinct shingle) / any_value(size) as share from f group by r, doc_id, license, first))
    select doc_id, license, cast(count(*) as bigint) as windows, max(share) as containment
    from m where share >= {CONTAINMENT} group by doc_id, license
    """
