"""Operator 12: license scans by an exact set-similarity join of text blocks with notice templates (native).

Texts become lower-case words, and blocks of ``2 * step`` words every ``step`` words, so that every passage of up to
``step`` + 1 words stands whole in a block.  A block matches a template when it holds at least ``threshold`` of the
template's distinct words (containment).  Templates' words are ordered by the number of documents that hold them, counted
over the whole table, rarest first.  With k words and a least overlap of a = ceil(threshold * k), a block that matches
holds one of the first k - a + 1 words (prefix filter), at least a template words in all (length filter), and behind the
first shared word enough words on both sides (positional filter); blocks that pass are verified word by word.  Only
blocks around such rare words are ever built.  A phrase is a template that must be held whole and in order: its rarest
word finds its places, then its words are compared.

Two scans (document counts of template words, at most one row a word; then matching) and no shuffle of texts: what is
sent around is bounded by the templates.

Defined results: null text is empty (0 words, no labels, null first_word and last_word, score 0); rows that repeat or share a
doc_id, or have none, are scanned row by row; words equally frequent are ordered by themselves, ties of score keep all
labels; other columns are kept whatever their names, the operator's own begin with license_ and replace columns of these
names; an empty table gives no rows.
"""

from __future__ import annotations

import math
import string
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chalkline.llm.common import quoted

BETWEEN = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
STEP, THRESHOLD = 64, 0.8


@dataclass(frozen=True)
class Template:
    label: str
    text: str

    @property
    def words(self) -> list[str]:
        return self.text.split()


#: Phrases that give a label wherever they stand.
PHRASES = (Template("mit", "mit license"), Template("apache", "apache license"), Template("gpl", "general public license"))

#: Opening sentences of public notices, in lower case and without signs.
NOTICES = (
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files to deal in the software without restriction"),
    Template("mit", "released under the mit license"),
    Template("apache", "licensed under the apache license version 2 0 you may not use this file except in compliance with the license"),
    Template("apache", "licensed under the apache license version 2 0"),
    Template("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    Template("gpl", "this work is licensed under the gnu general public license version 3"),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    Template("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"),
    Template("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    Template("cc", "this work is licensed under a creative commons attribution 4 0 international license"),
    Template("cc", "licensed under cc by nc 4 0"),
    Template("reserved", "all rights reserved no part of this publication may be reproduced distributed or transmitted in any form without prior written permission"),
)


def words_of(text: Column) -> Column:
    """Runs of digits, letters and all characters beyond ASCII; only A-Z are lower-cased."""
    lower = F.translate(F.coalesce(text, F.lit("")), string.ascii_uppercase, string.ascii_lowercase)
    return F.filter(F.split(lower, BETWEEN), lambda w: w != "")


def _strings(words: Sequence[str]) -> Column:
    return F.array(*map(F.lit, words)) if words else F.array().cast("array<string>")


def rarest_first(docs: DataFrame, templates: Sequence[Template]) -> list[str]:
    """All words of the templates, by the number of documents that hold them; one row a word reaches the driver."""
    vocabulary = sorted({w for t in templates for w in t.words})
    if not vocabulary:
        return []
    held = docs.select(F.explode(F.array_intersect(_strings(vocabulary), words_of(F.col("text")))).alias("word"))
    counts = {r["word"]: r["count"] for r in held.groupBy("word").count().collect()}
    return sorted(vocabulary, key=lambda w: (counts.get(w, 0), w))


def _template_column(templates: Sequence[Template], order: Sequence[str], threshold: float) -> Column:
    """array<struct<label, words (rarest first), prefix, least>>"""
    rank, made = {w: i for i, w in enumerate(order)}, []
    for t in templates:
        words = sorted(set(t.words), key=rank.__getitem__)
        least = max(1, math.ceil(round(threshold * len(words), 9)))
        made.append(F.struct(F.lit(t.label).alias("label"), _strings(words).alias("words"), _strings(words[: len(words) - least + 1]).alias("prefix"), F.lit(least).alias("least")))
    return F.array(*made)


def _phrase_column(phrases: Sequence[Template], order: Sequence[str]) -> Column:
    """array<struct<label, words (as they stand), rare, offset>>"""
    rank, made = {w: i for i, w in enumerate(order)}, []
    for p in phrases:
        rare = min(p.words, key=rank.__getitem__)
        made.append(F.struct(F.lit(p.label).alias("label"), _strings(p.words).alias("words"), F.lit(rare).alias("rare"), F.lit(p.words.index(rare)).alias("offset")))
    return F.array(*made)


def _contained(held: Column, t: Column) -> Column:
    """Length, prefix and positional filters, then the verification; held is in the global order."""
    first = F.get(F.filter(t["prefix"], lambda w: F.array_contains(held, w)), 0)
    behind = F.least(F.size(t["words"]) - F.array_position(t["words"], first), F.size(held) - F.array_position(held, first)) + 1
    return (F.size(held) >= t["least"]) & F.arrays_overlap(t["prefix"], held) & (behind >= t["least"]) & (F.size(F.array_intersect(t["words"], held)) >= t["least"])


def scan_licenses(docs: DataFrame, phrases: Sequence[Template] = PHRASES, notices: Sequence[Template] = NOTICES, threshold: float = THRESHOLD, step: int = STEP) -> DataFrame:
    """docs with license_words (their number), license_places array<struct<at, label>>: where phrases start, and
    license_blocks array<struct<start, label, likeness>>: word blocks that hold a notice, with its containment."""
    order = rarest_first(docs, [*phrases, *notices])
    templates, sought = _template_column(notices, order, threshold), _phrase_column(phrases, order)
    rank = {w: i for i, w in enumerate(order)}
    rare = {min(p.words, key=rank.__getitem__) for p in phrases}
    for t in notices:
        words = sorted(set(t.words), key=rank.__getitem__)
        rare.update(words[: len(words) - max(1, math.ceil(round(threshold * len(words), 9))) + 1])
    seeds, vocabulary = _strings(sorted(rare)), _strings(order)
    own = ("license_words", "license_places", "license_blocks")
    kept = [c for c in docs.columns if c not in own]
    row = F.struct(*[F.col(quoted(c)) for c in kept]).alias("row")

    worded = docs.select(row, words_of(F.col("text")).alias("words"))
    none = F.array().cast("array<int>")
    hits = F.when(F.arrays_overlap("words", seeds), F.filter(F.sequence(F.lit(0), F.size("words") - 1), lambda p: F.array_contains(seeds, F.get("words", p)))).otherwise(none)
    seeded = worded.select("row", "words", hits.alias("hits"))

    def at_place(p: Column) -> Column:
        whole = lambda f: (F.get("words", p) == f["rare"]) & (p >= f["offset"]) & (F.slice("words", F.greatest(p - f["offset"], F.lit(0)) + 1, F.size(f["words"])) == f["words"])
        return F.transform(F.filter(sought, whole), lambda f: F.struct((p - f["offset"]).alias("at"), f["label"].alias("label")))

    numbers = F.array_distinct(F.flatten(F.transform("hits", lambda p: F.array(F.floor(p / step).cast("int"), F.greatest(F.floor(p / step).cast("int") - 1, F.lit(0))))))
    blocks = F.transform(numbers, lambda b: F.struct((b * step).alias("start"), F.array_intersect(vocabulary, F.slice("words", b * step + 1, 2 * step)).alias("held")))
    places = F.flatten(F.transform("hits", at_place)) if phrases else F.lit(None).cast("array<struct<at:int,label:string>>")
    found = seeded.select("row", F.size("words").cast("long").alias("n"), places.alias("places"), blocks.alias("blocks"))

    def matches(b: Column) -> Column:
        passed = F.filter(templates, lambda t: _contained(b["held"], t))
        return F.transform(passed, lambda t: F.struct(b["start"].alias("start"), t["label"].alias("label"), (F.size(F.array_intersect(t["words"], b["held"])) / F.size(t["words"])).alias("likeness")))

    matched = F.flatten(F.transform("blocks", matches)) if notices else F.lit(None).cast("array<struct<start:int,label:string,likeness:double>>")
    return found.select(*[F.col("row")[c].alias(c) for c in kept], F.col("n").alias(own[0]), F.coalesce("places", F.array()).alias(own[1]), F.coalesce(matched, F.array()).alias(own[2]))


def license_labels(docs: DataFrame) -> DataFrame:
    """One digest row per document: places of the phrases, labels of phrases and notices, and the best likeness."""
    scanned = scan_licenses(docs.select("doc_id", "text")).drop("text")
    at, labels = F.transform("license_places", lambda p: p["at"]), F.transform("license_places", lambda p: p["label"])
    listed = lambda names: F.array_join(F.array_sort(F.array_distinct(names)), ",")
    return scanned.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("license_words").alias("n_words"), F.size("license_places").cast("long").alias("n_base"),
        F.array_min(at).cast("long").alias("first_word"), F.array_max(at).cast("long").alias("last_word"), listed(labels).alias("base_labels"),
        listed(F.concat(labels, F.transform("license_blocks", lambda b: b["label"]))).alias("labels"),
        F.when(F.size("license_places") > 0, 1.0).otherwise(F.coalesce(F.array_max(F.transform("license_blocks", lambda b: b["likeness"])), F.lit(0.0))).alias("score"),
    )


def oracle(phrases: Sequence[Template] = PHRASES, notices: Sequence[Template] = NOTICES, threshold: float = THRESHOLD, step: int = STEP) -> str:
    """DuckDB SQL of license_labels: every block against every notice, every place against every phrase."""
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    listed = lambda words: "[" + ", ".join(map(quote, words)) + "]"
    rows = lambda ts, distinct: ", ".join(f"({quote(t.label)}, {listed(sorted(set(t.words)) if distinct else t.words)})" for t in ts)
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
phrase(label, words) AS (VALUES {rows(phrases, False)}), notice(label, words) AS (VALUES {rows(notices, True)}),
pos AS (SELECT r, w, unnest(range(len(w))) AS p FROM d),
place AS (SELECT r, p, label FROM pos, phrase WHERE w[p + 1] = words[1] AND w[p + 1 : p + len(words)] = words),
block AS (SELECT r, list_distinct(w[p + 1 : p + {2 * step}]) AS held FROM pos WHERE p % {step} = 0),
hit AS (SELECT r, label, len(list_intersect(words, held)) AS n, len(words) AS k FROM block, notice),
found AS (SELECT r, label, n::DOUBLE / k AS likeness FROM hit WHERE n >= ceil(round({threshold} * k, 9))),
base AS (SELECT r, count(*) AS n_base, min(p) AS first_word, max(p) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM place GROUP BY r),
both_ AS (SELECT r, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM (SELECT r, label FROM place UNION ALL SELECT r, label FROM found) GROUP BY r),
best AS (SELECT r, max(likeness) AS likeness FROM found GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word, coalesce(base_labels, '') AS base_labels,
  coalesce(labels, '') AS labels, CASE WHEN n_base > 0 THEN 1.0 ELSE coalesce(likeness, 0.0) END::DOUBLE AS score
FROM d LEFT JOIN base USING (r) LEFT JOIN both_ USING (r) LEFT JOIN best USING (r)
"""


ORACLE = oracle()
