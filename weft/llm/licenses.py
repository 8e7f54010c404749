"""License scan: an exact set-similarity join of text blocks with license templates, in DataFrame functions only.

A block is BLOCK_WORDS consecutive words, and a new one begins after each half of them, so whatever lines
a notice is broken into, it stands whole in one block if it has no more words than that half. Template
and block are sets of words in one global order, the rarest word first; a block meets a template if it
contains at least ``threshold`` of the template's words. A prefix filter (a pair that qualifies shares a
word of both prefixes), a length filter and a positional filter leave few pairs, which are then verified
exactly. Texts are read once: documents that as a whole hold too few words of every template make no blocks.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .base import cut

#: Phrases and their labels.
PHRASES = (
    ("under the mit license", "mit"),
    ("apache license version 2", "apache-2"),
    ("cc by nc", "cc-by-nc"),
)
#: Notices and their labels.
TEMPLATES = (
    ("mit", "Released under the MIT License."),
    ("mit", "Licensed under the MIT License."),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("apache-2", "Licensed under the Apache License, Version 2.0."),
    ("apache-2", "you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0."),
    ("cc-by-nc", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("gpl-3", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl-3", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License version 3"),
    ("mpl-2", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
)
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Words of a block.
BLOCK_WORDS = 64
#: Rows of the templates' prefixes up to which they are broadcast; more are joined by a shuffle.
BROADCAST_ROWS = 20_000


def words_of(lowered: Column) -> Column:
    return F.array_remove(F.split(lowered, _BETWEEN), "")


def _template_words(text: str) -> list[str]:
    import re

    return sorted(set(re.findall(r"[a-z0-9\x80-\U0010ffff]+", text.translate(str.maketrans(_UPPER, _LOWER)))))


def _places(words: Column, lowered: Column, phrase: str) -> Column:
    """The indices of words at which the phrase's words stand; texts that lack one of them aren't searched."""
    parts = phrase.split(" ")
    k = len(parts)
    has = F.size(words) >= k
    for p in sorted(set(parts), key=len, reverse=True)[:2]:
        has = has & F.contains(lowered, F.lit(p))

    def stands(i: Column) -> Column:
        test = F.get(words, i) == parts[0]
        for j in range(1, k):
            test = test & (F.get(words, i + j) == parts[j])
        return test

    return F.when(has, F.filter(F.sequence(F.lit(0), F.size(words) - k), stands)).otherwise(F.array().cast("array<int>"))


def scan_licenses(docs: DataFrame, phrases: Sequence[tuple[str, str]] = PHRASES, templates: Sequence[tuple[str, str]] = TEMPLATES, threshold: float = 0.9) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score) of each document.

    n_base counts the places where a phrase's words stand consecutively in the lower-cased text;
    first_word and last_word are their smallest and largest start, null if there are none. labels are the
    phrases' labels and those of every template of which a block contains at least ``threshold`` of the
    distinct words. score is 1 if a phrase was found, else the best containment that met the threshold,
    else 0. A null text counts as empty; rows that repeat a doc_id or have none are scanned one by one; a text of any
    length makes blocks of bounded size; other columns are not read.
    """
    sets = [(label, _template_words(text)) for label, text in templates]
    sets = [(label, w, max(1, math.ceil(threshold * len(w) - 1e-9))) for label, w in sets if w]
    vocabulary = sorted({x for _, w, _ in sets for x in w})
    listed = F.array(*map(F.lit, vocabulary)) if vocabulary else F.array().cast("array<string>")
    low = F.translate(F.coalesce(F.col("text").cast("string"), F.lit("")), _UPPER, _LOWER)
    split = docs.select(F.col("doc_id").cast("long").alias("doc_id"), low.alias("low")).select("doc_id", "low", words_of(F.col("low")).alias("words")).select("*", F.array_intersect("words", listed).alias("tokens"))

    places = [_places(F.col("words"), F.col("low"), p) for p, _ in phrases]
    enough = F.lit(False)
    for _, w, least in sets:
        enough = enough | (F.size(F.array_intersect("tokens", F.array(*map(F.lit, w)))) >= least)
    stands = F.filter(F.transform("words", lambda w, i: F.struct(i.alias("at"), F.array_position(listed, w).cast("int").alias("token"))), lambda x: x["token"] > 0)
    found = split.select(
        "doc_id", F.size("words").cast("long").alias("n_words"), *(c.alias(f"__p{i}") for i, c in enumerate(places)), F.transform("tokens", lambda w: F.array_position(listed, w).cast("int")).alias("tokens"), F.when(enough, stands).alias("held")
    )
    found = cut(found).withColumn("__row", F.monotonically_increasing_id())

    columns = [F.col(f"__p{i}") for i in range(len(phrases))]
    every_place = F.concat(*columns) if columns else F.array().cast("array<int>")
    named = F.array(*(F.when(F.size(c) > 0, F.lit(label)) for c, (_, label) in zip(columns, phrases, strict=True))) if columns else F.array().cast("array<string>")
    base = found.select("__row", "doc_id", "n_words", F.size(every_place).cast("long").alias("n_base"), F.array_min(every_place).cast("long").alias("first_word"), F.array_max(every_place).cast("long").alias("last_word"), F.array_sort(F.array_distinct(F.array_compact(named))).alias("__base"))

    met = _contained(found, sets, len(vocabulary)).groupBy("__row").agg(F.collect_set("label").alias("__met"), F.max("containment").alias("__best"))
    joined = base.join(met, "__row", "left")
    every = F.array_sort(F.array_union("__base", F.coalesce("__met", F.array().cast("array<string>"))))
    return joined.select("doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join("__base", ",").alias("base_labels"), F.array_join(every, ",").alias("labels"), F.when(F.col("n_base") > 0, F.lit(1.0)).otherwise(F.coalesce("__best", F.lit(0.0))).alias("score"))


def _contained(found: DataFrame, sets: Sequence[tuple[str, list[str], int]], n_tokens: int) -> DataFrame:
    """(__row, label, containment) of every block that meets a template; a block may meet several.

    found: (__row, tokens, held): numbers, from 1, of the templates' words that a document has, and the places of
    all of them where they may make up a template.
    """
    spark = found.sparkSession
    if not n_tokens:
        return found.where("false").select("__row", F.lit("").alias("label"), F.lit(0.0).alias("containment"))
    # the global order: how many documents hold a word; a row for each word of the templates
    counted = {r[0]: r[1] for r in found.select(F.explode("tokens").alias("t")).groupBy("t").count().collect()}
    order = sorted(range(1, n_tokens + 1), key=lambda t: (counted.get(t, 0), t))
    rank = {t: i for i, t in enumerate(order)}
    number = {w: t for t, w in enumerate(sorted({x for _, w, _ in sets for x in w}), 1)}
    rows = []
    for k, (label, words, least) in enumerate(sets):
        ranks = sorted(rank[number[w]] for w in words)
        rows += [(ranks[i], k, label, i, least, ranks) for i in range(len(ranks) - least + 1)]
    prefixes = spark.createDataFrame(rows, "rank int, template int, label string, at_t int, least int, order array<int>")
    prefixes = F.broadcast(prefixes) if len(rows) <= BROADCAST_ROWS else prefixes

    by_token = F.array(*(F.lit(rank[t]) for t in range(1, n_tokens + 1)))
    half = F.floor(F.col("x.at") / (BLOCK_WORDS // 2)).cast("long")
    least = min(n for _, _, n in sets)
    blocks = (
        found.where("held is not null")
        .select("__row", F.explode("held").alias("x"))
        .select("__row", F.explode(F.array(half, half - 1)).alias("block"), F.element_at(by_token, F.col("x.token")).alias("rank"))
        .where("block >= 0")
        .groupBy("__row", "block")
        .agg(F.array_sort(F.collect_set("rank")).alias("held"))
        .where(F.size("held") >= least)
    )
    prefix = F.slice("held", F.lit(1), F.size("held") - (least - 1))
    pairs = (
        blocks.select("__row", "held", F.posexplode(prefix).alias("at_b", "rank"))
        .join(prefixes, "rank")
        .where(F.size("held") >= F.col("least"))  # length
        .where(F.col("at_b") <= F.size("held") - F.col("least"))  # prefix, for this template
        .where(F.least(F.size("order") - F.col("at_t"), F.size("held") - F.col("at_b")) >= F.col("least"))  # position
    )
    both = F.size(F.array_intersect("held", "order"))
    return pairs.where(both >= F.col("least")).select("__row", "label", (both / F.size("order")).alias("containment"))


def oracle_sql(phrases: Sequence[tuple[str, str]] = PHRASES, templates: Sequence[tuple[str, str]] = TEMPLATES, threshold: float = 0.9) -> str:
    """The same in DuckDB's SQL, without any filter: every block against every template."""
    word = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    values = ", ".join(f"({k}, '{label}', [{', '.join(repr(w) for w in _template_words(text))}])" for k, (label, text) in enumerate(templates))
    spots = []
    for phrase, label in phrases:
        parts = phrase.split(" ")
        test = " AND ".join(f"w[i + {j}] = '{p}'" for j, p in enumerate(parts))
        spots.append(f"list_filter(range(1, len(w) - {len(parts) - 2}), lambda i: {test})")
    labels = ", ".join(f"CASE WHEN len(p{k}) > 0 THEN '{label}' END" for k, (_, label) in enumerate(phrases))
    every = " || ".join(f"p{k}" for k in range(len(phrases)))
    return f"""
WITH low AS (SELECT doc_id, translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}') AS low FROM documents),
ws AS (SELECT doc_id, low, regexp_extract_all(low, '{word}') AS w FROM low),
ps AS (SELECT doc_id, low, w, {", ".join(f"{s} AS p{k}" for k, s in enumerate(spots))} FROM ws),
b AS (SELECT doc_id, low, len(w) AS n_words, {every} AS p, list_sort(list_distinct(list_filter([{labels}], lambda x: x IS NOT NULL))) AS bl FROM ps),
t(k, label, tw) AS (VALUES {values}),
bk AS (SELECT doc_id, list_distinct(w[s + 1 : s + {BLOCK_WORDS}]) AS lw FROM (SELECT doc_id, w, unnest(range(0, greatest(len(w), 1), {BLOCK_WORDS // 2})) AS s FROM ws)),
hit AS (SELECT doc_id, label, len(list_intersect(lw, tw)) AS met, len(tw) AS size FROM bk, t),
m AS (SELECT doc_id, list(DISTINCT label) AS ml, max(met / size) AS best FROM hit WHERE met >= greatest(1, ceil({threshold} * size - 1e-9)) GROUP BY doc_id)
SELECT b.doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(len(p) AS BIGINT) AS n_base, CAST(list_min(p) - 1 AS BIGINT) AS first_word, CAST(list_max(p) - 1 AS BIGINT) AS last_word,
  array_to_string(bl, ',') AS base_labels, array_to_string(list_sort(list_distinct(list_concat(bl, coalesce(ml, [])))), ',') AS labels,
  CAST(CASE WHEN len(p) > 0 THEN 1.0 ELSE coalesce(best, 0.0) END AS DOUBLE) AS score
FROM b LEFT JOIN m ON b.doc_id = m.doc_id
"""
