"""License scans by an exact set-similarity join with template clauses.

A text's words are cut into overlapping blocks of ``BLOCK`` words, one every ``BLOCK / 2``; any passage
of up to half a block lies whole in one of them. A block matches a template clause if it holds at
least ``threshold`` of the clause's distinct words (containment). The join that finds all such pairs:

* global order: words are ordered by how often they occur over all documents, rarest first (only
  words of a template can match, so only they are counted and ordered);
* prefix filter: with overlap ``o = ceil(threshold * n)`` of ``n`` words, a match must share one of the
  ``n - o + 1`` rarest words of the clause;
* length filter: a block with fewer than ``o`` different template words can't match;
* positional filter: if the rarest shared word stands at place ``i`` of the clause and ``j`` of the
  block's own order, at most ``1 + min(n - 1 - i, m - 1 - j)`` words can be shared.

What passes is verified by counting the shared words. All of it is DataFrame expressions.

Cases: very long texts are cut into blocks whole; a block that matches several clauses has all their labels; a null or empty text has no words, no labels and score zero; words longer than any template
word are kept; repeated rows are each scanned; an empty table gives an empty result; other columns are
ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, read, staged

#: Words of a block (clauses have at most half as many), and the containment threshold.
BLOCK, THRESHOLD = 64, 0.8

#: Phrases whose every place counts, with their labels.
PHRASES = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))
#: (label, clause)
TEMPLATES = (
    ("apache-2.0", "licensed under the apache license version 2 0"),
    ("apache-2.0", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis"),
    ("bsd", "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("cc0", "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work"),
    ("cc-by", "licensed under a creative commons attribution license"),
    ("epl-2.0", "this program and the accompanying materials are made available under the terms of the eclipse public license"),
    ("gpl", "this work is licensed under the gnu general public license version 3"),
    ("gpl", "this program is free software you can redistribute it and or modify it"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software"),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license"),
    ("ofl-1.1", "this font software is licensed under the sil open font license version 1 1"),
    ("reserved", "copyright all rights reserved"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
    ("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages"),
)


def words(text: Column) -> Column:
    """The words of a text as one string, a space after each and one before the first."""
    # The classes are written out so that no other engine's idea of a word comes in.
    spaced = F.regexp_replace(ascii_lower(F.coalesce(text, F.lit(""))), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", " ")
    return F.concat(F.lit(" "), F.ltrim(F.concat(F.rtrim(spaced), F.lit(" "))))


def word_order(docs: DataFrame, templates=TEMPLATES) -> list[str]:
    """The templates' words, those rarest in the corpus (column ``w`` of ``words``) first.

    Counted over all documents; the driver gets one row for each template word.
    """
    vocabulary = sorted({t for _, text in templates for t in text.split()})
    seen = docs.select(F.explode(F.filter(F.split("w", " "), lambda t: t.isin(vocabulary))).alias("token"))
    counts = {r["token"]: r["n"] for r in seen.groupBy("token").agg(F.count("*").alias("n")).collect()}
    return sorted(vocabulary, key=lambda t: (counts.get(t, 0), t))


def clauses(spark: SparkSession, order: list[str], templates=TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """clause, label, terms (in the global order), n, o (the least overlap)."""
    rank = {t: i for i, t in enumerate(order)}
    rows = []
    for i, (label, text) in enumerate(templates):
        terms = sorted(set(text.split()), key=rank.__getitem__)
        rows.append((i, label, terms, len(terms), math.ceil(threshold * len(terms) - 1e-9)))
    return spark.createDataFrame(rows, "clause int, label string, terms array<string>, n int, o int")


def prefix_words(order: list[str], templates=TEMPLATES, threshold: float = THRESHOLD) -> set[str]:
    """Words of which a block that matches any clause has at least one."""
    rank, out = {t: i for i, t in enumerate(order)}, set()
    for _, text in templates:
        terms = sorted(set(text.split()), key=rank.__getitem__)
        out |= set(terms[: len(terms) - math.ceil(threshold * len(terms) - 1e-9) + 1])
    return out


def blocks_of(order: list[str], templates=TEMPLATES, threshold: float = THRESHOLD, block: int = BLOCK) -> Column:
    """array<struct<block, own>>: a text's blocks (column ``ws``) that hold any prefix word.

    ``own`` has the block's template words in the global order; no other word can match.
    """
    prefix = prefix_words(order, templates, threshold)
    half, ws = block // 2, F.col("ws")
    n_blocks = F.greatest(F.lit(1), F.ceil((F.size(ws) - half) / F.lit(half)).cast("int"))
    listed = F.array(*map(F.lit, order))
    cut = F.transform(
        F.sequence(F.lit(0), n_blocks - 1),
        lambda b: F.struct(b.alias("block"), F.array_intersect(listed, F.slice(ws, b * half + 1, block)).alias("own")),
    )
    some = F.filter(cut, lambda b: F.arrays_overlap(b["own"], F.array(*map(F.lit, sorted(prefix)))))
    return F.coalesce(some, F.array().cast("array<struct<block:int,own:array<string>>>"))


def matches(cut: DataFrame, known: DataFrame) -> DataFrame:
    """key, block, label, score: blocks (key, block, own) that contain enough of a clause of ``known``."""
    lead = known.select("clause", "label", "terms", "n", "o", F.posexplode(F.expr("slice(terms, 1, n - o + 1)")).alias("i", "token"))
    shared = cut.select("key", "block", "own", F.posexplode("own").alias("j", "token")).join(lead, "token")
    m = F.size("own")
    fits = (m >= F.col("o")) & (1 + F.least(F.col("n") - 1 - F.col("i"), m - 1 - F.col("j")) >= F.col("o"))
    # By its rarest shared word alone: a pair is verified once.
    first = F.element_at(F.array_intersect("terms", "own"), 1) == F.col("token")
    overlap = F.size(F.array_intersect("terms", "own"))
    hit = shared.where(fits & first).withColumn("shared", overlap).where("shared >= o")
    return hit.select("key", "block", "label", (F.col("shared") / F.col("n")).alias("score"))


def places(phrase: str) -> Column:
    """Word numbers (from 0) at which the phrase's words stand consecutively in ``ws``."""
    ws, parts = F.col("ws"), phrase.split(" ")

    def here(i: Column) -> Column:
        out = F.lit(True)
        for k, part in enumerate(parts):
            out = out & (F.get(ws, i + k) == part)
        return out

    found = F.filter(F.sequence(F.lit(0), F.size(ws) - 1), here)
    return F.when(F.col("w").contains(f" {phrase} "), found).otherwise(F.array().cast("array<int>"))


def _labelled(found: Column, label: str) -> Column:
    return F.transform(found, lambda i: F.struct(i.cast("long").alias("at"), F.lit(label).alias("label")))


def scan(docs: DataFrame, templates=TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, n_words, places (array<struct<at, label>>), matched (labels), score of every row."""
    spark = docs.sparkSession
    worded = docs.select("doc_id", words(F.col("text").cast("string")).alias("w"))
    order = word_order(worded, templates)
    found = F.concat(*[_labelled(places(phrase), label) for phrase, label in PHRASES])
    # Only texts that hold a phrase or a prefix word are cut into words. The array is a column of its
    # own (by exploding an array of one): a lambda over places would cut the text again for each.
    telling = F.col("w").rlike(" (?:" + "|".join(sorted(prefix_words(order, templates, threshold) | {p for p, _ in PHRASES})) + ") ")
    cut_up = F.explode(F.array(F.when(telling, F.split(F.trim("w"), " "))))
    worded = worded.select("doc_id", "w", cut_up.alias("ws"))
    n_words = F.when(F.trim("w") == "", 0).otherwise(F.length("w") - F.length(F.replace("w", F.lit(" "), F.lit(""))) - 1)
    key = F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.hex(F.xxhash64("w")))
    rows = staged(worded.select("doc_id", key.alias("key"), n_words.cast("long").alias("n_words"), found.alias("places"), blocks_of(order, templates, threshold).alias("blocks")), "scanned")
    cut = rows.select("key", "blocks").distinct().select("key", F.explode("blocks").alias("b")).select("key", "b.block", "b.own")
    hits = matches(cut, clauses(spark, order, templates, threshold))
    by_key = hits.groupBy("key").agg(F.collect_set("label").alias("matched"), F.max("score").alias("score"))
    kept = rows.select("doc_id", F.col("key").alias("row_key"), "n_words", "places")
    return kept.join(by_key, F.col("row_key") == F.col("key"), "left").select("doc_id", "n_words", "places", F.coalesce("matched", F.array().cast("array<string>")).alias("matched"), F.coalesce("score", F.lit(0.0)).alias("score"))


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scan(read(spark, sf_dir, "documents"))
    at, base = F.transform("places", lambda p: p["at"]), F.transform("places", lambda p: p["label"])
    listed = lambda labels: F.array_join(F.array_sort(F.array_distinct(labels)), ",")
    return rows.select(
        "doc_id", "n_words", F.size("places").cast("long").alias("n_base"),
        F.array_min(at).alias("first_word"), F.array_max(at).alias("last_word"),
        listed(base).alias("base_labels"), listed(F.concat(base, "matched")).alias("labels"),
        F.when(F.size("places") > 0, 1.0).otherwise(F.col("score")).alias("score"),
    )


def _sql() -> str:
    values = ", ".join(f"({i}, '{label}', string_split('{text}', ' '))" for i, (label, text) in enumerate(TEMPLATES))
    phrases = ", ".join(f"('{p}', '{label}', {len(p.split())})" for p, label in PHRASES)
    return rf"""
WITH clause AS (SELECT i, label, list_distinct(t) AS terms FROM (VALUES {values}) v(i, label, t)),
phrase(p, label, k) AS (VALUES {phrases}),
d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents
),
base AS (
  SELECT r, count(*) AS n_base, min(p0) AS first_word, max(p0) AS last_word, list(label) AS labels FROM (
    SELECT r, label, p0, ws, p, k FROM (SELECT r, ws, unnest(range(len(ws))) AS p0 FROM d WHERE len(ws) > 0) x, phrase
    WHERE array_to_string(ws[p0 + 1 : p0 + k], ' ') = p) y GROUP BY r
),
block AS (
  SELECT r, list_distinct(ws[b * {BLOCK // 2} + 1 : b * {BLOCK // 2} + {BLOCK}]) AS own
  FROM (SELECT r, ws, unnest(range(greatest(1, CAST(ceil((len(ws) - {BLOCK // 2}) / {BLOCK // 2}.0) AS BIGINT)))) AS b FROM d) x
),
hit AS (
  SELECT r, label, len(list_intersect(own, terms)) / CAST(len(terms) AS DOUBLE) AS score FROM block, clause
  WHERE len(list_intersect(own, terms)) >= ceil({THRESHOLD} * len(terms) - 1e-9)
),
found AS (SELECT r, list(label) AS labels, max(score) AS score FROM hit GROUP BY r)
SELECT doc_id, len(ws) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word,
  coalesce(array_to_string(list_sort(list_distinct(b.labels)), ','), '') AS base_labels,
  coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(b.labels, []), coalesce(f.labels, [])))), ','), '') AS labels,
  CASE WHEN n_base > 0 THEN 1.0::DOUBLE ELSE coalesce(f.score, 0.0::DOUBLE) END AS score
FROM d LEFT JOIN base b USING (r) LEFT JOIN found f USING (r)
"""


OP2_SQL = _sql()
