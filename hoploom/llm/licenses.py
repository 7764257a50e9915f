"""License scans: an exact set-similarity join of text blocks with license templates, in DataFrame functions only.

A text's words are cut into overlapping blocks: for templates of up to L words
(L a power of two) blocks of 2 L words that begin every L words, so that each
passage of L words stands whole in one. A template matches a block that holds
at least ``threshold`` of the template's distinct words (containment).

One pass reads the texts; of documents without enough words of any template it
keeps their places and the words of templates that they hold alone. Words are
ordered by the number of documents that hold them, rarest first, as counted over
the whole table. Blocks are reduced to words of the templates, in
that order. A block of n such words can only reach a template's count ``need``
if n >= need (length filter), if the first n - need + 1 of its words and the
first m - need + 1 of the template's m share one (prefix filter, an equi-join on
the word), and if what follows the shared word on either side is long enough
(positional filter). Pairs that are left are verified on all words. No filter
drops a pair that reaches the threshold.

A document's blocks are made, joined and gathered within its own row's task: the
text is not shuffled, and what goes to the tasks is bounded by the templates.

Defined results: null and empty texts have no words, no places and no blocks;
long texts are scanned whole; templates that match the same block all count;
documents without an id are scanned like the others; rows repeated in full give
a row each; an empty table gives no rows; extra columns are ignored, whatever
their names.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut_lineage
from .common import table

#: The phrases of the base labels.
PHRASES = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}

#: Sentences of public license notices, and the labels that they give.
TEMPLATES = {
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files": "mit",
    "released under the mit license": "mit",
    "licensed under the apache license version 2 0": "apache-2",
    "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind": "apache-2",
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met": "bsd",
    "this work is licensed under the gnu general public license version 3": "gpl-3",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation": "gpl",
    "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation": "lgpl",
    "this source code form is subject to the terms of the mozilla public license v 2 0": "mpl-2",
    "licensed under cc by nc 4 0": "cc-by-nc",
    "this work is licensed under a creative commons attribution noncommercial 4 0 international license": "cc-by-nc",
    "this work is licensed under a creative commons attribution sharealike 4 0 international license": "cc-by-sa",
    "this work is licensed under a creative commons attribution 4 0 international license": "cc-by",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted": "isc",
    "this is free and unencumbered software released into the public domain": "unlicense",
}

#: What stands between words, once A-Z are lower-cased.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    """The words of a text, in order; null texts have none.

    Words of ASCII characters alone are as they are once A-Z are lower-cased. Others
    may have more letters lower-cased, but stay words and stay others: the one
    character outside ASCII that lower() turns into ASCII alone is replaced first.
    """
    return F.array_remove(F.split(F.lower(F.replace(F.coalesce(text, F.lit("")), F.lit("\u212a"), F.lit("\u0138"))), BETWEEN), "")


def _strings(values: Sequence[str]) -> Column:
    return F.array(*[F.lit(v) for v in values]) if values else F.array().cast("array<string>")


def _no(kind: str) -> Column:
    return F.array().cast(kind)


PLACES = "array<struct<start:bigint,label:string>>"
BLOCKS = "array<struct<length:int,start:bigint,tokens:array<string>>>"


def _starts(phrase: Sequence[str]) -> Column:
    """Where the words of a phrase stand one after the other in ``words``, counted from 0."""

    def stands(at: Column) -> Column:
        met = F.get("words", at) == phrase[0]
        for k, word in enumerate(phrase[1:], 1):
            met = met & (F.get("words", at + k) == word)
        return met

    return F.filter(F.sequence(F.lit(0), F.greatest(F.size("words") - len(phrase), F.lit(0))), stands)


def _labelled(starts: Column, label: str) -> Column:
    return F.transform(starts, lambda at: F.struct(at.cast("long").alias("start"), F.lit(label).alias("label")))


def _places(phrases: Mapping[str, str]) -> Column:
    """The places of all phrases; each is looked for where ``held`` has all its words."""
    found = []
    for phrase, label in phrases.items():
        own = phrase.split()
        found.append(F.when(F.size(F.array_except(_strings(own), F.col("held"))) == 0, _labelled(_starts(own), label)).otherwise(_no(PLACES)))
    return F.array_sort(F.concat(_no(PLACES), *found))


def _candidates(length: int, least: int, first: set[str], vocabulary: set[str], rank: Mapping[str, int]) -> Column:
    """The blocks of this length that hold a word of a prefix and ``least`` words of templates; their words of templates in order."""
    rarest, in_order = _strings(sorted(first)), _strings(sorted(vocabulary, key=rank.__getitem__))
    last = F.greatest(F.ceil(F.size("words") / length).cast("int") - 2, F.lit(0))

    def block(b: Column) -> Column:
        own = F.slice("words", b * length + 1, F.lit(2 * length))
        tokens = F.when(F.arrays_overlap(own, rarest), F.array_intersect(in_order, own))
        return F.struct(F.lit(length).alias("length"), (b * length).cast("long").alias("start"), tokens.alias("tokens"))

    made = F.filter(F.transform(F.sequence(F.lit(0), last), block), lambda x: F.size(x["tokens"]) >= least)
    return F.when(F.col("words").isNotNull() & F.arrays_overlap("held", rarest), made).otherwise(_no(BLOCKS))


def _needed(size: int, threshold: float) -> int:
    return max(1, math.ceil(round(threshold * size, 9)))


def block_length(n_words: int) -> int:
    """The class of a template: the least power of two that is not below its words."""
    return 1 << max(0, n_words - 1).bit_length()


def _prefix_rows(index: Mapping[tuple[int, str], list]) -> Column:
    """Array of (length, word, entries): the templates that have the word in their prefix, and where."""
    rows = []
    for (length, word), entries in index.items():
        told = [
            F.struct(F.lit(k).alias("template"), F.lit(label).alias("label"), F.lit(at).alias("t_at"), F.lit(need).alias("need"), _strings(own).alias("t_tokens"))
            for k, label, at, need, own in entries
        ]
        rows.append(F.struct(F.lit(length).alias("length"), F.lit(word).alias("word"), F.array(*told).alias("entries")))
    return F.array(*rows) if rows else _no("array<struct<length:int,word:string,entries:array<struct<template:int,label:string,t_at:int,need:int,t_tokens:array<string>>>>>")


def scan_licenses(docs: DataFrame, templates: Mapping[str, str] | None = None, phrases: Mapping[str, str] | None = None, threshold: float = 0.9) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text).

    ``n_words``; ``places``: array of (start, label) of the phrases; ``blocks``: array of
    (label, template, first_word, last_word, containment) of the blocks that reach the threshold.
    Templates and phrases are lower-case words of ASCII characters.
    """
    templates, phrases = dict(TEMPLATES if templates is None else templates), dict(PHRASES if phrases is None else phrases)
    if not all(text.isascii() for text in (*templates, *phrases)):
        raise ValueError("templates and phrases have to be ASCII")
    sets = [(k, words.split(), label) for k, (words, label) in enumerate(templates.items())]
    vocabulary = sorted({w for _, words, _ in sets for w in words})

    # One pass over the texts; of the words go on those of the documents that hold enough of a template.
    keyed = docs.select("doc_id", F.xxhash64("text").alias("h1"), F.xxhash64(F.lit(1), "text").alias("h2"), words_of(F.col("text")).alias("words"))
    keyed = keyed.withColumn("held", F.array_intersect(_strings(sorted({*vocabulary, *(w for p in phrases for w in p.split())})), "words"))
    enough = F.lit(False)
    for _, words, _ in sets:
        enough = enough | (F.size(F.array_intersect("held", _strings(sorted(set(words))))) >= _needed(len(set(words)), threshold))
    read = keyed.select("doc_id", "h1", "h2", F.size("words").cast("long").alias("n_words"), _places(phrases).alias("places"), "held", F.when(enough, F.col("words")).alias("words"))
    read = cut_lineage(read)

    # What comes back is a number for each word of the templates.
    counts = {r[0]: r[1] for r in read.select(F.explode_outer("held").alias("word")).groupBy("word").count().collect()}
    rank = {w: k for k, w in enumerate(sorted(vocabulary, key=lambda w: (counts.get(w, 0), w)))}
    index: dict[tuple[int, str], list] = {}
    lengths: dict[int, tuple[int, set[str], set[str]]] = {}
    for k, words, label in sets:
        own = sorted(set(words), key=rank.__getitem__)
        need, length = _needed(len(own), threshold), block_length(len(words))
        prefix = own[: len(own) - need + 1]
        for at, word in enumerate(prefix):
            index.setdefault((length, word), []).append((k, label, at, need, own))
        least, first, known = lengths.get(length, (need, set(), set()))
        lengths[length] = (min(least, need), first | set(prefix), known | set(own))
    blocks = [_candidates(length, *rest, rank=rank) for length, rest in sorted(lengths.items())]
    rows = read.select("doc_id", "h1", "h2", "n_words", "places", F.concat(_no(BLOCKS), *blocks).alias("found"))

    fixed = ["doc_id", "h1", "h2", "n_words", "places"]
    each = rows.select(*fixed, F.posexplode_outer("found").alias("nth", "b")).select(*fixed, "nth", F.col("b.length").alias("length"), F.col("b.start").alias("start"), F.col("b.tokens").alias("tokens"))
    each = each.select("*", F.posexplode_outer("tokens").alias("at", "word"))
    # One row for each word of a prefix, so that the join keeps the rows of the blocks as they are.
    prefixes = docs.sparkSession.range(1).select(F.inline(_prefix_rows(index)))
    met = each.join(F.broadcast(prefixes), ["length", "word"], "left")

    def verified(e: Column) -> Column:
        size, t_size = F.size("tokens"), F.size(e["t_tokens"])
        may = (F.col("at") <= size - e["need"]) & (F.least(size - F.col("at"), t_size - e["t_at"]) >= e["need"])
        shared = F.size(F.array_intersect("tokens", e["t_tokens"]))
        last = F.least(F.col("n_words"), F.col("start") + 2 * F.col("length")) - 1
        hit = F.struct(e["label"].alias("label"), e["template"].alias("template"), F.col("start").alias("first_word"), last.alias("last_word"), (shared / t_size).alias("containment"))
        return F.when(may & (shared >= e["need"]), hit)

    hits = F.filter(F.transform("entries", verified), lambda h: h.isNotNull())
    is_first = F.coalesce(F.col("nth"), F.lit(0)) + F.coalesce(F.col("at"), F.lit(0)) == 0
    # Rows repeated in full are gathered together, counted, and told apart again.
    gathered = met.groupBy(*fixed).agg(F.flatten(F.collect_list(hits)).alias("hits"), F.count(F.when(is_first, 1)).cast("int").alias("copies"))
    result = gathered.select("doc_id", "n_words", "places", F.array_sort(F.array_distinct("hits")).alias("blocks"), F.explode(F.sequence(F.lit(1), "copies")).alias("_copy"))
    return result.drop("_copy")


def op11_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places of the fixed phrases in every document, and the labels of all blocks that hold a license notice."""
    found = scan_licenses(table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = F.array_distinct(F.transform("places", lambda p: p["label"]))
    more = F.array_distinct(F.transform("blocks", lambda b: b["label"]))
    nearest = F.array_max(F.transform("blocks", lambda b: b["containment"]))
    return found.select(
        "doc_id",
        "n_words",
        F.size("places").cast("long").alias("n_base"),
        F.array_min(F.transform("places", lambda p: p["start"])).alias("first_word"),
        F.array_max(F.transform("places", lambda p: p["start"])).alias("last_word"),
        F.array_join(F.array_sort(base), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union(base, more)), ",").alias("labels"),
        F.when(F.size("places") > 0, 1.0).otherwise(F.coalesce(nearest, F.lit(0.0))).alias("score"),
    )


def _oracle() -> str:
    """The same result from the definitions alone: every block of every document against every template."""
    phrases = ", ".join(f"('{p}', {len(p.split())}, '{label}')" for p, label in PHRASES.items())
    templates = ", ".join(f"('{words}', {block_length(len(words.split()))}, '{label}')" for words, label in TEMPLATES.items())
    return rf"""
WITH docs AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words
  FROM documents
), phrases(phrase, size, label) AS (VALUES {phrases}),
places AS (
  SELECT r, pos, label FROM (SELECT r, words, phrase, size, label, unnest(range(len(words) - size + 1)) AS pos FROM docs, phrases WHERE list_has_all(words, string_split(phrase, ' ')))
  WHERE array_to_string(words[pos + 1 : pos + size], ' ') = phrase
), templates(phrase, length, label) AS (VALUES {templates}),
blocks AS (
  SELECT r, length, words[pos * length + 1 : pos * length + 2 * length] AS own
  FROM (SELECT r, length, words, unnest(range(greatest(1, CAST(ceil(len(words) / length) AS BIGINT) - 1))) AS pos FROM docs, (SELECT DISTINCT length FROM templates))
), shares AS (
  SELECT r, label, len(list_intersect(own, tokens)) / len(tokens) AS share
  FROM blocks JOIN (SELECT *, list_distinct(string_split(phrase, ' ')) AS tokens FROM templates) USING (length)
), hits AS (SELECT r, label, share FROM shares WHERE share >= 0.9 - 1e-9),
base AS (SELECT r, count(*) AS n, min(pos) AS first, max(pos) AS last FROM places GROUP BY r),
base_names AS (SELECT r, string_agg(label, ',' ORDER BY label) AS names FROM (SELECT DISTINCT r, label FROM places) GROUP BY r),
names AS (SELECT r, string_agg(label, ',' ORDER BY label) AS names FROM (SELECT r, label FROM places UNION SELECT r, label FROM hits) GROUP BY r),
best AS (SELECT r, max(share) AS share FROM hits GROUP BY r)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, coalesce(n, 0) AS n_base, first AS first_word, last AS last_word,
  coalesce(base_names.names, '') AS base_labels, coalesce(names.names, '') AS labels,
  CASE WHEN n > 0 THEN 1.0::DOUBLE ELSE coalesce(share, 0.0)::DOUBLE END AS score
FROM docs LEFT JOIN base USING (r) LEFT JOIN base_names USING (r) LEFT JOIN names USING (r) LEFT JOIN best USING (r)
"""


OP11_SQL = _oracle()
