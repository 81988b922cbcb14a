"""Licence scans as an exact set-similarity join, in DataFrame functions only.

Text blocks are joined with licence templates on containment: a block matches
if it has at least ``CONTAINMENT`` of the template's distinct words. Blocks are
lines (long ones in overlapping windows of words) and, as notices are wrapped,
every run of words of the whole text, over line ends too, that has as many words
as the template's text. Words of templates are put in one global order, rarest
in the corpus first, and three filters follow from it (for runs the first):

* prefix: a match must share one of the template's rarest words, as many as may
  be missing plus one; only these are indexed,
* length: a block needs as many words of the templates as the match takes,
* position: at a shared prefix word, what follows in both orders must be enough.

What is left is verified on the whole sets, so the result is exact; the
corpus's frequencies decide only how fast it is found.

Edge cases: null or empty texts have no words and no labels. Rows that repeat a
``doc_id``, or have none, each keep their own counts and labels, those of their
text. Ties of labels are sorted. An empty table gives no rows.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CONTAINMENT = 0.8
#: Longer lines are cut in windows of so many words, one beginning every STRIDE
#: words; a template has at most STRIDE words.
WINDOW, STRIDE = 64, 32

# Phrases that name a licence and their labels.
PHRASES = {
    "cc by": "cc-by",
    "general public license": "gpl",
    "all rights reserved": "reserved",
}

# Notices by which texts are put under a licence, and their labels.
TEMPLATES = [
    ("apache", "Licensed under the Apache License, Version 2.0"),
    ("apache", "you may not use this file except in compliance with the License"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("cc-by", "Licensed under CC BY 4.0"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution International License"),
    ("gpl", "This work is licensed under the GNU General Public License, version 3"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License"),
    ("mit", "Released under the MIT License"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License"),
    ("reserved", "Copyright. All rights reserved. No part may be reproduced without permission"),
]

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def words(lowered: Column) -> Column:
    """The words of a text that is in lower case already."""
    return F.filter(F.split(lowered, SEPARATORS, -1), lambda w: w != "")


def words_of(template: str) -> list[str]:
    return [w for w in re.split(SEPARATORS, template.lower()) if w]


def template_sets(templates: list[tuple[str, str]]) -> list[tuple[str, list[str]]]:
    return [(label, sorted(set(words_of(text)))) for label, text in templates]


def word_order(documents: DataFrame, vocabulary: list[str]) -> list[str]:
    """The vocabulary, rarest in the corpus first; counted over all documents."""
    found = F.filter(F.split(F.lower("text"), SEPARATORS, -1), lambda w: w.isin(vocabulary))
    counts = documents.select(F.explode(found).alias("w")).groupBy("w").count().collect()  # at most the vocabulary
    n = {r["w"]: r["count"] for r in counts}
    return sorted(vocabulary, key=lambda w: (n.get(w, 0), w))


def row_key() -> Column:
    """A digest of id and text: rows that share it are the same row twice."""
    return F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit("\n"), F.coalesce(F.col("text"), F.lit(""))).cast("binary"))


def matches(documents: DataFrame, templates: list[tuple[str, str]] = TEMPLATES, containment: float = CONTAINMENT) -> DataFrame:
    """``(doc_id, row, block, template, label, containment)`` for every block that meets a template.

    ``row`` is a digest of the row's id and text: what is found belongs to the text.
    ``block`` numbers the document's blocks, ``template`` the templates. A run of
    words of the whole text has the line -1 and the place of a word in it.
    """
    sets = template_sets(templates)
    if any(len(s) > STRIDE for _, s in sets):
        raise ValueError(f"a template may have {STRIDE} words")
    vocabulary = sorted({w for _, s in sets for w in s})
    order = word_order(documents, vocabulary)
    at = {w: i for i, w in enumerate(order)}
    index = []
    for k, (label, s) in enumerate(sets):
        need = math.ceil(containment * len(s) - 1e-9)
        ranked = sorted(at[w] for w in s)
        span = len(words_of(templates[k][1]))
        index += [(k, label, ranked, need, span, i, r) for i, r in enumerate(ranked[: len(ranked) - need + 1])]
    # As many rows as the templates have prefix words: a fixed, small number.
    index_table = documents.sparkSession.createDataFrame(index, "template int, label string, words array<int>, need int, span int, i int, rank int")
    prefix = sorted({order[r] for *_, r in index})
    ranks = F.create_map(*[F.lit(x) for w in order for x in (w, at[w])])

    rows = documents.where(F.arrays_overlap(F.split(F.lower("text"), SEPARATORS, -1), F.array(*[F.lit(w) for w in prefix])))
    rows = rows.select("doc_id", row_key().alias("row"), "text")
    lines = rows.select("doc_id", "row", F.posexplode(F.split("text", "\n", -1)).alias("_line", "_text"))
    lines = lines.select("doc_id", "row", "_line", words(ascii_lower(F.col("_text"))).alias("_words"))
    starts = F.sequence(F.lit(0), F.greatest(F.size("_words") - (WINDOW - STRIDE) - 1, F.lit(0)), F.lit(STRIDE))
    blocks = lines.select("doc_id", "row", "_line", "_words", F.explode(starts).alias("_from"))
    inside = F.filter(F.array_distinct(F.slice("_words", F.col("_from") + 1, F.lit(WINDOW))), lambda w: w.isin(vocabulary))
    blocks = blocks.select("doc_id", "row", F.struct("_line", "_from").alias("block"), F.array_sort(F.transform(inside, lambda w: ranks[w])).alias("have"))

    tokens = blocks.select("doc_id", "row", "block", "have", F.posexplode("have").alias("j", "rank"))
    met = tokens.join(F.broadcast(index_table), "rank")
    met = met.where(F.size("have") >= F.col("need"))
    most = F.least("i", "j") + F.least(F.size("words") - F.col("i"), F.size("have") - F.col("j"))
    met = met.where(most >= F.col("need"))
    shared = F.size(F.array_intersect("words", "have"))
    met = met.where(shared >= F.col("need")).select("doc_id", "row", "block", "template", "label", (shared / F.size("words")).alias("containment"))
    return met.unionByName(_runs_of_words(rows, index_table, vocabulary, ranks, sorted({at[w] for w in prefix}), max(x[4] for x in index))).distinct()


def _runs_of_words(rows: DataFrame, index_table: DataFrame, vocabulary: list[str], ranks: Column, prefix: list[int], longest: int) -> DataFrame:
    """Matches in runs of ``span`` words of the whole text, those around each prefix word."""
    placed = F.transform(words(ascii_lower(F.col("text"))), lambda w, i: F.struct(w.alias("w"), i.alias("at")))
    placed = F.filter(placed, lambda x: x["w"].isin(vocabulary))
    every = rows.select("doc_id", "row", F.transform(placed, lambda x: F.struct(ranks[x["w"]].alias("rank"), x["at"].alias("at"))).alias("_all"))
    numbered = F.transform("_all", lambda x, j: F.struct(x["rank"].alias("rank"), x["at"].alias("at"), j.alias("j")))
    hits = F.filter(numbered, lambda x: x["rank"].isin(prefix))
    # No more than the longest span to either side goes along with a hit.
    around = lambda x: F.slice("_all", F.greatest(x["j"] + 2 - longest, F.lit(1)), F.lit(2 * longest))
    hits = every.select("doc_id", "row", F.explode(F.transform(hits, lambda x: F.struct(x["rank"].alias("rank"), x["at"].alias("at"), around(x).alias("near")))).alias("_hit"))
    met = hits.select("doc_id", "row", F.col("_hit.rank").alias("rank"), F.col("_hit.at").alias("at"), F.col("_hit.near").alias("near")).join(F.broadcast(index_table), "rank")
    own = F.filter("near", lambda x: (F.abs(x["at"] - F.col("at")) < F.col("span")) & F.array_contains("words", x["rank"]))
    met = met.select("doc_id", "row", "at", "template", "label", "words", "need", "span", own.alias("own")).where(F.size("own") >= F.col("need"))
    run = lambda x: F.filter("own", lambda y: (y["at"] >= x["at"]) & (y["at"] < x["at"] + F.col("span")))
    shared = F.array_max(F.transform("own", lambda x: F.size(F.array_distinct(F.transform(run(x), lambda y: y["rank"])))))
    met = met.withColumn("_shared", shared).where(F.col("_shared") >= F.col("need"))
    return met.select("doc_id", "row", F.struct(F.lit(-1).alias("_line"), F.col("at").alias("_from")).alias("block"), "template", "label", (F.col("_shared") / F.size("words")).alias("containment"))


def _starts(phrase: list[str]) -> Column:
    """Where the words of a phrase stand side by side in ``_words``."""
    fits = F.size("_words") - len(phrase)
    all_starts = F.when(fits >= 0, F.sequence(F.lit(0), F.greatest(fits, F.lit(0)))).otherwise(F.array().cast("array<int>"))
    return F.filter(all_starts, lambda i: _here(i, phrase))


def _here(i: Column, phrase: list[str]) -> Column:
    out = F.lit(True)
    for k, w in enumerate(phrase):
        out = out & (F.col("_words")[i + k] == w)
    return out


def scan(documents: DataFrame, templates: list[tuple[str, str]] = TEMPLATES, containment: float = CONTAINMENT) -> DataFrame:
    """Word counts, places of the phrases, and labels of phrases and templates for each document."""
    found = matches(documents, templates, containment)
    found = found.groupBy(F.col("row").alias("_found")).agg(F.collect_set("label").alias("_more"), F.max("containment").alias("_best"))

    sep = SEPARATORS[:-1].replace(r"\x3A-\x60", r"\x3A-\x40\x5B-\x60") + "+"
    hint = "(?i)" + "|".join(p.replace(" ", sep) for p in PHRASES)
    text = F.coalesce(F.col("text"), F.lit(""))
    rough = F.split(F.lower(text), SEPARATORS, -1)
    rows = documents.select("doc_id", row_key().alias("_row"), text.alias("_text"), rough.alias("_rough"))
    # Only the ends of the split can be empty.
    n = F.size("_rough") - (F.element_at("_rough", 1) == "").cast("int") - ((F.size("_rough") > 1) & (F.element_at("_rough", -1) == "")).cast("int")
    rows = rows.select("doc_id", "_row", n.cast("long").alias("n_words"), F.when(F.col("_text").rlike(hint), F.col("_text")).alias("_text"))
    rows = rows.withColumn("_words", F.when(F.col("_text").isNotNull(), words(ascii_lower(F.col("_text")))))
    places = [(label, _starts(p.split())) for p, label in PHRASES.items()]
    rows = rows.select("doc_id", "_row", "n_words", *[F.when(F.col("_words").isNotNull(), c).otherwise(F.array().cast("array<int>")).alias(label) for label, c in places])
    names = [label for label, _ in places]
    every = F.concat(*[F.col(f"`{x}`") for x in names])
    base = F.array_compact(F.array(*[F.when(F.size(F.col(f"`{x}`")) > 0, F.lit(x)) for x in names]))
    rows = rows.select(
        "doc_id", "_row", "n_words", F.size(every).cast("long").alias("n_base"),
        F.array_min(every).cast("long").alias("first_word"), F.array_max(every).cast("long").alias("last_word"), F.array_sort(base).alias("_base"),
    )
    out = rows.join(found, F.col("_row") == F.col("_found"), "left")
    every_label = F.array_sort(F.array_union("_base", F.coalesce("_more", F.array().cast("array<string>"))))
    return out.select(
        "doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join("_base", ",").alias("base_labels"), F.array_join(every_label, ",").alias("labels"),
        F.when(F.size("_base") > 0, F.lit(1.0)).otherwise(F.coalesce("_best", F.lit(0.0))).alias("score"),
    )

