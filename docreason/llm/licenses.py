"""License scans by diagonal voting.

Every text is cut into rolling windows of ``K`` words; their hashes are joined
with the positions of the same windows in the license templates. A match of text
position p and template position q votes for the diagonal p - q, at which the
template would begin. Votes are counted by diagonal, neighbouring diagonals
(words put in or left out) are merged, and a merged span counts if the matched
windows are checked word for word and cover ``COVER`` of the template.

Base labels come from fixed phrases and always stay; spans add the labels of
their templates.

All work is DataFrame functions. The templates are the fixed table below, so the
broadcast of their windows has a fixed size. Votes are grouped by text, template
and diagonal; only matching windows are shuffled.

Words: A-Z lower-cased, then ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+``. Null text
has no words and no labels (labels are then empty strings). Texts shorter than a
window have no spans. Repeated rows share one result; null doc_ids are rows like
others.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docreason.llm.common import keyed_text

K = 3
COVER = 0.8
#: Diagonals at most so far apart are neighbours.
SHIFT = 3
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

#: Base phrases and their labels (fixed values of the contract).
PHRASES: list[tuple[str, str]] = [
    ("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl")]

#: License notices as published with the licenses, and short notices in use.
TEMPLATES: list[tuple[str, str]] = [
    ("mit", "Released under the MIT License"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
            "documentation files (the \"Software\"), to deal in the Software without restriction"),
    ("apache", "Licensed under the Apache License, Version 2.0"),
    ("apache", "you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("gpl", "This work is licensed under the GNU General Public License, version 3"),
    ("gpl", "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by "
            "the Free Software Foundation"),
    ("lgpl", "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided "
            "that the following conditions are met"),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0"),
    ("unlicense", "This is free and unencumbered software released into the public domain"),
]


def word_array(text: Column) -> Column:
    return F.array_remove(F.split(F.translate(text, UPPER, LOWER), NOT_WORD), "")


def _cut(x: Column, first: int, size: Column) -> Column:
    return F.slice(x, F.lit(first), F.greatest(size, F.lit(0)))


def exploded(texts: DataFrame, *keep: str) -> DataFrame:
    """keep, words, pos (from 0) and h of every window of three words of the
    column text (one row with a null pos and h for a shorter text). Each step
    is a column of its own, so that none is computed twice; an inner explode
    would bring in a filter that computes them all again."""
    n = F.size("words")
    words = texts.select(*keep, word_array(F.col("text")).alias("words"))
    one = words.withColumn("one", F.transform("words", lambda w: F.xxhash64(w)))
    two = one.withColumn("two", F.zip_with(_cut(F.col("one"), 1, n - 1), _cut(F.col("one"), 2, n - 1),
                                           lambda a, b: F.xxhash64(a, b)))
    three = F.zip_with(_cut(F.col("two"), 1, n - 2), _cut(F.col("one"), 3, n - 2), lambda a, b: F.xxhash64(a, b))
    return two.select(*keep, "words", three.alias("hashes")).select(
        *keep, "words", F.posexplode_outer("hashes").alias("pos", "h"))


def template_windows(spark: SparkSession, templates: list[tuple[str, str]]) -> DataFrame:
    """template, label, at (position), n (windows of the template), window, h."""
    table = spark.createDataFrame([(i, label, text) for i, (label, text) in enumerate(templates)],
                                  "template int, label string, text string")
    rows = exploded(table, "template", "label").where("h is not null")
    return rows.select("template", "label", F.col("pos").alias("at"), (F.size("words") - (K - 1)).alias("n"),
                       F.slice("words", F.col("pos") + 1, F.lit(K)).alias("window"), "h")


def spans(docs: DataFrame, templates: list[tuple[str, str]] = TEMPLATES) -> DataFrame:
    """doc_id, text_key, label, first, last (words), cover of every verified span."""
    table = F.broadcast(template_windows(docs.sparkSession, templates))
    votes = exploded(keyed_text(docs), "doc_id", "text_key").join(table, "h").where(
        F.slice("words", F.col("pos") + 1, F.lit(K)) == F.col("window"))
    diagonals = (votes.groupBy("doc_id", "text_key", "template", "label", "n", (F.col("pos") - F.col("at")).alias("diagonal"))
                 .agg(F.min("pos").alias("first"), F.max("pos").alias("last"), F.collect_set("at").alias("ats")))
    line = Window.partitionBy("doc_id", "text_key", "template").orderBy("diagonal")
    new = F.coalesce((F.col("diagonal") - F.lag("diagonal").over(line) > SHIFT).cast("int"), F.lit(1))
    merged = (diagonals.withColumn("new", new).withColumn("span", F.sum("new").over(line))
              .groupBy("doc_id", "text_key", "template", "label", "n", "span")
              .agg(F.min("first").alias("first"), (F.max("last") + (K - 1)).alias("last"),
                   F.size(F.array_distinct(F.flatten(F.collect_list("ats")))).alias("covered")))
    return merged.select("doc_id", "text_key", "label", "first", "last", (F.col("covered") / F.col("n")).alias("cover")).where(
        F.col("cover") >= COVER)


def phrase_places(words: Column, phrase: str) -> Column:
    """Positions (from 0, ascending) at which the phrase's words stand."""
    parts = phrase.split(" ")
    at = F.filter(F.transform(words, lambda w, i: F.when(w == parts[-1], i - (len(parts) - 1))), lambda i: i.isNotNull())
    return F.filter(at, lambda i: (i >= 0) & (F.array_join(F.slice(words, F.greatest(i, F.lit(0)) + 1, F.lit(len(parts))), " ") == phrase))


def scan(docs: DataFrame, templates: list[tuple[str, str]] = TEMPLATES,
         phrases: list[tuple[str, str]] = PHRASES) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels,
    score for every row. score is 1 with a base label, else the best cover of a
    verified span, else 0."""
    words = keyed_text(docs).select("doc_id", "text_key", word_array(F.col("text")).alias("words"))
    places = [F.when(F.array_contains("words", p.split(" ")[-1]), phrase_places(F.col("words"), p))
              .otherwise(F.array().cast("array<int>")).alias(f"p{i}") for i, (p, _) in enumerate(phrases)]
    found = words.select("doc_id", "text_key", F.size("words").cast("long").alias("n_words"), *places)
    all_places = F.concat(*[F.col(f"p{i}") for i in range(len(phrases))])
    base = F.array_compact(F.array(*[F.when(F.size(f"p{i}") > 0, F.lit(label)) for i, (_, label) in enumerate(phrases)]))
    rows = found.select("doc_id", "text_key", "n_words", F.size(all_places).cast("long").alias("n_base"),
                        F.array_min(all_places).cast("long").alias("first_word"),
                        F.array_max(all_places).cast("long").alias("last_word"), base.alias("base"))
    more = (spans(docs, templates).groupBy(F.col("doc_id").alias("d"), F.col("text_key").alias("k"))
            .agg(F.collect_set("label").alias("more"), F.max("cover").alias("cover")))
    both = rows.join(more, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("text_key") == F.col("k")), "left")
    none = F.array().cast("array<string>")
    return both.select(
        "doc_id", "n_words", "n_base", "first_word", "last_word",
        F.array_join(F.array_sort(F.array_distinct("base")), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union("base", F.coalesce("more", none))), ",").alias("labels"),
        F.when(F.col("n_base") > 0, 1.0).otherwise(F.coalesce("cover", F.lit(0.0))).alias("score"))
