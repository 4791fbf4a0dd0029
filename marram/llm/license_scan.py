"""License scan by diagonal voting, with DataFrame functions only.

The rolling word 3-gram hashes of every text are joined to the positions of the same grams in a table of templates: short
phrases, and the notices by which licences are commonly stated. A match votes for the diagonal (position in the text minus
position in the template). A phrase stands wherever its diagonal has all its votes. For a notice, each run of NEAR + 1
neighbouring diagonals is one span, so that words left out or put in don't split it and no span is longer than the notice
by more than NEAR words. Grams are compared by their words, and a span is verified in order: its share is the longest chain
of its votes that goes forward in the text and in the notice, so no gram of the notice counts twice, divided by the
notice's grams.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marram.llm.common import broadcast_if_small, free_name

GRAM = 3
#: So many diagonals beyond the first belong to one span of a notice.
NEAR = 8
#: Least share of a notice's grams that a span must hold.
COVERAGE = 0.7
#: Up to so many grams of templates, texts are first searched for their hashes; beyond it every gram goes into the join.
LISTED_GRAMS = 10_000

# Phrases and the labels they stand for.
PHRASES = [
    ("mit", "under the mit license"),
    ("apache-2", "apache license version 2"),
    ("cc-by-nc", "cc by nc"),
]
# The wording of public licence notices.
NOTICES = [
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the software without restriction"),
    ("apache-2", "you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("gpl", "licensed under the GNU General Public License"),
    ("lgpl", "licensed under the GNU Lesser General Public License"),
    ("mpl-2", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("cc0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work"),
    ("cc-by", "licensed under a Creative Commons Attribution"),
]

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: After lower-casing A-Z: ASCII letters and digits, and everything outside ASCII.
_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER), F.lit(_WORD), F.lit(0))


def _hash(words: Column, at: Column) -> Column:
    return F.xxhash64(*(F.get(words, at + j) for j in range(GRAM)))


def _grams(words: Column, listed: list[int] | None = None) -> Column:
    """(pos, hash, gram) of the rolling grams, of those whose hash is listed where there is a list; none for fewer words than
    a gram has. Only these few leave the row that holds all words."""
    n = F.size(words) - GRAM
    places = F.when(n >= 0, F.sequence(F.lit(0), F.greatest(n, F.lit(0)))).otherwise(F.expr("cast(array() as array<int>)"))
    if listed is not None:
        places = F.filter(places, lambda i: _hash(words, i).isin(listed))
    return F.transform(places, lambda i: F.struct(i.alias("pos"), _hash(words, i).alias("hash"), F.slice(words, i + 1, GRAM).alias("gram")))


def _templates(spark: SparkSession, phrases: list[tuple[str, str]], notices: list[tuple[str, str]]) -> DataFrame:
    """(hash, gram, template, base, label, grams, tpos): a row for each gram of each template."""
    rows = [(i, base, label, text) for i, (base, label, text) in enumerate([*((True, *p) for p in phrases), *((False, *n) for n in notices)])]
    table = spark.createDataFrame(rows, "template int, base boolean, label string, text string").withColumn("w", words_of(F.col("text")))
    table = table.select("template", "base", "label", (F.size("w") - GRAM + 1).alias("grams"), F.explode(_grams(F.col("w"))).alias("g"))
    return table.select("g.hash", "g.gram", "template", "base", "label", "grams", F.col("g.pos").alias("tpos"))


def _longest_chain(votes: Column) -> Column:
    """Length of the longest chain of (pos, back) that goes forward in pos and backward in back, votes in order.

    The state is the greatest `back` that ends a chain of each length; votes of one place come with the least back first, so
    that none follows another."""

    def add(ends: Column, vote: Column) -> Column:
        shorter = F.size(F.filter(ends, lambda x: x > vote["back"]))
        return F.concat(F.slice(ends, F.lit(1), shorter), F.array(vote["back"]), F.slice(ends, shorter + 2, F.size(ends)))

    return F.size(F.aggregate(votes, F.expr("cast(array() as array<int>)"), add))


def scan_licenses(docs: DataFrame, text_col: str = "text", phrases: list[tuple[str, str]] | None = None, notices: list[tuple[str, str]] | None = None) -> DataFrame:
    """docs without its text, and n_words, n_base (places of phrases), first_word, last_word (least and greatest start of
    a phrase, words from 0; else null), base_labels, labels (distinct, sorted, comma-joined; with the notices' labels),
    score (greatest share of a template found, 0 to 1) and spans (of phrases and notices: label, start, stop in words; of
    notice spans that overlap, the best).

    A template needs three words at least. Null texts count as empty: no words, nothing found. Every row is judged by
    itself, so repeated rows get the same result; columns of docs with the new names give way. Work grows with a text's
    length, whatever it repeats.
    """
    spark = docs.sparkSession
    templates = _templates(spark, PHRASES if phrases is None else phrases, NOTICES if notices is None else notices)
    known = [r[0] for r in templates.select("hash").distinct().limit(LISTED_GRAMS + 1).collect()]
    new = {"n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"}
    kept = [c for c in docs.columns if c.lower() not in new and c != text_col]
    packed, row = free_name(docs, "packed"), free_name(docs, "row_key")
    words = docs.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias(packed) if kept else F.struct(F.lit(1)).alias(packed), F.monotonically_increasing_id().alias(row), words_of(F.col(f"`{text_col}`")).alias("w"))
    # a first element, at -1, keeps a line for each row and what belongs to it; it votes for nothing. Neither the words nor
    # the other columns stand beside the elements, so none of them is copied for each gram
    keeper = F.struct(F.lit(-1).alias("pos"), F.lit(0).cast("long").alias("hash"), F.expr("cast(array() as array<string>)").alias("gram"), F.struct(F.size("w").cast("long").alias("n_words"), F.col(packed).alias("columns")).alias("own"))
    grams = F.transform(_grams(F.col("w"), known if len(known) <= LISTED_GRAMS else None), lambda g: g.withField("own", F.lit(None)))
    lines = words.select(row, F.explode(F.concat(F.array(keeper), grams)).alias("g")).select(row, "g.pos", "g.hash", "g.gram", F.col("g.own.n_words").alias("n_words"), F.col("g.own.columns").alias(packed))
    met = lines.join(broadcast_if_small(templates), ["hash", "gram"], "left").where((F.col("pos") < 0) | F.col("template").isNotNull())
    votes = met.select(packed, row, "n_words", "template", "base", "label", "grams", "pos", "tpos").repartition(row)  # all that follows groups by row, so this is the only shuffle
    diagonal = F.col("pos") - F.col("tpos")
    anchors = F.when(F.col("pos") >= 0, F.sequence(diagonal - F.when(F.col("base"), 0).otherwise(NEAR), diagonal)).otherwise(F.array(F.lit(None).cast("int")))
    windows = votes.select("*", F.explode(anchors).alias("anchor")).groupBy(row, "template", "base", "label", "grams", "anchor")
    windows = windows.agg(
        F.first(packed, ignorenulls=True).alias(packed),
        F.max("n_words").alias("n_words"),
        F.array_sort(F.collect_list(F.when(F.col("pos") >= 0, F.struct("pos", (-F.col("tpos")).alias("back"))))).alias("votes"),
        F.min("pos").alias("a"),
        F.max("pos").alias("b"),
    )
    shares = windows.withColumn("share", F.when(F.col("grams") > 0, _longest_chain(F.col("votes")) / F.col("grams"))).drop("votes")
    nearby = Window.partitionBy(row, "template").orderBy("anchor").rangeBetween(-NEAR, NEAR)
    best = F.max(F.struct("share", -F.col("anchor"))).over(nearby) == F.struct("share", -F.col("anchor"))
    spans = shares.withColumn("best", best)
    phrase = F.col("base") & (F.col("share") >= 1)
    notice = ~F.col("base") & (F.col("share") >= COVERAGE)
    joined = lambda test: F.array_join(F.array_sort(F.collect_set(F.when(test, F.col("label")))), ",")
    out = spans.groupBy(row).agg(
        F.first(packed, ignorenulls=True).alias(packed),
        F.max("n_words").alias("n_words"),
        F.count(F.when(phrase, 1)).alias("n_base"),
        F.min(F.when(phrase, F.col("a"))).cast("long").alias("first_word"),
        F.max(F.when(phrase, F.col("a"))).cast("long").alias("last_word"),
        joined(phrase).alias("base_labels"),
        joined(phrase | notice).alias("labels"),
        F.coalesce(F.max("share"), F.lit(0.0)).alias("score"),
        F.array_sort(F.collect_list(F.when(phrase | (notice & F.col("best")), F.struct(F.col("a").alias("start"), (F.col("b") + GRAM).alias("stop"), "label")))).alias("spans"),
    )
    return out.select(*[F.col(f"`{packed}`.`{c}`").alias(c) for c in kept], "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans")
