"""License scans: phrases, and an exact set-similarity join of text blocks with license notices. DataFrame functions only.

A block is a window of LINES consecutive lines; a notice is a template, and both are sets of words. A block meets a template when it
holds THRESHOLD of the template's words. The join finds all such pairs without comparing all: words are ordered by how many documents
hold them, rarest first; two sets that share `need` words share one in the first size - need + 1 words of each (prefix), both have at
least `need` words (length), and behind their first shared word both must still hold enough (positional). A pair is met at its first
shared word only, so none is found twice, and its shared words are then counted.

Words that no template has cannot be shared, so a set is kept as its words among those of all templates: a block is never larger than
the templates' vocabulary. A document is itself a superset of its blocks, so only documents that hold `need` words of a template are cut
into blocks. Both are exact.

Nothing is shuffled but the counts of the templates' words, a row for each, and the matches. The templates are a parameter; their
vocabulary bounds what is broadcast and what the driver reads.

Defined results: a null text is an empty one and has no words; a null id is carried along; repeated rows get a row each; words of equal
frequency are in the order of their characters, which changes no result; an empty table gives no rows; texts are read whole, however
long; only the id and the text are read, so other columns, whatever their names, have no effect and are not returned.
"""

from __future__ import annotations

import re
import string
from collections.abc import Sequence
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, shared_table

#: What is between words: ASCII but digits and small letters, once capitals are lowered.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
PHRASES = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))

#: Lines of a block, and the share of a template's words that a block must hold, in tenths: templates of up to nine words are held whole.
LINES, THRESHOLD = 4, 9

#: Fixed texts of notices and their labels.
TEMPLATES = (
    ("mit", "Released under the MIT License."),
    ("mit", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction'),
    ("apache", "Licensed under the Apache License, Version 2.0"),
    ("gpl", "This work is licensed under the GNU General Public License"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("lgpl", "under the terms of the GNU Lesser General Public License"),
    ("agpl", "under the terms of the GNU Affero General Public License"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    ("cc-by-nc", "Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0"),
    ("cc-by-sa", "Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("unlicense", "This is free and unencumbered software released into the public domain"),
)


class Template(NamedTuple):
    label: str
    words: list[str]
    need: int


def parsed(templates: Sequence[tuple[str, str]], threshold: int) -> list[Template]:
    out = []
    for label, text in templates:
        low = text.translate(str.maketrans(string.ascii_uppercase, string.ascii_lowercase))
        words = sorted({w for w in re.split(BETWEEN, low) if w})
        if not words or not 0 < threshold <= 10:
            raise ValueError("a template needs a word, and a threshold is 1 to 10 tenths")
        out.append(Template(label, words, -(-threshold * len(words) // 10)))
    if not out:
        raise ValueError("no templates")
    return out


def lowered(text: Column) -> Column:
    return F.translate(F.coalesce(text, F.lit("")), string.ascii_uppercase, string.ascii_lowercase)


def words(low: Column) -> Column:
    return F.filter(F.split(low, BETWEEN, -1), lambda w: w != "")


def places(low: Column, ws: Column, phrases: Sequence[tuple[str, str]]) -> Column:
    """Structs (at, label): where a phrase's words stand one after the other. Texts that lack one of its words are not searched."""

    def of(phrase: str, label: str) -> Column:
        parts = phrase.split()
        starts = F.sequence(F.lit(0), F.size(ws) - len(parts))
        held = lambda i: reduce(lambda a, b: a & b, [F.get(ws, i + j) == p for j, p in enumerate(parts)])
        found = F.transform(F.filter(starts, held), lambda i: F.struct(i.cast("long").alias("at"), F.lit(label).alias("label")))
        possible = reduce(lambda a, b: a & b, [F.contains(low, F.lit(p)) for p in parts]) & (F.size(ws) >= len(parts))
        return F.when(possible, found).otherwise(F.array().cast("array<struct<at:bigint,label:string>>"))

    return F.concat(*[of(*p) for p in phrases])


def _literal(xs: Sequence[str]) -> Column:
    return F.array(*[F.lit(x) for x in xs])


def _measured(text: Column, templates: Sequence[Template], vocabulary: Sequence[str], phrases: Sequence[tuple[str, str]]) -> Column:
    """Words, places of phrases, words of the vocabulary, and whether the whole text holds enough words of a template."""

    def of(low: Column, ws: Column) -> Column:
        def sets(own: Column) -> Column:
            enough = reduce(lambda a, b: a | b, [F.size(F.array_intersect(own, _literal(t.words))) >= t.need for t in templates])
            large = F.size(own) >= min(t.need for t in templates)
            return F.struct(F.size(ws).cast("long").alias("n_words"), places(low, ws, phrases).alias("found"), own.alias("own"), (large & enough).alias("open"))

        return let(F.array_intersect(_literal(vocabulary), ws), sets)

    return let(lowered(text), lambda low: let(words(low), lambda ws: of(low, ws)))


def measured(df: DataFrame, templates: Sequence[Template], *, key: str, text: str, phrases: Sequence[tuple[str, str]] = PHRASES) -> DataFrame:
    """A written table: a number for each row, its key, n_words, found, own, and the text where blocks are to be looked at."""
    vocabulary = sorted({w for t in templates for w in t.words})
    rows = df.select(F.col(key).alias("__key"), F.col(text).alias("__text"))
    each = rows.select("__key", "__text", _measured(F.col("__text"), templates, vocabulary, phrases).alias("m"))
    return shared_table(each.select(F.monotonically_increasing_id().alias("row"), "__key", "m.n_words", "m.found", "m.own", F.when(F.col("m.open"), F.col("__text")).alias("__text")), "licenses")


def matches(table: DataFrame, templates: Sequence[Template], lines: int) -> DataFrame:
    """row, block (its first line), template (its number), label and share: all blocks of measured rows that meet a template."""
    spark = table.sparkSession
    counts = {r["w"]: r["count"] for r in table.select(F.explode("own").alias("w")).groupBy("w").count().collect()}  # a row for each of the templates' words
    order = sorted({w for t in templates for w in t.words}, key=lambda w: (counts.get(w, 0), w))
    rank = {w: i for i, w in enumerate(order)}
    ranked = [sorted(t.words, key=rank.__getitem__) for t in templates]
    prefix = [(n, t.label, ws, w, i, t.need) for n, (t, ws) in enumerate(zip(templates, ranked, strict=True)) for i, w in enumerate(ws[: len(ws) - t.need + 1])]
    index = spark.createDataFrame(prefix, "template int, label string, words array<string>, word string, i int, need int")

    def windows(ls: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.greatest(F.size(ls) - lines, F.lit(0))), lambda i: F.array_join(F.slice(ls, i + 1, lines), "\n"))

    cut = table.where(F.col("__text").isNotNull()).select("row", F.posexplode(let(F.split("__text", "\n", -1), windows)).alias("block", "__block"))
    sets = cut.select("row", "block", F.array_intersect(_literal(order), words(lowered(F.col("__block")))).alias("own"))
    least = min(t.need for t in templates)
    sets = sets.where(F.size("own") >= least)
    probes = sets.select("row", "block", "own", F.posexplode(F.slice("own", F.lit(1), F.size("own") - least + 1)).alias("j", "word"))
    size = F.size("own")
    length = size >= F.col("need")
    prefixed = F.col("j") <= size - F.col("need")
    positional = F.least(F.size("words") - F.col("i"), size - F.col("j")) >= F.col("need")
    met = probes.join(F.broadcast(index), "word").where(length & prefixed & positional)
    shared = met.withColumn("shared", F.array_intersect("own", "words")).where((F.get("shared", F.lit(0)) == F.col("word")) & (F.size("shared") >= F.col("need")))
    return shared.select("row", "block", "template", "label", (F.size("shared") / F.size("words")).alias("share"))


def scan_licenses(
    df: DataFrame,
    *,
    key: str = "doc_id",
    text: str = "text",
    templates: Sequence[tuple[str, str]] = TEMPLATES,
    threshold: int = THRESHOLD,
    lines: int = LINES,
    phrases: Sequence[tuple[str, str]] = PHRASES,
) -> DataFrame:
    """key, n_words, n_base (places of phrases), first_word, last_word, base_labels, labels, n_blocks and score, a row for each input row.

    The score is 1 where a phrase stands, else the largest share of a template that a block holds, 0 where none holds enough.
    """
    known = parsed(templates, threshold)
    table = measured(df, known, key=key, text=text, phrases=phrases)
    found = matches(table, known, lines).groupBy("row").agg(F.collect_set("label").alias("more"), F.max("share").alias("share"), F.count_distinct("block").alias("n_blocks"))
    base = F.array_distinct(F.transform("found", lambda x: x["label"]))
    at = F.transform("found", lambda x: x["at"])
    both = table.drop("own", "__text").join(found, "row", "left").withColumn("base", base).withColumn("at", at)
    every = F.array_union("base", F.coalesce("more", F.array().cast("array<string>")))
    return both.select(
        F.col("__key").alias(key),
        "n_words",
        F.size("found").cast("long").alias("n_base"),
        F.array_min("at").alias("first_word"),
        F.array_max("at").alias("last_word"),
        F.array_join(F.array_sort("base"), ",").alias("base_labels"),
        F.array_join(F.array_sort(every), ",").alias("labels"),
        F.coalesce("n_blocks", F.lit(0)).alias("n_blocks"),
        F.when(F.size("found") > 0, F.lit(1.0)).otherwise(F.coalesce("share", F.lit(0.0))).alias("score"),
    )
