"""License scans by diagonal voting.

All rolling word k-gram hashes of the texts meet the positions of the templates in a Spark join.
Hits of a text and a template vote for the diagonal on which they lie (text place minus template
place); neighbouring diagonals are merged, which bridges inserted and lost words, and the span
they cover is verified: enough of the template, densely enough, and for each similar template of
another license some k-gram at the words in which the two differ. A phrase is a template that must
be covered whole on one diagonal.
"""

from __future__ import annotations

from difflib import SequenceMatcher

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hazardframe.llm.common import keep

K = 3
#: Words by which neighbouring diagonals may differ; least part of a template; least density.
SLACK, COVERED, DENSE = 4, 0.6, 0.5

# Phrases that count wherever their words stand in a row.
PHRASES = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}

# Notices that grant or name a license.
NOTICES = [
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction"),
    ("mit", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("apache-2", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license"),
    ("apache-2", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied"),
    ("gpl-3", "this work is licensed under the gnu general public license version 3"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("lgpl", "it under the terms of the gnu lesser general public license as published by the free software foundation"),
    ("agpl", "it under the terms of the gnu affero general public license as published by the free software foundation"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("cc-by-sa", "this work is licensed under a creative commons attribution sharealike 4 0 international license"),
    ("cc-by-nc", "this work is licensed under a creative commons attribution noncommercial 4 0 international license"),
    ("cc0", "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work"),
    ("all-rights-reserved", "copyright all rights reserved no part of this publication may be reproduced"),
]

_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: Column) -> Column:
    """Runs of a-z, 0-9 and letters beyond ASCII, A-Z lower-cased."""
    lower = F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER)
    return F.regexp_extract_all(lower, F.lit(_WORD), F.lit(0))


def grams(df: DataFrame, keys: list[str], word: str = "w", k: int = K) -> DataFrame:
    """(keys, place, hash) of every k words in a row of the array `word`."""
    hashed = df.filter(F.size(word) >= k).select(*keys, F.transform(word, lambda w: F.xxhash64(w)).alias("h"))
    rolled = F.transform(
        F.sequence(F.lit(0), F.size("h") - k), lambda i: F.xxhash64(*[F.get("h", i + j) for j in range(k)]))
    return hashed.select(*keys, F.posexplode(rolled).alias("place", "hash"))


def templates(spark: SparkSession, phrases: dict[str, str], notices: list[tuple[str, str]]) -> DataFrame:
    """(template, label, phrase, n_grams, at, hash), a few hundred rows fixed by the lists."""
    rows = [(i, label, True, text.split()) for i, (text, label) in enumerate(phrases.items())]
    rows += [(len(rows) + i, label, False, text.split()) for i, (label, text) in enumerate(notices)]
    frame = spark.createDataFrame(rows, "template int, label string, phrase boolean, w array<string>")
    counted = frame.withColumn("n_grams", F.size("w") - K + 1)
    return grams(counted, ["template", "label", "phrase", "n_grams"]).withColumnRenamed("place", "at")


def deciding(own: list[str], other: list[str], k: int = K) -> list[int]:
    """Places of the k-grams of `own` that tell it from `other`: those at a change between two
    stretches of k - 1 words or more that both have in the same order. Empty if there is none."""
    match = SequenceMatcher(None, own, other, autojunk=False)
    same = [m for m in match.get_matching_blocks() if m.size >= k - 1]
    theirs = {tuple(other[i : i + k]) for i in range(len(other) - k + 1)}
    at = {i for x, y in zip(same, same[1:], strict=False) for i in range(max(0, x.a + x.size - k + 1), min(y.a, len(own) - k + 1))}
    at |= {i for x, y in zip(same, same[1:], strict=False) for i in range(max(0, y.a - k + 1), min(y.a, len(own) - k + 1))}
    return sorted(i for i in at if tuple(own[i : i + k]) not in theirs)


def requirements(spark: SparkSession, phrases: dict[str, str], notices: list[tuple[str, str]]) -> DataFrame:
    """(template, needed): for each similar notice of another license the places of which one must
    be hit; a row per notice, fixed by the lists."""
    rows = []
    for i, (label, text) in enumerate(notices):
        others = (deciding(text.split(), t.split()) for name, t in notices if name != label)
        rows.append((len(phrases) + i, [x for x in others if x]))
    return spark.createDataFrame(rows, "template int, needed array<array<int>>")


def spans(
    docs: DataFrame, phrases: dict[str, str] = PHRASES, notices: list[tuple[str, str]] = NOTICES,
    text: str = "text", key: str = "doc_id",
) -> DataFrame:
    """(d, x, label, phrase, first, last, covered): verified spans of words first to last, from 0.

    `d` is the key and `x` the text's hash: rows equal in both count once. Phrases and notices
    need three words at least."""
    own = docs.select(F.col(key).alias("d"), F.xxhash64(F.col(text)).alias("x"), words(F.col(text)).alias("w"))
    known = templates(docs.sparkSession, phrases, notices)
    hits = grams(own, ["d", "x"]).join(F.broadcast(known), "hash")  # fixed lists
    votes = hits.groupBy("d", "x", "template", "label", "phrase", "n_grams", (F.col("place") - F.col("at")).alias("diagonal")).agg(
        F.collect_set("at").alias("at"))  # bounded by the template
    votes = keep(votes, "votes")  # read twice below, the texts once
    whole = votes.filter("phrase and size(at) = n_grams").select(
        "d", "x", "label", "phrase", F.col("diagonal").alias("first"), (F.col("diagonal") + F.col("n_grams") + K - 2).alias("last"),
        F.lit(1.0).alias("covered"))
    # Diagonals of one text and template, in order; a gap begins a new span.
    line = Window.partitionBy("d", "x", "template").orderBy("diagonal")
    rest = votes.filter("not phrase").withColumn(
        "new", F.coalesce((F.col("diagonal") - F.lag("diagonal").over(line) > SLACK).cast("int"), F.lit(0)))
    runs = rest.withColumn("span", F.sum("new").over(line.rowsBetween(Window.unboundedPreceding, 0)))
    hit = runs.select("d", "x", "template", "label", "n_grams", "span", "diagonal", F.explode("at").alias("at"))
    merged = hit.groupBy("d", "x", "template", "label", "n_grams", "span", "at").agg(
        F.min("diagonal").alias("low"), F.max("diagonal").alias("high"))
    found = merged.groupBy("d", "x", "template", "label", "n_grams", "span").agg(
        F.count(F.lit(1)).alias("n"), F.collect_set("at").alias("hit"), F.min(F.col("low") + F.col("at")).alias("first"),
        F.max(F.col("high") + F.col("at") + K - 1).alias("last"))
    covered = F.col("n") / F.col("n_grams")
    dense = (F.col("n") + K - 1) / (F.col("last") - F.col("first") + 1)
    needed = F.broadcast(requirements(docs.sparkSession, phrases, notices))  # a row per notice
    decided = F.forall("needed", lambda places: F.arrays_overlap(places, "hit"))
    verified = found.filter((covered >= COVERED) & (dense >= DENSE)).join(needed, "template").filter(decided).select(
        "d", "x", "label", F.lit(False).alias("phrase"), "first", "last", covered.alias("covered"))
    return whole.unionByName(verified)


def scan(docs: DataFrame, text: str = "text", key: str = "doc_id", **lists) -> DataFrame:
    """(key, n_words, n_base, first_word, last_word, base_labels, labels, score) for every row.

    Null and empty texts have no words and no labels; repeated rows each get their result; a null
    key is handed on; further columns are ignored."""
    each = spans(docs, text=text, key=key, **lists).groupBy("d", "x").agg(
        F.count(F.when(F.col("phrase"), 1)).alias("n_base"),
        F.min(F.when(F.col("phrase"), F.col("first"))).alias("first_word"),
        F.max(F.when(F.col("phrase"), F.col("first"))).alias("last_word"),
        F.collect_set(F.when(F.col("phrase"), F.col("label"))).alias("base"),
        F.collect_set("label").alias("all"), F.max("covered").alias("score"))
    rows = docs.select(F.col(key).alias("d"), F.xxhash64(F.col(text)).alias("x"), F.size(words(F.col(text))).cast("long").alias("n_words"))
    met = rows.alias("r").join(each.alias("e"), F.col("r.d").eqNullSafe(F.col("e.d")) & (F.col("r.x") == F.col("e.x")), "left")

    def joined(name: str) -> Column:
        return F.coalesce(F.array_join(F.array_sort(name), ","), F.lit(""))

    return met.select(
        F.col("r.d").alias(key), "n_words", F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"),
        F.col("first_word").cast("long"), F.col("last_word").cast("long"),
        joined("base").alias("base_labels"), joined("all").alias("labels"), F.coalesce("score", F.lit(0.0)).alias("score"))
