"""License notices in texts, by MinHash bands over windows of words.

A template of t words belongs to the window class s, the least power of two
with t <= s. A class cuts a text into windows of 2 s words, s words apart, so a
run of up to s words lies whole in one window. Windows and templates are sets
of shingles of three words, as notices are often shorter than five. Each band
is the least hash of a set under a function of its own; a window and a template
that agree in one band are a candidate pair. A window that holds ``least`` of a
template has at least some resemblance J to it, and a class gets as many bands
as miss such a pair with a probability (1 - J)^bands below ``miss``. Candidate
pairs are verified by exact containment: the share of the template's shingles
that the window holds.

A band can only agree if the window holds the template's shingle of least hash,
so only windows with such a shingle are hashed at all; this loses nothing.
Everything is built from DataFrame operations.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SHINGLE = 3
LEAST = 0.8
MISS = 1e-4
BROADCAST_BYTES = 10 << 20

# Wording of public license notices.
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0"),
    (
        "Apache-2.0",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is "
        "distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied",
    ),
    ("MIT", "Released under the MIT License"),
    ("MIT", "Licensed under the MIT License"),
    (
        "MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        "documentation files, to deal in the Software without restriction, including without limitation the rights "
        "to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
    ),
    (
        "BSD",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided "
        "that the following conditions are met",
    ),
    (
        "ISC",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is "
        "hereby granted",
    ),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3"),
    (
        "GPL",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
        "Public License as published by the Free Software Foundation",
    ),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0"),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0"),
    ("All-rights-reserved", "All rights reserved"),
)


def words_of(text: Column) -> Column:
    """Runs of letters and digits, in lower case."""
    plain = F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "))
    return F.filter(F.split(plain, " "), lambda w: w != "")


def shingles_of(hashes: Column) -> Column:
    """Hash of each run of SHINGLE words, from the words' hashes."""
    last = F.size(hashes) - SHINGLE
    runs = F.transform(
        F.sequence(F.lit(0), F.greatest(last, F.lit(0))),
        lambda i: F.xxhash64(*[F.get(hashes, i + j) for j in range(SHINGLE)]),
    )
    return F.when(last >= 0, runs).otherwise(F.array().cast("array<bigint>"))


class Index:
    """Band values of the templates, per window class."""

    def __init__(self, spark: SparkSession, templates=TEMPLATES, least: float = LEAST, miss: float = MISS):
        named = spark.createDataFrame(
            [(i, n, t) for i, (n, t) in enumerate(templates)], "template int, license string, text string"
        )
        named = named.withColumn("words", words_of(F.col("text")))
        named = named.withColumn("hashes", F.transform("words", lambda w: F.xxhash64(w)))
        rows = named.select("template", "license", F.size("words").alias("n"), shingles_of(F.col("hashes")).alias("set")).collect()
        self.sets = {r.template: sorted(set(r.set)) for r in rows}
        if not all(self.sets.values()):
            raise ValueError(f"a template needs {SHINGLE} words")
        self.license = {r.template: r.license for r in rows}
        self.stride = {r.template: max(SHINGLE + 1, 1 << (r.n - 1).bit_length()) for r in rows}
        self.bands: dict[int, int] = {}
        for t, stride in self.stride.items():
            need = math.ceil(least * len(self.sets[t]) - 1e-9)
            alike = need / (2 * stride - SHINGLE + 1 + len(self.sets[t]) - need)
            self.bands[stride] = max(self.bands.get(stride, 1), math.ceil(math.log(miss) / math.log(1 - alike)))
        sets = spark.createDataFrame(
            [(t, self.license[t], self.stride[t], self.sets[t], self.bands[self.stride[t]]) for t in self.sets],
            "template int, license string, stride int, set array<long>, bands int",
        )
        found = sets.select("template", "stride", F.posexplode(least_hashes(F.col("set"), F.col("bands"))).alias("band", "value")).collect()
        self.values = [tuple(r) for r in found]
        low = sets.select(F.explode(least_shingles(F.col("set"), F.col("bands"))).alias("x")).distinct().collect()
        self.marks = sorted(r.x for r in low)
        # Both grow with the templates alone, and their size is known here.
        self.table = small(spark.createDataFrame(self.values, "template int, stride int, band int, value long"), 24 * len(self.values))
        self.templates = small(sets.drop("bands", "stride"), 8 * sum(map(len, self.sets.values())))
        self.least = least


def small(df: DataFrame, size: int) -> DataFrame:
    """df, marked for broadcast while its ``size`` in bytes allows that."""
    return F.broadcast(df) if size <= BROADCAST_BYTES else df


def least_hashes(items: Column, bands: Column) -> Column:
    """The least hash of a set under each of the band functions."""
    return F.transform(F.sequence(F.lit(1), bands), lambda b: F.array_min(F.transform(items, lambda x: F.xxhash64(x, b))))


def least_shingles(items: Column, bands: Column) -> Column:
    """The shingles that have the least hash under some band function."""
    pairs = lambda b: F.array_min(F.transform(items, lambda x: F.struct(F.xxhash64(x, b).alias("h"), x.alias("x"))))
    return F.array_distinct(F.transform(F.sequence(F.lit(1), bands), lambda b: pairs(b)["x"]))


def scanned(documents: DataFrame, templates=TEMPLATES, least: float = LEAST, miss: float = MISS) -> DataFrame:
    """(doc_id, license, containment, windows, first_word) for each notice found in ``documents`` (doc_id, text).

    ``containment`` is the greatest of all windows and of the license's
    templates, ``windows`` the number of places (starts of windows) that reach
    ``least`` and ``first_word`` the first of them, counted in words from 0. A
    NULL or empty text holds no notice. Rows that share a doc_id are scanned
    each for itself and reported together; repeated rows count once. Other
    columns are ignored; no row gives no row.
    """
    index = Index(documents.sparkSession, templates, least, miss)
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = documents.select("doc_id", words_of(text).alias("words"))
    rows = rows.select("doc_id", F.transform("words", lambda w: F.xxhash64(w)).alias("hashes"))
    rows = rows.select("doc_id", shingles_of(F.col("hashes")).alias("set"))
    places = F.filter(F.transform("set", lambda x, i: F.when(x.isin(index.marks), i)), lambda i: i.isNotNull())
    rows = rows.withColumn("places", places)

    def windows(stride: int) -> Column:
        starts = F.flatten(F.transform("places", lambda p: F.array(F.floor(p / stride), F.floor(p / stride) - 1)))
        starts = F.filter(F.array_distinct(starts), lambda k: k >= 0)
        size = 2 * stride - SHINGLE + 1
        return F.transform(
            starts,
            lambda k: F.struct(
                F.lit(stride).alias("stride"),
                F.lit(index.bands[stride]).alias("bands"),
                (k * stride).alias("first_word"),
                F.slice(F.col("set"), (k * stride + 1).cast("int"), F.lit(size)).alias("part"),
            ),
        )

    # The outer forms: for the others the planner would test the arrays' sizes first, and so compute them twice,
    # and a filter pushed below these projections would hash the words anew for each shingle.
    cut = rows.select("doc_id", F.inline_outer(F.concat(*[windows(s) for s in sorted(index.bands)])))
    cut = cut.where("size(part) > 0")
    bands = least_hashes(F.col("part"), F.col("bands"))
    banded = cut.select("doc_id", "stride", "first_word", "part", F.posexplode_outer(bands).alias("band", "value"))
    # A window that meets a template in several bands comes several times, which changes none of the sums below;
    # so nothing is exchanged before containment has decided.
    pairs = banded.join(index.table, ["stride", "band", "value"]).join(index.templates, "template")
    pairs = pairs.withColumn("containment", F.size(F.array_intersect("part", "set")) / F.size("set")).where(F.col("containment") >= least)
    return pairs.groupBy("doc_id", "license").agg(
        F.max("containment").alias("containment"),
        F.count_distinct("first_word").alias("windows"),
        F.min("first_word").alias("first_word"),
    )
