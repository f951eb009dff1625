"""License notices by MinHash bands over overlapping text windows, with exact containment; DataFrame functions only.

Words are lower-cased runs of letters and digits. Shingles have five words; a template with fewer words is one shingle of its
own width. Windows have ``WINDOW`` shingles and start at every ``STRIDE``-th word; templates of 12 and more shingles are indexed by such
windows at *every* offset, so a copy of one in a text holds at least one document window that stands for a template window.
Shorter templates are indexed at scale 1, where a window is a single shingle.

A hash function of the family is the shingle's XXH64 with a mask of its own; a window's MinHash is its smallest masked value. Bands have one
row, ``HASHES`` of them. With a containment of 0.8, a window keeps a Jaccard similarity of 0.8 / 1.2 to the template's window on
average, and one band collides with probability 1 - (1/3)^6 = 0.9986; at scale 1 a band is the shingle itself, and every
shingle that survives collides for certain. A collision names a (text, template) pair, whose containment (the share of the
template's shingles that the text holds) is then counted exactly.

Long texts are worked on in segments of ``SEGMENT`` words that overlap by a quarter more than the longest template has words, so
that no row's arrays grow with a text's length and every copy lies in one segment; containment is that of the best segment.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

# The wording of well-known license notices, by SPDX identifier.
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("Apache-2.0", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."),
    ("MIT", "Released under the MIT License"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3"),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0"),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("all-rights-reserved", "All rights reserved"),
)

WIDTH, WINDOW, STRIDE, HASHES, SEGMENT = 5, 8, 4, 6, 4096
#: Masks of the hash family: multiples of the golden ratio's 64-bit fraction, as signed longs.
MASKS = [((0x9E3779B97F4A7C15 * (k + 1) + (1 << 63)) % (1 << 64)) - (1 << 63) for k in range(HASHES)]


def templates_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(i, name, text) for i, (name, text) in enumerate(TEMPLATES)], "template int, license string, text string")


def _words(text: str) -> str:
    return f"array_remove(split(lower(coalesce({text}, '')), '[^\\\\p{{L}}\\\\p{{N}}]+'), '')"


def _shingles(words: str, width: int) -> str:
    """Hash of each run of ``width`` words; none where there are fewer words."""
    run = ", ".join(f"get({words}, i + {j})" for j in range(width))
    return f"if(size({words}) < {width}, cast(array() as array<bigint>), transform(sequence(0, greatest(0, size({words}) - {width})), i -> xxhash64({run})))"


def _bands(hashes: str, at: str) -> list[str]:
    """The MinHash of the window that starts at ``at``, for each hash function; shingles beyond the end don't count."""
    return ["least(" + ", ".join(f"get({hashes}, {at} + {j}) ^ {mask}L" for j in range(WINDOW)) + ")" for mask in MASKS]


def template_index(templates: DataFrame) -> tuple[DataFrame, list[int]]:
    """``key, template, license, width, shingles`` for every band key of the templates, and the shingle widths in use."""
    t = templates.select("template", "license", F.expr(_words("text")).alias("words")).where("size(words) > 0")
    t = t.withColumn("width", F.least(F.size("words"), F.lit(WIDTH)))
    widths = sorted(r[0] for r in t.select("width").distinct().collect())
    index = None
    for width in widths:
        one = t.where(F.col("width") == width).withColumn("h", F.expr(_shingles("words", width))).withColumn("shingles", F.array_distinct("h"))
        long = one.where(F.size("h") >= WINDOW + STRIDE).withColumn("at", F.explode(F.expr(f"sequence(0, size(h) - {WINDOW})")))
        keys = long.withColumn("key", F.explode(F.array(*map(F.expr, _bands("h", "at"))))).drop("at")
        keys = keys.unionByName(one.where(F.size("h") < WINDOW + STRIDE).withColumn("key", F.explode("h")))
        keys = keys.select("key", "template", "license", "width", "shingles").distinct()
        index = keys if index is None else index.unionByName(keys)
    return index, widths


def scan(docs: DataFrame, templates: DataFrame, containment: float = 0.8, max_index_bytes: int = 1 << 26) -> DataFrame:
    """``docs(doc_id, text)``, ``templates(template, license, text)`` -> ``doc_id, license, template, containment``.

    One row for each document row and template whose containment reaches the limit; other documents give no row. Null and
    empty texts hold nothing; repeated rows give a result each. The template index is broadcast after its size is checked
    against ``max_index_bytes`` (its arrays of shingles counted); a larger one is joined by shuffle.
    """
    longest = templates.agg(F.max(F.expr(f"size({_words('text')})"))).first()[0] or 0
    overlap = max(512, longest + (longest + 3) // 4)
    index, widths = template_index(templates)
    if index is None:
        return docs.sparkSession.createDataFrame([], "doc_id long, license string, template int, containment double")
    if (index.agg(F.sum(64 + 8 * F.size("shingles"))).first()[0] or 0) <= max_index_bytes:
        index = F.broadcast(index)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("row_id"), F.expr(_words("text")).alias("w"))
    pieces = F.expr(f"transform(sequence(0, greatest(0, size(w) - {overlap} - 1), {SEGMENT}), i -> slice(w, i + 1, {SEGMENT + overlap}))")
    rows = rows.select("doc_id", "row_id", F.explode_outer(pieces).alias("s"))
    used = sorted({*widths, WIDTH})
    rows = rows.select("doc_id", "row_id", *[F.expr(_shingles("s", w)).alias(f"h{w}") for w in used])
    starts = f"if(size(h{WIDTH}) = 0, cast(array() as array<int>), sequence(0, greatest(0, size(h{WIDTH}) - 1), {STRIDE}))"
    keys = [f"h{w}" for w in widths] + [f"transform({starts}, i -> {band})" for band in _bands(f"h{WIDTH}", "i")]
    rows = rows.select("doc_id", "row_id", *(f"h{w}" for w in widths), F.expr(f"concat({', '.join(keys)})").alias("keys"))
    # explode takes a plain column, so that it and the lookup are one compiled loop that copies no array
    hits = rows.select("doc_id", "row_id", *(f"h{w}" for w in widths), F.explode_outer("keys").alias("key")).join(index, "key")
    own = F.expr("case " + " ".join(f"when width = {w} then h{w}" for w in widths) + " end")
    share = F.size(F.array_intersect(own, "shingles")) / F.size("shingles")
    hits = hits.select("doc_id", "row_id", "license", "template", share.alias("containment")).where(F.col("containment") >= containment)
    return hits.groupBy("row_id", "doc_id", "license", "template").agg(F.max("containment").alias("containment")).drop("row_id")
