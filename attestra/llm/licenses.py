"""License scans: MinHash bands over overlapping text windows, then exact containment.

A text's word shingles are cut into windows of ``2 * stride`` that start every ``stride``
shingles, so that any run of ``stride`` shingles lies inside one window. Templates longer than that are cut
into pieces of ``stride`` shingles; a document that holds 0.75 of a template holds 0.75 of one
of its pieces at least. A window takes the value of its shingles that is smallest under each of ``BANDS`` masks (the
value nearest to the mask), and each is a band. Under one mask, a window and a piece share the band with a probability of
their Jaccard similarity: 1/2 if the window holds the whole piece, 1/3 if it holds 0.75 of it. Masks of one hash are not
independent functions, so no product of these is claimed; in 20,000 simulated windows each, all that hold a whole piece share a
band of 16, and 0.9997 of those that hold 0.75 of it (0.999 for pieces of 4). Further windows and pieces add to this. Templates of one or two shingles are looked up in windows of one shingle. Retrieved templates are verified by exact shingle containment in the whole
document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .decontam import PERCENT, document_shingles, item_shingles
from .store import read, stage
from .words import LETTER_WORD, SHINGLE, keep_ids, shingle_rows, sized_broadcast, words

BANDS = 16
#: By the most shingles of a template: the stride (and length of a piece), the width of a window
#: and the bands. A window of one shingle needs one band, which always collides.
CLASSES = ((2, 1, 1, 1), (4, 4, 8, BANDS), (1 << 30, 8, 16, BANDS))
#: Seeds of the hash functions: multiples of an odd constant, so any number of them is defined.
SEEDS = [((k + 1) * 0x9E3779B97F4A7C15) % (1 << 64) - (1 << 63) for k in range(BANDS)]

# Short public license notices, by SPDX identifier.
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("MIT", "Released under the MIT License."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("LGPL-3.0", "This library is licensed under the GNU Lesser General Public License, version 3."),
    ("BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    (
        "MIT-text",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation "
        "files (the Software), to deal in the Software without restriction",
    ),
    (
        "Apache-2.0-text",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, "
        "WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    ),
    (
        "GPL-text",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as "
        "published by the Free Software Foundation",
    ),
)


def _hashes(df: DataFrame) -> DataFrame:
    """(id, h): the array of shingle hashes of a text; a text of fewer than 5 words has one."""
    at = F.sequence(F.lit(0), F.size("w") - SHINGLE)
    rolled = F.transform(at, lambda i: F.xxhash64(*[F.get(F.col("w"), i + k) for k in range(SHINGLE)]))
    return df.where(F.size("w") >= SHINGLE).select("id", rolled.alias("h"))


def _bands(df: DataFrame, width: int, bands: int, starts: Column) -> DataFrame:
    """(id, band): under each hash function the smallest value of ``width`` shingles from each start.

    Two explodes and a ``least`` in one generated stage; the function's seed is mixed in.
    """
    rows = df.withColumn("s", F.explode(starts)).withColumn("seed", F.explode(F.array(*[F.lit(x) for x in SEEDS[:bands]])))
    values = [F.get(F.col("h"), F.col("s") + k).bitwiseXOR(F.col("seed")) for k in range(width)]
    return rows.select("id", F.xxhash64(F.least(*values) if width > 1 else values[0], "seed").alias("band"))


def template_bands(templates: DataFrame) -> list[DataFrame]:
    """By class: (id, band) of every template or of each of its pieces."""
    hashed = _hashes(templates)
    out, least = [], 0
    for most, stride, _, bands in CLASSES:
        mine = hashed.where((F.size("h") > least) & (F.size("h") <= most))
        # The last piece ends with the template, so it may overlap the one before.
        last = F.greatest(F.size("h") - stride, F.lit(0))
        starts = F.array_distinct(F.concat(F.sequence(F.lit(0), last, F.lit(stride)), F.array(last)))
        out.append(_bands(mine, stride, bands, starts))
        least = most
    return out


def scan(docs: DataFrame, templates: DataFrame, percent: int = PERCENT, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Documents that hold at least ``percent`` hundredths of a template's distinct shingles:
    doc_id, license, n_shared, n_template, containment.

    ``templates`` has license and text. Templates of fewer than 5 words are one shingle and are
    looked up directly. Null and empty texts hold nothing; rows with one doc_id (null included)
    count as one document; empty tables give an empty result; other columns are ignored.
    """
    known = stage(item_shingles(templates, "license", "text"), "templates")
    lengths = sorted(r["len"] for r in known.select("len").distinct().collect()) or [SHINGLE]
    n_known = known.count()
    split = templates.select(F.col("license").alias("id"), words("text", LETTER_WORD, lower=True).alias("w"))
    bands = template_bands(split)
    hashed = _hashes(docs.select(F.col(key).alias("id"), words(text, LETTER_WORD, lower=True).alias("w")))
    wanted = None
    for (_, stride, width, functions), table in zip(CLASSES, bands, strict=True):
        table = stage(table.distinct().withColumnRenamed("id", "license"), f"bands{stride}")
        if not (n := table.count()):
            continue
        starts = F.sequence(F.lit(0), F.size("h") - 1, F.lit(stride))
        hit = _bands(hashed, width, functions, starts).join(sized_broadcast(table, n), "band").select("id", "license")
        wanted = hit if wanted is None else wanted.unionAll(hit)
    if short := [n for n in lengths if n < SHINGLE]:
        tiny = sized_broadcast(known.where(F.col("len") < SHINGLE), n_known)
        hit = document_shingles(docs, short, key, text).join(tiny, ["len", "h"]).select(F.col("doc").alias("id"), F.col("item").alias("license"))
        wanted = hit if wanted is None else wanted.unionAll(hit)
    if wanted is None:
        wanted = docs.select(F.col(key).alias("id"), F.lit("").alias("license")).limit(0)
    wanted = stage(wanted.distinct().select(F.col("id").alias("_id"), F.col("license").alias("_license")), "candidates")

    hold = stage(wanted.select("_id").distinct(), "hold")
    again = keep_ids(docs, key, hold)
    shared = document_shingles(again, lengths, key, text).join(sized_broadcast(known, n_known), ["len", "h"])
    shared = shared.select("doc", "item", "n", "len", "h").distinct().groupBy("doc", "item", "n").agg(F.count("*").alias("n_shared"))
    kept = shared.where(100 * F.col("n_shared") >= percent * F.col("n"))
    kept = kept.join(wanted, F.col("doc").eqNullSafe(F.col("_id")) & F.col("item").eqNullSafe(F.col("_license")), "left_semi")
    return kept.select(
        F.col("doc").alias(key), F.col("item").alias("license"), "n_shared", F.col("n").alias("n_template"), (F.col("n_shared") / F.col("n")).alias("containment")
    )


def templates(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(TEMPLATES), "license string, text string")


def op9_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(read(spark, sf_dir, "documents"), templates(spark))


_VALUES = ", ".join("('{}', '{}')".format(*(x.replace("'", "''") for x in t)) for t in TEMPLATES)
SQL = rf"""
WITH templates(license, text) AS (VALUES {_VALUES}), d AS (
  SELECT doc_id, regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}]+') AS w FROM documents
), b AS (
  SELECT license, regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}]+') AS w FROM templates
), bs AS (
  SELECT DISTINCT license, array_to_string(w[i:i + 4], ' ') AS s FROM (SELECT license, w, unnest(range(1, len(w) - 3)) AS i FROM b)
), n AS (
  SELECT license, count(*) AS n_template FROM bs GROUP BY license
), ds AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM d WHERE len(w) >= 5)
)
SELECT ds.doc_id, bs.license, count(*) AS n_shared, n.n_template, count(*) / n.n_template AS containment
FROM ds JOIN bs USING (s) JOIN n USING (license) GROUP BY ds.doc_id, bs.license, n.n_template HAVING 100 * count(*) >= 75 * n.n_template
"""
