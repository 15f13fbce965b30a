"""Operator 1: license scans by diagonal voting.

Every rolling group of ``K`` words of every document meets the positions of that group in the license templates in a Spark
join on its hash (the words themselves are compared too). A meeting at document position p and template position q votes for
the diagonal p - q. Votes are counted by (document, template, diagonal); diagonals at most ``BAND`` apart (and less than the
template's size) are one alignment if they follow each other, so inserted or dropped words don't split it; and an alignment is a finding if its groups cover
at least ``COVER`` of the template's words and its span is at most ``STRETCH`` times the template.

Scale: groups are made, hashed and joined inside the JVM in one pass; the template side is a few thousand rows, broadcast
after a check of their number; only meetings are shuffled, with neither text nor words.

Defined cases: null and empty texts, and those of fewer than K words, have no findings; long texts are scanned whole;
templates of fewer than K words never match; a template that occurs twice in a document is found twice; repeated rows report
once per (doc_id, text); null ids stay null; empty documents or templates give an empty result; further columns of
documents are ignored. Words are runs of ASCII letters, digits and non-ASCII characters; ASCII letters are folded.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .license_texts import TEXTS
from .shared import small_side
from .textkernel import need, row_key

K = 3
BAND = 3
COVER = 0.75
STRETCH = 1.5
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: (license, template) pairs: one-line notices and telling clauses of public licenses, then their texts.
TEMPLATES = [
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "This project is licensed under the terms of the MIT license."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "you may not use this file except in compliance with the License"),
    ("Apache-2.0", "distributed under the License is distributed on an AS IS BASIS"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "either version 3 of the License, or (at your option) any later version"),
    ("GPL-2.0", "either version 2 of the License, or (at your option) any later version"),
    ("GPL", "under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("LGPL", "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"),
    ("AGPL-3.0", "under the terms of the GNU Affero General Public License as published by the Free Software Foundation"),
    ("BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted"),
    ("BSD-3-Clause", "may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("EPL-2.0", "made available under the terms of the Eclipse Public License 2.0"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related rights to this work"),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("Proprietary", "All rights reserved. Unauthorized copying of this file, via any medium, is strictly prohibited."),
    ("Proprietary", "All rights reserved."),
    *TEXTS,
]


def words(text: Column) -> Column:
    """Folded words of a text, in order."""
    return F.array_remove(F.split(F.translate(text, _UPPER, _LOWER), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"), "")


def _groups(rows: DataFrame, *keep: str) -> DataFrame:
    """One row for each group: its position, its hash and its words."""
    n = F.size("w")
    made = F.transform(
        F.when(n >= K, F.sequence(F.lit(0), n - K)).otherwise(F.array().cast("array<int>")),
        lambda i: F.xxhash64(*[F.col("w")[i + j] for j in range(K)]),
    )
    # outer: for an inner explode the planner infers a filter that would cut the text into words anew for every group
    return rows.withColumn("hashes", made).select(*keep, "w", F.posexplode_outer("hashes").alias("at", "h"))


def template_positions(spark: SparkSession, templates: list[tuple[str, str]]) -> tuple[DataFrame, int]:
    """(template, license, size, q, h, gram) of every template group, and how many there are."""
    rows = [(i, name, text) for i, (name, text) in enumerate(templates)]
    table = spark.createDataFrame(rows, "template int, license string, text string").withColumn("w", words(F.col("text")))
    made = _groups(table.withColumn("size", F.size("w")), "template", "license", "size").where("h is not null")
    made = made.select("template", "license", "size", F.col("at").alias("q"), "h", *[F.col("w")[F.col("at") + j].alias(f"t{j}") for j in range(K)])
    return made, sum(len(text) for _, text in templates)  # no more groups than characters


def scan(docs: DataFrame, templates: list[tuple[str, str]] | None = None) -> DataFrame:
    """(doc_id, template, license, start_word, end_word, votes, coverage) of every verified alignment."""
    templates = TEMPLATES if templates is None else templates
    positions, most = template_positions(docs.sparkSession, templates)
    rows = need(docs, "doc_id", "text").where(F.col("text").isNotNull()).select("doc_id", *row_key(F.col("text")), words(F.col("text")).alias("w"))
    met = _groups(rows, "doc_id", "_k1", "_k2").join(small_side(positions, most), "h")
    met = met.where(functools.reduce(Column.__and__, [F.col("w")[F.col("at") + j] == F.col(f"t{j}") for j in range(K)]))
    met = met.select("doc_id", "_k1", "_k2", "template", "license", "size", "at", "q", (F.col("at") - F.col("q")).alias("diagonal")).distinct()
    doc = ["doc_id", "_k1", "_k2", "template", "license", "size"]
    voted = met.groupBy(*doc, "diagonal").agg(F.count("*").alias("votes"), F.min("at").alias("low"), F.max("at").alias("high"), F.collect_set("q").alias("q"))
    along = W.partitionBy("doc_id", "_k1", "_k2", "template").orderBy("diagonal")
    # copies of a template that follow at once are its size apart; the SQL, which has BAND alone, loses those of K words
    near = (F.col("diagonal") - F.lag("diagonal").over(along) <= F.least(F.lit(BAND), F.col("size") - 1)) & (F.col("low") - F.lag("high").over(along) <= F.col("size"))
    merged = voted.withColumn("new", F.when(near, 0).otherwise(1)).withColumn("alignment", F.sum("new").over(along.rowsBetween(W.unboundedPreceding, 0)))
    whole = merged.groupBy(*doc, "alignment").agg(F.sum("votes").alias("votes"), F.min("low").alias("start_word"), (F.max("high") + K).alias("end_word"), F.flatten(F.collect_list("q")).alias("q"))
    covered = F.size(F.array_distinct(F.flatten(F.transform("q", lambda q: F.array(*[q + j for j in range(K)])))))
    whole = whole.withColumn("covered", covered)
    verified = whole.where((F.col("covered") >= COVER * F.col("size")) & (F.col("end_word") - F.col("start_word") <= STRETCH * F.col("size")))
    return verified.select("doc_id", "template", "license", "start_word", "end_word", "votes", (F.col("covered") / F.col("size")).alias("coverage"))


def sql(templates: list[tuple[str, str]] = TEMPLATES) -> str:
    """The same over DuckDB's ``documents``."""
    split = "list_filter(string_split_regex(translate(text, '{u}', '{l}'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '')".format(u=_UPPER, l=_LOWER)
    values = ", ".join("({}, '{}', '{}')".format(i, name, text.replace("'", "''")) for i, (name, text) in enumerate(templates))
    return f"""
WITH t AS (SELECT template, license, {split} AS w FROM (VALUES {values}) v(template, license, text)),
tg AS (SELECT template, license, len(w) AS size, q, w[q + 1:q + {K}] AS gram FROM t, unnest(range(0, len(w) - {K - 1})) AS r(q)),
d AS (SELECT DISTINCT doc_id, text, {split} AS w FROM documents WHERE text IS NOT NULL),
g AS (SELECT doc_id, text, p, w[p + 1:p + {K}] AS gram FROM d, unnest(range(0, len(w) - {K - 1})) AS r(p)),
m AS (SELECT doc_id, text, template, license, size, p, q, p - q AS diagonal FROM g JOIN tg USING (gram)),
v AS (SELECT doc_id, text, template, license, size, diagonal, count(*) AS votes, min(p) AS low, max(p) AS high FROM m GROUP BY ALL),
l AS (SELECT *, CASE WHEN diagonal - lag(diagonal) OVER o <= {BAND} AND low - lag(high) OVER o <= size THEN 0 ELSE 1 END AS new FROM v
      WINDOW o AS (PARTITION BY doc_id, text, template ORDER BY diagonal)),
a AS (SELECT *, sum(new) OVER (PARTITION BY doc_id, text, template ORDER BY diagonal) AS alignment FROM l),
c AS (SELECT doc_id, text, template, alignment, count(DISTINCT q + j) AS covered FROM a JOIN m USING (doc_id, text, template, diagonal), unnest(range(0, {K})) AS r(j) GROUP BY ALL),
f AS (SELECT doc_id, text, template, license, size, alignment, sum(votes) AS votes, min(low) AS start_word, max(high) + {K} AS end_word FROM a GROUP BY ALL)
SELECT f.doc_id, CAST(f.template AS INTEGER) AS template, f.license, CAST(start_word AS INTEGER) AS start_word, CAST(end_word AS INTEGER) AS end_word, CAST(votes AS BIGINT) AS votes, covered / CAST(size AS DOUBLE) AS coverage
FROM f JOIN c ON f.doc_id IS NOT DISTINCT FROM c.doc_id AND f.text = c.text AND f.template = c.template AND f.alignment = c.alignment
WHERE covered >= {COVER} * size AND end_word - start_word <= {STRETCH} * size
"""


def op1_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
