"""Licence scan: sparse TF-IDF cosine to templates, then inheritance from the nearest directory.

* Every line of a whole file that names a licence is a passage; so is the whole
  text of a file that is named like a licence file.
* Passages and templates are TF-IDF vectors; document frequencies of all words
  are counted over all files.
* A file whose best passage reaches ``LEAST`` carries that licence. The best
  licence file of a directory licenses the directory; files without a licence
  of their own take it from the nearest directory above them that has one.

Everything is DataFrame expressions. What is broadcast is one row for each word
of a template: a table fixed by this module.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veriloom.llm.workspace import Workspace

LEAST = 0.6
CUE = r"(?i)licen[sc]e|copyright|spdx|all rights reserved|public domain|redistribut|permission is hereby"
FILE_NAME = r"(?i)^(licen[sc]e|copying|copyright|unlicense)([-._].*)?$"
#: Licence, and wordings of its notices.
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("Apache-2.0", "Apache License Version 2.0, January 2004 terms and conditions for use, reproduction, and distribution"),
    ("BSD-2-Clause", "SPDX-License-Identifier: BSD-2-Clause"),
    ("BSD-3-Clause", "SPDX-License-Identifier: BSD-3-Clause"),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC0-1.0", "This work is dedicated to the public domain under the Creative Commons CC0 1.0 Universal dedication."),
    ("GPL-2.0", "This program is licensed under the GNU General Public License, version 2."),
    ("GPL-2.0", "SPDX-License-Identifier: GPL-2.0"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0"),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("LGPL-3.0", "This library is licensed under the GNU Lesser General Public License, version 3."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("Proprietary", "All rights reserved."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
)
SPLIT = "[^a-z0-9.]+"


def _words(text: str) -> list[str]:
    return [w for w in (x.strip(".") for x in re.split(SPLIT, text.lower())) if w]


def template_words() -> list[tuple[int, str, str, int]]:
    """(template, licence, word, occurrences)."""
    return [(n, name, w, ws.count(w)) for n, (name, text) in enumerate(TEMPLATES) for ws in [_words(text)] for w in sorted(set(ws))]


def words(text: Column) -> Column:
    return F.filter(F.transform(F.split(F.lower(text), SPLIT), lambda w: F.trim(w, F.lit("."))), lambda w: w != "")


def _frequencies(files: DataFrame) -> DataFrame:
    """(word, df): in how many files a word stands. Tasks count their own files first, so a word is shuffled once for each task."""
    spelled = F.array_distinct(F.split(F.lower("text"), SPLIT))  # "word." and "word" are one word
    own = F.array_distinct(F.transform(spelled, lambda w: F.trim(w, F.lit("."))))
    return files.select(F.explode(own).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("df")).filter("word <> ''")


def _idf(total: int, df: Column) -> Column:
    return F.log((1 + F.lit(total)) / (1 + F.coalesce(df, F.lit(0)))) + 1


def _weights(spark: SparkSession, frequencies: DataFrame, total: int) -> DataFrame:
    """(template, licence, word, w, norm): TF-IDF of the template words, and the norm of each template."""
    templates = F.broadcast(spark.createDataFrame(template_words(), "template int, licence string, word string, n int"))
    known = frequencies.join(templates.select("word").distinct(), "word", "left_semi")
    out = templates.join(known, "word", "left").select("template", "licence", "word", (F.col("n") * _idf(total, F.col("df"))).alias("w"))
    norms = out.groupBy("template").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return out.join(F.broadcast(norms), "template")


def scan(files: DataFrame, *, keys: tuple[str, ...] = ("path",), ws: Workspace | None = None) -> DataFrame:
    """Licence of each file of ``files`` (``path``, ``text`` and the other columns of ``keys``).

    Returns ``keys``, ``path``, ``licence`` (``none`` if there is none),
    ``how`` (``own``, ``inherited`` or ``none``), ``similarity`` (rounded to 6
    places; null without a licence) and ``directory`` (where an inherited
    licence comes from). Ties go to the licence that comes first by name; of a
    directory's licence files the most similar counts.

    Null and empty texts carry no licence and may inherit one. A null path is
    in no directory: it neither gives nor inherits. Repeated rows give repeated
    results. Other columns are ignored; ``keys`` may not name a column of the
    result other than ``path``. Empty tables give an empty result.
    """
    spark = files.sparkSession
    ws = ws or Workspace(spark, "licences")
    keys = tuple(k for k in keys if k != "path")
    own = files.select(*[F.col(k) for k in keys], F.col("path").cast("string").alias("path"), F.col("text").cast("string").alias("text"))
    total, frequencies = own.count(), ws.save(_frequencies(own), "frequencies")
    weights = ws.save(_weights(spark, frequencies, total), "weights")  # as many rows as the templates have words
    name = F.element_at(F.split("path", "/"), -1)
    is_file = F.coalesce(name.rlike(FILE_NAME), F.lit(False))
    directory = F.regexp_replace(F.regexp_extract("path", "^(.*)/[^/]*$", 1), "/+$", "")
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike(CUE))
    passages = F.array_distinct(F.concat(lines, F.when(is_file, F.array("text")).otherwise(F.array().cast("array<string>"))))
    marked = F.coalesce(F.col("text").rlike(CUE) | (is_file & (F.col("text") != "")), F.lit(False))
    found = own.filter(marked).select(F.explode(passages).alias("passage"))
    found = found.select(F.xxhash64("passage").alias("pid"), "passage").dropDuplicates(["pid"])
    # similarity is computed once for each different passage
    counted = found.select("pid", F.explode(words(F.col("passage"))).alias("word")).groupBy("pid", "word").agg(F.count(F.lit(1)).alias("n"))
    valued = ws.save(counted.join(frequencies, "word", "left").select("pid", "word", (F.col("n") * _idf(total, F.col("df"))).alias("v")), "valued")
    norm = valued.groupBy("pid").agg(F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("own_norm"))
    dots = valued.join(F.broadcast(weights.select("template", "licence", "word", "w", "norm")), "word").groupBy("pid", "template", "licence", "norm").agg(F.sum(F.col("v") * F.col("w")).alias("dot"))
    alike = dots.join(norm, "pid").select("pid", "licence", (F.round(F.col("dot") / (F.col("norm") * F.col("own_norm")) * 1e6).cast("long") / F.lit(1e6)).alias("similarity")).filter(F.col("similarity") >= LEAST)
    first = F.min(F.struct((-F.col("similarity")).alias("s"), F.col("licence").alias("licence"))).alias("b")  # most similar, then by name
    best = alike.groupBy("pid").agg(first).select("pid", (-F.col("b.s")).alias("similarity"), F.col("b.licence").alias("licence"))
    best = ws.save(best, "passages")

    pids = F.transform(passages, lambda p: F.xxhash64(p))
    scored = own.filter(marked).select(F.xxhash64(F.coalesce("path", F.lit("")), "text").alias("fid"), F.explode(pids).alias("pid")).distinct().join(best, "pid")
    top = ws.save(scored.groupBy("fid").agg(first).select("fid", (-F.col("b.s")).alias("similarity"), F.col("b.licence").alias("licence")), "files")

    fid = F.when(marked, F.xxhash64(F.coalesce("path", F.lit("")), "text"))
    tagged = own.select(*keys, "path", fid.alias("fid"), F.when(F.col("path").isNotNull(), directory).alias("dir"), is_file.alias("is_file"))
    tagged = ws.save(tagged.join(top, "fid", "left").drop("fid"), "tagged")
    given = tagged.filter("is_file and licence is not null and dir is not null").select("dir", "licence", "similarity")
    given = given.groupBy("dir").agg(F.min(F.struct((-F.col("similarity")).alias("s"), F.col("licence").alias("licence"))).alias("g"))
    given = ws.save(given.select(F.col("dir").alias("up"), F.col("g.licence").alias("up_licence"), (-F.col("g.s")).alias("up_similarity")), "given")

    levels = F.split("dir", "/")
    above = F.transform(F.sequence(F.lit(1), F.size(levels)), lambda n: F.array_join(F.slice(levels, 1, n), "/"))
    dirs = tagged.filter("licence is null and dir is not null").select("dir").distinct().select("dir", F.explode(F.array_distinct(F.concat(F.array(F.lit("")), above))).alias("up"))
    nearest = dirs.join(given, "up").groupBy("dir").agg(F.max(F.struct(F.length("up").alias("depth"), "up", "up_licence", "up_similarity")).alias("n"))
    nearest = ws.save(nearest.select("dir", F.col("n.up").alias("directory"), "n.up_licence", "n.up_similarity"), "nearest")
    out = tagged.join(nearest, "dir", "left")
    mine = F.col("licence").isNotNull()
    return out.select(
        *keys,
        "path",
        F.coalesce("licence", "up_licence", F.lit("none")).alias("licence"),
        F.when(mine, "own").when(F.col("up_licence").isNotNull(), "inherited").otherwise("none").alias("how"),
        F.when(mine, F.col("similarity")).otherwise(F.col("up_similarity")).alias("similarity"),
        F.when(~mine, F.col("directory")).alias("directory"),
    )


def document_files(docs: DataFrame) -> DataFrame:
    """The documents as files: ``source/dA/dB/name``, named LICENSE-id where the first line names a licence, else id.txt."""
    first = F.substring_index("text", "\n", 1)
    name = F.when(F.coalesce(first.rlike(CUE), F.lit(False)), F.concat(F.lit("LICENSE-"), F.col("doc_id").cast("string"))).otherwise(F.concat(F.col("doc_id").cast("string"), F.lit(".txt")))
    top, low = F.pmod(F.floor(F.col("doc_id") / 1000), F.lit(50)), F.pmod(F.floor(F.col("doc_id") / 50), F.lit(20))
    path = F.concat_ws("/", F.coalesce("source", F.lit("-")), F.concat(F.lit("d"), top.cast("string")), F.concat(F.lit("e"), low.cast("string")), name)
    return docs.select("doc_id", F.when(F.col("doc_id").isNotNull(), path).alias("path"), "text")


def oracle() -> str:
    """DuckDB SQL for :func:`scan` over :func:`document_files` of the table ``documents``."""
    q = lambda s: "'" + s.replace("'", "''") + "'"
    rows = ", ".join(f"({t}, {q(n)}, {q(w)}, {c})" for t, n, w, c in template_words())
    split = f"list_filter(list_transform(string_split_regex(lower(X), {q(SPLIT)}), lambda w: trim(w, '.')), lambda w: w <> '')"
    return f"""
      WITH f AS (
        SELECT doc_id, text, coalesce(source, '-') || '/d' || CAST((doc_id // 1000) % 50 AS VARCHAR) || '/e' || CAST((doc_id // 50) % 20 AS VARCHAR) AS dir,
          coalesce(regexp_matches(string_split(text, chr(10))[1], {q(CUE)}), false) AS is_file FROM documents),
      g AS (SELECT *, dir || '/' || CASE WHEN is_file THEN 'LICENSE-' || CAST(doc_id AS VARCHAR) ELSE CAST(doc_id AS VARCHAR) || '.txt' END AS path FROM f),
      t(template, licence, word, n) AS (VALUES {rows}),
      df AS (SELECT word, count(*) AS df FROM (SELECT doc_id, unnest(list_distinct({split.replace("X", "text")})) AS word FROM documents) GROUP BY word),
      w AS (SELECT template, licence, t.word, ln((1 + (SELECT count(*) FROM documents)) / (1 + coalesce(df, 0))) + 1 AS idf, n FROM t LEFT JOIN df ON df.word = t.word),
      tn AS (SELECT template, sqrt(sum(n * idf * n * idf)) AS norm FROM w GROUP BY template),
      iw AS (SELECT word, ln((1 + (SELECT count(*) FROM documents)) / (1 + df)) + 1 AS idf FROM df),
      p AS (
        SELECT doc_id, unnest(list_distinct(list_concat(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, {q(CUE)})), CASE WHEN is_file THEN [text] ELSE [] END))) AS passage FROM g),
      d AS (SELECT row_number() OVER () AS pid, passage FROM (SELECT DISTINCT passage FROM p)),
      c AS (SELECT pid, word, count(*) AS n FROM (SELECT pid, unnest({split.replace("X", "passage")}) AS word FROM d) GROUP BY pid, word),
      v AS (SELECT pid, c.word, c.n * idf AS v FROM c JOIN iw ON iw.word = c.word),
      pn AS (SELECT pid, sqrt(sum(v * v)) AS own FROM v GROUP BY pid),
      a AS (SELECT v.pid, licence, CAST(round(sum(v.v * w.n * w.idf) / (any_value(tn.norm) * any_value(pn.own)) * 1e6) AS BIGINT) / CAST(1e6 AS DOUBLE) AS s
        FROM v JOIN w ON w.word = v.word JOIN tn ON tn.template = w.template JOIN pn ON pn.pid = v.pid GROUP BY v.pid, w.template, licence),
      b AS (SELECT doc_id, licence, s, row_number() OVER (PARTITION BY doc_id ORDER BY s DESC, licence) AS r FROM p JOIN d ON d.passage = p.passage JOIN a ON a.pid = d.pid WHERE s >= {LEAST}),
      o AS (SELECT g.doc_id, path, dir, is_file, b.licence, b.s FROM g LEFT JOIN b ON b.doc_id = g.doc_id AND b.r = 1),
      given AS (SELECT dir, licence, s, row_number() OVER (PARTITION BY dir ORDER BY s DESC, licence) AS r FROM o WHERE is_file AND licence IS NOT NULL),
      n AS (SELECT o.doc_id, given.dir, given.licence, given.s, row_number() OVER (PARTITION BY o.doc_id ORDER BY length(given.dir) DESC) AS r
        FROM o JOIN given ON given.r = 1 AND (o.dir = given.dir OR starts_with(o.dir, given.dir || '/')))
      SELECT o.doc_id, path, coalesce(o.licence, n.licence, 'none') AS licence,
        CASE WHEN o.licence IS NOT NULL THEN 'own' WHEN n.licence IS NOT NULL THEN 'inherited' ELSE 'none' END AS how,
        CASE WHEN o.licence IS NOT NULL THEN o.s ELSE n.s END AS similarity, CASE WHEN o.licence IS NULL THEN n.dir END AS directory
      FROM o LEFT JOIN n ON n.doc_id = o.doc_id AND n.r = 1
    """  # noqa: S608
