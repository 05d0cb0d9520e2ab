"""LaTeX documents as tables: files, include expansion, document texts and declared bibliographies.

``files`` is (doc_id, path, is_main, text): the files of each document, paths
relative to a common folder. Includes are expanded by joins, level by level.
"""

from __future__ import annotations

import posixpath

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veriloom.functions.latex import bibliography_files, embedded_bib_keys, has_embedded_bibliography, include_directives
from veriloom.plans.tables import Tables

DEPTH = 10


def read_files(spark: SparkSession, path: str, mains: list[str] | None = None) -> DataFrame:
    """``files`` of the folders under ``path``: one document for each folder right below it, or one for each of ``mains``.

    Files are read whole. ``valid`` tells whether a file is UTF-8; a byte-order mark is dropped.
    """
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{tex,bib}").load(path)
    name = F.regexp_replace(F.substring_index(F.col("path"), path.rstrip("/") + "/", -1), "^/+", "")
    text = F.regexp_replace(F.decode("content", "UTF-8"), "^\ufeff", "")
    own = raw.select(F.split(name, "/")[0].alias("doc_id"), name.alias("path"), F.is_valid_utf8(F.col("content").cast("string")).alias("valid"), text.alias("text"))
    main = F.col("path").isin(*mains) if mains else F.col("path").rlike(r"^[^/]+/(?:main|paper|[^/]*)\.tex$") & F.contains("text", F.lit("\\documentclass"))
    return own.withColumn("is_main", main)


def invalid_files(files: DataFrame) -> DataFrame:
    """(doc_id, note): an input error for each file that isn't UTF-8; it names the file only."""
    return files.filter("not valid").select("doc_id", F.concat(F.substring_index("path", "/", -1), F.lit(" is not valid UTF-8")).alias("note"))


def include_paths(name: str, root: str, here: str) -> list[str]:
    """Where an included file may be, best first: in the main file's folder, then the including file's; with the suffix first."""
    names = [name] if name.endswith(".tex") else [name + ".tex", name]
    return [posixpath.normpath(posixpath.join(folder, n)) for folder in (root, here) for n in names]


def parts(text: str) -> list[tuple[str, str | None]]:
    """A file as a list of (text, None) and (include command as it stands, file name), in order."""
    out, at = [], 0
    for name, start, end in include_directives(text):
        out += [(text[at:start], None), (text[start:end], name)]
        at = end
    return [*out, (text[at:], None)]


_PART = T.StructType([T.StructField("text", T.StringType()), T.StructField("name", T.StringType())])


@F.pandas_udf(T.ArrayType(_PART))
def _parts(text: pd.Series) -> pd.Series:
    return pd.Series([[{"text": a, "name": b} for a, b in parts(t if isinstance(t, str) else "")] for t in text])


@F.pandas_udf(T.StringType())
def _normal(path: pd.Series) -> pd.Series:
    return path.map(lambda p: posixpath.normpath(p) if isinstance(p, str) and p else None)


@F.pandas_udf(T.ArrayType(T.StringType()))
def _paths(name: pd.Series, main: pd.Series, here: pd.Series) -> pd.Series:
    folder = posixpath.dirname
    return pd.Series([include_paths(n, folder(m), folder(h)) for n, m, h in zip(name, main, here, strict=True)])


def documents(files: DataFrame) -> DataFrame:
    """(doc_id, path, text): each main file with its includes expanded.

    Files become rows of parts, and include commands are joined with the files
    they name, level by level, down to ``DEPTH`` levels; a command stays as it
    is if no file fits or the file includes itself. ``at`` is the place of a
    part, one number for each level.
    """
    keep = Tables(files.sparkSession, "includes").keep
    tex = files.filter("path not like '%.bib'").select("doc_id", _normal("path").alias("path"), "is_main", "text").filter("path is not null")
    own = keep(tex.select("doc_id", "path", "is_main", F.posexplode(_parts("text")).alias("n", "part")).select("doc_id", "path", "is_main", "n", "part.*"))
    first = own.filter("is_main").select("doc_id", F.col("path").alias("main"), F.col("path").alias("here"), F.array("path").alias("above"), F.array("n").alias("at"), "text", "name")
    names = own.select(F.col("doc_id").alias("_doc"), F.col("path").alias("_path")).distinct()
    below = own.select(F.col("doc_id").alias("_doc"), F.col("path").alias("_path"), F.col("n").alias("_n"), F.col("text").alias("_text"), F.col("name").alias("_name"))
    level, done = keep(first), []
    for _ in range(DEPTH):
        done.append(level.filter("name is null"))
        asked = level.filter("name is not null")
        if asked.isEmpty():
            break
        tried = asked.select("*", F.posexplode(_paths("name", "main", "here")).alias("rank", "path")).join(names, (F.col("doc_id") == F.col("_doc")) & (F.col("path") == F.col("_path")), "left")
        best = tried.groupBy("doc_id", "main", "here", "above", "at", "text", "name").agg(F.min_by("_path", F.when(F.col("_path").isNotNull(), F.col("rank"))).alias("child"))
        best = keep(best)
        fits = F.col("child").isNotNull() & ~F.array_contains("above", F.col("child"))
        done.append(best.filter(~F.coalesce(fits, F.lit(False))).drop("child"))
        both = best.filter(fits).join(below, (F.col("doc_id") == F.col("_doc")) & (F.col("child") == F.col("_path")))
        level = keep(both.select("doc_id", "main", F.col("child").alias("here"), F.concat("above", F.array("child")).alias("above"), F.concat("at", F.array("_n")).alias("at"), F.col("_text").alias("text"), F.col("_name").alias("name")))
    else:
        done.append(level)  # commands of the deepest level stay
    every = done[0]
    for more in done[1:]:
        every = every.unionByName(more)
    laid = every.groupBy("doc_id", "main").agg(F.array_sort(F.collect_list(F.struct("at", "text"))).alias("x"))  # the parts of one document
    return laid.select("doc_id", F.col("main").alias("path"), F.array_join(F.transform("x", lambda x: x["text"]), "").alias("text"))


def bibliographies(docs: DataFrame, files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Declared bibliography files of each document, and notes on missing ones.

    (doc_id, bib_file, file_no, text) with ``file_no`` in order of declaration, and (doc_id, note).
    """
    declared = docs.select("doc_id", F.col("path").alias("_main"), F.posexplode(bibliography_files("text")).alias("file_no", "bib_file"))
    folder = F.regexp_extract("_main", r"^(.*/)?[^/]*$", 1)
    declared = declared.withColumn("_path", F.concat(folder, F.regexp_replace("bib_file", r"^(?:\./)+", "")))
    have = files.filter("path like '%.bib'").select(F.col("doc_id").alias("_doc"), F.col("path").alias("_have"), "text")
    both = declared.join(have, (F.col("doc_id") == F.col("_doc")) & (F.col("_path") == F.col("_have")), "left")
    found = both.filter("_have is not null").select("doc_id", F.regexp_extract("bib_file", "[^/]*$", 0).alias("bib_file"), "file_no", "text")
    notes = both.filter("_have is null").select("doc_id", F.concat(F.lit("bibliography file not found: "), F.regexp_extract("bib_file", "[^/]*$", 0)).alias("note"))
    return found, notes.distinct()


def bibliography_format(docs: DataFrame) -> DataFrame:
    """(doc_id, bib_format, embedded_keys): ``external`` if files are declared, else ``embedded`` or ``none``."""
    form = F.when(F.size(bibliography_files("text")) > 0, "external").when(has_embedded_bibliography(F.col("text")), "embedded").otherwise("none")
    out = docs.select("doc_id", form.alias("bib_format"), embedded_bib_keys("text").alias("_keys"))
    return out.select("doc_id", "bib_format", F.when(F.col("bib_format") == "embedded", F.col("_keys")).otherwise(F.array().cast("array<string>")).alias("embedded_keys"))
