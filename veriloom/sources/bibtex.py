"""BibTeX files as tables: a tokenizer, a function over texts, and a batch data source ``bibtex``."""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

MONTHS = {m[:3].lower(): m for m in "January February March April May June July August September October November December".split()}
ENTRY = "key string, entry_type string, fields map<string,string>"
_NAME = re.compile(r"[^\s\"#%'(),={}]+")


class _Scanner:
    def __init__(self, text: str, at: int):
        self.text, self.at = text, at

    def space(self) -> None:
        while self.at < len(self.text) and self.text[self.at].isspace():
            self.at += 1

    def take(self, letter: str) -> bool:
        self.space()
        if self.text[self.at : self.at + 1] == letter:
            self.at += 1
            return True
        return False

    def name(self) -> str:
        self.space()
        m = _NAME.match(self.text, self.at)
        if not m:
            return ""
        self.at = m.end()
        return m[0]

    def enclosed(self, end: str) -> str:
        """Up to the closing letter outside inner braces; the opening one is already taken."""
        depth, start = 0, self.at
        while self.at < len(self.text):
            c = self.text[self.at]
            if c == "\\":
                self.at += 1
            elif c == end and depth == 0:
                self.at += 1
                return self.text[start : self.at - 1]
            elif c == "{":
                depth += 1
            elif c == "}":
                depth -= 1
            self.at += 1
        raise ValueError("no end")

    def value(self, macros: dict[str, str]) -> str:
        """Braced, quoted or bare parts, joined by the number sign; a bare word is a macro if one is defined."""
        parts = []
        while True:
            self.space()
            if self.take("{"):
                parts.append(self.enclosed("}"))
            elif self.take('"'):
                parts.append(self.enclosed('"'))
            else:
                word = self.name()
                if not word:
                    raise ValueError("no value")
                parts.append(macros.get(word.lower(), word))
            if not self.take("#"):
                return "".join(parts)


def parse(text: str) -> Iterator[tuple[str, str, dict[str, str]]]:
    """(key, type, fields) of the entries in order. Types and field names are lower case; types of any name are kept.

    Month and string macros are resolved. Comments and preambles are skipped.
    An entry that can't be read is skipped, and reading goes on at the next at-sign.
    """
    macros = dict(MONTHS)
    text = text.removeprefix("\ufeff")
    at = text.find("@")
    while at >= 0:
        s = _Scanner(text, at + 1)
        kind = s.name().lower()
        end = "}" if s.take("{") else ")" if s.take("(") else ""
        try:
            if kind == "comment" and end:
                s.enclosed(end)
            elif kind == "preamble" and end:
                s.value(macros)
            elif kind == "string" and end:
                name = s.name().lower()
                if s.take("="):
                    macros[name] = s.value(macros)
            elif kind and end:
                s.space()
                m = re.compile(r"[^,\s}]*").match(text, s.at)
                key, s.at = m[0].strip(), m.end()
                fields: dict[str, str] = {}
                while s.take(","):
                    name = s.name().lower()
                    if not name:
                        break
                    if not s.take("="):
                        raise ValueError("no equals sign")
                    value = re.sub(r"[ \t]*\r?\n\s*", "\n", s.value(macros)).strip()
                    fields.setdefault(name, value)
                if not s.take(end):
                    raise ValueError("no end")
                yield key, kind, fields
        except ValueError:
            s.at = at + 1
        at = text.find("@", max(s.at, at + 1))


_ROW = T.StructType([T.StructField("pos", T.IntegerType()), T.StructField("key", T.StringType()), T.StructField("entry_type", T.StringType()), T.StructField("fields", T.MapType(T.StringType(), T.StringType()))])


@F.udtf(returnType=_ROW)
class _Entries:
    def eval(self, text: str):
        for i, (key, kind, fields) in enumerate(parse(text or ""), 1):
            yield i, key, kind, fields


def entries(files: DataFrame) -> DataFrame:
    """``bib_entries`` of ``files`` (doc_id, bib_file, file_no, text): doc_id, bib_file, ordinal, key, entry_type, fields.

    ``ordinal`` orders the entries of a document over its files, in order of declaration.
    """
    spark = files.sparkSession
    spark.udtf.register("veriloom_bib_entries", _Entries)
    out = spark.sql("SELECT _f.doc_id, _f.bib_file, _f.file_no, _e.* FROM {f} _f, LATERAL veriloom_bib_entries(_f.text) _e", f=files)
    return out.select("doc_id", "bib_file", (F.col("file_no").cast("long") * 1_000_000 + F.col("pos")).alias("ordinal"), "key", "entry_type", "fields")


class _Part(InputPartition):
    def __init__(self, path: str):
        super().__init__(path)
        self.path = path


class BibtexSource(DataSource):
    """``spark.read.format("bibtex").load(path)``: path, pos, key, entry_type, fields; one partition a file.

    For files that every executor can open; others are read with Spark's text
    reader and passed to :func:`entries`.
    """

    @classmethod
    def name(cls) -> str:
        return "bibtex"

    def schema(self) -> str:
        return f"path string, pos int, {ENTRY}"

    def reader(self, schema) -> DataSourceReader:
        return _BibtexReader(self.options)


class _BibtexReader(DataSourceReader):
    def __init__(self, options):
        self.path = options["path"]

    def partitions(self) -> list[_Part]:
        import glob
        import os

        found = [self.path] if os.path.isfile(self.path) else sorted(glob.glob(os.path.join(self.path, "**", "*.bib"), recursive=True))
        return [_Part(p) for p in found]

    def read(self, partition: _Part):
        with open(partition.path, encoding="utf-8-sig") as f:
            for i, (key, kind, fields) in enumerate(parse(f.read()), 1):
                yield partition.path, i, key, kind, fields
