"""The abstract store: a Parquet table (doi, abstract, provider, outcome, fetched_at, raw_json).

Rows are only ever added, one a DOI. Metadata of a row is a JSON object that is
checked whenever it is read; any defect makes it null.
"""

from __future__ import annotations

import sqlite3

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from veriloom.functions.identifiers import normalize_doi
from veriloom.sources.records import METADATA

STORE = "doi string, abstract string, provider string, outcome string, fetched_at string, raw_json string"
REQUIRED = ("doi", "abstract", "provider", "outcome", "fetched_at")
FORMAT = "veriloom/metadata-1"
STRINGS = ("title", "year", "journal", "volume", "issue", "pages")
_SHAPE = "format string, source string, matched_by string, doi string, fetched_at string, fields struct<title:string,author_names:array<string>,year:string,journal:string,volume:string,issue:string,pages:string>"
_ZONED = r"^\d{4}-\d{2}-\d{2}[T ]\d{2}(?::?\d{2}(?::?\d{2}(?:[.,]\d{1,6})?)?)?(?:Z|[+-]\d{2}(?::?\d{2}(?::?\d{2})?)?)$"


def check_columns(df: DataFrame) -> DataFrame:
    """``df`` if it has the required columns (more may follow), with ``raw_json`` added where missing."""
    lacking = [c for c in REQUIRED if c not in df.columns]
    if lacking:
        raise ValueError("not an abstract store, missing: " + ", ".join(lacking))
    return df if "raw_json" in df.columns else df.withColumn("raw_json", F.lit(None).cast("string"))


def decode_metadata(raw: Column, row_doi: Column, formats: tuple[str, ...] = (FORMAT,)) -> Column:
    """(source, matched_by, doi, fetched_at, fields) of checked metadata, else null."""
    tree = F.try_parse_json(raw)
    kind = lambda path: F.schema_of_variant(F.try_variant_get(tree, path, "variant"))
    data = F.from_json(raw, _SHAPE)
    own = normalize_doi(data["doi"])
    typed = F.lit(True)
    for name in STRINGS:
        typed = typed & F.coalesce(kind(f"$.fields.{name}") == "STRING", F.lit(True))
    typed = typed & F.coalesce(kind("$.fields.author_names").isin("ARRAY<STRING>", "ARRAY<VOID>", "ARRAY<>"), F.lit(True))
    for name in ("format", "source", "matched_by", "doi", "fetched_at"):
        typed = typed & (kind(f"$.{name}") == "STRING")
    stamp = data["fetched_at"]
    good = (
        typed & data["format"].isin(*formats) & data["source"].isin(*METADATA) & (data["matched_by"] == "doi") & own.startswith("10.") & (own == normalize_doi(row_doi))
        & stamp.rlike(_ZONED) & F.try_to_timestamp(F.regexp_extract(stamp, r"^\d{4}-\d{2}-\d{2}", 0), F.lit("yyyy-MM-dd")).isNotNull() & kind("$.fields").startswith("OBJECT")
    )
    return F.when(F.coalesce(good, F.lit(False)), F.struct(data["source"].alias("source"), data["matched_by"].alias("matched_by"), own.alias("doi"), stamp.alias("fetched_at"), data["fields"].alias("fields")))


def encode_metadata(source: Column, doi: Column, fields: Column, fetched_at: Column) -> Column:
    """Compact JSON that :func:`decode_metadata` accepts, else null."""
    text = F.to_json(F.struct(F.lit(FORMAT).alias("format"), source.alias("source"), F.lit("doi").alias("matched_by"), doi.alias("doi"), fetched_at.alias("fetched_at"), fields.alias("fields")))
    return F.when(decode_metadata(text, doi).isNotNull(), text)


def add_new(store: DataFrame, new: DataFrame, order: str = "ordinal") -> DataFrame:
    """Rows of ``new`` whose DOI the store lacks, the first by ``order`` of each DOI. To be appended; nothing is replaced."""
    first = new.groupBy("doi").agg(F.min_by(F.struct(*[c for c in new.columns if c != "doi"]), F.col(order)).alias("n")).select("doi", "n.*").drop(order)
    return first.join(store.select("doi"), "doi", "left_anti")


def append(store_path: str, new: DataFrame) -> None:
    new.select([c.split()[0] for c in STORE.split(", ")]).write.mode("append").parquet(store_path)


class _Range(InputPartition):
    pass


class SqliteStore(DataSource):
    """``spark.read.format("abstract_sqlite").load(path)``: imports a store kept in SQLite, read-only."""

    @classmethod
    def name(cls) -> str:
        return "abstract_sqlite"

    def schema(self) -> str:
        return STORE

    def reader(self, schema) -> DataSourceReader:
        return _SqliteReader(self.options["path"])


class _SqliteReader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self):
        return [_Range(0)]

    def read(self, partition):
        con = sqlite3.connect(f"file:{self.path}?mode=ro", uri=True)
        try:
            have = {r[1] for r in con.execute("PRAGMA table_info(abstracts)")}
            if not set(REQUIRED) <= have:
                raise ValueError("not an abstract store, missing: " + ", ".join(c for c in REQUIRED if c not in have))
            raw = "raw_json" if "raw_json" in have else "NULL"
            for row in con.execute(f"SELECT doi, abstract, provider, outcome, fetched_at, {raw} FROM abstracts"):  # noqa: S608
                yield tuple(None if v is None else str(v) for v in row)
        finally:
            con.close()


def register(spark: SparkSession) -> None:
    """Make the data sources of this package known to a session."""
    from veriloom.sources.bibtex import BibtexSource

    spark.dataSource.register(BibtexSource)
    spark.dataSource.register(SqliteStore)
