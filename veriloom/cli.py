"""Command line: check the manuscripts of a folder against recorded answers.

    python -m veriloom.cli FOLDER --responses PARQUET [--replies PARQUET] [--store PARQUET] --output FOLDER
"""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from veriloom.operators.judging import REPLIES
from veriloom.operators.report import write_markdown
from veriloom.plans import verify
from veriloom.sources import store, tex


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="veriloom", description="Check citations, bibliography entries and claims of LaTeX manuscripts.")
    p.add_argument("folder")
    p.add_argument("--responses", required=True, help="recorded answers of bibliographic services (Parquet)")
    p.add_argument("--replies", help="recorded answers of a model (Parquet)")
    p.add_argument("--store", help="abstract store (Parquet); new rows are added")
    p.add_argument("--read-only", action="store_true", help="add nothing to the store")
    p.add_argument("--output", required=True, help="folder for the reports")
    return p


def main(argv: list[str] | None = None) -> int:
    """Exit code: the highest of all documents (4 model failed, 3 no source answered, 1 findings, 0); usage errors exit with 2."""
    args = parser().parse_args(argv)
    spark = SparkSession.builder.appName("veriloom").getOrCreate()
    files = tex.read_files(spark, args.folder)
    replies = spark.read.parquet(args.replies) if args.replies else spark.createDataFrame([], REPLIES)
    have = store.check_columns(spark.read.parquet(args.store)) if args.store else None
    result = verify.run(files, spark.read.parquet(args.responses), replies, have)
    write_markdown(result.reports, args.output)
    if have is not None and not args.read_only:
        store.append(args.store, store.add_new(have, result.new_store_rows))
    return result.exit_codes.selectExpr("coalesce(max(exit_code), 0)").first()[0]


if __name__ == "__main__":
    raise SystemExit(main())
