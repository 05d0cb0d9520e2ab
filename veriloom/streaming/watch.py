"""Manuscripts as a stream: every batch of new files is checked for consistency and claims."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from veriloom.operators import consistency


def documents(spark: SparkSession, path: str) -> DataFrame:
    """A stream of (doc_id, text): one document for each .tex file that appears under ``path``; includes are not followed."""
    raw = spark.readStream.format("text").option("wholetext", "true").option("pathGlobFilter", "*.tex").option("recursiveFileLookup", "true").load(path)
    return raw.select(F.regexp_extract(F.col("_metadata.file_path"), "[^/]*$", 0).alias("doc_id"), F.regexp_replace("value", "^﻿", "").alias("text"))


def watch(docs: DataFrame, out: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Append the claims of each batch to ``out``. A batch that is run again replaces what it wrote before."""

    def write(batch: DataFrame, number: int) -> None:
        consistency.claims(batch).withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return docs.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
