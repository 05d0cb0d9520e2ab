"""Shared scratch space, and Arrow batches for Python workers."""

from __future__ import annotations

import ctypes
import gc

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veriloom.plans.tables import Tables

_SLOTS = 1 << 23


class Workspace(Tables):
    """One folder of intermediate Parquet tables for one run of one operator."""

    save = Tables.keep

    def sweep(self) -> None:
        """Let Spark remove the shuffle files of tables that are written by now; else they stay until the driver happens to collect its garbage. Executors give back their heaps too."""
        gc.collect()
        self.spark.sparkContext._jvm.System.gc()
        ease(self.spark)


def ease(spark: SparkSession) -> None:
    """Let executors collect their garbage and give back the rest of their heaps, which else stay as large as they ever were beside the Python workers: a task for every core, of some tenths of a second."""
    n = spark.sparkContext.defaultParallelism
    spark.range(0, n, 1, n).select(F.reflect(F.lit("java.lang.System"), F.lit("gc"))).write.format("noop").mode("overwrite").save()


def sift(rows: DataFrame, key: Column, wanted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``rows`` whose ``key`` may be in ``wanted`` (its first column, longs), and the rows whose key surely isn't there.

    A key is looked up in a table of ``_SLOTS`` bits, one megabyte at every
    size; a key that isn't wanted passes as often as the table is full. So a
    join of whole texts with a few wanted ones moves little more than those.
    """
    spark = rows.sparkSession
    slot_of = lambda c: F.pmod(F.xxhash64(c.cast("long")), F.lit(_SLOTS))
    slots = wanted.select(slot_of(F.col(wanted.columns[0])).alias("s")).groupBy(F.expr("shiftright(s, 6)").alias("at"))
    found = slots.agg(F.expr("bit_or(shiftleft(1L, CAST(s % 64 AS INT)))").alias("word")).toArrow()
    words = np.zeros(_SLOTS // 64, dtype=np.int64)
    words[found.column("at").to_numpy()] = found.column("word").to_numpy()
    slot, name = fresh(rows.columns, "slot", "bits")
    bits = F.broadcast(spark.createDataFrame(pa.table({name: pa.array([words], pa.list_(pa.int64()))})))
    own = rows.withColumn(slot, F.when(key.isNotNull(), slot_of(key)))
    there = F.getbit(F.get(F.col(name), F.shiftright(F.col(slot), 6).cast("int")), (F.col(slot) % 64).cast("int")) == 1
    return own.join(bits, there, "left_semi").drop(slot), own.join(bits, there, "left_anti").drop(slot)


def in_batches(batches, rows: int):
    """The batches cut to at most ``rows`` rows, so that a Python worker never turns many whole texts into objects at once; the session stays as it is."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def tidy(run, rows: int = 10_000):
    """``run`` for mapInArrow over batches of at most ``rows`` rows, giving freed memory back to the system when a task ends: idle workers stay small."""

    def tidied(batches):
        try:
            yield from run(in_batches(batches, rows))
        finally:
            release()

    return tidied


def release() -> None:
    """Give freed memory back to the system."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass  # not every C library has it


def fresh(columns: list[str], *names: str) -> list[str]:
    """The names, each with as many underscores before it as it takes to differ from all ``columns``."""
    taken = {c.lower() for c in columns}
    out = []
    for n in names:
        while n.lower() in taken:
            n = "_" + n
        taken.add(n.lower())
        out.append(n)
    return out
