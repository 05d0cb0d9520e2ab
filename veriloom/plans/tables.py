"""Tables that cut lineage: written to the shared folder of the cluster and read back."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_root(spark: SparkSession) -> str:
    """The folder that the cluster names in ``spark.checkpoint.dir``, or that was set with ``setCheckpointDir``.

    Where neither is set, a temporary folder if driver and executors are one
    process; on a cluster it would be another folder on each machine, so that
    is an error.
    """
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        current = context._jsc.sc().getCheckpointDir()
        named = current.get() if current.isDefined() else None
    if named:
        return named.rstrip("/")
    if not context.master.startswith("local") or context.master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share: intermediate tables are written there")
    if not _LOCAL:
        _LOCAL.append(tempfile.mkdtemp(prefix="veriloom-"))
        atexit.register(shutil.rmtree, _LOCAL[0], ignore_errors=True)
    return "file://" + _LOCAL[0]


_LOCAL: list[str] = []


class Tables:
    """Intermediate Parquet tables of one run, in one folder below :func:`shared_root`.

    Reading a table back keeps plans small and means that a lost executor costs
    no more than the table that was being written.
    """

    def __init__(self, spark: SparkSession, label: str):
        self.spark, self.path, self._n = spark, f"{shared_root(spark)}/{label}-{uuid.uuid4().hex}", 0

    def keep(self, df: DataFrame, name: str = "t") -> DataFrame:
        """Write ``df`` and return it read back, so that nothing before it is ever run again."""
        self._n += 1
        at = f"{self.path}/{self._n:03d}-{name}"
        df.write.mode("overwrite").parquet(at)
        out = self.spark.read.schema(df.schema).parquet(at)
        out._veriloom_path = at
        return out

    def drop(self, df: DataFrame) -> None:
        """Remove a table made by :meth:`keep` that no later plan reads."""
        at = getattr(df, "_veriloom_path", None)
        if at:
            self._remove(at)

    def close(self) -> None:
        """Remove all tables, once no plan that is still to run reads them."""
        self._remove(self.path)

    def _remove(self, at: str) -> None:
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(at)
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
