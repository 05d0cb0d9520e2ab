"""Connected components of a graph that never leaves the executors."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veriloom.llm.workspace import Workspace, tidy


def _forest(batches):
    """Spanning stars of the edges of one partition: never more rows than nodes, whatever the degree."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        top = x
        while (p := parent.get(top, top)) != top:
            top = p
        while x != top:
            parent[x], x = top, parent.get(x, x)
        return top

    def flush():
        rows = [(x, root(x)) for x in list(parent)]
        rows = [r for r in rows if r[0] != r[1]]
        parent.clear()
        return pa.RecordBatch.from_arrays(
            [pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64())], names=["u", "v"]
        )

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            ra, rb = root(a), root(b)
            if ra != rb:
                lo, hi = (ra, rb) if ra < rb else (rb, ra)
                parent[hi] = lo
                parent.setdefault(lo, lo)
        if len(parent) > 2_000_000:  # bounds the worker's memory; the driver loop joins what is left
            yield flush()
    if parent:
        yield flush()


#: Rows that one task of a round takes at least, as far as every core has a task: small graphs aren't dealt in hundreds of nearly empty ones.
ROWS_A_TASK = 100_000


def connected_components(edges: DataFrame, ws: Workspace) -> DataFrame:
    """Components of the undirected ``edges`` (first two columns, longs, no nulls).

    Returns ``(node, component)``, one row per node that has an edge to another
    one; ``component`` is the smallest node of the component. Each partition
    first reduces its edges to a spanning forest; then edges are rewired towards
    smaller neighbours (alternating large and small stars) until all are
    stars, which takes a logarithmic number of rounds. Every round is written
    to the shared workspace, so a lost executor costs one round at most.
    """
    a, b = edges.columns[:2]
    e = edges.select(F.col(a).cast("long").alias("u"), F.col(b).cast("long").alias("v")).filter("u <> v")
    e = ws.save(e.mapInArrow(tidy(_forest), "u long, v long").distinct(), "forest")
    tasks = max(ws.spark.sparkContext.defaultParallelism, -(-e.count() // ROWS_A_TASK))  # no round has more edges than the first
    while True:
        both = e.unionAll(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count_if(F.col("v") < F.col("u")).alias("down"), F.count_if(F.col("v") > F.col("u")).alias("up"))
        low = ws.save(low.coalesce(tasks), "low")  # a table, so that the join can split a hub's rows
        if low.filter("down > 1 OR down > 0 AND up > 0").isEmpty():  # every node is a centre or has one edge, to a centre
            ws.drop(low)
            return e.select(F.col("u").alias("node"), F.col("v").alias("component"))
        large = both.join(low.select("u", "m"), "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = ws.save(large.filter("u <> v").distinct().coalesce(tasks), "large")
        ws.drop(low)
        low = ws.save(large.groupBy("u").agg(F.min("v").alias("m")).coalesce(tasks), "low")
        small = large.join(low, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = ws.save(small.unionAll(low.select("u", F.col("m").alias("v"))).distinct().coalesce(tasks), "small")
        for old in (low, large, e):
            ws.drop(old)
        e = small
