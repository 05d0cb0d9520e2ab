"""Exact top-k search by largest inner product with two cover trees.

Vectors become integers, ``floor(scale * x)``. Queries and data are both kept
in cover trees: a node is one of its vectors with a covering radius (the
distance to its farthest descendant); its children lie within that radius and
apart from one another by more than ``BASE`` times it; a node of at most
``LEAF`` vectors, or of equal ones, has them all as its children. A pair of nodes is
dropped if no pair of vectors below them can reach the worst kth score of the
query node's queries. With centres Q and D, covering radii r_Q and r_D and
greatest norms n_Q and n_D below them,

    <q, d> <= <Q, D> + |Q| r_D + |D| r_Q + r_Q r_D
    <q, d> <= (n_Q^2 + n_D^2 - max(0, |Q - D| - r_Q - r_D)^2) / 2
    <q, d> <= n_Q n_D

Bounds of all children of a node are one expression, and vectors below those
that stay are compared in matrix products of ``TURN`` vectors, the most
promising first; the bounds are tested again before each.

The top of the trees is shared by all tasks: ``cells`` of data around centres
that are far apart, and ``groups`` of queries likewise, from bounded samples.
Queries first meet the cell of their nearest centre, which gives their kth
scores so far; then pairs of a group and a cell are dropped by the same bounds
before anything else is dealt out, and the rest meet in tasks, each of which
reads one block of queries and then its part of a cell, a tree for every
``BLOCK`` vectors.
"""

from __future__ import annotations

from itertools import groupby as _runs

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veriloom.llm.workspace import Workspace, tidy

#: Radius of a child as a part of its parent's; vectors of a node that isn't split, of a matrix product, of a tree of data; of a cell, and cells at most; bytes of a block of queries; rows and bytes that centres are taken from.
BASE, LEAF, TURN, BLOCK, CELL_ROWS, CELLS, QUERY_BYTES, SAMPLE_ROWS, SAMPLE_BYTES = 0.8, 32, 512, 4096, 4096, 256, 16_000_000, 2048, 16_000_000
_LOWEST = np.iinfo(np.int64).min


class Node:
    """``points`` are the rows below it, ``alone`` those that are children without children, ``kids`` the other children."""

    __slots__ = ("alone", "centre", "kids", "most", "norm", "points", "radius", "tops")

    def __init__(self, centre: np.ndarray, radius: float, points: np.ndarray, alone: np.ndarray, kids: list[Node], norms: np.ndarray):
        self.centre, self.radius, self.points, self.alone, self.kids = centre, radius, points, alone, kids
        self.norm, self.most = float(np.sqrt(centre @ centre)), float(norms[points].max())
        self.tops = (np.stack([c.centre for c in kids]), np.array([c.norm for c in kids]), np.array([c.radius for c in kids]), np.array([c.most for c in kids])) if kids else None


def build(x: np.ndarray) -> Node:
    """A cover tree over the rows of ``x``."""
    norms = np.sqrt(np.einsum("ij,ij->i", x, x))

    def far(at: np.ndarray, centre: int) -> np.ndarray:
        apart = x[at] - x[centre]
        return np.sqrt(np.einsum("ij,ij->i", apart, apart))

    def grow(at: np.ndarray, centre: int, away: np.ndarray) -> Node:
        radius = float(away.max())
        if radius == 0 or len(at) <= LEAF:
            return Node(x[centre], radius, at, at, [], norms)
        reach, alone, kids, own = radius * BASE, [], [], centre
        rest, d = at, away
        while len(rest):
            near = d <= reach
            mine = rest[near]
            if len(mine) == 1:
                alone.append(own)
            else:
                kids.append(grow(mine, own, d[near]))
            rest = rest[~near]
            if len(rest):
                own = int(rest[0])
                d = far(rest, own)
        return Node(x[centre], radius, at, np.array(alone, dtype=np.int64), kids, norms)

    every = np.arange(len(x))
    middle = x - x.mean(axis=0)
    root = int(np.argmin(np.einsum("ij,ij->i", middle, middle)))
    return grow(every, root, far(every, root))


def depth(node: Node) -> int:
    """Levels of a tree, with the level of the vectors that stand alone."""
    return 1 + max([depth(c) for c in node.kids], default=int(len(node.points) > 1))


def bounds(dots, q_norm, q_radius, q_most, d_norm, d_radius, d_most):
    """Greatest inner product below pairs of nodes, given those of their centres; any argument may be an array."""
    by_radius = dots + q_norm * d_radius + d_norm * q_radius + q_radius * d_radius
    apart = np.sqrt(np.maximum(q_norm * q_norm + d_norm * d_norm - 2 * dots, 0.0))
    by_gap = (q_most * q_most + d_most * d_most - np.maximum(apart - q_radius - d_radius, 0.0) ** 2) / 2
    most = np.minimum(np.minimum(by_radius, by_gap), q_most * d_most)
    return most + 1e-9 * (q_most * d_most + np.abs(most)) + 0.5  # more than rounding can take away


class Search:
    """Best k data vectors of each query so far; ``floor`` are scores that the kth of each query is known to reach."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, k: int, floor: np.ndarray | None = None):
        self.ids, self.exact, self.k = ids, vectors, k
        self.x = vectors.astype(np.float64)
        self.norms = np.sqrt(np.einsum("ij,ij->i", self.x, self.x))
        self.tree = build(self.x)
        self.floor = np.full(len(ids), _LOWEST, dtype=np.int64) if floor is None else floor
        self.score = np.full((len(ids), k), _LOWEST, dtype=np.int64)
        self.found = np.full((len(ids), k), np.iinfo(np.int64).max, dtype=np.int64)
        self.tested = self.pruned = self.scored = 0

    def worst(self, at: np.ndarray) -> np.ndarray:
        """The score that a candidate of each of these queries has to reach."""
        return np.maximum(self.score[at, -1], self.floor[at])

    def add(self, ids: np.ndarray, vectors: np.ndarray) -> None:
        """Compare all queries with one tree of data."""
        x = vectors.astype(np.float64)
        # float64 products are exact below 2**53; beyond it 64-bit integers are used
        small = float(np.abs(x).max(initial=0)) * float(np.abs(self.x).max(initial=0)) * x.shape[1] < 2**52
        self.data, self.d_ids, self.d_norms, self.small = (x if small else vectors), ids, np.sqrt(np.einsum("ij,ij->i", x, x)), small
        root = build(x)
        stack: list[tuple[Node | np.ndarray, Node]] = [(self.tree, root)]
        while stack:
            q, d = stack.pop()
            if isinstance(q, Node):
                self.tested += 1
                if self._beyond(bounds(float(q.centre @ d.centre), q.norm, q.radius, q.most, d.norm, d.radius, d.most), self.worst(q.points).min()):
                    self.pruned += 1
                elif q.radius > d.radius or (not d.kids and q.radius):
                    stack += [(c, d) for c in q.kids]
                    if len(q.alone):
                        stack.append((q.alone, d))
                else:
                    self._below(q.points, d, x, stack, q)
            else:  # queries that stand alone
                self.tested += len(q)
                kept = q[~self._beyond(bounds(self.x[q] @ d.centre, self.norms[q], 0.0, self.norms[q], d.norm, d.radius, d.most), self.worst(q))]
                self.pruned += len(q) - len(kept)
                if len(kept):
                    self._below(kept, d, x, stack, kept)

    @staticmethod
    def _beyond(bound, worst):
        return (worst != _LOWEST) & (bound < worst)

    def _reach(self, q: Node | np.ndarray, centres: np.ndarray, norm: np.ndarray, radius, most: np.ndarray) -> np.ndarray:
        """Greatest product of each child with a query, less the score that it has to reach; endless while a query lacks k results."""
        if isinstance(q, Node):
            worst = self.worst(q.points).min()
            return np.full(len(norm), np.inf) if worst == _LOWEST else bounds(centres @ q.centre, q.norm, q.radius, q.most, norm, radius, most) - worst
        own, worst = self.norms[q][:, None], self.worst(q)
        over = bounds(self.x[q] @ centres.T, own, 0.0, own, norm[None, :], radius, most[None, :]) - worst[:, None]
        over[worst == _LOWEST] = np.inf
        return over.max(axis=0)

    def _below(self, points: np.ndarray, d: Node, x: np.ndarray, stack: list, q: Node | np.ndarray) -> None:
        """Go down on the data's side."""
        if d.kids:
            over = self._reach(q, *d.tops)
            self.tested += len(over)
            self.pruned += int((over < 0).sum())
            order = [int(i) for i in np.argsort(-over, kind="stable") if over[i] >= 0]
            stack += [(q, d.kids[i]) for i in reversed(order) if d.kids[i].kids]
            ready = [d.kids[i].points for i in order if not d.kids[i].kids]
        else:
            ready = []
        ready = np.concatenate([*ready, d.alone])
        for at in range(0, len(ready), TURN):
            own = ready[at : at + TURN]
            if isinstance(q, Node) and q.radius:
                over = self._reach(q, x[own], self.d_norms[own], 0.0, self.d_norms[own])
                self.tested += len(own)
                self.pruned += int((over < 0).sum())
                own = own[over >= 0]
            if len(own):
                self._score(points, own, x)

    def _score(self, qs: np.ndarray, ds: np.ndarray, x: np.ndarray) -> None:
        self.scored += len(qs) * len(ds)
        s = np.rint(self.x[qs] @ x[ds].T).astype(np.int64) if self.small else self.exact[qs] @ self.data[ds].T
        ids = self.d_ids[ds]
        s = np.where(ids[None, :] == self.ids[qs][:, None], _LOWEST, s)
        least = self.worst(qs)
        if s.shape[1] > self.k:  # what is below the k best of these can't count
            least = np.maximum(least, np.partition(s, -self.k, axis=1)[:, -self.k])
        row, col = np.nonzero((s >= least[:, None]) & (s != _LOWEST))
        if not len(row):
            return
        hit = np.unique(row)
        old_row, old_col = np.nonzero(self.score[qs[hit]] != _LOWEST)
        rows = np.concatenate((row, hit[old_row]))
        scores = np.concatenate((s[row, col], self.score[qs[hit]][old_row, old_col]))
        names = np.concatenate((ids[col], self.found[qs[hit]][old_row, old_col]))
        order = np.lexsort((names, ~scores, rows))  # ~ reverses the order and can't overflow
        rows, scores, names = rows[order], scores[order], names[order]
        place = np.arange(len(rows)) - np.searchsorted(rows, rows)
        keep = place < self.k
        self.score[qs[rows[keep]], place[keep]], self.found[qs[rows[keep]], place[keep]] = scores[keep], names[keep]

    def rows(self) -> pa.RecordBatch:
        row, col = np.nonzero(self.score != _LOWEST)
        return pa.RecordBatch.from_arrays(
            [pa.array(row), pa.array(self.ids[row]), pa.array(self.found[row, col]), pa.array(self.score[row, col])], names=["n", "query_id", "vec_id", "score"]
        )


def _vectors(batch: pa.RecordBatch, column: int) -> list[np.ndarray]:
    lists = batch.column(column)
    values, offsets = lists.flatten().to_numpy(zero_copy_only=False), lists.offsets.to_numpy() - lists.offsets[0].as_py()
    return [values[a:b].copy() for a, b in zip(offsets[:-1], offsets[1:], strict=True)]


def _search(k: int):
    """Rows (task, dims, kind, vec_id, floor, v), sorted by task and dims, queries (kind 0) before data."""

    def rows(batches):
        for batch in batches:
            for vec, task, dims, kind, own, floor in zip(_vectors(batch, 5), *(batch.column(c).to_pylist() for c in range(5)), strict=True):
                yield (task, dims), kind, own, floor, vec

    def blocks(own, size):
        ids, vectors = [], []
        for _, _, vec, _, v in own:
            ids.append(vec)
            vectors.append(v)
            if len(ids) == size:
                yield np.array(ids, dtype=np.int64), np.stack(vectors).astype(np.int64)
                ids, vectors = [], []
        if ids:
            yield np.array(ids, dtype=np.int64), np.stack(vectors).astype(np.int64)

    def run(batches):
        for (_, dims), task in _runs(rows(batches), key=lambda r: r[0]):
            search = None
            for kind, own in _runs(task, key=lambda r: r[1]):
                if kind == 0:
                    ids, floors, vectors = zip(*[r[2:] for r in own], strict=True)  # one block of queries
                    search = Search(np.array(ids, dtype=np.int64), np.stack(vectors).astype(np.int64).reshape(len(ids), dims), k, np.array([_LOWEST if f is None else f for f in floors], dtype=np.int64))
                elif search is not None:
                    for ids, vectors in blocks(own, BLOCK):
                        search.add(ids, vectors)
            if search is not None:
                out = search.rows()
                names = pa.array([search.exact[n].tobytes() for n in out.column(0).to_pylist()], pa.binary())  # tells queries of one id apart
                yield pa.RecordBatch.from_arrays([names, *(out.column(i) for i in (1, 2, 3))], names=["q", "query_id", "vec_id", "score"])

    return run


def integers(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 1024) -> DataFrame:
    """(vec_id, v): each component x as floor(scale * x), x as double. Null vectors, empty ones and those with null or non-finite components are left out, as are rows without an id."""
    own = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))
    bad = F.exists("v", lambda x: x.isNull() | F.coalesce(F.isnan(x) | (F.abs(x) == float("inf")), F.lit(True)))
    own = own.filter(F.col("vec_id").isNotNull() & (F.size("v") > 0)).filter(~bad)
    return own.select("vec_id", F.transform("v", lambda x: F.floor(x * scale).cast("long")).alias("v"))


def spread(rows: np.ndarray, n: int) -> np.ndarray:
    """At most ``n`` different rows, each the farthest from those before it: the top of a cover tree."""
    x = rows.astype(np.float64)
    middle = x - x.mean(axis=0)
    chosen = [int(np.argmin(np.einsum("ij,ij->i", middle, middle)))]
    away = np.linalg.norm(x - x[chosen[0]], axis=1)
    while len(chosen) < n and away.max() > 0:
        chosen.append(int(np.argmax(away)))
        away = np.minimum(away, np.linalg.norm(x - x[chosen[-1]], axis=1))
    return rows[chosen]


def _centres(table: DataFrame, at_most: int) -> dict[int, np.ndarray]:
    """By vector length, up to ``at_most`` centres from a bounded sample. Lengths that the sample lacks have the origin."""
    dims = table.agg(F.max(F.size("v"))).first()[0] or 1
    rows = table.orderBy(F.xxhash64("vec_id"), "vec_id").select("v").limit(int(max(1, min(SAMPLE_ROWS, SAMPLE_BYTES // (8 * dims))))).collect()
    own: dict[int, list] = {}
    for r in rows:
        own.setdefault(len(r.v), []).append(r.v)
    return {n: spread(np.array(v, dtype=np.int64), at_most) for n, v in own.items()}


def _nearest(table: DataFrame, centres: dict[int, np.ndarray], *names: str) -> DataFrame:
    """``table`` (vec_id, v, ...) with the number of the nearest centre, the distance to it and the vector's norm as ``names``."""
    shared = table.sparkSession.sparkContext.broadcast(centres)  # at most CELLS vectors of each length

    def run(batches):
        for batch in batches:
            found = []
            for v in _vectors(batch, 1):
                x = v.astype(np.float64)
                at = shared.value.get(len(x), np.zeros((1, len(x)))).astype(np.float64) - x
                d = np.sqrt(np.einsum("ij,ij->i", at, at))
                near = int(np.argmin(d))
                found.append((near, float(d[near]), float(np.sqrt(x @ x))))
            near, away, norm = zip(*found, strict=True)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(near, pa.int64()), pa.array(away, pa.float64()), pa.array(norm, pa.float64())], names=[*batch.schema.names, *names])

    have = ", ".join(f"{n} {t.replace('bigint', 'long')}" for n, t in table.dtypes)
    return table.mapInArrow(tidy(run, 2000), f"{have}, {names[0]} long, {names[1]} double, {names[2]} double")


def _meet(queries: DataFrame, data: DataFrame, pairs: DataFrame, k: int) -> DataFrame:
    """Search the parts of cells that ``pairs`` (g, near, dims, parts, blocks) names; ``queries`` (g, dims, vec_id, floor, v, cell) leave out their own ``cell``."""
    part = F.pmod(F.xxhash64("vec_id", F.lit("part")), F.col("parts")).cast("long")
    block = F.pmod(F.xxhash64("vec_id", F.lit("block")), F.col("blocks")).cast("long")
    q = queries.join(pairs, ["g", "dims"]).filter(F.col("cell").isNull() | (F.col("cell") != F.col("near")))
    q = q.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))).withColumn("block", block)
    d = data.join(pairs, ["near", "dims"]).withColumn("part", part).withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    task = F.xxhash64("g", "near", "part", "block").alias("task")
    none = F.lit(None).cast("long").alias("floor")
    rows = q.select("g", "near", "part", "block", task, "dims", F.lit(0).alias("kind"), "vec_id", "floor", "v").unionAll(d.select("g", "near", "part", "block", task, "dims", F.lit(1).alias("kind"), "vec_id", none, "v"))
    dealt = rows.repartition("g", "near", "part", "block").sortWithinPartitions("task", "g", "near", "part", "block", "dims", "kind").select("task", "dims", "kind", "vec_id", "floor", "v")
    return dealt.mapInArrow(tidy(_search(k), 2000), "q binary, query_id long, vec_id long, score long")


def _ranked(best: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("query_id", "q").orderBy(F.desc("score"), "vec_id")  # k rows a query of each task
    return best.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def top_k(data: DataFrame, queries: DataFrame, k: int = 10, ws: Workspace | None = None) -> DataFrame:
    """The ``k`` largest integer inner products of each query with the data.

    ``data`` and ``queries`` are ``(vec_id, v)`` as :func:`integers` makes
    them. Returns ``query_id``, ``rank`` (from 1), ``vec_id``, ``score``; ties
    go to the smaller ``vec_id``; a row of the query's own ``vec_id`` is no
    candidate; a query with fewer candidates has fewer rows. Vectors of
    different lengths aren't compared. A query row repeated as it is counts
    once; repeated data rows are candidates each. Empty tables give an empty
    result; other columns are ignored, whatever their names; vectors may be of
    any length.

    Centres come from at most ``SAMPLE_ROWS`` rows and ``SAMPLE_BYTES`` bytes;
    every row belongs to a cell. The driver sees one row for each cell and each
    group of queries.
    """
    spark = data.sparkSession
    ws = ws or Workspace(spark, "topk")
    schema = "query_id long, rank int, vec_id long, score long"
    data, queries = ws.save(data.select("vec_id", "v"), "data"), ws.save(queries.select("vec_id", "v").distinct(), "queries")
    n, m = data.count(), queries.count()
    if not n or not m:
        return spark.createDataFrame([], schema)
    of_data = _centres(data, int(min(CELLS, n // CELL_ROWS + 1)))
    wide = queries.agg(F.max(F.size("v"))).first()[0]
    per_block = max(1, QUERY_BYTES // (8 * wide))
    of_queries = _centres(queries, int(min(CELLS, -(-m // per_block))))  # groups of queries that lie near one another
    dims = F.size("v").cast("long").alias("dims")
    placed = ws.save(_nearest(data, of_data, "near", "away", "norm").select("*", dims), "placed")
    asked = _nearest(_nearest(queries, of_data, "cell", "_", "__").select("vec_id", "v", "cell"), of_queries, "g", "away", "norm")
    asked = ws.save(asked.select("*", dims), "asked")

    cells = placed.groupBy("dims", "near").agg(F.count(F.lit(1)).alias("n"), F.max("away").alias("radius"), F.max("norm").alias("most")).collect()
    part_rows = max(4 * BLOCK, n // CELLS)
    parts = {(c.dims, c.near): -(-c.n // part_rows) for c in cells}
    pair_schema = "g long, near long, dims long, parts long, blocks long"
    homes = {(r.dims, r.cell): r.n for r in asked.groupBy("dims", "cell").agg(F.count(F.lit(1)).alias("n")).collect()}
    home = spark.createDataFrame([(near, near, d, parts[d, near], -(-homes[d, near] // per_block)) for d, near in sorted(parts) if (d, near) in homes], pair_schema)
    at_home = asked.select(F.col("cell").alias("g"), "dims", "vec_id", F.lit(None).cast("long").alias("floor"), "v", F.lit(None).cast("long").alias("cell"))
    first = ws.save(_meet(at_home, placed, home, k), "home")

    kth = _ranked(first, k).filter(F.col("rank") == k).select(F.col("query_id").alias("vec_id"), F.col("score").alias("floor"))
    ids = kth.groupBy("vec_id").agg(F.min("floor").alias("floor"), F.count(F.lit(1)).alias("_n"))
    same = asked.groupBy("vec_id").agg(F.count(F.lit(1)).alias("_m"))  # an id may stand for several query vectors: then the least of all their scores, if all have one
    floors = ids.join(same, "vec_id").filter("_n = _m").select("vec_id", "floor")
    asked = ws.save(asked.join(floors, "vec_id", "left"), "floors")
    groups = asked.groupBy("dims", "g").agg(F.count(F.lit(1)).alias("n"), F.max("away").alias("radius"), F.max("norm").alias("most"), F.min("floor").alias("worst"), F.count("floor").alias("known")).collect()
    pairs = []
    for q in groups:
        centre = of_queries.get(q.dims, np.zeros((1, q.dims)))[q.g].astype(np.float64)
        for c in cells:
            if c.dims != q.dims:
                continue
            d = of_data.get(c.dims, np.zeros((1, c.dims)))[c.near].astype(np.float64)
            most = bounds(float(centre @ d), float(np.linalg.norm(centre)), q.radius, q.most, float(np.linalg.norm(d)), c.radius, c.most)
            if q.known < q.n or most >= q.worst:
                pairs.append((q.g, c.near, q.dims, parts[c.dims, c.near], -(-q.n // per_block)))
    rest = _meet(asked.select("g", "dims", "vec_id", "floor", "v", "cell"), placed, spark.createDataFrame(pairs, pair_schema), k)
    best = ws.save(first.unionAll(rest), "best")
    return _ranked(best, k).select("query_id", "rank", "vec_id", "score")
