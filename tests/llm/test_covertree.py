import math
import random

import numpy as np
import pyarrow.parquet as pq
import pytest

from veriloom.llm import covertree as c


def brute(rows, wanted, k):
    own = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    out = set()
    for i, q in own:
        if wanted(i):
            near = sorted((-sum(a * b for a, b in zip(q, v, strict=True)), j) for j, v in own if j != i and len(v) == len(q))[:k]
            out |= {(i, r + 1, j, -s) for r, (s, j) in enumerate(near)}
    return out


def found(spark, rows, k=3):
    df = spark.createDataFrame([(i, v, 7, 1) for i, v in rows], "vec_id long, embedding array<double>, score int, rank int")
    own = c.integers(df)
    return {tuple(r) for r in c.top_k(own, own.filter("vec_id % 5 = 0"), k).collect()}


def test_cover_tree_invariants():
    x = np.random.default_rng(0).normal(size=(500, 4))

    def walk(n):
        d = np.linalg.norm(x[n.points] - n.centre, axis=1)
        assert d.max() <= n.radius + 1e-9
        assert sorted(np.concatenate([n.alone, *(m.points for m in n.kids)])) == sorted(n.points)
        assert n.most == pytest.approx(np.linalg.norm(x[n.points], axis=1).max())
        if len(n.points) > c.LEAF and n.radius:
            centres = [m.centre for m in n.kids] + list(x[n.alone])
            assert all(np.linalg.norm(a - b) > n.radius * c.BASE for i, a in enumerate(centres) for b in centres[:i])
            assert all(m.radius <= n.radius * c.BASE for m in n.kids)
        for m in n.kids:
            walk(m)

    walk(c.build(x))


@pytest.mark.parametrize("dims", [1, 3, 16])
def test_against_brute_force(spark, monkeypatch, dims):
    monkeypatch.setattr(c, "BLOCK", 50)
    monkeypatch.setattr(c, "QUERY_BYTES", 20 * 8 * dims)
    monkeypatch.setattr(c, "CELL_ROWS", 40)
    monkeypatch.setattr(c, "TURN", 16)
    monkeypatch.setattr(c, "LEAF", 4)
    rng = random.Random(dims)
    centres = [[rng.gauss(0, 1) for _ in range(dims)] for _ in range(5)]
    rows = [(i, [x + rng.gauss(0, 0.1) for x in rng.choice(centres)]) for i in range(300)]
    assert found(spark, rows) == brute(rows, lambda i: i % 5 == 0, 3)


def test_real_vectors_go_through_both_trees():
    """Trees of several levels over the whole table; vectors without clusters let few pairs of nodes go, copies and clusters many."""
    rows = pq.read_table("/root/testdata/sf0.1/embeddings.parquet")
    v, ids = np.floor(1024 * np.stack(rows["embedding"].to_numpy()).astype(float)).astype(np.int64), rows["vec_id"].to_numpy()
    rng = np.random.default_rng(3)
    lumps = v[rng.integers(0, 60, 3000)] + rng.integers(-40, 41, (3000, v.shape[1]))
    for name, data in (("table", v), ("lumps", lumps)):
        own = np.arange(len(data)) if name == "lumps" else ids
        of = own % 100 == 0
        s = c.Search(own[of], data[of], 10)
        s.add(own, data)
        print(f"{name}: {c.depth(c.build(data.astype(float)))} levels of data, {c.depth(s.tree)} of queries; node pairs tested {s.tested}, dropped {s.pruned}; vector pairs compared {s.scored} of {of.sum() * len(own)}")
        assert c.depth(c.build(data.astype(float))) > 2 and c.depth(s.tree) > 1 and s.tested > 1
        for i, row in enumerate(data[of] @ data.T):
            best = sorted((-int(x), int(j)) for x, j in zip(row, own, strict=True) if j != s.ids[i])[:10]
            assert best == [(-int(a), int(b)) for a, b in zip(s.score[i], s.found[i], strict=True)]
        assert name == "table" or s.scored < 0.6 * of.sum() * len(own) and s.pruned > 100


def test_bounds_hold_for_all_pairs_of_nodes():
    rng = np.random.default_rng(1)
    x = np.floor(1024 * np.concatenate([rng.normal(size=(200, 5)), rng.normal(size=(1, 5)) * 4 + 0.05 * rng.normal(size=(200, 5))]))

    def every(n):
        yield n
        for m in n.kids:
            yield from every(m)

    a, b = list(every(c.build(x[::2]))), list(every(c.build(x[1::2])))
    for q in a:
        for d in b:
            assert (x[::2][q.points] @ x[1::2][d.points].T).max() <= c.bounds(float(q.centre @ d.centre), q.norm, q.radius, q.most, d.norm, d.radius, d.most)


def test_edges(spark):
    rows = [(0, [1.0, 2.0]), (1, [1.0, 2.0]), (2, [1.0, 2.0]), (5, [1.0, 2.0]), (3, None), (4, [1.0, None]), (10, [float("nan"), 1.0]), (15, [float("inf"), 1.0]), (20, []), (None, [1.0, 1.0]), (25, [3.0]), (6, [-0.0001, 1e-9])]
    assert found(spark, rows) == brute(rows, lambda i: i % 5 == 0, 3)
    big = [(0, [2.0**25 + 1, 1.0]), (1, [2.0**10, 5.0]), (2, [1.0, 1.0])]
    assert found(spark, big) == brute(big, lambda i: i % 5 == 0, 3)
    assert found(spark, rows[4:9]) == set()
    assert found(spark, [(0, [1.0]), (0, [1.0])]) == set()
