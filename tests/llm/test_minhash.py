import itertools
import random

import pytest

from tests.llm.moved import shuffled
from veriloom.llm import minhash
from veriloom.llm.components import connected_components
from veriloom.llm.workspace import Workspace

SPACE = " \t\n\r\x0b\x0c"


def shingles(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for c in SPACE[1:]:
        low = low.replace(c, " ")
    w = [x for x in low.split(" ") if x]
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def brute(rows, percent=85):
    sets = {i: shingles(t) for i, t in rows}
    comp = {i: i for i in sets}

    def root(x):
        while comp[x] != x:
            x = comp[x]
        return x

    for a, b in itertools.combinations(sorted(sets), 2):
        x, y = sets[a], sets[b]
        if x and y and 100 * len(x & y) >= percent * len(x | y):
            lo, hi = sorted((root(a), root(b)))
            comp[hi] = lo
    return {(i, len(sets[i]), root(i), root(i) == i) for i in sets}


def found(df):
    return {tuple(r) for r in minhash.near_duplicates(df).collect()}


def test_documents_against_brute_force(spark, sf_dir):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    assert found(docs) == brute([(r.doc_id, r.text) for r in docs.collect()])


def test_family_in_many_blocks_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK_ROWS", 8)
    rng = random.Random(3)
    base = [f"w{rng.randrange(5000)}" for _ in range(120)]
    rows = []
    for i in range(150):
        words = list(base)
        for _ in range(rng.choice([0, 1, 1, 2, 3, 5, 8])):
            words[rng.randrange(len(words))] = f"x{rng.randrange(10**6)}"
        rows.append((1000 - i, " ".join(words)))
    assert found(spark.createDataFrame(rows, "doc_id long, text string")) == brute(rows)


def test_edges(spark):
    rows = [(1, None), (2, ""), (3, " \n\t"), (4, "One two"), (5, "one  TWO"), (6, "É x"), (7, "é x"), (8, "a b c d e"), (9, "A b c d\x0be"), (10, "z z")]
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, rep string, component_id int")
    assert found(df) == brute(rows)
    assert minhash.near_duplicates(df.limit(0)).count() == 0


def test_links_that_no_pivot_sees(spark, monkeypatch):
    """Chains in which a text is linked with members of a bucket, but not with its smallest."""
    monkeypatch.setattr(minhash, "BLOCK_ROWS", 5)
    rng = random.Random(9)
    rows = []
    for chain in range(12):
        words = [f"w{rng.randrange(10**6)}" for _ in range(150)]
        for step in range(14):
            rows.append((100 * chain + step, " ".join(words)))
            at = (step * 31) % 140
            words[at : at + 6] = [f"x{rng.randrange(10**6)}" for _ in range(6)]
    want = brute(rows)
    assert found(spark.createDataFrame(rows, "doc_id long, text string")) == want and len({r[2] for r in want}) == 12


def test_long_texts_and_names_that_clash(spark):
    long = " ".join(f"w{i}" for i in range(60_000))
    df = spark.createDataFrame([(1, long, 7, 8), (2, long + " x", 7, 8), (3, "a b", 7, 8)], "doc_id long, text string, gone_id int, _gone int")
    out = minhash.drop_near_duplicates(df)
    assert out.columns == df.columns and sorted(r.doc_id for r in out.collect()) == [1, 3]


def test_null_id_and_repeated_rows(spark):
    df = spark.createDataFrame([(None, "a b c d e f"), (1, "a b c d e f"), (1, "a b c d e f"), (2, "a b c d e f")], "doc_id long, text string")
    rows = sorted(minhash.near_duplicates(df).collect(), key=str)
    assert len(rows) == 4
    assert {(r.doc_id, r.component_id, r.kept) for r in rows} == {(None, None, True), (1, 1, True), (2, 1, False)}
    assert minhash.drop_near_duplicates(df).count() == 3


def test_pruning_limits():
    limits = minhash.least_matches(252, 36, 0.85, 1e-6)
    assert [m for m, _ in limits] == list(range(36, 253, 36))
    assert all(0 < k / m < 0.85 for m, k in limits)


@pytest.mark.parametrize("shape", ["chain", "star"])
def test_components(spark, shape):
    n = 60
    edges = [(i, i + 1) for i in range(n)] if shape == "chain" else [(0, i) for i in range(1, n)] + [(100, 101), (101, 101)]
    df = spark.createDataFrame(edges, "a long, b long").repartition(7)
    got = {r.node: r.component for r in connected_components(df, Workspace(spark, "test")).collect()}
    assert got == ({i: 0 for i in range(1, n + 1)} if shape == "chain" else {i: 0 for i in range(1, n)} | {101: 100})


def test_texts_without_candidates_are_not_moved(spark):
    rng = random.Random(4)
    rows = [(i, " ".join("".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=400)) for _ in range(50))) for i in range(150)]
    rows += [(200, rows[3][1] + " x")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        got = []
        assert shuffled(spark, lambda: got.extend(map(tuple, minhash.drop_near_duplicates(df).collect()))) < 1_500_000
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert sorted(got) == rows[:150]


def test_small_graphs_take_few_tasks_and_stars_no_round(spark, monkeypatch):
    """Whatever the number of shuffle partitions: a round's tables are dealt by their rows."""
    held = {"spark.sql.shuffle.partitions": "64", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in held}
    made, save = [], Workspace.save

    def noted(self, df, name="t"):
        out = save(self, df, name)
        made.append((name, len(out.inputFiles())))
        return out

    monkeypatch.setattr(Workspace, "save", noted)
    try:
        for k, v in held.items():
            spark.conf.set(k, v)
        ws = Workspace(spark, "test")
        star = spark.range(1, 500).selectExpr("id AS u", "0L AS v")
        assert {tuple(r) for r in connected_components(star, ws).collect()} == {(i, 0) for i in range(1, 500)}
        assert [n for n, _ in made] == ["forest", "low"]
        chain = spark.range(1, 3000).selectExpr("id AS u", "id - 1 AS v").repartition(32)
        assert {tuple(r) for r in connected_components(chain, ws).collect()} == {(i, 0) for i in range(1, 3000)}
        assert max(files for name, files in made if name != "forest") <= spark.sparkContext.defaultParallelism
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
