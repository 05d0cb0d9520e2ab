import itertools

import numpy as np
from pyspark.sql import functions as F

from veriloom.llm import quality as q
from veriloom.llm.shingles import documents_words


def auc(rows):
    good, bad = [s for s, y in rows if y == 1], [s for s, y in rows if y == 0]
    return np.mean([(g > b) + 0.5 * (g == b) for g in good for b in bad])


def test_held_out_ranking(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    out = q.score(docs, q.fit(docs, labels, metadata=("n_chars",)), metadata=("n_chars",))
    rows = out.filter("held_out").join(labels, "doc_id").select("score", "quality").collect()
    assert len(rows) > 300 and auc(rows) > 0.95


def test_linear_time_score_equals_sum_over_pairs():
    rng = np.random.default_rng(0)
    m = q.Machine(0.3, rng.normal(size=q._size(())).astype(np.float32), rng.normal(size=(q._size(()), q.RANK)).astype(np.float32) * 0.1)
    texts = ["one two two three!", "", "| a | b |", None]
    rows = [q.features(t, w) for t, w in zip(texts, documents_words(texts), strict=True)]
    for (at, x), got in zip(rows, m.scores(rows), strict=True):
        raw = m.bias + float(m.linear[at] @ x)
        raw += sum(float(m.factors[at[i]] @ m.factors[at[j]]) * float(x[i] * x[j]) for i, j in itertools.combinations(range(len(at)), 2))
        assert abs(got - 1 / (1 + np.exp(-raw))) < 1e-4


def test_edges(spark):
    rows = [(i, ("good plain words here " if i % 2 else "BAD!! WORDS!! ") * (i % 5 + 1), i) for i in range(60)] + [(100, None, None), (101, "", 1), (None, "good words", 2), (102, "w " * 300_000, 3), (1, "good plain words here ", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score int")
    labels = spark.createDataFrame([(i, i % 2, None) for i in range(60)] + [(None, 1, "x"), (5, None, "x"), (6, 7, "x")], "doc_id long, quality int, text string")
    m = q.fit(docs, labels, metadata=("score",))
    out = q.score(docs, m, metadata=("score",)).collect()
    assert len(out) == len(rows) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in out)
    by = {r.doc_id: r for r in out}
    assert by[1].predicted == 1 and by[2].predicted == 0 and not by[None].held_out
    assert q.fit(docs, labels.limit(0)) is None and q.fit(docs.limit(0), labels) is None
    assert {r.score for r in q.score(docs, None).collect()} == {0.5}
    assert q.score(docs.limit(0), m, metadata=("score",)).count() == 0
    assert q.fit(docs, labels.withColumn("quality", F.lit(None).cast("int"))) is None
