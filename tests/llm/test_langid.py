import random

import pytest
from pyspark.sql import functions as F

from veriloom.llm import langid


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = langid.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out and lang_pred <> 'und'")
    right, n = out.select(F.avg((F.col("lang") == F.col("lang_pred")).cast("double")), F.count(F.lit(1))).first()
    assert n > 200 and right > 0.97


def test_folded_weights_equal_kernel_expansion():
    rng = random.Random(0)
    texts = ["".join(rng.choice("abcde " if i % 2 else "xyzuv ") for _ in range(200)) for i in range(40)]
    labels = ["one" if i % 2 else "two" for i in range(40)]
    import numpy as np

    sets = []
    for t in texts:
        row = np.zeros(langid.BINS, dtype=np.uint8)
        langid.mark(t, row)
        sets.append(np.flatnonzero(row))
    names, scores = langid.solve(sets, labels).scores(texts)
    assert names == labels and min(scores) > 0.5


def test_long_text_equals_pieces(monkeypatch):
    import numpy as np

    text = "".join(random.Random(1).choice("abcdefé ß") for _ in range(5000))
    a, b = np.zeros(langid.BINS), np.zeros(langid.BINS)
    langid.mark(text, a)
    monkeypatch.setattr(langid, "_PIECE", 37)
    langid.mark(text, b)
    assert (a == b).all()


@pytest.mark.parametrize("stage", [False, True])
def test_edges(spark, stage):
    words = {"en": "the of and in to is", "fr": "le la des et du une"}
    rows = [(i, " ".join(random.Random(i).choices(words[x].split(), k=40)), x, 1) for i in range(60) for x in [("en", "fr")[i % 2]]]
    rows += [(900, None, "en", 1), (901, "", None, 1), (902, "123 !!", "fr", 1), (None, "the of and", "en", 1), (903, "the and of " * 50_000, None, 1), (0, rows[0][1], "en", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, score int")
    if stage:
        out = langid.reject_unidentified(df)
        assert out.columns == df.columns and out.count() == len(rows) - 3
        return
    out = {r.doc_id: r for r in langid.identify(df).collect()}
    assert [out[i].lang_pred for i in (900, 901, 902)] == ["und"] * 3
    assert out[None].lang_pred == "en" and out[903].lang_pred == "en" and not out[None].held_out
    assert all(0 <= r.score <= 1 for r in out.values())
    nothing = langid.identify(df.withColumn("lang", F.lit(None).cast("string"))).collect()
    assert {r.lang_pred for r in nothing} == {"und"}
    assert langid.identify(df.limit(0)).count() == 0


def test_more_languages_than_64(spark):
    rng = random.Random(2)
    rows = []
    for n in range(80):
        lexicon = ["".join(chr(0x4E00 + 40 * n + rng.randrange(40)) for _ in range(4)) for _ in range(50)]
        rows += [(1000 * n + i, " ".join(rng.choices(lexicon, k=30)), f"l{n:02}") for i in range(6 if n < 70 else 4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    learned = {r.lang for r in docs.filter(~langid.held_out(docs.doc_id)).collect()}
    assert len(learned) > 70 and set(langid.fit(docs).labels) == learned
    want = {i: lang for i, _, lang in rows if lang in learned}
    assert {r.doc_id: r.lang_pred for r in langid.identify(docs).collect() if r.doc_id in want} == want
    assert want.keys() <= {r.doc_id for r in langid.reject_unidentified(docs).collect()}


def test_a_small_share_of_the_sample_leaves_no_language_out(spark, monkeypatch):
    monkeypatch.setattr(langid, "SAMPLE_ROWS", 8)
    docs = spark.createDataFrame([(i, f"{'abcd'[i % 4] * 3} {i}", "abcd"[i % 4]) for i in range(2000)], "doc_id long, text string, lang string")
    assert langid.fit(docs).labels == list("abcd")


def test_the_stage_sends_only_texts_to_python_and_keeps_what_is_identified(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").withColumn("a.b", F.col("doc_id") + 1)
    docs = docs.withColumn("text", F.when(F.col("doc_id") % 10 == 3, "1 2").when(F.col("doc_id") % 10 == 4, "qxzj").otherwise(F.col("text")))
    out = langid.reject_unidentified(docs)
    assert "MapInArrow" not in out._jdf.queryExecution().executedPlan().toString()
    found = langid.identify(docs).filter("lang_pred <> 'und' and score >= 0.3")
    assert out.columns == docs.columns and 0 < out.count() < docs.count()
    assert sorted(r.doc_id for r in out.select("doc_id").collect()) == sorted(r.doc_id for r in found.collect())
