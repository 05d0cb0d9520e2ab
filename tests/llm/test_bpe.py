import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from veriloom.llm import bpe

PATH = public_tokenizers.path("word_bpe_49k.json")
EDGE = ["Hello  World's é à 12345 <|endoftext|> foo…　x", "", "ab́ İstanbul <|startoftext|>don't", "a\x1cb\x85c", "<|endoftext|>", "日本語 🎉🎉!!! ''s don''t", "x" * 50_000, "ab" * 3000, "ΑΣ Σ ſt ß"]


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(PATH)
    t.no_truncation()
    t.no_padding()
    return t


def _same(ours, library, text):
    e = library.encode(text, add_special_tokens=False)
    ids, decoded = ours.encode_text(text)
    assert ids == " ".join(map(str, e.ids))
    assert decoded == library.decode(e.ids, skip_special_tokens=False)


@pytest.mark.parametrize("text", EDGE)
def test_edges_equal_library(library, text):
    _same(bpe.loaded(PATH), library, text)


def test_random_texts_equal_library(library):
    rng = random.Random(5)
    letters = "abcdefghilmnorstu'.,!éñß Σ\n0İ́🎉"
    for _ in range(2000):
        _same(bpe.loaded(PATH), library, "".join(rng.choice(letters) for _ in range(120)))


def test_cache_generations_do_not_change_results(monkeypatch, library):
    ours = bpe.WordBPE(PATH)
    monkeypatch.setattr(bpe, "WORDS_AT_MOST", 3)
    for _ in range(3):
        for text in EDGE[:5]:
            _same(ours, library, text)


def test_documents(spark, sf_dir, library):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = bpe.encode_documents(docs, PATH, text=True).collect()
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert len(rows) == len(texts)
    for r in rows:
        e = library.encode(texts[r.doc_id], add_special_tokens=False)
        assert r.token_ids == e.ids and r.n_tokens == len(e.ids)
        assert r.decoded == library.decode(e.ids, skip_special_tokens=False)


def test_nulls_clashing_columns_and_empty_table(spark):
    df = spark.createDataFrame([(None, "Ab", 1, "x"), (1, None, 2, "y"), (1, "", 3, "z"), (1, "Ab", 4, None)], "doc_id long, text string, n_tokens int, token_ids string")
    rows = bpe.decode_ids(bpe.encode_documents(df, PATH, digests=True), PATH).collect()
    assert sorted(r.n_tokens for r in rows) == [0, 0, 1, 1]
    assert {r.decoded for r in rows} == {"", "ab</w>"}
    assert bpe.encode_documents(df.limit(0), PATH).count() == 0


def test_a_worker_that_is_used_again_holds_no_pairs_or_words(spark, sf_dir):
    bpe.encode_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), PATH).collect()

    def held(batches):
        import pyarrow as pa

        for _ in batches:
            used = bpe.loaded.cache_info().currsize > 0
            own = bpe.loaded(PATH) if used else None
            yield pa.RecordBatch.from_pydict({"used": [used], "n": [len(own._valid) + len(own._chunks) + len(own._chunks.old) if used else 0]})

    rows = spark.range(0, 64, 1, 8).mapInArrow(held, "used boolean, n long").collect()
    assert any(r.used for r in rows) and {r.n for r in rows} == {0}
