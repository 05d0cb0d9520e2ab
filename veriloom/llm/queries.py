"""The queries of this subpackage: thin wrappers that apply an operator to its whole table, and SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from veriloom.llm import bpe, covertree, decontaminate, langid, licenses, linededup, minhash, pii, quality, warc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.derive(warc.responses_from_pages(_table(spark, sf_dir, "pages")))


def op2_string_kernel_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(_table(spark, sf_dir, "documents"))


def op3_bpe_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return bpe.encode_documents(docs, vocabulary_path(), ids=False, digests=True).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


def op4_factorisation_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    return quality.score(docs, quality.fit(docs, labels, metadata=("n_chars",)), metadata=("n_chars",))


def op5_licence_inheritance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(licenses.document_files(_table(spark, sf_dir, "documents")), keys=("doc_id",))


def op6_segment_edit_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.line_classes(_table(spark, sf_dir, "documents"))


def op7_candidate_boosting_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(_table(spark, sf_dir, "documents"))


def op8_dual_tree_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = covertree.integers(_table(spark, sf_dir, "embeddings"))
    return covertree.top_k(own, own.filter("vec_id % 100 = 0"))


def op9_simhash_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op10_minhash_bayes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_warc_derivatives": op1_warc_derivatives,
    "op2_string_kernel_language": op2_string_kernel_language,
    "op3_bpe_roundtrip": op3_bpe_roundtrip,
    "op4_factorisation_quality": op4_factorisation_quality,
    "op5_licence_inheritance": op5_licence_inheritance,
    "op6_segment_edit_join": op6_segment_edit_join,
    "op7_candidate_boosting_pii": op7_candidate_boosting_pii,
    "op8_dual_tree_topk": op8_dual_tree_topk,
    "op9_simhash_windows": op9_simhash_windows,
    "op10_minhash_bayes": op10_minhash_bayes,
}

ORACLES: dict[str, str] = {
    "op1_warc_derivatives": warc.oracle(),
    "op5_licence_inheritance": licenses.oracle(),
    "op8_dual_tree_topk": """
        WITH e AS (
          SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 1024) AS DOUBLE)) AS v
          FROM embeddings
          WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        s AS (
          SELECT q.vec_id AS query_id, d.vec_id, CAST(list_dot_product(q.v, d.v) AS BIGINT) AS score
          FROM e q JOIN e d ON q.vec_id % 100 = 0 AND q.vec_id <> d.vec_id),
        r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank, vec_id, score FROM s)
        SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 10
    """,
}
