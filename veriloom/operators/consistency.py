"""Cited keys against defined keys, and the claims of a document."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veriloom.functions.latex import citation_list, document_body, paragraphs, split_sentences
from veriloom.functions.text import strip_comments


def citations(docs: DataFrame) -> DataFrame:
    """(doc_id, ordinal, command, keys, start, end) of all citations of the whole text, comments aside."""
    own = docs.select("doc_id", F.posexplode(citation_list("text")).alias("n", "c"))
    return own.select("doc_id", (F.col("n") + 1).alias("ordinal"), "c.command", "c.keys", "c.start", "c.end")


def cited_keys(found: DataFrame) -> DataFrame:
    """(doc_id, key, first) of the cited keys, ``first`` being the ordinal of the first citation; the star is no key."""
    keys = found.select("doc_id", "ordinal", F.explode("keys").alias("key")).filter("key <> '*'")
    return keys.groupBy("doc_id", "key").agg(F.min("ordinal").alias("first"))


def nocite_all(found: DataFrame) -> DataFrame:
    """(doc_id) of documents in which a star is cited silently."""
    return found.filter("command = 'nocite' and array_contains(keys, '*')").select("doc_id").distinct()


def cited_but_undefined(cited: DataFrame, defined: DataFrame) -> DataFrame:
    return cited.select("doc_id", "key").join(defined.select("doc_id", "key"), ["doc_id", "key"], "left_anti")


def defined_but_uncited(cited: DataFrame, defined: DataFrame, everything: DataFrame) -> DataFrame:
    """Empty for documents of ``everything`` (those that cite all)."""
    own = defined.select("doc_id", "key").distinct().join(everything, "doc_id", "left_anti")
    return own.join(cited.select("doc_id", "key"), ["doc_id", "key"], "left_anti")


def check(docs: DataFrame, defined: DataFrame, formats: DataFrame | None = None) -> DataFrame:
    """One row a document: sorted key lists, ``nocite_all``, ``bib_format`` and ``consistent``."""
    found = citations(docs)
    cited, everything = cited_keys(found), nocite_all(found)
    defined = defined.select("doc_id", "key").distinct()
    keys = lambda df, name: df.groupBy("doc_id").agg(F.array_sort(F.collect_set("key")).alias(name))
    out = docs.select("doc_id").distinct()
    for df, name in ((cited, "cited_keys"), (defined, "defined_keys"), (cited_but_undefined(cited, defined), "cited_but_undefined"), (defined_but_uncited(cited, defined, everything), "defined_but_uncited")):
        out = out.join(keys(df, name), "doc_id", "left").withColumn(name, F.coalesce(name, F.array().cast("array<string>")))
    out = out.join(everything.withColumn("nocite_all", F.lit(True)), "doc_id", "left").withColumn("nocite_all", F.coalesce("nocite_all", F.lit(False)))
    if formats is not None:
        out = out.join(formats.select("doc_id", "bib_format"), "doc_id", "left")
    else:
        out = out.withColumn("bib_format", F.lit("external"))
    return out.withColumn("consistent", (F.size("cited_but_undefined") == 0) & (F.size("defined_but_uncited") == 0))


def claims(docs: DataFrame) -> DataFrame:
    """(doc_id, claim_index, sentence, cite_key, command, context_before): one row for each sentence and key it cites.

    The sentence before counts as context within its paragraph only. All order
    comes from positions inside a document, so windows are as small as documents.
    """
    body = document_body(strip_comments(F.col("text")))
    para = docs.select("doc_id", F.posexplode(paragraphs(body)).alias("par", "p"))
    sent = para.select("doc_id", "par", F.posexplode(split_sentences("p")).alias("sent", "sentence"))
    before = F.lag("sentence", 1, "").over(Window.partitionBy("doc_id", "par").orderBy("sent"))
    sent = sent.withColumn("context_before", before)
    cite = sent.select("doc_id", "par", "sent", "sentence", "context_before", F.posexplode(citation_list("sentence")).alias("cit", "c")).filter("c.command <> 'nocite'")
    keys = cite.select("*", F.posexplode("c.keys").alias("k", "cite_key")).filter("cite_key <> '*'")
    index = F.row_number().over(Window.partitionBy("doc_id").orderBy("par", "sent", "cit", "k"))
    return keys.select("doc_id", index.alias("claim_index"), "sentence", "cite_key", F.col("c.command").alias("command"), "context_before")


def first_entries(entries: DataFrame) -> DataFrame:
    """The first entry of each key of a document: what claims refer to. Ties don't occur, as ordinals differ."""
    rest = [c for c in entries.columns if c not in ("doc_id", "key")]
    return entries.groupBy("doc_id", "key").agg(F.min_by(F.struct(*rest), "ordinal").alias("_first")).select("doc_id", "key", "_first.*")


def duplicate_keys(entries: DataFrame) -> DataFrame:
    """(doc_id, note): keys that are defined more than once."""
    twice = entries.groupBy("doc_id", "key").count().filter("count > 1")
    return twice.select("doc_id", F.concat(F.lit("duplicate key, the claim check uses its first entry: "), "key").alias("note"))
