"""The whole verification of many manuscripts at once, from files and recorded answers to reports."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veriloom.operators import consistency, evidence, judging, references, report
from veriloom.plans.tables import Tables
from veriloom.sources import bibtex, records, tex


@dataclass
class Verification:
    """Tables of one run; each is a lazy DataFrame."""

    docs: DataFrame
    notes: DataFrame
    consistency: DataFrame
    references: DataFrame
    claims: DataFrame
    reports: DataFrame
    exit_codes: DataFrame
    new_store_rows: DataFrame


def run(files: DataFrame, responses: DataFrame, replies: DataFrame, store: DataFrame | None = None, *, generated: str = "", fetched_at: str = "1970-01-01T00:00:00+00:00") -> Verification:
    """Check the citations, entries and claims of every document of ``files``.

    ``responses`` are what services answered, ``replies`` what models answered.
    Tables that several others are built on are written to the shared folder.
    """
    keep = Tables(files.sparkSession, "verify").keep
    docs = keep(tex.documents(files))
    found, notes = tex.bibliographies(docs, files)
    entries = keep(bibtex.entries(found))
    formats = tex.bibliography_format(docs)
    embedded = formats.select("doc_id", F.explode("embedded_keys").alias("key"))
    consistent = keep(consistency.check(docs, entries.select("doc_id", "key").unionAll(embedded), formats))
    settled = keep(records.settle(responses))
    results = keep(records.parse(settled))
    wanted = references.prepared(entries).select(F.col("title_key").alias("request_key"), "title").filter("request_key is not null")
    hits = keep(records.title_results(settled, wanted))
    verified = keep(references.verify(entries, results, hits, store))
    claims = keep(consistency.claims(docs))
    works = keep(evidence.works(claims, entries))
    proof = keep(evidence.find(works, results, hits, store))
    judged = keep(judging.judge(judging.with_evidence(claims, proof), replies))
    notes = notes.unionByName(consistency.duplicate_keys(entries)).distinct()
    names = found.groupBy("doc_id").agg(F.array_sort(F.collect_set("bib_file")).alias("bibliography"))
    told = notes.groupBy("doc_id").agg(F.array_sort(F.collect_set("note")).alias("notes"))
    empty = F.array().cast("array<string>")
    head = docs.select("doc_id", F.regexp_extract("path", "[^/]*$", 0).alias("input"), F.lit(generated).alias("generated")).join(names, "doc_id", "left").join(told, "doc_id", "left")
    head = keep(head.withColumns({"bibliography": F.coalesce("bibliography", empty), "notes": F.coalesce("notes", empty)}))
    lines = report.markdown_lines(head, consistent, references.status_counts(verified), references.report_rows(verified), report.claim_rows(judged))
    codes = report.exit_codes(docs, judging.failure_message(judged, replies), references.no_source_answered(verified), consistent, verified, judged)
    return Verification(docs, notes, consistent, verified, judged, report.markdown(lines), codes, evidence.new_store_rows(proof, works, results, fetched_at))
