"""Metadata verification of bibliography entries against service records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veriloom.functions.identifiers import entry_arxiv_id, entry_doi, entry_year, nonempty, normalize_doi
from veriloom.functions.similarity import comparable_fields, compare_fields
from veriloom.sources.records import ABSENT, ERROR, FOUND, SKIPPED, title_key
from veriloom.sources.store import FORMAT, decode_metadata

STATUSES = ("MATCH", "MISMATCH_MINOR", "MISMATCH_MAJOR", "NOT_FOUND_IN_ENABLED_SOURCES", "SOURCE_ERROR", "NOT_CHECKED")
SEPARATOR = " · "
ENTRY = ["doc_id", "bib_file", "ordinal", "key", "entry_type"]
_CHECKS = "array<struct<field_name:string,bib_value:string,source_value:string,match:boolean,source:string,severity:string>>"


def prepared(entries: DataFrame) -> DataFrame:
    """Entries with normalised identifiers, title, year, the fields that are compared, and the title search key."""
    fields = F.col("fields")
    out = entries.withColumns({"doi": entry_doi(fields), "arxiv_id": entry_arxiv_id(fields), "title": nonempty(F.trim(fields["title"])), "year": entry_year(fields), "compared": comparable_fields(fields), "shown_doi": nonempty(F.trim(fields["doi"]))})
    return out.withColumn("title_key", title_key(F.col("title"), F.col("year")))


def request_keys(sources: tuple[str, ...]) -> Column:
    """Array of (n, source, request_key, needs) for an entry's identifiers; null keys where a source doesn't apply."""
    doi = F.when(F.col("doi").isNotNull(), F.concat(F.lit("doi:"), "doi"))
    arxiv = F.when(F.col("arxiv_id").isNotNull(), F.concat(F.lit("arxiv:"), "arxiv_id"))
    either = F.coalesce(doi, arxiv)
    own = F.coalesce(arxiv, F.when(F.col("doi").startswith("10.48550/arxiv."), F.concat(F.lit("arxiv:"), F.substring("doi", 16, 10_000))))
    key = {"arxiv": (own, "needs an arXiv identifier or an arXiv DOI"), "openalex": (doi, "needs a DOI or a title"), "datacite": (either, "needs a DOI or an arXiv identifier"), "s2": (either, "needs a DOI or an arXiv identifier")}
    rows = [F.struct(F.lit(i).alias("n"), F.lit(s).alias("source"), key.get(s, (doi,))[0].alias("request_key"), F.lit(key.get(s, (doi, "needs a DOI"))[1]).alias("needs")) for i, s in enumerate(sources)]
    return F.array(*rows)


def looked_up(entries: DataFrame, results: DataFrame, sources: tuple[str, ...]) -> DataFrame:
    """One row for each entry and source: the result of its request; SKIPPED where the source doesn't apply."""
    asked = entries.drop("fields").withColumn("r", F.explode(request_keys(sources))).select("*", "r.n", "r.source", "r.request_key", "r.needs").drop("r")
    got = results.filter("request_key not like 'title:%'").drop("seq")
    out = asked.join(got, ["source", "request_key"], "left")
    missing = F.col("status").isNull()
    out = out.withColumn("reason", F.when(F.col("request_key").isNull(), F.col("needs")).when(missing, "no recorded response").otherwise(F.col("reason")))
    out = out.withColumn("status", F.when(F.col("request_key").isNull(), SKIPPED).when(missing, ERROR).otherwise(F.col("status")))
    return out.withColumn("matched_by", F.when(F.col("status") == FOUND, F.when(F.col("request_key").startswith("doi:") | (F.col("arxiv_id").isNull() & F.col("doi").isNotNull()), "doi").otherwise("arxiv_id")))


def _lookup() -> Column:
    return F.struct("n", "source", "status", "reason", "matched_by", "resolved_doi", "public_url", F.coalesce("checks", F.array().cast(_CHECKS)).alias("checks"))


def with_verdict(df: DataFrame) -> DataFrame:
    """Adds status and reason of each entry from all its ``checks`` and ``lookups``."""
    told = lambda xs: F.array_join(F.transform(xs, lambda x: F.concat_ws(": ", x["source"], F.coalesce(x["reason"], F.lit("None")))), SEPARATOR)
    df = df.withColumns(
        {
            "_found": F.exists("lookups", lambda x: x["status"] == FOUND),
            "_applicable": F.filter("lookups", lambda x: x["status"] != SKIPPED),
            "_errors": F.filter("lookups", lambda x: x["status"] == ERROR),
            "_wrong": F.filter("checks", lambda c: ~c["match"]),
            "_n": F.size("checks"),
        }
    )
    found, failed = F.col("_found"), F.size("_errors") > 0
    major = F.exists("_wrong", lambda c: c["severity"] == "major")
    status = (
        F.when(found & (F.col("_n") == 0), "NOT_CHECKED").when(found & (F.size("_wrong") == 0), "MATCH").when(found & major, "MISMATCH_MAJOR").when(found, "MISMATCH_MINOR")
        .when(F.size("_applicable") == 0, "NOT_CHECKED").when(failed, "SOURCE_ERROR").otherwise("NOT_FOUND_IN_ENABLED_SOURCES")
    )
    reason = (
        F.when(found & (F.col("_n") == 0), "no comparable fields").when(found, F.lit(None).cast("string"))
        .when(F.size("_applicable") == 0, "no applicable source").when(failed, told(F.col("_errors"))).otherwise(told(F.col("_applicable")))
    )
    return df.withColumns({"status": status, "reason": reason}).drop("_found", "_applicable", "_errors", "_wrong", "_n")


def _with_checks(rows: DataFrame) -> DataFrame:
    """Found rows compared; others pass by the Python workers."""
    found = rows.filter(F.col("status") == FOUND)
    found = found.withColumn("checks", F.when(F.col("fields").isNotNull(), compare_fields("compared", "fields", "source")).otherwise(F.array().cast(_CHECKS)))
    return found.unionByName(rows.filter(F.col("status") != FOUND).withColumn("checks", F.array().cast(_CHECKS)))


def _same_doi(title_hit: DataFrame) -> DataFrame:
    """A hit of a title search that states a DOI is also compared by it."""
    plain = lambda c: F.translate(F.lower(c), "{}\\'\"-–—", "")
    match = F.col("doi") == F.col("resolved_doi")
    check = F.struct(F.lit("doi").alias("field_name"), F.col("doi").alias("bib_value"), F.col("resolved_doi").alias("source_value"), match.alias("match"), F.col("source").alias("source"), F.when(~match, F.when(plain(F.col("doi")) != plain(F.col("resolved_doi")), "major").otherwise("minor")).alias("severity"))
    both = F.col("doi").isNotNull() & F.col("resolved_doi").isNotNull() & (F.col("status") == FOUND) & F.col("fields").isNotNull()
    return title_hit.withColumn("checks", F.when(both, F.concat("checks", F.array(check))).otherwise(F.col("checks")))


def stored_matches(entries: DataFrame, store: DataFrame, formats: tuple[str, ...] = (FORMAT,)) -> DataFrame:
    """Entries that stored metadata of their DOI confirm in every field: entry columns, checks, metadata_date, stored_source."""
    kept = store.select(normalize_doi(F.col("doi")).alias("doi"), decode_metadata(F.col("raw_json"), F.col("doi"), formats).alias("m")).filter("m is not null").dropDuplicates(["doi"])
    both = entries.join(kept, "doi").withColumn("checks", compare_fields("compared", "m.fields", "m.source"))
    good = (F.size("checks") > 0) & F.forall("checks", lambda c: c["match"])
    return both.filter(good).select(*ENTRY, "shown_doi", "checks", F.col("m.fetched_at").alias("metadata_date"), F.col("m.source").alias("stored_source"))


def verify(entries: DataFrame, results: DataFrame, title_hits: DataFrame | None = None, store: DataFrame | None = None, sources: tuple[str, ...] = ("crossref", "openalex", "datacite"), formats: tuple[str, ...] = (FORMAT,)) -> DataFrame:
    """Verdict of each entry: ENTRY columns, doi, status, reason, checks, lookups, origin, metadata_date, stored_source.

    Stored metadata that agree in every field settle an entry. Else sources
    count in order up to the first that gives a field to compare. A title
    search counts if nothing was found, and the entry has no DOI or all who
    were asked for it answered that they lack it.
    """
    own = prepared(entries)
    done = None
    if store is not None:
        done = stored_matches(own, store, formats)
        own = own.join(done.select("doc_id", "ordinal"), ["doc_id", "ordinal"], "left_anti")
    rows = _with_checks(looked_up(own, results, sources))
    per = rows.groupBy("doc_id", "ordinal").agg(F.array_sort(F.collect_list(_lookup())).alias("all"))  # one row a source
    stop = F.array_position(F.transform("all", lambda x: F.size(x["checks"]) > 0), True)
    per = per.withColumn("lookups", F.when(stop > 0, F.slice("all", 1, stop.cast("int"))).otherwise(F.col("all"))).drop("all")
    own = own.join(per, ["doc_id", "ordinal"])

    answered = F.filter("lookups", lambda x: x["status"] != SKIPPED)
    no_hit = ~F.exists("lookups", lambda x: x["status"] == FOUND)
    open_ = no_hit & F.col("title").isNotNull() & (F.col("doi").isNull() | ((F.size(answered) > 0) & F.forall(answered, lambda x: x["status"] == ABSENT)))
    if title_hits is not None:
        hits = title_hits.drop("seq")
        asked = own.filter(open_ & F.col("title_key").isNotNull()).select("doc_id", "ordinal", "doi", "compared", F.col("title_key").alias("request_key")).join(hits, "request_key")
        asked = asked.withColumns({"n": F.lit(len(sources)), "matched_by": F.when(F.col("status") == FOUND, "title")})
        more = _same_doi(_with_checks(asked)).select("doc_id", "ordinal", F.array(_lookup()).alias("more"))
        own = own.join(more, ["doc_id", "ordinal"], "left").withColumn("lookups", F.concat("lookups", F.coalesce("more", F.array().cast(own.schema["lookups"].dataType)))).drop("more")
    checks = F.flatten(F.transform("lookups", lambda x: x["checks"]))
    out = with_verdict(own.withColumn("checks", checks))
    live = out.select(*ENTRY, F.col("shown_doi").alias("doi"), "status", "reason", "checks", F.transform("lookups", lambda x: x.dropFields("n", "checks")).alias("lookups"), F.when(F.size("lookups") > 0, "API").alias("origin"), F.lit(None).cast("string").alias("metadata_date"), F.lit(None).cast("string").alias("stored_source"))
    if done is None:
        return live
    none = F.array().cast(live.schema["lookups"].dataType)
    kept = done.select(*ENTRY, F.col("shown_doi").alias("doi"), F.lit("MATCH").alias("status"), F.lit(None).cast("string").alias("reason"), "checks", none.alias("lookups"), F.lit("DB").alias("origin"), "metadata_date", "stored_source")
    return live.unionByName(kept)


def report_rows(verified: DataFrame) -> DataFrame:
    """Verdicts with the flat columns of the report: compared_with, resolved_doi, public_url, differences."""
    compared = F.array_distinct(F.transform("checks", lambda c: c["source"]))
    used = F.filter("lookups", lambda x: (x["status"] == FOUND) & F.array_contains(compared, x["source"]))
    label = F.transform(used, lambda x: F.when(x["matched_by"].isNotNull(), F.concat(x["source"], F.lit(" ("), x["matched_by"], F.lit(")"))).otherwise(x["source"]))
    stored = F.when((F.col("origin") == "DB") & F.col("stored_source").isNotNull(), F.concat("stored_source", F.lit(" (doi, stored)")))
    wrong = F.filter("checks", lambda c: ~c["match"])
    told = F.transform(wrong, lambda c: F.concat(c["field_name"], F.lit(" ["), c["source"], F.lit(", "), c["severity"], F.lit("]: bib '"), c["bib_value"], F.lit("' vs source '"), c["source_value"], F.lit("'")))
    first = lambda name: F.get(F.filter(F.transform(used, lambda x: x[name]), lambda v: F.coalesce(v, F.lit("")) != ""), F.lit(0))
    return verified.withColumns({"compared_with": F.coalesce(stored, F.array_join(label, ", ")), "resolved_doi": first("resolved_doi"), "public_url": first("public_url"), "differences": F.array_join(told, SEPARATOR)})


def status_counts(verified: DataFrame) -> DataFrame:
    """(doc_id, status, n) with a row for each of the six statuses."""
    counted = verified.groupBy("doc_id").agg(*[F.count_if(F.col("status") == s).alias(s) for s in STATUSES])
    return counted.select("doc_id", F.posexplode(F.array(*[F.col(s) for s in STATUSES])).alias("i", "n")).select("doc_id", F.element_at(F.array(*map(F.lit, STATUSES)), F.col("i") + 1).alias("status"), "n")


def no_source_answered(verified: DataFrame) -> DataFrame:
    """(doc_id, no_source): lookups were made and every one failed."""
    asked = verified.select("doc_id", F.explode("lookups").alias("x")).filter(F.col("x.status") != SKIPPED)
    return asked.groupBy("doc_id").agg(F.bool_and(F.col("x.status") == ERROR).alias("no_source"))
