"""The abstract of each cited work: from the store, else from the first source that has a usable one."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veriloom.functions.identifiers import doi_url, normalize_doi
from veriloom.functions.similarity import agree, compare_fields
from veriloom.functions.text import plain_latex, usable, clean_text
from veriloom.operators.references import SEPARATOR, looked_up, prepared
from veriloom.sources.records import ABSENT, ERROR, FOUND, REGISTRY
from veriloom.sources.store import FORMAT, decode_metadata, encode_metadata

SOURCES = tuple(r[0] for r in REGISTRY)
STORED_MISMATCH = "database: stored record title does not match the entry"
EVIDENCE = "struct<abstract:string,source:string,origin:string,match:string,public_url:string,resolved_doi:string>"


def works(claims: DataFrame, entries: DataFrame) -> DataFrame:
    """Each cited key of a document once, with its first entry (null fields if it has none) and its title in plain text."""
    keys = claims.groupBy("doc_id", F.col("cite_key").alias("key")).agg(F.min("claim_index").alias("first"))
    own = keys.join(prepared(entries), ["doc_id", "key"], "left")
    return own.withColumn("plain_title", F.when(F.col("fields").isNotNull(), plain_latex(F.col("fields")["title"])))


def stored(own: DataFrame, store: DataFrame, formats: tuple[str, ...]) -> DataFrame:
    """(doc_id, key, hit, note): usable stored abstracts of found works; a note instead where the stored title names another work."""
    kept = store.filter("outcome = 'FOUND'").select(normalize_doi(F.col("doi")).alias("doi"), usable(clean_text("abstract")).alias("abstract"), "provider", decode_metadata(F.col("raw_json"), F.col("doi"), formats).alias("m"))
    both = own.select("doc_id", "key", "doi", "plain_title").join(kept.filter("abstract is not null").dropDuplicates(["doi"]), "doi")
    same = F.col("m").isNull() | agree("plain_title", "m.fields.title")
    hit = F.struct("abstract", F.col("provider").alias("source"), F.lit("DB").alias("origin"), F.lit("doi").alias("match"), doi_url(F.col("doi")).alias("public_url"), F.col("doi").alias("resolved_doi"))
    return both.select("doc_id", "key", F.when(same, hit).alias("hit"), F.when(~same, STORED_MISMATCH).alias("note"))


def _judged(rows: DataFrame, by_title: bool) -> DataFrame:
    """Adds hit (evidence), note and error of each result; abstracts and titles are only looked at where a record was found."""
    found = rows.filter(F.col("status") == FOUND).withColumn("text", usable(clean_text("abstract"))).withColumn("same", agree("plain_title", "record_title"))
    named = F.col("record_title").isNotNull() if by_title else F.lit(True)
    has_title = F.coalesce(F.col("plain_title"), F.lit("")) != ""
    fits = ~has_title | (F.col("same") & named)
    other = F.coalesce(F.col("other"), F.lit(False)) if by_title else F.lit(False)
    hit = F.struct(F.col("text").alias("abstract"), "source", F.lit("API").alias("origin"), F.col("matched_by").alias("match"), "public_url", normalize_doi(F.col("resolved_doi")).alias("resolved_doi"))
    told = lambda t: F.concat("source", F.lit(f": {t}"))
    note = F.when(other, told("title search hit is another work")).when(F.col("text").isNull(), told("no usable abstract")).when(~fits, told("record title does not match the entry"))
    found = found.withColumns({"hit": F.when(note.isNull(), hit), "note": note, "error": F.lit(None).cast("string")}).drop("text", "same")
    rest = rows.filter(F.col("status") != FOUND).withColumns({
        "hit": F.lit(None).cast(EVIDENCE),
        "note": F.when(F.col("status") == ABSENT, F.concat_ws(": ", "source", F.coalesce("reason", F.lit("not found")))),
        "error": F.when(F.col("status") == ERROR, F.concat_ws(": ", "source", F.coalesce("reason", F.lit("error")))),
    })
    return found.unionByName(rest)


def find(own: DataFrame, results: DataFrame, title_hits: DataFrame | None = None, store: DataFrame | None = None, sources: tuple[str, ...] = SOURCES, formats: tuple[str, ...] = (FORMAT,)) -> DataFrame:
    """Evidence of each work (see :func:`works`): doc_id, key, lookup_status, reason, and the parts of EVIDENCE.

    A stored abstract comes first; then sources in order up to the first with a
    usable abstract whose record agrees in title; then a title search, if the
    work has no DOI or nobody who was asked found it or failed.
    """
    none = F.lit(None).cast(EVIDENCE)
    if store is not None:
        own = own.join(stored(own, store, formats).withColumnsRenamed({"hit": "db_hit", "note": "db_note"}), ["doc_id", "key"], "left")
    else:
        own = own.withColumns({"db_hit": none, "db_note": F.lit(None).cast("string")})
    open_ = own.filter("db_hit is null and fields is not null")
    rows = _judged(looked_up(open_.filter("doi is not null or arxiv_id is not null"), results, sources), False)
    item = F.struct("n", "status", "hit", "note", "error")
    per = rows.groupBy("doc_id", "key").agg(F.array_sort(F.collect_list(item), lambda a, b: a["n"] - b["n"]).alias("all"))  # one row a source
    stop = F.array_position(F.transform("all", lambda x: x["hit"].isNotNull()), True)
    per = per.withColumn("tried", F.when(stop > 0, F.slice("all", 1, stop.cast("int"))).otherwise(F.col("all"))).drop("all")
    kind = per.schema["tried"].dataType
    live = open_.join(per, ["doc_id", "key"], "left").withColumn("tried", F.coalesce("tried", F.array().cast(kind)))
    if title_hits is not None:
        hit = F.exists("tried", lambda x: x["hit"].isNotNull())
        clear = F.col("doi").isNull() | ~F.exists("tried", lambda x: x["status"].isin(FOUND, ERROR))
        asked = live.filter(~hit & clear & F.col("title_key").isNotNull()).select("doc_id", "key", "doi", "compared", "plain_title", F.col("title_key").alias("request_key")).join(title_hits.drop("seq"), "request_key")
        major = F.exists(compare_fields("compared", "fields", "source"), lambda c: F.coalesce(c["severity"] == "major", F.lit(False)))
        foreign = F.col("doi").isNotNull() & F.coalesce(F.col("resolved_doi") != F.col("doi"), F.lit(False))
        asked = asked.withColumns({"n": F.lit(len(sources)), "matched_by": F.lit("title"), "other": foreign | F.coalesce(major, F.lit(False))})
        more = _judged(asked, True).select("doc_id", "key", F.array(item).cast(kind).alias("more"))
        live = live.join(more, ["doc_id", "key"], "left").withColumn("tried", F.concat("tried", F.coalesce("more", F.array().cast(kind)))).drop("more")
    live = live.withColumn("h", F.get(F.filter("tried", lambda x: x["hit"].isNotNull()), F.lit(0))["hit"])
    best = F.col("h")
    texts = lambda name: F.filter(F.transform("tried", lambda x: x[name]), lambda v: v.isNotNull())
    db = F.when(F.col("db_note").isNotNull(), F.array("db_note")).otherwise(F.array().cast("array<string>"))
    live = live.withColumns({"errors": texts("error"), "notes": F.concat(db, texts("note")), "db": db})
    errors, notes, db = F.col("errors"), F.col("notes"), F.col("db")
    nothing = F.when(F.col("doi").isNull() & F.col("arxiv_id").isNull() & (F.coalesce("plain_title", F.lit("")) == ""), "no DOI, arXiv identifier or title").otherwise("no applicable source")
    reason = F.when(best.isNotNull(), F.col("db_note")).when(F.size(errors) > 0, F.array_join(F.concat(errors, db), SEPARATOR)).when(F.size(notes) > 0, F.array_join(notes, SEPARATOR)).otherwise(nothing)
    status = F.when(best.isNotNull(), "found").when(F.size(errors) > 0, "source_error").otherwise("absent")
    shape = ("doc_id", "key", "plain_title")
    out = live.select(*shape, status.alias("lookup_status"), reason.alias("reason"), "h")
    kept = own.filter("db_hit is not null").select(*shape, F.lit("found").alias("lookup_status"), F.lit(None).cast("string").alias("reason"), F.col("db_hit").alias("h"))
    lone = own.filter("db_hit is null and fields is null").select(*shape, F.lit("absent").alias("lookup_status"), F.lit("no bibliography entry for this key").alias("reason"), none.alias("h"))
    return out.unionByName(kept).unionByName(lone).select("doc_id", "key", F.col("plain_title").alias("title"), "lookup_status", "reason", "h.*")


def new_store_rows(found: DataFrame, own: DataFrame, results: DataFrame, at: str) -> DataFrame:
    """Rows for the store: abstracts found live whose record states the entry's own DOI.

    Metadata go with a row if a metadata source's record of that DOI has a
    title that agrees with the entry's; the first such source by name order counts.
    """
    live = found.filter("origin = 'API' and abstract is not null").join(own.select("doc_id", "key", "doi", "plain_title", "first"), ["doc_id", "key"])
    live = live.filter("resolved_doi = doi and doi like '10.%'")
    meta = results.filter(F.col("fields.title").isNotNull() & (F.col("status") == FOUND) & F.col("request_key").startswith("doi:")).select(F.col("source").alias("m_source"), F.col("resolved_doi").alias("doi"), "fields").filter("doi is not null")
    both = live.join(meta, "doi", "left")
    same = F.col("fields").isNotNull() & (F.coalesce("plain_title", F.lit("")) != "") & agree("plain_title", "fields.title")
    raw = F.when(same, encode_metadata(F.col("m_source"), F.col("doi"), F.col("fields"), F.lit(at)))
    order = F.array_position(F.array(*map(F.lit, SOURCES)), F.col("m_source"))
    rows = both.withColumn("raw_json", raw).groupBy("doi").agg(F.min_by("abstract", "first").alias("abstract"), F.min_by("source", "first").alias("provider"), F.min_by("raw_json", F.when(F.col("raw_json").isNotNull(), order)).alias("raw_json"), F.min("first").alias("ordinal"))
    return rows.select("doi", "abstract", "provider", F.lit("FOUND").alias("outcome"), F.lit(at).alias("fetched_at"), "raw_json", "ordinal")
