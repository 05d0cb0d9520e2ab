"""Bibliographic services as tables.

``responses`` holds what services answered: (source, endpoint, request_key,
seq, http_status, headers, body, network_error), ``seq`` being the order in
which requests were made. From it come results in one shape for all services:
status, record fields, abstract, link, reason, how it was matched, and the DOI
the record states for itself.

Request keys: ``doi:<doi>``, ``arxiv:<id>`` and ``title:<search text>|<year>``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veriloom.functions.identifiers import arxiv_doi, doi_url, nonempty, normalize_arxiv_id, normalize_doi
from veriloom.functions.similarity import title_similarity
from veriloom.functions.text import clean_latex

#: Fixed values: (name, order, uses DOI, uses arXiv id, title search, metadata, strict DOI, required variable, seconds between requests).
REGISTRY = (
    ("arxiv", 1, True, True, False, False, False, None, 3.0),
    ("crossref", 2, True, False, False, True, False, None, 0.5),
    ("openalex", 3, True, False, True, True, False, None, 0.5),
    ("datacite", 4, True, True, False, True, False, None, 0.5),
    ("springer", 5, True, False, False, False, True, "SPRINGER_API_KEY", 0.0),
    ("s2", 6, True, True, False, False, False, None, 1.0),
    ("core", 7, True, False, False, False, True, None, 2.0),
    ("europepmc", 8, True, False, False, False, True, None, 0.0),
)
METADATA = tuple(r[0] for r in REGISTRY if r[5])
FOUND, ABSENT, ERROR, SKIPPED = "FOUND", "ABSENT", "ERROR", "SKIPPED"
USED_UP = "request allowance used up"
TITLE_HITS, TITLE_LEAST = 5, 0.60

RESPONSES = "source string, endpoint string, request_key string, seq long, http_status int, headers map<string,string>, body string, network_error string"
FIELDS = "struct<title:string,author_names:array<string>,year:string,journal:string,volume:string,issue:string,pages:string>"
RESULTS = ("source", "request_key", "seq", "status", "reason", "fields", "record_title", "abstract", "public_url", "resolved_doi", "record")


def registry(spark: SparkSession, available: dict[str, str] | None = None) -> DataFrame:
    """One row a source; one that needs a variable ``available`` lacks is not available."""
    have = available or {}
    rows = [(*r, r[7] is None or bool(have.get(r[7], "").strip())) for r in REGISTRY]
    return spark.createDataFrame(rows, "source string, source_order int, by_doi boolean, by_arxiv boolean, by_title boolean, metadata boolean, strict_doi boolean, required_env string, min_interval double, available boolean")


def select_sources(registry: DataFrame, names: list[str] | None = None) -> list[str]:
    """Names in (order, name) order: the available ones, or exactly those asked for. A small table of fixed size."""
    rows = {r["source"]: r for r in registry.orderBy("source_order", "source").collect()}
    if names is None:
        return [n for n, r in rows.items() if r["available"]]
    for n in names:
        if n not in rows:
            raise ValueError(f"unknown source: {n}")
        if not rows[n]["available"]:
            raise ValueError(f"source {n} is not available: {rows[n]['required_env']} is not set")
    return [n for n in rows if n in set(names)]


def missing_variables(registry: DataFrame) -> DataFrame:
    return registry.filter("not available").select("source", "required_env")


def classify(code: Column, body: Column, headers: Column, network_error: Column, metadata: Column, search: Column) -> Column:
    """(status, reason) of one answer, null status where the body is to be read."""
    out = lambda s, r: F.struct(F.lit(s).alias("status"), (F.lit(r) if isinstance(r, str) else r).alias("reason"))
    remaining = F.element_at(F.map_from_entries(F.transform(F.map_entries(F.coalesce(headers, F.create_map().cast("map<string,string>"))), lambda e: F.struct(F.lower(e["key"]), e["value"]))), "x-ratelimit-remaining")
    used_up = F.when(metadata, search).otherwise(F.coalesce(F.trim(remaining) == "0", F.lit(False)))
    http = lambda what: F.concat(F.lit("HTTP "), code.cast("string"), F.lit(f" ({what})"))
    text = F.trim(F.coalesce(body, F.lit("")))
    detail = F.when(F.contains(network_error, F.lit(":")), F.concat(F.lit("network error ("), F.substring_index(network_error, ":", 1), F.lit("): "), F.left(F.trim(F.regexp_replace(network_error, "^[^:]*:", "")), F.lit(200))))
    return (
        F.when(network_error.isNotNull(), out(ERROR, F.coalesce(detail, F.concat(F.lit("network error ("), network_error, F.lit(")")))))
        .when(code.isNull(), out(ERROR, "no recorded response"))
        .when(code == 404, out(ABSENT, "not found"))
        .when(code.isin(401, 403), out(ERROR, http("access denied")))
        .when((code == 429) & used_up, out(ERROR, f"HTTP 429 (rate limited, {USED_UP})"))
        .when(code == 429, out(ERROR, "HTTP 429 (rate limited)"))
        .when(code >= 500, out(ERROR, http("server error")))
        .when(code == 204, out(ABSENT, "empty response"))
        .when(~code.between(200, 299), out(ERROR, http("unexpected response")))
        .when(text == "", out(ABSENT, "empty response"))
        .otherwise(out(None, F.lit(None).cast("string")))
    )


def settle(responses: DataFrame) -> DataFrame:
    """Answers with (status, reason), latches applied, one row for each request.

    After 401, 403 or a used-up allowance an endpoint is locked: its later
    requests are errors for the same reason. The first lock of each endpoint is
    an aggregate of a few rows, not a running window. Of repeated requests the
    first answer that is no error counts, else the last.
    """
    metadata = F.col("source").isin(*METADATA)
    search = F.col("endpoint") == "search"
    got = responses.withColumn("c", classify(F.col("http_status"), F.col("body"), F.col("headers"), F.col("network_error"), metadata, search)).select("*", "c.status", "c.reason").drop("c")
    remaining = F.exists(F.map_entries(F.coalesce("headers", F.create_map().cast("map<string,string>"))), lambda e: (F.lower(e["key"]) == "x-ratelimit-remaining") & (F.trim(e["value"]) == "0"))
    spent = ~metadata & F.col("http_status").between(200, 299) & (F.col("http_status") != 204) & remaining
    locks = F.coalesce((F.col("status") == ERROR) & (F.col("reason").rlike(r"^HTTP 40[13] |allowance used up")), F.lit(False)) | spent
    cause = F.when(spent, F.lit(USED_UP)).otherwise(F.col("reason"))
    first = got.filter(locks).groupBy("source", "endpoint").agg(F.min(F.struct("seq", cause.alias("cause"))).alias("lock"))
    both = got.join(first, ["source", "endpoint"], "left")  # one row an endpoint
    late = F.coalesce(F.col("seq") > F.col("lock.seq"), F.lit(False))
    both = both.withColumn("status", F.when(late, ERROR).otherwise(F.col("status"))).withColumn("reason", F.when(late, F.col("lock.cause")).otherwise(F.col("reason"))).drop("lock")
    failed = F.coalesce(F.col("status") == ERROR, F.lit(False))
    best = F.min_by(F.struct("seq", "status", "reason", "body"), F.struct(failed, F.when(failed, -F.col("seq")).otherwise(F.col("seq"))))
    return both.groupBy("source", "endpoint", "request_key").agg(best.alias("b")).select("source", "endpoint", "request_key", "b.*")


_PERSON = "array<struct<family:string,given:string>>"
_SHAPES = {
    "crossref": f"message struct<DOI:string,title:array<string>,author:{_PERSON},issued:struct<`date-parts`:array<array<string>>>,`container-title`:array<string>,volume:string,issue:string,page:string,abstract:string,URL:string>",
    "datacite": "data struct<id:string,attributes:struct<doi:string,titles:array<struct<title:string,titleType:string>>,descriptions:array<struct<description:string,descriptionType:string>>,creators:array<struct<familyName:string,givenName:string,name:string>>,publicationYear:string,container:struct<title:string,volume:string,issue:string,firstPage:string,lastPage:string>>>",
    "springer": "records array<struct<doi:string,title:string,abstract:string>>",
    "s2": "title string, abstract string, externalIds map<string,string>, url string",
    "core": "results array<struct<doi:string,title:string,abstract:string>>",
    "europepmc": "resultList struct<result:array<struct<doi:string,title:string,abstractText:string>>>",
}
_WORK = "id string, doi string, title string, abstract_inverted_index map<string,array<int>>, authorships array<struct<author:struct<display_name:string>>>, publication_year string, primary_location struct<source:struct<display_name:string>>, biblio struct<volume:string,issue:string,first_page:string,last_page:string>"


def first_text(values: Column) -> Column:
    """The first string of an array that isn't blank, else null."""
    return F.get(F.filter(values, lambda v: F.trim(v) != ""), F.lit(0))


def inverted_text(index: Column) -> Column:
    """Text of a map from words to positions; null for an empty one."""
    placed = F.flatten(F.transform(F.map_entries(index), lambda e: F.transform(F.coalesce(e["value"], F.array().cast("array<int>")), lambda p: F.struct(p.alias("p"), e["key"].alias("w")))))
    return nonempty(F.array_join(F.transform(F.array_sort(placed, lambda a, b: a["p"] - b["p"]), lambda x: x["w"]), " "))


def joined_pages(first: Column, last: Column) -> Column:
    first, last = nonempty(first), nonempty(last)
    return F.when(last.isNotNull() & (last != first), F.concat(first, F.lit("-"), last)).otherwise(first)


def names(people: Column, family: str, given: str, alone: str | None = None) -> Column:
    """Array of "Family, Given" (or the family name, or ``alone``), null if there is none."""
    one = lambda p: F.when(nonempty(p[family]).isNotNull(), F.concat_ws(", ", p[family], nonempty(p[given])))
    out = F.transform(people, lambda p: F.coalesce(one(p), nonempty(p[alone])) if alone else one(p))
    out = F.filter(out, lambda n: n.isNotNull())
    return F.when(F.size(out) > 0, out)


def _fields(**c: Column) -> Column:
    parts = ("title", "author_names", "year", "journal", "volume", "issue", "pages")
    return F.struct(*[c.get(p, F.lit(None)).cast("array<string>" if p == "author_names" else "string").alias(p) for p in parts])


def crossref_fields(m: Column) -> Column:
    year = F.get(F.get(m["issued"]["date-parts"], F.lit(0)), F.lit(0))
    return _fields(title=first_text(m["title"]), author_names=names(m["author"], "family", "given"), year=nonempty(year), journal=first_text(m["container-title"]), volume=nonempty(m["volume"]), issue=nonempty(m["issue"]), pages=nonempty(m["page"]))


def openalex_fields(w: Column) -> Column:
    people = F.filter(F.transform(w["authorships"], lambda a: nonempty(a["author"]["display_name"])), lambda n: n.isNotNull())
    b = w["biblio"]
    return _fields(title=nonempty(w["title"]), author_names=F.when(F.size(people) > 0, people), year=nonempty(w["publication_year"]), journal=nonempty(w["primary_location"]["source"]["display_name"]), volume=nonempty(b["volume"]), issue=nonempty(b["issue"]), pages=joined_pages(b["first_page"], b["last_page"]))


def datacite_fields(attributes: Column) -> Column:
    titles = attributes["titles"]
    main = F.transform(F.filter(titles, lambda t: nonempty(t["titleType"]).isNull()), lambda t: t["title"])
    c = attributes["container"]
    title = F.coalesce(first_text(main), first_text(F.transform(titles, lambda t: t["title"])))
    return _fields(title=title, author_names=names(attributes["creators"], "familyName", "givenName", "name"), year=nonempty(attributes["publicationYear"]), journal=nonempty(c["title"]), volume=nonempty(c["volume"]), issue=nonempty(c["issue"]), pages=joined_pages(c["firstPage"], c["lastPage"]))


def _result(df: DataFrame, *, empty: Column, fields: Column, title: Column, abstract: Column, url: Column, own_doi: Column, record: Column, strict: bool = False, absent: Column | None = None, absent_reason: str = "identifier mismatch") -> DataFrame:
    """Results of one source from its parsed answers: bad structure, emptiness and the DOI rule, in this order."""
    df = df.withColumns({"own": own_doi, "tree": F.try_parse_json("body")}).withColumn("kind", F.schema_of_variant("tree"))  # as columns, so that they are computed once
    tree, kind, own = F.col("tree"), F.col("kind"), F.col("own")
    hollow = tree.isNotNull() & kind.isin("VOID", "OBJECT<>", "ARRAY<VOID>", "ARRAY<>")
    asked = F.when(F.col("request_key").startswith("doi:"), F.substring("request_key", 5, 10_000))
    if strict:
        wrong = asked.isNotNull() & ~F.coalesce(own == asked, F.lit(False))
    else:
        wrong = asked.isNotNull() & own.isNotNull() & (own != asked)
    out = lambda s, r: F.struct(F.lit(s).alias("status"), F.lit(r).cast("string").alias("reason"))
    verdict = (
        F.when(F.col("status").isNotNull(), F.struct("status", "reason"))
        .when(tree.isNull(), out(ERROR, "invalid response (not JSON)"))
        .when(hollow, out(ABSENT, "empty response"))
        .when(~kind.startswith("OBJECT"), out(ERROR, "invalid response (unexpected structure)"))
        .when(F.coalesce(empty, F.lit(True)), out(ABSENT, "not found" if strict else "empty response"))
        .when(F.coalesce(absent, F.lit(False)) if absent is not None else F.lit(False), out(ABSENT, absent_reason))
        .when(F.coalesce(wrong, F.lit(False)), out(ABSENT, "doi mismatch"))
        .otherwise(out(FOUND, None))
    )
    values = {"_fields": fields, "_title": nonempty(title), "_abstract": abstract, "_url": url, "_record": record}
    return _shaped(df.withColumns({"v": verdict} | values), F.col("own"))


def _shaped(df: DataFrame, own_doi: Column) -> DataFrame:
    """``RESULTS`` columns from the verdict ``v`` and the values of a record, which count only where it was found."""
    found = F.col("v.status") == FOUND
    keep = lambda c: F.when(found, F.col(c)).alias({"_fields": "fields", "_title": "record_title", "_abstract": "abstract", "_url": "public_url", "_record": "record"}[c])
    stated = F.when(found | (F.col("v.reason") == "doi mismatch"), own_doi)
    return df.select("source", "request_key", "seq", "v.status", "v.reason", keep("_fields"), keep("_title"), keep("_abstract"), keep("_url"), stated.alias("resolved_doi"), keep("_record"))


def parse(settled: DataFrame) -> DataFrame:
    """Results of all settled identifier requests: ``RESULTS`` columns. Each source's rows are read with its own shape."""
    none = F.lit(None).cast(FIELDS)
    part = {s: settled.filter((F.col("source") == s) & (F.col("endpoint") != "title")).withColumn("j", F.from_json("body", shape)) for s, shape in _SHAPES.items()}
    body = F.col("body")
    out = []
    m = F.col("j.message")
    own = normalize_doi(m["DOI"])
    out.append(_result(part["crossref"], empty=m.isNull(), fields=crossref_fields(m), title=first_text(m["title"]), abstract=nonempty(m["abstract"]), url=F.coalesce(doi_url(own), m["URL"]), own_doi=own, record=F.to_json(m)))
    works = settled.filter("source = 'openalex' and request_key not like 'title:%'").withColumn("j", F.from_json("body", _WORK))
    w = F.col("j")
    own = normalize_doi(w["doi"])
    out.append(_result(works, empty=F.lit(False), fields=openalex_fields(w), title=w["title"], abstract=inverted_text(w["abstract_inverted_index"]), url=F.coalesce(doi_url(own), w["id"]), own_doi=own, record=body))
    d, a = F.col("j.data"), F.col("j.data.attributes")
    own = normalize_doi(F.coalesce(nonempty(a["doi"]), d["id"]))
    abstract = F.get(F.filter(F.transform(F.filter(a["descriptions"], lambda x: x["descriptionType"] == "Abstract"), lambda x: x["description"]), lambda t: F.trim(t) != ""), F.lit(0))
    by_arxiv = F.col("request_key").startswith("arxiv:")
    wrong = by_arxiv & own.isNotNull() & (own != arxiv_doi(F.substring("request_key", 7, 10_000)))
    out.append(_result(part["datacite"], empty=d.isNull(), fields=datacite_fields(a), title=datacite_fields(a)["title"], abstract=abstract, url=doi_url(own), own_doi=own, record=F.to_json(d), absent=wrong, absent_reason="doi mismatch"))
    for source, rows, text in (("springer", F.col("j.records"), "abstract"), ("core", F.col("j.results"), "abstract"), ("europepmc", F.col("j.resultList.result"), "abstractText")):
        r = F.get(rows, F.lit(0))
        own = normalize_doi(r["doi"])
        out.append(_result(part[source], empty=r.isNull(), fields=none, title=r["title"], abstract=F.when(F.trim(r[text]) != "", r[text]), url=doi_url(own), own_doi=own, record=F.to_json(r), strict=True))
    own, ids = normalize_doi(F.col("j.externalIds")["DOI"]), normalize_arxiv_id(F.col("j.externalIds")["ArXiv"])
    wrong = by_arxiv & ids.isNotNull() & (ids != F.substring("request_key", 7, 10_000))
    out.append(_result(part["s2"], empty=F.lit(False), fields=none, title=F.col("j.title"), abstract=F.when(F.trim(F.col("j.abstract")) != "", F.col("j.abstract")), url=F.coalesce(doi_url(own), F.col("j.url")), own_doi=own, record=body, absent=wrong))
    out.append(_atom(settled.filter("source = 'arxiv'")))
    total = out[0]
    for o in out[1:]:
        total = total.unionByName(o)
    return total


def _atom(df: DataFrame) -> DataFrame:
    """arXiv answers: an Atom feed whose first entry must have the identifier that was asked for."""
    shape = "entry array<struct<id:string,title:string,summary:string,published:string,doi:string>>, _bad string"
    df = df.withColumn("x", F.from_xml("body", shape, {"rowTag": "feed", "ignoreNamespace": "true", "columnNameOfCorruptRecord": "_bad", "mode": "PERMISSIVE"}))
    e = F.get(F.col("x.entry"), F.lit(0))
    has = F.contains(F.trim(e["id"]), F.lit("/abs/")) & ~F.contains(e["id"], F.lit("/api/errors"))
    own = normalize_arxiv_id(F.substring_index(F.trim(e["id"]), "/abs/", -1))
    asked = F.substring("request_key", 7, 10_000)
    out = lambda s, r: F.struct(F.lit(s).alias("status"), F.lit(r).cast("string").alias("reason"))
    v = (
        F.when(F.col("status").isNotNull(), F.struct("status", "reason"))
        .when(F.col("x._bad").isNotNull() | ~F.coalesce(F.col("body").rlike("(?s)^\\s*<.*>\\s*$"), F.lit(False)), out(ERROR, "invalid response (not XML)"))
        .when(~F.coalesce(has, F.lit(False)), out(ABSENT, "not found"))
        .when(~F.coalesce(own == asked, F.lit(False)), out(ABSENT, "identifier mismatch"))
        .otherwise(out(FOUND, None))
    )
    title = F.trim(F.regexp_replace(e["title"], r"(?U)\s+", " "))
    values = {"_fields": F.lit(None).cast(FIELDS), "_title": nonempty(title), "_abstract": e["summary"], "_url": F.concat(F.lit("https://arxiv.org/abs/"), own), "_record": F.to_json(e), "own": arxiv_doi(own)}
    return _shaped(df.withColumns({"v": v} | values), F.col("own"))


def search_text(title: Column) -> Column:
    """The title as it is searched for: no LaTeX, commas or bars."""
    return F.trim(F.regexp_replace(F.regexp_replace(clean_latex(title), r"[,|]", " "), r"(?U)\s+", " "))


def title_key(title: Column, year: Column) -> Column:
    return F.when(search_text(title) != "", F.concat(F.lit("title:"), search_text(title), F.lit("|"), F.coalesce(year.cast("string"), F.lit(""))))


def title_results(settled: DataFrame, wanted: DataFrame) -> DataFrame:
    """Results of title searches for ``wanted`` (request_key, title): the hit whose title is most similar, first of ties, at 0.60 or more.

    At most five hits of a request are compared: what the service ranked first.
    """
    got = settled.filter("source = 'openalex' and request_key like 'title:%'").join(wanted.dropDuplicates(["request_key"]), "request_key")
    got = got.withColumn("tree", F.try_parse_json("body"))
    tree = F.col("tree")
    shaped = F.schema_of_variant(tree).startswith("OBJECT")
    got = got.withColumn("j", F.from_json("body", f"results array<struct<{', '.join(p.strip().replace(' ', ':', 1) for p in _split_fields(_WORK))}>>"))
    hits = got.filter("status is null").select("request_key", "seq", "title", F.posexplode(F.slice(F.coalesce("j.results", F.array().cast(got.schema["j"].dataType["results"].dataType)), 1, TITLE_HITS)).alias("n", "w"))
    hits = hits.withColumn("ratio", title_similarity(clean_latex(F.col("title")), F.coalesce(F.col("w.title"), F.lit(""))))
    best = hits.filter(F.col("ratio") >= TITLE_LEAST).groupBy("request_key").agg(F.max_by(F.struct("seq", "w"), F.struct("ratio", -F.col("n"))).alias("b"))
    both = got.join(best.withColumnRenamed("request_key", "_key"), F.col("request_key") == F.col("_key"), "left")
    w = F.col("b.w")
    own = normalize_doi(w["doi"])
    out = lambda s, r: F.struct(F.lit(s).alias("status"), F.lit(r).cast("string").alias("reason"))
    v = (
        F.when(F.col("status").isNotNull(), F.struct("status", "reason"))
        .when(tree.isNull(), out(ERROR, "invalid response (not JSON)"))
        .when(~shaped, out(ERROR, "invalid response (unexpected structure)"))
        .when(w.isNull(), out(ABSENT, "no title match"))
        .otherwise(out(FOUND, None))
    )
    values = {"_fields": openalex_fields(w), "_title": nonempty(w["title"]), "_abstract": inverted_text(w["abstract_inverted_index"]), "_url": F.coalesce(doi_url(own), w["id"]), "_record": F.to_json(w), "own": own}
    return _shaped(both.withColumns({"v": v} | values), F.col("own"))


def _split_fields(ddl: str) -> list[str]:
    """Top-level fields of a schema text."""
    out, depth, start = [], 0, 0
    for i, c in enumerate(ddl):
        depth += (c == "<") - (c == ">")
        if c == "," and depth == 0:
            out.append(ddl[start:i])
            start = i + 1
    return [*out, ddl[start:]]
