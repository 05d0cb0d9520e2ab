"""Operators over small literal tables: documents, bibliographies, records, evidence, verdicts."""

import json
import sqlite3

import pytest
from pyspark.sql import functions as F

from veriloom.operators import consistency as C
from veriloom.operators import evidence as E
from veriloom.operators import judging as J
from veriloom.operators import references as R
from veriloom.plans.tables import Tables
from veriloom.sources import bibtex, records, store, tex

MAIN = r"""\documentclass{article} % \input{ignored}
\addbibresource{refs.bib}\bibliography{refs,missing}
\begin{document}
\section{Intro \cite{s}}
First we begin. Then Smith et al. found it \cite{a,b}. \begin{table} \cite{t} \end{table}
It holds.\footcite{a} \input{part}
% \cite{hidden}

New paragraph \citet[p.~2]{c}. \nocite{n}
\end{document} \cite{late}"""
PART = "Included text \\cite{d}. \\input{main} \\include{deep/more}"
FILES = [(1, "p/main.tex", True, MAIN), (1, "p/part.tex", False, PART), (1, "p/deep/more.tex", False, "Deep \\cite{e}."), (1, "p/refs.bib", False, "@article{a, title={A}}\n@book{a, title={A2}}\n@misc{b, title={B}}\n@misc{x,}"), (2, "q/m.tex", True, "\\begin{thebibliography}\\bibitem{k}\\end{thebibliography}\\cite{k}\\nocite{*}")]
ABSTRACT = "This abstract is long enough to be used, as it has well over fifty letters."


@pytest.fixture(scope="module")
def files(spark):
    return spark.createDataFrame(FILES, "doc_id long, path string, is_main boolean, text string")


@pytest.fixture(scope="module")
def docs(files):
    return tex.documents(files)


def test_includes(docs):
    text = {r.doc_id: r.text for r in docs.collect()}
    assert "Included text \\cite{d}." in text[1] and "Deep \\cite{e}." in text[1] and "\\input{main}" in text[1] and "% \\input{ignored}" in text[1]


def test_include_depth_and_resolution(spark):
    rows = [(1, f"p/{i}.tex", i == 0, f"{i} \\input{{{i + 1}}}") for i in range(20)]
    rows += [(2, "q/main.tex", True, "\\input{a} \\input{sub/b}"), (2, "q/a", False, "plain"), (2, "q/sub/b.tex", False, "b \\input{c} \\input{none}"), (2, "q/sub/c.tex", False, "c \\input{b}"), (2, "q/a.bib", False, "x"), (3, "r/main.tex", True, None)]
    got = {r.doc_id: r.text for r in tex.documents(spark.createDataFrame(rows, "doc_id long, path string, is_main boolean, text string")).collect()}
    assert got[1].split()[-2:] == ["10", "\\input{11}"]
    assert got[2] == "plain b c \\input{b} \\input{none}" and got[3] == ""
    assert tex.include_paths("a.tex", "p", "p/sub") == ["p/a.tex", "p/sub/a.tex"]


def test_bibliographies_and_notes(docs, files):
    found, notes = tex.bibliographies(docs, files)
    assert [(r.doc_id, r.bib_file) for r in found.collect()] == [(1, "refs.bib")]
    assert [r.note for r in notes.collect()] == ["bibliography file not found: missing.bib"]
    assert {r.doc_id: (r.bib_format, r.embedded_keys) for r in tex.bibliography_format(docs).collect()} == {1: ("external", []), 2: ("embedded", ["k"])}


def test_consistency(docs, files):
    entries = bibtex.entries(tex.bibliographies(docs, files)[0])
    defined = entries.select("doc_id", "key").unionAll(tex.bibliography_format(docs).select("doc_id", F.explode("embedded_keys").alias("key")))
    got = {r.doc_id: r for r in C.check(docs, defined, tex.bibliography_format(docs)).collect()}
    assert got[1].cited_keys == ["a", "b", "c", "d", "e", "late", "n", "s", "t"] and got[1].cited_but_undefined == ["c", "d", "e", "late", "n", "s", "t"] and got[1].defined_but_uncited == ["x"]
    assert got[2].nocite_all and got[2].consistent and got[2].bib_format == "embedded"
    assert [r.note for r in C.duplicate_keys(entries).collect()] == ["duplicate key, the claim check uses its first entry: a"]
    assert {r.key: r["fields"].get("title") for r in C.first_entries(entries).collect()} == {"a": "A", "b": "B", "x": None}


def test_claims(docs):
    got = [(r.claim_index, r.cite_key, r.command, r.context_before) for r in C.claims(docs).filter("doc_id = 1").orderBy("claim_index").collect()]
    assert [g[1] for g in got] == ["a", "b", "a", "d", "e", "c"] and [g[0] for g in got] == list(range(1, 7))
    assert got[0][3] == "First we begin." and got[5][2:] == ("citet", "")


def test_bibtex():
    text = '@string{j = "Journal"}\n@comment{x}@preamble{"y"}\n@Article(k1, Title = {A {B} "c"}, journal = j # " of X", month = jan, year = 2020,)\n@online{k2, note = "a {"} b"}\n@bad{k3, title = {open\n@misc{k4, url={u}}'
    got = list(bibtex.parse("\ufeff" + text))
    assert got[0] == ("k1", "article", {"title": 'A {B} "c"', "journal": "Journal of X", "month": "January", "year": "2020"})
    assert got[1] == ("k2", "online", {"note": 'a {"} b'}) and got[-1] == ("k4", "misc", {"url": "u"})


def test_data_sources(spark, tmp_path):
    store.register(spark)
    (tmp_path / "a.bib").write_text("@misc{k, title={T}}", encoding="utf-8")
    assert [(r.key, r.fields) for r in spark.read.format("bibtex").load(str(tmp_path)).collect()] == [("k", {"title": "T"})]
    con = sqlite3.connect(tmp_path / "s.db")
    con.execute("CREATE TABLE abstracts (doi TEXT PRIMARY KEY, abstract TEXT, provider TEXT NOT NULL, outcome TEXT NOT NULL, fetched_at TEXT NOT NULL, more TEXT)")
    con.execute("INSERT INTO abstracts VALUES ('10.1/a', 'x', 'crossref', 'FOUND', 't', 'm')")
    con.commit()
    con.close()
    assert [tuple(r) for r in spark.read.format("abstract_sqlite").load(str(tmp_path / "s.db")).collect()] == [("10.1/a", "x", "crossref", "FOUND", "t", None)]
    with pytest.raises(ValueError, match="missing: outcome"):
        store.check_columns(spark.createDataFrame([], "doi string, abstract string, provider string, fetched_at string"))


def crossref(doi, title, year="2020", abstract=ABSTRACT, authors=(("Doe", "Jane"),)):
    return json.dumps({"message": {"DOI": doi, "title": [title], "author": [{"family": f, "given": g} for f, g in authors], "issued": {"date-parts": [[int(year)]]}, "container-title": ["Journal of Tests"], "abstract": abstract}})


def openalex(doi, title, year=2020, words=ABSTRACT):
    index = {}
    for i, w in enumerate(words.split()):
        index.setdefault(w, []).append(i)
    return {"id": "http://oa/1", "doi": doi and f"https://doi.org/{doi}", "title": title, "publication_year": year, "abstract_inverted_index": index, "authorships": [{"author": {"display_name": "Jane Doe"}}]}


RESPONSES = [
    ("crossref", "works", "doi:10.1/match", 1, 200, None, crossref("10.1/match", "A study of many things"), None),
    ("crossref", "works", "doi:10.1/minor", 2, 200, None, crossref("10.1/minor", "Some other study", "2021"), None),
    ("crossref", "works", "doi:10.1/major", 3, 200, None, crossref("10.1/major", "Entirely unrelated work on birds"), None),
    ("crossref", "works", "doi:10.1/other", 4, 200, None, crossref("10.9/else", "Whatever"), None),
    ("crossref", "works", "doi:10.1/error", 5, 503, None, None, None),
    ("crossref", "works", "doi:10.1/retry", 6, 503, None, None, None),
    ("crossref", "works", "doi:10.1/retry", 7, 200, None, crossref("10.1/retry", "Tried again"), None),
    *[("openalex", "work", f"doi:10.1/{k}", 10 + i, 404, None, None, None) for i, k in enumerate(("other", "error", "gone"))],
    *[("datacite", "dois", f"doi:10.1/{k}", 20 + i, 404, None, None, None) for i, k in enumerate(("other", "error", "gone"))],
    ("crossref", "works", "doi:10.1/gone", 30, 404, None, None, None),
    ("datacite", "dois", "arxiv:2401.01234", 31, 200, None, json.dumps({"data": {"id": "x", "attributes": {"doi": "10.48550/arXiv.2401.01234", "titles": [{"title": "Sub", "titleType": "Subtitle"}, {"title": "An archived paper"}], "creators": [{"familyName": "Doe", "givenName": "Jane"}], "publicationYear": 2024, "descriptions": [{"descriptionType": "Other", "description": "no"}, {"descriptionType": "Abstract", "description": ABSTRACT}]}}}), None),
    ("openalex", "search", "title:A paper without any identifier|2020", 40, 200, None, json.dumps({"results": [openalex(None, "A paper with no such thing"), openalex("10.5/found", "A paper without any identifier")]}), None),
    ("openalex", "search", "title:Unheard of|", 41, 200, None, json.dumps({"results": [openalex(None, "Completely different")]}), None),
    ("arxiv", "query", "arxiv:2401.01234", 50, 200, None, f'<feed xmlns="http://www.w3.org/2005/Atom"><entry><id>http://arxiv.org/abs/2401.01234v1</id><title>An archived\n paper</title><summary>{ABSTRACT}</summary></entry></feed>', None),
    ("springer", "meta", "doi:10.1/gone", 60, 200, None, json.dumps({"records": [{"title": "Gone for good", "abstract": ABSTRACT}]}), None),
    ("s2", "paper", "doi:10.1/gone", 61, 200, None, json.dumps({"title": "Gone for good", "abstract": ABSTRACT, "externalIds": {"DOI": "10.1/GONE"}, "url": "u"}), None),
    ("core", "search", "doi:10.1/gone", 62, 403, None, None, None),
    ("core", "search", "doi:10.1/error", 63, 200, None, json.dumps({"results": [{"doi": "10.1/error"}]}), None),
    ("europepmc", "search", "doi:10.1/gone", 64, None, None, None, "ConnectionError: refused"),
]


@pytest.fixture(scope="module")
def settled(spark):
    return Tables(spark, "test").keep(records.settle(spark.createDataFrame(RESPONSES, records.RESPONSES)))


@pytest.fixture(scope="module")
def results(spark, settled):
    return Tables(spark, "test").keep(records.parse(settled))


def entry(key, title, doi=None, year="2020", **more):
    fields = {"title": title, "author": "Doe, Jane", "year": year} | ({"doi": doi} if doi else {}) | more
    return fields


ENTRIES = [
    ("match", entry("match", "A study of many things", "https://doi.org/10.1/MATCH")), ("minor", entry("minor", "Some other study", "10.1/minor")), ("major", entry("major", "A study of fish", "10.1/major")), ("other", entry("other", "Whatever", "10.1/other")),
    ("error", entry("error", "An error", "10.1/error")), ("retry", entry("retry", "Tried again", "10.1/retry")), ("gone", entry("gone", "Gone for good", "10.1/gone")), ("arx", entry("arx", "An archived paper", None, "2024", eprint="2401.01234v2", archiveprefix="arXiv")),
    ("title", entry("title", "A paper without any identifier")), ("lost", {"title": "Unheard of"}), ("bare", {"note": "nothing"}),
]


@pytest.fixture(scope="module")
def entries(spark):
    return spark.createDataFrame([(1, "refs.bib", i, k, "article", f) for i, (k, f) in enumerate(ENTRIES)], "doc_id long, bib_file string, ordinal long, key string, entry_type string, fields map<string,string>")


@pytest.fixture(scope="module")
def title_hits(spark, settled, entries):
    return Tables(spark, "test").keep(records.title_results(settled, R.prepared(entries).select(F.col("title_key").alias("request_key"), "title")))


def test_classification_and_locks(results):
    got = {(r.source, r.request_key): (r.status, r.reason) for r in results.collect()}
    assert got["crossref", "doi:10.1/retry"] == ("FOUND", None) and got["crossref", "doi:10.1/error"] == ("ERROR", "HTTP 503 (server error)")
    assert got["crossref", "doi:10.1/other"] == ("ABSENT", "doi mismatch") and got["springer", "doi:10.1/gone"] == ("ABSENT", "doi mismatch")
    assert got["core", "doi:10.1/gone"] == ("ERROR", "HTTP 403 (access denied)") == got["core", "doi:10.1/error"]
    assert got["europepmc", "doi:10.1/gone"] == ("ERROR", "network error (ConnectionError): refused")
    assert got["arxiv", "arxiv:2401.01234"] == ("FOUND", None) and got["datacite", "arxiv:2401.01234"] == ("FOUND", None)


def test_allowances(spark):
    rows = [("s2", "paper", f"doi:{i}", i, c, h, "{}", None) for i, (c, h) in enumerate([(200, None), (429, None), (200, {"X-RateLimit-Remaining": "0"}), (200, None)])] + [("openalex", "search", "title:a|", 9, 429, None, None, None), ("openalex", "work", "doi:1", 10, 429, None, None, None), ("openalex", "work", "doi:2", 11, 200, None, "{}", None)]
    got = {(r.source, r.request_key): r.reason for r in records.settle(spark.createDataFrame(rows, records.RESPONSES)).collect()}
    assert got["s2", "doi:1"] == "HTTP 429 (rate limited)" and got["s2", "doi:2"] is None and got["s2", "doi:3"] == records.USED_UP
    assert got["openalex", "title:a|"] == "HTTP 429 (rate limited, request allowance used up)" and got["openalex", "doi:1"] == "HTTP 429 (rate limited)" and got["openalex", "doi:2"] is None


def test_verdicts(entries, results, title_hits):
    got = {r.key: r for r in R.report_rows(R.verify(entries, results, title_hits)).collect()}
    assert {k: r.status for k, r in got.items()} == {
        "match": "MATCH", "minor": "MISMATCH_MINOR", "major": "MISMATCH_MAJOR", "other": "NOT_FOUND_IN_ENABLED_SOURCES", "error": "SOURCE_ERROR", "retry": "MATCH", "gone": "NOT_FOUND_IN_ENABLED_SOURCES",
        "arx": "MATCH", "title": "MATCH", "lost": "NOT_FOUND_IN_ENABLED_SOURCES", "bare": "NOT_CHECKED",
    }
    assert got["match"].compared_with == "crossref (doi)" and len(got["match"].lookups) == 1 and got["match"].public_url == "https://doi.org/10.1/match"
    assert got["minor"].differences == "year [crossref, minor]: bib '2020' vs source '2021'"
    assert got["error"].reason == "crossref: HTTP 503 (server error)" and got["other"].reason.startswith("crossref: doi mismatch · openalex: not found")
    assert got["title"].compared_with == "openalex (title)" and got["bare"].reason == "no applicable source"


def test_status_counts(entries, results, title_hits):
    v = R.verify(entries, results, title_hits)
    assert {r.status: r.n for r in R.status_counts(v).collect()} == {"MATCH": 4, "MISMATCH_MINOR": 1, "MISMATCH_MAJOR": 1, "NOT_FOUND_IN_ENABLED_SOURCES": 3, "SOURCE_ERROR": 1, "NOT_CHECKED": 1}
    assert [r.no_source for r in R.no_source_answered(v).collect()] == [False]


def stored_row(doi, title, /, **more):
    raw = {"format": store.FORMAT, "source": "crossref", "matched_by": "doi", "doi": doi, "fetched_at": "2024-01-01T00:00:00+00:00", "fields": {"title": title, "year": "2020"}} | more
    return (doi, ABSTRACT, "crossref", "FOUND", "2024-01-01", json.dumps(raw))


@pytest.mark.parametrize("bad", [{"format": "x"}, {"source": "s2"}, {"matched_by": "title"}, {"doi": "11.1/a"}, {"doi": 5}, {"fetched_at": "2024-01-01T00:00:00"}, {"fetched_at": "soon"}, {"fields": []}, {"fields": {"year": 2020}}, {"fields": {"author_names": [1]}}])
def test_stored_metadata_defects(spark, bad):
    df = spark.createDataFrame([stored_row("10.1/a", "T"), stored_row("10.1/a", "T", **bad), ("10.1/a", None, "c", "FOUND", "t", "{no")], store.STORE)
    assert [r[0] is not None for r in df.select(store.decode_metadata(F.col("raw_json"), F.col("doi"))).collect()] == [True, False, False]


def test_store_settles_and_grows(spark, entries, results, title_hits):
    have = spark.createDataFrame([stored_row("10.1/major", "A study of fish"), stored_row("10.1/gone", "Another work")], store.STORE)
    got = {r.key: r for r in R.verify(entries, results, title_hits, have).collect()}
    assert (got["major"].status, got["major"].origin, got["major"].stored_source) == ("MATCH", "DB", "crossref") and got["gone"].status == "NOT_FOUND_IN_ENABLED_SOURCES"
    new = spark.createDataFrame([("10.1/new", "a", "p", "FOUND", "t", None, 2), ("10.1/new", "b", "p", "FOUND", "t", None, 1), ("10.1/gone", "c", "p", "FOUND", "t", None, 3)], store.STORE + ", ordinal long")
    assert [(r.doi, r.abstract) for r in store.add_new(have, new).collect()] == [("10.1/new", "b")]


@pytest.fixture(scope="module")
def claims(spark):
    keys = ["match", "gone", "match", "arx", "title", "nokey", "bare", "major", "error"]
    return spark.createDataFrame([(1, i + 1, f"Sentence {i}.", k, "cite", "") for i, k in enumerate(keys)], "doc_id long, claim_index int, sentence string, cite_key string, command string, context_before string")


def test_evidence(spark, claims, entries, results, title_hits):
    own = E.works(claims, entries)
    have = spark.createDataFrame([stored_row("10.1/match", "A study of many things"), stored_row("10.1/gone", "Another work entirely")], store.STORE)
    got = {r.key: r for r in E.find(own, results, title_hits, have).collect()}
    assert (got["match"].lookup_status, got["match"].origin, got["match"].source) == ("found", "DB", "crossref")
    assert (got["gone"].source, got["gone"].reason, got["gone"].match) == ("s2", E.STORED_MISMATCH, "doi")
    assert (got["arx"].source, got["arx"].match, got["arx"].resolved_doi) == ("arxiv", "arxiv_id", "10.48550/arxiv.2401.01234")
    assert (got["title"].source, got["title"].match) == ("openalex", "title")
    assert (got["nokey"].lookup_status, got["nokey"].reason) == ("absent", "no bibliography entry for this key")
    assert got["bare"].reason == "no DOI, arXiv identifier or title"
    assert got["major"].lookup_status == "source_error" and "crossref: record title does not match the entry" not in (got["major"].reason or "")
    assert got["error"].lookup_status == "source_error" and got["error"].reason.startswith("crossref: HTTP 503 (server error)")
    rows = {r.doi: r for r in E.new_store_rows(E.find(own, results, title_hits), own, results, "2024-05-05T00:00:00+00:00").collect()}
    assert set(rows) == {"10.1/match", "10.1/gone"} and json.loads(rows["10.1/match"].raw_json)["source"] == "crossref" and rows["10.1/gone"].raw_json is None


def test_judging(spark, claims, entries, results, title_hits):
    withe = J.with_evidence(claims, E.find(E.works(claims, entries), results, title_hits))
    withe = Tables(spark, "test").keep(withe)
    good = json.dumps({"verdict": "SUPPORTED", "evidence_quote": "long enough to be used", "rationale": "r"})
    wrong = json.dumps({"verdict": "SUPPORTED", "evidence_quote": "not in the abstract", "rationale": "r"})
    replies = spark.createDataFrame([(1, 1, 1, good, None, False), (1, 3, 1, "no json", None, False), (1, 3, 2, wrong, None, False), (1, 2, 1, "no", None, False), (1, 4, 1, None, "HTTP 429", False)], "doc_id long, claim_index int, attempt int, reply string, transport_error string, fatal boolean")
    got = {r.claim_index: r for r in J.judge(withe, replies).collect()}
    assert (got[1].verdict, got[1].evidence_quote) == ("SUPPORTED", "long enough to be used")
    assert got[3].verdict == "UNVERIFIABLE" and got[3].rationale.startswith("Downgraded") and got[2].rationale == "model output invalid"
    assert got[4].rationale == "Not judged: HTTP 429" and got[6].rationale.startswith("No usable abstract") and len(got) == 9
    assert J.failure_message(withe, replies).first().failure.startswith("the model request failed for 1 claim")
    stop = replies.limit(0).unionAll(spark.createDataFrame([(1, 1, 1, None, "down", True)], replies.schema))
    assert all(r.rationale == "Not judged: down" for r in J.judge(withe, stop).filter("abstract is not null").collect())
    first, third = (r.prompt for r in J.prompts(withe).filter("claim_index in (1, 3)").orderBy("claim_index").collect())
    at = first.index("CLAIM TO CHECK")
    assert first[:at] == third[:at] and first != third
    counts = {(r.kind, r.value): r.n for r in J.summary(J.judge(withe, replies)).collect()}
    assert counts["verdict", "SUPPORTED"] == 1 and sum(n for (k, _), n in counts.items() if k == "lookup_status") == 9


def test_registry(spark):
    reg = records.registry(spark)
    assert records.select_sources(reg) == ["arxiv", "crossref", "openalex", "datacite", "s2", "core", "europepmc"]
    assert records.select_sources(records.registry(spark, {"SPRINGER_API_KEY": "k"}), ["springer", "arxiv"]) == ["arxiv", "springer"]
    assert [r.required_env for r in records.missing_variables(reg).collect()] == ["SPRINGER_API_KEY"]
    for names in (["nope"], ["springer"]):
        with pytest.raises(ValueError, match="source"):
            records.select_sources(reg, names)
