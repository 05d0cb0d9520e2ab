"""DOI and arXiv identifiers, links and redaction: expressions on columns."""

from __future__ import annotations

from urllib.parse import quote

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Resolver and scheme prefixes that name the same DOI; they may be stacked. A bare "dx.doi.org/" is none of them.
DOI_PREFIX = r"^(?:(?:https?://(?:dx\.)?doi\.org/|doi\.org/|doi:)\s*)+"
ARXIV_DOI = "10.48550/arxiv."


def nonempty(c: Column) -> Column:
    """Null for an empty string."""
    return F.nullif(c, F.lit(""))


def normalize_doi(doi: Column) -> Column:
    """Lower-case DOI without prefixes, surrounding space or trailing slashes; null if nothing is left."""
    text = F.regexp_replace(F.lower(F.regexp_replace(doi, r"(?U)^\s+|\s+$", "")), DOI_PREFIX, "")
    return nonempty(F.regexp_replace(text, r"/+$", ""))


def normalize_arxiv_id(value: Column) -> Column:
    """Lower-case arXiv identifier without prefix, version or subject class; null if it is none."""
    text = F.regexp_replace(F.lower(F.trim(value)), r"^(?:https?://arxiv\.org/abs/\s*)?(?:arxiv:\s*)?", "")
    new = nonempty(F.regexp_extract(text, r"^(\d{4}\.\d{4,5})(?:v\d+)?$", 1))
    old = r"^([a-z-]+)(?:\.[a-z-]+)?/(\d{7})(?:v\d+)?$"
    return F.coalesce(new, F.when(text.rlike(old), F.concat_ws("/", F.regexp_extract(text, old, 1), F.regexp_extract(text, old, 2))))


def arxiv_id_from_doi(doi: Column) -> Column:
    """The arXiv identifier that a DOI of the arXiv prefix names, else null."""
    own = normalize_doi(doi)
    return F.when(own.startswith(ARXIV_DOI), normalize_arxiv_id(F.substring(own, len(ARXIV_DOI) + 1, 10_000)))


def arxiv_doi(arxiv_id: Column) -> Column:
    """The DOI registered for an arXiv identifier, without its version."""
    own = F.regexp_replace(F.regexp_replace(F.lower(F.trim(arxiv_id)), r"^arxiv:\s*", ""), r"(?<=.)v\d+$", "")
    return F.when(own != "", F.concat(F.lit(ARXIV_DOI), own))


def doi_url(doi: Column) -> Column:
    return F.when(F.coalesce(doi, F.lit("")) != "", F.concat(F.lit("https://doi.org/"), doi))


def quote_doi(doi: Column) -> Column:
    """Percent-encoded for a path: slashes, colons and parentheses stay."""
    out = F.replace(F.url_encode(doi), F.lit("+"), F.lit("%20"))
    for code, letter in (("%2F", "/"), ("%3A", ":"), ("%28", "("), ("%29", ")"), ("%7E", "~")):
        out = F.replace(out, F.lit(code), F.lit(letter))
    return F.replace(out, F.lit("*"), F.lit("%2A"))


def redact(text: Column, secrets: tuple[str, ...] = ()) -> Column:
    """Without credentials: known secrets, user names in links, key parameters, authorisation headers, query strings.

    Redact before cutting, so that no part of a secret is left.
    """
    out = text
    for s in filter(None, secrets):
        for form in {s, quote(s, safe="")}:
            out = F.replace(out, F.lit(form), F.lit("***"))
    out = F.regexp_replace(out, r"""(?iU)\b([a-z][a-z0-9+.-]*://)[^/\s@'"<>]+@""", "$1***@")
    out = F.regexp_replace(out, r"""(?iU)\b([a-z0-9_-]*(?:key|token|secret|password|signature)[a-z0-9_-]*)=([^&\s'"()<>]+)""", "$1=***")
    out = F.regexp_replace(out, r"""(?iU)\b(authorization|proxy-authorization|x-[a-z0-9-]*(?:key|token))(['"]?\s*[:=]\s*['"]?)((?:(?:bearer|basic|token)\s+)?)([^\s'",}]+)""", "$1$2$3***")
    return F.regexp_replace(out, r"""(?U)\?[A-Za-z0-9_.\[\]-]+=[^\s'"()<>]*""", "?...")


def entry_doi(fields: Column) -> Column:
    """Normalised DOI of the fields of an entry."""
    return normalize_doi(F.translate(F.replace(fields["doi"], F.lit("\\_"), F.lit("_")), "{}", ""))


def entry_arxiv_id(fields: Column) -> Column:
    """arXiv identifier of an entry whose archive is arXiv."""
    archive = F.coalesce(nonempty(fields["archiveprefix"]), nonempty(fields["eprinttype"]))
    return F.when(F.lower(F.trim(archive)) == "arxiv", normalize_arxiv_id(fields["eprint"]))


def entry_year(fields: Column) -> Column:
    """First four digits of ``year``, else of ``date``, as an integer."""
    digits = lambda c: nonempty(F.regexp_extract(F.coalesce(c, F.lit("")), r"\d{4}", 0))
    return F.coalesce(digits(fields["year"]), digits(fields["date"])).cast("int")
