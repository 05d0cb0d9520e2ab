"""WARC derivatives: from response records to metadata and conversion records.

Both derivatives refer to the response by its record id, target and date, and
carry its digests: those that the source states, and ``sha256:`` in lower-case
hex where it states none. The metadata record lists what is known about the page
and every header of the source; the conversion record is the page as plain text.
One pass, no shuffle; character references are decoded in Arrow batches, where
the white space of the text is collapsed too, all else is expressions on columns. Derived record ids are built from
the digest of the response's id and the kind of the derivative, so the same
input always gives the same records.
"""

from __future__ import annotations

import html as _html
import re
from html.entities import html5

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veriloom.llm.workspace import fresh

CRLF = "\r\n"
#: Elements whose start and end break a line.
BLOCK_TAGS = "address|article|aside|blockquote|br|caption|dd|div|dl|dt|fieldset|figcaption|figure|footer|form|h1|h2|h3|h4|h5|h6|header|hr|li|main|nav|ol|option|p|pre|section|table|td|th|title|tr|ul"
#: Patterns that mean the same to Spark and to SQL engines with linear-time expressions.
HIDDEN = (r"(?s)<!--.*?-->", r"(?is)<script\b[^>]*>.*?</script\s*>", r"(?is)<style\b[^>]*>.*?</style\s*>", r"(?is)<template\b[^>]*>.*?</template\s*>")
BREAKS = rf"(?i)</?(?:{BLOCK_TAGS})\b[^>]*>"
TAGS = r"</?[A-Za-z!?][^>]*>"
TITLE = r"(?is)<title[^>]*>([^<]*)</title"
LANGUAGE = r"(?is)<html\b[^>]*\blang=[\"']?([A-Za-z-]+)"
#: A character reference in an attribute; a name without semicolon counts only where no letter, digit or = follows.
REFERENCE = re.compile(r"&(?:#[xX][0-9a-fA-F]+;?|#[0-9]+;?|[A-Za-z][A-Za-z0-9]*(?:;|(?![A-Za-z0-9=])))")
LINKS = r"(?i)<a\b[^>]*\bhref=[\"']?([^\"'\s>]+)"
SPACES, LINE_ENDS = "[ \\t\\r\\f\\v]+", " ?\\n[ \\n]*"

#: Columns of :func:`derive` beside the keys.
OUTPUT = (
    "warc_type", "record_id", "refers_to", "refers_to_target_uri", "refers_to_date", "warc_date", "content_type", "source_headers",
    "source_block_digest", "source_payload_digest", "block", "content_length", "block_digest",
)


def _uuid(hex_digest: Column) -> Column:
    part = lambda at, n: F.substring(hex_digest, at, n)
    return F.concat(F.lit("<urn:uuid:"), part(1, 8), F.lit("-"), part(9, 4), F.lit("-5"), part(14, 3), F.lit("-8"), part(18, 3), F.lit("-"), part(21, 12), F.lit(">"))


def sha256(text: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(text.cast("binary"), 256))


def link(value: str) -> str:
    """An attribute with its character references decoded; tabs and line ends go, as in any URL."""
    value = REFERENCE.sub(lambda m: _html.unescape(m[0]) if m[0][1] == "#" else html5.get(m[0][1:], m[0]), value) if "&" in value else value
    return re.sub(r"[\t\r\n]+", "", value)


@F.pandas_udf(T.StringType())
def decoded(text: pd.Series) -> pd.Series:
    """Text with all named and numeric character references decoded."""
    return pd.Series([_html.unescape(t) if isinstance(t, str) else None for t in text], dtype=object)


def plain(text: str) -> str:
    """Text with character references decoded and white space collapsed: what ``SPACES`` and ``LINE_ENDS`` do, without a pass of expressions for each."""
    text = _html.unescape(text)
    for space in "\u00a0\t\r\f\v":
        text = text.replace(space, " ")
    while "  " in text:
        text = text.replace("  ", " ")
    return "\n".join([own for line in text.split("\n") if (own := line.strip(" "))])


@F.pandas_udf(T.StringType())
def plain_text(text: pd.Series) -> pd.Series:
    return pd.Series([plain(t) if isinstance(t, str) else None for t in text], dtype=object)


@F.pandas_udf(T.ArrayType(T.StringType()))
def decoded_links(links: pd.Series) -> pd.Series:
    return pd.Series([None if own is None else [link(x) for x in own] for own in links], dtype=object)


def page_text(html: Column) -> Column:
    """The visible text of a page: hidden parts dropped, block elements as line breaks, references decoded, white space (no-break spaces too) collapsed."""
    out = html
    for pattern in HIDDEN:
        out = F.regexp_replace(out, F.lit(pattern), F.lit(""))
    out = F.replace(F.replace(out, F.lit("\r"), F.lit(" ")), F.lit("\n"), F.lit(" "))  # runs of spaces become one below
    out = F.regexp_replace(out, F.lit(BREAKS), F.lit("\n"))
    return plain_text(F.regexp_replace(out, F.lit(TAGS), F.lit("")))


def responses_from_pages(pages: DataFrame, date: str = "2024-01-01T00:00:00Z", *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Response records of stored pages: ``page_id``, ``record_id``, ``target_uri``, ``warc_date``, ``http_head``, ``payload``.

    A null page counts as empty. The id of a record comes from page id, url and payload.
    """
    payload = F.coalesce(F.col(html_col).cast("string"), F.lit(""))
    head = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), F.octet_length(payload).cast("string"), F.lit(CRLF))
    key = F.concat_ws("\n", F.coalesce(F.col(id_col).cast("string"), F.lit("-")), F.coalesce(F.col(url_col).cast("string"), F.lit("-")), payload)
    return pages.select(
        F.col(id_col).alias("page_id"), _uuid(F.sha2(key.cast("binary"), 256)).alias("record_id"), F.col(url_col).cast("string").alias("target_uri"), F.lit(date).alias("warc_date"), head.alias("http_head"), payload.alias("payload")
    )


def split_response(block: Column) -> tuple[Column, Column]:
    """(head, payload) of the block of a response record: they meet at the first empty line."""
    at = F.locate(CRLF + CRLF, block)
    head = F.when(at > 0, F.substring(block, F.lit(1), at + 1)).otherwise(block)
    return head, F.when(at > 0, F.substring(block, at + 4, F.length(block))).otherwise(F.lit(""))


def derive(responses: DataFrame) -> DataFrame:
    """One metadata and one conversion record of each response.

    Input columns: ``record_id``, ``target_uri``, ``warc_date``, ``http_head``,
    ``payload`` (text), where the source states them ``block_digest`` and
    ``payload_digest`` (any algorithm, carried over as they are), and any key
    columns, which are kept. Output: the keys,
    ``warc_type``, ``record_id``, ``refers_to``, ``refers_to_target_uri``,
    ``refers_to_date``, ``warc_date``, ``content_type``, ``source_headers``,
    ``source_block_digest``, ``source_payload_digest``, ``block``,
    ``content_length`` (bytes), ``block_digest``.

    Null heads and payloads count as empty; a null target or date stays null
    and is left out of the metadata block; a null digest is computed from head
    and payload; a response without an id gets derivatives that refer to null,
    their own ids coming from its payload. Pages may be of any length.
    Repeated responses give repeated records. Empty tables give an empty
    result. A key column with the name of an output column gets underscores
    before its name.
    """
    fixed = ("record_id", "target_uri", "warc_date", "http_head", "payload", "block_digest", "payload_digest")
    names = [c for c in responses.columns if c not in fixed]
    keys = fresh([*OUTPUT, *(c for c in names if c.lower() not in OUTPUT)], *(c for c in names if c.lower() in OUTPUT))
    keys = dict(zip((c for c in names if c.lower() in OUTPUT), keys, strict=True))
    kept = F.struct(*[F.col(f"`{c}`").alias(keys.get(c, c)) for c in names], F.lit(0).alias("".join(fresh(names + list(keys.values()), "none"))))
    stated = lambda c: F.col(c).cast("string") if c in responses.columns else F.lit(None).cast("string")
    head, body = F.coalesce("http_head", F.lit("")), F.coalesce("payload", F.lit(""))
    own = responses.select(kept.alias("_keys"), "record_id", "target_uri", "warc_date", head.alias("_head"), body.alias("_body"), stated("block_digest").alias("_stated"), stated("payload_digest").alias("_stated_payload"))
    own = own.withColumns(
        {
            "_text": page_text(F.col("_body")),
            "_title": F.trim(F.regexp_replace(decoded(F.regexp_extract("_body", TITLE, 1)), "[ \\t\\r\\n\u00a0]+", " ")),
            "_lang": F.regexp_extract("_body", LANGUAGE, 1),
            "_links": decoded_links(F.regexp_extract_all("_body", F.lit(LINKS), F.lit(1))),
            "_own_digest": sha256(F.col("_body")),
            "_block_digest": F.coalesce("_stated", sha256(F.concat("_head", F.lit(CRLF), "_body"))),
        }
    ).withColumn("_payload_digest", F.coalesce("_stated_payload", "_own_digest"))
    field = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit(CRLF))
    optional = lambda name, value: F.when(F.coalesce(value, F.lit("")) != "", field(name, value)).otherwise(F.lit(""))
    lines = F.filter(F.split("_head", CRLF), lambda x: x != "")
    metadata = F.concat(
        optional("via", F.col("target_uri")),
        optional("title", F.col("_title")),
        optional("language", F.col("_lang")),
        field("source-payload-digest", F.col("_payload_digest")),
        F.array_join(F.transform(lines, lambda x: field("source-header", x)), ""),
        F.array_join(F.transform("_links", lambda x: field("outlink", x)), ""),
    )
    seed = F.coalesce("record_id", "_own_digest")
    kinds = F.array(
        F.struct(F.lit("metadata").alias("kind"), F.lit("application/warc-fields").alias("type"), metadata.alias("block")),
        F.struct(F.lit("conversion").alias("kind"), F.lit("text/plain; charset=utf-8").alias("type"), F.col("_text").alias("block")),
    )
    out = own.withColumn("_d", F.explode(kinds))
    return out.select(
        *[F.col(f"_keys.`{keys.get(c, c)}`") for c in names],
        F.col("_d.kind").alias("warc_type"),
        _uuid(F.sha2(F.concat(F.col("_d.kind"), F.lit(" of "), seed).cast("binary"), 256)).alias("record_id"),
        F.col("record_id").alias("refers_to"),
        F.col("target_uri").alias("refers_to_target_uri"),
        F.col("warc_date").alias("refers_to_date"),
        "warc_date",
        F.col("_d.type").alias("content_type"),
        F.col("_head").alias("source_headers"),
        F.col("_block_digest").alias("source_block_digest"),
        F.col("_payload_digest").alias("source_payload_digest"),
        F.col("_d.block").alias("block"),
        F.octet_length("_d.block").cast("long").alias("content_length"),
        sha256(F.col("_d.block")).alias("block_digest"),
    )


def record_text(derived: DataFrame) -> DataFrame:
    """Adds ``record``: the derivative as it stands in a WARC file, headers, block and two line ends."""
    line = lambda name, c: F.when(F.col(c).isNotNull(), F.concat(F.lit(f"{name}: "), F.col(c).cast("string"), F.lit(CRLF))).otherwise(F.lit(""))
    names = (
        ("WARC-Type", "warc_type"), ("WARC-Record-ID", "record_id"), ("WARC-Refers-To", "refers_to"), ("WARC-Refers-To-Target-URI", "refers_to_target_uri"), ("WARC-Refers-To-Date", "refers_to_date"),
        ("WARC-Target-URI", "refers_to_target_uri"), ("WARC-Date", "warc_date"), ("WARC-Block-Digest", "block_digest"), ("Content-Type", "content_type"), ("Content-Length", "content_length"),
    )
    return derived.withColumn("record", F.concat(F.lit(f"WARC/1.1{CRLF}"), *[line(n, c) for n, c in names], F.lit(CRLF), "block", F.lit(CRLF + CRLF)))


def oracle() -> str:
    """DuckDB SQL for :func:`derive` over :func:`responses_from_pages` of the table ``pages``."""
    q = lambda s: "'" + s.replace("'", "''") + "'"
    text = "html"
    for pattern in HIDDEN:
        text = f"regexp_replace({text}, {q(pattern)}, '', 'g')"
    text = f"regexp_replace({text}, '[\\r\\n]+', ' ', 'g')"
    text = f"regexp_replace(regexp_replace({text}, {q(BREAKS)}, chr(10), 'g'), {q(TAGS)}, '', 'g')"
    bare = "|".join(sorted((n for n in html5 if not n.endswith(";")), key=lambda n: (-len(n), n)))  # names that count without a semicolon, the longest first
    names = ", ".join(f"({q(n)}, {q(c)})" for n, c in html5.items())
    clean = "replace(t.v, chr(160), ' ')"
    clean = f"trim(regexp_replace(regexp_replace({clean}, {q(SPACES)}, ' ', 'g'), {q(LINE_ENDS)}, chr(10), 'g'), ' ' || chr(10))"
    uuid = lambda h: f"'<urn:uuid:' || substr({h},1,8) || '-' || substr({h},9,4) || '-5' || substr({h},14,3) || '-8' || substr({h},18,3) || '-' || substr({h},21,12) || '>'"
    crlf = "chr(13) || chr(10)"
    opt = lambda n, v: f"CASE WHEN coalesce({v}, '') <> '' THEN '{n}: ' || {v} || {crlf} ELSE '' END"
    fields = lambda n, v: f"array_to_string(list_transform({v}, lambda x: '{n}: ' || x || {crlf}), '')"
    return f"""
      WITH p AS (SELECT page_id, url, coalesce(html, '') AS html FROM pages),
      r AS MATERIALIZED (SELECT row_number() OVER () AS n, page_id, url, html, sha256(concat_ws(chr(10), coalesce(CAST(page_id AS VARCHAR), '-'), coalesce(url, '-'), html)) AS h,
        'HTTP/1.1 200 OK' || {crlf} || 'Content-Type: text/html; charset=utf-8' || {crlf} || 'Content-Length: ' || CAST(octet_length(encode(html)) AS VARCHAR) || {crlf} AS head FROM p),
      parts AS (SELECT n, 'text' AS k, 0 AS i, {text} AS v FROM r UNION ALL SELECT n, 'title', 0, regexp_extract(html, {q(TITLE)}, 1) FROM r
        UNION ALL SELECT n, 'link', unnest(range(len(l))), unnest(l) FROM (SELECT n, regexp_extract_all(html, {q(LINKS)}, 1) AS l FROM r)),
      pieces AS (SELECT n, k, i, unnest(range(len(a))) AS j, unnest(a) AS s FROM (SELECT n, k, i, string_split(v, '&') AS a FROM parts)),
      refs AS (SELECT *, CASE WHEN j > 0 THEN regexp_extract(s, '^(#[xX][0-9a-fA-F]+;?|#[0-9]+;?|[A-Za-z][A-Za-z0-9]*;)') ELSE '' END AS x,
        CASE WHEN j = 0 THEN '' WHEN k = 'link' THEN regexp_extract(s, '^({bare})(?:$|[^A-Za-z0-9=;])', 1) ELSE regexp_extract(s, '^({bare})') END AS y FROM pieces),
      names(name, c) AS (VALUES {names}),
      known AS (SELECT n, k, i, j, s, CASE WHEN x LIKE '#%' OR e.c IS NOT NULL THEN x ELSE y END AS x,
        CASE WHEN x LIKE '#x%' OR x LIKE '#X%' THEN chr(CAST('0x' || rtrim(x[3:], ';') AS INTEGER)) WHEN x LIKE '#%' THEN chr(CAST(rtrim(x[2:], ';') AS INTEGER)) ELSE coalesce(e.c, f.c) END AS c
        FROM refs LEFT JOIN names e ON e.name = x LEFT JOIN names f ON f.name = y),
      whole AS (SELECT n, k, i, string_agg(CASE WHEN j = 0 THEN s WHEN c IS NULL THEN '&' || s ELSE c || substr(s, len(x) + 1) END, '' ORDER BY j) AS v FROM known GROUP BY n, k, i),
      s AS (SELECT page_id, url, head, {uuid("h")} AS id, {clean} AS txt, 'sha256:' || sha256(html) AS pd, 'sha256:' || sha256(head || {crlf} || html) AS bd,
        trim(regexp_replace(i.v, '[ \\t\\r\\n' || chr(160) || ']+', ' ', 'g')) AS title, regexp_extract(html, {q(LANGUAGE)}, 1) AS lang, coalesce(l.links, []) AS links
        FROM r JOIN whole t ON t.n = r.n AND t.k = 'text' JOIN whole i ON i.n = r.n AND i.k = 'title'
        LEFT JOIN (SELECT n, list(regexp_replace(v, '[\\t\\r\\n]+', '', 'g') ORDER BY i) AS links FROM whole WHERE k = 'link' GROUP BY n) l ON l.n = r.n),
      d AS (
        SELECT *, 'metadata' AS kind, 'application/warc-fields' AS ct,
          {opt("via", "url")} || {opt("title", "title")} || {opt("language", "lang")} || 'source-payload-digest: ' || pd || {crlf}
          || {fields("source-header", f"list_filter(string_split(head, {crlf}), lambda x: x <> '')")} || {fields("outlink", "links")} AS block FROM s
        UNION ALL SELECT *, 'conversion', 'text/plain; charset=utf-8', txt FROM s),
      e AS (SELECT *, sha256(kind || ' of ' || id) AS g FROM d)
      SELECT page_id, kind AS warc_type, {uuid("g")} AS record_id, id AS refers_to, url AS refers_to_target_uri, '2024-01-01T00:00:00Z' AS refers_to_date,
        '2024-01-01T00:00:00Z' AS warc_date, ct AS content_type, head AS source_headers, bd AS source_block_digest, pd AS source_payload_digest,
        block, CAST(octet_length(encode(block)) AS BIGINT) AS content_length, 'sha256:' || sha256(block) AS block_digest
      FROM e
    """  # noqa: S608
