import hashlib
import html as unescaping
import random
import re

from pyspark.sql import functions as F

from tests.duck import assert_same
from veriloom.llm import warc


def test_pages_against_sql(spark):
    sf = "/root/testdata/sf0.01"
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    assert assert_same(warc.derive(warc.responses_from_pages(pages)), warc.oracle(), sf) == 2 * pages.count()


def test_links_digests_and_lengths(spark):
    html = '<html lang="en"><head><title>A &amp;\nB</title><script>var t="</p>";</script></head><body><!-- x --><p>One&nbsp;two</p><p>É <a href="/x">three</a><br>four</body></html>'
    out = {r.warc_type: r for r in warc.record_text(warc.derive(warc.responses_from_pages(spark.createDataFrame([(7, "http://a/", html)], "page_id int, url string, html string")))).collect()}
    c, m = out["conversion"], out["metadata"]
    assert c.block == "A & B\nOne two\nÉ three\nfour"
    assert c.refers_to == m.refers_to != c.record_id != m.record_id
    for r in (c, m):
        raw = r.block.encode()
        assert r.content_length == len(raw) and r.block_digest == "sha256:" + hashlib.sha256(raw).hexdigest()
        assert r.source_payload_digest == "sha256:" + hashlib.sha256(html.encode()).hexdigest()
        assert f"WARC-Refers-To: {r.refers_to}\r\n" in r.record and r.record.endswith(r.block + "\r\n\r\n")
    assert "source-header: HTTP/1.1 200 OK\r\n" in m.block and "outlink: /x\r\n" in m.block and "title: A & B\r\n" in m.block


def test_split_response(spark):
    df = spark.createDataFrame([("HTTP/1.1 200 OK\r\nA: b\r\n\r\nbody\r\n\r\nmore",), ("no end",), (None,)], "b string")
    head, body = warc.split_response(F.col("b"))
    assert [tuple(r) for r in df.select(head, body).collect()] == [("HTTP/1.1 200 OK\r\nA: b\r\n", "body\r\n\r\nmore"), ("no end", ""), (None, "")]


def test_edges(spark):
    rows = [(1, None, None), (None, "http://b/", "<p>x"), (2, "", ""), (2, "", ""), (3, "http://c/", "<p>" + "word <b>" * 100_000)]
    out = warc.derive(warc.responses_from_pages(spark.createDataFrame([(*r, "k") for r in rows], "page_id int, url string, html string, block string"))).collect()
    assert len(out) == 10 and all(r.refers_to and r.block_digest for r in out)
    raw = spark.createDataFrame([(None, None, None, None, None, 5)], "record_id string, target_uri string, warc_date string, http_head string, payload string, key int")
    assert [(r.key, r.refers_to, r.block) for r in warc.derive(raw).collect()][1] == (5, None, "")
    assert warc.derive(raw.limit(0)).count() == 0


def test_character_references(spark):
    html = "<title>a&nbsp;&#8212;&#x41;&eacute;&lt;b&gt;&#10;&bogus;</title><p>&copy; x &middot y &notin; &#128; &amp;lt; &#0;</p><a href='/q?a=1&amp;copy=2&copy=3&lt&#10;&sect;&x;'>z</a>"
    m, c = sorted(warc.derive(warc.responses_from_pages(spark.createDataFrame([(1, None, html)], "page_id int, url string, html string"))).collect(), key=lambda r: r.warc_type, reverse=True)
    assert "title: a \u2014A\u00e9<b> &bogus;\r\n" in m.block and "outlink: /q?a=1&copy=2&copy=3<\u00a7&x;\r\n" in m.block
    assert c.block == "a \u2014A\u00e9<b>\n&bogus;\n\u00a9 x \u00b7 y \u2209 \u20ac &lt; \ufffd\nz"


def test_digests_of_the_source_stay(spark):
    schema = "record_id string, target_uri string, warc_date string, http_head string, payload string, block_digest string, payload_digest string, Block int, _text int, `a.b` int"
    out = warc.derive(spark.createDataFrame([("<r>", "u", "d", "H\r\n", "x", "sha1:AB", "md5:cd", 1, 2, 3), ("<q>", "u", "d", "H\r\n", "x", None, None, 4, 5, 6)], schema))
    assert out.columns == ["_Block", "_text", "a.b", *warc.OUTPUT]
    rows = {(r.refers_to, r.warc_type): r for r in out.collect()}
    r, q = rows["<r>", "metadata"], rows["<q>", "conversion"]
    assert (r._Block, r._text, r["a.b"], r.source_block_digest, r.source_payload_digest) == (1, 2, 3, "sha1:AB", "md5:cd") and "source-payload-digest: md5:cd\r\n" in r.block
    assert q.source_payload_digest == "sha256:" + hashlib.sha256(b"x").hexdigest() and q.source_block_digest == "sha256:" + hashlib.sha256(b"H\r\n\r\nx").hexdigest()


def test_white_space_is_collapsed_as_the_patterns_do_without_a_pass_for_each(spark):
    rng = random.Random(5)
    parts = [" ", "  ", "\n", "\r", "\r\n", "\t", "\f", "\v", "\u00a0", "&nbsp;", "&#13;", "&#10;", "&am", "p;", "&", "a", "b\u2003", "\x85", "\x1c", "<br>", "<\nb>", "<b\n\nc='d'>"]
    pages = [(i, "".join(rng.choices(parts, k=rng.randrange(30)))) for i in range(1500)]

    def expected(t):
        t = re.sub(r"[\r\n]+", " ", t)
        t = re.sub(warc.TAGS, "", re.sub(warc.BREAKS, "\n", t))
        t = unescaping.unescape(t).replace("\u00a0", " ")
        return re.sub(warc.LINE_ENDS, "\n", re.sub(warc.SPACES, " ", t)).strip(" \n")

    out = spark.createDataFrame(pages, "i int, html string").select("i", warc.page_text(F.col("html")).alias("text"))
    assert {r.i: r.text for r in out.collect()} == {i: expected(t) for i, t in pages}
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_replace") == len(warc.HIDDEN) + 2 and "translate" not in plan
