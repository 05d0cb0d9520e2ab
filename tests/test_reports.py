import json
import zipfile
from xml.etree import ElementTree

import pytest

from tests.test_engine import ABSTRACT, FILES, crossref
from veriloom import cli
from veriloom.operators import report
from veriloom.plans import verify
from veriloom.sources import records
from veriloom.streaming import watch


@pytest.fixture(scope="module")
def done(spark):
    files = [(i, p, m, t.replace("@misc{b, title={B}}", "@misc{b, title={B work}, doi={10.1/b}, year={2020}}")) for i, p, m, t in FILES]
    answers = [("crossref", "works", "doi:10.1/b", 1, 200, None, crossref("10.1/b", "B work", "2021"), None)]
    good = json.dumps({"verdict": "SUPPORTED", "evidence_quote": ABSTRACT[:40], "rationale": "a | b"})
    return verify.run(
        spark.createDataFrame(files, "doc_id long, path string, is_main boolean, text string"), spark.createDataFrame(answers, records.RESPONSES),
        spark.createDataFrame([(1, 2, 1, good, None, False)], "doc_id long, claim_index int, attempt int, reply string, transport_error string, fatal boolean"), generated="2024-01-01 00:00",
    )


def test_report_text(done):
    text = {r.doc_id: r.text for r in done.reports.collect()}
    one = text[1].splitlines()
    assert one[0] == "# Citation and bibliography report" and "- Input: main.tex" in one and "- Note: bibliography file not found: missing.bib" in one
    for line in ("| Cited but undefined | 7 |", "| MISMATCH_MINOR | 1 |", "**Status: INCONSISTENT**", "- `late`", "### SUPPORTED", "- Verdict: **SUPPORTED**", "- Rationale: a \\| b", "- year [crossref, minor]: bib `2020` vs source `2021`"):
        assert line in one, line
    assert [x for x in one if x.startswith("## ")] == ["## Summary", "## References", "## Claims"]
    assert one.index("### UNVERIFIABLE") < one.index("### SUPPORTED")
    assert "**Status: CONSISTENT**" in text[2] and "counts as cited" in text[2]


def test_exit_codes_and_store(done):
    assert {r.doc_id: r.exit_code for r in done.exit_codes.collect()} == {1: 1, 2: 0}
    (row,) = done.new_store_rows.collect()
    assert row.doi == "10.1/b" and row.abstract == ABSTRACT and json.loads(row.raw_json)["fields"]["title"] == "B work"


def test_workbook(tmp_path):
    report.write_xlsx(str(tmp_path / "r.xlsx"), [("tool", "x"), ("n", 3)], [{"key": "=1+1", "status": "MATCH"}], [{"index": 1, "verdict": "SUPPORTED", "sentence": "a <b> & \x01c"}])
    with zipfile.ZipFile(tmp_path / "r.xlsx") as z:
        sheets = [z.read(f"xl/worksheets/sheet{i}.xml").decode() for i in (1, 2, 3)]
        for name in z.namelist():
            ElementTree.fromstring(z.read(name))
    assert "<v>3</v>" in sheets[0] and "=1+1" in sheets[1] and "<f>" not in sheets[1] and 'state="frozen"' in sheets[1] and "a &lt;b&gt; &amp; c" in sheets[2] and 's="2"' in sheets[2]


def test_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for n in (1, 2):
        (tmp_path / "in" / f"d{n}.tex").write_text(f"It holds \\cite{{k{n}}}.", encoding="utf-8")
        q = watch.watch(watch.documents(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "cp"))
        q.awaitTermination(120)
    rows = spark.read.parquet(str(tmp_path / "out")).collect()
    assert sorted((r.doc_id, r.cite_key) for r in rows) == [("d1.tex", "k1"), ("d2.tex", "k2")]


def test_command_line(spark, tmp_path):
    d = tmp_path / "docs" / "p"
    d.mkdir(parents=True)
    (d / "main.tex").write_text("﻿\\documentclass{x}\\bibliography{r}\\begin{document}It holds \\cite{a,zz}.\\end{document}", encoding="utf-8")
    (d / "r.bib").write_text("@misc{a, title={T}}", encoding="utf-8")
    spark.createDataFrame([], records.RESPONSES).write.parquet(str(tmp_path / "responses"))
    assert cli.main([str(tmp_path / "docs"), "--responses", str(tmp_path / "responses"), "--output", str(tmp_path / "out")]) == 1
    assert "- `zz`" in spark.read.text(str(tmp_path / "out"), wholetext=True).first().value
    with pytest.raises(SystemExit) as e:
        cli.main([])
    assert e.value.code == 2
