import random
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from veriloom.functions import identifiers as I
from veriloom.functions import latex as L
from veriloom.functions import similarity as S
from veriloom.functions import text as T
from veriloom.functions import verdicts as V


def values(spark, rows, expr, kind="string"):
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], f"i int, x {kind}")
    return [r[0] for r in df.orderBy("i").select(expr(F.col("x"))).collect()]


def test_normalize_doi(spark):
    rows = ["10.1/AB", " https://doi.org/10.1/ab/ ", "doi: 10.1/ab", "DOI:https://dx.doi.org/10.1/ab//", "dx.doi.org/10.1/ab", "", "doi:", None]
    assert values(spark, rows, I.normalize_doi) == ["10.1/ab"] * 4 + ["dx.doi.org/10.1/ab", None, None, None]


def test_arxiv_ids(spark):
    rows = ["2401.01234v2", "arXiv:2401.01234", "https://arxiv.org/abs/hep-th/9901001v1", "math.GT/0309136", "nonsense", None]
    assert values(spark, rows, I.normalize_arxiv_id) == ["2401.01234", "2401.01234", "hep-th/9901001", "math/0309136", None, None]
    assert values(spark, ["10.48550/arXiv.2401.01234v3", "10.1/x"], I.arxiv_id_from_doi) == ["2401.01234", None]
    assert values(spark, ["arXiv:2401.01234v2"], I.arxiv_doi) == ["10.48550/arxiv.2401.01234"]
    assert values(spark, ["10.1/a b(c):d;e"], I.quote_doi) == ["10.1/a%20b(c):d%3Be"]


def test_redact(spark):
    rows = ["GET https://u:p@h/x?api_key=abc&q=1 failed", "Authorization: Bearer t0k", "token=abc, secret s3", "x-api-key: k"]
    assert values(spark, rows, lambda c: I.redact(c, ("s3",))) == ["GET https://***@h/x?... failed", "Authorization: Bearer ***", "token=*** secret ***", "x-api-key: ***"]


def test_clean_text_and_usable(spark):
    rows = ["<jats:p>One</jats:p><jats:p>two &lt;b&gt;bold&lt;/b&gt;</jats:p>", "e\u0301 \ufb01 so\u00adft\u00a0x", None, "1 < 2 and 3 > 2"]
    assert values(spark, rows, T.clean_text) == ["One two bold", "é fi soft x", "", "1 < 2 and 3 > 2"]
    assert values(spark, ["x" * 49, "x" * 50, "y" * 7000, "y" * 7001], lambda c: T.usable_abstract(c).isNotNull()) == [False, True, True, False]


@pytest.mark.parametrize(
    ("quote", "abstract", "found"),
    [("“The result holds.”", "We show the result holds here", True), ("two words", "two words here", False), ("we don’t know it", "We don't KNOW it at all", True), ("straße ist lang", "Die STRASSE IST LANG", True), ("not in there at", "something else", False), (None, "x", False)],
)
def test_quote(spark, quote, abstract, found):
    df = spark.createDataFrame([(quote, abstract)], "q string, a string")
    assert df.select(T.quote_in_abstract("q", "a")).first()[0] is found


def test_latex_text(spark):
    assert values(spark, [r"{\"O}zg\"ur \& Sm{\o}rg{\aa}s --- \emph{x}~y", None], T.plain_latex) == ["Özgür & Smørgås — x y", ""]
    rows = [r"{\'E}t{\'e} \v{c} {A}bc \o x"]
    assert values(spark, rows, T.clean_latex) == [T.simple_latex(rows[0])]
    assert T.folded("<i>Été</i> {X}-“y’s”–z\u2010") == "ete x“y’s”z\u2010"


def test_strip_comments(spark):
    rows = ["a % b\r\nc \\% d % e\n% only\nend", "x\\\\% y"]
    assert values(spark, rows, T.strip_comments)[0].replace("\r", "") == "a \nc \\% d \n\nend"
    assert values(spark, rows, T.strip_comments)[1] == "x\\\\"


def test_mask_keeps_offsets():
    rng = random.Random(1)
    for _ in range(500):
        t = "".join(rng.choice("ab%\\\n\r {}") for _ in range(40))
        m = L.masked(t)
        assert len(m) == len(t) and all(a == b or b == " " for a, b in zip(t, m, strict=True))
        assert [c for c in m if c in "\n"] == [c for c in t if c == "\n"]
        assert L.masked(m) == m


def test_citations():
    t = r"\cite[see][p. 2]{a, b} \Citep*{c}% \cite{no}" + "\n" + r"50\% \parencites[x]{d}[y][z]{e,f} \nocite{*} \cite{#1} \footcite {g}"
    assert [(c, k) for c, k, *_ in L.citations(t)] == [("cite", ["a", "b"]), ("citep", ["c"]), ("parencites", ["d", "e", "f"]), ("nocite", ["*"]), ("cite", []), ("footcite", ["g"])]
    assert all(t[s] == "\\" and t[e - 1] == "}" for *_, s, e in L.citations(t))


def test_sentences():
    text = r"As shown by Smith et al. in Fig. 2, it holds.\cite{a} J. Doe disagrees (see Sec. 3). Is it so? Yes! e.g. This. 5 more."
    assert L.sentences(text) == [r"As shown by Smith et al. in Fig. 2, it holds.\cite{a}", "J. Doe disagrees (see Sec. 3).", "Is it so?", "Yes! e.g. This.", "5 more."]


def test_bibliographies():
    t = "\\bibliography{a, b.bib}\n% \\bibliography{no}\n\\addbibresource[x]{c.bib}\\bibliography{a}"
    assert L.declared_bibliographies(t) == ["a.bib", "b.bib", "c.bib"]
    assert L.embedded_keys("\\bibitem[X]{k1}\n%\\bibitem{k2}\n\\bibitem {k3}") == ["k1", "k3"]


def test_ratio_is_the_library_s():
    rng = random.Random(2)
    for _ in range(50):
        a, b = ("".join(rng.choice("abc ") for _ in range(rng.randrange(300))) for _ in range(2))
        assert S.ratio(a, b) == SequenceMatcher(None, a, b).ratio()


@pytest.mark.parametrize(
    ("a", "b", "same"),
    [
        ("Deep nets", "Deep nets: a survey", True), ("Deep nets", "Deep nets a survey", False), ("Deep nets for learning", "Deep nets for learning-based control", False), ("Deep nets (long version)", "Deep nets", True),
        ("Ein sehr langer Haupttitel mit vielen Worten: erster Teil", "Ein sehr langer Haupttitel mit vielen Worten: zweiter", True), ("Short: one", "Short: two", False), ("", "x", False), ("{\\'E}tude", "Etude", True), ("A - B", "A", True),
    ],
)
def test_titles(a, b, same):
    assert S.same_title(a, b) is same is S.same_title(b, a)


@pytest.mark.parametrize(("a", "b", "short"), [("J. Financ. Econ.", "Journal of Financial Economics", True), ("Nature", "Science", False), ("Proc. Conf.", "Proceedings of the Conference", True), ("Phys. Rev. Letters", "Physical Review Lett.", False)])
def test_journal_abbreviations(a, b, short):
    assert S.journal_abbreviated(a, b) is short


def test_authors():
    assert S.bib_surnames("van Eck, Nees and {{The Group}} and The Team and Ada Lovelace") == ["van Eck", "Lovelace"]
    assert S.authors_match("van Eck, N. and Lovelace, A.", ["Eck, Nees", "Ada Lovelace"])
    assert S.authors_match("Pedregosa, F.", ["PedregosaFabian"]) and not S.authors_match("Pedregosa, F.", ["Somebody Else"])
    assert S.authors_match("", ["x"]) and S.authors_match("X, Y", [])


@pytest.mark.parametrize(
    ("field", "bib", "source", "match", "severity"),
    [
        ("year", "2020", "2021", False, "minor"), ("year", "2020", "2023", False, "major"), ("year", "MMXX", "2020", False, "major"), ("year", " 2020", "2020", True, None), ("volume", "3", "4", False, "major"),
        ("issue", "1--2", "1–2", True, None), ("issue", "1", "2", False, "minor"), ("pages", "10--20", "10", True, None), ("pages", "10-20", "11-20", False, "major"), ("journal", "J. Financ. Econ.", "Journal of Financial Economics", False, "minor"),
    ],
)
def test_field_checks(field, bib, source, match, severity):
    entry = {"issue": "number"}.get(field, field)
    (check,) = S.compare({entry: bib}, {field: source}, "crossref")
    assert (check[0], check[3], check[5]) == (field, match, severity)


def test_absent_fields_fall_back_empty_ones_do_not():
    assert [c[0] for c in S.compare({"editor": "Doe, J", "booktitle": "Nature"}, {"author_names": ["Doe, Jane"], "journal": "Nature"}, "x")] == ["author", "journal"]
    assert S.compare({"author": "", "editor": "Doe, J", "journal": "", "booktitle": "Nature"}, {"author_names": ["Doe, Jane"], "journal": "Nature"}, "x") == []


def test_replies(spark):
    good = '{"verdict": "PLAUSIBLE", "evidence_quote": "", "rationale": "r"}'
    rows = [good, f"```json\n{good}\n```", "no", '{"verdict": "MAYBE", "evidence_quote": "", "rationale": ""}', '{"verdict": "PLAUSIBLE", "evidence_quote": 1, "rationale": ""}', '{"verdict": "PLAUSIBLE", "evidence_quote": "", "rationale": "", "x": ""}', None]
    assert [v is not None for v in values(spark, rows, V.parse_reply)] == [True, True, False, False, False, False, False]


@pytest.mark.parametrize(
    ("verdict", "quote", "found", "want"),
    [
        ("SUPPORTED", "q", True, ("SUPPORTED", "q", "r")), ("SUPPORTED", " ", False, ("UNVERIFIABLE", "", "Downgraded from SUPPORTED because no evidence quote was given. Model rationale: r")),
        ("SUPPORTED", "q", False, ("UNVERIFIABLE", "", "Downgraded from SUPPORTED because the evidence quote was not found in the abstract. Model rationale: r")),
        ("PLAUSIBLE", "q", False, ("PLAUSIBLE", "", "r (The quoted passage was not found in the abstract and was removed.)")), ("PLAUSIBLE", "q", True, ("PLAUSIBLE", "q", "r")), ("SUSPICIOUS", "", False, ("SUSPICIOUS", "", "r")),
    ],
)
def test_quote_check(spark, verdict, quote, found, want):
    df = spark.createDataFrame([(verdict, quote, " r ", found)], "v string, q string, r string, f boolean")
    assert tuple(df.select(V.checked(*map(F.col, "vqrf"))).first()[0]) == want


def test_markdown_escapes(spark):
    assert values(spark, ["a|b <i> [x](y)! \\ \x01\n"], T.md) == ["a\\|b \\<i\\> \\[x\\](y)\\! \\\\  "]
    assert values(spark, ["", None, " x "], T.md_cell) == ["—", "—", "x"]
    assert values(spark, ["http://a/(b)|c", "javascript:x", None], lambda c: T.md_link(F.lit("l"), c)) == ["[l](http://a/%28b%29%7Cc)", "l (javascript:x)", "l"]
    assert values(spark, ["http://a/b", "ftp://x"], T.md_bare_link) == ["http://a/b", "ftp://x"]
