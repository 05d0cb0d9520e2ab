"""Reading LaTeX: comments, citations, paragraphs, sentences, claims, bibliography declarations."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Citation commands; commands with several groups; commands that stay with the sentence before them; environments
#: that are left out; headings; abbreviations that end no sentence.
CITE = "cite citep citet citealt citealp citeauthor citeyear citeyearpar citenum citetitle parencite textcite autocite smartcite supercite fullcite footcite footfullcite nocite".split()
MULTI_CITE = "cites parencites textcites autocites footcites smartcites supercites".split()
TRAILING_CITE = "cite citep parencite autocite footcite supercite smartcite citenum".split()
SKIPPED = "table figure equation align alignat gather multline eqnarray tabular tabularx longtable verbatim lstlisting displaymath math tikzpicture algorithm algorithmic".split()
HEADINGS = "part chapter section subsection subsubsection paragraph subparagraph".split()
ABBREVIATIONS = ("e.g", "i.e", "et al", "cf", "fig", "figs", "eq", "eqs", "sec", "vs", "etc", "no", "vol", "ch", "approx", "resp", "incl", "p", "pp", "dr", "prof", "st")

_MULTI, _SINGLE, _TRAILING, _LEFT_OUT, _TITLES = map(frozenset, (MULTI_CITE, CITE, TRAILING_CITE, SKIPPED, HEADINGS))
_LINE_END = re.compile("[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]")
_CLOSING, _OPENING = frozenset(")]'\"\u2019\u201d"), frozenset("(\\\"'`\u2018\u201c")
_TERMINATOR = re.compile("[.?!]")


# --- a small scanner: each function looks at one place of a text and says where it ends ---


def _past_space(text: str, at: int) -> int:
    while at < len(text) and text[at].isspace():
        at += 1
    return at


def _enclosed(text: str, at: int, pair: str) -> tuple[str, int] | None:
    """(content, end) of a flat group such as ``[...]`` that starts here, after space."""
    at = _past_space(text, at)
    end = text.find(pair[1], at + 1) if text[at : at + 1] == pair[0] else -1
    return None if end < 0 else (text[at + 1 : end], end + 1)


def _past_options(text: str, at: int, most: int = 1 << 30) -> int:
    while most and (got := _enclosed(text, at, "[]")):
        at, most = got[1], most - 1
    return at


def _commands(text: str, at: int = 0) -> Iterator[tuple[str, int, int]]:
    """(name, start, end of the name) of every backslash with letters after it."""
    while (start := text.find("\\", at)) >= 0:
        end = start + 1
        while end < len(text) and text[end].isascii() and text[end].isalpha():
            end += 1
        if end > start + 1:
            yield text[start + 1 : end], start, end
        at = max(end, start + 1)


def _escaped(text: str, at: int) -> bool:
    """Whether an odd number of backslashes stands right before this place."""
    n = 0
    while n < at and text[at - n - 1] == "\\":
        n += 1
    return n % 2 == 1


def masked(text: str) -> str:
    """Comments replaced by as many spaces, so that every offset and line end stays."""
    out, at = [], 0
    while (sign := text.find("%", at)) >= 0:
        if _escaped(text, sign):
            out.append(text[at : sign + 1])
            at = sign + 1
        else:
            found = _LINE_END.search(text, sign)
            end = found.start() if found else len(text)
            out += [text[at:sign], " " * (end - sign)]
            at = end
    return "".join(out) + text[at:]


def _key_lists(text: str, name: str, at: int) -> tuple[list[str], int]:
    """Key lists of a citation command whose name ends here, and where it ends; no lists if it is none."""
    at += text[at : at + 1] == "*"
    if name in _MULTI:
        lists = []
        while group := _enclosed(text, _past_options(text, at, 2), "{}"):
            lists.append(group[0])
            at = group[1]
        return lists, at
    group = _enclosed(text, _past_options(text, at), "{}") if name in _SINGLE else None
    return ([group[0]], group[1]) if group else ([], at)


def citations(text: str) -> Iterator[tuple[str, list[str], int, int]]:
    """(command, keys, start, end) of every citation outside comments; keys with a macro parameter are left out."""
    plain, done = masked(text), 0
    for name, start, end in _commands(plain):
        if start < done:
            continue
        lists, upto = _key_lists(plain, name.lower(), end)
        if lists:
            done = upto
            keys = (k.strip() for one in lists for k in one.split(","))
            yield name.lower(), [k for k in keys if k and "#" not in k], start, upto


def _is_abbreviation(text: str) -> bool:
    """Whether the text, which ends with a full stop, ends with an abbreviation or an initial."""
    bare = text[:-1]
    low = bare.lower()
    for word in ABBREVIATIONS:
        rest = low[: -len(word)]
        if low.endswith(word) and not (rest and "a" <= rest[-1] <= "z"):
            return True
    return bool(bare) and "A" <= bare[-1] <= "Z" and (len(bare) == 1 or bare[-2].isspace() or bare[-2] in "(~")


def _opens(text: str, at: int) -> bool:
    """Whether space and then a letter or sign that can open a sentence stand here."""
    to = _past_space(text, at)
    return to > at and to < len(text) and (text[to] in _OPENING or text[to].isascii() and (text[to].isupper() or text[to].isdigit()))


def _trailing_ends(text: str, at: int) -> list[int]:
    """Where the sentence can end: here, and after each citation that follows directly."""
    ends = [at]
    while True:
        start = _past_space(text, at)
        name, _, after = next(_commands(text, start), ("", 0, 0)) if text[start : start + 1] == "\\" else ("", 0, 0)
        known = next((n for n in (name,) if n in _TRAILING), None)
        group = _enclosed(text, _past_options(text, after + (text[after : after + 1] == "*")), "{}") if known else None
        if not group:
            return ends
        at = group[1]
        ends.append(at)


def sentences(paragraph: str) -> list[str]:
    """Sentences of a paragraph; abbreviations and initials don't end one, and citations right after the end stay with it."""
    out, begin, at = [], 0, 0
    while stop := _TERMINATOR.search(paragraph, at):
        end = at = stop.end()
        while end < len(paragraph) and paragraph[end] in _CLOSING:
            end += 1
        cut = next((e for e in reversed(_trailing_ends(paragraph, end)) if _opens(paragraph, e)), None)
        if cut is not None:
            at = cut
            if stop[0] != "." or not _is_abbreviation(paragraph[begin : stop.end()]):
                out.append(paragraph[begin:cut])
                begin = cut
    return [s for s in (x.strip() for x in [*out, paragraph[begin:]]) if s]


def declared_bibliographies(text: str) -> list[str]:
    """Bibliography files in order of declaration, each once; the suffix is added where the command implies it."""
    plain, names = masked(text), {}
    for name, _, end in _commands(plain):
        if name in ("bibliography", "nobibliography"):
            group = _enclosed(plain, end, "{}")
            own = [n.strip() for n in group[0].split(",")] if group else []
            names.update((n if n.endswith(".bib") else n + ".bib", None) for n in own if n)
        elif name == "addbibresource":
            group = _enclosed(plain, _past_options(plain, end, 1), "{}")
            if group and group[0].strip():
                names[group[0].strip()] = None
    return list(names)


def embedded_keys(text: str) -> list[str]:
    plain = masked(text)
    groups = (_enclosed(plain, _past_options(plain, end, 1), "{}") for name, _, end in _commands(plain) if name == "bibitem")
    return sorted({g[0].strip() for g in groups if g and g[0]})


def include_directives(text: str) -> list[tuple[str, int, int]]:
    """(file name, start, end) of the include commands outside comments."""
    plain, out = masked(text), []
    for name, start, end in _commands(plain):
        group = _enclosed(plain, end, "{}") if name in ("input", "include") else None
        if group and group[0]:
            out.append((group[0].strip(), start, group[1]))
    return out


def _heading_end(text: str, at: int) -> int | None:
    """Where the braced title of a heading ends, which may hold groups but no groups within these."""
    at = _past_space(text, _past_options(text, at + (text[at : at + 1] == "*"), 1))
    depth = 0
    for i in range(at, len(text)):
        if text[i] == "{":
            depth += 1
        elif text[i] == "}":
            depth -= 1
        if depth == 0 or depth > 2:
            return i + 1 if depth == 0 and i > at else None
    return None


def _prose(body: str) -> str:
    """The text with what is no prose taken out: a gap of two line ends where paragraphs part, a space for a displayed formula."""
    out, at, gap = [], 0, "\n\n"

    def put(upto: int, by: str, end: int) -> None:
        nonlocal at
        out.extend((body[at:upto], by))
        at = end

    look = 0
    while True:
        slash, dollars = body.find("\\", look), body.find("$$", look)
        if dollars >= 0 and (slash < 0 or dollars < slash):
            close = body.find("$$", dollars + 2)
            if close < 0:
                look = dollars + 2
            else:
                put(dollars, " ", close + 2)
                look = at
            continue
        if slash < 0:
            return "".join(out) + body[at:]
        after = body[slash + 1 : slash + 2]
        if after == "\\":
            put(slash, gap, slash + 2)
        elif after == "[" and (close := body.find("\\]", slash)) >= 0:
            put(slash, " ", close + 2)
        elif after.isascii() and after.isalpha():
            name, _, end = next(_commands(body, slash))
            if name == "begin" and (group := _enclosed(body, end, "{}")) and body[end] == "{" and group[0].removesuffix("*") in _LEFT_OUT and (close := body.find("\\end{" + group[0] + "}", end)) >= 0:
                put(slash, gap, close + len(group[0]) + 6)
            elif name in ("item", "begin", "end"):
                end = _past_options(body, end, 1)
                group = _enclosed(body, end, "{}")
                put(slash, gap, group[1] if group and "{" not in group[0] else end)
            elif name == "par":
                put(slash, gap, end)
            elif name in _TITLES and (close := _heading_end(body, end)):
                put(slash, gap, close)
            else:
                look = end
                continue
        else:
            look = slash + 1
            continue
        look = at


def paragraph_list(body: str) -> list[str]:
    """Paragraphs of a document's body, white space single; skipped environments, headings, items and line breaks divide."""
    out, own = [], []
    for line in [*_prose(body).split("\n"), ""]:
        words = line.split()
        if words:
            own += words
        elif own:
            out.append(" ".join(own))
            own = []
    return out


def _mapped(f, kind: T.DataType):
    @F.pandas_udf(kind)
    def one(col: pd.Series) -> pd.Series:
        return pd.Series([f(x) if isinstance(x, str) else None for x in col], dtype=object)

    return one


_STRINGS = T.ArrayType(T.StringType())
CITATION = T.StructType([T.StructField("command", T.StringType()), T.StructField("keys", _STRINGS), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())])
mask_comments = _mapped(masked, T.StringType())
citation_list = _mapped(lambda t: [dict(zip(("command", "keys", "start", "end"), c, strict=True)) for c in citations(t)], T.ArrayType(CITATION))
split_sentences = _mapped(sentences, _STRINGS)
paragraphs = _mapped(paragraph_list, _STRINGS)
bibliography_files = _mapped(declared_bibliographies, _STRINGS)
embedded_bib_keys = _mapped(embedded_keys, _STRINGS)


def has_embedded_bibliography(text: Column) -> Column:
    return F.contains(mask_comments(text), F.lit("\\begin{thebibliography}"))


def document_body(text: Column) -> Column:
    """Between the first begin and the first end of the document after it; either may be missing."""
    begin, end = "\\begin{document}", "\\end{document}"
    rest = F.when(F.locate(begin, text) > 0, F.substring(text, F.locate(begin, text) + len(begin), F.length(text))).otherwise(text)
    return F.when(F.locate(end, rest) > 0, F.substring(rest, F.lit(1), F.locate(end, rest) - 1)).otherwise(rest)
