"""Personal data: candidates, boosted trees, calibrated thresholds.

Base spans (e-mail addresses, IP addresses, card numbers, phone numbers) follow
fixed grammars and always stay. High-recall generators also propose looser
forms: addresses spelled "name at host dot org", IP addresses with spaced or
bracketed dots, card numbers grouped by dots, phone numbers without a plus.
Each candidate is brought to its plain form; its format (validity of the plain
form, digits, groups, separators, brackets, endings) and its context (announcing
words before it, words that announce other numbers, letters around it) are
features of gradient-boosted trees. Candidates of all kinds that overlap are
settled by score in one sweep; none overlaps a base span.

The trees learn from planted examples, as no table labels loose forms: spans of
every kind, loosened at random, and near misses of the same look (prose with
"at" and "dot", numbered sections, check digits that fail, runs of figures), set
between words of the corpus. What an example is comes from how it was planted,
not from its features. A third is held out, and a kind's threshold is the lowest
score at which the held-out examples keep the wanted precision.

Finding and scoring is DataFrame expressions only; trees become nested CASE
expressions. Learning runs on the driver over a bounded number of examples.
"""

from __future__ import annotations

import math
import random
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")
#: Documents that give the words around examples (the first characters of each), examples of a kind, rounds of depth-three trees, wanted precision on the held-out third.
SAMPLE_DOCS, SAMPLE_CHARS, EXAMPLES, ROUNDS, DEPTH, SHRINK, PRECISION = 200, 400, 2400, 24, 3, 0.3, 0.92
MARGIN, CHUNK = 24, 128

_LOCAL, _HOST = "[A-Za-z0-9._%+-]", "[A-Za-z0-9-]"
#: Base grammars. A run is entered at its start only (or where the last match ended), and possessively, so long runs take
#: linear time; the matches are those of the plain grammars: the classes of neighbouring parts don't overlap.
BASE = {
    "email": rf"(?:(?<!{_LOCAL})|\G){_LOCAL}++@{_HOST}++(?:\.{_HOST}++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}+",
    "card": r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){11,18}+(?![ -]?[0-9])",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
#: Looser forms; what a base span covers is left out later.
LOOSE = {
    # "name at host" needs a spelled or bracketed dot: prose is full of "at the end. Then"
    "email": rf"(?i)(?<!{_LOCAL}){_LOCAL}{{1,64}}+ ?(?:(?:\[at\]|\(at\)|@) ?{_HOST}{{1,63}}+(?: ?(?:\[dot\]|\(dot\)|\bdot\b) ?{_HOST}{{1,63}}+|\.{_HOST}{{1,63}}+){{1,8}}+"
    rf"|\bat\b ?{_HOST}{{1,63}}+(?: ?(?:\[dot\]|\(dot\)|\bdot\b) ?{_HOST}{{1,63}}+){{1,8}}+)",
    "ip": r"(?<![0-9.])[0-9]{1,3}+(?: ?(?:\[\.\]|\(\.\)|\.) ?[0-9]{1,3}+){3}+(?![0-9])",
    "card": r"(?<![0-9])(?<![0-9][ ._-])[0-9]{4}(?:[ ._-]{1,2}[0-9]{4}){3}(?![0-9])",
    "phone": r"(?<![0-9+])(?<![0-9][ .-])(?:\(0?[0-9]{2,4}\)|00[0-9]{1,3}|0[0-9]{2,4}|[0-9]{3})(?:[ .-]?[0-9]{2,4}){2,4}+(?![0-9])",
}
#: Quick tests that a text can hold a match at all.
MAY = {
    "email": {"base": lambda t: F.contains(t, F.lit("@")), "loose": lambda t: t.rlike(r"(?i)@|[\[(]at[\])]|\bat\b.{1,64}\bdot\b")},
    "ip": {"base": lambda t: t.rlike(r"[0-9]\.[0-9]++\.[0-9]++\."), "loose": lambda t: t.rlike(r"[0-9] ?[\[(]?\.[\])]? ?[0-9]")},
    "card": {"base": lambda t: t.rlike("[0-9](?:[ -]?[0-9]){11}"), "loose": lambda t: t.rlike("[0-9]{4}[ ._-]{1,2}[0-9]{4}")},
    "phone": {"base": lambda t: F.contains(t, F.lit("+")), "loose": lambda t: t.rlike("[0-9]{2}")},
}
#: Words that announce each kind, words that announce something else, common last parts of host names.
CUES = {"email": "mail|contact|write", "ip": r"\bip\b|address|host|server|login", "card": "card|visa|credit|pay", "phone": r"phone|tel\b|call|mobile|fax|\bcell"}
OTHER = r"version|section|chapter|figure|page|order|serial|isbn|ref\b|total|about|from|years?\b|item|table|price|look|arrive|stop|meet"
ENDINGS = "com|org|net|edu|gov|io|info|eu|uk|de|fr|es|it|example|test"
FEATURES = ("valid", "digits", "length", "groups", "even_groups", "cue", "other", "letter_before", "letter_after", "bracket", "spaces", "first_zero", "ending", "marked_name", "small_parts")
_SPAN = "struct<s:int,e:int,m:string,b:string,a:string>"
_SCORED = "struct<s:int,e:int,k:int,p:double>"


def let(value: Column, f) -> Column:
    """``f`` of a value that is worked out once, however often ``f`` and the lambdas in it use it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def spans_of(text: Column, pattern: str) -> Column:
    """Array of (s, e, m, b, a) of all matches: start and end (exclusive) in code points, match, up to ``MARGIN`` characters before it and one after it.

    The pieces between matches give offsets and context, so time is linear in
    the text. Matches are laid out in chunks, as appending copies what is there.
    """

    def laid(x):
        got, pieces = x["got"], x["pieces"]
        both = F.arrays_zip(got.alias("m"), F.slice(pieces, 1, F.size(got)).alias("p"), F.slice(pieces, 2, F.size(got)).alias("q"))
        every = F.sequence(F.lit(0), F.floor(F.size(got) / CHUNK).cast("int"))

        def chunks(y):
            width = lambda a, z: a + F.length(z["p"]) + F.length(z["m"])
            sums = F.transform(y["chunks"], lambda c: F.aggregate(c, F.lit(0), width))
            step = lambda acc, z: let(acc["at"] + F.length(z["p"]), lambda s: F.struct((s + F.length(z["m"])).alias("at"), F.concat(acc["out"], F.array(F.struct(s.alias("s"), (s + F.length(z["m"])).alias("e"), z["m"].alias("m"), F.right(z["p"], F.lit(MARGIN)).alias("b"), F.left(z["q"], F.lit(1)).alias("a")))).alias("out")))
            empty = F.array().cast(f"array<{_SPAN}>")
            lay = lambda sums: F.flatten(F.transform(y["chunks"], lambda c, i: F.aggregate(c, F.struct(F.aggregate(F.slice(sums, 1, i), F.lit(0), lambda a, z: a + z).alias("at"), empty.alias("out")), step, lambda acc: acc["out"])))
            return let(sums, lay)

        return let(F.struct(let(both, lambda v: F.transform(every, lambda c: F.slice(v, c * CHUNK + 1, CHUNK))).alias("chunks")), chunks)

    return let(F.struct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("got"), F.split(text, pattern, -1).alias("pieces")), laid)


def digits_of(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether the check digit of a digit string holds: every second digit from the right is doubled, nines cast out."""
    ds = F.split(F.reverse(digits), "")
    value = F.transform(ds, lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise(d.cast("int") * 2 - F.when(d.cast("int") > 4, 9).otherwise(0)))
    return F.aggregate(value, F.lit(0), lambda a, d: a + F.coalesce(d, F.lit(0))) % 10 == 0


def valid(kind: str, plain: Column) -> Column:
    """Whether a plain form passes its kind's test."""
    digits = digits_of(plain)
    if kind == "ip":
        return F.forall(F.split(plain, r"\."), lambda p: F.regexp_replace(p, "^0+(?=.)", "").rlike("^(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$"))
    if kind == "card":
        return F.length(digits).between(12, 19) & luhn(digits)
    if kind == "phone":
        return F.length(digits).between(9, 15)
    return plain.rlike(rf"^{_LOCAL}+@{_HOST}+(\.{_HOST}+)+$")


def base_spans(text: Column, kind: str) -> Column:
    """Array of spans: matches of the base grammar that pass the kind's test."""
    none = F.array().cast(f"array<{_SPAN}>")
    found = spans_of(text, BASE[kind])
    if kind != "email":
        found = F.filter(found, lambda x: valid(kind, x["m"]))
    return F.when(MAY[kind]["base"](text), found).otherwise(none)


def plain_form(kind: str, match: Column) -> Column:
    if kind == "email":
        at = F.regexp_replace(match, r"(?i) ?(?:\[at\]|\(at\)|\bat\b|@) ?", "@")
        return F.regexp_replace(at, r"(?i) ?(?:\[dot\]|\(dot\)|\bdot\b|\.) ?", ".")
    if kind == "ip":
        return F.regexp_replace(match, r" ?(?:\[\.\]|\(\.\)|\.) ?", ".")
    return digits_of(match) if kind == "card" else match


def features(kind: str, c: Column) -> dict[str, Column]:
    """Format and context of a candidate (a span) as integers."""
    flag = lambda x: F.coalesce(x.cast("int"), F.lit(0))
    m, plain = c["m"], plain_form(kind, c["m"])
    groups = F.filter(F.split(plain, "[^0-9A-Za-z]+"), lambda g: g != "")
    return {
        "valid": flag(valid(kind, plain)),
        "digits": F.length(digits_of(plain)),
        "length": F.length(plain),
        "groups": F.size(groups),
        "even_groups": flag(F.size(F.array_distinct(F.transform(groups, lambda g: F.length(g)))) <= 1),
        "cue": flag(c["b"].rlike(f"(?i){CUES[kind]}")),
        "other": flag(c["b"].rlike(rf"(?i)\b(?:{OTHER})\W*$|\b(?:{OTHER})\W+\w*\W*$")),
        "letter_before": flag(c["b"].rlike(r"[\p{L}0-9]$")),
        "letter_after": flag(c["a"].rlike(r"^[\p{L}0-9]")),
        "bracket": flag(m.rlike(r"[\[(]")),
        "spaces": F.length(F.regexp_replace(m, "[^ ]", "")),
        "first_zero": flag(digits_of(plain).startswith("0")),
        "ending": flag(plain.rlike(rf"(?i)\.(?:{ENDINGS})$")),
        "marked_name": flag(plain.rlike("^[^@]*[0-9._+-]")),
        "small_parts": F.size(F.filter(groups, lambda g: F.length(g) <= 1)),
    }


def candidates(docs: DataFrame, kind: str) -> DataFrame:
    """``docs`` (id, text) with (s, e, features) of every proposal of the high-recall generator that is no base span."""
    found = F.explode(loose_spans(F.col("text"), kind)).alias("c")
    own = docs.select("id", found).filter(~(F.col("c.m").rlike(f"^(?:{BASE[kind]})$") & valid(kind, F.col("c.m"))))
    return own.select("id", "c.s", "c.e", *[x.alias(n) for n, x in features(kind, F.col("c")).items()])


def loose_spans(text: Column, kind: str) -> Column:
    """Array of spans: what the high-recall generator proposes."""
    none = F.array().cast(f"array<{_SPAN}>")
    return F.when(MAY[kind]["loose"](text), spans_of(text, LOOSE[kind])).otherwise(none)


@dataclass
class Booster:
    """Trees: a leaf, or (feature, cut, tree at most the cut, tree over it)."""

    start: float
    trees: list[tuple]
    threshold: float

    def raw(self, row: list[int]) -> float:
        def leaf(t):
            return t if isinstance(t, float) else leaf(t[2] if row[t[0]] <= t[1] else t[3])

        return self.start + sum(leaf(t) for t in self.trees)

    def score(self, row: dict[str, Column]) -> Column:
        """The probability, as an expression on the features."""

        def expr(t) -> Column:
            return F.lit(t) if isinstance(t, float) else F.when(row[FEATURES[t[0]]] <= t[1], expr(t[2])).otherwise(expr(t[3]))

        total = F.lit(self.start)
        for t in self.trees:
            total = total + expr(t)
        return 1 / (1 + F.exp(-total))


def boost(rows: list[list[int]], labels: list[int]) -> Booster:
    """Gradient boosting of the logistic loss; rows that look alike are counted, not repeated, so its cost is that of the different rows."""
    groups: dict[tuple[int, ...], list[int]] = {}
    for r, y in zip(rows, labels, strict=True):
        g = groups.setdefault(tuple(r), [0, 0])
        g[0] += 1
        g[1] += y
    keys = sorted(groups)
    n, pos = [groups[k][0] for k in keys], [groups[k][1] for k in keys]
    share = min(max(sum(pos) / sum(n), 0.01), 0.99)
    start = math.log(share / (1 - share))
    f = [start] * len(keys)

    def leaf(at, g, h):
        return SHRINK * sum(g[i] for i in at) / (sum(h[i] for i in at) + 1.0)

    def split(at, g, h):
        best = (1e-9, None, None)
        gs, hs = sum(g[i] for i in at), sum(h[i] for i in at) + 1.0
        for j in range(len(FEATURES)):
            values = sorted({keys[i][j] for i in at})
            for cut in values[:-1][:: max(1, len(values) // 16)]:
                left = [i for i in at if keys[i][j] <= cut]
                gl, hl = sum(g[i] for i in left), sum(h[i] for i in left) + 1.0
                gain = gl * gl / hl + (gs - gl) ** 2 / (hs - hl + 1.0) - gs * gs / hs
                if gain > best[0] + 1e-12:
                    best = (gain, j, cut)
        return best[1:]

    def tree(at, g, h, depth):
        j, cut = split(at, g, h) if depth else (None, None)
        if j is None:
            return float(leaf(at, g, h))
        return (j, cut, tree([i for i in at if keys[i][j] <= cut], g, h, depth - 1), tree([i for i in at if keys[i][j] > cut], g, h, depth - 1))

    trees = []
    for _ in range(ROUNDS):
        p = [1 / (1 + math.exp(-x)) for x in f]
        g, h = [pos[i] - n[i] * p[i] for i in range(len(keys))], [n[i] * p[i] * (1 - p[i]) for i in range(len(keys))]
        t = tree(list(range(len(keys))), g, h, DEPTH)
        trees.append(t)
        one = Booster(0.0, [t], 0.0)
        f = [x + one.raw(list(k)) for x, k in zip(f, keys, strict=True)]
    return Booster(start, trees, 0.5)


def calibrated(booster: Booster, rows: list[list[int]], labels: list[int]) -> Booster:
    """The booster with the lowest threshold at which rows it hasn't seen keep the wanted precision."""
    ranked = sorted(zip((booster.raw(r) for r in rows), labels, strict=True), reverse=True)
    threshold, right = 1.1, 0
    for at, (f, y) in enumerate(ranked):
        right += y
        if (at + 1 == len(ranked) or ranked[at + 1][0] < f) and right >= PRECISION * (at + 1):
            threshold = 1 / (1 + math.exp(-f))
    return Booster(booster.start, booster.trees, threshold - 1e-9)


def check_digit(digits: str) -> str:
    """The digit that makes a digit string pass :func:`luhn`."""
    total = sum(d if i % 2 else d * 2 - 9 * (d > 4) for i, d in enumerate(map(int, reversed(digits))))
    return str(-total % 10)


def planted(kind: str, words: list[str], n: int, seed: int) -> list[tuple[str, int, int, int]]:
    """(text, start, end, label) of ``n`` examples of a kind: loosened spans (1) and near misses (0) between words of a corpus."""
    rng = random.Random(f"{kind}{seed}")
    word = lambda: rng.choice(words)
    digits = lambda k: "".join(rng.choice("0123456789") for _ in range(k))
    told = {"email": ("mail", "e-mail:", "contact", "write to"), "ip": ("server", "host", "ip address", "login from"), "card": ("card", "credit card", "visa", "paid with"), "phone": ("phone", "call", "tel", "mobile:", "fax")}[kind]
    beside = {"email": ("look", "arrive", "stop", "meet"), "ip": ("version", "section", "chapter", "figure"), "card": ("order", "serial", "item", "ref"), "phone": ("total", "pages", "from", "table", "price", "about")}[kind]

    def span(label: int) -> str:
        if kind == "email":
            at, dot = rng.choice([(" at ", " dot "), (" (at) ", " (dot) "), ("[at]", "[dot]"), (" @ ", "."), (" [at] ", " dot ")]) if label else (" at ", " dot ")
            name = rng.choice([word() + rng.choice("._-") + word(), word() + digits(2), word()]) if label else rng.choice(["it", "me", word(), word()])
            return name + at + word() + (dot + word()) * (rng.random() < 0.2) + dot + (rng.choice(ENDINGS.split("|")) if rng.random() < (0.85 if label else 0.08) else word())
        if kind == "ip":
            sep = rng.choice([" . ", "[.]", "(.)", " [.] ", " (.) ", ". "])
            parts = [str(rng.randrange(256)) for _ in range(4)] if label else [str(rng.choice([rng.randrange(1, 10), rng.randrange(1, 10), rng.randrange(256, 1000)])) for _ in range(4)]
            return (sep if label else rng.choice([" . ", ". "])).join(parts)
        if kind == "card":
            body = rng.choice("3456") + digits(14)
            number = body + (check_digit(body) if label or rng.random() < 0.15 else str((int(check_digit(body)) + rng.randrange(1, 10)) % 10))
            return rng.choice([".", "_", "  ", ". ", " . "[:2]]).join(number[i : i + 4] for i in range(0, 16, 4))
        if label:
            sep = rng.choice([" ", "-", "."])
            return rng.choice([f"({digits(3)}){sep}{digits(3)}{sep}{digits(4)}", f"0{digits(3)}{sep}{digits(3)}{sep}{digits(4)}", f"00{digits(2)}{sep}{digits(3)}{sep}{digits(4)}{sep}{digits(2)}", f"{digits(3)}{sep}{digits(3)}{sep}{digits(4)}"])
        return rng.choice([f"{rng.randrange(100, 999)} {rng.randrange(1000, 2030)} {rng.randrange(100, 999)}", f"{rng.randrange(100, 999)} {digits(2)} {digits(3)} {digits(2)}", f"{rng.randrange(100, 999)}.{digits(3)}.{digits(3)}", f"{digits(3)}-{digits(2)}-{digits(2)}"])

    out = []
    for i in range(n):
        label = i % 2
        share = rng.random()
        if label:
            lead = rng.choice(told) if share < (0.85 if kind == "phone" else 0.7) else word()
        else:
            lead = rng.choice(beside) if share < 0.6 else rng.choice(told) if share < 0.64 else word()
        before = " ".join([*(word() for _ in range(6)), lead]) + " "
        own = span(label)
        out.append((before + own + " " + " ".join(word() for _ in range(6)), len(before), len(before) + len(own), label))
    return out


def fit(docs: DataFrame, examples: int = EXAMPLES) -> dict[str, Booster]:
    """A booster for each kind, from planted examples between words of at most ``SAMPLE_DOCS`` documents of ``docs`` (doc_id, text)."""
    h = F.xxhash64(F.lit("pii"), "doc_id", "text")
    rate = min(1.0, 4 * SAMPLE_DOCS / max(docs.count(), 1))  # so that no more rows reach the driver where there are more tasks
    some = docs.filter((F.pmod(h, F.lit(1_000_000_000)) / 1e9 < rate) & F.col("text").rlike("[A-Za-z]{3}")).select(h.alias("h"), F.left("text", F.lit(SAMPLE_CHARS)).alias("t"))
    some = some.orderBy("h", "t").limit(SAMPLE_DOCS).collect()
    words = sorted({w.lower() for r in some for w in r["t"].split() if w.isascii() and w.isalpha() and 2 < len(w) < 13}) or ["one", "two", "three"]
    spark, out = docs.sparkSession, {}
    for kind in KINDS:
        rows = planted(kind, words, examples, 3)
        texts = spark.createDataFrame([(i, r[0]) for i, r in enumerate(rows)], "id int, text string")
        parts: tuple[tuple[list, list], ...] = (([], []), ([], []))
        for r in candidates(texts, kind).collect():
            _, start, end, label = rows[r["id"]]
            if r["s"] < end and start < r["e"]:
                x, y = parts[r["id"] % 3 == 0]
                x.append([int(r[n]) for n in FEATURES])
                y.append(label)
        if parts[0][0] and 0 < sum(parts[0][1]):
            out[kind] = calibrated(boost(*parts[0]), *parts[1])
    return out


def _scored(kind: str, booster: Booster | None, found: Column) -> Column:
    """Array of (s, e, k, p): candidates at or over the kind's threshold."""
    none = F.array().cast(f"array<{_SCORED}>")
    if booster is None:
        return none
    number = F.lit(KINDS.index(kind)).alias("k")
    score = lambda c: let(F.struct(*[x.alias(n) for n, x in features(kind, c).items()]), lambda f: booster.score({n: f[n] for n in FEATURES}))
    scored = F.transform(found, lambda c: F.struct(c["s"].alias("s"), c["e"].alias("e"), number, score(c).alias("p")))
    return F.coalesce(F.filter(scored, lambda c: c["p"] >= booster.threshold), none)


def settled(items: Column) -> Column:
    """Of an array of (s, e, k, p) sorted by start those under p 1 that overlap none over 1 (base spans), and of overlapping neighbours the better one.

    One sweep; what is kept is laid out in chunks, as appending copies what is there.
    """
    empty = F.array().cast(f"array<{_SCORED}>")
    none = F.struct(F.lit(-1).alias("s"), F.lit(-1).alias("e"), F.lit(0).alias("k"), F.lit(-1.0).alias("p"))

    def step(acc, c):
        held, base = acc["held"], c["p"] > 1
        some, late = held["s"] >= 0, (c["p"] <= 1) & (c["s"] < acc["reach"])
        over = some & (held["e"] > c["s"])
        now = F.when(late, held).when(base, none).when(over & (held["p"] >= c["p"]), held).otherwise(c)
        out = F.concat(acc["out"], F.when(some & ~over & ~late, F.array(held)).otherwise(empty))
        return F.struct(now.alias("held"), F.when(base, F.greatest(acc["reach"], c["e"])).otherwise(acc["reach"]).alias("reach"), out.alias("out"))

    def chunk(acc, own):
        done = F.aggregate(own, F.struct(acc["held"].alias("held"), acc["reach"].alias("reach"), empty.alias("out")), step)
        return let(done, lambda d: F.struct(d["held"].alias("held"), d["reach"].alias("reach"), F.concat(acc["out"], F.array(d["out"])).alias("out")))

    start = F.struct(none.alias("held"), F.lit(0).alias("reach"), F.array().cast(f"array<array<{_SCORED}>>").alias("out"))
    last = lambda acc: F.concat(F.flatten(acc["out"]), F.when(acc["held"]["s"] >= 0, F.array(acc["held"])).otherwise(empty))
    cut = lambda v: F.transform(F.sequence(F.lit(0), F.floor(F.size(v) / CHUNK).cast("int")), lambda c: F.slice(v, c * CHUNK + 1, CHUNK))
    return F.aggregate(let(items, cut), start, chunk, last)


def _listed(spans: Column) -> Column:
    """kind:start:end of all (s, k, e), by start, then kind as listed, then end."""
    name = lambda k: F.element_at(F.array(*map(F.lit, KINDS)), k + 1)
    return F.array_join(F.transform(F.array_sort(spans), lambda x: F.concat_ws(":", name(x["k"]), x["s"].cast("string"), x["e"].cast("string"))), ",")


def find(docs: DataFrame, boosters: dict[str, Booster] | None = None, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Personal data in every whole text; one row per row, no shuffle.

    Returns ``doc_id``, ``n_email``, ``n_ip``, ``n_card``, ``n_phone`` and
    ``base_sha256`` of the base spans, and ``spans``: base spans and those the
    trees add, ``kind:start:end`` by start, then kind, comma-joined (offsets in
    code points, ends exclusive). Added spans overlap no base span of any kind
    and no other added one; of equal scores the earlier one stays.

    Null and empty texts have no spans. Rows with a null id, repeated rows and
    ties are treated like any other; other columns are ignored, whatever their
    names; texts may be of any length and hold any number of matches, in
    linear time. An empty table gives an empty result.
    """
    own = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    if boosters is None:
        boosters = fit(own)
    text = F.col("text")

    def numbered(i: int, kind: str) -> Column:
        return F.transform(base_spans(text, kind), lambda x: F.struct(x["s"].alias("s"), F.lit(i).alias("k"), x["e"].alias("e")))

    out = own.withColumns({f"_{k}": numbered(i, k) for i, k in enumerate(KINDS)})
    out = out.withColumns({f"_more_{k}": _scored(k, boosters.get(k), loose_spans(text, k)) for k in KINDS})
    base = F.concat(*[F.col(f"_{k}") for k in KINDS])
    weighed = F.transform(base, lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), x["k"].alias("k"), F.lit(2.0).alias("p")))
    added = settled(F.array_sort(F.concat(weighed, *[F.col(f"_more_{k}") for k in KINDS])))
    every = F.concat(base, F.transform(added, lambda x: F.struct(x["s"].alias("s"), x["k"].alias("k"), x["e"].alias("e"))))
    return out.select("doc_id", *[F.size(f"_{k}").cast("long").alias(f"n_{k}") for k in KINDS], F.sha2(_listed(base).cast("binary"), 256).alias("base_sha256"), _listed(every).alias("spans"))
