"""Language identification with a string kernel.

A text is the set of its character n-grams of orders 1 to 3 (blended spectrum,
presence only), each hashed to one of ``BINS`` bins. The kernel of two texts is
the size of the intersection over the geometric mean of the sizes. Landmarks
give a Nyström map of the kernel, and kernel ridge regression, one language
versus the rest, is solved in it. The kernel is linear in the presence vector,
so landmarks, map and weights fold into one (bins x languages) matrix, and a
batch of texts is scored by one matrix product.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veriloom.llm.workspace import release, tidy

BINS = 1 << 16
ORDERS = 3
#: At most so many labelled texts a language are learned from, and so many in all, which languages share evenly; every language counts.
PER_LANGUAGE, SAMPLE_ROWS, LANDMARKS, RIDGE, SHARPNESS = 800, 51_200, 256, 1e-2, 5.0
_PIECE = 1 << 18
_ROWS = 32


def held_out(doc_id: Column) -> Column:
    """Whether a document is kept from learning: crc32 of its id as text, modulo 3, is 1. A null id: false."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def mark(text: str, row: np.ndarray) -> None:
    """Set the bins of all n-grams of the whole text in ``row``."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    for at in range(0, len(codes), _PIECE):
        c = codes[at : at + _PIECE + ORDERS - 1]
        h = c
        for n in range(1, ORDERS + 1):
            if n > 1:
                h = h[:-1] * np.uint32(0x01000193) + c[n - 1 :]
            if len(h):
                x = (h ^ np.uint32(n * 0x1BD1E995)) * np.uint32(0x9E3779B1)
                row[(x ^ (x >> np.uint32(15))) * np.uint32(0x85EBCA6B) >> np.uint32(16)] = 1


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


@dataclass
class Model:
    labels: list[str]
    weights: np.ndarray  # (BINS, languages + 1); the last column counts bins
    bias: np.ndarray

    def named(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        """Language and score of each text; ``und`` and 0 without a letter."""
        names, scores = ["und"] * len(texts), [0.0] * len(texts)
        at = [i for i, t in enumerate(texts) if has_letter(t)]
        if at:
            for i, name, s in zip(at, *self.scores([texts[i] for i in at]), strict=True):
                names[i], scores[i] = name, s
        return names, scores

    def scores(self, texts: list[str]) -> tuple[list[str], list[float]]:
        names, best = [], []
        x = np.zeros((_ROWS, BINS), dtype=np.float32)
        for at in range(0, len(texts), _ROWS):
            part = texts[at : at + _ROWS]
            x[:] = 0
            for row, t in zip(x, part, strict=False):
                mark(t, row)
            y = x[: len(part)] @ self.weights
            f = y[:, :-1] / np.sqrt(np.maximum(y[:, -1:], 1)) + self.bias
            p = np.exp(SHARPNESS * (f - f.max(axis=1, keepdims=True)))
            p /= p.sum(axis=1, keepdims=True)
            top = p.argmax(axis=1)
            names += [self.labels[i] for i in top]
            best += [float(v) for v in p[np.arange(len(part)), top]]
        return names, best


def solve(sets: list[np.ndarray], labels: list[str]) -> Model:
    """Nyström kernel ridge regression from the bins of each text and its label; rows in a fixed order."""
    names = sorted(set(labels))
    n = len(sets)
    size = np.array([max(len(s), 1) for s in sets], dtype=np.float64)
    m = min(max(LANDMARKS, len(names)), n)  # one of each language at least
    by = {c: [i for i in range(n) if labels[i] == c] for c in names}  # landmarks take turns among languages
    order = [by[c][k] for k in range(max(map(len, by.values()))) for c in names if k < len(by[c])]
    marks = np.array(order[:m])
    land = np.zeros((m, BINS), dtype=np.float32)
    for r, i in enumerate(marks):
        land[r, sets[i]] = 1
    land /= np.sqrt(size[marks])[:, None].astype(np.float32)
    k = np.stack([land[:, s].sum(axis=1) for s in sets]).astype(np.float64) / np.sqrt(size)[:, None]
    value, vector = np.linalg.eigh(k[marks])
    inverse_root = vector / np.sqrt(np.maximum(value, 1e-6)) @ vector.T
    z = k @ inverse_root
    y = np.array([[1.0 if x == c else -1.0 for c in names] for x in labels])
    weight = np.array([1.0 / len(by[x]) for x in labels]) * n / len(names)  # languages count alike
    centre, mean = (z * weight[:, None]).sum(0) / weight.sum(), (y * weight[:, None]).sum(0) / weight.sum()
    zc = (z - centre) * weight[:, None]
    b = np.linalg.solve(zc.T @ (z - centre) + RIDGE * n / m * np.eye(m), zc.T @ (y - mean))
    folded = land.T @ (inverse_root @ b).astype(np.float32)
    return Model(names, np.hstack([folded, np.ones((BINS, 1), dtype=np.float32)]).astype(np.float32), (mean - centre @ b).astype(np.float32))


def _bins(batches):
    for batch in batches:
        row, out = np.zeros(BINS, dtype=np.uint8), []
        for t in batch.column(2).to_pylist():
            row[:] = 0
            mark(t, row)
            out.append(np.flatnonzero(row).astype(np.uint16).tobytes())
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.binary())], names=["h", "lang", "bins"])


def fit(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = PER_LANGUAGE) -> Model | None:
    """Learn from documents with text, letters, a language and an id that isn't held out; None if there is none.

    All languages are learned. The sample of each is bounded: a hash of the id
    picks about ``per_language``, or an even share of ``SAMPLE_ROWS`` where
    that is less, and one at least. What reaches the driver is at most
    ``2 * BINS`` bytes a text.
    """
    own = docs.select(F.col(id_col).alias("doc_id"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"))
    own = own.filter(F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & ~held_out(F.col("doc_id")) & F.col("text").rlike(r"\p{L}"))
    counts = own.groupBy("lang").count().collect()
    if not counts:
        return None
    per_language = min(per_language, max(1, SAMPLE_ROWS // len(counts)))
    h = F.xxhash64(F.col("doc_id").cast("string")).alias("h")
    part = (F.pmod(F.xxhash64(F.lit("langid"), F.col("doc_id").cast("string")), F.lit(1_000_000)) / 1e6).alias("part")
    often = max(1.25 * per_language, per_language + 20.0)  # a small share may not come out as none
    rates = docs.sparkSession.createDataFrame(pa.table({"lang": [r["lang"] for r in counts], "rate": [min(1.0, often / r["count"]) for r in counts]}))  # from Arrow: a list would be read by Python workers of its own
    picked = own.join(F.broadcast(rates), "lang").filter(part < F.col("rate")).select(h, "lang", "text")
    rows = sorted(picked.mapInArrow(tidy(_bins, 500), "h long, lang string, bins binary").collect(), key=lambda r: (r["h"], r["lang"], bytes(r["bins"])))
    taken: dict[str, int] = {}
    sets, labels = [], []
    for r in rows:
        if taken.get(r["lang"], 0) < per_language:
            taken[r["lang"]] = taken.get(r["lang"], 0) + 1
            sets.append(np.frombuffer(bytes(r["bins"]), dtype=np.uint16).astype(np.int64))
            labels.append(r["lang"])
    return solve(sets, labels) if sets else None


def identify(docs: DataFrame, model: Model | None = None, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", keep: tuple[str, ...] = ()) -> DataFrame:
    """Predict the language of every whole text; one row per row, no shuffle.

    Returns ``doc_id``, the columns of ``keep``, ``held_out``, ``lang_pred``
    and ``score`` (0 to 1). ``lang_pred`` is a learned language; it is ``und``
    with score 0 for a null text, a text without a letter, or if there was
    nothing to learn from. Only the text is an input of a prediction. Rows with
    a null id are predicted and count as not held out; repeated rows and ties
    (first language by name) change nothing; other columns are ignored.
    """
    spark = docs.sparkSession
    if model is None:
        model = fit(docs, id_col=id_col, text_col=text_col, lang_col=lang_col)
    shared = spark.sparkContext.broadcast(model)  # BINS x (languages + 1) floats
    src = docs.select(F.col(id_col).alias("doc_id"), *[c for c in keep if c != id_col], held_out(F.col(id_col)).alias("held_out"), F.col(text_col).cast("string").alias("_text_in"))
    fields = src.schema.fields[:-1]

    def run(batches):
        m = shared.value
        for batch in batches:
            texts = batch.column(batch.num_columns - 1).to_pylist()
            names, scores = m.named(texts) if m is not None else (["und"] * len(texts), [0.0] * len(texts))
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(fields))), pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=[*(f.name for f in fields), "lang_pred", "score"])

    return src.mapInArrow(tidy(run, 500), ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields) + ", lang_pred string, score double")


def reject_unidentified(docs: DataFrame, least: float = 0.3) -> DataFrame:
    """``docs`` without texts of no language (``und``) or of a score under ``least``; columns stay.

    Only texts go to the Python workers and only the answer comes back; rows
    wait in the memory of the JVM, so that no text is held in Arrow twice.
    """
    model = fit(docs)
    if model is None:
        return docs.filter(F.col("text").rlike(r"\p{L}"))
    shared = docs.sparkSession.sparkContext.broadcast(model)  # BINS x (languages + 1) floats

    @F.arrow_udf("boolean")
    def identified(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        m = shared.value
        try:
            for own in columns:
                out: list[bool] = []
                for at in range(0, len(own), 500):
                    out += [name != "und" and score >= least for name, score in zip(*m.named(own.slice(at, 500).to_pylist()), strict=True)]
                yield pa.array(out, pa.bool_())
        finally:
            release()

    return docs.filter(identified(F.col("text").cast("string")))
