"""Quality classifier: a factorisation machine.

A text is a sparse vector of hashed words, bucketed structure statistics and
metadata. Every feature has a weight and a vector of ``RANK`` numbers; a pair
of features interacts by the product of their vectors. The score is linear in
the number of features, as

    sum over pairs <v_i, v_j> x_i x_j
        = 1/2 sum over ranks ((sum v_if x_i)**2 - sum v_if**2 x_i**2).
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veriloom.llm.langid import held_out
from veriloom.llm.shingles import documents_words
from veriloom.llm.workspace import tidy

WORD_BINS, BUCKETS, RANK = 1 << 16, 16, 8
#: At most about so many labelled rows are learned from.
SAMPLE, EPOCHS, RATE, DECAY = 6000, 8, 0.05, 1e-5
STATISTICS = ("upper", "digit", "punctuation", "bars", "spaces", "long_words", "line_length", "repeated_lines", "repeated_words", "length", "exclamations", "other_bytes")
#: Byte classes: 0 other ASCII, 1 lower, 2 upper, 3 digit, 4 white space, 5 punctuation, 6 bar, 7 exclamation mark, 8 beyond ASCII.
_CLASS = np.zeros(256, dtype=np.uint8)
_CLASS[33:127] = 5
_CLASS[97:123], _CLASS[65:91], _CLASS[48:58] = 1, 2, 3
_CLASS[[9, 10, 11, 12, 13, 32]], _CLASS[ord("|")], _CLASS[ord("!")], _CLASS[128:] = 4, 6, 7, 8


def _bucket(share: float) -> int:
    """16 buckets of a share between 0 and 1, finer near 0."""
    return min(BUCKETS - 1, int(np.sqrt(min(max(share, 0.0), 1.0)) * BUCKETS))


def features(text: str | None, words: np.ndarray, metadata: tuple = ()) -> tuple[np.ndarray, np.ndarray]:
    """(indexes, values) of a whole text; ``words`` are its word hashes; null counts as empty."""
    text = text or ""
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), dtype=np.uint8)
    n = max(len(raw), 1)
    count = np.bincount(_CLASS[raw], minlength=9)
    lines = [x for x in text.split("\n") if x]
    bins, times = np.unique((words >> np.uint64(48)).astype(np.int64), return_counts=True)
    letters = max(int(count[1] + count[2]), 1)
    shares = (
        count[2] / letters, count[3] / n, count[5] / n, count[6] / n * 10, count[4] / n, n / max(len(words), 1) / 40, np.log1p(n / max(len(lines), 1)) / 14,
        1 - len(set(lines)) / max(len(lines), 1), 1 - len(bins) / max(len(words), 1), np.log1p(len(raw)) / 20, count[7] / n * 10, count[8] / n,
    )
    at = [WORD_BINS + i * BUCKETS + _bucket(float(s)) for i, s in enumerate(shares)]
    base = WORD_BINS + len(shares) * BUCKETS
    for i, m in enumerate(metadata):  # a number's magnitude; missing has a bucket of its own
        at.append(base + i * BUCKETS + (0 if m is None else 1 + min(BUCKETS - 2, int(np.log2(1 + abs(float(m))) * 0.7))))
    total = max(float(np.sqrt((times.astype(np.float64) ** 2).sum())), 1.0)
    return np.concatenate((bins, np.array(at, dtype=np.int64))), np.concatenate((times / total, np.full(len(at), 0.5))).astype(np.float32)


@dataclass
class Machine:
    bias: float
    linear: np.ndarray
    factors: np.ndarray

    def raw(self, at: np.ndarray, x: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Scores of many texts laid end to end, and the sums of their factors; no text is without features."""
        vx = self.factors[at] * x[:, None]
        sums = np.add.reduceat(vx, starts, axis=0)
        squares = np.add.reduceat((vx * vx).sum(axis=1), starts)
        return self.bias + np.add.reduceat(self.linear[at] * x, starts) + 0.5 * ((sums * sums).sum(axis=1) - squares), sums

    def scores(self, rows: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        sizes = np.array([len(r[0]) for r in rows])
        raw, _ = self.raw(np.concatenate([r[0] for r in rows]), np.concatenate([r[1] for r in rows]), np.concatenate(([0], np.cumsum(sizes)[:-1])))
        return 1 / (1 + np.exp(-np.clip(raw.astype(np.float64), -30, 30)))


def train(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, n_features: int) -> Machine:
    """Logistic loss by AdaGrad on mini-batches; the order of rows and the seed fix the result."""
    rng = np.random.default_rng(11)
    share = float(np.clip(labels.mean(), 1e-3, 1 - 1e-3))
    m = Machine(float(np.log(share / (1 - share))), np.zeros(n_features, np.float32), rng.normal(0, 0.05, (n_features, RANK)).astype(np.float32))
    gl, gf = np.full(n_features, 1e-2, np.float32), np.full((n_features, RANK), 1e-2, np.float32)
    for _ in range(EPOCHS):
        order = rng.permutation(len(rows))
        for b in range(0, len(order), 64):
            part = order[b : b + 64]
            sizes = np.array([len(rows[i][0]) for i in part])
            at, x = np.concatenate([rows[i][0] for i in part]), np.concatenate([rows[i][1] for i in part])
            raw, sums = m.raw(at, x, np.concatenate(([0], np.cumsum(sizes)[:-1])))
            error = (1 / (1 + np.exp(-np.clip(raw, -30, 30))) - labels[part]).astype(np.float32) / np.float32(8)
            e = np.repeat(error, sizes)
            m.bias -= RATE * float(error.sum()) / 8
            uniq, back = np.unique(at, return_inverse=True)
            g1 = np.bincount(back, e * x, len(uniq)).astype(np.float32) + DECAY * m.linear[uniq]
            g2 = np.zeros((len(uniq), RANK), np.float32)
            np.add.at(g2, back, (e * x)[:, None] * (np.repeat(sums, sizes, axis=0) - m.factors[at] * x[:, None]))
            g2 += DECAY * m.factors[uniq]
            gl[uniq] += g1 * g1
            gf[uniq] += g2 * g2
            m.linear[uniq] -= RATE * 2 * g1 / np.sqrt(gl[uniq])
            m.factors[uniq] -= RATE * g2 / np.sqrt(gf[uniq])
    return m


def _size(metadata: tuple[str, ...]) -> int:
    return WORD_BINS + (len(STATISTICS) + len(metadata)) * BUCKETS


def _prepared(docs: DataFrame, id_col: str, text_col: str, metadata: tuple[str, ...]) -> DataFrame:
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"), *[F.col(c).cast("double").alias(f"_m{i}") for i, c in enumerate(metadata)])


def _of(batch) -> list[tuple[np.ndarray, np.ndarray]]:
    """Features of the rows of a batch: the text is column 1, metadata follow."""
    texts = batch.column(1).to_pylist()
    more = list(zip(*(batch.column(i).to_pylist() for i in range(2, batch.num_columns)), strict=True)) or [()] * len(texts)
    return [features(t, w, m) for t, w, m in zip(texts, documents_words(texts), more, strict=True)]


def fit(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", metadata: tuple[str, ...] = (), sample: int = SAMPLE) -> Machine | None:
    """Learn from labelled rows whose id isn't held out; None if there is none.

    A hash of the id picks about ``sample`` of them. What reaches the driver is
    the features of these texts, at most 12 bytes for each of ``WORD_BINS``.
    """
    own = labels.select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("_label")).filter(F.col("_id").isNotNull() & F.col("_label").isin(0, 1) & ~held_out(F.col("_id")))
    n = own.count()
    if not n:
        return None
    part = F.pmod(F.xxhash64(F.lit("quality"), F.col("_id").cast("string")), F.lit(1_000_000)) / 1e6
    picked = own.filter(part < min(1.0, sample / n)).distinct()  # about ``sample`` rows, so it may be broadcast
    texts = _prepared(docs, id_col, text_col, metadata).join(F.broadcast(picked), F.col("doc_id") == F.col("_id"))
    texts = texts.select("_label", "text", *[f"_m{i}" for i in range(len(metadata))], F.xxhash64(F.col("_id").cast("string")).alias("_h"))

    def run(batches):
        for batch in batches:
            rows = _of(pa.RecordBatch.from_arrays([batch.column(i) for i in range(batch.num_columns - 1)], names=batch.schema.names[:-1]))
            yield pa.RecordBatch.from_arrays(
                [batch.column(batch.num_columns - 1), batch.column(0), pa.array([r[0].tobytes() for r in rows], pa.binary()), pa.array([r[1].tobytes() for r in rows], pa.binary())], names=["h", "label", "at", "x"]
            )

    got = sorted(texts.mapInArrow(tidy(run, 500), "h long, label int, at binary, x binary").collect(), key=lambda r: (r["h"], r["label"], bytes(r["at"]), bytes(r["x"])))
    if not got:
        return None
    rows = [(np.frombuffer(bytes(r["at"]), np.int64), np.frombuffer(bytes(r["x"]), np.float32)) for r in got]
    return train(rows, np.array([r["label"] for r in got], dtype=np.float32), _size(metadata))


def score(docs: DataFrame, machine: Machine | None, *, id_col: str = "doc_id", text_col: str = "text", metadata: tuple[str, ...] = ()) -> DataFrame:
    """Score every whole text; one row per row, no shuffle.

    Returns ``doc_id``, ``held_out``, ``score`` (0 to 1, higher: the good label
    is likelier) and ``predicted`` (1 if score >= 0.5, else 0). A null text
    counts as empty, and empty texts are scored. Without a machine (nothing to
    learn from) every score is 0.5. Null metadata have a feature of their own.
    Rows with a null id are scored and count as not held out; repeated rows get
    equal scores; other columns are ignored, whatever their names.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(machine)  # a fixed size: (features) x (RANK + 1) floats
    src = _prepared(docs, id_col, text_col, metadata)
    kind = src.schema["doc_id"].dataType.simpleString()

    def run(batches):
        m = shared.value
        for batch in batches:
            n = batch.num_rows
            out = np.full(n, 0.5)
            if m is not None and n:
                rows = _of(batch)
                for a in range(0, n, 64):
                    out[a : a + 64] = m.scores(rows[a : a + 64])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out)], names=["doc_id", "score"])

    out = src.mapInArrow(tidy(run, 500), f"doc_id {kind}, score double")
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))
