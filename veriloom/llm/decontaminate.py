"""Benchmark decontamination by SimHash windows of the size of each benchmark item.

A window of a document is as many words as an item has. Windows get a SimHash
of ``BITS`` bits of their five-word shingles, weighted by how often each occurs,
which rolls along: one shingle enters, one leaves. The items' fingerprints are
indexed in ``BLOCKS`` blocks of ``WIDTH`` bits. Of two fingerprints that differ
in at most ``RADIUS`` bits, one block differs in at most ``FLIPS`` bits, so
looking up every block with all its neighbours of up to so many flipped bits
finds every item within the radius; a random item meets about one lookup in
twenty. Items within the radius are verified by the exact weighted similarity:
the sum of the smaller counts over the sum of the larger counts of all shingles.

A window that reaches the threshold for an item of its size holds a certain
number of places with a shingle that items of that size have. Windows with
fewer, whatever the order and whichever the items, get no fingerprint; all
others do.

Two windows of similarity 0.8 have fingerprints that differ in about 38 bits
(standard deviation 6), so the radius misses such a pair about once in 800, and
one of similarity 0.85 less than once in 10**4.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from itertools import combinations
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veriloom.llm.shingles import combine, documents_words, hash_words, mix64
from veriloom.llm.workspace import fresh, tidy

WIDTH, BLOCKS, FLIPS = 18, 14, 3
BITS, RADIUS = WIDTH * BLOCKS, FLIPS * BLOCKS + BLOCKS - 1  # pigeonhole: were every block to differ in more than FLIPS bits, more than RADIUS would differ
#: Items are broadcast in groups of at most so many characters; more items mean more passes, not larger broadcasts.
GROUP_CHARS = 8_000_000
_LANES = np.array([0x1F83D9ABFB41BD6B, 0x5BE0CD19137E2179, 0x6A09E667F3BCC908, 0x3C6EF372FE94F82B], dtype=np.uint64)
_MASKS = np.array([sum(1 << x for x in c) for n in range(FLIPS + 1) for c in combinations(range(WIDTH), n)], dtype=np.int64)
_PLACE = 1 << np.arange(WIDTH, dtype=np.int64)
_TURN = 2048


def _shingles(words: np.ndarray, k: int) -> np.ndarray:
    if len(words) >= k:
        return combine(words, k)
    return combine(words, len(words)) ^ np.uint64(len(words)) if len(words) else np.zeros(0, dtype=np.uint64)


def _signs(shingles: np.ndarray) -> np.ndarray:
    """+1 or -1 for each of ``BITS`` bits of each shingle."""
    lanes = mix64(shingles[:, None] ^ _LANES[None, :])
    return np.unpackbits(lanes.view(np.uint8).reshape(len(shingles), 32), axis=1)[:, :BITS].astype(np.int32) * 2 - 1


def _marks(sums: np.ndarray) -> np.ndarray:
    """Fingerprints as block values."""
    return (sums > 0).reshape(len(sums), BLOCKS, WIDTH) @ _PLACE


def rolling(shingles: np.ndarray, starts: np.ndarray, size: int) -> np.ndarray:
    """Fingerprints of the windows of ``size`` shingles at ``starts`` (in order). A shingle that occurs n times has weight n."""
    out = np.empty((len(starts), BLOCKS), dtype=np.int64)
    at = 0
    while at < len(starts):
        first = int(starts[at])
        upto = int(np.searchsorted(starts, first + _TURN))
        gap = np.flatnonzero(np.diff(starts[at:upto]) > size)  # beyond a gap a new sum is cheaper
        upto = at + int(gap[0]) + 1 if len(gap) else upto
        steps = int(starts[upto - 1]) - first
        base = sum(_signs(shingles[i : min(i + _TURN, first + size)]).sum(axis=0) for i in range(first, first + size, _TURN))
        moved = _signs(shingles[first + size : first + size + steps]) - _signs(shingles[first : first + steps]) if steps else np.zeros((0, BITS), dtype=np.int32)
        sums = np.concatenate((base[None, :], base + np.cumsum(moved, axis=0)))
        out[at:upto] = _marks(sums[starts[at:upto] - first])
        at = upto
    return out


def simhash(shingles: np.ndarray) -> np.ndarray:
    """Fingerprint of one whole text, as block values."""
    return rolling(shingles, np.zeros(1, dtype=np.int64), len(shingles))[0]


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Sum of smaller over sum of larger occurrence counts of all shingles of two texts."""
    x, n = np.unique(a, return_counts=True)
    y, m = np.unique(b, return_counts=True)
    _, i, j = np.intersect1d(x, y, assume_unique=True, return_indices=True)
    low = int(np.minimum(n[i], m[j]).sum())
    return low / (len(a) + len(b) - low) if len(a) + len(b) else 0.0


@dataclass
class Index:
    """Items of one group: which shingles occur in items of which size, and the fingerprint blocks."""

    k: int
    ids: list[int]
    words: list[int] = field(default_factory=list)
    shingles: list[np.ndarray] = field(default_factory=list)
    looked_up: int = 0
    met: int = 0

    def build(self, texts: list[str | None]) -> Index:
        for w in documents_words(texts):
            self.words.append(len(w))
            self.shingles.append(_shingles(w, self.k))
        self.size = np.array(self.words, dtype=np.int64)
        sizes = np.repeat(self.size, [len(s) for s in self.shingles])
        rows = np.unique(np.stack([np.concatenate([*self.shingles, np.zeros(0, np.uint64)]), sizes.astype(np.uint64)]), axis=1)
        self.keys, at = np.unique(rows[0], return_index=True)
        self.bounds, self.sizes = np.append(at, rows.shape[1]), rows[1].astype(np.int64)
        self.filter = np.zeros(1 << 20, dtype=bool)
        self.filter[(self.keys >> np.uint64(44)).astype(np.int64)] = True
        self.marks = np.array([simhash(s) if len(s) else np.zeros(BLOCKS, np.int64) for s in self.shingles], dtype=np.int64).reshape(-1, BLOCKS)
        self.order = np.argsort(self.marks, axis=0, kind="stable")
        self.sorted = np.take_along_axis(self.marks, self.order, axis=0)
        self.have = np.zeros((BLOCKS, 1 << WIDTH), dtype=bool)
        for b in range(BLOCKS):
            self.have[b, self.marks[:, b]] = True
        return self

    def near(self, marks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row of ``marks``, item, differing bits) of every item within the radius of each fingerprint."""
        found = []
        for at in range(0, len(marks), 256):
            codes = []
            for b in range(BLOCKS):
                asked = marks[at : at + 256, b, None] ^ _MASKS[None, :]
                row, col = np.nonzero(self.have[b][asked])
                value = asked[row, col]
                lo, hi = np.searchsorted(self.sorted[:, b], value), np.searchsorted(self.sorted[:, b], value, side="right")
                n = hi - lo
                items = self.order[np.repeat(lo - np.cumsum(n) + n, n) + np.arange(n.sum()), b]
                codes.append((np.repeat(row, n) + at) * len(self.ids) + items)
            met = np.unique(np.concatenate(codes))
            row, item = np.divmod(met, max(len(self.ids), 1))
            apart = np.bitwise_count(marks[row] ^ self.marks[item]).sum(axis=1)
            self.met += len(met)
            found.append((row[apart <= RADIUS], item[apart <= RADIUS], apart[apart <= RADIUS]))
        self.looked_up += len(marks)
        if not found:
            return (np.zeros(0, dtype=np.int64),) * 3
        return tuple(np.concatenate(x) for x in zip(*found, strict=True))

    def matches(self, words: np.ndarray, threshold: float) -> list[tuple[int, int, int, int, float]]:
        """Best window of each item that reaches the threshold: (item id, first word, words, differing bits, similarity)."""
        own = _shingles(words, self.k)
        maybe = np.flatnonzero(self.filter[(own >> np.uint64(44)).astype(np.int64)])
        place = np.searchsorted(self.keys, own[maybe])
        hit = np.flatnonzero(place < len(self.keys))
        hit = hit[self.keys[place[hit]] == own[maybe[hit]]]
        if not len(hit):
            return []
        at, lo = maybe[hit], self.bounds[place[hit]]
        n = self.bounds[place[hit] + 1] - lo
        sizes, where = self.sizes[np.repeat(lo - np.cumsum(n) + n, n) + np.arange(n.sum())], np.repeat(at, n)
        by_size = np.argsort(sizes, kind="stable")
        sizes, where = sizes[by_size], where[by_size]
        best: dict[int, tuple] = {}
        for size in np.unique(sizes).tolist():
            whole = max(1, size - self.k + 1)  # shingles of an item of this size
            part = min(len(own), max(1, min(size, len(words)) - self.k + 1))  # and of a window
            need = ceil(threshold * (part + whole) / (1 + threshold) - 1e-9)
            places = where[np.searchsorted(sizes, size) : np.searchsorted(sizes, size, side="right")]
            if len(places) < need or part < need:
                continue
            sums = np.zeros(len(own) + 1, dtype=np.int64)
            sums[1:] = np.cumsum(np.bincount(places, minlength=len(own)))
            count = sums[part:] - sums[: len(sums) - part]
            starts = np.flatnonzero(count >= need)
            if not len(starts):
                continue
            marks, same = np.unique(rolling(own, starts, part), axis=0, return_inverse=True)
            row, item, apart = self.near(marks)
            right = self.size[item] == size
            row, item, apart = row[right], item[right], apart[right]
            by_count = starts[np.argsort(-count[starts], kind="stable")]
            mark_of = dict(zip(starts.tolist(), same.reshape(-1).tolist(), strict=True))
            for i in np.unique(item).tolist():
                of = dict(zip(row[item == i].tolist(), apart[item == i].tolist(), strict=True))
                for start in by_count.tolist():
                    c = int(count[start])
                    if i in best and c < best[i][0] * (part + whole - c):
                        break  # no later window can be better
                    d = of.get(mark_of[start])
                    if d is None:
                        continue
                    s = similarity(own[start : start + part], self.shingles[i])
                    if s >= threshold and (i not in best or (s, -start) > (best[i][0], -best[i][1])):
                        best[i] = (s, start, min(size, len(words)), d)
        return [(self.ids[i], start, size, d, s) for i, (s, start, size, d) in sorted(best.items())]


def item_groups(benchmark: DataFrame, item_id: str, item_text: str, k: int):
    """Indexes of the items, in groups of bounded size; one small query a group."""
    own = benchmark.select(F.col(item_id).cast("long").alias("i"), F.col(item_text).cast("string").alias("t")).filter("i is not null and t is not null")
    chars, least, most = own.agg(F.sum(F.length("t")), F.min("i"), F.max("i")).first()
    if not chars:
        return
    parts = int(chars // GROUP_CHARS) + 1
    for p in range(parts):
        rows = (own if parts == 1 else own.filter(F.pmod(F.xxhash64("i"), F.lit(parts)) == p)).distinct().collect()
        rows = sorted((r for r in rows if len(hash_words(r.t.encode("utf-8", "surrogatepass"))[0])), key=lambda r: (r.i, r.t))
        if rows:
            yield Index(k, [r.i for r in rows]).build([r.t for r in rows])


def contaminated(
    docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", k: int = 5, threshold: float = 0.8
) -> DataFrame:
    """Pairs of a document and a benchmark item that one of its windows repeats.

    Returns ``doc_id``, ``item_id``, ``start_word``, ``n_words``,
    ``hamming``, ``similarity``: the most similar window (first of ties) of
    each pair that reaches ``threshold``. Documents are read once a group of
    items, whole and without a shuffle; items are compared in groups of at most
    ``GROUP_CHARS`` characters.

    Null or blank texts and items match nothing; an item or document of fewer
    than ``k`` words has its whole sequence as one shingle, and a document
    shorter than an item is one window. Rows with a null ``doc_id`` are matched
    too and returned with the null; items with a null id are left out; repeated
    rows give repeated results, repeated items of one id count as variants of
    it. Other columns are ignored, whatever their names.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    schema = "doc_id long, item_id long, start_word long, n_words long, hamming int, similarity double"
    out = spark.range(0).selectExpr(*[f"CAST(NULL AS {kind}) AS {name}" for name, kind in map(str.split, schema.split(", "))])  # a list, even an empty one, would be read by Python workers of its own
    for index in item_groups(benchmark, item_id, item_text, k):
        shared = spark.sparkContext.broadcast(index)

        def run(batches, shared=shared):
            index = shared.value
            for batch in batches:
                rows = []
                for doc_id, words in zip(batch.column(0).to_pylist(), documents_words(batch.column(1).to_pylist()), strict=True):
                    best = {}
                    for m in index.matches(words, threshold):
                        if m[0] not in best or m[4] > best[m[0]][4]:
                            best[m[0]] = m
                    rows += [(doc_id, *m) for m in best.values()]
                if rows:
                    types = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.float64())
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=["doc_id", "item_id", "start_word", "n_words", "hamming", "similarity"])

        out = out.unionAll(texts.mapInArrow(tidy(run, 1000), schema))
    return out


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", **options) -> DataFrame:
    """``docs`` without the documents that repeat a benchmark item; a row without an id stays. Columns stay."""
    (leaked,) = fresh(docs.columns, "leaked")
    found = contaminated(docs, benchmark, id_col=id_col, **options).select(F.col("doc_id").alias(leaked)).distinct()
    return docs.join(found, docs[id_col] == found[leaked], "left_anti")
