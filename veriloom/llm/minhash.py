"""MinHash near-duplicate detection with sequential Bayesian verification.

1. Every text becomes its set of distinct five-word shingles (64-bit hashes).
   Texts with equal sets form a class; only the class representative (smallest
   ``doc_id``) goes on, so a group of exact copies costs one row.
2. ``bands * rows`` MinHash values per representative. Representatives that
   agree on all values of a band are candidates; buckets are joined to their
   smallest member only, never expanded into pairs.
3. Each candidate is compared with the smallest member of its buckets:
   signature bytes batch after batch, and a pair is dropped once the posterior
   probability that its similarity reaches the threshold falls below ``miss``;
   survivors are checked exactly on their full shingle sets. Links join texts
   into components, so a group of near copies of one text is done here.
4. Buckets that still hold several components are open. Their members, connected
   through open buckets, form families; a family is dealt in blocks, and each
   pair of blocks is one bounded task that compares, in the same way, pairs of
   different components that share a band. At most one link per text leaves it.
5. All links between representatives are joined into components.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache
from itertools import groupby as _runs

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veriloom.llm.components import connected_components
from veriloom.llm.shingles import documents_words, mix64, shingle_set
from veriloom.llm.workspace import Workspace, fresh, sift, tidy

BANDS, ROWS, STEP = 36, 7, 36
BLOCK_ROWS, BLOCK_BYTES = 256, 16_000_000


@lru_cache(maxsize=4)
def _family(n: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20240229)
    return rng.integers(0, 1 << 32, (n, 1), dtype=np.uint32), rng.integers(0, 1 << 31, (n, 1), dtype=np.uint32) * np.uint32(2) + np.uint32(1)


def signature(shingles: np.ndarray, n: int) -> np.ndarray:
    """``n`` 32-bit MinHash values of a non-empty set."""
    flip, factor = _family(n)
    low = (shingles >> np.uint64(32)).astype(np.uint32)
    out = None
    for at in range(0, len(low), 2048):
        part = ((low[None, at : at + 2048] ^ flip) * factor).min(axis=1)
        out = part if out is None else np.minimum(out, part)
    return out


def band_keys(sig: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One signed 64-bit key per band; keys of different bands differ."""
    h = np.arange(1, bands + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for col in sig.reshape(bands, rows).T:
        h = mix64(h ^ col.astype(np.uint64)) + np.uint64(1)
    return h.view(np.int64)


def signature_bytes(sig: np.ndarray) -> bytes:
    """One byte of each MinHash value: unequal values agree by chance once in 256."""
    return ((sig * np.uint32(2654435761)) >> np.uint32(24)).astype(np.uint8).tobytes()


@lru_cache(maxsize=8)
def least_matches(n: int, step: int, threshold: float, miss: float) -> tuple[tuple[int, int], ...]:
    """(compared, least agreeing bytes) after each batch, such that fewer mean P(similarity >= threshold) < miss.

    Uniform prior on the similarity, binomial likelihood, integrated on a grid.
    """
    s = (np.arange(4000) + 0.5) / 4000
    p = s + (1 - s) / 256
    out = []
    for m in range(step, n + 1, step):
        k = np.arange(m + 1)[:, None]
        like = k * np.log(p) + (m - k) * np.log1p(-p)
        like = np.exp(like - like.max(axis=1, keepdims=True))
        tail = like[:, s >= threshold].sum(axis=1) / like.sum(axis=1)
        out.append((m, int(np.argmax(tail >= miss))))
    return tuple(out)


def _profile(bands: int, rows: int, k: int):
    schema = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("fp1", pa.int64()), ("fp2", pa.int64()), ("keys", pa.list_(pa.int64())), ("sig", pa.binary())])

    def run(batches):
        seen: dict[bytes, tuple[np.ndarray, bytes]] = {}
        for batch in batches:
            rows_out = []
            for doc_id, words in zip(batch.column(0).to_pylist(), documents_words(batch.column(1).to_pylist()), strict=True):
                sh = shingle_set(words, k)
                if not len(sh):
                    rows_out.append((doc_id, 0, None, None, None, None))
                    continue
                digest = hashlib.blake2b(sh.tobytes(), digest_size=16).digest()
                fp = np.frombuffer(digest, dtype=np.int64)
                got = seen.get(digest)
                if got is None:
                    sig = signature(sh, bands * rows)
                    got = band_keys(sig, bands, rows), signature_bytes(sig)
                    if len(seen) < 20_000:
                        seen[digest] = got
                rows_out.append((doc_id, len(sh), int(fp[0]), int(fp[1]), *got))
            if rows_out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows_out, strict=True), schema, strict=True)], schema=schema)

    return run


def _shingled(k: int):
    """(rep, text) to (rep, packed shingle set)."""

    def run(batches):
        for batch in batches:
            packed = [shingle_set(w, k).tobytes() for w in documents_words(batch.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(packed, pa.binary())], names=["rep", "shingles"])

    return run


def _linked(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    small, big = (x, y) if len(x) <= len(y) else (y, x)
    if 100 * len(small) < percent * len(big):
        return False
    at = np.searchsorted(big, small)
    at[at == len(big)] = 0
    both = int((big[at] == small).sum())
    return 100 * both >= percent * (len(x) + len(y) - both)


def _promising(step: int, percent: int, miss: float):
    """Pairs (rep, pivot, n, other_n, sig, other_sig) that the byte comparison leaves."""

    def run(batches):
        for batch in batches:
            n, m = batch.column(2).to_numpy(), batch.column(3).to_numpy()
            left = np.flatnonzero(100 * np.minimum(n, m) >= percent * np.maximum(n, m))
            if len(left):
                a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), dtype=np.uint8).reshape(batch.num_rows, -1) for c in (4, 5))
                matches, done = np.zeros(len(left), dtype=np.int64), 0
                for upto, least in least_matches(a.shape[1], step, percent / 100, miss):
                    matches = matches + (a[left, done:upto] == b[left, done:upto]).sum(axis=1)
                    keep = matches >= least
                    left, matches, done = left[keep], matches[keep], upto
            yield batch.select([0, 1]).take(pa.array(left))

    return run


def _confirmed(percent: int):
    """Pairs (rep, pivot, shingles, other_shingles) that are linked."""

    def run(batches):
        for batch in batches:
            own = [_linked(np.frombuffer(x, dtype=np.uint64), np.frombuffer(y, dtype=np.uint64), percent) for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
            yield batch.select([0, 1]).filter(pa.array(own, pa.bool_()))

    return run


def _verify_task(ids, sides, keys, sigs, sets, known, bands: int, step: int, percent: int, miss: float) -> list[tuple[int, int]]:
    """Spanning links between the texts of one pair of blocks (or of one block with itself); ``known`` are their components so far."""
    n = len(ids)
    first: dict[int, int] = {}
    comp = [first.setdefault(c, i) for i, c in enumerate(known)]

    def root(x: int) -> int:
        while comp[x] != x:
            comp[x] = comp[comp[x]]
            x = comp[x]
        return x

    links = []
    two = sides[0] != 2
    keys, sigs = np.stack(keys), np.stack(sigs)
    limits = least_matches(sigs.shape[1], step, percent / 100, miss)
    lengths = np.array([len(s) for s in sets])
    top = np.array([root(i) for i in range(n)])
    for i in range(n - 1):
        rest = np.arange(i + 1, n)
        if two:
            rest = rest[sides[i + 1 :] != sides[i]]
        rest = rest[top[rest] != top[i]]
        if not len(rest):
            continue
        lo, hi = np.minimum(lengths[rest], lengths[i]), np.maximum(lengths[rest], lengths[i])
        rest = rest[100 * lo >= percent * hi]
        rest = rest[(keys[rest] == keys[i]).any(axis=1)]
        matches, done = np.zeros(len(rest), dtype=np.int64), 0
        for m, least in limits:
            if not len(rest):
                break
            matches = matches + (sigs[rest, done:m] == sigs[i, done:m]).sum(axis=1)
            keep = matches >= least
            rest, matches, done = rest[keep], matches[keep], m
        for j in rest[np.argsort(-matches, kind="stable")]:
            if root(i) != root(int(j)) and _linked(sets[i], sets[j], percent):
                comp[root(int(j))] = root(i)
                links.append((ids[i], ids[j]))
        if len(rest):
            top = np.array([root(x) for x in range(n)])
    return links


def _verify(bands: int, step: int, percent: int, miss: float):
    """Rows come sorted by (family, cell); one run of equal keys is one task."""

    def rows(batches):
        for batch in batches:
            yield from zip(*(batch.column(i).to_pylist() for i in range(batch.num_columns)), strict=True)

    def run(batches):
        out: list[tuple[int, int]] = []
        for _, own in _runs(rows(batches), key=lambda r: (r[0], r[1])):
            own = list({(r[3], r[2], r[6]): r for r in own}.values())
            if len(own) > 1:
                ids = [r[3] for r in own]
                out += _verify_task(
                    ids, np.array([r[2] for r in own]), [np.array(r[4], dtype=np.int64) for r in own], [np.frombuffer(r[5], dtype=np.uint8) for r in own],
                    [np.frombuffer(r[6], dtype=np.uint64) for r in own], [r[7] for r in own], bands, step, percent, miss,
                )
            if len(out) >= 10_000:
                yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int64())], names=["a", "b"])
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int64())], names=["a", "b"])

    return run


def _cells(rep: Column, blocks: Column) -> Column:
    """All cells (pair of blocks) that a member's own block takes part in, with the side it stands on: 0 or 1, or 2 where a block meets itself."""
    own = F.pmod(F.xxhash64(rep), blocks)
    other = F.sequence(F.lit(0).cast("long"), blocks - 1)
    return F.transform(other, lambda b: F.struct((F.least(own, b) * blocks + F.greatest(own, b)).alias("cell"), F.when(own == b, 2).when(own < b, 0).otherwise(1).alias("side")))


def near_duplicates(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", k: int = 5, percent: int = 85, bands: int = BANDS, rows: int = ROWS, miss: float = 1e-6, ws: Workspace | None = None
) -> DataFrame:
    """Near-duplicate components of ``docs``.

    Two texts are linked when 100 * |intersection| >= ``percent`` * |union| of
    their shingle sets. Returns one row per row of ``docs``: ``doc_id``,
    ``n_shingles``, ``component_id`` (smallest ``doc_id`` reachable) and
    ``kept`` (``doc_id = component_id``).

    A null, empty or blank text has an empty set, links with nothing and is its
    own component. Texts may be of any length: a set is made and compared whole.
    A row without ``doc_id`` has no identity: it is returned with a null
    component and kept; ``doc_id`` has to be a number. Repeated rows of one
    ``doc_id`` count as one document. Ties need no rule: a component is named
    by its smallest ``doc_id``. An empty table gives an empty result. Other
    columns of ``docs`` are ignored, whatever their names.

    Probability that a pair at the threshold is no candidate:
    (1 - 0.85**7)**36 < 1e-6; ``miss`` bounds the loss of the byte comparison.
    """
    spark = docs.sparkSession
    ws = ws or Workspace(spark, "minhash")
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    profile = ws.save(texts.mapInArrow(tidy(_profile(bands, rows, k), 1000), "doc_id long, n_shingles long, fp1 long, fp2 long, keys array<long>, sig binary"), "profile")

    known = profile.filter("doc_id is not null and fp1 is not null")
    classes = ws.save(known.groupBy("fp1", "fp2").agg(F.min("doc_id").alias("rep")), "classes")  # a table, so that the join can split a hot class
    members = known.select("doc_id", "n_shingles", "fp1", "fp2").join(classes, ["fp1", "fp2"]).select("doc_id", "n_shingles", "rep")
    members = ws.save(members, "members")
    reps = known.select(F.col("doc_id").alias("rep"), "n_shingles", "keys", "sig").join(members.filter("doc_id = rep").select("rep").distinct(), "rep", "left_semi")
    reps = ws.save(reps.dropDuplicates(["rep", "keys"]), "reps")

    buckets = reps.select("rep", F.explode("keys").alias("bucket"))
    pivots = buckets.groupBy("bucket").agg(F.min("rep").alias("pivot"), F.max("rep").alias("last")).filter("pivot <> last").select("bucket", "pivot")
    met = ws.save(buckets.join(pivots, "bucket").select("rep", "bucket", "pivot"), "met")
    stars = ws.save(met.filter("rep <> pivot").select("rep", "pivot").distinct(), "stars")
    ws.sweep()
    side = reps.select("rep", "n_shingles", "sig")
    both = stars.join(side, "rep").join(side.withColumnsRenamed({"rep": "pivot", "n_shingles": "other_n", "sig": "other_sig"}), "pivot")
    both = both.select("rep", "pivot", "n_shingles", "other_n", "sig", "other_sig")
    left = ws.save(both.mapInArrow(tidy(_promising(STEP, percent, miss)), "rep long, pivot long"), "left")

    wanted = stars.select("rep").unionAll(stars.select(F.col("pivot").alias("rep"))).distinct()
    wanted = ws.save(wanted, "wanted")
    own, _ = sift(texts, texts["doc_id"], wanted)  # texts without candidates stay where they are
    own = own.join(wanted.hint("merge"), texts["doc_id"] == wanted["rep"]).select("rep", "text")  # the same way at every size
    sets = ws.save(own.mapInArrow(tidy(_shingled(k), 1000), "rep long, shingles binary"), "sets")
    ws.sweep()
    both = left.join(sets, "rep").join(sets.withColumnsRenamed({"rep": "pivot", "shingles": "other"}), "pivot").select("rep", "pivot", "shingles", "other")
    links = ws.save(both.mapInArrow(tidy(_confirmed(percent), 500), "rep long, pivot long").toDF("a", "b"), "links")

    joined = connected_components(links, ws).withColumnsRenamed({"node": "rep", "component": "known"})
    tagged = ws.save(met.join(joined, "rep", "left").select("rep", "bucket", "pivot", F.coalesce("known", "rep").alias("known")), "tagged")
    ws.drop(met)
    unsettled = tagged.groupBy("bucket").agg(F.min("known").alias("x"), F.max("known").alias("y")).filter("x <> y").select("bucket")
    unsettled = ws.save(tagged.join(unsettled, "bucket", "left_semi"), "open")
    families = connected_components(unsettled.select("rep", "pivot"), ws)
    table = families.select(F.col("node").alias("rep"), F.col("component").alias("family"))
    table = table.unionAll(families.select(F.col("component").alias("rep"), F.col("component").alias("family")).distinct())
    table = table.join(unsettled.select("rep", "known").distinct(), "rep").join(reps, "rep")
    table = ws.save(table, "families")
    sizes = table.groupBy("family").agg(F.count(F.lit(1)).alias("n"), F.sum("n_shingles").alias("bytes"))
    blocks = F.greatest(F.ceil(F.col("n") / BLOCK_ROWS), F.ceil(F.col("bytes") * 8 / BLOCK_BYTES), F.lit(1)).cast("long")
    sized = table.join(ws.save(sizes.select("family", blocks.alias("blocks")), "sizes"), "family")
    dealt = sized.join(sets, "rep").withColumn("c", F.explode(_cells(F.col("rep"), F.col("blocks")))).select("family", "c.cell", "c.side", "rep", "keys", "sig", "shingles", "known")
    dealt = dealt.repartition("family", "cell").sortWithinPartitions("family", "cell", "rep")
    rest = ws.save(dealt.mapInArrow(tidy(_verify(bands, STEP, percent, miss), 500), "a long, b long"), "links")
    links = links.unionAll(rest)
    for old in (sets, tagged, unsettled, left, stars):
        ws.drop(old)

    groups = connected_components(links, ws).withColumnRenamed("node", "rep")
    out = members.join(groups, "rep", "left").select("doc_id", "n_shingles", F.coalesce("component", "rep").alias("component_id"))
    alone = profile.filter("doc_id is null or fp1 is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return out.unionAll(alone).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def drop_near_duplicates(docs: DataFrame, **options) -> DataFrame:
    """``docs`` without the rows that :func:`near_duplicates` doesn't keep; columns and order of columns stay.

    A row without ``doc_id`` stays. Of repeated rows of one kept ``doc_id`` all stay.
    """
    id_col = options.get("id_col", "doc_id")
    (gone_id,) = fresh(docs.columns, "gone_id")
    ws = options.pop("ws", None) or Workspace(docs.sparkSession, "minhash")
    gone = near_duplicates(docs, ws=ws, **options).filter(~F.col("kept")).select(F.col("doc_id").alias(gone_id)).distinct()
    gone = ws.save(gone, "gone")
    ws.sweep()
    some, others = sift(docs, docs[id_col], gone)  # texts that stay aren't moved
    return some.join(gone, docs[id_col] == gone[gone_id], "left_anti").unionAll(others)
