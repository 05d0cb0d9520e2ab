import random
from collections import Counter

import numpy as np

from veriloom.llm import decontaminate as d

SCHEMA = "doc_id long, text string, item_id int, hamming string"


def brute(docs, items, threshold=0.8, k=5):
    """All windows of the size of each item, compared on the counts of their shingles."""

    def counts(w):
        return Counter(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else Counter([tuple(w)] if w else [])

    out = {}
    for doc_id, text in docs:
        w = (text or "").lower().split()
        for item_id, item in items:
            v = (item or "").lower().split()
            want = counts(v)
            for s in range(max(1, len(w) - len(v) + 1)):
                have = counts(w[s : s + len(v)])
                union = sum((have | want).values())
                sim = sum((have & want).values()) / union if union and want and have else 0
                if sim >= threshold and sim > out.get((doc_id, item_id), 0):
                    out[doc_id, item_id] = sim
    return out


def found(docs, items):
    return {(r.doc_id, r.item_id): r.similarity for r in d.contaminated(docs, items).collect()}


def test_random_passages_against_brute_force(spark):
    rng = random.Random(7)
    word = lambda: f"w{rng.randrange(300)}"
    items = [(i, " ".join(word() for _ in range(rng.randrange(15, 60)))) for i in range(30)]
    docs = []
    for n in range(120):
        w = [word() for _ in range(rng.randrange(0, 150))]
        if n % 2:
            v = items[rng.randrange(30)][1].split()
            for _ in range(rng.randrange(0, 3)):
                v[rng.choice([0, 1, len(v) - 1, rng.randrange(len(v))])] = "X" + word()
            v = v[rng.randrange(0, 4) :]
            at = rng.randrange(len(w) + 1)
            w = w[:at] + v + w[at:]
        docs.append((n, " ".join(w)))
    want = brute(docs, items)
    got = found(spark.createDataFrame([(*x, 1, "") for x in docs], SCHEMA), spark.createDataFrame(items, "item_id long, text string"))
    assert len(want) > 20 and any(s < 1 for s in want.values())
    assert got.keys() == want.keys() and all(abs(got[x] - want[x]) < 1e-12 for x in want)


def test_reordered_passages_against_brute_force(spark):
    rng = random.Random(11)
    word = lambda n=3000: f"w{rng.randrange(n)}"
    items = [(i, " ".join(word() for _ in range(60))) for i in range(12)] + [(12, " ".join(word(6) for _ in range(40))), (13, "r " * 30)]
    docs = []
    for n in range(56):
        v = items[n % 14][1].split()
        cut = rng.randrange(1, len(v))
        v = v[len(v) // 2 :] + v[: len(v) // 2] if n < 14 else v[cut:] + v[:cut]
        docs.append((n, " ".join([word() for _ in range(rng.randrange(0, 90))] + v + [word() for _ in range(rng.randrange(0, 90))])))
    docs += [(100, "r " * 500), (101, " ".join(word(6) for _ in range(900)))]
    want = brute(docs, items)
    got = found(spark.createDataFrame([(*x, 1, "") for x in docs], SCHEMA), spark.createDataFrame(items, "item_id long, text string"))
    assert {(n, n) for n in range(12)} <= want.keys()
    assert got.keys() == want.keys() and all(abs(got[x] - want[x]) < 1e-12 for x in want)


def test_groups_of_items_give_the_same(spark, sf_dir, monkeypatch):
    docs, items = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    once = found(docs, items)
    monkeypatch.setattr(d, "GROUP_CHARS", 2000)
    assert once and found(docs, items) == once


def test_blocks_find_all_within_radius_and_few_others():
    rng = np.random.default_rng(1)
    index = d.Index(5, list(range(500))).build([" ".join(f"w{x}" for x in rng.integers(0, 1000, 30)) for _ in range(500)])
    marks, want = [], []
    for n in range(300):
        i = int(rng.integers(500))
        bits = (index.marks[i][:, None] >> np.arange(d.WIDTH)) & 1
        bits.reshape(-1)[rng.choice(d.BITS, d.RADIUS, replace=False)] ^= 1
        marks.append(bits @ (1 << np.arange(d.WIDTH)))
        want.append((n, i, d.RADIUS))
    assert set(want) <= set(zip(*(x.tolist() for x in index.near(np.array(marks))), strict=True))
    index.looked_up = index.met = 0
    index.near(rng.integers(0, 1 << d.WIDTH, (300, d.BLOCKS)))
    share = index.met / (index.looked_up * 500)
    print(f"items compared with a random fingerprint: {share:.3f}")
    assert share < 0.08


def test_rolling_fingerprints_are_those_of_each_window(monkeypatch):
    monkeypatch.setattr(d, "_TURN", 16)
    own = np.random.default_rng(2).integers(0, 1 << 40, 300).astype(np.uint64)
    starts = np.array([0, 1, 2, 9, 40, 41, 90, 91, 92, 200, 270])
    assert all((d.simhash(own[s : s + 30]) == m).all() for s, m in zip(starts, d.rolling(own, starts, 30), strict=True))


def test_recall_at_the_threshold():
    """Windows just at 0.8: the radius keeps nearly all."""
    rng = np.random.default_rng(3)
    seen = hit = 0
    for n in range(400):
        v = [f"w{x}" for x in rng.integers(0, 10**6, 49)]
        w = [*v[:44], *(f"x{x}" for x in rng.integers(0, 10**6, 5))]
        index = d.Index(5, [1]).build([" ".join(v)])
        words = next(d.documents_words([" ".join(w)]))
        assert abs(d.similarity(d._shingles(words, 5), index.shingles[0]) - 0.8) < 1e-9
        seen, hit = seen + 1, hit + bool(index.matches(words, 0.8))
    print(f"pairs at 0.8 found: {hit} of {seen}")
    assert hit >= 0.99 * seen


def test_edges(spark):
    rows = [(1, None), (2, ""), (3, " \n"), (4, "Short Item"), (5, "short item here"), (None, "a b c d e f g h"), (6, "x " * 200_000 + "a b c d e f g h"), (6, "nothing")]
    docs = spark.createDataFrame([(*r, 1, "h") for r in rows], SCHEMA)
    items = spark.createDataFrame([(1, "short item"), (2, "A b c d e f g h"), (3, None), (None, "a b c d e f g h"), (4, " "), (2, "A b c d e f g h")], "item_id long, text string")
    assert found(docs, items) == {(4, 1): 1.0, (None, 2): 1.0, (6, 2): 1.0}
    assert found(docs.limit(0), items) == {} == found(docs, items.limit(0))
    left = d.drop_contaminated(docs, items)
    assert left.columns == docs.columns and sorted(str(r.doc_id) for r in left.collect()) == ["1", "2", "3", "5", "None"]
