"""op10: windows against brute force; recall at and above the threshold."""
import random
from collections import Counter

import numpy as np
import pyarrow as pa
from llm.conftest import clash

from churnlens.llm import decontaminate as dc
from churnlens.llm import text as tx


def brute(text, item, k=5):
    """Best window of the item's length: (similarity, first word)."""
    a, b, best = (text or "").lower().split(), (item or "").lower().split(), None
    if not a or not b:
        return None
    kk = min(k, len(b))
    want, n = Counter(tuple(b[i:i + kk]) for i in range(len(b) - kk + 1)), min(len(a), len(b))
    for s in range(len(a) - n + 1):
        got = Counter(tuple(a[s + i:s + i + kk]) for i in range(n - kk + 1))
        if got:
            j = sum((got & want).values()) / sum((got | want).values())
            if j >= 0.8 and (best is None or j > best[0]):
                best = (j, s)
    return best


def material(seed):
    rng = random.Random(seed)
    pool = [f"w{i}" for i in range(400)]
    items = [(i, " ".join(rng.choice(pool) for _ in range(rng.choice([1, 3, 5, 8, 20, 30, 41, 60])))) for i in range(40)]
    items += [(100, None), (101, ""), (102, "A b C d E f")]
    docs = ["", None, "a b c d e f", " ".join(items[7][1].split()[:-1])]
    for _ in range(400):
        w = [rng.choice(pool) for _ in range(rng.randint(0, 120))]
        for _ in range(rng.randint(0, 2)):
            p = (rng.choice(items)[1] or "").split()
            for _ in range(rng.randint(0, 3) if p and rng.random() < 0.5 else 0):
                at, kind = rng.randrange(len(p)), rng.random()
                p[at:at + 1] = [rng.choice(pool)] if kind < 0.4 else [p[at], rng.choice(pool)] if kind < 0.7 or len(p) == 1 else []
            at = rng.randint(0, len(w))
            w[at:at] = [x.upper() if rng.random() < 0.2 else x for x in p]
        docs.append(" ".join(w))
    return items, docs


def test_windows_match_brute_force():
    items, docs = material(2)
    got = dc.Items(items, 5, 0.8).leaks(*tx.column_bytes(pa.array(docs, pa.string())))
    pairs = 0
    for d, found in zip(docs, got):
        want = {i: brute(d, t) for i, t in items}
        want = {i: w for i, w in want.items() if w}
        pairs += len(want)
        assert {i: (round(s, 9), a) for i, (s, a, _) in found.items()} == {i: (round(s, 9), a) for i, (s, a) in want.items()}
    assert pairs > 100


def test_index_finds_every_fingerprint_in_the_radius():
    rng = np.random.default_rng(1)
    size = dc._Size(20, 5, [(i, rng.integers(0, 1 << 63, 16).astype(np.uint64)) for i in range(30)], 0.8)
    prints = size.prints[rng.integers(0, 30, 400)].copy()
    for row in prints:
        for bit in rng.choice(dc.BITS, rng.integers(0, 45), replace=False):
            row[bit // 8] ^= 1 << (bit % 8)
    near = np.bitwise_count(prints[:, None] ^ size.prints[None]).sum(2) <= dc.RADIUS
    i, j = size.candidates(prints)
    assert set(zip(i.tolist(), j.tolist())) == set(zip(*(x.tolist() for x in np.nonzero(near))))


def test_windows_at_the_threshold_are_within_the_radius():
    # Windows of m distinct shingles with similarity just at or above 0.8: some are 32 bits or more away.
    rng = np.random.default_rng(3)
    far = 0
    for m in (9, 27, 45):
        n = 4000
        item = rng.integers(0, 1 << 63, (n, m)).astype(np.uint64)
        window = item.copy()
        window[:, :m // 9] = rng.integers(0, 1 << 63, (n, m // 9)).astype(np.uint64)     # 8 of 10 in common
        apart = np.bitwise_count(dc.fingerprints(item) ^ dc.fingerprints(window)).sum(1, dtype=np.int64)
        for i in np.argsort(apart)[-3:]:
            size = dc._Size(m + 4, 5, [(0, item[i])], 0.8)
            assert len(size.candidates(dc.fingerprints(window[i:i + 1]))[0]) == 1
        far += int((apart > 31).sum())
    assert far > 0


def test_blocks_of_the_benchmark_and_tricky_rows(spark, tricky):
    items = [(1, "same text of some words that is here twice"), (2, "word"), (3, "other words"), (4, None), (None, "an id is missing here")]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    want = None
    for block in (1 << 20, 1):
        out = dc.find_leaks(clash(tricky, "leaks", "item_id"), benchmark, block_bytes=block).collect()
        got = sorted(((r.doc_id, x.item_id, x.similarity, x.start) for r in out for x in r.leaks or []), key=repr)
        want = want or got
        assert got == want and len(out) == tricky.count()
    assert {(d, i) for d, i, _, _ in want} == {(5, 2), (5, 3), (10, 1), (11, 1), (None, None)}
    assert dc.find_leaks(tricky.limit(0), benchmark).count() == 0
    assert dc.find_leaks(tricky, benchmark.limit(0)).filter("leaks IS NOT NULL").count() == 0


def test_index_passes_few_unrelated_fingerprints():
    rng = np.random.default_rng(7)
    a, b = (rng.integers(0, 256, (1000, dc.BITS // 8)).astype(np.uint8) for _ in range(2))
    i, _ = dc._Size.near(dc.block_values(a), dc.block_values(b))
    assert len(i) < 0.06 * 1000 * 1000


def test_recall_of_the_radius_at_the_threshold():
    """Windows of m shingles of which eight in nine are shared: all but one in a thousand are within the radius."""
    rng = np.random.default_rng(8)
    for m in (9, 27, 45):
        item = rng.integers(0, 1 << 63, (6000, m)).astype(np.uint64)
        window = item.copy()
        window[:, :m // 9] = rng.integers(0, 1 << 63, (6000, m // 9)).astype(np.uint64)
        apart = np.bitwise_count(dc.fingerprints(item) ^ dc.fingerprints(window)).sum(1, dtype=np.int64)
        assert (apart <= dc.RADIUS).mean() > 0.999


def test_comparison_in_small_slices(monkeypatch):
    rng = np.random.default_rng(9)
    size = dc._Size(20, 5, [(i, rng.integers(0, 1 << 63, 16).astype(np.uint64)) for i in range(50)], 0.8)
    prints = size.prints[rng.integers(0, 50, 90)]
    want = [x.tolist() for x in size.candidates(prints)]
    monkeypatch.setattr(dc, "COMPARE_BYTES", 4 * dc.BLOCKS * 7)
    got = [x.tolist() for x in size.candidates(prints)]
    assert sorted(zip(*got)) == sorted(zip(*want)) and len(want[0]) >= 90
