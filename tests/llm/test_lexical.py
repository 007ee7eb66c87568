"""op11: ranked search against scoring every document."""
import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from llm.conftest import clash

from churnlens.llm.lexical import Bucket, Queries, Search, rank_documents

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def brute(docs, items, k):
    bags = [(i, Counter(terms(t))) for i, t in docs]
    n = sum(1 for _, b in bags if b)
    total = sum(sum(b.values()) for _, b in bags)
    df = Counter(t for _, b in bags for t in b)
    out = []
    for item, text in dict.fromkeys(items):
        found = []
        for i, b in bags:
            m = 50 + (50 * sum(b.values()) * n) // total if b else 0
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((10**9 * b[t]) // (1000 * b[t] + 20 * m))
                        for t in set(terms(text)) if b[t])
            if score > 0:
                found.append((-score, i is None, i))
        out += [(item, r + 1, i, -s) for r, (s, _, i) in enumerate(sorted(found, key=lambda x: (x[0], x[1], x[2] or 0))[:k])]
    return sorted(out, key=repr)


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(11)
    pool = [f"w{i}" for i in range(60)] + ["the", "The", "THE", "é", "Éa", "x1"]
    word = lambda: pool[min(int(rng.expovariate(0.08)), len(pool) - 1)]
    text = lambda n: rng.choice([" ", ", ", "-", "\n"]).join(word() for _ in range(n))
    docs = [(i, text(rng.randint(0, 60))) for i in range(400)]
    items = [(i, text(rng.randint(1, 25))) for i in range(30)]
    docs += [(400 + i, f"{text(5)} {items[i][1]} {text(5)}") for i in range(10)]
    docs += [(500, None), (501, ""), (502, "..."), (503, "w1 " * 20000), (504, docs[3][1]), (3, docs[3][1]), (None, docs[3][1]),
             (None, "w5 w6")]
    items += [(40, None), (41, ""), (42, "-"), (43, "nowhere"), (44, items[0][1]), (0, items[0][1]), (1, "w1 w2 w3"), (None, "w4 w5")]
    return docs, items


def search(spark, docs, items, **options):
    d = clash(spark.createDataFrame(docs, "doc_id long, text string"), "id", "n", "t", "score", "rank", "query")
    q = clash(spark.createDataFrame(items, "item_id long, text string"), "item", "doc", "query")
    return sorted((tuple(r) for r in rank_documents(d, q, **options).collect()), key=repr)


@pytest.mark.parametrize("k, options", [(5, {}), (50, {"block_bytes": 500}), (3, {"head": 0.01})])
def test_against_all_documents(spark, corpus, k, options):
    assert search(spark, *corpus, k=k, **options) == brute(*corpus, k)


def test_buckets_are_pruned():
    """With a threshold from the long vectors, short ones are neither candidates nor scored."""
    q = Queries.of(["alpha beta gamma"]).weighted(np.array([10, 10, 10]), 10_000)
    rng = np.random.default_rng(0)

    def bucket(n, terms, impact):
        off = pa.array(np.arange(0, n * terms + 1, terms), pa.int32())
        t = np.concatenate([rng.permutation(3)[:terms] for _ in range(n)])
        lists = [pa.ListArray.from_arrays(off, pa.array(x, pa.int32())) for x in (np.sort(t.reshape(n, terms)).ravel(), np.full(n * terms, impact))]
        length = np.sqrt(terms * float(q.weights[0]) * float(impact) ** 2)
        return Bucket(pa.RecordBatch.from_arrays([pa.array(np.arange(n)), pa.array(np.full(n, length)), *lists], ["id", "length", "t", "impact"]), 3)

    s = Search(q, np.zeros(1, np.int64), 5)
    s.add(bucket(20, 3, 500_000))
    assert s.scored == 20 and s.least[0] == 3 * q.weights[0] * 500_000
    s.add(bucket(500, 1, 400_000))
    s.add(bucket(500, 2, 500_000))
    assert s.scored == 20


def test_empty(spark):
    assert search(spark, [], [(1, "a")]) == [] and search(spark, [(1, "a")], []) == [] and search(spark, [(1, None)], [(1, "a")]) == []
    # A term that is in every document still weighs floor(1000 * ln((2N + 2) / (2N + 1))).
    assert search(spark, [(1, "a")], [(1, "a b")]) == brute([(1, "a")], [(1, "a b")], 50)
