"""op13: the threshold algorithm against all products."""
import math
import random

import numpy as np
from llm.conftest import clash
from pyspark.sql import functions as F

from churnlens.llm.vectors import Lists, top_vectors


def brute(rows, k):
    ok = [(i, [math.floor(256 * x) for x in v]) for i, v in rows
          if v and all(x is not None and math.isfinite(x) for x in v)]
    out = set()
    for q, a in dict.fromkeys((i, tuple(v)) for i, v in ok if i is not None and i % 3 == 0):
        found = sorted((-sum(x * y for x, y in zip(a, b)), c is None, c) for c, b in ok if c != q and len(b) == len(a))
        out |= {(q, n + 1, c, -s) for n, (s, _, c) in enumerate(found[:k])}
    return out


def search(spark, rows, k, **sizes):
    df = clash(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), "v", "id", "score", "rank", "qkey", "x")
    return [tuple(r) for r in top_vectors(df, F.col("vec_id") % 3 == 0, k, **sizes).collect()]


def test_random_vectors(spark):
    rng = random.Random(7)
    value = lambda: rng.choice([0.0, 0.25, -0.5, 1.0, rng.uniform(-2, 2)])
    rows = [(i, [float(np.float32(value())) for _ in range(6)]) for i in range(200)]
    rows += [(i + 200, [0.5, -0.5]) for i in range(8)] + [(210, None), (213, []), (216, [0.1, None]), (219, [float("nan"), 1.0]),
                                                       (222, [float("inf"), 1.0]), (None, rows[0][1]), (6, rows[6][1]), (7, rows[7][1])]
    rows += [(225, [0.0] * 6)]
    for k, sizes in ((5, {}), (3, {"query_rows": 10, "block_bytes": 400}), (500, {})):
        got = search(spark, rows, k, **sizes)
        assert len(got) == len(set(got)) and set(got) == brute(rows, k)


def test_stops_early():
    """Of rows in one narrow cone and a far crowd, only a part is scored."""
    rng = np.random.default_rng(1)
    v = rng.integers(-3, 4, (5000, 8))
    v[:40] += 200
    rows, scores, met = Lists(np.arange(5000), v).top(v[0], 0, 5, None)
    all_scores = v @ v[0]
    all_scores[0] = -10**9
    assert sorted(scores)[::-1] == sorted(all_scores)[::-1][:5] and met < 400


def test_empty(spark):
    assert search(spark, [], 5) == [] and search(spark, [(3, [1.0])], 5) == []
