"""The drift monitor on a stream, sketches against exact quantiles, and as-of lookups against brute force."""
import bisect
import random
import time
import uuid

import pytest
from pyspark.sql import functions as F

from churnlens.functions import sketches as sk
from churnlens.functions.asof import asof
from churnlens.operators import drift as dr
from churnlens.operators import survival as sv
from churnlens.session import ensure_checkpoint_dir
from churnlens.streaming import drift as sd


def _base(spark):
    return ensure_checkpoint_dir(spark).rstrip("/") + "/m_" + uuid.uuid4().hex


def test_stream_monitor_is_the_report_over_all_batches(spark):
    rng = random.Random(4)
    base, schema = _base(spark), "a double, b double"
    ref = spark.createDataFrame([(rng.gauss(0, 1), rng.random()) for _ in range(800)], schema)
    parts = [[(rng.gauss(0, 1), rng.random()) for _ in range(300)], [(rng.gauss(3, 1), None) for _ in range(300)],
             [(rng.gauss(3, 1), rng.random()) for _ in range(900)], [(99.0, float("nan"))]]
    for rows in parts:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(base + "/in")
        time.sleep(1.1)
    sd.write_baseline(ref, ["a", "b"], base + "/base")
    stream = lambda: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(base + "/in")
    sd.monitor_stream(stream(), base + "/base", base + "/out", base + "/ck")
    whole = spark.createDataFrame([r for rows in parts for r in rows], schema)
    want = {r.feature: (r.psi, r.level) for r in dr.psi_report(ref, whole, ["a", "b"]).collect()}
    got = {r.feature: (r.psi, r.level) for r in sd.current_levels(spark, base + "/out").collect()}
    assert got.keys() == want.keys() and all(got[f] == (pytest.approx(want[f][0]), want[f][1]) for f in want)
    raised = [(r.batch_id, r.feature, r.previous_level, r.level) for r in sd.alerts(spark, base + "/out").collect()]
    assert raised == [(1, "a", "green", "red")]          # once, not in each later batch
    # The whole stream again into the same folder, from another checkpoint: nothing changes.
    before = sorted(map(str, sd.alerts(spark, base + "/out").collect() + spark.read.parquet(base + "/out/levels").collect()))
    sd.monitor_stream(stream(), base + "/base", base + "/out", base + "/ck2")
    assert sorted(map(str, sd.alerts(spark, base + "/out").collect() + spark.read.parquet(base + "/out/levels").collect())) == before


def test_merged_sketches_are_within_the_bound(spark):
    rng = random.Random(2)
    rows = [(f"2024-01-{1 + i % 9:02d}", rng.lognormvariate(0, 1), float(i % 5)) for i in range(30_000)] + [("2024-01-01", None, float("nan"))]
    df = spark.createDataFrame(rows, "day string, x double, same double")
    days = sk.daily_sketches(df, ["x", "same"], "day")
    assert days.count() == 18
    merged = sk.merge_sketches(days)
    at_once = sk.daily_sketches(df.withColumn("day", F.lit("2024-01-01")), ["x", "same"], "day")
    values = sorted(r[1] for r in rows if r[1] is not None)
    probs = [0, 0.01, 0.25, 0.5, 0.9, 1]
    for table in (merged, at_once):
        r = sk.sketch_quantiles(table.filter("feature = 'x'"), probs).first()
        assert r.n == 30_000 and r.quantiles[0] == values[0] and r.quantiles[-1] == values[-1]
        for p, q in zip(probs, r.quantiles):
            assert abs(bisect.bisect_right(values, q) / len(values) - p) <= 2 * sk.rank_error() + 1e-4
    small = df.filter("x IS NOT NULL").limit(200)
    both = [sk.sketch_quantiles(t.filter("feature = 'x'"), probs).first().quantiles for t in (
        sk.merge_sketches(sk.daily_sketches(small, ["x"], "day")), sk.daily_sketches(small.withColumn("day", F.lit("2024-01-01")), ["x"], "day"))]
    assert both[0] == both[1]                             # fewer rows than the sketch holds: exact
    edges = {r.feature: r.edges for r in sk.sketch_edges(merged).collect()}
    assert len(edges["x"]) == 11 and len(edges["same"]) == 11 and edges["x"] == sorted(edges["x"])
    psi = {r.feature: r.psi for r in dr.psi(df, df, ["x", "same"], edges=sk.sketch_edges(merged)).collect()}
    assert psi == pytest.approx({"x": 0.0, "same": 0.0})
    f = sk.sketch_fences(merged.filter("feature = 'x'")).first()
    assert f.lower < 0.6 < 1.7 < f.upper


@pytest.mark.parametrize("n_parts", [1, 7])
def test_asof_is_the_last_earlier_observation(spark, n_parts):
    rng = random.Random(8)
    pick = lambda: rng.choice(["a", "b", "hot", "hot", "hot", None])
    rows = [(pick(), rng.choice([None, *[x / 2 for x in range(60)]]), i) for i in range(300)] + [("late", 0.0, 1000), ("none", 5.0, 1001)] * 2
    seen = [(pick(), rng.choice([None, *range(30)]), i, rng.choice([None, rng.random()]) if i % 3 else float(i)) for i in range(120)]
    seen = [(g, None if t is None else float(t), i, v) for g, t, i, v in seen] + [("late", 3.0, 500, 1.0)]
    left = spark.createDataFrame(rows, "g string, t double, id long").withColumn("v", F.lit("mine"))
    right = spark.createDataFrame(seen, "g string, st double, tie long, v double")
    got = asof(left, right, "t", "st", ["v"], by=["g"], tie=["tie"], n_parts=n_parts)
    assert got.columns == ["g", "t", "id", "st", "v"]
    want = []
    for g, t, i in rows:
        mine = [(s, k, v) for sg, s, k, v in seen if sg == g and s is not None and t is not None and s <= t]
        best = max(mine, key=lambda x: x[:2]) if mine else (None, None, None)
        want.append((g, t, i, best[0], best[2]))
    assert sorted((tuple(r) for r in got.collect()), key=repr) == sorted(want, key=repr)
    alone = asof(left.select("t", "id"), right, "t", "st", ["v"], tie=["tie"], n_parts=n_parts)
    assert alone.count() == len(rows)
    assert asof(left.limit(0), right, "t", "st", ["v"], by=["g"]).count() == 0
    assert asof(left, right.limit(0), "t", "st", ["v"], by=["g"]).filter("v IS NULL").count() == len(rows)


def test_km_by_segment_with_continuous_durations(spark):
    rng = random.Random(3)
    rows = [(rng.choice(["x", "y", None]), rng.choice([rng.uniform(0, 50), float(rng.randint(0, 5) * 10)]), int(rng.random() < 0.6)) for _ in range(400)]
    rows += [("late", 90.0, 1)] * 3
    df = spark.createDataFrame(rows, "segment string, duration double, event int")
    grid = [0.0, 10.0, 20.0, 30.0, 60.0]
    out = sv.km_by_segment(df, "segment", grid)
    for r in out.collect():
        mine = [(d, e) for s, d, e in rows if s == r.segment]
        s = 1.0
        for t in sorted({d for d, e in mine if e and d <= r.t}):
            s *= 1 - sum(1 for d, e in mine if d == t and e) / sum(1 for d, _ in mine if d >= t)
        assert r.survival == pytest.approx(s) and r.n_at_risk == sum(d >= r.t for d, _ in mine)
        assert r.n_events == sum(d <= r.t and e for d, e in mine)
    assert out.count() == 4 * len(grid)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
