"""op2: removal of cross-site lines against brute force."""
import random

from llm.conftest import clash

from churnlens.llm.linededup import dedup_lines


def brute(rows, min_sites):
    sites, first = {}, {}
    for i, (d, t, s) in enumerate(rows):
        for n, line in enumerate((t or "").split("\n")):
            if line.strip(" \t\n\r\x0b\x0c"):
                sites.setdefault(line, set()).update({s} - {None})
                first[line] = min(first.get(line, (d, n)), (d, n))
    out = []
    for d, t, s in rows:
        lines = (t or "").split("\n")
        kept = [x for n, x in enumerate(lines) if len(sites.get(x, ())) < min_sites or first[x] == (d, n)]
        out.append((d, None if t is None else "\n".join(kept), 0 if t is None else len(lines), len(lines) - len(kept)))
    return sorted(out, key=repr)


def test_random_lines(spark):
    rng = random.Random(7)
    pool = [f"line {i}" for i in range(12)] + ["", " ", "x"]
    rows = [(d, rng.choice([None, ""]) if rng.random() < 0.05 else "\n".join(rng.choice(pool) for _ in range(rng.randint(1, 6))),
             rng.choice([None, *[f"s{i}" for i in range(9)]])) for d in range(120)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    for min_sites in (2, 8, 9):
        got = dedup_lines(df, min_sites=min_sites).select("doc_id", "text", "n_lines", "n_removed").collect()
        assert sorted(map(tuple, got), key=repr) == brute(rows, min_sites)


def test_more_sites_than_the_sketch_counts_exactly(spark):
    # Exactly at the threshold and one below it, with estimates that are off: the exact count decides.
    rows = [(i, "at" if i < 400 else "below", f"s{i if i < 400 else i - 400}") for i in range(799)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = dedup_lines(df, min_sites=400, lg_k=4).groupBy("text").count().collect()
    assert {r["text"]: r["count"] for r in got} == {"at": 1, "": 399, "below": 399}


def test_tricky_rows(spark, tricky):
    out = dedup_lines(clash(tricky, "n_removed", "th", "id", "site", "h1", "row", "cuts", "t"), min_sites=2)
    assert out.count() == tricky.count() and out.filter("text IS NULL").count() == 1
    # Ids 10 and 11 have the same text on two sites: the first keeps it.
    got = {r.doc_id: r.text for r in out.filter("doc_id IN (10, 11)").collect()}
    assert got[10] and not got[11].strip()
    assert {r.th for r in out.collect()} == {"mine"}
    assert dedup_lines(tricky.limit(0)).count() == 0
