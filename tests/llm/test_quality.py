"""op1: base measures and Viterbi against brute force, the fitted CRF on held-out documents."""
import itertools
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from conftest import SF
from llm.conftest import clash

from churnlens.llm import quality as q
from churnlens.llm import text as tx


def brute(t):
    t = t or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    seen, dup = set(), 0
    for line in t.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    c = Counter(tuple(w[i:i + 8]) for i in range(len(w) - 7))
    cover = {j for i in range(len(w) - 7) if c[tuple(w[i:i + 8])] > 1 for j in range(i, i + 8)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(cover)


def test_measures_match_brute_force():
    rng = random.Random(1)
    texts = [None, "", "\n", "\n\n a", "a\n\na\n", "x"] + [
        "".join(rng.choice("aab  \n\té😀#*|!.\x85\xa0") for _ in range(rng.randint(0, 300))) for _ in range(800)]
    got = []
    for b in tx.slices(pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], ["t"]), "t", 20_000):
        data, off = tx.column_bytes(b.column(0))
        m = q.measure(data, off, *q.describe(data, off))
        got += list(zip(*[m[c].tolist() for c in q._MEASURES]))
    assert got == [brute(t) for t in texts]


def test_viterbi_matches_brute_force():
    rng = np.random.default_rng(3)
    for _ in range(60):
        first = np.concatenate([[0], np.cumsum(rng.integers(0, 7, 5))])
        s, trans, start = rng.normal(size=(first[-1], 2)), rng.normal(size=(2, 2)), rng.normal(size=2)
        label = q.viterbi(s, first, trans, start)
        for a, b in zip(first, first[1:]):
            if b > a:
                assert tuple(label[a:b]) == max(itertools.product((0, 1), repeat=int(b - a)), key=lambda p: (
                    start[p[0]] + sum(s[a + i, x] for i, x in enumerate(p)) + sum(trans[x, y] for x, y in zip(p, p[1:]))))


def test_fit_gradient_direction_and_single_class():
    x = np.concatenate([np.zeros((40, 2)), np.ones((40, 2))])
    y = np.repeat([0, 1], 40)
    first = np.arange(0, 81, 4)
    m = q.fit_crf(x, first, y)
    assert (q.viterbi(m.scores(x), first, m.trans, m.start) == y).all()
    assert q.fit_crf(x, first, np.ones(80, int)) is None and q.fit_crf(x[:0], np.zeros(1, int), y[:0]) is None


def test_held_out_documents(spark):
    sf = SF.replace("0.001", "0.01")
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    model = q.train(docs, labels.filter("doc_id % 2 = 0"))
    held = q.judge(docs.select("doc_id", "text"), model).join(labels.filter("doc_id % 2 = 1"), "doc_id")
    held = held.filter("not base_failed").select("kept", "quality").collect()
    assert len(held) > 100 and sum(r.kept == bool(r.quality) for r in held) >= 0.95 * len(held)


def test_tricky_rows(spark, tricky):
    out = q.judge(clash(tricky, "kept", "n_words"), None)
    assert set(tricky.columns) <= set(out.columns)
    got = out.collect()
    assert len(got) == tricky.count()
    for r in got:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == brute(r.text)
        assert r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words) and r.kept == (not r.base_failed)
    assert q.judge(tricky.limit(0), None).count() == 0
    empty = spark.createDataFrame([], "doc_id long, quality int")
    assert q.train(tricky, empty) is None and q.train(tricky.limit(0), empty) is None
