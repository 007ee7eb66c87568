"""op12: collocations against counting all phrases, for any number of shards and any table of slots."""
import random
import re
from collections import Counter

import pytest
from llm.conftest import clash

from churnlens.llm.phrases import collocations, count_phrases, part_index, top_collocations

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def grams(rows, n_max):
    f, total = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            ws = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(ws)
            for n in range(1, n_max + 1):
                f.update((lang, tuple(ws[i:i + n])) for i in range(len(ws) - n + 1))
    return f, total


def brute(rows, threshold, n_max=3, top=2000):
    f, total = grams(rows, n_max)
    cand = {p: c for p, c in f.items() if len(p[1]) > 1 and c >= threshold}
    inside = Counter()
    for (lang, ws), c in cand.items():
        for n in range(2, len(ws)):
            for i in range(len(ws) - n + 1):
                inside[lang, ws[i:i + n]] = max(inside[lang, ws[i:i + n]], c)
    out = []
    for (lang, ws), a in cand.items():
        if 100 * inside[lang, ws] >= 50 * a:
            continue
        cuts = [(1000000 * a * a // (f[lang, ws[:k]] * f[lang, ws[k:]]), k) for k in range(1, len(ws))]
        score, k = min(cuts)
        out.append((lang, " ".join(ws), a, f[lang, ws[:k]], f[lang, ws[k:]], total[lang], score))
    out.sort(key=lambda r: (r[0], -r[6], -r[2], r[1].encode()))
    ranks = Counter()
    done = []
    for r in out:
        ranks[r[0]] += 1
        if ranks[r[0]] <= top:
            done.append((r[0], ranks[r[0]], *r[1:]))
    return sorted(done)


def frame(spark, rows):
    df = spark.createDataFrame([(t, la) for la, t in rows], "text string, lang string")
    return clash(df, "t", "h", "code", "c", "phrase", "n", "rank", "score")


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(3)
    pool = ["a", "A", "b", "c", "new", "york", "é", "ñ x", "\x00"]
    rows = [(rng.choice(["en", "de", None, "und", ""]),
             "".join(rng.choice(pool) + rng.choice([" ", " ", " ", "  ", "\t", ". ", ",", "\n"]) for _ in range(rng.randint(0, 40))))
            for _ in range(120)]
    return rows + [("en", None), ("en", ""), (None, "  "), ("en", "..,"), ("de", "x " * 3000), ("de", "x " * 3000),
                   ("fr", "once upon a time there was " * 12), *[("xx", "only here")] * 10]


@pytest.mark.parametrize("shards, slots, threshold", [(2, 1 << 16, 10), (4, 1 << 16, 6), (1, 1 << 10, 10), (3, 1, 10)])
def test_against_all_phrases(spark, corpus, shards, slots, threshold):
    got = top_collocations(frame(spark, corpus), shards=shards, slots=slots, threshold=threshold)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(map(tuple, got.collect())) == brute(corpus, threshold)


def test_longer_phrases_and_top(spark, corpus):
    got = collocations(frame(spark, corpus), n_max=4, shards=2, slots=1 << 14).drop("n", "rank")
    assert sorted(tuple(r) for r in got.collect()) == sorted((r[0], *r[2:6], r[7]) for r in brute(corpus, 10, 4, 10**9))
    got = top_collocations(frame(spark, corpus), top=3, slots=1 << 14)
    assert sorted(map(tuple, got.collect())) == brute(corpus, 10, 3, 3)


def test_lengths_interleave(spark):
    """Pairs of words that are frequent in the first shard are counted in the second scan: three words take
    fewer scans than one pass a length, and rare phrases are never counted."""
    rows = [("en", "new york city hall. rare%d word%d" % (i, i)) for i in range(400)]
    counts, scans = count_phrases(frame(spark, rows), shards=4, slots=1 << 16)
    assert scans < 12
    assert sorted((r.n, r.f) for r in counts.collect()) == [(0, 2400), *[(1, 400)] * 4, *[(2, 400)] * 3, *[(3, 400)] * 2]


def test_part_index():
    assert [part_index(3, i, 1) for i in range(3)] == [0, 1, 2] and [part_index(3, i, 2) for i in range(2)] == [3, 4]


def test_empty(spark):
    assert top_collocations(frame(spark, []), slots=1 << 10).count() == 0
    assert top_collocations(frame(spark, [("en", None)] * 20), slots=1 << 10).count() == 0
    with pytest.raises(ValueError):
        count_phrases(frame(spark, []), slots=1000)
