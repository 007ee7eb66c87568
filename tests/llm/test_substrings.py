"""op5: repeated windows against brute force."""
import random
import re
from collections import Counter

from llm.conftest import clash

from churnlens.llm.substrings import remove_repeats


def brute(texts, k):
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for t in texts]
    count = Counter(tuple(w[i:i + k]) for w in words for i in range(len(w) - k + 1))
    out = []
    for w in words:
        gone = {j for i in range(len(w) - k + 1) if count[tuple(w[i:i + k])] > 1 for j in range(i, i + k)}
        runs = []
        for j in sorted(gone):
            if runs and runs[-1][1] == j:
                runs[-1][1] = j + 1
            else:
                runs.append([j, j + 1])
        out.append((len(w), len(gone), runs, " ".join(x for j, x in enumerate(w) if j not in gone)))
    return out


def check(spark, texts, k, chunk_bytes):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = sorted(remove_repeats(df, k, chunk_bytes=chunk_bytes, bucket_bytes=chunk_bytes).collect(), key=lambda r: r.doc_id)
    assert [(r.n_words, r.n_removed, [[x.start, x.end] for x in r.removed], r.kept_text) for r in got] == brute(texts, k)


def test_random_texts(spark):
    rng = random.Random(4)
    pool = ["a", "b", "c", "é", "dd"]
    texts = [None, "", "a"] + [rng.choice([" ", "\n", "  "]).join(rng.choice(pool) for _ in range(rng.randint(0, 25)))
                               for _ in range(150)]
    for k in (1, 3, 5):
        check(spark, texts, k, 200)
    check(spark, texts, 3, 1 << 20)


def test_passages_inside_and_across_documents(spark):
    rng = random.Random(5)
    word = lambda: f"w{rng.randint(0, 10**6)}"
    passage, short = [word() for _ in range(60)], [word() for _ in range(34)]
    own = [word() for _ in range(40)]
    texts = [" ".join([word(), *passage, word()]), " ".join([word() for _ in range(100)] + passage), " ".join(short + [word()]),
             " ".join(short + [word()]), " ".join(own + [word()] + own), "the " * 3000, " ".join(passage)]
    check(spark, texts, 35, 1 << 10)


def test_tricky_rows(spark, tricky):
    got = remove_repeats(clash(tricky, "chunk", "row", "t", "order", "n_removed", "bucket"), 3)
    assert got.count() == tricky.count() and {r.chunk for r in got.collect()} == {"mine"}
    by = {r.doc_id: r for r in got.filter("doc_id IN (8, 9, 10, 11)").collect()}
    assert by[8].n_removed == 5000 and by[9].n_removed == 0 and by[10].n_removed == by[10].n_words == by[11].n_removed
    assert remove_repeats(tricky.limit(0)).count() == 0
