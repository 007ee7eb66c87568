"""op9 and connected components against brute force."""
import random
import re

import numpy as np
from llm.conftest import clash

from churnlens.llm import jaccard
from churnlens.llm.components import connected_components


def union_find(nodes, edges):
    parent = {n: n for n in nodes}

    def root(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x
    for a, b in edges:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}


def brute(texts, k=4, percent=85):
    sets = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), t or ""))
        sets.append({tuple(w[i:i + k]) for i in range(max(len(w) - k + 1, 1))} if w else set())
    edges = [(i, j) for i in range(len(sets)) for j in range(i) if sets[i] and sets[j]
             and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j])]
    comp = union_find(range(len(sets)), edges)
    return [(i, len(s), comp[i]) for i, s in enumerate(sets)]


def check(spark, texts, **more):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = jaccard.jaccard_components(df, **more).select("doc_id", "n_shingles", "component_id").collect()
    assert sorted(map(tuple, got)) == brute(texts)


def corpus(seed, n_base=25, words=(1, 60)):
    rng = random.Random(seed)
    pool = [f"w{i}" for i in range(3000)]
    passage = [rng.choice(pool) for _ in range(30)]
    texts = [None, "", "A b", "a B", "a b c", "x", "X"]
    for _ in range(n_base):
        base = [rng.choice(pool) for _ in range(rng.randint(*words))]
        if rng.random() < 0.4:
            base += passage
        texts.append(" ".join(base))
        for _ in range(rng.randint(0, 6)):
            near = base.copy()
            for _ in range(rng.randint(0, max(1, len(base) // 20))):
                near[rng.randrange(len(near))] = rng.choice(pool)
            texts.append(rng.choice([" ", "\n"]).join(near[:rng.randint(len(near) - 3, len(near))] or near))
    rng.shuffle(texts)
    return texts


def test_random_corpora(spark):
    check(spark, corpus(1), chunk_bytes=500, bucket_bytes=900)
    check(spark, corpus(2, 12, (100, 300)))


def test_chains_and_large_groups(spark):
    # A chain: each text links with its neighbours only; and a group of many different near copies.
    words = [f"c{i}" for i in range(160)]
    chain = [" ".join(words[i:i + 60]) for i in range(0, 100, 4)]
    rng = random.Random(9)
    base = [f"g{i}" for i in range(120)]
    group = []
    for i in range(60):
        near = base.copy()
        near[rng.randrange(120)] = f"new{i}"
        group.append(" ".join(near))
    check(spark, chain + group + [" ".join(base)] * 3)


def test_packed_keys():
    rng = np.random.default_rng(0)
    for keys in ([], [0], [5, 70_000, 70_001, (1 << 24) - 1], sorted(set(rng.integers(0, 1 << 24, 500).tolist()))):
        keys = np.array(keys, np.int64)
        assert jaccard.unpack_keys(*jaccard.pack_keys(keys)).tolist() == keys.tolist()


def test_common_shingles_come_last(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "COMMON", 2)
    check(spark, corpus(5), chunk_bytes=700, bucket_bytes=1500)


def test_copies_that_link_only_through_their_origin(spark, monkeypatch):
    # Each copy has changes of its own: 0.87 with the origin, less among each other.
    monkeypatch.setattr(jaccard, "COMMON", 4)
    rng = random.Random(8)
    base = [f"b{i}" for i in range(200)]
    texts = []
    for i in range(40):
        near = base.copy()
        for j in rng.sample(range(4, 196, 8), 3):
            near[j] = f"x{i}.{j}"
        texts.append(" ".join(near))
    check(spark, texts)
    check(spark, [*texts[:20], " ".join(base), *texts[20:]])


def test_tree_loses_no_pair():
    rng = np.random.default_rng(2)
    sets = []
    for _ in range(60):
        base = rng.integers(0, 1 << 60, rng.integers(5, 200))
        for _ in range(4):
            keep = base[rng.random(len(base)) > 0.08]
            sets.append(np.unique(np.append(keep, rng.integers(0, 1 << 60, 2))))
    vec = np.stack([np.bincount(s % jaccard.GROUPS, minlength=jaccard.GROUPS) for s in sets])
    n = np.array([len(s) for s in sets])
    q, p = jaccard.CountTree(vec, n).search(vec, n, 85)
    got = set(zip(q.tolist(), p.tolist()))
    links = {(i, j) for i in range(len(sets)) for j in range(len(sets))
             if 100 * len(np.intersect1d(sets[i], sets[j])) >= 85 * len(np.union1d(sets[i], sets[j]))}
    assert links <= got and len(got) < 0.2 * len(sets) ** 2 and len(links) > len(sets)


def test_search_by_tree_and_by_neighbours(spark):
    # A shingle that very many classes share goes through the tree, small groups do not.
    rng = np.random.default_rng(5)
    rows = []
    for s, size in ((1, 300), (2, 3), (3, 40), (4, 1)):
        for _ in range(size):
            v = rng.integers(0, 4, jaccard.GROUPS)
            rows += [(s, len(rows), len(rows), int(v.sum()), v)]
    near = [(s, c + 10_000, c + 10_000, n, v) for s, c, _, n, v in rows]
    everything = rows + near
    df = spark.createDataFrame([(s, c, comp, n, bytearray(v.astype(np.uint8).tobytes())) for s, c, comp, n, v in everything],
                               "s long, c long, comp long, n long, vec binary").repartition(4, "s").sortWithinPartitions("s")
    got = {tuple(r) for r in jaccard._search(df, 85).collect()}
    want = {tuple(sorted((a[1], b[1]))) for i, a in enumerate(everything) for b in everything[:i] if a[0] == b[0]
            and 100 * min(a[3], b[3]) >= 85 * max(a[3], b[3])
            and np.minimum(a[4], b[4]).sum() >= -(-85 * (a[3] + b[3]) // 185)}
    assert got == want and len(want) >= len(rows)


def test_large_groups_are_searched_in_blocks(spark, monkeypatch):
    # One shingle shared by a large component, outsiders and copies that do not link with each other.
    monkeypatch.setattr(jaccard, "BLOCK", 40)
    comp = {c: 0 if c < 400 else 400 if c < 450 else c for c in range(520)}
    rows = [(1, c, comp[c]) for c in comp] + [(2, c, comp[c]) for c in range(395, 405)]
    got = jaccard._blocks(spark.createDataFrame(rows, "s long, c long, comp long")).collect()
    groups = {}
    for r in got:
        groups.setdefault((r.s, r.i, r.j), ([], []))[r.side].append(r.c)
    assert max(len(a) + len(b) for a, b in groups.values()) < 2 * 2 * 40
    assert all(len({comp[c] for c in a + b}) > 1 for a, b in groups.values())
    assert sorted(groups[2, 0, 0][0]) == list(range(395, 405))
    met = [tuple(sorted((x, y))) for (s, i, j), (a, b) in groups.items() if s == 1
           for x in a for y in (b if i < j else a) if x != y and comp[x] != comp[y]]
    assert {(x, y) for x in comp for y in range(x) if comp[x] != comp[y]} == {(y, x) for x, y in met}

    rng = np.random.default_rng(4)
    vec = {c: rng.integers(0, 4, jaccard.GROUPS) * (1 if c % 7 else 90) for c in range(300)}     # also counts above 255
    vec |= {c + 300: v for c, v in vec.items() if c + 300 < 520}
    size = {c: int(v.sum()) for c, v in vec.items()}
    info = spark.createDataFrame([(c, size[c], bytearray(np.minimum(v, 255).astype(np.uint8).tobytes())) for c, v in vec.items()],
                                 "c long, n long, vec binary")
    dealt = jaccard._blocks(spark.createDataFrame(rows, "s long, c long, comp long")).join(info, "c")
    found = {tuple(r) for r in jaccard._search(dealt.repartition(3, "s", "i", "j").sortWithinPartitions("s", "i", "j"), 85).collect()}
    want = {(c, c + 300) for c in range(220) if comp[c] != comp[c + 300]}
    assert len(want) > 100 and want <= found and all(comp[a] != comp[b] for a, b in found)


def test_groups_in_blocks_keep_the_components(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK", 6)
    rng = random.Random(8)
    base = [f"b{i}" for i in range(200)]
    texts = []
    for i in range(40):
        near = base.copy()
        for j in rng.sample(range(4, 196, 8), 2 + i % 3):
            near[j] = f"x{i}.{j}"
        texts.append(" ".join(near))
    check(spark, texts + corpus(3, 10))


def test_sets_are_sent_in_bounded_parts(spark, monkeypatch):
    to = [{"a": a, "part": 0, "role": 1} for a in range(1000)]
    parts = list(jaccard.set_copies([(1, to, b"x" * 100), (2, to[:3], b"y" * 7)], 1000))
    assert max(sum(map(len, p["set"])) for p in parts) <= 1000
    sent = [(c, a, s) for p in parts for c, a, s in zip(p["c"], p["a"], p["set"])]
    assert sent == [(1, a, b"x" * 100) for a in range(1000)] + [(2, a, b"y" * 7) for a in range(3)]
    monkeypatch.setattr(jaccard, "TARGETS", 20)
    rows = [(1, a, 0, 1) for a in range(1000)] + [(2, 5, 0, 0)]
    lists = jaccard._target_lists(spark.createDataFrame(rows, "c long, a long, part long, role int")).collect()
    assert max(len(r.to) for r in lists) < 3 * 20
    assert sorted((r.c, x.a, x.part, x.role) for r in lists for x in r.to) == rows


def test_components(spark):
    rng = random.Random(3)
    edges = [(i, i + 1) for i in range(200, 260)] + [(300, i) for i in range(301, 340)] + [(5, 5), (None, 4)]
    edges += [(rng.randrange(150), rng.randrange(150)) for _ in range(100)]
    rng.shuffle(edges)
    real = [(a, b) for a, b in edges if a is not None and a != b]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == union_find({x for e in real for x in e}, real)
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_tricky_rows(spark, tricky):
    got = jaccard.jaccard_components(clash(tricky, "n", "c", "row", "shared", "set", "component_id")).collect()
    assert len(got) == tricky.count() and {r.set for r in got} == {"mine"}
    by = {}
    for r in got:
        by.setdefault(r.doc_id, set()).add((r.n_shingles, r.component_id))
    assert by[0] == by[1] == by[2] or all(n == 0 and c == d for d in (0, 1, 2) for n, c in by[d])
    assert by[None] == {(2, None)} and by[11] == {(9, 10)} or by[11] == by[10]
    assert by[5] == {(1, 5)}
    assert jaccard.jaccard_components(tricky.limit(0)).count() == 0
