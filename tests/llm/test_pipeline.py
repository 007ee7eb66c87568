"""The pipeline's stages on a small corpus with planted cases, and the queries' contract columns."""
import random

import __spark_entry__ as entry
import corpus_pipeline
from conftest import SF


def test_planted_cases(spark, tmp_path):
    rng = random.Random(1)
    text = lambda n: " ".join(f"w{rng.randint(0, 10**6)}" for _ in range(n)) + "."
    clean = [text(80) for _ in range(30)]
    item = text(30)
    near = clean[0].split()
    near[40] = "changed"
    docs = list(enumerate(clean)) + [(100, clean[1]), (101, clean[2] + " " + item + " " + text(40)), (102, "buy now " * 40),
                                     (103, None), (104, "")]
    near = " ".join(text(300).split())
    docs += [(200, near), (201, near.replace(near.split()[150], "other", 1))]
    docs += [(300 + i, text(40) + "\nAll rights reserved.") for i in range(12)]
    rows = [(d, t, "en", f"s{d % 13}", len(t or "")) for d, t in docs]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(
        f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in got} == set(range(30)) | {200} | set(range(300, 312))
    assert all(r.round_trip and r.n_tokens == len(r.ids) for r in got)
    # The boilerplate line stays where it stood first.
    assert len(corpus_pipeline.STAGES) == 5


def test_near_copies_by_five_words(spark):
    # Alike by five words at 80 %, not by four words at 85 % (op9's contract).
    words = [f"w{i}" for i in range(100)]

    def jaccard(a, b, k):
        x, y = ({tuple(t.split()[i:i + k]) for i in range(len(t.split()) - k + 1)} for t in (a, b))
        return len(x & y) / len(x | y)

    base = " ".join(words)
    between = " ".join(words[:90] + [f"n{i}" for i in range(10)])
    far = " ".join(words[:80] + [f"f{i}" for i in range(20)])
    assert jaccard(base, between, 5) >= 0.8 and jaccard(base, between, 4) < 0.85
    assert jaccard(base, far, 5) < 0.8 and jaccard(between, far, 5) < 0.8
    docs = spark.createDataFrame([(1, base), (2, between), (3, far)], "doc_id long, text string")
    assert {r.doc_id for r in corpus_pipeline.near_copies(spark, docs, SF).collect()} == {1, 3}


def test_near_copies_of_repeated_rows_and_rows_without_id(spark):
    a, b, c, d = (" ".join(f"{x}{i}" for i in range(60)) for x in "abcd")
    rows = [(1, a), (1, a), (2, a), (None, a), (None, b), (None, b), (None, b + " more"), (5, c), (5, c + " more"), (5, d),
            (6, ""), (6, ""), (7, ""), (None, None), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = [tuple(r) for r in corpus_pipeline.near_copies(spark, docs, SF).collect()]
    start = sorted(((i, (t or "")[:2]) for i, t in got), key=repr)
    assert start == sorted([(1, "a0"), (None, "b0"), (5, "c0"), (5, "d0"), (6, ""), (7, ""), (None, "")], key=repr)


def test_stages_keep_columns_named_like_an_operators(spark, tmp_path):
    rng = random.Random(2)
    text = lambda n: " ".join(f"w{rng.randint(0, 10**6)}" for _ in range(n)) + "."
    names = ["n_words", "kept", "n_lines", "n_removed", "leaks", "row", "id", "n_shingles", "component_id", "ids"]
    rows = [(i, text(60) + "\nsame line", "en", f"s{i % 13}", 7, *[f"{n}{i}" for n in names]) for i in range(15)] + [
        (None, None, None, None, None, *["x"] * len(names)), (20, "", "en", "s", 0, *["x"] * len(names))]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{n} string" for n in names)
    docs = spark.createDataFrame(rows, schema)
    spark.createDataFrame([(1, text(30))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for stage in (corpus_pipeline.quality, corpus_pipeline.lines, corpus_pipeline.near_copies, corpus_pipeline.benchmark_leaks):
        out = stage(spark, docs, str(tmp_path))
        assert out.schema.simpleString() == docs.schema.simpleString()
        got = {r.doc_id: r for r in out.collect()}
        assert set(range(15)) <= set(got) and all(got[i][n] == f"{n}{i}" for i in range(15) for n in names)
        empty = stage(spark, docs.limit(0), str(tmp_path))
        assert empty.columns == docs.columns and empty.count() == 0
    cut = {r.doc_id: r for r in corpus_pipeline.lines(spark, docs, str(tmp_path)).collect()}
    assert cut[0].text == rows[0][1] and cut[3].text == rows[3][1].split("\n")[0] and cut[3].n_chars == len(cut[3].text)
    tokens = corpus_pipeline.tokens(spark, docs, str(tmp_path)).collect()
    assert len(tokens) == len(rows) and all(r.round_trip for r in tokens)


def test_every_operator_has_a_query(spark):
    names = entry.queries()
    for n in range(1, 14):
        assert len([q for q in names if q.startswith(f"op{n}_")]) == 1
    assert "pipeline" in names and set(entry.oracle_sql()) <= set(names)


def test_contract_columns(spark):
    want = {"op1_": ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"],
            "op3_": ["doc_id", "n_bytes", "n_tokens", "over_limit"],
            "op4_": ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"],
            "op5_": ["doc_id", "n_words", "n_removed", "kept_sha256"],
            "op6_": ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            "op7_": ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"],
            "op8_": ["doc_id", "start", "n_tokens", "ids_crc32"], "op9_": ["doc_id", "n_shingles", "component_id"],
            "op11_": ["item_id", "rank", "doc_id", "score"], "op12_": ["lang", "rank", "phrase", "a", "l", "r", "n", "score"],
            "op13_": ["query_id", "rank", "vec_id", "score"]}
    for name, fn in entry.queries().items():
        for prefix, columns in want.items():
            if name.startswith(prefix):
                df = fn(spark, SF)
                assert set(columns) <= set(df.columns), name
                kinds = dict(df.dtypes)
                assert all(kinds[c] == "bigint" for c in columns if c.startswith("n_") or c in (
                    "doc_id", "page_id", "start", "component_id", "payload_bytes", "refers_to", "ids_crc32", "word_chars")), kinds
