"""op3, op6, op8: token counts, exact BPE and packed files against the tokenizers library."""
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from llm.conftest import clash
from tokenizers import Tokenizer

from churnlens.llm import bpe, packing, tokencount
from churnlens.llm.registry import tokenizer_path
from churnlens.llm.storage import new_folder
from churnlens.llm.units import UnitCache

ALPHABET = "aabbcdeΣσAÉ    \n\t\r\x1c\x85\xa0'sreléñß1234²½中文😀!?.,<|endoftext|>_-ıŸ́‍"


def texts(n, seed=5, longest=60):
    rng = random.Random(seed)
    out = ["", "a", " ", "  a", "a  b", "x <|endoftext|> y", "<|endoftext|>", "a\n", "\n a", "foo\n bar", "a" * 300, "ab" * 50,
           " " * 77 + "x", "1" * 100, "don't we'll they're"]
    out += ["".join(rng.choice(ALPHABET) for _ in range(rng.randint(1, longest))) for _ in range(n)]
    return out + [" ".join(rng.choice(["<|endoftext|>", "don't", "naïve,", "aaaaaaaaaa", "foo\nbar", "foo\n", "\nfoo", "x ", "The."])
                           for _ in range(8)) for _ in range(n // 5)]


@pytest.fixture(scope="module")
def byte_level():
    return Tokenizer.from_file(tokenizer_path(bpe.VOCABULARY))


def test_backtracking_encoder_is_exact(byte_level):
    ts = texts(5000)
    v, table = bpe.Vocabulary(tokenizer_path(bpe.VOCABULARY)), bpe.OffsetTable(tokenizer_path(bpe.VOCABULARY))
    for t, e, got in zip(ts, byte_level.encode_batch(ts, add_special_tokens=False), v.encode(ts)):
        ids = np.frombuffer(got, "<u4")
        assert ids.tolist() == e.ids, t
        assert table.decode(ids.astype(np.int64))[0].tobytes().decode("utf-8", "replace") == byte_level.decode(
            e.ids, skip_special_tokens=False)


def test_every_token_encodes_as_the_library_does(byte_level):
    v = bpe.Vocabulary(tokenizer_path(bpe.VOCABULARY))
    table = bpe.OffsetTable(tokenizer_path(bpe.VOCABULARY))
    sample = [table.blob[table.offset[i]:table.offset[i + 1]].tobytes() for i in range(0, v.size - 1, 37)]
    ts = [b.decode() for b in sample if b.decode("utf-8", "ignore").encode() == b]
    assert [np.frombuffer(x, "<u4").tolist() for x in v.encode(ts)] == [
        e.ids for e in byte_level.encode_batch(ts, add_special_tokens=False)]


@pytest.mark.parametrize("chunk, overlap", [(40, 8), (100, 4), (300, 30)])
def test_spliced_counts(byte_level, chunk, overlap):
    ts = texts(400, seed=chunk, longest=1500) + ["a" * 5000, " " * 3000, "ab " * 900]
    c = tokencount.Counter(tokenizer_path(tokencount.TOKENIZER), chunk, overlap)
    assert c.count(ts) == [len(e.ids) for e in byte_level.encode_batch(ts, add_special_tokens=False)]
    assert c.widened > 0


def test_counts_of_other_tokenizers():
    import sentencepiece
    ts = texts(300)
    word = Tokenizer.from_file(tokenizer_path("word_bpe_49k.json"))
    c = tokencount.Counter(tokenizer_path("word_bpe_49k.json"), 40, 8)
    assert c.count(ts) == [len(e.ids) for e in word.encode_batch(ts, add_special_tokens=False)]
    piece = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path("piece_bpe_32k.model"))
    assert tokencount.Counter(tokenizer_path("piece_bpe_32k.model"), 40, 8).count(ts) == [len(x) for x in piece.encode(ts)]


def test_word_encoder_is_exact():
    ts = texts(5000)
    word = Tokenizer.from_file(tokenizer_path(packing.TOKENIZER))
    e = packing.Encoder(tokenizer_path(packing.TOKENIZER))
    assert e.local
    want = [x.ids for x in word.encode_batch(ts, add_special_tokens=False)]
    for i in range(0, len(ts), 700):     # with and without added tokens in a column
        ids, off = e.encode(pa.array(ts[i:i + 700]))
        assert [ids[s:t].tolist() for s, t in zip(off, off[1:])] == want[i:i + 700]
    plain = [t for t in ts if "<|" not in t] + [None]
    ids, off = e.encode(pa.array(plain))
    assert [ids[s:t].tolist() for s, t in zip(off, off[1:])] == [
        x.ids for x in word.encode_batch([t or "" for t in plain], add_special_tokens=False)]


def test_small_caches_forget_but_stay_right():
    seen = []
    cache = UnitCache(lambda units: [seen.append(u) or len(u) for u in units], limit=8)
    for i in range(50):
        keys = {f"k{i}", f"k{i // 10}", ""}
        got = cache.fill(keys)
        assert got[f"k{i}"] == len(f"k{i}") and got[""] is ... and len(cache.young) <= 8
    assert len(seen) >= 50


@pytest.mark.parametrize("bits", [1, 5, 8, 15, 16, 17, 32])
def test_pack_round_trip(bits):
    ids = np.random.default_rng(bits).integers(0, 1 << min(bits, 31), 1001).astype(np.uint32)
    assert (packing.unpack(packing.pack(ids, bits), bits, len(ids)) == ids).all()
    assert packing.bits_for(1 << min(bits, 31)) == min(bits, 31)


def test_random_access(tmp_path):
    rng = np.random.default_rng(0)
    docs = [rng.integers(0, 50_000, n).astype(np.uint32) for n in (0, 5, 1000, 1, 0, 333)]
    w = packing.PackWriter(f"{tmp_path}/x.ids", 17, block=64)
    for i, ids in enumerate(docs):
        w.add([i or None], ids, np.array([0, len(ids)]))
    w.close()
    r = packing.PackReader(f"{tmp_path}/x.ids")
    assert r.doc_ids == [None, 1, 2, 3, 4, 5] and r.bits == 17
    for k in (2, 0, 5, 3):
        assert (r.document(k) == docs[k]).all()
    everything = np.concatenate(docs)
    for s, e in ((0, 0), (63, 65), (10, 1339), (128, 192)):
        assert (r.ids(s, e) == everything[s:e]).all()


def test_packed_documents_in_order(spark, tricky):
    path = tokenizer_path(packing.TOKENIZER)
    files = packing.write_ids(clash(tricky, "file", "start"), path, new_folder(spark, "test"), end_id=1, block=64)
    word = Tokenizer.from_file(path)
    want = {}
    for r in tricky.collect():
        ids = np.array([*word.encode(r.text or "", add_special_tokens=False).ids, 1], "<u4")
        want.setdefault(r.doc_id, []).append((len(ids), zlib.crc32(ids.tobytes())))
    got = sorted(packing.digests(files).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == sorted((r.doc_id for r in tricky.collect()), key=lambda d: (d is not None, d))
    at = 0
    for r in got:
        assert r.start == at and (r.n_tokens, r.ids_crc32) in want[r.doc_id]
        at += r.n_tokens
    read = {(r.doc_id, r.start): len(r.ids) for r in packing.read_ids(files).collect()}
    assert read == {(r.doc_id, r.start): r.n_tokens for r in got}
    none = packing.write_ids(tricky.limit(0), path, new_folder(spark, "test"), end_id=1)
    assert none.count() == 0 and packing.digests(none).count() == 0 and packing.read_ids(none).count() == 0


def test_columns(spark, tricky, byte_level):
    path = tokenizer_path(bpe.VOCABULARY)
    counted = tokencount.token_counts(clash(tricky, "n_tokens", "over_limit"), path, limit=4)
    round_trip = bpe.decode(bpe.encode(clash(tricky, "ids", "decoded"), path), path)
    for r in counted.collect():
        n = len(byte_level.encode(r.text or "").ids)
        assert (r.n_tokens, r.n_bytes, r.over_limit) == (n, len((r.text or "").encode()), n > 4)
    once = bpe.round_trip(clash(tricky, "ids", "decoded"), path)
    assert once.columns == round_trip.columns
    for r in [*round_trip.collect(), *once.collect()]:
        assert r.ids == byte_level.encode(r.text or "").ids and r.decoded == (r.text or "")
    assert tokencount.token_counts(tricky.limit(0), path).count() == 0
    assert bpe.decode(bpe.encode(tricky.limit(0), path), path).count() == 0


def test_unit_cache_is_bounded_in_characters(monkeypatch):
    from churnlens.llm import units
    monkeypatch.setattr(units, "CACHE_CHARS", 10_000)
    cache = units.UnitCache(lambda us: [len(u) for u in us], limit=1000)
    rng = random.Random(1)
    for _ in range(50):
        keys = {rng.choice("abc") * rng.randint(1, 3000) for _ in range(4)}
        got = cache.fill(keys)
        assert {k: got[k] for k in keys} == {k: len(k) for k in keys}
        # Two generations of half the bound each, and what the last call brought.
        assert sum(map(len, cache.young)) + sum(map(len, cache.old)) <= 10_000 + 4 * 3000 * 2


def test_units_of_megabytes_round_trip(spark):
    texts = ["x" * 3_000_000, "ab" * 1_000_000 + " tail", "y" * 3_000_000 + " " + "z" * 10]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in bpe.round_trip(df, tokenizer_path(bpe.VOCABULARY), cache_units=10).collect()}
    lib = Tokenizer.from_file(tokenizer_path(bpe.VOCABULARY))
    for i, t in enumerate(texts):
        assert got[i].ids == lib.encode(t, add_special_tokens=False).ids and got[i].decoded == t
