"""Exact byte-level BPE by backtracking over longest token matches, and decoding by an offset table.

``Vocabulary`` reads a byte-level BPE file of the ``tokenizers`` library. A word's encoding is
the only sequence of tokens in which every two neighbours are compatible, that is, in which
merging the two tokens' bytes alone gives them back. The encoder walks a word with the longest
token that an Aho-Corasick automaton finds at each position, takes it if it is compatible with
the token before it, else tries the next shorter token that is a prefix of it, else steps back
and closes the position; each position is closed at most once, so the work is linear in the
word. Whether two tokens are compatible is looked up in a table that is filled on demand.

Defined cases: a null or empty text has no ids and decodes to the empty text; repeated rows are
encoded each; other columns are kept.
"""

from __future__ import annotations

import json
import struct
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from churnlens.llm import text as tx
from churnlens.llm.registry import query, small_batches, table, tokenizer_path
from churnlens.llm.units import CACHE_UNITS, UnitCache, added_tokens_are_local, combined_units

VOCABULARY = "byte_bpe_50k.json"
#: Entries of the pair table kept by one worker.
PAIR_ENTRIES = 300_000
_NEVER = 1 << 60


def _packed(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


def byte_chars() -> dict[str, int]:
    """The printable stand-in of each byte in byte-level vocabulary files."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class OffsetTable:
    """Decoding: the bytes of id i are blob[offset[i]:offset[i + 1]]."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        chars = byte_chars()
        tokens = {i: bytes(chars[c] for c in s) for s, i in spec["model"]["vocab"].items()}
        tokens |= {t["id"]: t["content"].encode() for t in spec.get("added_tokens") or []}
        table_ = [tokens.get(i, b"") for i in range(max(tokens) + 1)]
        self.blob = np.frombuffer(b"".join(table_), np.uint8)
        self.offset = np.concatenate([[0], np.cumsum([len(b) for b in table_])]).astype(np.int64)

    def decode(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(bytes of all ids, length of each id's bytes)."""
        start = self.offset[ids]
        size = self.offset[ids + 1] - start
        stop = np.cumsum(size)
        total = int(stop[-1]) if len(stop) else 0
        at = np.repeat(start - (stop - size), size) + np.arange(total)
        return self.blob[at], size

    def texts(self, ids: np.ndarray, off: np.ndarray) -> list[str]:
        """The texts of the ids between the offsets; bytes that are not UTF-8 become U+FFFD."""
        data, size = self.decode(ids)
        ends = np.concatenate([[0], np.cumsum(size)])[off]
        whole = data.tobytes()
        return [whole[s:e].decode("utf-8", "replace") for s, e in zip(ends, ends[1:])]


class Vocabulary:
    """Tokens, merges, automaton, prefix table and pair table of one file."""

    def __init__(self, path: str, cache_units: int = CACHE_UNITS):
        import ahocorasick
        import regex

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, pre = spec["model"], spec.get("pre_tokenizer") or {}
        if model["type"] != "BPE" or pre.get("type") != "ByteLevel" or spec.get("normalizer") or model.get("dropout") \
                or model.get("ignore_merges") or pre.get("add_prefix_space") or not pre.get("use_regex", True):
            raise ValueError(f"{path} is not a plain byte-level BPE file")
        if not added_tokens_are_local(path):
            raise ValueError(f"{path} has added tokens that take in white space")
        chars = byte_chars()
        vocab: dict[str, int] = model["vocab"]
        raw = {i: bytes(chars[c] for c in s) for s, i in vocab.items()}
        self.added = {t["content"]: t["id"] for t in spec.get("added_tokens") or []}
        self.size = max([*raw, *self.added.values()]) + 1

        self.merge: dict[tuple[int, int], int] = {}            # pair -> rank
        self.made = np.full(self.size, -1).tolist()            # token -> rank of its merge
        self.halves: list[tuple[int, int] | None] = [None] * self.size
        for rank, m in enumerate(model["merges"]):
            a, b = m.split(" ") if isinstance(m, str) else m
            left, right, whole = vocab[a], vocab[b], vocab[a + b]
            self.merge[left, right] = rank
            if self.halves[whole] is None:
                self.made[whole], self.halves[whole] = rank, (left, right)
            if max(self.made[left], self.made[right]) > rank:
                raise ValueError("a merge uses a token that is made later")
        self.pairs: dict[int, bool] = {}                       # left * size + right -> compatible
        # Tokens that the merges of their own bytes give: the others never occur in an encoding.
        alive = {i for i, b in raw.items() if len(b) == 1}
        for i in sorted((i for i in raw if self.halves[i]), key=self.made.__getitem__):
            left, right = self.halves[i]
            if left in alive and right in alive and not self._merges_early(left, right, self.made[i]):
                alive.add(i)
        self.length = [len(raw.get(i, b"")) for i in range(self.size)]
        self.automaton = ahocorasick.Automaton()
        for i in alive:
            self.automaton.add_word(raw[i].decode("latin-1"), i)
        self.automaton.make_automaton()
        by_bytes = {raw[i]: i for i in alive}
        self.prefix = [-1] * self.size
        for i in alive:
            b = raw[i]
            self.prefix[i] = next((by_bytes[b[:n]] for n in range(len(b) - 1, 0, -1) if b[:n] in by_bytes), -1)
        self.whole = {b.decode("latin-1"): i for b, i in by_bytes.items()}
        # The pre-tokens of byte-level BPE (fixed pattern of the file format).
        self.pre_tokens = regex.compile(
            r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+").findall
        self.split_added = regex.compile("(" + "|".join(map(regex.escape, sorted(self.added, key=len, reverse=True)))
                                         + ")").split if self.added else None
        self.added_starts = {s[0] for s in self.added}
        self.words = UnitCache(lambda ws: [self._word_bytes(w) for w in ws], cache_units)
        self.units = UnitCache(lambda us: self._encode_raw([" " + u for u in us]), cache_units)

    def _merges_early(self, a: int, b: int, before: int) -> bool:
        """True if some merge joins bytes of token a to bytes of b at a rank below ``before``.

        Walks back in time over the last part of a and the first part of b: a part lives from
        the rank that makes it to the rank that takes it into the next larger part.
        """
        made, halves, merge = self.made, self.halves, self.merge
        a_taken = b_taken = before
        while True:
            rank = merge.get((a, b))
            # Equal ranks mean equal pairs, of which the left one is merged first.
            if rank is not None and rank < a_taken and (rank <= b_taken if b_taken < before else rank < b_taken):
                return True
            if made[a] > made[b]:
                a_taken, a = made[a], halves[a][1]
            elif made[b] >= 0:
                b_taken, b = made[b], halves[b][0]
            else:
                return False

    def compatible(self, a: int, b: int) -> bool:
        """True if the encoding of the two tokens' bytes is the two tokens; kept in the pair table."""
        if len(self.pairs) >= PAIR_ENTRIES:
            self.pairs.clear()
        got = self.pairs[a * self.size + b] = not self._merges_early(a, b, _NEVER)
        return got

    def encode_word(self, word: str) -> list[int]:
        """Ids of one pre-token, given as its bytes in latin-1."""
        i = self.whole.get(word)
        if i is not None:
            return [i]
        n, length, prefix, pairs, size = len(word), self.length, self.prefix, self.pairs, self.size
        longest = [-1] * n
        for end, i in self.automaton.iter(word):
            longest[end - length[i] + 1] = i    # ends ascend: the longest comes last
        opened = bytearray(b"\1") * (n + 1)
        out: list[int] = []
        at, i = 0, longest[0]
        while True:
            end = at + length[i]
            if opened[end]:
                fits = True
                if out:
                    fits = pairs.get(out[-1] * size + i)
                    if fits is None:
                        fits = self.compatible(out[-1], i)
            else:
                fits = False
            if fits:
                out.append(i)
                if end == n:
                    return out
                at, i = end, longest[end]
            elif prefix[i] >= 0:
                i = prefix[i]
            else:
                opened[at] = 0
                i = out.pop()
                at -= length[i]

    def _word_bytes(self, word: str) -> bytes:
        return _packed(self.encode_word(word.encode().decode("latin-1")))

    def _encode_raw(self, texts: list[str]) -> list[bytes]:
        """Little-endian 32-bit ids of each text as it is."""
        out, cached, pre_tokens = [], self._cached, self.pre_tokens
        for t in texts:
            if self.added_starts.isdisjoint(t):
                out.append(b"".join([cached(w) for w in pre_tokens(t)]))
            else:   # odd pieces are added tokens
                out.append(b"".join([_packed([self.added[piece]]) if j % 2 else
                                     b"".join([cached(w) for w in pre_tokens(piece)])
                                     for j, piece in enumerate(self.split_added(t))]))
        return out

    def _cached(self, word: str) -> bytes:
        c = self.words
        got = c.young.get(word)
        if got is None:
            got = c.old.get(word) or self._word_bytes(word)
            if not c.room(1, len(word)):
                c.age()
            c.young[word] = got
            c.chars += len(word)
        return got

    def encode(self, texts: list[str]) -> Iterator[bytes]:
        """Little-endian 32-bit ids of each text."""
        return combined_units(texts, self.units, self._encode_raw, b"".join)


@lru_cache(maxsize=2)
def vocabulary(path: str, cache_units: int = CACHE_UNITS) -> Vocabulary:
    return Vocabulary(path, cache_units)


@lru_cache(maxsize=2)
def offset_table(path: str) -> OffsetTable:
    return OffsetTable(path)


tx.KEPT += [vocabulary.cache_clear, offset_table.cache_clear]


def _encoded(v: Vocabulary, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(ids, offsets) of a column of texts."""
    ids = list(v.encode([t or "" for t in texts.to_pylist()]))
    return np.frombuffer(b"".join(ids), "<u4"), np.cumsum([0, *(len(x) // 4 for x in ids)]).astype(np.int32)


def _with_columns(df: DataFrame, run, added: list[T.StructField]) -> DataFrame:
    base = df.drop(*[f.name for f in added])
    return small_batches(base).mapInArrow(run, T.StructType([*base.schema.fields, *added]))


def encode(df: DataFrame, path: str, text_col: str = "text", ids_col: str = "ids") -> DataFrame:
    """Add ``ids_col`` (array<int>), the token ids of the text; an equal-named column is replaced."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(path)
        for whole in batches:
            for b in tx.slices(whole, text_col):
                ids, off = _encoded(v, b.column(b.schema.get_field_index(text_col)))
                lists = pa.ListArray.from_arrays(pa.array(off), pa.array(ids.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([*b.columns, lists], [*b.schema.names, ids_col])

    return _with_columns(df, run, [T.StructField(ids_col, T.ArrayType(T.IntegerType(), False), False)])


def decode(df: DataFrame, path: str, ids_col: str = "ids", text_col: str = "decoded") -> DataFrame:
    """Add ``text_col``, the text of the ids; byte sequences that are not UTF-8 become U+FFFD."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table_ = offset_table(path)
        for b in batches:
            lists = b.column(b.schema.get_field_index(ids_col))
            step = 1 + int((1 << 20) * max(len(lists), 1) / max(len(lists.flatten()), 1))
            for at in range(0, b.num_rows, step):
                part = b.slice(at, step)
                col = part.column(part.schema.get_field_index(ids_col))
                off = np.concatenate([[0], np.cumsum(np.asarray(col.value_lengths().fill_null(0)))])
                texts = table_.texts(np.asarray(col.flatten()), off)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.string())],
                                                 [*part.schema.names, text_col])

    return _with_columns(df, run, [T.StructField(text_col, T.StringType(), False)])


def round_trip(df: DataFrame, path: str, text_col: str = "text", ids_col: str = "ids",
               decoded_col: str = "decoded", cache_units: int = CACHE_UNITS) -> DataFrame:
    """``encode`` and ``decode`` in one pass, which saves the ids a way through a second worker.

    A worker keeps the ids of at most ``cache_units`` units and as many words."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, table_ = vocabulary(path, cache_units), offset_table(path)
        for whole in batches:
            for b in tx.slices(whole, text_col):
                ids, off = _encoded(v, b.column(b.schema.get_field_index(text_col)))
                lists = pa.ListArray.from_arrays(pa.array(off), pa.array(ids.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([*b.columns, lists, pa.array(table_.texts(ids, off), pa.string())],
                                                 [*b.schema.names, ids_col, decoded_col])

    return _with_columns(df, run, [T.StructField(ids_col, T.ArrayType(T.IntegerType(), False), False),
                                   T.StructField(decoded_col, T.StringType(), False)])


@query("op6_bpe_roundtrip")
def op6_bpe_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded and decoded; digests of the ids and of the decoded text."""
    docs = round_trip(table(spark, sf_dir, "documents").select("doc_id", "text"), tokenizer_path(VOCABULARY))
    return docs.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join("ids", ","), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded"), 256).alias("decoded_sha256"))
