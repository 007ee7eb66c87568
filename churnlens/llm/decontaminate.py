"""Benchmark decontamination: SimHash of item-sized windows, Hamming blocks, exact verification.

For every benchmark item a document's windows of as many words are compared with it (a shorter
document is one window). Words are lower-cased (A-Z); a window or item is the multiset of its
shingles of ``k`` words (an item of fewer words is one shingle), each weighted by its count. The
512-bit SimHash of a window is looked up in a multi-index over the items' fingerprints of that
size: 23 blocks of 22 or 23 bits, each matched within four bits, so every item within 114 bits is found
by the pigeonhole principle; of unrelated fingerprints one in twenty passes a block. At a similarity of
0.8 about 15 % of the bits differ, 78 on average, so the radius lies over four standard deviations
above it. Survivors are verified by exact weighted Jaccard similarity.

Fingerprints are only made of windows that can pass at all: of two multisets of m shingles with
similarity s, the overlap is at least 2 s m / (1 + s), so a window needs that many shingles that
occur in items of its size.

The benchmark is a query set, written in blocks of about ``block_bytes`` of text to the shared folder. A
task reads the blocks one at a time for each slice of its documents, in one pass over them and without any
shuffle; the driver knows the number of blocks only.

Defined cases: null or empty texts and items have no words and match nothing; repeated rows are
judged each, equal item ids are reported once with the best window; ties go to the first window; a
null item id is reported as null; other columns are kept, one named ``leaks`` replaced.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from churnlens.llm import text as tx
from churnlens.llm.registry import query, small_batches, table, text_bytes
from churnlens.llm.storage import file_system, new_folder

SHINGLE = 5
SIMILARITY = 0.8
BITS = 512
BLOCKS = 23
#: Bits of a block that may differ, and those that the blocks guarantee to bridge together.
NEAR = 4
RADIUS = BLOCKS * (NEAR + 1) - 1
#: Bytes of block differences compared at once.
COMPARE_BYTES = 16 << 20
#: Benchmark text that a task holds at once.
BLOCK_BYTES = 2 << 20
_FILTER_BITS = 22
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A"):ord("Z") + 1] += 32


def fingerprints(shingles: np.ndarray) -> np.ndarray:
    """SimHash (n x 64 bytes) of n rows of shingle hashes, each shingle weighted by its count."""
    n, m = shingles.shape
    out = np.empty((n, BITS // 8), np.uint8)
    step = max(1, (8 << 20) // (m * BITS))
    for i in range(0, n, step):
        h = np.ascontiguousarray(shingles[i:i + step])
        words = np.stack([h, *[tx.with_doc(h, np.full(h.shape, seed)) for seed in range(7, 6 + BITS // 64)]], -1)
        bits = np.unpackbits(words.view(np.uint8).reshape(len(h), m, BITS // 8), axis=2)
        out[i:i + step] = np.packbits(2 * bits.sum(1, dtype=np.int64) > m, axis=1)
    return out


def block_values(prints: np.ndarray) -> np.ndarray:
    """The fingerprints' blocks as numbers (n x BLOCKS)."""
    bits = np.unpackbits(prints, axis=1)
    edges = np.arange(BLOCKS + 1) * BITS // BLOCKS
    out = np.empty((len(prints), BLOCKS), np.uint32)
    for b, (i, j) in enumerate(zip(edges, edges[1:])):
        out[:, b] = bits[:, i:j].astype(np.uint32) @ (np.uint32(1) << np.arange(j - i, dtype=np.uint32))
    return out


def weighted_jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Sum of the smaller over sum of the larger counts of two multisets of hashes."""
    keys = np.concatenate([a, b])
    _, inverse = np.unique(keys, return_inverse=True)
    x, y = (np.bincount(part, minlength=inverse.max() + 1) for part in (inverse[:len(a)], inverse[len(a):]))
    return float(np.minimum(x, y).sum() / np.maximum(x, y).sum())


class _Size:
    """The items of one number of words: shingles, fingerprints and the block index."""

    def __init__(self, n_words: int, k: int, items: list[tuple[int | None, np.ndarray]], similarity: float):
        self.n_words, self.k, self.items = n_words, min(k, n_words), items
        self.m = n_words - self.k + 1
        self.shingles = np.unique(np.concatenate([s for _, s in items]))
        self.prints = fingerprints(np.stack([s for _, s in items]))
        self.blocks = block_values(self.prints)
        # Least shingles shared by a window of m, and by a shorter document.
        self.need = max(1, math.ceil(2 * similarity / (1 + similarity) * self.m - 1e-9))
        self.need_short = max(1, math.ceil(similarity * self.m - 1e-9))

    def candidates(self, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(window, item) pairs within the radius, in slices of bounded size on both sides."""
        mine, found = block_values(prints), [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
        wide = max(1, min(len(self.blocks), COMPARE_BYTES // (4 * BLOCKS)))
        tall = max(1, COMPARE_BYTES // (4 * BLOCKS * wide))
        for a in range(0, len(mine), tall):
            for b in range(0, len(self.blocks), wide):
                i, j = self.near(mine[a:a + tall], self.blocks[b:b + wide])
                close = np.bitwise_count(prints[a + i] ^ self.prints[b + j]).sum(1, dtype=np.int64) <= RADIUS
                found.append((a + i[close], b + j[close]))
        i, j = (np.concatenate(x) for x in zip(*found))
        return i, j

    @staticmethod
    def near(windows: np.ndarray, items: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of which some block differs in ``NEAR`` bits at most."""
        return np.nonzero((np.bitwise_count(windows[:, None] ^ items[None]) <= NEAR).any(2))


class Items:
    """One block of the benchmark."""

    def __init__(self, rows: list[tuple[int | None, str | None]], k: int, similarity: float):
        self.k, self.similarity = k, similarity
        data, off = tx.column_bytes(pa.array([t for _, t in rows], pa.string()))
        words = tx.words_of(_LOWER[data], off)
        wh = tx.word_hashes(words)
        sizes: dict[int, list[tuple[int | None, np.ndarray]]] = {}
        for (item, _), s, e in zip(rows, words.first, words.first[1:]):
            if e > s:
                kk = min(k, e - s)
                sizes.setdefault(int(e - s), []).append((item, tx.window_hashes(wh, np.arange(s, e - kk + 1), kk)))
        self.sizes = [_Size(n, k, items, similarity) for n, items in sorted(sizes.items())]
        self.by_k: dict[int, list[_Size]] = {}
        for size in self.sizes:
            self.by_k.setdefault(size.k, []).append(size)
        self.all = {kk: np.unique(np.concatenate([s.shingles for s in ss])) for kk, ss in self.by_k.items()}
        self.filter = {}
        for kk, hashes in self.all.items():
            f = np.zeros(1 << _FILTER_BITS, bool)
            f[(hashes >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)] = True
            self.filter[kk] = f

    def leaks(self, data: np.ndarray, off: np.ndarray) -> list[dict]:
        """For each document {item: (similarity, first word, words)}, the best window of each item found."""
        words = tx.words_of(_LOWER[data], off)
        wh, first = tx.word_hashes(words), words.first
        found: list[dict] = [{} for _ in range(len(off) - 1)]
        for kk, sizes in self.by_k.items():
            at = tx.window_starts(first, kk)
            h = tx.window_hashes(wh, at, kk)
            hit = np.flatnonzero(self.filter[kk][(h >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)])
            hit = hit[_member(h[hit], self.all[kk])]
            if not len(hit):
                continue
            by_word = np.zeros(len(wh), np.uint64)
            by_word[at] = h
            hit_at, hit_h = at[hit], h[hit]
            doc = np.searchsorted(first, hit_at, "right") - 1
            for size in sizes:
                mine = _member(hit_h, size.shingles)
                if mine.any():
                    self._size_leaks(size, hit_at[mine], doc[mine], first, by_word, found)
        return found

    def _size_leaks(self, size: _Size, at: np.ndarray, doc: np.ndarray, first: np.ndarray, by_word: np.ndarray,
                    found: list[dict]) -> None:
        # Runs of `need` hits that fit into one window give the starts of all windows with as many hits.
        ahead = size.need - 1
        if len(at) > ahead:
            p, q, d = at[:len(at) - ahead], at[ahead:], doc[:len(at) - ahead]
            lo = np.maximum(q - size.m + 1, first[d])
            hi = np.minimum(p, first[d + 1] - size.n_words)
            ok = (doc[ahead:] == d) & (hi >= lo)
            n = (hi - lo + 1)[ok]
            starts = np.unique(np.repeat(lo[ok] - (np.cumsum(n) - n), n) + np.arange(int(n.sum())))
            self._verify(size, starts, size.m, first, by_word, found)
        # Documents shorter than the item are one window.
        docs, hits = np.unique(doc, return_counts=True)
        length = first[docs + 1] - first[docs]
        for d in docs[(length < size.n_words) & (hits >= size.need_short)]:
            self._verify(size, first[d:d + 1], int(first[d + 1] - first[d]) - size.k + 1, first, by_word, found)

    def _verify(self, size: _Size, starts: np.ndarray, m: int, first: np.ndarray, by_word: np.ndarray,
                found: list[dict]) -> None:
        for a in range(0, len(starts), 4096):
            part = starts[a:a + 4096]
            shingles = by_word[part[:, None] + np.arange(m)]
            for i, j in zip(*size.candidates(fingerprints(shingles))):
                s = weighted_jaccard(shingles[i], size.items[j][1])
                if s >= self.similarity:
                    d = int(np.searchsorted(first, part[i], "right")) - 1
                    item, old = size.items[j][0], found[d].get(size.items[j][0])
                    if old is None or s > old[0]:
                        found[d][item] = (s, int(part[i] - first[d]), m + size.k - 1)


def _member(values: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    i = np.minimum(np.searchsorted(ordered, values), len(ordered) - 1)
    return ordered[i] == values


@lru_cache(maxsize=2)
def _items(folder: str, k: int, similarity: float) -> Items:
    """The items of one block's files."""
    store, path = file_system(folder)
    rows = []
    for f in store.get_file_info(pafs.FileSelector(path)):
        if f.path.endswith(".parquet"):
            with store.open_input_file(f.path) as file:
                t = pq.read_table(file, columns=["item", "text"])
            rows += zip(t["item"].to_pylist(), t["text"].to_pylist())
    return Items(sorted(rows, key=lambda r: (r[0] is None, r[0], r[1])), k, similarity)


tx.KEPT.append(_items.cache_clear)


_LEAK = T.StructType([T.StructField("item_id", T.LongType()), T.StructField("similarity", T.DoubleType()),
                      T.StructField("start", T.LongType()), T.StructField("n_words", T.LongType())])


def find_leaks(df: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id",
               item_text_col: str = "text", k: int = SHINGLE, similarity: float = SIMILARITY,
               block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Add ``leaks``: array of (item_id, similarity, start, n_words), the best window of each matched item."""
    out = small_batches(df.drop("leaks"))
    schema = T.StructType([*out.schema.fields, T.StructField("leaks", T.ArrayType(_LEAK))])
    kind = pa.list_(pa.struct([("item_id", pa.int64()), ("similarity", pa.float64()), ("start", pa.int64()),
                               ("n_words", pa.int64())]))
    items = benchmark.select(F.col(item_col).cast("long").alias("item"), F.col(item_text_col).alias("text")).filter(
        F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    n_blocks = text_bytes(items) // block_bytes + 1
    folder = new_folder(df.sparkSession, "benchmark")
    block = F.pmod(F.xxhash64("item", "text"), F.lit(n_blocks))
    items.withColumn("block", block).repartition("block").write.partitionBy("block").parquet(folder)
    filled = sorted(r.block for r in df.sparkSession.read.schema("item long, text string, block long").parquet(folder)
                    .select("block").distinct().collect())         # numbers of blocks
    if not filled:
        return out.withColumn("leaks", F.lit(None).cast(schema["leaks"].dataType))
    return out.mapInArrow(_scan([f"{folder}/block={b}" for b in filled], text_col, k, similarity, kind), schema)


def _scan(folders: list[str], text_col: str, k: int, similarity: float, kind: pa.DataType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tx.release()
        for whole in batches:
            for b in tx.slices(whole, text_col):
                data, off = tx.column_bytes(b.column(b.schema.get_field_index(text_col)))
                best: list[dict] = [{} for _ in range(b.num_rows)]
                for folder in folders:
                    for mine, new in zip(best, _items(folder, k, similarity).leaks(data, off)):
                        mine.update({i: x for i, x in new.items() if i not in mine or x[0] > mine[i][0]})
                leaks = [[{"item_id": i, "similarity": s, "start": a, "n_words": n} for i, (s, a, n) in x.items()] or None for x in best]
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(leaks, kind)], [*b.schema.names, "leaks"])
    return run


@query("op10_decontaminate")
def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every pair of a document and a benchmark item that it holds: similarity and place of the best window."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return find_leaks(docs, table(spark, sf_dir, "benchmark")).select("doc_id", F.explode("leaks").alias("leak")).select(
        "doc_id", "leak.item_id", "leak.similarity", F.col("leak.start").alias("start_word"), "leak.n_words")
