"""N-gram Jaccard join: documents whose shingle sets are alike, and their connected components.

A document's set holds its distinct shingles of ``k`` words (A-Z lower-cased). Documents with equal
sets form a class. Two classes link when ``100 * common >= percent * union``.

1. Chunks of documents send short keys of their shingles, packed by bucket; buckets count them and
   answer with two bits for each (in one document, up to ``RARE``, up to ``COMMON``, more) and with
   how common the common ones are. Shingles are ordered rare ones first; a class's prefix, its first
   ``n - ceil(percent n / 100) + 1`` shingles in that order, shares a shingle with the prefix of every
   class it links with. Shingles that no other document has come first, so a text of which more
   than the allowed part is its own meets no other at all.
2. The (prefix shingle, class) pairs, packed by bucket, are searched for shingles that two classes
   share. Classes with such shingles go on with their count vectors: the number of shingles in
   each of about n / 8 hash groups.
3. Its rarest and its most common shared shingles link each class with one centre per shingle, the
   class whose shingles are the most common on average: of copies with changes of their own that
   is the text without any. Verified links collapse groups of near copies to components, so no
   group is expanded into all its pairs.
4. Classes of different components that share a prefix shingle, at places from which on their sets are
   long enough to link (of their first common shingle the rest of each bounds the overlap), are searched by an R-tree of their
   count vectors (folded to ``GROUPS`` groups): a node's largest counts bound the overlap with any
   class below it by the sum of the smaller coordinates. Larger groups are dealt into blocks of about
   ``BLOCK`` classes; each pair of blocks is searched by itself, but not two blocks of one component.
5. A pair is verified only if the full count vectors' bound lets it link. The texts of the classes in
   such pairs are found by a bitmap of fixed size and a join; their sets meet at one of the two,
   split into parts where very many do, and are intersected.

Shingles and classes are known by 64-bit hashes.

Defined cases: a null text or one without words has an empty set, n_shingles 0, links with nothing
and is its own component; fewer than k words are one shingle; rows with a null id take part in links
but get a null component; repeated rows belong to one component; rows are judged by their own text,
also where ids repeat; other columns are kept, those named like the result's replaced.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from churnlens.llm import text as tx
from churnlens.llm.components import connected_components
from churnlens.llm.decontaminate import _LOWER
from churnlens.llm.registry import query, small_batches, table, text_bytes
from churnlens.llm.storage import new_folder

SHINGLE = 4
PERCENT = 85
GROUPS = 256
#: Shingles in a group of a count vector, on average.
PER_GROUP = 8
#: Documents above which a shingle is not rare any more, and above which it is common; each doubling from there is
#: a class of its own.
RARE = 4
COMMON = 32
#: Bits of a shingle's key within its bucket, for the counts only.
_KEY_BITS = 24
#: Text bytes that a chunk of documents and a bucket of shingles are planned for. A chunk sends a
#: row to every bucket, so raise both with the executors' memory on very large corpora.
CHUNK_BYTES = 4 << 20
BUCKET_BYTES = 16 << 20
#: Rarest and most common shared shingles by which a class looks for centres.
CENTRES = 2
FANOUT = 16
#: Classes of a group that are searched at once; larger groups are dealt into blocks of this size.
BLOCK = 1 << 14
#: Pairs of queries and nodes that a search starts from, and pairs that it holds before it sends them.
SEARCH_PAIRS = 1 << 20
#: Partners of a class that one part of its verification is planned for.
PARTNERS = 256
#: Places to which one row sends its class's set; a class with more has several rows.
TARGETS = 256
#: Bits of the map of rows whose texts are wanted (its size does not depend on the data).
WANTED_BITS = 23


def _shingle_hashes(data: np.ndarray, off: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, document) of every shingle; a document of 1 to k - 1 words has one of its own."""
    words = tx.words_of(_LOWER[data], off)
    wh, first = tx.word_hashes(words), words.first
    at = tx.window_starts(first, k)
    hashes, docs = [tx.window_hashes(wh, at, k)], [tx.word_docs(first)[at]]
    n = np.diff(first)
    for short in range(1, k):
        d = np.flatnonzero(n == short)
        hashes.append(tx.window_hashes(wh, first[d], short))
        docs.append(d)
    return np.concatenate(hashes), np.concatenate(docs)


def shingle_sets(data: np.ndarray, off: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hashes, documents, first): each document's distinct shingles, ascending, and where they start."""
    h, doc = _shingle_hashes(data, off, k)
    order = np.argsort(h)
    order = order[np.argsort(doc[order], kind="stable")]
    h, doc = h[order], doc[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    h, doc = h[new], doc[new]
    return h, doc, np.searchsorted(doc, np.arange(len(off)))


def pack_keys(keys: np.ndarray) -> tuple[bytes, bytes]:
    """Ascending keys as 16-bit differences; larger ones are marked and kept aside."""
    d = np.diff(keys, prepend=0)
    large = d >= 0xFFFF
    return np.where(large, 0xFFFF, d).astype("<u2").tobytes(), d[large].astype("<u4").tobytes()


def unpack_keys(small: bytes, large: bytes) -> np.ndarray:
    d = np.frombuffer(small, "<u2").astype(np.int64)
    d[d == 0xFFFF] = np.frombuffer(large, "<u4")
    return np.cumsum(d)


def count_vector(names: np.ndarray) -> np.ndarray:
    """Shingles by hash group; the number of groups is a power of 2 of at least GROUPS."""
    groups = max(GROUPS, 1 << max(0, len(names) // PER_GROUP - 1).bit_length())
    return np.bincount((names & np.uint64(groups - 1)).astype(np.int64), minlength=groups).astype("<u4")


def fold(vec: np.ndarray, groups: int = GROUPS) -> np.ndarray:
    """The count vector over fewer groups."""
    return vec.reshape(-1, groups).sum(0, dtype=np.uint32)


class _Sets:
    """Shingle sets of a chunk of documents, in a fixed order, and the keys that it counts them by."""

    def __init__(self, texts: pa.ChunkedArray, k: int, n_buckets: int):
        self.h, self.doc, self.first = shingle_sets(*tx.column_bytes(texts), k)
        self.n = np.diff(self.first)
        bucket = (tx._mix(self.h) % np.uint64(n_buckets)).astype(np.int64)
        keys = (bucket << _KEY_BITS) | (self.h >> np.uint64(64 - _KEY_BITS)).astype(np.int64)
        self.keys, self.key, self.count = np.unique(keys, return_inverse=True, return_counts=True)
        self.buckets, self.starts = np.unique(self.keys >> _KEY_BITS, return_index=True)
        self.stops = np.append(self.starts[1:], len(self.keys))
        with np.errstate(over="ignore"):
            total = np.concatenate([[np.uint64(0)], np.cumsum(tx._mix(self.h), dtype=np.uint64)])
            self.cls = tx._mix(total[self.first[1:]] - total[self.first[:-1]] + self.n.astype(np.uint64)).view(np.int64)
        # One document carries its class: the first with a set.
        full = np.flatnonzero(self.n > 0)
        _, at = np.unique(self.cls[full], return_index=True)
        self.carriers = np.sort(full[at])

    def prefixes(self, frequency: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(shingle, frequency class, class of sets, shingles from it on) of the carriers' prefixes, rare
        shingles first."""
        f = frequency[self.key]
        order = np.argsort((f.astype(np.uint64) << np.uint64(58)) | (self.h >> np.uint64(6)))
        order = order[np.argsort(self.doc[order], kind="stable")]
        p = self.n[self.carriers]
        p = p - -(-percent * p // 100) + 1
        stop = np.cumsum(p)
        place = np.arange(int(p.sum())) - np.repeat(stop - p, p)
        at = order[np.repeat(self.first[self.carriers], p) + place]
        rest = (np.repeat(self.n[self.carriers], p) - place).astype("<u4")
        return self.h[at], f[at], np.repeat(self.cls[self.carriers], p), rest


def pack_levels(levels: np.ndarray) -> bytes:
    """Two bits a value."""
    return np.packbits(np.stack([levels & 1, levels >> 1]).astype(bool).ravel()).tobytes()


def unpack_levels(raw: bytes, n: int) -> np.ndarray:
    bits = np.unpackbits(np.frombuffer(raw, np.uint8), count=2 * n)
    return bits[:n] + 2 * bits[n:]


def _sorted_by_id(t: pa.Table) -> pa.Table:
    tx.release()
    return t.take(pa.compute.sort_indices(t, [("order", "ascending"), ("t", "ascending")]))


def _dealt(df: DataFrame, id_col: str, text_col: str, k: int, percent: int, chunk_bytes: int,
           bucket_bytes: int) -> DataFrame:
    """Two kinds of rows. For each document its row, key, number of shingles, class, mean frequency of
    its shingles and, on one row a chunk and class, the count vector; for each chunk and bucket its prefix shingles (hash,
    frequency class, class of sets)."""
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    size = text_bytes(df, text_col)
    n, n_buckets = size // chunk_bytes + 1, size // bucket_bytes + 1
    rest = [c for c in df.columns if c not in (text_col, "n_shingles", "component_id")]
    dealt = df.select(F.struct(*[F.col(f"`{c}`") for c in rest]).alias("row"), F.col(text_col).alias("t"),
                      F.xxhash64(id_col).alias("order"), F.xxhash64(id_col, text_col).alias("key"),
                      F.pmod(F.xxhash64(id_col, text_col), F.lit(n)).alias("chunk"))
    dealt = dealt.repartition(parts, "chunk")

    def weigh(t: pa.Table) -> pa.Table:
        s = _Sets(_sorted_by_id(t)["t"], k, n_buckets)
        packed = [pack_keys(s.keys[i:j] & ((1 << _KEY_BITS) - 1)) for i, j in zip(s.starts, s.stops)]
        return pa.table({"bucket": pa.array(s.buckets, pa.int64()), "chunk": pa.array([t["chunk"][0].as_py()] * len(packed), pa.int64()),
                         "small": pa.array([x for x, _ in packed], pa.binary()), "large": pa.array([x for _, x in packed], pa.binary()),
                         "counts": pa.array([s.count[i:j].astype("<u4").tobytes() for i, j in zip(s.starts, s.stops)], pa.binary())})

    def count(t: pa.Table) -> pa.Table:
        keys = [unpack_keys(x, y) for x, y in zip(t["small"].to_pylist(), t["large"].to_pylist())]
        counts = np.frombuffer(b"".join(t["counts"].to_pylist()), "<u4")
        names, at = np.unique(np.concatenate(keys), return_inverse=True)
        total = np.bincount(at, counts, minlength=len(names))
        classes = np.where(total > COMMON, 3 + np.floor(np.log2(np.maximum(total, 1) / COMMON)),
                           (total > 1).astype(np.int64) + (total > RARE)).astype(np.uint8)[at]
        out = {"chunk": [], "bucket": [], "levels": [], "places": [], "classes": []}
        for chunk, bucket, own in zip(t["chunk"].to_pylist(), t["bucket"].to_pylist(),
                                      np.split(classes, np.cumsum([len(x) for x in keys])[:-1])):
            places = np.flatnonzero(own >= 3)
            if own.any():
                for name, value in zip(out, (chunk, bucket, pack_levels(np.minimum(own, 3)), places.astype("<u4").tobytes(),
                                             own[places].tobytes())):
                    out[name].append(value)
        return pa.table(out, schema=pa.schema([("chunk", pa.int64()), ("bucket", pa.int64()), ("levels", pa.binary()),
                                               ("places", pa.binary()), ("classes", pa.binary())]))

    def collect(t: pa.Table, answers: pa.Table) -> pa.Table:
        t = _sorted_by_id(t)
        s = _Sets(t["t"], k, n_buckets)
        frequency = np.zeros(len(s.keys), np.uint8)
        span = dict(zip(s.buckets.tolist(), zip(s.starts.tolist(), s.stops.tolist())))
        for bucket, levels, places, classes in zip(*(answers[c].to_pylist() for c in ("bucket", "levels", "places", "classes"))):
            start, stop = span[bucket]
            frequency[start:stop] = unpack_levels(levels, stop - start)
            frequency[start + np.frombuffer(places, "<u4").astype(np.int64)] = np.frombuffer(classes, np.uint8)
        vectors: list = [None] * len(s.n)
        common = np.add.reduceat(np.append(frequency[s.key].astype(np.int64), 0), np.minimum(s.first[:-1], len(s.h)))
        common = np.where(s.n > 0, 1000 * common // np.maximum(s.n, 1), 0)
        for d in s.carriers:
            vectors[d] = count_vector(s.h[s.first[d]:s.first[d + 1]]).tobytes()
        docs = pa.table([t["row"], t["key"], pa.array(s.n.astype(np.int64)), pa.array(s.cls), pa.array(vectors, pa.binary()), pa.array(common),
                         *[pa.nulls(len(t), x) for x in (pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.binary())]], names=names)
        h, f, c, rest = s.prefixes(frequency, percent)
        bucket = (tx._mix(h) % np.uint64(n_buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        buckets, starts = np.unique(bucket[order], return_index=True)
        cuts = np.split(order, starts[1:]) if len(starts) else []
        m = len(cuts)
        packed = pa.table([pa.nulls(m, docs["row"].type), *[pa.nulls(m, docs[x].type) for x in names[1:6]], pa.array(buckets, pa.int64()),
                           *[pa.array([x[i].tobytes() for i in cuts], pa.binary()) for x in (h, f, c, rest)]], names=names)
        return pa.concat_tables([docs, packed])

    names = ["row", "key", "n", "c", "vec", "common", "bucket", "shingles", "frequency", "classes", "rests"]
    kinds = {"key": T.LongType(), "n": T.LongType(), "c": T.LongType(), "vec": T.BinaryType(), "common": T.LongType(),
             "bucket": T.LongType(), "shingles": T.BinaryType(), "frequency": T.BinaryType(), "classes": T.BinaryType(),
             "rests": T.BinaryType()}
    schema = T.StructType([T.StructField("row", dealt.schema["row"].dataType), *[T.StructField(c, x) for c, x in kinds.items()]])
    weighed = dealt.groupBy("chunk").applyInArrow(weigh, "bucket long, chunk long, small binary, large binary, counts binary")
    answers = weighed.groupBy("bucket").applyInArrow(count, "chunk long, bucket long, levels binary, places binary, classes binary")
    return dealt.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(collect, schema)


def _shared(packed: DataFrame) -> DataFrame:
    """(s, f, c, rest): prefix shingles that two classes of sets share, with those classes."""
    def run(t: pa.Table) -> pa.Table:
        s, f, c, rest = (np.frombuffer(b"".join(t[x].to_pylist()), kind) for x, kind in (
            ("shingles", np.uint64), ("frequency", np.uint8), ("classes", np.int64), ("rests", "<u4")))
        order = np.lexsort((c, s))
        s, f, c, rest = s[order], f[order], c[order], rest[order]
        new = np.ones(len(s), bool)          # copies of a class in several chunks
        new[1:] = (s[1:] != s[:-1]) | (c[1:] != c[:-1])
        s, f, c, rest = s[new], f[new], c[new], rest[new]
        both = np.zeros(len(s), bool)
        both[1:] = s[1:] == s[:-1]
        both[:-1] |= both[1:]
        return pa.table({"s": s[both].view(np.int64), "f": f[both].astype(np.int32), "c": c[both],
                         "rest": rest[both].astype(np.int64)})

    return packed.groupBy("bucket").applyInArrow(run, "s long, f int, c long, rest long")


def overlap_needed(na: np.ndarray, nb: np.ndarray, percent: int) -> np.ndarray:
    """Least number of common shingles of sets of these sizes that link."""
    return -(-percent * (na + nb) // (100 + percent))


def _bounded(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose count vectors let them link."""
    left = classes.select(F.col("c").alias("a"), F.col("n").alias("na"), F.col("vec").alias("va"))
    right = classes.select(F.col("c").alias("b"), F.col("n").alias("nb"), F.col("vec").alias("vb"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            na, nb = (b.column(c).to_numpy() for c in ("na", "nb"))
            keep = []
            for need, x, y in zip(overlap_needed(na, nb, percent), b.column("va").to_pylist(), b.column("vb").to_pylist()):
                x, y = np.frombuffer(x, "<u4"), np.frombuffer(y, "<u4")
                groups = min(len(x), len(y))
                keep.append(bool(np.minimum(fold(x, groups), fold(y, groups)).sum(dtype=np.int64) >= need))
            yield b.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    full = pairs.join(left, "a").join(right, "b").select("a", "b", "na", "nb", "va", "vb")
    return small_batches(full).mapInArrow(run, "a long, b long")


def _wanted(docs: DataFrame, keys: DataFrame) -> DataFrame:
    """The documents whose row key may be among ``keys``: a bitmap of fixed size decides."""
    bits = 1 << WANTED_BITS
    at = F.pmod(F.xxhash64("key"), F.lit(bits))
    rows = (keys.select(at.alias("at")).groupBy(F.expr("at div 32768").alias("part"))
            .agg(F.bitmap_construct_agg(F.col("at") % 32768).alias("map")).collect())     # at most bits / 32768 rows
    found = np.zeros(bits // 8, np.uint8)
    for r in rows:
        found[r.part * 4096:(r.part + 1) * 4096] = np.frombuffer(r.map, np.uint8)

    @F.pandas_udf("boolean")
    def may_be(place: pd.Series) -> pd.Series:
        p = place.to_numpy()
        return pd.Series((found[p >> 3] >> (p & 7).astype(np.uint8)) & 1 == 1)

    return docs.filter(may_be(at))


def _target_lists(sends: DataFrame) -> DataFrame:
    """(c, to): the targets (a, part, role) of each class, dealt into lists of about TARGETS."""
    size = sends.groupBy("c").agg(F.expr(f"count(*) div {TARGETS} + 1").alias("lists"))
    salt = F.pmod(F.xxhash64("a", "part", "role"), F.col("lists"))
    return (sends.join(size, "c").groupBy("c", salt.alias("salt")).agg(F.collect_list(F.struct("a", "part", "role")).alias("to"))
            .select("c", "to"))


def set_copies(rows: Iterable[tuple[int, list[dict], bytes]], limit: int) -> Iterator[dict[str, list]]:
    """Columns with a copy of a class's set for each of its targets; rows are (class, targets, set). A
    part ends when its sets have ``limit`` bytes."""
    names = ("a", "part", "role", "c", "set")
    out, held = {n: [] for n in names}, 0
    for c, to, data in rows:
        for x in to:
            for name, value in (*x.items(), ("c", c), ("set", data)):
                out[name].append(value)
            held += len(data)
            if held >= limit:
                yield out
                out, held = {n: [] for n in names}, 0
    yield out


def _links(pairs: DataFrame, classes: DataFrame, docs: DataFrame, k: int, percent: int) -> DataFrame:
    """Of pairs (a, b) of classes those that link, verified on their sets.

    ``docs`` has the rows' key and text. Each set travels to the first class of its pairs, which
    is dealt into parts by the number of its partners; there the sets are intersected.
    """
    pairs = _bounded(pairs, classes, percent).checkpoint()
    size = pairs.groupBy("a").agg((F.expr(f"count(*) div {PARTNERS}") + 1).alias("parts"))
    dealt = pairs.join(size, "a").withColumn("part", F.pmod(F.xxhash64("b"), F.col("parts")))
    sends = dealt.select(F.col("b").alias("c"), "a", "part", F.lit(1).alias("role"))
    sends = sends.unionByName(size.select(F.col("a").alias("c"), "a", F.explode(F.expr("sequence(0L, parts - 1)")).alias("part"),
                                          F.lit(0).alias("role")))
    sends = _target_lists(sends).join(classes.select("c", "key"), "c").checkpoint()
    texts = _wanted(docs, sends).join(sends, "key").select("c", "to", "t")

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in tx.slices(whole, "t"):
                h, _, first = shingle_sets(*tx.column_bytes(b.column(2)), k)
                sets = (h[i:j].tobytes() for i, j in zip(first, first[1:]))
                for out in set_copies(zip(b.column(0).to_pylist(), b.column(1).to_pylist(), sets), tx.BATCH_BYTES):
                    yield pa.RecordBatch.from_pydict(out, schema=kind)

    kind = pa.schema([("a", pa.int64()), ("part", pa.int64()), ("role", pa.int32()), ("c", pa.int64()), ("set", pa.binary())])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centre, own = None, None
        for b in batches:
            hit: list[tuple[int, int]] = []
            for r in b.to_pylist():
                other = np.frombuffer(r["set"], np.uint64)
                if r["role"] == 0:      # comes before its partners
                    centre, own = r["a"], other
                elif r["a"] == centre:
                    common = len(np.intersect1d(own, other, assume_unique=True))
                    if common >= overlap_needed(len(own), len(other), percent):
                        hit.append((r["a"], r["c"]))
            yield pa.RecordBatch.from_pydict({"a": pa.array([a for a, _ in hit], pa.int64()),
                                              "b": pa.array([b for _, b in hit], pa.int64())})

    sets = small_batches(texts).mapInArrow(spread, "a long, part long, role int, c long, set binary")
    n_parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return (sets.repartition(n_parts, "a", "part").sortWithinPartitions("a", "part", "role")
            .mapInArrow(meet, "a long, b long").distinct())


def _common_bound(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Sums of the smaller counts by row; in bytes, 255 in both bounds nothing."""
    low = np.minimum(x, y)
    bound = low.sum(1, dtype=np.int64)
    if low.dtype == np.uint8:
        bound[(low == 255).any(1)] = 1 << 40
    return bound


class CountTree:
    """R-tree of count vectors, packed in order of set size; nodes keep their largest counts."""

    def __init__(self, vec: np.ndarray, n: np.ndarray):
        self.order = np.argsort(n, kind="stable")
        self.levels = [(vec[self.order], n[self.order], n[self.order])]
        while len(self.levels[-1][1]) > FANOUT:
            high, low_n, high_n = self.levels[-1]
            starts = np.arange(0, len(low_n), FANOUT)
            self.levels.append((np.maximum.reduceat(high, starts), np.minimum.reduceat(low_n, starts),
                                np.maximum.reduceat(high_n, starts)))

    def search(self, vec: np.ndarray, n: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
        """(query, point) pairs whose bounds let them link."""
        top = len(self.levels) - 1
        q = np.repeat(np.arange(len(n)), len(self.levels[top][1]))
        node = np.tile(np.arange(len(self.levels[top][1])), len(n))
        for level in range(top, -1, -1):
            high, low_n, high_n = self.levels[level]
            ok = (100 * n[q] >= percent * low_n[node]) & (100 * high_n[node] >= percent * n[q])
            q, node = q[ok], node[ok]
            keep = np.zeros(len(q), bool)
            for i in range(0, len(q), 1 << 12):
                a, b = q[i:i + (1 << 12)], node[i:i + (1 << 12)]
                keep[i:i + (1 << 12)] = _common_bound(vec[a], high[b]) >= overlap_needed(n[a], low_n[b], percent)
            q, node = q[keep], node[keep]
            if level:
                below = len(self.levels[level - 1][1])
                q = np.repeat(q, FANOUT)
                node = (node[:, None] * FANOUT + np.arange(FANOUT)).ravel()
                q, node = q[node < below], node[node < below]
        return q, self.order[node]


def _group_pairs(c: np.ndarray, comp: np.ndarray, n: np.ndarray, rest: np.ndarray, vec: np.ndarray, side: np.ndarray,
                 percent: int) -> Iterator[np.ndarray]:
    """Pairs of one group's classes, in different components, that the tree and the rests let pass.
    Where classes stand on side 1, only pairs across the sides."""
    points = np.flatnonzero(side == 0)
    queries = np.flatnonzero(side == 1) if side.any() else points
    tree = CountTree(vec[points], n[points])
    step = min(1024, max(1, SEARCH_PAIRS // max(len(points), 1)))
    for i in range(0, len(queries), step):
        at = queries[i:i + step]
        q, p = tree.search(vec[at], n[at], percent)
        q, p = at[q], points[p]
        ok = (comp[q] != comp[p]) & ((c[q] < c[p]) | (side[q] == 1))
        ok &= np.minimum(rest[q], rest[p]) >= overlap_needed(n[q], n[p], percent)
        yield np.sort(np.stack([c[q[ok]], c[p[ok]]], 1), axis=1)


def _blocks(members: DataFrame) -> DataFrame:
    """Members (s, c, comp) of groups with the pairs of blocks (i, j) that they are searched in and their
    side there. A component of a block or more has blocks of its own, which never meet each other; the
    group's other classes share blocks. Groups of one block have the pair (0, 0)."""
    sizes = members.groupBy("s", "comp").agg(F.count(F.lit(1)).alias("m"))
    own = F.col("m") >= BLOCK
    of_group = sizes.groupBy("s").agg(F.sum("m").alias("size"), F.sum(F.when(~own, F.col("m")).otherwise(0)).alias("rest"),
                                      F.count_if(own).alias("n_own")).filter(F.col("size") > BLOCK).checkpoint()
    ceil = lambda x: F.expr(f"({x} + {BLOCK - 1}) div {BLOCK}")     # noqa: E731
    # The blocks of large components follow the shared ones; few rows, each stands for a block or more.
    before = Window.partitionBy("s").orderBy("comp").rowsBetween(Window.unboundedPreceding, -1)
    large = (sizes.filter(own).join(of_group, "s").withColumn("width", ceil("m"))
             .select("s", "comp", "width", (ceil("rest") + F.coalesce(F.sum("width").over(before), F.lit(0))).alias("low"))
             .checkpoint())
    total = (of_group.join(large.groupBy("s").agg(F.sum("width").alias("wide")), "s", "left")
             .select("s", ceil("rest").alias("shared"), (ceil("rest") + F.coalesce("wide", F.lit(0))).alias("total")))
    dealt = members.join(total, "s", "left").join(large, ["s", "comp"], "left")
    mine = F.coalesce(F.col("low"), F.lit(0)) + F.pmod(F.xxhash64("c"), F.coalesce("width", "shared", F.lit(1)))
    dealt = dealt.withColumn("mine", mine).withColumn("other", F.explode(F.expr(
        "CASE WHEN total IS NULL THEN array(0L) "
        "ELSE filter(sequence(0L, total - 1), x -> low IS NULL OR x < low OR x >= low + width) END")))
    return dealt.select("s", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"),
                        *[x for x in members.columns if x != "s"], (F.col("mine") > F.col("other")).cast("int").alias("side"))


def _search(rows: DataFrame, percent: int) -> DataFrame:
    """Distinct candidate pairs of rows (s, c, comp, n, vec) that stand together by shingle s and, if
    the rows have them, blocks i and j; ``rest`` holds the class's shingles from s on (default: all)."""
    if "rest" not in rows.columns:
        rows = rows.withColumn("rest", F.col("n"))
    if "i" not in rows.columns:
        rows = rows.select("*", F.lit(0).cast("long").alias("i"), F.lit(0).cast("long").alias("j"), F.lit(0).alias("side"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def starts_of(t: pa.RecordBatch | pa.Table) -> np.ndarray:
            new = np.zeros(t.num_rows, bool)
            new[:1] = True
            for x in ("s", "i", "j"):
                v = t[x].to_numpy()
                new[1:] |= v[1:] != v[:-1]
            return np.flatnonzero(new)

        def name(t: pa.RecordBatch, at: int) -> list:
            return [t[x][at] for x in ("s", "i", "j")]

        def pairs(t: pa.Table) -> Iterator[pa.RecordBatch]:
            c, comp, n, rest, side = (t[x].to_numpy() for x in ("c", "comp", "n", "rest", "side"))
            vec = np.frombuffer(b"".join(t["vec"].to_pylist()), np.uint8).reshape(-1, GROUPS)
            starts = starts_of(t)
            ends = np.r_[starts[1:], t.num_rows]
            group = np.repeat(np.arange(len(starts)), ends - starts)
            found = [np.zeros((0, 2), np.int64)]
            small = ends - starts <= FANOUT
            # Groups that fill no node: neighbours at distance 1, 2, ... of all such groups at once.
            for gap in range(1, int((ends - starts)[small].max(initial=0))):
                i = np.arange(len(group) - gap)
                i = i[(group[i] == group[i + gap]) & (comp[i] != comp[i + gap]) & small[group[i]]]
                j = i + gap
                # Equal or near sizes, and enough of both sets from the shared shingle on.
                fits = np.minimum(rest[i], rest[j]) >= overlap_needed(n[i], n[j], percent)
                i, j = i[fits], j[fits]
                ok = _common_bound(vec[i], vec[j]) >= overlap_needed(n[i], n[j], percent)
                found.append(np.sort(np.stack([c[i[ok]], c[j[ok]]], 1), axis=1))
            for b, e in zip(starts[~small], ends[~small]):
                for some in _group_pairs(c[b:e], comp[b:e], n[b:e], rest[b:e], vec[b:e], side[b:e], percent):
                    found.append(some)
                    if sum(map(len, found)) > SEARCH_PAIRS:
                        yield distinct(found)
                        found = []
            yield distinct(found)

        def distinct(found: list[np.ndarray]) -> pa.RecordBatch:
            out = np.unique(np.concatenate(found or [np.zeros((0, 2), np.int64)]), axis=0)
            return pa.RecordBatch.from_pydict({"a": out[:, 0], "b": out[:, 1]})

        for b in batches:
            if not b.num_rows:
                continue
            at = int(starts_of(b)[-1])      # the last group may go on in the next batch
            if held and name(held[-1], -1) != name(b, 0):
                yield from pairs(pa.Table.from_batches(held).combine_chunks())
                held = []
            if at:
                yield from pairs(pa.Table.from_batches([*held, b.slice(0, at)]).combine_chunks())
                held = []
            held.append(b.slice(at))
        if held:
            yield from pairs(pa.Table.from_batches(held).combine_chunks())

    return rows.select("s", "i", "j", "side", "c", "comp", "n", "rest", "vec").mapInArrow(run, "a long, b long").distinct()


def _folded(classes: DataFrame) -> DataFrame:
    """The classes with their count vectors over GROUPS groups in a byte each; 255 stands for any
    larger count (see ``_common_bound``)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            vec = [np.minimum(fold(np.frombuffer(v, "<u4")), 255).astype(np.uint8).tobytes() for v in b.column("vec").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(vec, pa.binary()) if n == "vec" else c
                                              for n, c in zip(b.schema.names, b.columns)], b.schema.names)

    return small_batches(classes).mapInArrow(run, classes.schema)


def jaccard_components(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = SHINGLE,
                       percent: int = PERCENT, chunk_bytes: int = CHUNK_BYTES, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """The rows without their text, with n_shingles and component_id (smallest id reachable by links)."""
    spark = df.sparkSession
    folder = new_folder(spark, "jaccard")
    _dealt(df, id_col, text_col, k, percent, chunk_bytes, bucket_bytes).write.parquet(folder)
    both = spark.read.parquet(folder)
    docs = both.filter("bucket IS NULL")
    texts = df.select(F.xxhash64(id_col, text_col).alias("key"), F.col(text_col).alias("t"))
    with_id = F.col("row")[id_col].isNotNull()
    shared = _shared(both.filter("bucket IS NOT NULL").select("bucket", "shingles", "frequency", "classes", "rests")).checkpoint()
    # A class has one count vector a chunk; any of them will do.
    classes = (docs.filter(F.col("vec").isNotNull()).join(shared.select("c").distinct(), "c", "left_semi").groupBy("c")
               .agg(F.min_by(F.struct("key", "n", "vec", "common"), "key").alias("x")).select("c", "x.*")).checkpoint()

    # Step 3: each class and the centres of the groups of some of its shared shingles.
    by_class = (shared.groupBy("c").agg(F.array_sort(F.collect_list(F.struct("f", "s"))).alias("x"))
                .withColumn("last", F.slice("x", F.greatest(F.size("x") - (CENTRES - 1), F.lit(1)), CENTRES)))
    some = by_class.select("c", F.explode(F.array_distinct(F.concat(F.slice("x", 1, CENTRES), "last"))).alias("y"))
    near = some.select("c", "y.s").join(classes.select("c", "n", "common"), "c")
    centre = near.groupBy("s").agg(F.max(F.struct("common", "c", "n")).alias("m"))
    stars = (near.join(centre, "s").select(F.col("m.c").alias("a"), F.col("c").alias("b"), F.col("m.n").alias("x"), "n")
             .filter(F.col("a") != F.col("b"))
             .filter(100 * F.least("x", "n") >= percent * F.greatest("x", "n")).select("a", "b").distinct())
    first = _links(stars, classes, texts, k, percent).checkpoint()
    comps = connected_components(first)

    # Step 4: groups that hold classes of different components.
    members = shared.select("s", "c", "rest").join(comps.withColumnRenamed("node", "c"), "c", "left").select(
        "s", "c", F.coalesce("component", "c").alias("comp"), "rest")
    mixed = (members.groupBy("s").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"))
             .filter("lo < hi").select("s"))
    blocks = _blocks(members.join(mixed, "s", "left_semi").checkpoint())
    rows = blocks.join(_folded(classes.select("c", "n", "vec")), "c")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.repartition(parts, "s", "i", "j").sortWithinPartitions("s", "i", "j")
    pairs = _search(small_batches(rows), percent)
    second = _links(pairs, classes, texts, k, percent)
    links = first.unionByName(second).checkpoint()
    comps = connected_components(links)

    # The smallest id of each class, then of each component.
    least_ids = (docs.filter(with_id & (F.col("n") > 0)).groupBy("c").agg(F.min(F.col("row")[id_col]).alias("least"))
               .join(comps.withColumnRenamed("node", "c"), "c", "left")
               .select("c", "least", F.coalesce("component", "c").alias("comp")))
    least = least_ids.groupBy("comp").agg(F.min("least").alias("component_id"))
    label = least_ids.join(least, "comp").select("c", "component_id")
    out = docs.select("row", "n", "c").join(label, "c", "left")
    rest = [f.name for f in docs.schema["row"].dataType.fields]
    component = F.when(F.col("n") == 0, F.col("row")[id_col]).otherwise(F.when(with_id, F.col("component_id")))
    return out.select(*[F.col("row")[c].alias(c) for c in rest], F.col("n").alias("n_shingles"),
                      component.alias("component_id"))


_SQL = f"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
sh AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + {SHINGLE - 1}], ' ') AS s
       FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - {SHINGLE - 2}, 2))) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id <> b.doc_id
           GROUP BY 1, 2),
link AS (SELECT a, b FROM common JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b
         WHERE 100 * c >= {PERCENT} * (x.n + y.n - c)),
reach(root, node) AS (SELECT doc_id, doc_id FROM documents UNION SELECT root, b FROM reach JOIN link ON node = a)
SELECT d.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(node) AS component_id
FROM documents d JOIN reach ON root = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id GROUP BY d.doc_id
"""


@query("op9_jaccard_join", _SQL)
def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the size of its shingle set and its component of near copies."""
    return jaccard_components(table(spark, sf_dir, "documents").select("doc_id", "text"))
