"""Removal of repeated word windows: Rabin-Karp hashes counted in Spark, merged into intervals.

Documents are dealt into chunks of about ``chunk_bytes``. Each chunk hashes all its windows of k
words (rolling polynomials over word hashes, one of 64 bits and an independent one that names a
bucket), and sends each distinct hash once, packed by bucket, so a window that occurs very often is
one entry a chunk. Buckets count hashes over all chunks and answer each chunk with the places of the
hashes that other chunks have too. The chunk, read again from the same shuffle, adds the hashes
that occur twice in itself, covers the words of all repeated windows and merges them into maximal
removal intervals. Numbers of chunks and buckets follow the bytes of the text.

Two different windows are taken for equal if both hashes agree: one in 2**64 times the number of
buckets.

Defined cases: a null text has no words and its kept text is empty, as for an empty text; documents
of fewer than k words lose nothing; repeated rows (same id and text) repeat each other's windows;
other columns are kept, those named like the result's replaced.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from churnlens.llm import text as tx
from churnlens.llm.registry import query, table, text_bytes

#: Words in a window.
WINDOW = 35
#: Text bytes that a chunk of documents and a bucket of hashes are planned for. A chunk sends a row
#: to every bucket, so raise both with the executors' memory on very large corpora.
CHUNK_BYTES = 4 << 20
BUCKET_BYTES = 8 << 20
_ADDED = ("n_words", "n_removed", "removed", "kept_text")


class _Windows:
    """A chunk's windows, its distinct hashes by bucket, and back."""

    def __init__(self, texts: pa.ChunkedArray, k: int, n_buckets: int):
        self.data, self.off = tx.column_bytes(texts)
        self.words, self.k = tx.words_of(self.data, self.off), k
        wh = tx.word_hashes(self.words)
        self.at = tx.window_starts(self.words.first, k)
        h = tx.window_hashes(wh, self.at, k)
        order = np.argsort(h)
        ranked = h[order]
        new = np.ones(len(h), bool)
        new[1:] = ranked[1:] != ranked[:-1]
        self.key = np.empty(len(h), np.int64)     # window -> distinct hash
        self.key[order] = np.cumsum(new) - 1
        self.distinct = ranked[new]
        bucket = (tx.window_hashes(wh, self.at, k, seed=1) % np.uint64(n_buckets)).astype(np.int64)
        bucket_of = bucket[order[new]]
        self.by_bucket = np.argsort(bucket_of, kind="stable")
        self.buckets, self.starts = np.unique(bucket_of[self.by_bucket], return_index=True)
        self.stops = np.append(self.starts[1:], len(self.by_bucket))

    def own_repeats(self) -> np.ndarray:
        """Of each distinct hash, whether it occurs at least twice here."""
        return np.bincount(self.key, minlength=len(self.distinct)) > 1


def _sorted_by_id(t: pa.Table) -> pa.Table:
    """A fixed order of the chunk's rows, whichever way they were fetched."""
    tx.release()
    return t.take(pa.compute.sort_indices(t, [("order", "ascending"), ("t", "ascending")]))


def remove_repeats(df: DataFrame, k: int = WINDOW, id_col: str = "doc_id", text_col: str = "text",
                   chunk_bytes: int = CHUNK_BYTES, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """Add n_words, n_removed, removed (maximal intervals of word numbers, end exclusive), kept_text."""
    spark = df.sparkSession
    keep = [c for c in df.columns if c not in _ADDED]
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    size = text_bytes(df, text_col)
    n, n_buckets = size // chunk_bytes + 1, size // bucket_bytes + 1
    rest = [c for c in keep if c != text_col]
    dealt = df.select(
        F.struct(*[F.col(f"`{c}`") for c in rest]).alias("row"), F.col(text_col).alias("t"),
        F.xxhash64(id_col).alias("order"), F.pmod(F.xxhash64(id_col, text_col), F.lit(n)).alias("chunk"))
    dealt = dealt.repartition(parts, "chunk")

    def send(t: pa.Table) -> pa.Table:
        t = _sorted_by_id(t)
        w = _Windows(t["t"], k, n_buckets)
        chunk = t["chunk"][0].as_py()
        blobs = [w.distinct[w.by_bucket[s:e]].tobytes() for s, e in zip(w.starts, w.stops)]
        return pa.table({"bucket": pa.array(w.buckets, pa.int64()), "chunk": pa.array([chunk] * len(blobs), pa.int64()),
                         "hashes": pa.array(blobs, pa.binary())})

    def count(t: pa.Table) -> pa.Table:
        blobs = t["hashes"].to_pylist()
        size = np.array([len(b) // 8 for b in blobs])
        again = tx.repeated(np.frombuffer(b"".join(blobs), np.uint64))   # distinct within a chunk
        ends = np.cumsum(size)
        places = [np.flatnonzero(again[e - s:e]).astype(np.uint32) for s, e in zip(size, ends)]
        hit = [i for i, p in enumerate(places) if len(p)]
        return pa.table({"chunk": t["chunk"].take(pa.array(hit, pa.int64())),
                         "bucket": t["bucket"].take(pa.array(hit, pa.int64())),
                         "places": pa.array([places[i].tobytes() for i in hit], pa.binary())})

    def remove(t: pa.Table, answers: pa.Table) -> pa.Table:
        t = _sorted_by_id(t)
        w = _Windows(t["t"], k, n_buckets)
        again = w.own_repeats()
        start = dict(zip(w.buckets.tolist(), w.starts.tolist()))
        for bucket, places in zip(answers["bucket"].to_pylist(), answers["places"].to_pylist()):
            again[w.by_bucket[start[bucket] + np.frombuffer(places, np.uint32).astype(np.int64)]] = True
        gone = tx.cover(w.at[again[w.key]], k, len(w.words.starts))
        n_words, doc = np.diff(w.words.first), tx.word_docs(w.words.first)
        removed = np.bincount(doc[gone], minlength=len(n_words)).astype(np.int64)
        return pa.table([t["row"], pa.array(n_words.astype(np.int64)), pa.array(removed), _intervals(gone, doc, w.words),
                         _join(w.words, ~gone, doc)], schema=schema_arrow(t.schema.field("row").type))

    interval = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
    schema = T.StructType([dealt.schema["row"], T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()),
                           T.StructField("removed", interval), T.StructField("kept_text", T.StringType())])

    def schema_arrow(row: pa.DataType) -> pa.Schema:
        return pa.schema([("row", row), ("n_words", pa.int64()), ("n_removed", pa.int64()),
                          ("removed", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
                          ("kept_text", pa.string())])

    sent = dealt.groupBy("chunk").applyInArrow(send, "bucket long, chunk long, hashes binary")
    answers = sent.groupBy("bucket").applyInArrow(count, "chunk long, bucket long, places binary")
    out = dealt.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(remove, schema)
    return out.select(*[F.col("row")[c].alias(c) for c in rest], *_ADDED)


def _intervals(gone: np.ndarray, doc: np.ndarray, words: tx.Words) -> pa.Array:
    """Maximal runs of removed words of each document."""
    joined = np.zeros(len(gone), bool)      # removed, as the word before it in the same document
    joined[1:] = gone[1:] & gone[:-1] & (doc[1:] == doc[:-1])
    starts = np.flatnonzero(gone & ~joined)
    after = np.ones(len(gone), bool)
    after[:-1] = ~joined[1:]
    ends = np.flatnonzero(gone & after) + 1
    base = words.first[doc[starts]]
    off = np.searchsorted(starts, words.first).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(off), pa.StructArray.from_arrays(
        [pa.array(starts - base, pa.int64()), pa.array(ends - base, pa.int64())], ["start", "end"]))


def _join(words: tx.Words, kept: np.ndarray, doc: np.ndarray) -> pa.Array:
    """The kept words of each document, joined by one space."""
    s, size = words.starts[kept], (words.ends - words.starts)[kept]
    d = doc[kept]
    last = np.ones(len(d), bool)
    last[:-1] = d[1:] != d[:-1]
    room = size + ~last            # a space after each word but a document's last one
    stop = np.cumsum(room)
    total = int(stop[-1]) if len(stop) else 0
    begin = stop - room
    out = np.full(total, 0x20, np.uint8)
    at = np.repeat(s - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
    to = np.repeat(begin - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
    out[to] = words.data[at]
    first = np.searchsorted(d, np.arange(len(words.first)))      # first kept word of each document
    off = np.append(begin, total)[first]
    return pa.LargeStringArray.from_buffers(len(off) - 1, pa.py_buffer(off.astype(np.int64).tobytes()),
                                            pa.py_buffer(out.tobytes())).cast(pa.string())


_SQL = f"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
win AS (SELECT doc_id, i, array_to_string(ws[i:i + {WINDOW - 1}], ' ') AS h
        FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - {WINDOW - 2})) AS i FROM w)),
rep AS (SELECT doc_id, i FROM win WHERE h IN (SELECT h FROM win GROUP BY h HAVING count(*) > 1)),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + {WINDOW})) AS j FROM rep),
word AS (SELECT doc_id, unnest(ws) AS x, unnest(range(1, len(ws) + 1)) AS j FROM w),
kept AS (SELECT doc_id, count(*) AS n, string_agg(x, ' ' ORDER BY j) AS t
         FROM word ANTI JOIN gone USING (doc_id, j) GROUP BY doc_id)
SELECT w.doc_id, len(ws) AS n_words, len(ws) - coalesce(n, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (doc_id)
"""


@query("op5_substring_dedup", _SQL)
def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the words of 35-word windows that occur elsewhere too."""
    docs = remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return docs.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))
