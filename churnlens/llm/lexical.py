"""Ranked lexical search: impact vectors ordered by length, pruned by Cauchy-Schwarz and coordinate bounds.

A document's impact vector has a coordinate for each term of the queries' vocabulary, and its score for
a query is the sum of w * impact over the query's terms, all in integers. With a query vector of
sqrt(w) and a document vector of sqrt(w) * impact the score is an inner product, so that

* the vectors are written in descending order of their length, in range partitions of about equal
  size, and searched in buckets of ``BUCKET`` rows; a query leaves out every bucket whose longest vector
  cannot reach its threshold (Cauchy-Schwarz), which the scan uses too (rows shorter than any query needs
  are not read);
* inside a bucket the largest impact of each coordinate bounds what the terms can add. Only documents that
  hold one of the query's focus terms (those without which the threshold is out of reach) are candidates; their
  partial score over the focus terms, plus the smaller of the coordinate bound and of
  Cauchy-Schwarz over the other terms, is held against the threshold;
* survivors are scored exactly in integers.

A query's threshold is the score of its kth best document so far. The longest vectors (``HEAD`` of all rows) are
searched first; their kth scores are where the tasks of the rest start from. Bounds only skip documents that score
less than the threshold, so the result is exact, ties by ascending document id included.

Queries are taken in blocks of about ``block_bytes`` of text; a block's terms, their document counts and its
thresholds go to every task. Terms are compared by 64-bit hashes.

Defined cases: null or empty texts have no term, count for nothing and are never returned; repeated documents are
ranked each; equal queries (id and text) are one query, queries of one id with other texts are ranked each;
queries without terms return nothing; a null document id comes last among equal scores; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from churnlens.llm import text as tx
from churnlens.llm.registry import query, table, text_bytes
from churnlens.llm.storage import new_folder

TOP = 50
#: Query text searched at once.
BLOCK_BYTES = 2 << 20
#: Rows of a bucket.
BUCKET = 2048
#: Share of the rows, longest vectors first, that is searched first.
HEAD = 0.125
#: Text bytes scanned at once.
SLICE_BYTES = 8 << 20

_TERM = np.zeros(256, bool)
_TERM[0x80:] = True
_TERM[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A"):ord("Z") + 1] += 32
_LAST = np.int64(2**63 - 1)


class Terms(NamedTuple):
    hashes: np.ndarray    # of each term with repeats
    first: np.ndarray     # index of each text's first term, plus the total


def terms_of(arr: pa.Array) -> Terms:
    raw, off = tx.column_bytes(arr)
    words = tx.words_of(_LOWER[raw], off, _TERM)
    return Terms(tx.word_hashes(words), words.first)


class Queries(NamedTuple):
    vocabulary: np.ndarray           # sorted hashes
    terms: list[np.ndarray]          # of each query, as places in the vocabulary
    weights: np.ndarray | None       # w of each term of the vocabulary

    @classmethod
    def of(cls, texts: list[str | None]) -> Queries:
        t = terms_of(pa.array(texts, pa.string()))
        vocabulary = np.unique(t.hashes)
        own = [np.searchsorted(vocabulary, np.unique(t.hashes[a:b])) for a, b in zip(t.first, t.first[1:])]
        return cls(vocabulary, own, None)

    def weighted(self, df: np.ndarray, n_docs: int) -> Queries:
        w = np.floor(1000 * np.log((2.0 * n_docs + 2) / (2.0 * df + 1))).astype(np.int64)
        return self._replace(weights=w)


def _counts(queries: Queries):
    """(id, n, t, tf): number of terms, and the places and counts of the terms of the vocabulary."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tx.release()
        v = queries.vocabulary
        for whole in batches:
            for b in tx.slices(whole, "text", SLICE_BYTES):
                t = terms_of(b.column(1))
                n = np.diff(t.first)
                place = np.minimum(np.searchsorted(v, t.hashes), len(v) - 1)
                hit = np.flatnonzero(v[place] == t.hashes)
                keys, tf = np.unique(tx.word_docs(t.first)[hit] * len(v) + place[hit], return_counts=True)
                doc, term = np.divmod(keys, len(v))
                off = pa.array(np.searchsorted(doc, np.arange(len(n) + 1)), pa.int32())
                out = pa.RecordBatch.from_arrays(
                    [b.column(0), pa.array(n, pa.int64()), pa.ListArray.from_arrays(off, pa.array(term, pa.int32())),
                     pa.ListArray.from_arrays(off, pa.array(tf, pa.int32()))], ["id", "n", "t", "tf"])
                yield out.filter(pa.array(n > 0))
    return run


def _impacts(queries: Queries, n_docs: int, n_terms: int):
    """(id, length, t, impact) of the documents that hold a term of positive weight."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = np.asarray(b.column(1))
            off = np.asarray(b.column(2).offsets) - b.column(2).offsets[0].as_py()
            t, tf = (np.asarray(b.column(i).flatten()).astype(np.int64) for i in (2, 3))
            size = np.diff(off)
            m = np.repeat(50 + (50 * n * n_docs) // n_terms, size)
            impact = (1000000000 * tf) // (1000 * tf + 20 * m)
            row = np.repeat(np.arange(len(n)), size)
            length = np.sqrt(np.bincount(row, queries.weights[t] * impact.astype(np.float64) ** 2, len(n)))
            lists = [pa.ListArray.from_arrays(pa.array(off, pa.int32()), pa.array(x, pa.int32())) for x in (t, impact)]
            out = pa.RecordBatch.from_arrays([b.column(0), pa.array(length), *lists], ["id", "length", "t", "impact"])
            yield out.filter(pa.array(length > 0))
    return run


class Bucket:
    """Vectors of about equal length: by row, by coordinate, and their largest coordinates."""

    def __init__(self, b: pa.RecordBatch, n_terms: int):
        self.ids = np.asarray(b.column(0).fill_null(int(_LAST))).astype(np.int64)
        self.length = np.asarray(b.column(1))
        self.off = np.asarray(b.column(2).offsets) - b.column(2).offsets[0].as_py()
        self.t, self.impact = (np.asarray(b.column(i).flatten()).astype(np.int64) for i in (2, 3))
        self.longest = float(self.length.max())
        order = np.argsort(self.t, kind="stable")
        row = np.repeat(np.arange(len(self.ids)), np.diff(self.off))
        self.rows, self.values = row[order], self.impact[order]
        self.start = np.searchsorted(self.t[order], np.arange(n_terms + 1))
        self.most = np.zeros(n_terms, np.int64)
        held = np.flatnonzero(np.diff(self.start))
        self.most[held] = np.maximum.reduceat(self.values, self.start[held])

    def postings(self, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(term, row, impact) of all entries of these terms."""
        size = self.start[terms + 1] - self.start[terms]
        at = np.repeat(self.start[terms] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
        return np.repeat(terms, size), self.rows[at], self.values[at]

    def candidates(self, terms: np.ndarray, w: np.ndarray, least: int) -> np.ndarray:
        """Rows whose bound reaches ``least``, which is positive."""
        gain = w[terms] * self.most[terms]
        order = np.argsort(-gain, kind="stable")
        terms, gain = terms[order], gain[order]
        rest = gain[::-1].cumsum()[::-1]                  # what the terms from each on can add
        if rest[0] < least:
            return np.zeros(0, np.int64)
        focus = int(np.searchsorted(-rest, -least, "right"))     # without these terms the threshold is out of reach
        t, row, impact = self.postings(terms[:focus])
        n = len(self.ids)
        partial = np.bincount(row, (w[t] * impact).astype(np.float64), n)
        used = np.bincount(row, w[t] * impact.astype(np.float64) ** 2, n)
        other = float(rest[focus]) if focus < len(terms) else 0.0
        # Rounding is far below one part in 10**9; one more point keeps the bound safe.
        angle = np.sqrt(float(w[terms[focus:]].sum()) * np.maximum(self.length ** 2 * (1 + 1e-9) - used, 0))
        return np.flatnonzero((partial + np.minimum(other, angle * (1 + 1e-9) + 1) >= least) & (partial > 0))

    def scores(self, rows: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """Exact scores of the rows; ``weight`` is zero but for the query's terms."""
        size = np.diff(self.off)[rows]
        begin = np.cumsum(size) - size
        at = np.repeat(self.off[rows] - begin, size) + np.arange(int(size.sum()))
        return np.add.reduceat(weight[self.t[at]] * self.impact[at], begin) if len(rows) else np.zeros(0, np.int64)


class Search:
    """The best documents of each query so far."""

    def __init__(self, queries: Queries, least: np.ndarray, k: int):
        self.q, self.k = queries, k
        self.least = np.maximum(least, 1)                 # only scores above 0 count
        self.terms = [t[queries.weights[t] > 0] for t in queries.terms]
        self.length = np.array([np.sqrt(float(queries.weights[t].sum())) for t in self.terms])
        self.ids = [np.zeros(0, np.int64)] * len(self.terms)
        self.best = [np.zeros(0, np.int64)] * len(self.terms)
        self.scored = 0

    def add(self, b: Bucket) -> None:
        weight = np.zeros(len(self.q.vocabulary), np.int64)
        for i in np.flatnonzero(self.length * b.longest * (1 + 1e-9) + 1 >= self.least):
            terms = self.terms[i]
            if not len(terms):
                continue
            rows = b.candidates(terms, self.q.weights, int(self.least[i]))
            if not len(rows):
                continue
            weight[terms] = self.q.weights[terms]
            scores = b.scores(rows, weight)
            weight[terms] = 0
            self.scored += len(rows)
            good = scores >= self.least[i]
            ids, best = np.concatenate([self.ids[i], b.ids[rows[good]]]), np.concatenate([self.best[i], scores[good]])
            order = np.lexsort((ids, -best))[:self.k]
            self.ids[i], self.best[i] = ids[order], best[order]
            if len(order) == self.k:
                self.least[i] = max(self.least[i], int(best[order[-1]]))


def _search(queries: Queries, least: np.ndarray, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = Search(queries, least, k)
        for b in batches:
            for at in range(0, b.num_rows, BUCKET):
                found.add(Bucket(b.slice(at, BUCKET), len(queries.vocabulary)))
        for i, (ids, scores) in enumerate(zip(found.ids, found.best)):
            if len(ids):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(ids), i, np.int32)), pa.array(ids, mask=ids == _LAST), pa.array(scores)],
                    ["query", "doc", "score"])
    return run


def _best(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("doc"))
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def _search_block(docs: DataFrame, texts: list[str | None], k: int, head: float) -> DataFrame | None:
    """(query, rank, doc, score) for the queries of one block, written; query is the place in ``texts``."""
    spark = docs.sparkSession
    queries = Queries.of(texts)
    if not len(queries.vocabulary):
        return None
    folder = new_folder(spark, "lexical")
    docs.mapInArrow(_counts(queries), "id long, n long, t array<int>, tf array<int>").write.parquet(f"{folder}/counts")
    counts = spark.read.parquet(f"{folder}/counts")
    n_docs, n_terms = counts.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    if not n_docs:
        return None
    df = np.zeros(len(queries.vocabulary), np.int64)
    for r in counts.select(F.explode("t").alias("t")).groupBy("t").count().collect():    # the block's vocabulary at most
        df[r.t] = r["count"]
    queries = queries.weighted(df, n_docs)
    vectors = counts.mapInArrow(_impacts(queries, n_docs, n_terms), "id long, length double, t array<int>, impact array<int>")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = [F.desc("length"), F.xxhash64("id", "t")]
    vectors.repartitionByRange(parts, *order).sortWithinPartitions(*order).write.parquet(f"{folder}/vectors")
    vectors = spark.read.parquet(f"{folder}/vectors")
    cut = (vectors.approxQuantile("length", [1 - head], 0.01) or [0.0])[0]
    none = np.zeros(len(texts), np.int64)
    result = "query int, doc long, score long"
    _best(vectors.filter(F.col("length") >= cut).mapInArrow(_search(queries, none, k), result), k).write.parquet(f"{folder}/head")
    first = spark.read.parquet(f"{folder}/head")
    least = none.copy()
    for r in first.filter(F.col("rank") == k).collect():        # one row a query
        least[r.query] = r.score
    # The shortest vector that any query can use.
    length = np.array([np.sqrt(float(queries.weights[t].sum())) for t in queries.terms])
    need = min((float(x / y) for x, y in zip(least, length) if y > 0), default=0.0) * (1 - 1e-9)
    rest = vectors.filter((F.col("length") < cut) & (F.col("length") >= need)).mapInArrow(_search(queries, least, k), result)
    _best(first.drop("rank").unionByName(rest), k).write.parquet(f"{folder}/best")
    return spark.read.parquet(f"{folder}/best")


def rank_documents(df: DataFrame, queries: DataFrame, k: int = TOP, id_col: str = "doc_id", text_col: str = "text",
                   query_id_col: str = "item_id", query_text_col: str = "text", block_bytes: int = BLOCK_BYTES,
                   head: float = HEAD) -> DataFrame:
    """(item_id, rank, doc_id, score): each query's k documents of highest score above 0."""
    spark = df.sparkSession
    docs = df.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").alias("text"))
    asked = queries.select(F.col(f"`{query_id_col}`").cast("long").alias("item"), F.col(f"`{query_text_col}`").alias("text")).distinct()
    n_blocks = text_bytes(asked) // block_bytes + 1
    out = spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    for block in range(n_blocks):
        rows = asked.filter(F.pmod(F.xxhash64("item", "text"), F.lit(n_blocks)) == block).collect()   # about block_bytes
        found = _search_block(docs, [r.text for r in rows], k, head)
        if found is not None:
            ids = spark.createDataFrame([(i, r.item) for i, r in enumerate(rows)], "query int, item_id long")
            out = out.unionByName(found.join(F.broadcast(ids), "query")       # the block's ids
                                  .select("item_id", "rank", F.col("doc").alias("doc_id"), "score"))
    return out


_TERMS = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')"
_SQL = f"""
WITH d AS MATERIALIZED (SELECT doc_id, {_TERMS} AS ts FROM documents),
s AS (SELECT count(*) FILTER (WHERE len(ts) > 0) AS docs, sum(len(ts))::BIGINT AS terms FROM d),
tf AS MATERIALIZED (SELECT doc_id, len(ts)::BIGINT AS n, t, count(*) AS tf
                    FROM (SELECT doc_id, ts, unnest(ts) AS t FROM d) GROUP BY doc_id, len(ts), t),
w AS (SELECT t, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * df + 1)::DOUBLE))::BIGINT AS w
      FROM (SELECT t, count(*) AS df FROM tf GROUP BY t), s),
q AS (SELECT DISTINCT item_id, unnest({_TERMS}) AS t FROM benchmark),
score AS (SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * docs) // terms))))::BIGINT AS score
          FROM q JOIN w USING (t) JOIN tf USING (t), s GROUP BY item_id, doc_id),
r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM score WHERE score > 0)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM r WHERE rank <= {TOP}
"""


@query("op11_lexical_search", _SQL)
def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 50 documents of highest score for each benchmark item."""
    return rank_documents(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
