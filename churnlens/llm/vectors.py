"""Exact top-k inner products: Fagin's threshold algorithm over sorted per-dimension lists.

Components are turned into floor(256 * x). Rows are searched in blocks: a task sorts the ids of its
block once per dimension and, for each query, reads all lists in parallel (from the top for a positive query
component, from the bottom for a negative one), scores each row when it is first met, and stops when
the sum of the query's components times the values last read cannot reach the kth best score any more
(ties included, so equal scores still go to the smaller id).

The queries are rows of the table. They are written to the shared folder in files of ``QUERY_ROWS`` and read
by the tasks one file at a time, so no task or driver holds more than one block of rows and one of queries. A
first search of the queries among themselves gives each one a kth score that its result cannot fall
below; the search over all rows starts from it and sends only rows that reach it.

Defined cases: vectors null, empty or with null or non-finite components take no part; only vectors of
equal length are compared; a query meets every row but those of its own id; repeated rows are candidates
each, but one query; rows of one id with different vectors are queries each; a null id is no query and
comes last among equal scores; products are 64-bit integers (exact below 2**63).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from churnlens.llm.registry import query, table
from churnlens.llm.storage import file_system, new_folder

TOP = 5
#: Queries in a file.
QUERY_ROWS = 4096
#: Bytes of 64-bit components in a block of rows.
BLOCK_BYTES = 16 << 20
#: Rows of each list read before the first test of the bound; doubled after each.
STEP = 16
_LAST = np.int64(2**63 - 1)


class Lists:
    """A block of vectors of one length, sorted by each dimension."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        self.ids, self.n = ids, len(ids)
        self.vectors = vectors
        self.most = int(np.abs(vectors).max(initial=0))
        self.exact = vectors.astype(np.float64)
        self.order = np.ascontiguousarray(np.argsort(vectors, axis=0, kind="stable").T.astype(np.int32))
        self.sorted = np.take_along_axis(vectors.T, self.order, axis=1)

    def _scores(self, rows: np.ndarray, q: np.ndarray) -> np.ndarray:
        if len(q) * self.most * int(np.abs(q).max(initial=0)) < 2**53:
            return (self.exact[rows] @ q.astype(np.float64)).astype(np.int64)
        return self.vectors[rows] @ q

    def top(self, q: np.ndarray, own: int, k: int, least: int | None) -> tuple[np.ndarray, np.ndarray, int]:
        """(rows, scores, rows scored) of the k best by score and id, none below ``least``."""
        up, down = np.flatnonzero(q >= 0), np.flatnonzero(q < 0)
        seen = self.ids == own
        rows, scores = np.zeros(0, np.int64), np.zeros(0, np.int64)
        at, step, met = 0, STEP, 0
        while at < self.n:
            end = min(self.n, at + step)
            new = np.concatenate([self.order[up, self.n - end:self.n - at].ravel(), self.order[down, at:end].ravel()])
            new = np.unique(new[~seen[new]])
            seen[new] = True
            met += len(new)
            s = self._scores(new, q)
            if least is not None:
                new, s = new[s >= least], s[s >= least]
            if len(new):
                rows, scores = np.concatenate([rows, new]), np.concatenate([scores, s])
                best = np.lexsort((self.ids[rows], -scores))[:k]
                rows, scores = rows[best], scores[best]
                if len(rows) == k:
                    least = int(scores[-1])
            bound = int((q[up] * self.sorted[up, self.n - end]).sum() + (q[down] * self.sorted[down, end - 1]).sum())
            if least is not None and bound < least:
                break
            at, step = end, 2 * step
        return rows, scores, met


def _matrices(ids: pa.Array, vectors: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row numbers, matrix) for each length of vector."""
    if isinstance(vectors, pa.ChunkedArray):
        vectors = vectors.combine_chunks()
    size = np.asarray(vectors.value_lengths())
    flat, start = np.asarray(vectors.flatten()).astype(np.int64), np.cumsum(size) - size
    for d in np.unique(size):
        rows = np.flatnonzero(size == d)
        yield rows, flat[start[rows][:, None] + np.arange(d)]


def _ids(arr: pa.Array) -> np.ndarray:
    return np.asarray(arr.fill_null(int(_LAST))).astype(np.int64)


def _quantised(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, v) of the rows that take part; v holds the integer components."""
    rows = df.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{vector_col}`").alias("x"))
    finite = F.forall("x", lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < float("inf")))
    return rows.filter((F.size("x") > 0) & finite).select(
        "id", F.transform("x", lambda c: F.floor(F.lit(256.0) * c.cast("double"))).alias("v"))


def _blocks(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[pa.Table]:
    """Batches put together to about ``limit`` bytes of components."""
    held, size = [], 0
    for b in batches:
        for at in range(0, b.num_rows, 4096):
            part = b.slice(at, 4096)
            held.append(part)
            size += 8 * len(part.column(1).flatten())
            if size >= limit:
                yield pa.Table.from_batches(held)
                held, size = [], 0
    if held:
        yield pa.Table.from_batches(held)


def _search(rows: DataFrame, folder: str, k: int, block_bytes: int) -> DataFrame:
    """(qkey, query_id, vec_id, score): for each query of the folder the best rows of each block."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, path = file_system(folder)
        files = sorted(f.path for f in store.get_file_info(pafs.FileSelector(path)) if f.path.endswith(".parquet"))
        for block in _blocks(batches, block_bytes):
            block = block.combine_chunks()
            id_col = block.column(0).combine_chunks()
            ids = _ids(id_col)
            lists = {m.shape[1]: (at, Lists(ids[at], m)) for at, m in _matrices(id_col, block.column(1))}
            for file in files:
                with store.open_input_file(file) as f:
                    queries = pq.read_table(f).combine_chunks()
                out = []
                least = queries["least"].to_pylist()
                own = _ids(queries["id"].combine_chunks())
                for at, m in _matrices(queries["id"], queries["v"]):
                    if m.shape[1] not in lists:
                        continue
                    place, mine = lists[m.shape[1]]
                    for i, q in zip(at, m):
                        found, scores, _ = mine.top(q, own[i], k, least[i])
                        out.append((np.full(len(found), i), place[found], scores))
                if out:
                    i, found, scores = (np.concatenate(x) for x in zip(*out))
                    yield pa.RecordBatch.from_arrays(
                        [queries["qkey"].combine_chunks().take(pa.array(i)), queries["id"].combine_chunks().take(pa.array(i)),
                         id_col.take(pa.array(found)), pa.array(scores, pa.int64())],
                        ["qkey", "query_id", "vec_id", "score"])
    return rows.mapInArrow(run, "qkey long, query_id long, vec_id long, score long")


def _best(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("qkey").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"))
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def top_vectors(df: DataFrame, is_query: Column, k: int = TOP, id_col: str = "vec_id", vector_col: str = "embedding",
                query_rows: int = QUERY_ROWS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row that ``is_query`` marks the k rows of largest inner product."""
    spark = df.sparkSession
    rows = _quantised(df, id_col, vector_col)
    asked = _quantised(df.filter(is_query & F.col(f"`{id_col}`").isNotNull()), id_col, vector_col).distinct()
    asked = asked.withColumn("qkey", F.xxhash64("id", "v"))
    first = new_folder(spark, "queries")
    asked.withColumn("least", F.lit(None).cast("long")).write.option("maxRecordsPerFile", query_rows).parquet(first)
    asked = spark.read.parquet(first)
    among = _best(_search(asked.select("id", "v"), first, k, block_bytes), k)
    least = among.groupBy("qkey").agg(F.when(F.count("*") == k, F.min("score")).alias("least"))
    folder = new_folder(spark, "queries")
    asked.drop("least").join(least, "qkey", "left").write.option("maxRecordsPerFile", query_rows).parquet(folder)
    return _best(_search(rows, folder, k, block_bytes), k).select("query_id", "rank", "vec_id", "score")


_SQL = f"""
WITH v AS (SELECT vec_id, [floor(256 * x::DOUBLE) FOR x IN embedding] AS e FROM embeddings
           WHERE embedding IS NOT NULL AND len(embedding) > 0
             AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x::DOUBLE)]) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.e, c.e)::BIGINT AS score
      FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= {TOP}
"""


@query("op13_top_vectors", _SQL)
def op13_top_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five vectors of largest integer inner product for each 50th vector."""
    return top_vectors(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), F.col("vec_id") % 50 == 0)
