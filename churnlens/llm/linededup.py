"""Removal of lines that stand on many sites, with SQL functions only.

Every line (with at least one word) is hashed; per hash a HyperLogLog sketch of the sites it
occurs on is aggregated, merging partial sketches, so a hot line moves one sketch per task. Lines
whose estimate is clear of ``min_sites`` by the sketch's error are decided by it; the others get
an exact count of distinct sites. A line on at least ``min_sites`` sites is boilerplate: its
first occurrence (smallest document id, then line) stays, all others are removed.

Defined cases: a null site counts for no site; a null text stays null and has no lines; an empty
text has one line without words, which is never removed; rows with equal document id and text are
treated alike; other columns are kept, those named like the result's replaced.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from churnlens.llm.registry import query, table

#: Distinct sites from which a line is boilerplate.
MIN_SITES = 10
#: Sketch of 2**LG_K registers: relative standard error 1.04 / sqrt(2**LG_K).
LG_K = 10
#: Standard errors within which an estimate is near the threshold.
NEAR = 3.0
_KEY = ["h1", "h2"]


def dedup_lines(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", site_col: str = "source",
                min_sites: int = MIN_SITES, lg_k: int = LG_K) -> DataFrame:
    """Replace the text by its kept lines; add n_lines and n_removed."""
    keep = [c for c in df.columns if c not in ("n_lines", "n_removed")]
    docs = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("t"), F.col(site_col).cast("string").alias("site"),
                     F.xxhash64(text_col).alias("th"))
    worded = F.col("line").rlike(r"[^\x20\x09-\x0D]")
    every = (docs.select("id", "th", "site", F.posexplode(F.split("t", "\n", -1)).alias("no", "line"))
             .select("id", "th", "site", "no", F.when(worded, F.xxhash64("line")).alias("h1"), F.hash("line").alias("h2")))
    lines = every.filter("h1 IS NOT NULL")
    error = NEAR * 1.04 / math.sqrt(2 ** lg_k)
    low, high = math.floor(min_sites * (1 - error)), math.ceil(min_sites * (1 + error))
    spread = (lines.groupBy(*_KEY)
              .agg(F.hll_sketch_agg("site", F.lit(lg_k)).alias("sketch"), F.min(F.struct("id", "th", "no")).alias("first"))
              .select(*_KEY, "first", F.hll_sketch_estimate("sketch").alias("sites"))
              .filter(F.col("sites") >= low))
    # Read twice and small beside the lines: kept in the shared folder.
    spread = spread.checkpoint()
    near = spread.filter(F.col("sites") <= high)
    exact = (lines.join(near.select(*_KEY), _KEY, "left_semi").filter("site IS NOT NULL")
             .groupBy(*_KEY, "site").agg(F.lit(1).alias("one"))
             .groupBy(*_KEY).agg(F.count("*").alias("exact")).filter(F.col("exact") >= min_sites))
    spread = spread.filter(F.col("sites") > high).select(*_KEY, "first").unionByName(
        near.join(exact, _KEY).select(*_KEY, "first"))
    # For each document that loses a line: whether line i goes, at index i.
    cut = F.col("first").isNotNull() & ~F.struct("id", "th", "no").eqNullSafe(F.col("first"))
    flags = (every.join(spread, _KEY, "left").select("id", "th", "no", cut.alias("cut"))
             .groupBy("id", "th").agg(F.max("cut").alias("any"), F.collect_set(F.struct("no", "cut")).alias("cuts"))
             .filter("any").select(F.col("id").alias("f_id"), F.col("th").alias("f_th"),
                                   F.expr("transform(sort_array(cuts), c -> c.cut)").alias("cuts")))
    row = df.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row"))
    row = row.select("row", F.col("row")[id_col].alias("id"), F.col("row")[text_col].alias("t"),
                     F.xxhash64(F.col("row")[text_col]).alias("th"))
    joined = row.join(flags, row["id"].eqNullSafe(F.col("f_id")) & (row["th"] == F.col("f_th")), "left")
    kept = F.expr("IF(cuts IS NULL, t, array_join(filter(split(t, '\\n', -1), (l, i) -> NOT cuts[i]), '\\n'))")
    return joined.select(
        *[(kept if c == text_col else F.col("row")[c]).alias(c) for c in keep],
        F.when(F.col("t").isNull(), 0).otherwise(F.size(F.split("t", "\n", -1))).cast("long").alias("n_lines"),
        F.expr("CASE WHEN cuts IS NULL THEN 0 ELSE size(filter(cuts, c -> c)) END").cast("long").alias("n_removed"))


_SQL = f"""
WITH docs AS (SELECT doc_id, source, text, string_split(text, chr(10)) AS ls FROM documents),
lines AS (SELECT doc_id, source, unnest(ls) AS line, unnest(range(len(ls))) AS no FROM docs),
spread AS (SELECT line, min(struct_pack(d := doc_id, n := no)) AS first FROM lines
           WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]')
           GROUP BY line HAVING count(DISTINCT source) >= {MIN_SITES}),
kept AS (SELECT doc_id, count(*) AS n_lines, count(first) FILTER (WHERE first <> struct_pack(d := doc_id, n := no)) AS n_removed,
                string_agg(line, chr(10) ORDER BY no) FILTER (WHERE first IS NULL OR first = struct_pack(d := doc_id, n := no)) AS t
         FROM lines LEFT JOIN spread USING (line) GROUP BY doc_id)
SELECT doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed,
       sha256(coalesce(t, '')) AS kept_sha256
FROM documents LEFT JOIN kept USING (doc_id)
"""


@query("op2_line_dedup", _SQL)
def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the lines that stand on many sites, as counts and a digest of the kept text."""
    docs = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return docs.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))
