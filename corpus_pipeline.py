"""Corpus pipeline: quality, line dedup, near copies, benchmark leaks, tokens.

Each stage is a function (spark, docs, sf_dir) -> DataFrame over all that the stage before it kept;
``run`` writes each stage's result as Parquet below the shared folder and reads it again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from churnlens.llm.bpe import VOCABULARY, round_trip
from churnlens.llm.decontaminate import find_leaks
from churnlens.llm.jaccard import jaccard_components
from churnlens.llm.linededup import dedup_lines
from churnlens.llm.quality import judge, train
from churnlens.llm.registry import table, tokenizer_path
from churnlens.llm.storage import new_folder

_WORD = r"[^\x20\x09-\x0D]"
#: Near copies share 80 % of their five-word shingles (the op9 query has a contract of its own).
NEAR_SHINGLE = 5
NEAR_PERCENT = 80
#: Units that a worker of the last stage keeps, beside what the stages before it have left in the executor.
TOKEN_CACHE = 100_000


def _packed(docs: DataFrame, *needed: str) -> DataFrame:
    """The text and the columns that an operator needs, all others as one: none of them is named like a
    column that the operator adds."""
    rest = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"])
    return docs.select(*needed, "text", rest.alias("__rest"))


def _unpacked(out: DataFrame, columns: list[str]) -> DataFrame:
    return out.select(*[F.col("text") if c == "text" else F.col("__rest")[c].alias(c) for c in columns])


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep. A null or empty text has too few words and goes; a null
    id is judged by its text; repeated rows are judged each."""
    model = train(docs, table(spark, sf_dir, "labels"))
    return _unpacked(judge(_packed(docs, "doc_id"), model).filter("kept"), docs.columns)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the later occurrences of cross-site lines; texts that lose all their words go. Null and
    empty texts have no line with a word and stay; of repeated rows (one id and text) each keeps the
    first occurrence."""
    out = dedup_lines(_packed(docs, "doc_id", "source")).filter((F.col("n_removed") == 0) | F.col("text").rlike(_WORD))
    out = _unpacked(out, docs.columns)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(docs.columns)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document (the smallest id) of each group of near copies.

    A row without an id stays only if its group has none with an id. Of rows of equal id one stays
    in a group, of equal id and text (also texts without words) one in all, whichever if their other
    columns differ.
    """
    key = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", F.xxhash64("text").alias("th"))
    marked = jaccard_components(docs.select(key.alias("id"), "text"), id_col="id", k=NEAR_SHINGLE, percent=NEAR_PERCENT)
    kept = marked.filter("component_id = id").select("id").distinct()
    marked = docs.withColumn("__key", key)
    return marked.join(kept, marked["__key"] == kept["id"], "left_semi").dropDuplicates(["__key"]).drop("__key")


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark. Null and empty texts have none; repeated rows are
    judged each; an empty benchmark leaves all."""
    return _unpacked(find_leaks(_packed(docs), table(spark, sf_dir, "benchmark")).filter("leaks IS NULL"), docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, and whether they decode to its text. A null or empty text has none, and
    decodes to the empty text."""
    done = round_trip(docs.select("doc_id", "lang", "source", "text"), tokenizer_path(VOCABULARY), cache_units=TOKEN_CACHE)
    return done.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids",
                       F.coalesce(F.col("decoded") == F.coalesce("text", F.lit("")), F.lit(False)).alias("round_trip"))


STAGES = [("quality rules", quality), ("line dedup", lines), ("n-gram Jaccard join", near_copies),
          ("benchmark decontamination", benchmark_leaks), ("BPE encoding", tokens)]
#: The labelling model and the tokenizer are not expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table."""
    docs = table(spark, sf_dir, "documents")
    folder = new_folder(spark, "pipeline")
    for i, (_, stage) in enumerate(STAGES):
        at = f"{folder}/{i}"
        stage(spark, docs, sf_dir).write.parquet(at)
        docs = spark.read.parquet(at)
    return docs
