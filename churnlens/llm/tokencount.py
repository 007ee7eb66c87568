"""Token counts by overlap resynchronisation.

A text of more than ``chunk_chars`` characters is encoded in overlapping chunks with offsets.
Two neighbouring encodings are spliced at a common boundary: a character position inside the
overlap at which both have a token start and at which the pre-tokenizer splits whatever stands
around it (a single space between two non-space characters, outside added tokens). Where an
overlap has no such position the chunk is encoded again with its overlap doubled, up to the end
of the text. Tokens of chunk i count from its splice with chunk i - 1 to that with chunk i + 1.

Shorter texts are one chunk. The same boundaries cut them into units (``units``), whose library
encodings a bounded cache keeps. Tokenizers for which the boundary is not proven (a pre-tokenizer
other than byte-level, a normalizer, added tokens with white space, SentencePiece models) get
whole texts instead.

Defined cases: a null or empty text has 0 bytes and 0 tokens; repeated rows are counted each;
other columns are kept, equal-named ones replaced.
"""

from __future__ import annotations

import json
import os
from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from churnlens.llm import text as tx
from churnlens.llm.registry import query, small_batches, table, tokenizer_path
from churnlens.llm.units import UnitCache, added_tokens_are_local, combined_units

TOKENIZER = "byte_bpe_50k.json"
CHUNK_CHARS = 32_768
OVERLAP_CHARS = 512
LIMIT = 1024


def _boundary(text: str, at: int) -> bool:
    return 0 < at < len(text) - 1 and text[at] == " " and not text[at - 1].isspace() and not text[at + 1].isspace()


class Counter:
    """Counts tokens as one tokenizer file's library does, special strings by its default."""

    def __init__(self, path: str, chunk_chars: int = CHUNK_CHARS, overlap_chars: int = OVERLAP_CHARS):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"   # Spark's tasks are the parallelism
        self.chunk, self.overlap, self.widened = chunk_chars, overlap_chars, 0
        if path.endswith(".model"):
            import sentencepiece
            model = sentencepiece.SentencePieceProcessor(model_file=path)
            self.raw = lambda texts: [len(ids) for ids in model.encode(list(texts), num_threads=1)]
            self.proven = False
            return
        from tokenizers import Tokenizer
        lib = Tokenizer.from_file(path)
        lib.no_truncation()
        lib.no_padding()
        self.lib = lib
        self.raw = lambda texts: [len(e) for e in lib.encode_batch_fast(texts, add_special_tokens=False)]
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre = spec.get("pre_tokenizer") or {}
        self.proven = (pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space")
                       and not spec.get("normalizer") and not spec.get("post_processor")
                       and added_tokens_are_local(path))
        self.cache = UnitCache(lambda units: self.raw([" " + u for u in units]))

    def count(self, texts: list[str]) -> list[int]:
        if not self.proven:
            return self.raw(texts)
        short = [t for t in texts if len(t) <= self.chunk]
        counts = combined_units(short, self.cache, self.raw, sum)
        return [next(counts) if len(t) <= self.chunk else self.spliced(t) for t in texts]

    def _starts(self, text: str, begin: int, end: int) -> list[int]:
        """First character of each token of text[begin:end], as positions in the text."""
        return [begin + s for s, _ in self.lib.encode(text[begin:end], add_special_tokens=False).offsets]

    def spliced(self, text: str) -> int:
        """Tokens of a long text from overlapping chunks."""
        total, begin, splice = 0, 0, 0
        end = min(self.chunk, len(text))
        starts = self._starts(text, begin, end)
        while end < len(text):
            overlap = self.overlap
            while True:
                nxt = max(end - overlap, begin + 1)
                next_end = min(nxt + self.chunk + overlap, len(text))
                following = self._starts(text, nxt, next_end)
                both = set(starts).intersection(following)
                # The edges of both chunks are left out: what stands beyond them may join in.
                cut = next((p for p in range(nxt + 1, end - 1) if p > splice and p in both and _boundary(text, p)), None)
                if cut is not None:
                    break
                # No alignment: widen to both sides and encode again.
                self.widened += 1
                overlap *= 2
                end = min(end + overlap, len(text))
                starts = self._starts(text, begin, end)
                if end == len(text):
                    return total + len(starts) - bisect_left(starts, splice)
            total += bisect_left(starts, cut) - bisect_left(starts, splice)
            begin, end, starts, splice = nxt, next_end, following, cut
        return total + len(starts) - bisect_left(starts, splice)


@lru_cache(maxsize=2)
def counter(path: str, chunk_chars: int, overlap_chars: int) -> Counter:
    return Counter(path, chunk_chars, overlap_chars)


def token_counts(df: DataFrame, path: str, text_col: str = "text", limit: int = LIMIT,
                 chunk_chars: int = CHUNK_CHARS, overlap_chars: int = OVERLAP_CHARS) -> DataFrame:
    """Add n_bytes, n_tokens and over_limit (n_tokens > limit)."""
    base = df.drop("n_bytes", "n_tokens", "over_limit")
    schema = T.StructType([*base.schema.fields, T.StructField("n_tokens", T.LongType(), False)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = counter(path, chunk_chars, overlap_chars)
        for whole in batches:
            for b in tx.slices(whole, text_col):
                texts = [t or "" for t in b.column(b.schema.get_field_index(text_col)).to_pylist()]
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(c.count(texts), pa.int64())],
                                                 [*b.schema.names, "n_tokens"])

    return (small_batches(base).mapInArrow(run, schema)
            .withColumn("n_bytes", F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long"))
            .withColumn("over_limit", F.col("n_tokens") > limit))


@query("op3_token_counts")
def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes and tokens of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return token_counts(docs, tokenizer_path(TOKENIZER)).select("doc_id", "n_bytes", "n_tokens", "over_limit")
