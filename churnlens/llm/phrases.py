"""Phrase collocations by dynamic itemset counting over cyclic shards of the corpus.

Rows are dealt into ``shards`` shards by a hash, and the shards are scanned in a cycle. Words are counted
from the first scan on. After each scan the phrases that have reached the threshold so far are known, and
a longer phrase is counted from the scan after the one in which both its subphrases (all words but the
last, all but the first) have reached it. Every phrase is counted for one full cycle from its start,
so its count is exact, and the scans end when no phrase is still in its cycle: lengths overlap instead
of taking a whole pass each.

A phrase is a 64-bit hash of its words and its language. Scans count hashes (a numpy count for each slice of text,
then a Spark aggregate); the unfinished counts of the scan before are added in the same aggregate, and of
finished phrases only those that reach the threshold are kept. Which phrases have reached the threshold, and
when, stands in a table of ``slots`` bytes: a phrase has two slots, each with the number of the
first scan that may use it. A clash of slots can only start a phrase that need not be counted; since a
slot never changes once it is set, its start stays the same and its count stays exact. The table is the only
thing that goes through the driver, and its size is a parameter.

Two more scans name the frequent phrases: in the first a task spells only a share of those it meets (they occur
in many tasks), in the second those that no task has spelled. Joins give the counts of their parts, and the exact
global order ranks them within each language.

Defined cases: a null text is empty, a null language is ``und``; repeated rows count each; two phrases
are taken for one if their hashes agree (one in 2**64 for each pair); other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from churnlens.functions.prefix import global_order
from churnlens.llm import text as tx
from churnlens.llm.registry import query, table
from churnlens.llm.storage import NewFile, file_system, new_folder

THRESHOLD = 10
WORDS = 3
SHARDS = 2
#: Bytes of the table of activations (a power of two); more give fewer needless counts.
SLOTS = 1 << 24
#: A phrase inside a longer one with this share of its count is dropped (percent).
INSIDE = 50
TOP = 2000
SLICE_BYTES = 4 << 20
#: A task spells one in so many of the phrases that it meets in the first scan for names.
SPELL = 6
NEVER = 255
_BLOCK = 1 << 15

_SEPARATOR = np.zeros(256, bool)
_SEPARATOR[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
_WORD = ~_SEPARATOR
_WORD[[0x20, 0x09]] = False
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A"):ord("Z") + 1] += 32


class Phrases:
    """The words of a slice of texts and the hashes of their windows."""

    def __init__(self, batch: pa.RecordBatch, n_max: int):
        raw, off = tx.column_bytes(batch.column(0))
        self.words = w = tx.words_of(_LOWER[raw], off, _WORD)
        langs = pc.fill_null(batch.column(1), "und").dictionary_encode()
        names, at = tx.column_bytes(langs.dictionary)
        of_lang = tx.hash_spans(names, at[:-1], at[1:], seed=2)
        doc = tx.word_docs(w.first)
        self.lang = of_lang[np.asarray(langs.indices)][doc]
        # Words of one piece have the same number of separators before them and the same document.
        piece = (np.cumsum(_SEPARATOR[w.data])[w.starts] if len(doc) else np.zeros(0, np.int64)) + doc
        self.hashes = [np.zeros(0, np.uint64), tx.with_doc(tx.word_hashes(w), self.lang)]
        self.ok = [None, np.ones(len(doc), bool)]
        for n in range(2, n_max + 1):
            m = max(len(doc) - n + 1, 0)
            self.hashes.append(tx.with_doc(self.hashes[n - 1][:m], self.hashes[1][n - 1:]))
            self.ok.append(piece[:m] == piece[n - 1:])


def slots_of(h: np.ndarray, slots: int) -> tuple[np.ndarray, np.ndarray]:
    """The two places of each hash in the table."""
    mask = np.uint64(slots - 1)
    return (h & mask).astype(np.int64), ((h >> np.uint64(32)) & mask).astype(np.int64)


@lru_cache(maxsize=2)
def read_slots(uri: str) -> np.ndarray:
    store, path = file_system(uri)
    with store.open_input_stream(path) as f:
        return np.frombuffer(zlib.decompress(f.read()), np.uint8)


tx.KEPT.append(read_slots.cache_clear)


def write_slots(uri: str, values: np.ndarray) -> None:
    f = NewFile(uri)
    f.write(zlib.compress(values.tobytes(), 1))
    f.close()


def starts_of(p: Phrases, n: int, values: np.ndarray) -> np.ndarray:
    """For each window of n words the first scan that counts it (NEVER: none yet)."""
    a, b = slots_of(p.hashes[n - 1], len(values))
    part = np.maximum(values[a], values[b])
    m = len(p.hashes[n])
    return np.maximum(part[:m], part[1:m + 1])


def _count(uri: str, scan: int, shards: int, n_max: int):
    """Counts of one scan: (h, code, c); code is 256 * words + start, 0 words stand for a language's total."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tx.release()
        values = read_slots(uri)
        for whole in batches:
            for b in tx.slices(whole, "t", SLICE_BYTES):
                p = Phrases(b, n_max)
                for n in range(n_max + 1):
                    if n < 2:
                        if scan >= shards:
                            continue
                        h, start = (p.lang if n == 0 else p.hashes[1]), None
                    else:
                        begin = starts_of(p, n, values)
                        on = p.ok[n] & (begin <= scan) & (begin.astype(np.int64) + shards > scan)
                        h, start = p.hashes[n][on], begin[on]
                    if not len(h):
                        continue
                    keys, first, c = np.unique(h, return_index=True, return_counts=True)
                    code = np.full(len(keys), 256 * n, np.int32)
                    if start is not None:
                        code += start[first]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(keys.view(np.int64)), pa.array(code), pa.array(c.astype(np.int64))], ["h", "code", "c"])
    return run


def _slot_bits(hashes: DataFrame, slots: int) -> np.ndarray:
    """True for the slots of these hashes; tasks mark blocks of slots, the driver gets their bits."""
    def mark(t: pa.Table) -> pa.Table:
        bits = np.zeros(_BLOCK, bool)
        bits[np.asarray(t["slot"]) % _BLOCK] = True
        return pa.table({"block": t["block"].slice(0, 1), "bits": pa.array([np.packbits(bits).tobytes()], pa.binary())})

    low = F.col("h").bitwiseAND(F.lit(slots - 1))
    high = F.shiftrightunsigned("h", 32).bitwiseAND(F.lit(slots - 1))
    marked = (hashes.select(F.explode(F.array(low, high)).alias("slot")).distinct()
              .withColumn("block", F.floor(F.col("slot") / _BLOCK)).groupBy("block").applyInArrow(mark, "block long, bits binary"))
    out = np.zeros(max(slots, _BLOCK), bool)
    for r in marked.collect():      # at most slots / 8 bytes
        out[r.block * _BLOCK:(r.block + 1) * _BLOCK] = np.unpackbits(np.frombuffer(r.bits, np.uint8)).astype(bool)
    return out[:slots]


def count_phrases(df: DataFrame, text_col: str = "text", lang_col: str = "lang", threshold: int = THRESHOLD,
                  n_max: int = WORDS, shards: int = SHARDS, slots: int = SLOTS) -> tuple[DataFrame, int]:
    """((h, n, f) of the phrases that reach the threshold and of the languages (n = 0), number of scans)."""
    if not (slots & (slots - 1) == 0 and 1 <= slots <= 1 << 31 and n_max * shards < NEVER):
        raise ValueError("slots must be a power of two up to 2**31, and the scans fewer than 255")
    spark = df.sparkSession
    folder = new_folder(spark, "phrases")
    texts = df.select(F.col(f"`{text_col}`").alias("t"), F.col(f"`{lang_col}`").cast("string").alias("lang"))
    values = np.full(slots, NEVER, np.uint8)
    scan = last = 0
    code_n, code_start = F.floor(F.col("code") / 256), F.col("code") % 256
    while scan < last + shards:
        uri = f"{folder}/slots-{scan}"
        write_slots(uri, values)
        here = texts.filter(F.pmod(F.xxhash64("t", "lang"), F.lit(shards)) == scan % shards)
        found = here.mapInArrow(_count(uri, scan, shards, n_max), "h long, code int, c long")
        if scan:
            going = spark.read.parquet(f"{folder}/counts-{scan - 1}").filter(code_start + shards > scan)
            found = found.unionByName(going)
        counts = found.groupBy("h", "code").agg(F.sum("c").alias("c"))
        done = code_start + shards == scan + 1
        counts.filter(~done | (F.col("c") >= threshold) | (code_n == 0)).write.parquet(f"{folder}/counts-{scan}")
        counts = spark.read.parquet(f"{folder}/counts-{scan}")
        reached = counts.filter((F.col("c") >= threshold) & (code_n >= 1) & (code_n < n_max))
        new = _slot_bits(reached, slots) & (values == NEVER)
        scan += 1
        if new.any():
            values[new] = scan
            last = scan
    ended = [spark.read.parquet(f"{folder}/counts-{s}").filter(code_start + shards == s + 1) for s in range(scan)]
    return reduce(DataFrame.unionByName, ended).select("h", code_n.cast("int").alias("n"), F.col("c").alias("f")), scan


def _name(uri: str, n_max: int, spell: int):
    """(h, lang, phrase) of the windows of two words and more whose slots are set, each once a task and
    only those that fall to the task."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tx.release()
        wanted = read_slots(uri) == 1
        task = TaskContext.get().partitionId()
        seen = np.zeros(0, np.uint64)
        for whole in batches:
            for b in tx.slices(whole, "t", SLICE_BYTES):
                p = Phrases(b, n_max)
                lang = pc.fill_null(b.column(1), "und")
                for n in range(2, n_max + 1):
                    a, c = slots_of(p.hashes[n], len(wanted))
                    at = np.flatnonzero(p.ok[n] & wanted[a] & wanted[c])
                    h = p.hashes[n][at]
                    mine = tx.with_doc(h, np.full(len(h), task)) % np.uint64(spell) == 0
                    h, first = np.unique(h[mine], return_index=True)
                    at = at[mine][first]
                    new = ~np.isin(h, seen, assume_unique=True)
                    h, at = h[new], at[new]
                    if not len(at):
                        continue
                    seen = np.concatenate([seen, h])
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(h.view(np.int64)), lang.take(pa.array(tx.word_docs(p.words.first)[at])), _spelled(p.words, at, n)],
                        ["h", "lang", "phrase"])
    return run


def _parts(n_max: int):
    """Adds to spelled phrases the hash of the language and those of all proper parts."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in tx.slices(whole, "phrase", SLICE_BYTES):
                p = Phrases(b.select(["phrase", "lang"]), n_max)
                first, size = p.words.first[:-1], np.diff(p.words.first)
                rows, values = [], []
                for n in range(2, n_max + 1):
                    mine = np.flatnonzero(size == n)
                    rows.append(mine)
                    values.append(np.stack([p.hashes[m][first[mine] + i] for m in range(1, n) for i in range(n - m + 1)], 1))
                order = np.concatenate(rows)
                width = np.concatenate([np.full(len(r), v.shape[1]) for r, v in zip(rows, values)])
                parts = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(width)]), pa.int32()),
                                                 pa.array(np.concatenate([v.ravel() for v in values]).view(np.int64)))
                out = b.take(pa.array(order))
                yield pa.RecordBatch.from_arrays([*out.columns, pa.array(p.lang[first[order]].view(np.int64)), parts],
                                                 [*out.schema.names, "lh", "parts"])
    return run


def _spelled(w: tx.Words, at: np.ndarray, n: int) -> pa.Array:
    """The n words from each word in ``at``, joined by one space."""
    if len(w.data) < 2**31:
        text = [pa.array([], pa.string())] * n
        for i in range(n):
            s, size = w.starts[at + i], (w.ends - w.starts)[at + i]
            off = np.concatenate([[0], np.cumsum(size)])
            pick = np.repeat(s - off[:-1], size) + np.arange(off[-1])
            text[i] = pa.LargeStringArray.from_buffers(len(at), pa.py_buffer(off.astype(np.int64).tobytes()),
                                                       pa.py_buffer(w.data[pick].tobytes()))
        return pc.binary_join_element_wise(*text, pa.scalar(" ", pa.large_string())).cast(pa.string())
    raise ValueError("a slice of texts is larger than 2 GB")


def part_index(n: int, first: int, words: int) -> int:
    """Where ``parts`` of a phrase of n words holds the part of ``words`` words from word ``first``."""
    return sum(n - m + 1 for m in range(1, words)) + first


def collocations(df: DataFrame, text_col: str = "text", lang_col: str = "lang", threshold: int = THRESHOLD,
                 n_max: int = WORDS, inside: int = INSIDE, shards: int = SHARDS, slots: int = SLOTS) -> DataFrame:
    """(lang, phrase, a, l, r, n, score) of the phrases of two words and more that are not inside a longer one."""
    spark = df.sparkSession
    folder = new_folder(spark, "collocations")
    counted, _ = count_phrases(df, text_col, lang_col, threshold, n_max, shards, slots)
    phrases = counted.filter("n >= 2")
    texts = df.select(F.col(f"`{text_col}`").alias("t"), F.col(f"`{lang_col}`").cast("string").alias("lang"))
    left = phrases
    for i, spell in enumerate((SPELL, 1)):
        write_slots(f"{folder}/wanted-{i}", _slot_bits(left, slots).astype(np.uint8))
        found = texts.mapInArrow(_name(f"{folder}/wanted-{i}", n_max, spell), "h long, lang string, phrase string")
        found = found.groupBy("h").agg(F.min("lang").alias("lang"), F.min("phrase").alias("phrase"))
        found.join(left, "h").write.parquet(f"{folder}/spelled-{i}")
        left = left.join(spark.read.parquet(f"{folder}/spelled-{i}"), "h", "left_anti")
    named = spark.read.parquet(f"{folder}/spelled-0").unionByName(spark.read.parquet(f"{folder}/spelled-1"))
    named = named.mapInArrow(_parts(n_max), "h long, lang string, phrase string, n int, f long, lh long, parts array<long>")
    named.write.parquet(f"{folder}/named")
    named = spark.read.parquet(f"{folder}/named")
    counts = counted.select(F.col("h").alias("p"), F.col("f").alias("pf"))
    # The counts of all parts of each candidate, and each part's most frequent longer phrase.
    parts = named.select("h", "n", F.col("f").alias("a"), F.posexplode("parts").alias("i", "p"))
    known = parts.join(counts, "p").groupBy("h").agg(F.map_from_entries(F.collect_list(F.struct("i", "pf"))).alias("pf"))
    longer = parts.filter("n > 2").groupBy("p").agg(F.max("a").alias("most")).withColumnRenamed("p", "h")
    total = counted.filter("n = 0").select(F.col("h").alias("lh"), F.col("f").alias("total"))
    rows = named.join(longer, "h", "left").filter(F.expr(f"most IS NULL OR 100 * most < {inside} * f")).drop("most")
    rows = rows.join(known, "h").join(total, "lh")
    cut = "struct(" + "floor_score({l}, {r}) AS score, {k} AS k, {l} AS l, {r} AS r)"
    score = "CAST(1000000 * CAST(f AS DECIMAL(16,0)) * CAST(f AS DECIMAL(16,0)) div (CAST({l} AS DECIMAL(19,0)) * CAST({r} AS DECIMAL(18,0))) AS BIGINT)"
    best = F.lit(None)
    for n in range(2, n_max + 1):
        cuts = []
        for k in range(1, n):
            left, right = f"pf[{part_index(n, 0, k)}]", f"pf[{part_index(n, k, n - k)}]"
            cuts.append(cut.replace("floor_score({l}, {r})", score).format(l=left, r=right, k=k))
        best = F.when(F.col("n") == n, F.expr(f"array_min(array({', '.join(cuts)}))")).otherwise(best)
    rows = rows.withColumn("cut", best)
    return rows.select("lang", "phrase", F.col("f").alias("a"), F.col("cut.l").alias("l"), F.col("cut.r").alias("r"),
                       F.col("total").alias("n"), F.col("cut.score").alias("score"))


def top_collocations(df: DataFrame, top: int = TOP, **options) -> DataFrame:
    """Each language's first ``top`` collocations by score, count and phrase, with their rank."""
    ranked = global_order(collocations(df, **options), [("lang", True), ("score", False), ("a", False), ("phrase", True)],
                          rank_col="rank", partition_by=["lang"])
    return ranked.filter(F.col("rank") <= top).select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


_SQL = f"""
WITH t AS (SELECT coalesce(lang, 'und') AS lang,
                  translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
pieces AS (SELECT lang, unnest(regexp_split_to_array(text, '[.,;:!?\\x0A-\\x0D]')) AS piece FROM t),
w AS MATERIALIZED (SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS ws FROM pieces),
g AS (SELECT lang, 1 AS k, unnest(ws) AS phrase FROM w
      UNION ALL SELECT lang, 2, unnest([ws[i] || ' ' || ws[i + 1] FOR i IN range(1, len(ws))]) FROM w
      UNION ALL SELECT lang, 3, unnest([ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] FOR i IN range(1, len(ws) - 1)]) FROM w),
f AS MATERIALIZED (SELECT lang, k, phrase, count(*) AS c FROM g GROUP BY ALL),
total AS (SELECT lang, sum(c)::BIGINT AS n FROM f WHERE k = 1 GROUP BY lang),
cand AS MATERIALIZED (SELECT lang, k, phrase, c AS a, string_split(phrase, ' ') AS ws FROM f WHERE k >= 2 AND c >= {THRESHOLD}),
cut AS (SELECT lang, k, phrase, a, 1 AS pos, ws[1] AS x, array_to_string(ws[2:], ' ') AS y FROM cand
        UNION ALL SELECT lang, k, phrase, a, 2, ws[1] || ' ' || ws[2], ws[3] FROM cand WHERE k = 3),
scored AS (SELECT cut.*, l.c AS l, r.c AS r, ((1000000::HUGEINT * a * a) // (l.c::HUGEINT * r.c))::BIGINT AS score
           FROM cut JOIN f l ON l.lang = cut.lang AND l.phrase = x AND l.k = pos JOIN f r ON r.lang = cut.lang AND r.phrase = y AND r.k = cut.k - pos),
least AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, pos) = 1),
longer AS (SELECT lang, phrase, max(a) AS most FROM (
    SELECT lang, ws[1] || ' ' || ws[2] AS phrase, a FROM cand WHERE k = 3
    UNION ALL SELECT lang, ws[2] || ' ' || ws[3], a FROM cand WHERE k = 3) GROUP BY ALL),
kept AS (SELECT least.* FROM least LEFT JOIN longer USING (lang, phrase) WHERE k = 3 OR most IS NULL OR 100 * most < {INSIDE} * a),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN total USING (lang) WHERE rank <= {TOP}
"""


@query("op12_collocations", _SQL)
def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 2000 strongest collocations of two and three words of each language."""
    return top_collocations(table(spark, sf_dir, "documents").select("text", "lang"))
