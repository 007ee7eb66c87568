"""Token ids in fixed-width bit-packed files with random access.

File layout (little-endian): the magic ``IDPACK01``; blocks of ``BLOCK`` ids, each packed to
``bits`` bits an id (the fewest that hold the vocabulary's largest id), lowest bit first, and
padded to a whole byte; then the index: block byte offsets (n_blocks + 1 int64), documents'
first ids (n_docs + 1 int64), document ids (n_docs int64) and their null flags (n_docs bytes);
then a footer of int64: bits, block size, n_ids, n_docs, n_blocks, index offset. Any id range is
read by seeking to its blocks; a block is unpacked by numpy at once.

``write_ids`` range-partitions documents by id, sorts each partition (null ids first, ties by
the text's digest) and lets every task encode and write one file; files take their name only when
whole, so retried tasks are safe. Each file's place among all ids follows from the files' counts,
one row a file on the driver.

Defined cases: a null or empty text has the end id only; repeated document ids each get their
own entry; an empty table gives no file and no row; other columns are not read.
"""

from __future__ import annotations

import gc
import json
import os
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from churnlens.llm import text as tx
from churnlens.llm.registry import query, table, text_bytes, tokenizer_path
from churnlens.llm.storage import NewFile, file_system, new_folder
from churnlens.llm.units import CACHE_UNITS, UnitCache, added_tokens_are_local

TOKENIZER = "word_bpe_49k.json"
END_ID = 1
BLOCK = 1 << 16
MAGIC = b"IDPACK01"
_FOOTER = struct.Struct("<6q")
#: Text bytes that one file is planned for.
FILE_BYTES = 64 << 20
#: Text bytes encoded at once: a unit is looked up once in them.
SLICE_BYTES = 8 << 20


def bits_for(vocabulary_size: int) -> int:
    return max(1, (vocabulary_size - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    if bits in (8, 16, 32):
        return ids.astype(f"<u{bits // 8}").tobytes()
    rows = ((ids.astype(np.uint32)[:, None] >> np.arange(bits, dtype=np.uint32)) & 1).astype(np.uint8)
    return np.packbits(rows.ravel(), bitorder="little").tobytes()


def unpack(data: bytes, bits: int, n: int) -> np.ndarray:
    if bits in (8, 16, 32):
        return np.frombuffer(data, f"<u{bits // 8}", n).astype(np.uint32)
    rows = np.unpackbits(np.frombuffer(data, np.uint8), bitorder="little")[:n * bits].reshape(n, bits)
    return (rows.astype(np.uint32) << np.arange(bits, dtype=np.uint32)).sum(axis=1, dtype=np.uint32)


class PackWriter:
    def __init__(self, uri: str, bits: int, block: int = BLOCK):
        self.file, self.bits, self.block = NewFile(uri), bits, block
        self.file.write(MAGIC)
        self.pending: list[np.ndarray] = []
        self.n_pending = 0
        self.blocks, self.first, self.doc_ids = [], [0], []

    def add(self, doc_ids: list[int | None], ids: np.ndarray, off: np.ndarray) -> None:
        """Documents with the ids between their offsets."""
        self.doc_ids += doc_ids
        self.first += (off[1:] + self.first[-1]).tolist()
        self.pending.append(ids)
        self.n_pending += len(ids)
        if self.n_pending >= self.block:
            self._flush(self.n_pending // self.block)

    def _flush(self, n_blocks: int | None = None) -> None:
        ids = np.concatenate(self.pending) if self.pending else np.zeros(0, np.uint32)
        stop = len(ids) if n_blocks is None else n_blocks * self.block
        for at in range(0, stop, self.block):
            self.blocks.append(self.file.size)
            self.file.write(pack(ids[at:min(at + self.block, stop)], self.bits))
        self.pending, self.n_pending = [ids[stop:]], len(ids) - stop

    def close(self) -> None:
        self._flush()
        index = self.file.size
        self.file.write(np.array([*self.blocks, index], "<i8").tobytes())
        self.file.write(np.array(self.first, "<i8").tobytes())
        self.file.write(np.array([d or 0 for d in self.doc_ids], "<i8").tobytes())
        self.file.write(np.array([d is None for d in self.doc_ids], np.uint8).tobytes())
        self.file.write(_FOOTER.pack(self.bits, self.block, self.first[-1], len(self.doc_ids), len(self.blocks), index))
        self.file.close()


class PackReader:
    """Random access to one file: ``ids(i, j)`` for an id range, ``document(k)`` for one document."""

    def __init__(self, uri: str):
        fs, path = file_system(uri)
        self.f = fs.open_input_file(path)
        size = self.f.size()
        self.bits, self.block, self.n_ids, n_docs, n_blocks, index = _FOOTER.unpack(
            self.f.read_at(_FOOTER.size, size - _FOOTER.size))
        raw = self.f.read_at(size - _FOOTER.size - index, index)
        if self.f.read_at(len(MAGIC), 0) != MAGIC:
            raise ValueError(f"{uri} is not a packed id file")
        longs = np.frombuffer(raw, "<i8", n_blocks + 1 + n_docs + 1 + n_docs)
        self.offsets, self.first, ids = np.split(longs, [n_blocks + 1, n_blocks + n_docs + 2])
        null = np.frombuffer(raw, np.uint8, n_docs, len(longs) * 8)
        self.doc_ids = [None if x else int(d) for d, x in zip(ids, null)]

    def ids(self, start: int, stop: int) -> np.ndarray:
        if stop <= start:
            return np.zeros(0, np.uint32)
        b0, b1 = start // self.block, (stop - 1) // self.block + 1
        raw = self.f.read_at(int(self.offsets[b1] - self.offsets[b0]), int(self.offsets[b0]))
        parts = []
        for b in range(b0, b1):
            n = min(self.block, self.n_ids - b * self.block)
            parts.append(unpack(raw[int(self.offsets[b] - self.offsets[b0]):int(self.offsets[b + 1] - self.offsets[b0])],
                                self.bits, n))
        return np.concatenate(parts)[start - b0 * self.block:stop - b0 * self.block]

    def document(self, k: int) -> np.ndarray:
        return self.ids(int(self.first[k]), int(self.first[k + 1]))

    def close(self) -> None:
        self.f.close()


class Encoder:
    """Library ids of texts; units between spaces are cached where white space is dropped.

    A unit that is letters and then sentence marks is two words to such a tokenizer; ASCII letters
    are the same word in either case if the normalizer lower-cases. Units seldom come again, their
    words do, so the library encodes each word once as long as the cache holds it.
    """

    MARKS = ".,;:!?"

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        os.environ["TOKENIZERS_PARALLELISM"] = "false"   # Spark's tasks are the parallelism
        lib = Tokenizer.from_file(path)
        lib.no_truncation()
        lib.no_padding()
        self.lib, self.size = lib, lib.get_vocab_size(with_added_tokens=True)
        self.raw = lambda texts: [struct.pack(f"<{len(e)}I", *e.ids)
                                  for e in lib.encode_batch_fast(texts, add_special_tokens=False)]
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        first = ((spec.get("pre_tokenizer") or {}).get("pretokenizers") or [{}])[0]
        pattern = (first.get("pattern") or {}).get("Regex") or ""
        # Words only: what the split pattern does not match, white space included, is removed.
        self.local = (first.get("type") == "Split" and first.get("behavior") == "Removed" and first.get("invert", False)
                      and all(x in pattern for x in (r"[\p{L}]+", r"[^\s\p{L}\p{N}]+")) and not spec.get("post_processor") and added_tokens_are_local(path))
        steps = (spec.get("normalizer") or {}).get("normalizers") or [spec.get("normalizer") or {}]
        self.lower = any(n.get("type") == "Lowercase" for n in steps)
        self.added = [t["content"][:2] for t in spec.get("added_tokens") or []]
        # With a suffix on every word's last token the ids of many words can be told apart.
        suffix = spec["model"].get("end_of_word_suffix")
        self.ends = None
        if suffix:
            self.ends = np.zeros(self.size, bool)
            self.ends[[i for s, i in spec["model"]["vocab"].items() if s.endswith(suffix)]] = True
        self.words = UnitCache(self._words, 2 * CACHE_UNITS, edges=False)
        self.cache = UnitCache(self._units, 2 * CACHE_UNITS, edges=False)

    def _words(self, words: list[str]) -> list[bytes]:
        """Ids of words of letters, many encoded as one text; other units one by one."""
        out: dict[str, bytes] = {}
        letters = [w for w in words if w.isalpha()] if self.ends is not None else []
        groups = [letters[i:i + 1000] for i in range(0, len(letters), 1000)]
        for group, e in zip(groups, self.lib.encode_batch_fast([" ".join(g) for g in groups], add_special_tokens=False)):
            ids = np.array(e.ids, "<u4")
            stops = (np.flatnonzero(self.ends[ids]) + 1) * 4
            if len(stops) == len(group) and stops[-1] == 4 * len(ids):
                raw, stops = ids.tobytes(), stops.tolist()
                out.update(zip(group, [raw[s:e] for s, e in zip([0, *stops], stops)]))
        rest = [w for w in words if w not in out]
        out.update(zip(rest, self.raw(rest)))
        return [out[w] for w in words]

    def _units(self, units: list[str]) -> list[bytes]:
        cut = []
        for u in units:
            core = u.rstrip(self.MARKS)
            if core.isalpha():
                tail = u[len(core):]
                cut.append((core.lower() if self.lower and core.isascii() else core, tail))
            else:
                cut.append((u, ""))
        words = {w for pair in cut for w in pair}
        got = self.words.fill(words)
        return [got[core] + got[tail] if tail else got[core] for core, tail in cut]

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """``_encode`` without the collector of cycles, which would go through all the strings it makes."""
        on = gc.isenabled()
        gc.disable()
        try:
            return self._encode(texts)
        finally:
            if on:
                gc.enable()

    def _encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids, offsets) of a column of texts; null counts as empty.

        Where white space only separates words, the column is cut there, its distinct units are
        looked up once and their ids are dealt back by one gather. A-Z is lowered first where the
        tokenizer would do it, so that units come again more often.
        """
        texts = pc.fill_null(texts, "")
        mixed = any(pc.any(pc.match_substring(texts, a)).as_py() for a in self.added)
        if not self.local:
            raw = self.raw(texts.to_pylist())
            return np.frombuffer(b"".join(raw), "<u4"), np.cumsum([0, *(len(r) // 4 for r in raw)])
        lists = pc.ascii_split_whitespace(pc.ascii_lower(texts) if self.lower and not mixed else texts)
        units = pc.dictionary_encode(lists.flatten())
        names = units.dictionary.to_pylist()
        values = list(map(self.cache.young.get, names))
        miss = [n for n, v in zip(names, values) if v is None]
        if miss:
            got = self.cache.fill(set(miss))
            values = [got[n] if v is None else v for n, v in zip(names, values)]
        blob = np.frombuffer(b"".join(values), "<u4")
        size = np.fromiter(map(len, values), np.int64, len(values)) // 4
        start = np.cumsum(size) - size
        index = np.asarray(units.indices)
        sizes = size[index]
        stop = np.concatenate([[0], np.cumsum(sizes)])
        at = np.repeat(start[index] - stop[:-1], sizes) + np.arange(stop[-1])
        counts = np.concatenate([[0], np.cumsum(np.asarray(pc.list_value_length(lists)))])
        return blob[at], stop[counts]


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def write_ids(df: DataFrame, path: str, folder: str, end_id: int | None = None, id_col: str = "doc_id",
              text_col: str = "text", block: int = BLOCK, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Write packed files in ascending document order; returns (file, n_docs, n_ids, start), one row a file."""
    spark = df.sparkSession
    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), text_bytes(docs) // file_bytes + 1)
    # Rows of one id (or without one) may be many: the text's hash deals them out.
    order = [F.asc_nulls_first("doc_id"), F.xxhash64("text")]
    ordered = docs.repartitionByRange(parts, *order).sortWithinPartitions(*order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e, out, name = encoder(path), None, ""
        for whole in batches:
            for b in tx.slices(whole, "text", SLICE_BYTES):
                if out is None:
                    name = f"{folder}/part-{TaskContext.get().partitionId():06d}.ids"
                    out = PackWriter(name, bits_for(max(e.size, (end_id or 0) + 1)), block)
                ids, off = e.encode(b.column(1))
                if end_id is not None:
                    ids, off = np.insert(ids, off[1:], end_id), off + np.arange(len(off))
                out.add(b.column(0).to_pylist(), ids, off)
        if out is not None:
            out.close()
            keys = [d for d in out.doc_ids if d is not None]
            yield pa.RecordBatch.from_pydict({
                "file": [name], "least": pa.array([keys[0] if keys else None], pa.int64()),
                "n_docs": pa.array([len(out.doc_ids)], pa.int64()), "n_ids": pa.array([out.first[-1]], pa.int64())})

    files = ordered.mapInArrow(run, "file string, least long, n_docs long, n_ids long").collect()   # one row a file
    files.sort(key=lambda r: r.file)        # the ranges' order
    start, rows = 0, []
    for r in files:
        rows.append((r.file, r.n_docs, r.n_ids, start))
        start += r.n_ids
    return spark.createDataFrame(rows, "file string, n_docs long, n_ids long, start long")


def _documents(name: str, start: int) -> Iterator[tuple[pa.Array, pa.Array, np.ndarray, np.ndarray]]:
    """A file's documents in parts of about 1 M ids: document ids, first ids, offsets, ids."""
    r = PackReader(name)
    at, n = 0, len(r.doc_ids)
    while at < n:
        stop = max(at + 1, int(np.searchsorted(r.first, r.first[at] + (1 << 20), "right")) - 1)
        ids = r.ids(int(r.first[at]), int(r.first[stop]))
        yield (pa.array(r.doc_ids[at:stop], pa.int64()), pa.array(r.first[at:stop] + start, pa.int64()),
               r.first[at:stop + 1] - r.first[at], ids)
        at = stop
    r.close()


def _one_task_a_file(files: DataFrame) -> DataFrame:
    return files.select("file", "start").repartition(max(1, files.count()))


def read_ids(files: DataFrame) -> DataFrame:
    """Documents of the files that ``write_ids`` lists: doc_id, start (ids before it), ids."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, start in zip(b.column("file").to_pylist(), b.column("start").to_pylist()):
                for doc, first, off, ids in _documents(name, start):
                    lists = pa.ListArray.from_arrays(pa.array(off.astype(np.int32)), pa.array(ids.astype(np.int32)))
                    yield pa.RecordBatch.from_arrays([doc, first, lists], ["doc_id", "start", "ids"])

    return _one_task_a_file(files).mapInArrow(run, "doc_id long, start long, ids array<int>")


def digests(files: DataFrame) -> DataFrame:
    """Of the documents in the files: doc_id, start, n_tokens, ids_crc32 of the ids as 32-bit little-endian."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, start in zip(b.column("file").to_pylist(), b.column("start").to_pylist()):
                for doc, first, off, ids in _documents(name, start):
                    raw = memoryview(np.ascontiguousarray(ids, "<u4")).cast("B")
                    ends = (off * 4).tolist()
                    crc = [zlib.crc32(raw[s:e]) for s, e in zip(ends, ends[1:])]
                    yield pa.RecordBatch.from_pydict({"doc_id": doc, "start": first, "n_tokens": pa.array(np.diff(off)),
                                                      "ids_crc32": pa.array(crc, pa.int64())})

    return _one_task_a_file(files).mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


@query("op8_packed_ids")
def op8_packed_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's ids written to packed files in document order and read back."""
    docs = table(spark, sf_dir, "documents")
    files = write_ids(docs, tokenizer_path(TOKENIZER), new_folder(spark, "packed-ids"), END_ID)
    return digests(files)
