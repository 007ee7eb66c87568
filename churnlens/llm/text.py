"""Vectorised word, line and window kernels over the bytes of an Arrow string column.

All functions work on whole texts: a batch is the concatenated UTF-8 of its documents plus
offsets, words and lines are byte spans, and every per-word step is a numpy operation.
Words are maximal runs of bytes other than 0x20 and 0x09-0x0D, which are the words
``[^\\x20\\x09-\\x0D]+`` of the text, because those bytes never occur inside a longer UTF-8
sequence.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# Workers live long: what one batch needed goes back to the system after it.
pa.set_memory_pool(pa.system_memory_pool())
U64 = np.uint64
#: Bytes hashed at once; bounds the working memory of the kernels, not the texts.
SEGMENT = 2 << 20
#: Text bytes per numpy batch (a longer document is a batch of its own).
BATCH_BYTES = 4 << 20

_WORD = np.ones(256, bool)
_WORD[[0x20, *range(0x09, 0x0E)]] = False
_CONT = np.zeros(256, bool)
_CONT[0x80:0xC0] = True


class Words(NamedTuple):
    data: np.ndarray      # uint8, the batch's bytes
    starts: np.ndarray    # first byte of each word
    ends: np.ndarray      # byte after each word
    first: np.ndarray     # index of each document's first word, plus the total


#: What other operators have left in this worker and can make again.
KEPT: list[Callable[[], None]] = []


def release() -> None:
    """Drop what earlier operators keep in this worker, and give freed memory back to the system
    (glibc only)."""
    for drop in KEPT:
        drop()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def column_bytes(arr: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary column; null counts as empty."""
    if isinstance(arr, pa.ChunkedArray):
        arr = arr.combine_chunks()
    if arr.null_count:
        arr = pc.fill_null(arr, b"" if pa.types.is_binary(arr.type) or pa.types.is_large_binary(arr.type) else "")
    wide = pa.types.is_large_string(arr.type) or pa.types.is_large_binary(arr.type)
    _, off_buf, data_buf = arr.buffers()
    n = len(arr)
    if n == 0 or off_buf is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    off = np.frombuffer(off_buf, np.int64 if wide else np.int32)[arr.offset:arr.offset + n + 1].astype(np.int64)
    data = np.frombuffer(data_buf, np.uint8) if data_buf is not None else np.zeros(0, np.uint8)
    return data[off[0]:off[-1]], off - off[0]


def slices(batch: pa.RecordBatch, column: str, limit: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that the column holds about ``limit`` bytes in each part (whole rows)."""
    if batch.num_rows == 0:
        return
    _, off = column_bytes(batch.column(batch.schema.get_field_index(column)))
    at = 0
    while at < batch.num_rows:
        end = int(np.searchsorted(off, off[at] + limit, "right")) - 1
        end = min(max(end, at + 1), batch.num_rows)
        yield batch.slice(at, end - at)
        at = end


def span_count(mask: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Number of true values in each span; spans ascend and do not overlap."""
    out = np.zeros(len(starts), np.int64)
    full = np.flatnonzero(ends > starts)
    if len(full):
        s, e = starts[full], ends[full]
        edges = np.empty(2 * len(full), np.int64)
        edges[0::2], edges[1::2] = s, e
        if edges[-1] >= len(mask):
            edges = edges[:-1]
        out[full] = np.add.reduceat(mask, edges, dtype=np.int64)[0::2]
    return out


def words_of(data: np.ndarray, off: np.ndarray, table: np.ndarray = _WORD) -> Words:
    """Maximal runs of bytes that ``table`` marks, within each document."""
    mark = table[data]
    before = np.empty(len(mark), bool)
    before[:1] = False
    before[1:] = mark[:-1]
    inner = off[(off > 0) & (off < len(data))]
    before[inner] = False
    starts = np.flatnonzero(mark & ~before)
    after = np.empty(len(mark), bool)
    after[-1:] = False
    after[:-1] = mark[1:]
    after[inner - 1] = False
    ends = np.flatnonzero(mark & ~after) + 1
    return Words(data, starts, ends, np.searchsorted(starts, off))


def _mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> U64(30))
    h *= U64(0xBF58476D1CE4E5B9)
    h ^= h >> U64(27)
    h *= U64(0x94D049BB133111EB)
    h ^= h >> U64(31)
    return h


_TABLES: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}


def _powers(base: int, n: int) -> np.ndarray:
    p = np.full(n, U64(base))
    p[0] = 1
    return np.cumprod(p, dtype=U64)


def _tables(seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    if seed not in _TABLES:
        rng = np.random.default_rng(1000 + seed)
        base = int(rng.integers(1 << 62, 1 << 63)) * 2 + 1
        lut = rng.integers(1, 1 << 63, 256, dtype=np.uint64) * U64(2) + U64(1)
        n = SEGMENT + 1
        _TABLES[seed] = (lut, _powers(base & (2**64 - 1), n), _powers(pow(base, -1, 2**64), n))
    return _TABLES[seed]


def hash_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """64-bit Rabin-Karp hash of the bytes of each span (spans ascend, no overlap).

    Spans are taken in segments of ``SEGMENT`` bytes; a longer span is hashed in pieces.
    """
    out = np.empty(len(starts), U64)
    lut, pw, inv = _tables(seed)
    at, n = 0, len(starts)
    with np.errstate(over="ignore"):
        while at < n:
            end = int(np.searchsorted(ends, starts[at] + SEGMENT, "right"))
            if end <= at:   # one span longer than a segment
                h = U64(0)
                for b in range(int(starts[at]), int(ends[at]), SEGMENT):
                    part = lut[data[b:min(b + SEGMENT, int(ends[at]))]]
                    h = _mix(np.array([h + (part * pw[:len(part)]).sum(dtype=U64)]))[0]
                out[at] = h + U64(int(ends[at] - starts[at]))
                at += 1
                continue
            lo, hi = int(starts[at]), int(ends[end - 1])
            c = np.empty(hi - lo + 1, U64)
            c[0] = 0
            np.cumsum(lut[data[lo:hi]] * pw[:hi - lo], dtype=U64, out=c[1:])
            s, e = starts[at:end] - lo, ends[at:end] - lo
            out[at:end] = (c[e] - c[s]) * inv[s] + (e - s).astype(U64)
            at = end
        return _mix(out)


def word_hashes(w: Words, seed: int = 0) -> np.ndarray:
    return hash_spans(w.data, w.starts, w.ends, seed)


def word_docs(first: np.ndarray) -> np.ndarray:
    """Document index of each word."""
    return np.repeat(np.arange(len(first) - 1), np.diff(first))


def window_starts(first: np.ndarray, k: int) -> np.ndarray:
    """Word indexes at which a window of k words of one document starts."""
    n = np.maximum(np.diff(first) - (k - 1), 0)
    total = int(n.sum())
    shift = np.repeat(first[:-1] - (np.cumsum(n) - n), n)
    return np.arange(total, dtype=np.int64) + shift


def window_hashes(wh: np.ndarray, at: np.ndarray, k: int, seed: int = 0) -> np.ndarray:
    """Rabin-Karp hash over the word hashes of the k words from each index in ``at``."""
    base = int(_tables(seed)[1][1])
    out = np.empty(len(at), U64)
    step = 1 << 18
    pw, inv = _powers(base, step + k + 1), _powers(pow(base, -1, 2**64), step + k + 1)
    with np.errstate(over="ignore"):
        i = 0
        while i < len(at):
            lo = int(at[i])
            j = int(np.searchsorted(at, lo + step, "left"))
            part = wh[lo:lo + step + k]
            c = np.empty(len(part) + 1, U64)
            c[0] = 0
            np.cumsum(part * pw[:len(part)], dtype=U64, out=c[1:])
            s = at[i:j] - lo
            out[i:j] = (c[s + k] - c[s]) * inv[s]
            i = j
        return _mix(out + U64(k))


def repeated(keys: np.ndarray) -> np.ndarray:
    """True for each value that occurs at least twice."""
    flag = np.zeros(len(keys), bool)
    if len(keys) > 1:
        order = np.argsort(keys)
        v = keys[order]
        same = v[1:] == v[:-1]
        flag[order[1:][same]] = True
        flag[order[:-1][same]] = True
    return flag


def with_doc(hashes: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Hashes made distinct by document, so that one sort of a batch serves all of them."""
    with np.errstate(over="ignore"):
        return _mix(hashes + (doc.astype(U64) + U64(1)) * U64(0x9E3779B97F4A7C15))


def cover(starts: np.ndarray, k: int, n: int) -> np.ndarray:
    """Words covered by windows of k words from each (distinct) index in ``starts``."""
    d = np.zeros(n + 1, np.int32)
    d[starts] = 1
    d[starts + k] -= 1
    return np.cumsum(d[:-1]) > 0


def code_points(data: np.ndarray) -> np.ndarray:
    """True at the first byte of each code point."""
    return ~_CONT[data]


def lines_of(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, first): the \\n-split lines of each document, an empty text has one line."""
    nl = np.flatnonzero(data == 0x0A)
    # A document's lines: one more than its newlines.
    per = np.searchsorted(nl, off[1:]) - np.searchsorted(nl, off[:-1]) + 1
    first = np.concatenate([[0], np.cumsum(per)])
    starts = np.empty(first[-1], np.int64)
    is_first = np.zeros(first[-1], bool)
    is_first[first[:-1]] = True
    starts[first[:-1]] = off[:-1]
    starts[~is_first] = nl + 1
    ends = np.empty(first[-1], np.int64)
    is_last = np.zeros(first[-1], bool)
    is_last[first[1:] - 1] = True
    ends[is_last] = off[1:]
    ends[~is_last] = nl
    return starts, ends, first
