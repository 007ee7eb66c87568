"""Word, line and window kernels against plain Python."""
import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from churnlens.llm import text as tx

TEXT = st.lists(st.one_of(st.none(), st.text(alphabet="ab \n\t\r\x0b\x0cé😀.\x85\xa0\x1c", max_size=40)), max_size=6)


def batch(texts):
    return tx.column_bytes(pa.array(texts, pa.string()))


@given(TEXT)
@settings(max_examples=200, deadline=None)
def test_words_and_lines(texts):
    data, off = batch(texts)
    w = tx.words_of(data, off)
    got = [data[s:e].tobytes().decode() for s, e in zip(w.starts, w.ends)]
    want = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for t in texts]
    assert got == [x for ws in want for x in ws]
    assert np.diff(w.first).tolist() == [len(ws) for ws in want]
    s, e, first = tx.lines_of(data, off)
    assert [data[a:b].tobytes().decode() for a, b in zip(s, e)] == [x for t in texts for x in (t or "").split("\n")]
    assert np.diff(first).tolist() == [len((t or "").split("\n")) for t in texts]


@given(TEXT, st.integers(1, 4))
@settings(max_examples=100, deadline=None)
def test_window_hashes_follow_the_words(texts, k):
    data, off = batch(texts)
    w = tx.words_of(data, off)
    at = tx.window_starts(w.first, k)
    h = tx.window_hashes(tx.word_hashes(w), at, k)
    words = [data[s:e].tobytes() for s, e in zip(w.starts, w.ends)]
    by_hash = {}
    for i, x in zip(at, h):
        assert by_hash.setdefault(int(x), tuple(words[i:i + k])) == tuple(words[i:i + k])
    assert len(by_hash) == len({tuple(words[i:i + k]) for i in at})
    assert len(at) == sum(max(0, n - k + 1) for n in np.diff(w.first))


def test_hashes_do_not_depend_on_segments_or_batches(monkeypatch):
    texts = ["alpha beta " + "g" * 5000 + " delta", "beta alpha"]
    data, off = batch(texts)
    whole = tx.word_hashes(tx.words_of(data, off))
    alone = [tx.word_hashes(tx.words_of(*batch([t]))) for t in texts]
    assert whole.tolist() == np.concatenate(alone).tolist()


def test_slices_keep_all_rows_in_order():
    b = pa.RecordBatch.from_arrays([pa.array(["a" * n for n in (5, 0, 100, 3, 3, 3)])], ["t"])
    parts = list(tx.slices(b, "t", 7))
    assert [x for p in parts for x in p.column(0).to_pylist()] == b.column(0).to_pylist() and len(parts) > 2
    assert list(tx.slices(b.slice(0, 0), "t")) == []
    sliced = b.slice(2, 3)
    assert tx.column_bytes(sliced.column(0))[1].tolist() == [0, 100, 103, 106]
