"""Quality rules by line labelling: a linear-chain CRF marks each line content or boilerplate.

Lines are described by shape features (length, letter case, symbols, repeats); Viterbi decoding
finds each document's best sequence of labels; the share of a document's words in content lines
decides whether it is kept. The CRF is fitted on a bounded sample of labelled documents
(``TRAIN_DOCS``, smallest hashes of their ids; of each at most ``TRAIN_LINES`` lines), whose lines
all carry the document's label; only the sample's features come to the driver.

Base measures are counted over whole texts: n_words, word_chars, n_symbols, n_dup_lines,
n_repeat_words and base_failed, as the columns of ``measure`` say.

Defined cases: a null or empty text has no words, fails the base rule and is not kept; a text
without line labels to learn from (no labelled rows, or one class only) is judged by the base rule
alone; repeated rows are judged each; other columns are kept, equal-named ones replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from churnlens.llm import text as tx
from churnlens.llm.registry import query, small_batches, table

#: Labelled documents that the CRF is fitted on, and lines taken of each of them.
TRAIN_DOCS = 2000
TRAIN_LINES = 64
TRAIN_STEPS = 150
#: Least share of words in content lines.
MIN_CONTENT = 0.5
MIN_WORDS = 20
#: Words in a window that may repeat, and the percentage of words in repeated windows allowed.
WINDOW = 8
MAX_REPEAT_PERCENT = 30

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[list(b"0123456789")] = True
_UPPER = np.zeros(256, bool)
_UPPER[ord("A"):ord("Z") + 1] = True
N_FEATURES = 10
_MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


class Crf(NamedTuple):
    mean: np.ndarray      # of the features
    scale: np.ndarray
    weights: np.ndarray   # features + 1 (bias): score of content against boilerplate
    trans: np.ndarray     # 2 x 2: boilerplate 0, content 1
    start: np.ndarray

    def scores(self, x: np.ndarray) -> np.ndarray:
        s = ((x - self.mean) / self.scale) @ self.weights[:-1] + self.weights[-1]
        return np.stack([np.zeros(len(s)), s], 1)


class Lines(NamedTuple):
    words: tx.Words
    line_of_word: np.ndarray
    first: np.ndarray      # first line of each document (only lines with a word), plus the total
    n_words: np.ndarray
    dup: np.ndarray        # equal to an earlier line of the document
    features: np.ndarray


def describe(data: np.ndarray, off: np.ndarray) -> tuple[Lines, np.ndarray]:
    """Lines with a word of each document and their features; and the word hashes."""
    w = tx.words_of(data, off)
    wh = tx.word_hashes(w)
    starts, ends, first = tx.lines_of(data, off)
    of_word = np.searchsorted(starts, w.starts, "right") - 1 if len(starts) else np.zeros(0, np.int64)
    # Empty lines and empty documents share a start with what follows: the last one holds the word.
    n = np.bincount(of_word, minlength=len(starts))
    worded = np.flatnonzero(n > 0)
    number = np.cumsum(n > 0) - 1
    line_first = np.searchsorted(worded, first)
    s, e, n = starts[worded], ends[worded], n[worded]
    doc = tx.word_docs(line_first)
    # The first line of equal ones is not a repeat: a stable sort keeps their order.
    keys = tx.with_doc(tx.hash_spans(data, s, e, seed=1), doc)
    order = np.argsort(keys, kind="stable")
    dup = np.zeros(len(keys), bool)
    dup[order[1:][keys[order][1:] == keys[order][:-1]]] = True

    chars = np.add.reduceat(tx.span_count(tx.code_points(data), w.starts, w.ends),
                            np.searchsorted(number[of_word], np.arange(len(worded)))) if len(worded) else np.zeros(0)
    chars = np.maximum(chars, 1)
    # Capital letters of the Latin-1 supplement are C3 80 to C3 9E.
    upper = _UPPER[data]
    if len(data) > 1:
        upper[1:] |= (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)
    same = np.zeros(len(wh), bool)
    same[1:] = (wh[1:] == wh[:-1]) & (of_word[1:] == of_word[:-1])
    count = lambda mask: tx.span_count(mask, s, e) / chars
    last = data[np.maximum(w.ends - 1, 0)] if len(wh) else np.zeros(0, np.uint8)
    last_word = np.searchsorted(number[of_word], np.arange(len(worded)), "right") - 1 if len(worded) else np.zeros(0, int)
    per_line = lambda mask: np.bincount(number[of_word], mask, minlength=len(worded)) / np.maximum(n, 1)
    x = np.stack([
        np.log1p(n), np.log1p(chars / np.maximum(n, 1)), np.sqrt(count(_SYMBOL[data])), np.sqrt(count(data == ord("!"))),
        np.sqrt(count(upper)), per_line(same), np.sqrt(count(_DIGIT[data])),
        (last[last_word] == ord(".")).astype(float) if len(worded) else np.zeros(0),
        dup.astype(float), per_line(last == ord("|")) if len(worded) else np.zeros(0)], 1)
    return Lines(w, number[of_word] if len(of_word) else of_word, line_first, n, dup, x), wh


def measure(data: np.ndarray, off: np.ndarray, lines: Lines, wh: np.ndarray) -> dict[str, np.ndarray]:
    """Base measures of each document."""
    w = lines.words
    docs, n_docs = tx.word_docs(w.first), len(off) - 1
    at = tx.window_starts(w.first, WINDOW)
    if len(at):
        hit = at[tx.repeated(tx.with_doc(tx.window_hashes(wh, at, WINDOW), docs[at]))]
    else:
        hit = at
    covered = tx.cover(hit, WINDOW, len(wh))
    n = np.diff(w.first)
    repeat = np.bincount(docs[covered], minlength=n_docs)
    per_word = tx.span_count(tx.code_points(data), w.starts, w.ends)
    return {"n_words": n, "word_chars": np.bincount(docs, per_word, minlength=n_docs).astype(np.int64),
            "n_symbols": tx.span_count(_SYMBOL[data], off[:-1], off[1:]),
            "n_dup_lines": np.bincount(tx.word_docs(lines.first)[lines.dup], minlength=n_docs),
            "n_repeat_words": repeat}


def viterbi(scores: np.ndarray, first: np.ndarray, trans: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Best label of each line; all documents advance line by line together."""
    size = np.diff(first)
    order = np.argsort(-size, kind="stable")
    base, size = first[:-1][order], size[order]
    longest = int(size[0]) if len(size) else 0
    active = np.searchsorted(-size, -np.arange(longest), "left")
    delta = np.zeros((len(size), 2))
    back = np.zeros((len(scores), 2), np.int8)
    for t in range(longest):
        m = active[t]
        line = base[:m] + t
        if t == 0:
            delta[:m] = start + scores[line]
        else:
            via = delta[:m, :, None] + trans
            back[line] = via.argmax(1)
            delta[:m] = via.max(1) + scores[line]
    label = np.zeros(len(scores), np.int8)
    state = delta.argmax(1)
    for t in range(longest - 1, -1, -1):
        line = base[:active[t]] + t
        label[line] = state[:active[t]]
        state[:active[t]] = back[line, state[:active[t]]]
    return label


def fit_crf(x: np.ndarray, first: np.ndarray, y: np.ndarray, steps: int = TRAIN_STEPS, l2: float = 1e-3) -> Crf | None:
    """Maximum-likelihood linear-chain CRF for lines x with labels y (Adam); None without both labels."""
    if len(y) == 0 or y.min() == y.max():
        return None
    mean, scale = x.mean(0), np.maximum(x.std(0), 1e-6)
    z = np.concatenate([(x - mean) / scale, np.ones((len(x), 1))], 1)
    size = np.diff(first)
    order = np.argsort(-size, kind="stable")
    base, size = first[:-1][order], size[order]
    longest = int(size[0])
    active = np.searchsorted(-size, -np.arange(longest), "left")
    rows = [base[:m] + t for t, m in enumerate(active)]
    n_docs = len(base)
    theta = np.zeros(z.shape[1] + 4 + 2)
    m1, m2 = np.zeros_like(theta), np.zeros_like(theta)
    lse = np.logaddexp
    for step in range(1, steps + 1):
        w, trans, start = theta[:z.shape[1]], theta[z.shape[1]:-2].reshape(2, 2), theta[-2:]
        s = np.stack([np.zeros(len(z)), z @ w], 1)
        alpha, beta = np.zeros((len(z), 2)), np.zeros((len(z), 2))
        alpha[rows[0]] = start + s[rows[0]]
        for t in range(1, longest):
            p = alpha[rows[t - 1][:active[t]]]
            alpha[rows[t]] = lse(p[:, :1] + trans[0], p[:, 1:] + trans[1]) + s[rows[t]]
        for t in range(longest - 2, -1, -1):
            r = rows[t][:active[t + 1]]
            v = beta[rows[t + 1]] + s[rows[t + 1]]
            beta[r] = lse(trans[:, 0] + v[:, :1], trans[:, 1] + v[:, 1:])
        total = lse(*(alpha[rows[0]] + beta[rows[0]]).T)
        z_doc = np.empty(n_docs)
        z_doc[:] = total
        grad = np.zeros_like(theta)
        norm = np.empty(len(z))
        for t in range(longest):
            norm[rows[t]] = z_doc[:active[t]]
        p = np.exp(alpha + beta - norm[:, None])
        grad[:z.shape[1]] = z.T @ (p[:, 1] - y)
        for t in range(1, longest):
            a, r = rows[t - 1][:active[t]], rows[t]
            pair = np.exp(alpha[a][:, :, None] + trans + (s[r] + beta[r])[:, None, :] - norm[r][:, None, None])
            grad[z.shape[1]:-2] += pair.sum(0).ravel()
            grad[z.shape[1]:-2] -= np.bincount(2 * y[a] + y[r], minlength=4)
        grad[-2:] = p[rows[0]].sum(0) - np.bincount(y[rows[0]], minlength=2)
        grad = grad / len(z) + l2 * theta
        m1, m2 = 0.9 * m1 + 0.1 * grad, 0.99 * m2 + 0.01 * grad ** 2
        theta = theta - 0.1 * (m1 / (1 - 0.9 ** step)) / (np.sqrt(m2 / (1 - 0.99 ** step)) + 1e-9)
    return Crf(mean, scale, theta[:z.shape[1]], theta[z.shape[1]:-2].reshape(2, 2), theta[-2:])


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
          max_docs: int = TRAIN_DOCS, max_lines: int = TRAIN_LINES) -> Crf | None:
    """Fit the CRF on a bounded sample of labelled documents; only their line features are collected."""
    sample = (labels.filter(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull())
              .groupBy(F.col(id_col).alias("id")).agg(F.max(label_col).cast("int").alias("y"))
              .orderBy(F.xxhash64("id"), "id").limit(max_docs))
    # At most max_docs rows of two numbers.
    chosen = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(sample), "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in tx.slices(whole, "text"):
                data, off = tx.column_bytes(b.column(b.schema.get_field_index("text")))
                lines, _ = describe(data, off)
                x = [lines.features[s:min(e, s + max_lines)].tobytes() for s, e in zip(lines.first, lines.first[1:])]
                yield pa.RecordBatch.from_arrays([b.column(b.schema.get_field_index("id")).cast(pa.int64()),
                                                  b.column(b.schema.get_field_index("y")), pa.array(x, pa.binary())],
                                                 ["id", "y", "x"])

    found = (small_batches(chosen).mapInArrow(run, "id long, y int, x binary")
             .groupBy("id").agg(F.max("y").alias("y"), F.min("x").alias("x")).collect())     # at most max_docs rows
    found = sorted((r for r in found if r.x), key=lambda r: r.id)
    if not found:
        return None
    xs = [np.frombuffer(r.x).reshape(-1, N_FEATURES) for r in found]
    first = np.concatenate([[0], np.cumsum([len(x) for x in xs])])
    return fit_crf(np.concatenate(xs), first, np.repeat([r.y for r in found], np.diff(first)))


def judge(df: DataFrame, model: Crf | None, text_col: str = "text", min_content: float = MIN_CONTENT) -> DataFrame:
    """Add the base measures, base_failed, content_share (of words, in content lines) and kept."""
    added = [T.StructField(c, T.LongType(), False) for c in _MEASURES] + [
        T.StructField("base_failed", T.BooleanType(), False), T.StructField("content_share", T.DoubleType(), False),
        T.StructField("kept", T.BooleanType(), False)]
    base = df.drop(*[f.name for f in added])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tx.release()
        for whole in batches:
            for b in tx.slices(whole, text_col):
                data, off = tx.column_bytes(b.column(b.schema.get_field_index(text_col)))
                lines, wh = describe(data, off)
                m = measure(data, off, lines, wh)
                n = m["n_words"]
                failed = (n < MIN_WORDS) | (100 * m["n_repeat_words"] > MAX_REPEAT_PERCENT * n)
                if model is None:
                    share = np.where(n > 0, 1.0, 0.0)
                else:
                    label = viterbi(model.scores(lines.features), lines.first, model.trans, model.start)
                    content = np.bincount(tx.word_docs(lines.first), lines.n_words * (label == 1), minlength=len(n))
                    share = content / np.maximum(n, 1)
                out = [pa.array(m[c].astype(np.int64)) for c in _MEASURES]
                out += [pa.array(failed), pa.array(share), pa.array(~failed & (share >= min_content))]
                yield pa.RecordBatch.from_arrays([*b.columns, *out], [*b.schema.names, *[f.name for f in added]])

    return small_batches(base).mapInArrow(run, T.StructType([*base.schema.fields, *added]))


@query("op1_quality")
def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base measures and the CRF's verdict on every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(docs, table(spark, sf_dir, "labels"))
    return judge(docs, model).drop("text")
