"""Quality classifier: histogram gradient-boosted trees over document statistics.

A text is measured by about thirty shares and counts. Measures are cut into at most 64 bins by the quantiles of the
training sample; each tree is grown level by level from histograms of gradients by bin. Trained trees are flattened
into arrays of the same shape, heap-ordered, and a batch of documents walks all trees at once by numpy indexing.

Training takes a bounded sample of labelled rows: at most ``Training.max_rows`` labels are drawn, and at most as many rows of measures, no
texts, come to the driver.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._words import SPACE, U64, Chunk, pieces


@dataclass(frozen=True)
class Training:
    max_rows: int = 20_000
    trees: int = 80
    depth: int = 5
    bins: int = 64
    rate: float = 0.15
    l2: float = 1.0
    min_hessian: float = 2.0
    seed: int = 1


_KINDS = {
    "upper": range(0x41, 0x5B),
    "lower": range(0x61, 0x7B),
    "digit": range(0x30, 0x3A),
    "end": b".!?",
    "pause": b",;:",
    "symbol": b"#*$%&|<>",
    "other": b"\"'()[]{}/\\@^_`~+=-",
    "bang": b"!",
    "bar": b"|",
    "wide": range(0x80, 0x100),
}
NAMES = (
    ["log_bytes", "log_words", "word_bytes", "long_words", "short_words", "log_lines", "line_words", "dup_lines", "distinct_words", "repeat3", "repeat5", "capital_words", "shout_words", "symbol_words", "end_lines", "space"]
    + [f"share_{k}" for k in _KINDS]
)


def _histograms(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """(texts, 256): how often each byte stands in each text."""
    out = np.zeros((len(off) - 1, 256), np.int64)
    for i, (a, b) in enumerate(zip(off[:-1].tolist(), off[1:].tolist(), strict=True)):
        for lo in range(a, b, 1 << 18):
            out[i] += np.bincount(data[lo : min(b, lo + (1 << 18))], minlength=256)
    return out


def _distinct(doc: np.ndarray, h: np.ndarray, n: int) -> np.ndarray:
    """Distinct values of each text."""
    if not len(h):
        return np.zeros(n)
    order = np.lexsort((h, doc))
    d, v = doc[order], h[order]
    new = np.ones(len(v), bool)
    new[1:] = (v[1:] != v[:-1]) | (d[1:] != d[:-1])
    return np.bincount(d[new], minlength=n).astype(float)


def features(arr: pa.Array) -> np.ndarray:
    """(texts, measures). A text without words has zeros, as has a null one."""
    c = Chunk(arr)
    n, off, data = len(c), c.offsets, c.data
    size = np.maximum(np.diff(off), 1)
    words = c.n_words.astype(float)
    w = np.maximum(words, 1)
    doc = c.doc_of_word()
    length = c.ends - c.starts
    by_word = lambda f: np.bincount(doc, f, minlength=n)
    h = c.word_hashes(0)
    first = data[c.starts] if len(c.starts) else np.zeros(0, np.uint8)
    upper = np.zeros(len(data) + 1, np.int32)
    np.cumsum((data >= 0x41) & (data <= 0x5A), out=upper[1:])
    in_word = upper[c.ends] - upper[c.starts]
    marks = np.zeros(256, bool)
    marks[list(b"#*$%&|<>")] = True
    symbols = np.zeros(len(data) + 1, np.int32)
    np.cumsum(marks[data], out=symbols[1:])
    bytes_of = _histograms(data, off)
    lines = bytes_of[:, 0x0A] + 1
    cols = [np.log1p(np.diff(off)), np.log1p(words), by_word(length) / w, by_word(length > 12) / w, by_word(length < 4) / w, np.log1p(lines), words / lines]
    # repeated lines: a line's hash is that of its words, taken from the prefix of word hashes
    line_of = np.searchsorted(np.flatnonzero(data == 0x0A), c.starts)
    key = line_of.astype(np.int64) + doc
    begin = np.flatnonzero(np.diff(key, prepend=-1)) if len(key) else np.zeros(0, np.int64)
    sums = np.add.reduceat(h * (np.arange(len(h), dtype=U64) - np.repeat(begin, np.diff(np.append(begin, len(h)))).astype(U64) + U64(1)), begin) if len(begin) else np.zeros(0, U64)
    full = np.bincount(doc[begin], minlength=n)
    cols.append(1 - _distinct(doc[begin], sums, n) / np.maximum(full, 1) * (full > 0) - (full == 0))
    folded = Chunk(arr, SPACE, lower=True).word_hashes(0)
    cols.append(_distinct(doc, folded, n) / w)
    for k in (3, 5):
        if len(h) >= k:
            g, inside = c.windows(folded, k)
            d = doc[: len(g)][inside]
            total = np.bincount(d, minlength=n)
            cols.append((total - _distinct(d, g[inside], n)) / np.maximum(total, 1))
        else:
            cols.append(np.zeros(n))
    cols += [by_word((first >= 0x41) & (first <= 0x5A)) / w, by_word((in_word > 1) & (2 * in_word > length)) / w, by_word(symbols[c.ends] > symbols[c.starts]) / w]
    last = c.ends - 1
    closing = np.isin(data[last], np.frombuffer(b".!?", np.uint8)) if len(last) else np.zeros(0, bool)
    final = np.append(begin[1:], len(key))[: len(begin)] - 1 if len(begin) else np.zeros(0, np.int64)
    cols += [np.bincount(doc[begin], closing[final], minlength=n) / np.maximum(full, 1), bytes_of[:, SPACE].sum(axis=1) / size]
    for kind in _KINDS.values():
        cols.append(bytes_of[:, list(kind)].sum(axis=1) / size)
    return np.where(words[:, None] > 0, np.stack(cols, axis=1), 0.0)


@dataclass
class Trees:
    """Heap-ordered: node i has children 2 i + 1 and 2 i + 2; a row goes right where its measure exceeds ``cut``."""

    feature: np.ndarray
    cut: np.ndarray
    leaf: np.ndarray
    base: float
    depth: int

    def score(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        tree = np.arange(len(self.leaf))
        for a in range(0, len(x), 4096):
            part = x[a : a + 4096]
            row = np.arange(len(part))[:, None]
            at = np.zeros((len(part), len(tree)), np.int64)
            for _ in range(self.depth):
                at = 2 * at + 1 + (part[row, self.feature[tree, at]] > self.cut[tree, at])
            out[a : a + 4096] += self.leaf[tree, at - (2**self.depth - 1)].sum(axis=1)
        return 1 / (1 + np.exp(-np.clip(out, -60, 60)))


def train(x: np.ndarray, labels: np.ndarray, t: Training = Training()) -> Trees:
    """No rows, or labels all alike: no splits, and the score is the share of label 1, smoothed."""
    y = np.asarray(labels, float)
    n, m = len(y), x.shape[1]
    share = (y.sum() + 0.5) / (n + 1)
    base = float(np.log(share / (1 - share)))
    inner, leaves = 2**t.depth - 1, 2**t.depth
    feature = np.zeros((t.trees, inner), np.int64)
    cut = np.full((t.trees, inner), np.inf)
    leaf = np.zeros((t.trees, leaves))
    if n < 2 or y.min() == y.max():
        return Trees(feature, cut, leaf, base, t.depth)
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, t.bins + 1)[1:-1])) for f in range(m)]
    binned = np.stack([np.searchsorted(e, x[:, f], side="left") for f, e in enumerate(edges)], axis=1)
    flat = binned + np.arange(m) * t.bins
    logit = np.full(n, base)
    for k in range(t.trees):
        p = 1 / (1 + np.exp(-logit))
        g, h = p - y, np.maximum(p * (1 - p), 1e-6)
        node = np.zeros(n, np.int64)
        for level in range(t.depth):
            width = 2**level
            cell = (node[:, None] * (m * t.bins) + flat).ravel()
            size = width * m * t.bins
            hg = np.bincount(cell, np.repeat(g, m), size).reshape(width, m, t.bins).cumsum(axis=2)
            hh = np.bincount(cell, np.repeat(h, m), size).reshape(width, m, t.bins).cumsum(axis=2)
            tg, th = hg[:, :1, -1:], hh[:, :1, -1:]
            gain = hg**2 / (hh + t.l2) + (tg - hg) ** 2 / (th - hh + t.l2) - tg**2 / (th + t.l2)
            gain = np.where((hh >= t.min_hessian) & (th - hh >= t.min_hessian), gain, -1).reshape(width, -1)
            best = gain.argmax(axis=1)
            f, b = best // t.bins, best % t.bins
            ok = gain[np.arange(width), best] > 1e-9
            at = width - 1 + np.arange(width)
            for i in np.flatnonzero(ok):
                if b[i] < len(edges[f[i]]):
                    feature[k, at[i]], cut[k, at[i]] = f[i], edges[f[i]][b[i]]
                else:
                    ok[i] = False
            node = 2 * node + (ok[node] & (binned[np.arange(n), f[node]] > b[node]))
        sg, sh = np.bincount(node, g, leaves), np.bincount(node, h, leaves)
        leaf[k] = -t.rate * sg / (sh + t.l2)
        logit += leaf[k][node]
    return Trees(feature, cut, leaf, base, t.depth)


def measured(docs: DataFrame, text: str = "text", key: str = "doc_id", keep: list[str] | None = None) -> DataFrame:
    """(doc_id, kept columns, x: the measures) of every row."""
    return _mapped(docs, lambda arr: pa.FixedSizeListArray.from_arrays(pa.array(features(arr).ravel()), len(NAMES)).cast(pa.list_(pa.float64())), "x array<double>", text, key, keep or [])


def _mapped(docs: DataFrame, of, column: str, text: str, key: str, keep: list[str]) -> DataFrame:
    rows = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"), *(F.col(f"`{k}`").alias(f"keep_{i}") for i, k in enumerate(keep)))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches, "text"):
            yield pa.RecordBatch.from_arrays([piece.column(0), *piece.columns[2:], of(piece.column(1))], names=["doc_id", *piece.schema.names[2:], column.split()[0]])

    schema = ", ".join(f"{c} {kind}" for c, kind in rows.dtypes if c != "text") + f", {column}"
    return rows.mapInArrow(run, schema).withColumnsRenamed({f"keep_{i}": k for i, k in enumerate(keep)})


def fit(docs: DataFrame, labels: DataFrame, label: str, t: Training = Training(), text: str = "text", key: str = "doc_id") -> Trees:
    """Train on at most ``max_rows`` keys of ``labels`` (key, label) and rows of their texts, both drawn by hash; equal rows count once,
    and of several labels of one key the largest counts."""
    picked = labels.select(F.col(key).alias("doc_id"), F.col(label).cast("double").alias("label")).where("doc_id is not null and label is not null").groupBy("doc_id").agg(F.max("label").alias("label"))
    picked = picked.orderBy(F.xxhash64(F.lit(t.seed), "doc_id"), "doc_id").limit(t.max_rows)
    rows = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text")).join(F.broadcast(picked), "doc_id")
    rows = measured(rows, "text", "doc_id", ["label"])
    order = [F.xxhash64(F.lit(t.seed), "doc_id"), F.col("doc_id"), F.xxhash64("x")]
    table = rows.dropDuplicates(["doc_id", "x"]).orderBy(*order).limit(t.max_rows).toArrow()
    x = np.asarray(table.column("x").combine_chunks().flatten()).reshape(-1, len(NAMES)) if len(table) else np.zeros((0, len(NAMES)))
    return train(x, table.column("label").to_numpy() if len(table) else np.zeros(0), t)


def score(docs: DataFrame, model: Trees, text: str = "text", key: str = "doc_id", keep: list[str] | None = None) -> DataFrame:
    """One row per input row: doc_id, score, and the columns named in ``keep``.

    Null and empty texts have measures of zero and get those measures' score. Repeated rows each come back. An empty
    table gives an empty result.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)
    return _mapped(docs, lambda arr: pa.array(sent.value.score(features(arr))), "score double", text, key, keep or [])
