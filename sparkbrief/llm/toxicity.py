"""Toxicity: subword-bag embeddings averaged into a linear softmax, trained jointly in numpy.

A text is the bag of its character n-grams, cut from the folded bytes of each word with one space at either side. Every
n-gram is hashed to a row of an embedding table; rows are averaged over the text and a linear softmax over two classes
reads the average. A misspelt word never seen shares most n-grams, and so their vectors, with words that were.

Training takes a bounded sample of labelled rows (``Training.max_rows`` and ``max_bytes`` of text) to the driver. Long texts
take part in pieces of ``piece`` characters, each a row of its own with its text's label, so no text is too long to be drawn.
Embeddings and head are trained together by Adam. With two classes only the difference of the head's rows matters,
so a pass forward reads one number a bucket and the gradient of the table is an outer product.

Scoring adds up, over all n-grams of a whole text, the product of its row and the head, found once for each bucket.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._words import _BYTE, LOWER, SEGMENT, SPACE, U64, cut, mix, pieces, powers


@dataclass(frozen=True)
class Training:
    max_rows: int = 6000
    max_bytes: int = 10 << 20
    piece: int = 20_000
    bits: int = 17
    dim: int = 4
    lengths: tuple[int, ...] = (3, 5, 7)
    epochs: int = 40
    batch: int = 256
    rate: float = 0.02
    decay: float = 1e-5
    scale: float = 200.0
    smooth: float = 200.0
    seed: int = 1


@dataclass
class Model:
    """``value``: of each bucket the product of its embedding and the head; a text's logit is bias + scale * their mean, which counts
    ``smooth`` empty n-grams besides: a few words alone do not make a text toxic."""

    lengths: tuple[int, ...]
    value: np.ndarray
    bias: float
    scale: float
    smooth: float

    @property
    def bits(self) -> int:
        return int(len(self.value)).bit_length() - 1

    def score(self, arr: pa.Array) -> np.ndarray:
        total = np.zeros(len(arr))
        count = np.zeros(len(arr), np.int64)
        for raw, off, text in cut(arr, SEGMENT // 2):
            for ends, bucket in ngrams(raw, off, self.lengths, self.bits):
                v = np.zeros(len(bucket) + 1)
                np.cumsum(self.value[bucket], out=v[1:])
                np.add.at(total, text, v[ends[1:]] - v[ends[:-1]])
                np.add.at(count, text, np.diff(ends))
        logit = self.bias + self.scale * total / (count + self.smooth)
        return 1 / (1 + np.exp(-np.clip(logit, -60, 60)))


def ngrams(raw: np.ndarray, off: np.ndarray, lengths: Iterable[int], bits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each length: (offsets of the texts' n-grams, their buckets). Lengths count bytes, folded; a space stands at both
    ends of a word, and an n-gram holds spaces at its ends only and at least two bytes of a word."""
    # a space before each text and after the last, so that words at the edges have theirs
    n = len(raw) + len(off)
    place = np.arange(len(raw)) + 1 + np.repeat(np.arange(len(off) - 1), np.diff(off))
    data = np.full(n, 0x20, np.uint8)
    data[place] = LOWER[raw]
    gap = SPACE[data]
    spaces = np.zeros(n + 1, np.int32)
    np.cumsum(gap, out=spaces[1:])
    v = (_BYTE[0] | U64(1))[np.where(gap, np.uint8(0x20), data)] * powers(0, n)
    p = np.zeros(n + 1, U64)
    np.cumsum(v, out=p[1:])
    inverse = powers(0, n, inverse=True)
    edges = off + np.arange(len(off))
    for k in lengths:
        if n < k:
            yield np.zeros(len(off), np.int64), np.zeros(0, np.int64)
            continue
        # no space strictly inside
        at = np.flatnonzero((spaces[k - 1 : n] - spaces[1 : n - k + 2] == 0) & ~(gap[: n - k + 1] & gap[k - 1 :] & (k < 4)))
        h = mix((p[at + k] - p[at]) * inverse[at], 60 + k) >> U64(64 - bits)
        yield np.searchsorted(at, edges), h.astype(np.int64)


def bags(arr: pa.Array, t: Training) -> list[tuple[np.ndarray, np.ndarray]]:
    """Of each text the buckets and their shares."""
    out = []
    for piece in pieces([pa.RecordBatch.from_arrays([arr], names=["text"])], "text"):
        found: list[list[np.ndarray]] = [[] for _ in range(piece.num_rows)]
        for raw, off, text in cut(piece.column(0), SEGMENT // 2):
            for ends, bucket in ngrams(raw, off, t.lengths, t.bits):
                for i, a, b in zip(text, ends[:-1], ends[1:], strict=True):
                    found[i].append(bucket[a:b])
        for parts in found:
            b, c = np.unique(np.concatenate(parts), return_counts=True) if parts else (np.zeros(0, np.int64), np.zeros(0, np.int64))
            out.append((b.astype(np.int32), (c / (c.sum() + t.smooth)).astype(np.float32)))
    return out


def train(texts: pa.Array, labels: np.ndarray, t: Training = Training()) -> Model:
    """No texts, or labels all alike: a model whose score is the share of label 1, smoothed."""
    y = np.asarray(labels, np.float32)
    share = (y.sum() + 0.5) / (len(y) + 1)
    size = 1 << t.bits
    bias = float(np.log(share / (1 - share)))
    if len(y) < 2 or y.min() == y.max():
        return Model(t.lengths, np.zeros(size, np.float32), bias, t.scale, t.smooth)
    rng = np.random.default_rng(t.seed)
    docs = bags(texts, t)
    table = rng.normal(0, 0.05, (size, t.dim)).astype(np.float32)
    head = rng.normal(0, 0.5, t.dim).astype(np.float32)
    state = [(np.zeros_like(x), np.zeros_like(x)) for x in (table, head)]
    step = 0
    b_m = b_v = 0.0
    for _ in range(t.epochs):
        order = rng.permutation(len(docs))
        for a in range(0, len(order), t.batch):
            part = order[a : a + t.batch]
            bucket = np.concatenate([docs[i][0] for i in part])
            weight = np.concatenate([docs[i][1] for i in part])
            ends = np.cumsum([len(docs[i][0]) for i in part])
            doc = np.repeat(np.arange(len(part), dtype=np.int32), np.diff(np.concatenate([[0], ends])))
            z = np.bincount(doc, weight * (table @ head)[bucket], minlength=len(part))
            prob = 1 / (1 + np.exp(-np.clip(bias + t.scale * z, -60, 60)))
            err = (prob - y[part]) / len(part)
            pull = t.scale * np.bincount(bucket, weight * err[doc].astype(np.float32), minlength=size).astype(np.float32)
            grads = (pull[:, None] * head + t.decay * table, table.T @ pull)
            step += 1
            for x, g, (m, v) in zip((table, head), grads, state, strict=True):
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                x -= t.rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
            g = float(err.sum())
            b_m += 0.1 * (g - b_m)
            b_v += 0.01 * (g * g - b_v)
            bias -= t.rate * (b_m / (1 - 0.9**step)) / ((b_v / (1 - 0.99**step)) ** 0.5 + 1e-8)
    return Model(t.lengths, (table @ head).astype(np.float32), bias, t.scale, t.smooth)


def sample(labelled: DataFrame, t: Training) -> pa.Table:
    """At most max_rows pieces and max_bytes of text of (key, text, label), in an order fixed by a hash of key, piece and text."""
    rows = labelled.select("doc_id", "text", F.col("label").cast("int").alias("label")).where("label is not null and text is not null")
    number = F.sequence(F.lit(0), F.floor(F.greatest(F.char_length("text") - 1, F.lit(0)) / t.piece).cast("int"))
    rows = rows.select("doc_id", "label", "text", F.explode(number).alias("no"))
    rows = rows.select("doc_id", "label", "no", F.substring(F.col("text"), F.col("no") * t.piece + 1, F.lit(t.piece)).alias("text"))
    rows = rows.withColumn("h", F.xxhash64(F.lit(t.seed), "doc_id", "no")).withColumn("x", F.xxhash64("text"))
    top = rows.orderBy("h", "doc_id", "no", "x").limit(t.max_rows).select("doc_id", "label", "text").toArrow()
    size = np.cumsum(np.asarray(pa.compute.binary_length(top.column("text")), np.int64)) if len(top) else np.zeros(0)
    return top.slice(0, int(np.searchsorted(size, t.max_bytes, side="right")))


def fit(docs: DataFrame, labels: DataFrame, label: str, t: Training = Training(), text: str = "text", key: str = "doc_id") -> Model:
    """Train on the rows of ``labels`` (key, label). Which keys to take is decided on the label table, before any text is read: at
    most ``max_rows`` of them. Of several labels of one key the largest counts."""
    picked = labels.select(F.col(key).alias("doc_id"), F.col(label).alias("label")).where("doc_id is not null and label is not null").groupBy("doc_id").agg(F.max("label").alias("label"))
    picked = picked.orderBy(F.xxhash64(F.lit(t.seed), "doc_id"), "doc_id").limit(t.max_rows)
    # at most max_rows keys
    table = sample(docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text")).join(F.broadcast(picked), "doc_id"), t)
    return train(table.column("text").combine_chunks() if len(table) else pa.array([], pa.string()), table.column("label").to_numpy() if len(table) else np.zeros(0), t)


def score(docs: DataFrame, model: Model, text: str = "text", key: str = "doc_id", keep: list[str] | None = None) -> DataFrame:
    """One row per input row: doc_id, score, and the columns named in ``keep``.

    Null and empty texts score by the bias alone. Repeated rows each come back. An empty table gives an empty result.
    """
    keep = keep or []
    sent = docs.sparkSession.sparkContext.broadcast(model)
    # the text goes to Python once, and back only if it is kept
    rows = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"), *(F.col(f"`{k}`").alias(f"keep_{i}") for i, k in enumerate(keep) if k != text))
    back = [c for c in rows.columns if c != "text" or text in keep]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches, "text"):
            yield pa.RecordBatch.from_arrays([*(piece.column(c) for c in back), pa.array(sent.value.score(piece.column(1)))], names=[*back, "score"])

    schema = ", ".join(f"{c} {kind}" for c, kind in rows.dtypes if c in back) + ", score double"
    return rows.mapInArrow(run, schema).withColumnsRenamed({"text": text} | {f"keep_{i}": k for i, k in enumerate(keep)}).select("doc_id", *(F.col(f"`{k}`") for k in keep), "score")
