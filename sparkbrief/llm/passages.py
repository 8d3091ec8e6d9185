"""Substring dedup: repeated windows of words merge into maximal removal intervals.

Every window of ``length`` consecutive words gets a Rabin-Karp hash, rolled over the word hashes of a text. A window
matters only if another document holds it too. To find these without sending every window over the network, each
window first picks, among the shorter word runs inside it, the one of least hash. The pick depends on the window's
words alone, so equal windows pick equal runs wherever they stand, and a run picked in one document only proves
that its windows occur in no other. About one position in sixteen is picked. The windows whose pick is shared are
then counted by their full 128-bit hashes, and those that start in an earlier document cover the words to remove.
No window that repeats is missed.

Texts of equal word sequences are one class, known by a 128-bit hash of the sequence. They are settled first: only the windows of
a class's representative, its text of least doc_id, stand for all. Positions always belong to a word sequence, never to a doc_id, so rows
that share a doc_id keep apart.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._store import Store
from ._words import U64, Chunk, pieces, roll, signed, whole

FULL = U64(0xFFFFFFFFFFFFFFFF)


def _sliding(a: np.ndarray, width: int, least: bool) -> np.ndarray:
    """Minimum (or maximum) of every run of ``width`` values, in linear time."""
    n = len(a) - width + 1
    op, fill = (np.minimum, FULL) if least else (np.maximum, U64(0))
    rows = -(-len(a) // width)
    padded = np.full(rows * width, fill, U64)
    padded[: len(a)] = a
    grid = padded.reshape(rows, width)
    ahead = op.accumulate(grid, axis=1).ravel()
    behind = op.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return op(behind[:n], ahead[width - 1 : width - 1 + n])


class _Picks:
    """The windows of a chunk: hashes of the short runs, each window's least one, and which windows lie in one text."""

    def __init__(self, chunk: Chunk, length: int):
        self.run = max(1, length * 2 // 5)
        self.span = length - self.run + 1
        self.hashes = chunk.word_hashes(0)
        self.n = len(self.hashes) - length + 1
        if self.n <= 0:
            return
        self.valid = _inside(chunk, self.n, length)
        self.grams = roll(self.hashes, self.run) | U64(1)
        self.grams = np.where(_inside(chunk, len(self.grams), self.run), self.grams, FULL)
        self.least = np.where(self.valid, _sliding(self.grams, self.span, True), U64(0))

    def picked(self) -> np.ndarray:
        """Positions of the runs that some window picks."""
        pad = np.zeros(self.span - 1, U64)
        most = _sliding(np.concatenate([pad, self.least, pad]), self.span, False)
        return np.flatnonzero((most == self.grams) & (self.grams != FULL))

    def choosing(self, positions: np.ndarray) -> np.ndarray:
        """Starts of the windows whose pick is at one of ``positions``."""
        g = np.full(len(self.grams), FULL, U64)
        g[positions] = self.grams[positions]
        return np.flatnonzero(self.valid & (_sliding(g, self.span, True) == self.least))


def _inside(chunk: Chunk, n: int, length: int) -> np.ndarray:
    """Of the first n starts: whether ``length`` words from there belong to one text."""
    last = np.repeat(chunk.first[1:], chunk.n_words)[:n]
    return np.arange(n) + length <= last


def _lists(values: np.ndarray, counts: np.ndarray) -> pa.Array:
    offsets = np.zeros(len(counts) + 1, np.int32)
    np.cumsum(counts, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))


def _sketch(length: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches, "text"):
            c = Chunk(piece.column(1))
            p = _Picks(c, length)
            at = p.picked() if p.n > 0 else np.zeros(0, np.int64)
            doc = np.searchsorted(c.first, at, side="right") - 1
            counts = np.bincount(doc, minlength=len(c))
            runs = p.grams[at] if len(at) else np.zeros(0, U64)
            ids = [signed(whole(c, c.word_hashes(w), w)) for w in (0, 1)]
            yield pa.RecordBatch.from_arrays(
                [piece.column(0), *piece.columns[2:], pa.array(c.n_words.astype(np.int64)), *map(pa.array, ids), _lists(signed(runs), counts), _lists((at - c.first[doc]).astype(np.int32), counts)],
                names=["doc_id", *ROW, "n_words", "s1", "s2", "runs", "at"],
            )

    return run, "doc_id long, x1 long, x2 long, n_words long, s1 long, s2 long, runs array<long>, at array<int>"


def _candidates(length: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches, "text"):
            c = Chunk(piece.column(1))
            p = _Picks(c, length)
            if p.n <= 0:
                continue
            lists = piece.column(3)
            doc = np.repeat(np.arange(len(c)), np.diff(np.asarray(lists.offsets)))
            at = p.choosing(np.asarray(lists.flatten()) + c.first[doc])
            doc = np.searchsorted(c.first, at, side="right") - 1
            h = [signed(roll(x, length, w)[at]) for w, x in ((0, p.hashes), (1, c.word_hashes(1)))]
            of = pa.array(doc)
            yield pa.RecordBatch.from_arrays([piece.column(0).take(of), piece.column(2).take(of), pa.array((at - c.first[doc]).astype(np.int32)), *map(pa.array, h)], names=["doc_id", "s1", "start", "h1", "h2"])

    return run, "doc_id long, s1 long, start int, h1 long, h2 long"


#: Two hashes that stand, with the doc_id, for a row's text where tables are joined.
ROW = ["x1", "x2"]


def _rows(docs: DataFrame) -> DataFrame:
    t = F.coalesce("text", F.lit(""))
    return docs.select("doc_id", "text", F.xxhash64(t).alias("x1"), F.xxhash64(F.lit(1), t).alias("x2"))


def removal_starts(docs: DataFrame, store: Store, length: int = 50) -> DataFrame:
    """(doc_id, x1, x2, starts): word positions of the windows of each text that also start in a document of smaller doc_id.

    ``starts`` is [-1] for a text whose whole word sequence is that of a smaller doc_id.
    """
    run, schema = _sketch(length)
    sketches = store.put(_rows(docs.where("doc_id is not null")).mapInArrow(run, schema), "sketches")
    long = sketches.where(F.col("n_words") >= length)
    same = ["s1", "s2", "n_words"]
    # tables are written before they are joined: a join of plain scans can be split where a class, a run or a window has very many rows
    classes = long.groupBy(*same).agg(F.min(F.struct("doc_id", *ROW)).alias("r"), F.max("doc_id").alias("top"))
    classes = store.put(classes.select(*same, "r.*", "top"), "classes")
    reps = classes.select("doc_id", *ROW, "s1")
    picks = long.drop("s1").join(reps, ["doc_id", *ROW]).select("doc_id", *ROW, "s1", F.explode(F.arrays_zip("runs", "at")).alias("x")).select("doc_id", *ROW, "s1", F.col("x.runs").alias("run"), F.col("x.at").alias("at"))
    shared = store.put(picks.groupBy("run").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).where("lo < hi").select("run"), "shared")
    where = store.put(picks.join(shared, "run").groupBy("doc_id", *ROW, "s1").agg(F.collect_set("at").alias("at")), "where")
    store.drop(shared)

    run, schema = _candidates(length)
    windows = store.put(_rows(docs).join(where, ["doc_id", *ROW]).select("doc_id", "text", "s1", "at").mapInArrow(run, schema), "windows")
    store.drop(where)
    first = store.put(windows.groupBy("h1", "h2").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).where("lo < hi").select("h1", "h2", "lo"), "first")
    later = windows.join(first, ["h1", "h2"]).where("doc_id > lo").groupBy("doc_id", "s1").agg(F.collect_set("start").alias("starts"))

    verdicts = classes.withColumnRenamed("doc_id", "rep").drop(*ROW).join(later.withColumnRenamed("doc_id", "rep"), ["rep", "s1"], "left")
    verdicts = store.put(verdicts.where("rep < top or starts is not null"), "verdicts")
    for table in (windows, first):
        store.drop(table)
    rows = long.select("doc_id", *ROW, *same).join(verdicts, same)
    rows = rows.select("doc_id", *ROW, F.when(F.col("doc_id") > F.col("rep"), F.array(F.lit(-1))).otherwise(F.col("starts")).alias("starts")).where("starts is not null")
    out = store.put(rows.dropDuplicates(["doc_id", *ROW]), "starts")
    for table in (sketches, classes, verdicts):
        store.drop(table)
    return out


def _cover(n: int, starts: np.ndarray, length: int) -> np.ndarray:
    if len(starts) and starts.min() < 0:
        return np.ones(n, bool)
    edge = np.zeros(n + 1, np.int32)
    np.add.at(edge, starts, 1)
    np.add.at(edge, np.minimum(starts + length, n), -1)
    return np.cumsum(edge[:n]) > 0


def _strip(length: int, with_text: bool):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches, "text"):
            c = Chunk(piece.column(1))
            lists = piece.column(2)
            doc_of = np.repeat(np.arange(len(c)), c.n_words)
            gone = np.zeros(len(c.starts), bool)
            for i in np.flatnonzero(np.asarray(lists.is_valid())):
                a, b = c.first[i], c.first[i + 1]
                gone[a:b] = _cover(b - a, np.asarray(lists[int(i)].values), length)
            # the bytes of kept words, each followed by one space unless it is its text's last
            stay = np.flatnonzero(~gone)
            a, b, doc = c.starts[stay], c.ends[stay], doc_of[stay]
            more = np.zeros(len(stay), bool)
            more[:-1] = doc[1:] == doc[:-1]
            out = np.append(c.data, np.uint8(0x20))
            out[b[more]] = 0x20
            edge = np.zeros(len(out) + 1, np.int8)
            edge[a] += 1
            np.subtract.at(edge, b + more, 1)
            keep = np.cumsum(edge[:-1], dtype=np.int8) > 0
            raw = out[keep].tobytes()
            sizes = np.bincount(doc, weights=b - a + more, minlength=len(c)).astype(np.int64)
            ends = np.cumsum(sizes)
            texts = [raw[e - s : e] for s, e in zip(sizes, ends, strict=True)]
            n_gone = np.bincount(doc_of[gone], minlength=len(c)).astype(np.int64)
            cols = [piece.column(0), pa.array(c.n_words.astype(np.int64)), pa.array(n_gone), pa.array([hashlib.sha256(t).hexdigest() for t in texts], pa.string())]
            names = ["doc_id", "n_words", "n_removed", "kept_sha256"]
            if with_text:
                cols += [pa.array([t.decode() for t in texts], pa.string()), pa.array([_spans(gone[x:y]) for x, y in zip(c.first[:-1], c.first[1:], strict=True)], pa.list_(pa.list_(pa.int32())))]
                names += ["kept", "removed"]
            yield pa.RecordBatch.from_arrays(cols, names=names)

    return run, "doc_id long, n_words long, n_removed long, kept_sha256 string" + (", kept string, removed array<array<int>>" if with_text else "")


def _spans(gone: np.ndarray) -> list[list[int]]:
    edge = np.flatnonzero(np.diff(np.concatenate([[0], gone.astype(np.int8), [0]])))
    return edge.reshape(-1, 2).tolist()


def remove_repeats(docs: DataFrame, length: int = 50, text: str = "text", key: str = "doc_id", with_text: bool = True) -> DataFrame:
    """Every word covered by a window of ``length`` words that also starts in a document of smaller ``key`` goes.

    One row per input row: doc_id, n_words, n_removed, kept_sha256 and, if asked for, ``kept`` (words joined by one
    space) and ``removed`` (maximal word intervals [from, to)). Windows are judged on the input. Texts shorter than a
    window, null and empty texts lose nothing. Rows that share a doc_id are one document: they do not remove from each
    other, and each loses the windows of its own text that start in a smaller doc_id. A null doc_id takes no part and loses
    nothing. An empty table gives an empty result. Other columns are ignored.
    """
    store = Store(docs.sparkSession, "passages")
    docs = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    starts = removal_starts(docs, store, length)
    run, schema = _strip(length, with_text)
    return _rows(docs).join(starts, ["doc_id", *ROW], "left").select("doc_id", "text", "starts").mapInArrow(run, schema)
