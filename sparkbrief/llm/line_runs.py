"""Line dedup over levelled sorted runs of line hashes.

Every line longer than a few characters has a key (stripped, A-Z lower-cased) and a 128-bit hash of it. The state is
a set of runs: written tables of (hash, n_docs, holder), each free of repeats, bucketed by hash and sorted in its buckets.
Batches of documents come in falling order of doc_id. A batch sums its own lines by hash and merge-joins them with the runs,
bucket by bucket, to part those seen before from those never seen, for which its largest doc_id becomes the holder; it then adds
one run of its own. Once a level holds ``fanout`` runs they are merged into one of the next level, so a line is
rewritten once a level and there are logarithmically many runs. Runs are never shuffled again: only a batch's own lines are.

After the last batch the runs say in how many documents each line occurs and which largest document keeps it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._store import Store
from ._words import _BYTE, CHUNK_BYTES, LOWER, SPACE, U64, mix, pieces, signed, spans, utf8

HASH = ["h1", "h2"]


def _lines(arr: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of a run of texts: bytes, offsets, and of each line its start, its end and its text's number."""
    data, off = utf8(arr)
    nl = np.flatnonzero(data == 0x0A)
    # a text's lines end at its newlines and at its own end
    ends = np.concatenate([nl, off[1:]])
    doc = np.concatenate([np.searchsorted(off[1:], nl, side="right"), np.arange(len(off) - 1)])
    order = np.lexsort((ends, doc))
    # a newline that is a text's last byte ends the line before the empty last one
    ends, doc = ends[order], doc[order]
    starts = np.empty_like(ends)
    starts[1:] = ends[:-1] + 1
    starts[np.searchsorted(doc, np.arange(len(off) - 1))] = off[:-1]
    return data, off, starts, ends, doc


def _keyed(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, min_chars: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(numbers of the lines whose key is long enough, two hashes of each key), in steps of CHUNK_BYTES or of one line."""
    at, left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    i = 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + CHUNK_BYTES, side="right")))
        lo = starts[i]
        part = data[lo : ends[j - 1]]
        body = np.flatnonzero(~SPACE[part])
        a, b = np.searchsorted(body, starts[i:j] - lo), np.searchsorted(body, ends[i:j] - lo)
        full = np.flatnonzero(b > a)
        # strip: from the first to the last byte that is no space
        x, y = body[a[full]], body[b[full] - 1] + 1
        points = np.zeros(len(part) + 1, np.int64)
        np.cumsum((part & 0xC0) != 0x80, out=points[1:])
        long = points[y] - points[x] >= max(1, min_chars)
        at.append(full[long] + i)
        left.append(x[long] + lo)
        right.append(y[long] + lo)
        i = j
    a, b = np.concatenate(left), np.concatenate(right)
    h = [mix(spans(lambda lo, hi, w=w: (_BYTE[w] | U64(1))[LOWER[data[lo:hi]]], a, b, w) + (b - a).astype(U64), 11 + w) for w in (0, 1)]
    return np.concatenate(at), h[0], h[1]


def line_keys(docs: DataFrame, min_chars: int, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(doc_id, h1, h2) of every line of a row whose key has ``min_chars`` code points or more, once a row and key."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches, "text"):
            data, _, starts, ends, doc = _lines(piece.column(1))
            at, h1, h2 = _keyed(data, starts, ends, min_chars)
            doc = doc[at]
            order = np.lexsort((h2, h1, doc))
            doc, h1, h2 = doc[order], h1[order], h2[order]
            new = np.ones(len(doc), bool)
            new[1:] = (doc[1:] != doc[:-1]) | (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])
            yield pa.RecordBatch.from_arrays([piece.column(0).take(pa.array(doc[new])), pa.array(signed(h1[new])), pa.array(signed(h2[new]))], names=["doc_id", *HASH])

    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")).where("doc_id is not null")
    return rows.mapInArrow(run, "doc_id long, h1 long, h2 long")


class LineRuns:
    """The levelled runs. ``add`` takes batches in falling order of doc_id; ``state`` gives (h1, h2, n_docs, holder)."""

    def __init__(self, store: Store, fanout: int = 4):
        self.store, self.fanout = store, fanout
        #: as many buckets as a shuffle has partitions, so that a batch's sums meet the runs where they are
        self.buckets = int(store.spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[list[DataFrame]] = []

    def runs(self) -> list[DataFrame]:
        return [r for level in self.levels for r in level]

    def add(self, lines: DataFrame) -> None:
        """``lines``: (doc_id, h1, h2) of one batch, repeats allowed. A doc_id counts once a line however often it holds it."""
        # one row a document and line first, and then map-side partial sums: a line of a third of all documents makes no large group
        own = lines.select("doc_id", *HASH).distinct().groupBy(*HASH).agg(F.count("*").alias("n_docs"), F.max("doc_id").alias("last"))
        seen = F.lit(False)
        for i, r in enumerate(self.runs()):
            # of all runs one at most holds the line with its holder
            own = own.join(r.where("holder is not null").select(*HASH, F.lit(True).alias(f"in_{i}")).hint("merge"), HASH, "left")
            seen = seen | F.coalesce(f"in_{i}", F.lit(False))
        self._place(own.select(*HASH, "n_docs", F.when(~seen, F.col("last")).alias("holder")), 0)

    def _place(self, run: DataFrame, level: int) -> None:
        run = self.store.put_sorted(run, HASH, self.buckets, f"run-{level}")
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(run)
        if len(self.levels[level]) >= self.fanout:
            old, self.levels[level] = self.levels[level], []
            self._place(self._merged(old), level + 1)
            for r in old:
                self.store.drop(r)

    def _merged(self, runs: list[DataFrame]) -> DataFrame:
        def two(a: DataFrame, b: DataFrame) -> DataFrame:
            b = b.select(*HASH, F.col("n_docs").alias("n_b"), F.col("holder").alias("holder_b")).hint("merge")
            n = F.coalesce("n_docs", F.lit(0)) + F.coalesce("n_b", F.lit(0))
            return a.join(b, HASH, "full").select(*HASH, n.cast("long").alias("n_docs"), F.coalesce("holder", "holder_b").alias("holder"))

        return reduce(two, runs)

    def state(self) -> DataFrame:
        return self._merged(self.runs())


def dropped_lines(docs: DataFrame, store: Store, min_chars: int = 20, min_docs: int = 3, batches: int = 3, fanout: int = 2, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(doc_id, lines): of each document the first hashes of the lines it loses; documents that lose none are not listed."""
    keys = store.put(line_keys(docs, min_chars, text, key), "keys")
    runs = LineRuns(store, fanout)
    edges = keys.selectExpr(f"percentile_approx(doc_id, array({', '.join(str(i / batches) for i in range(1, batches))}), 1000) q").first()[0] if batches > 1 else []
    edges = sorted(set(edges or []), reverse=True)
    for hi, lo in zip([None, *edges], [*edges, None], strict=True):
        part = keys if hi is None else keys.where(F.col("doc_id") <= hi)
        runs.add(part if lo is None else part.where(F.col("doc_id") > lo))
    # written first, here and below: a join of plain scans can be split where one line or document has very many rows
    common = store.put(runs.state().where(F.col("n_docs") >= min_docs).select(*HASH, "holder"), "common")
    hits = keys.join(common, HASH).where("doc_id <> holder")
    out = store.put(hits.groupBy("doc_id").agg(F.collect_set("h1").alias("lines")), "dropped")
    for table in (keys, common, *runs.runs()):
        store.drop(table)
    return out


def _strip(min_chars: int, with_text: bool):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches, "text"):
            data, off, starts, ends, doc = _lines(piece.column(1))
            n = piece.num_rows
            lists = piece.column(2)
            gone = np.zeros(len(doc), bool)
            counts = np.asarray(pc.fill_null(pc.list_value_length(lists), 0))
            if counts.any():
                # of a document the lines whose hash it loses: pairs of text number and hash
                lose = np.asarray(lists.flatten()).view(np.uint64) ^ mix(np.repeat(np.arange(n), counts).astype(U64), 21)
                at, h1, _ = _keyed(data, starts, ends, min_chars)
                gone[at] = np.isin(h1 ^ mix(doc[at].astype(U64), 21), lose)
            stay = np.flatnonzero(~gone)
            a, b, of = starts[stay], ends[stay], doc[stay]
            # the newline after a kept line stays if another kept line of the text follows
            more = np.zeros(len(stay), np.int64)
            more[:-1] = of[1:] == of[:-1]
            if gone.any():
                edge = np.zeros(len(data) + 2, np.int32)
                np.add.at(edge, a, 1)
                np.subtract.at(edge, b + more, 1)
                body = data[np.cumsum(edge)[: len(data)] > 0]
            else:
                body = data
            sizes = np.bincount(of, weights=b - a + more, minlength=n).astype(np.int64)
            to = np.zeros(n + 1, np.int32)
            np.cumsum(sizes, out=to[1:])
            raw = body.tobytes()
            sums = [hashlib.sha256(memoryview(raw)[x:y]).hexdigest() for x, y in zip(to[:-1], to[1:], strict=True)]
            total, lost = np.bincount(doc, minlength=n), np.bincount(doc, weights=gone, minlength=n)
            cols = [piece.column(0), pa.array(total.astype(np.int64)), pa.array(lost.astype(np.int64)), pa.array(sums, pa.string())]
            names = ["doc_id", "n_lines", "n_dropped", "kept_sha256"]
            if with_text:
                kept = pa.StringArray.from_buffers(n, pa.py_buffer(to), pa.py_buffer(raw))
                cols.append(pc.if_else(piece.column(1).is_valid(), kept, pa.scalar(None, pa.string())))
                names.append("kept")
            yield pa.RecordBatch.from_arrays(cols + piece.columns[3:], names=names + piece.schema.names[3:])

    return run


def strip_lines(docs: DataFrame, lines: DataFrame, min_chars: int = 20, text: str = "text", key: str = "doc_id", with_text: bool = True, keep: list[str] | None = None) -> DataFrame:
    """(doc_id, n_lines, n_dropped, kept_sha256), if asked for ``kept`` (the text without its dropped lines, null for a null
    text), and the columns named in ``keep``."""
    keep = keep or []
    kept_cols = [F.col(f"`{k}`").alias(f"keep_{i}") for i, k in enumerate(keep)]
    # merged at every size: the table of lost lines grows with the documents, so it is not broadcast where it happens to be small
    joined = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"), *kept_cols).join(lines.hint("merge"), "doc_id", "left")
    joined = joined.select("doc_id", "text", "lines", *(f"keep_{i}" for i in range(len(keep))))
    schema = "doc_id long, n_lines long, n_dropped long, kept_sha256 string" + (", kept string" if with_text else "") + "".join(f", {c} {kind}" for c, kind in joined.dtypes[3:])
    return joined.mapInArrow(_strip(min_chars, with_text), schema).withColumnsRenamed({f"keep_{i}": k for i, k in enumerate(keep)})


def dedup_lines(docs: DataFrame, min_chars: int = 20, min_docs: int = 3, batches: int = 3, fanout: int = 2, text: str = "text", key: str = "doc_id", with_text: bool = True) -> DataFrame:
    """Lines whose key has ``min_chars`` code points and occurs in ``min_docs`` documents go from all documents but the
    largest ``key`` that holds them, where all their occurrences stay.

    One row per input row. Null text counts as one empty line. Rows that share a doc_id are one document: a line of several of
    them counts once, and it goes from, or stays in, all of them; no other line of theirs is touched. A null doc_id holds no
    line and loses none. An empty table gives an empty result. Other columns are ignored.
    """
    store = Store(docs.sparkSession, "line-runs")
    return strip_lines(docs, dropped_lines(docs, store, min_chars, min_docs, batches, fanout, text, key), min_chars, text, key, with_text)
