"""Benchmark decontamination: one Aho-Corasick automaton over the normalised benchmark texts.

A text is normalised to its words in lower case; each word is a number by its place in the benchmark's vocabulary, and words
that the benchmark lacks are 0. The automaton's patterns are the benchmark's windows of ``width`` words as runs of
such numbers. Every text is scanned once; matches are runs of whole words, and where asked for they are mapped to offsets in the
original text.

The benchmark is turned into word hashes on the executors. Up to ``block_words`` words it goes to them as one block, from which a
worker builds the automaton once for all its tasks. A larger one is scanned block by block, each block in a pass of its own
that writes only what it found; beyond ``max_blocks`` blocks hashed windows of documents and benchmark are joined in Spark. All ways
give the same results, and none holds more than one block in a worker or at the driver.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._store import Store
from ._words import U64, Chunk, pieces, roll, signed

#: Bytes that part words: ASCII but digits and letters.
GAP = np.zeros(256, bool)
GAP[[*range(0x00, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]] = True

#: Two hashes that stand, with the doc_id, for a row's text where tables are joined.
ROW = ["x1", "x2"]
_NOTHING = hashlib.sha256(b"").hexdigest()


def _chunk(arr: pa.Array) -> Chunk:
    return Chunk(arr, GAP, lower=True)


def _item_words(width: int, block_words: int):
    """Items as hashes of their words, in parts of at most ``block_words`` that overlap by a window less one word."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches, "text"):
            c = _chunk(piece.column(1))
            h = [signed(c.word_hashes(w)) for w in (0, 1)]
            names, parts = [], []
            for i, name in enumerate(piece.column(0).to_pylist()):
                a, b = int(c.first[i]), int(c.first[i + 1])
                for lo in range(a, max(b - width + 1, min(b, a + 1)), max(1, block_words - width + 1)):
                    names.append(name)
                    parts.append((lo, min(b, lo + max(block_words, width))))
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), *(pa.array([x[a:b] for a, b in parts], pa.list_(pa.int64())) for x in h)], names=["item", "words", "more"])

    return run, "item string, words array<long>, more array<long>"


@dataclass
class Block:
    """Items of a block: their names in order as strings, and of each part its item's number (-1 without a name) and its words."""

    names: list[str]
    number: list[int]
    words: list[np.ndarray]
    width: int

    @classmethod
    def of(cls, rows: Iterable, width: int) -> Block:
        rows = list(rows)
        names = sorted({r.item for r in rows if r.item is not None})
        place = {n: i for i, n in enumerate(names)}
        return cls(names, [place.get(r.item, -1) for r in rows], [np.array(r.words, np.int64).view(U64) for r in rows], width)


class Matcher:
    """The automaton of a block; ``find`` gives the matches in a chunk of texts."""

    def __init__(self, block: Block):
        self.names = block.names
        self.vocabulary = np.unique(np.concatenate(block.words)) if block.words else np.zeros(0, U64)
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
        sizes: list[int] = []
        owners: list[set[int]] = []
        for who, words in zip(block.number, block.words, strict=True):
            w = tuple((np.searchsorted(self.vocabulary, words) + 1).tolist())
            size = min(block.width, len(w))
            for i in range(len(w) - size + 1 if size else 0):
                k = self.automaton.get(w[i : i + size], -1)
                if k < 0:
                    k = len(sizes)
                    self.automaton.add_word(w[i : i + size], k)
                    sizes.append(size)
                    owners.append(set())
                if who >= 0:
                    owners[k].add(who)
        self.sizes = np.array(sizes, np.int64)
        self.least = int(self.sizes.min()) if sizes else 0
        #: Of each pattern the numbers of its items, one list behind the other.
        self.owner = np.array([x for s in owners for x in sorted(s)], np.int64)
        self.owner_at = np.concatenate([[0], np.cumsum([len(s) for s in owners])]).astype(np.int64)
        if sizes:
            self.automaton.make_automaton()

    def find(self, c: Chunk) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(first words and words after the last, by number in the chunk; text numbers and item numbers, each pair once)."""
        none = np.zeros(0, np.int64)
        h = c.word_hashes(0)
        if not len(h) or not len(self.sizes):
            return none, none, none, none
        at = np.minimum(np.searchsorted(self.vocabulary, h), len(self.vocabulary) - 1)
        number = np.where(self.vocabulary[at] == h, at + 1, 0)
        # only runs of words of the benchmark, within one text, as long as its shortest window are looked into
        doc = c.doc_of_word()
        known = number > 0
        breaks = np.flatnonzero(known[1:] != known[:-1]) + 1
        breaks = np.union1d(np.concatenate([[0], breaks, [len(h)]]), c.first)
        a, b = breaks[:-1], breaks[1:]
        some = known[a] & (b - a >= self.least)
        ends, pats = [], []
        for x, y in zip(a[some].tolist(), b[some].tolist(), strict=True):
            for end, k in self.automaton.iter(tuple(number[x:y].tolist())):
                ends.append(x + end + 1)
                pats.append(k)
        if not ends:
            return none, none, none, none
        last, pat = np.array(ends, np.int64), np.array(pats, np.int64)
        n = self.owner_at[pat + 1] - self.owner_at[pat]
        items = self.owner[np.repeat(self.owner_at[pat] - np.cumsum(n) + n, n) + np.arange(int(n.sum()))]
        pairs = np.unique(np.repeat(doc[last - 1], n) * max(1, len(self.names)) + items)
        return last - self.sizes[pat], last, pairs // max(1, len(self.names)), pairs % max(1, len(self.names))


_last: tuple[str, Matcher] | None = None


def _matcher(name: str, sent) -> Matcher:
    """The matcher of a block, kept for the next tasks of this worker."""
    global _last
    if _last is None or _last[0] != name:
        _last = None
        _last = (name, Matcher(sent.value))
    return _last[1]


def _covered(n: int, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    edge = np.zeros(n + 1, np.int32)
    np.add.at(edge, first, 1)
    np.subtract.at(edge, last, 1)
    return np.cumsum(edge[:n]) > 0


def _columns(c: Chunk, cover: np.ndarray, items: dict[int, list[str]], with_spans: bool) -> tuple[list[pa.Array], list[str]]:
    """What is told of each text, from its hit words and the names of its items, in order."""
    hit = np.zeros(len(cover) + 1, np.int64)
    np.cumsum(cover, out=hit[1:])
    n_hit = hit[c.first[1:]] - hit[c.first[:-1]]
    names = [items.get(i, []) for i in range(len(c))]
    sums = [hashlib.sha256(",".join(x).encode()).hexdigest() if x else _NOTHING for x in names]
    cols = [pa.array(c.n_words.astype(np.int64)), pa.array(n_hit), pa.array([len(x) for x in names], pa.int64()), pa.array(sums, pa.string())]
    out = ["n_words", "n_hit", "n_items", "items_sha256"]
    if with_spans:
        spans: list[list[list[int]]] = [[] for _ in range(len(c))]
        for i in np.flatnonzero(n_hit):
            a, b = c.first[i], c.first[i + 1]
            runs = np.flatnonzero(np.diff(np.concatenate([[0], cover[a:b].astype(np.int8), [0]]))).reshape(-1, 2)
            body = c.data[c.offsets[i] : c.offsets[i + 1]]
            points = np.cumsum((body & 0xC0) != 0x80)
            at = c.offsets[i]
            spans[i] = [[int(points[c.starts[a + x] - at]) - 1, int(points[c.ends[a + y - 1] - at - 1])] for x, y in runs]
        cols += [pa.array(names, pa.list_(pa.string())), pa.array(spans, pa.list_(pa.list_(pa.int32())))]
        out += ["items", "spans"]
    return cols, out


_TOLD = "n_words long, n_hit long, n_items long, items_sha256 string"


def _scan(name: str, sent, with_spans: bool, back: list[str]):
    """Whole texts against one block: the result itself."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches, "text"):
            m = _matcher(name, sent)
            c = _chunk(piece.column(1))
            first, last, docs, who = m.find(c)
            items: dict[int, list[str]] = {}
            for i, k in zip(docs.tolist(), who.tolist(), strict=True):
                items.setdefault(i, []).append(m.names[k])
            cols, names = _columns(c, _covered(len(c.starts), first, last), items, with_spans)
            yield pa.RecordBatch.from_arrays([*(piece.column(k) for k in back), *cols], names=[*back, *names])

    return run


def _found(name: str, sent):
    """Texts in which windows of a block occur: the starts and ends of the matches in words, and the names of the items."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches, "text"):
            m = _matcher(name, sent)
            c = _chunk(piece.column(1))
            first, last, docs, who = m.find(c)
            doc = np.searchsorted(c.first, first, side="right") - 1
            hit = np.unique(doc)
            of = pa.array(hit)
            mine = [np.flatnonzero(doc == i) for i in hit]
            yield pa.RecordBatch.from_arrays(
                [piece.column(0).take(of), piece.column(2).take(of), piece.column(3).take(of), pa.array([(first[x] - c.first[i]) for i, x in zip(hit, mine, strict=True)], pa.list_(pa.int64())), pa.array([(last[x] - c.first[i]) for i, x in zip(hit, mine, strict=True)], pa.list_(pa.int64())), pa.array([[m.names[k] for k in who[docs == i]] for i in hit], pa.list_(pa.string()))],
                names=["doc_id", *ROW, "first", "last", "items"],
            )

    return run, "doc_id long, x1 long, x2 long, first array<long>, last array<long>, items array<string>"


def _windows(sizes: list[int]):
    """All windows of the texts: (row, start, size, two hashes)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches, "text"):
            c = _chunk(piece.column(1))
            h = [c.word_hashes(w) for w in (0, 1)]
            for n in sizes:
                if len(h[0]) < n:
                    continue
                doc = c.doc_of_word()
                at = np.flatnonzero(doc[: len(doc) - n + 1] == doc[n - 1 :])
                of = pa.array(doc[at])
                yield pa.RecordBatch.from_arrays([piece.column(0).take(of), piece.column(2).take(of), piece.column(3).take(of), pa.array(at - c.first[doc[at]]), pa.array(np.full(len(at), n)), *(pa.array(signed(roll(x, n, w)[at])) for w, x in enumerate(h))], names=["doc_id", *ROW, "first", "n", "h1", "h2"])

    return run, "doc_id long, x1 long, x2 long, first long, n long, h1 long, h2 long"


def _pattern_rows(width: int):
    """Windows of the items: (item, size, two hashes)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                w = [np.asarray(batch.column(k)[i].values).view(U64) for k in (1, 2)]
                n = min(width, len(w[0]))
                if not n:
                    continue
                h = [signed(roll(x, n, k)) for k, x in enumerate(w)]
                yield pa.RecordBatch.from_arrays([pa.array([batch.column(0)[i].as_py()] * len(h[0]), pa.string()), pa.array(np.full(len(h[0]), n)), *map(pa.array, h)], names=["item", "n", "h1", "h2"])

    return run, "item string, n long, h1 long, h2 long"


def _digest(with_spans: bool, back: list[str]):
    """Texts with what was found in them -> the result."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches, "text"):
            c = _chunk(piece.column(1))
            first, last, who = (piece.column(k) for k in ("first", "last", "items"))
            shift = [np.repeat(c.first[:-1], np.asarray(pa.compute.fill_null(pa.compute.list_value_length(x), 0))) for x in (first, last)]
            cover = _covered(len(c.starts), np.asarray(first.flatten(), np.int64) + shift[0], np.asarray(last.flatten(), np.int64) + shift[1])
            items = {i: x for i, x in enumerate(who.to_pylist()) if x}
            cols, names = _columns(c, cover, items, with_spans)
            yield pa.RecordBatch.from_arrays([*(piece.column(k) for k in back), *cols], names=[*back, *names])

    return run


def _blocks(items: DataFrame, block_words: int, width: int) -> Iterator[Block]:
    """The parts in blocks; one block at a time is at the driver."""
    held, size = [], 0
    for r in items.select("item", "words").toLocalIterator():
        if held and size + len(r.words) > block_words:
            yield Block.of(held, width)
            held, size = [], 0
        held.append(r)
        size += len(r.words)
    if held:
        yield Block.of(held, width)


def scan(docs: DataFrame, benchmark: DataFrame, width: int = 13, block_words: int = 200_000, max_blocks: int = 16, text: str = "text", key: str = "doc_id", item: str = "item_id", item_text: str = "text", with_spans: bool = True, keep: list[str] | None = None) -> DataFrame:
    """One row per input row: doc_id, n_words, n_hit (words inside a match), n_items, items_sha256, contaminated and, if
    asked for, ``items`` and ``spans`` (maximal runs of hit words as code point intervals of the original text), and the
    columns named in ``keep``.

    An item of fewer than ``width`` words, but not none, is one window. Null and empty texts have no words and are
    never contaminated. Repeated rows each come back; repeated items count once. Windows of an item without an id hit words like
    any others, but there is nothing to list or count it by. An empty benchmark hits nothing, an empty table gives an empty
    result. Other columns are ignored.
    """
    keep = keep or []
    spark = docs.sparkSession
    store = Store(spark, "contamination")
    run, schema = _item_words(width, block_words)
    items = store.put(benchmark.select(F.col(item).cast("string").alias("item"), F.col(item_text).alias("text")).mapInArrow(run, schema), "items")
    total = items.agg(F.coalesce(F.sum(F.size("words")), F.lit(0))).first()[0]

    kept = [F.col(f"`{k}`").alias(f"keep_{i}") for i, k in enumerate(keep) if k != text]
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"), *kept)
    back = [c for c in rows.columns if c != "text" or text in keep]
    told = ", ".join(f"{c} {kind}" for c, kind in rows.dtypes if c in back) + f", {_TOLD}" + (", items array<string>, spans array<array<int>>" if with_spans else "")
    if total <= block_words:
        # at most block_words numbers and the items' names
        block = Block.of(items.select("item", "words").collect(), width)
        out = rows.mapInArrow(_scan(uuid.uuid4().hex, spark.sparkContext.broadcast(block), with_spans, back), told)
    else:
        found = _by_block(rows, items, store, block_words, width) if total <= max_blocks * block_words else _by_join(rows, items, store, width)
        lists = {c: F.flatten(F.collect_list(c)) for c in ("first", "last")} | {"items": F.array_sort(F.array_distinct(F.flatten(F.collect_list("items"))))}
        found = store.put(found.groupBy("doc_id", *ROW).agg(*(v.alias(k) for k, v in lists.items())), "found")
        joined = _keyed(rows, kept=True).withColumn("_null", F.col("doc_id").isNull())
        found = found.withColumn("_null", F.col("doc_id").isNull()).withColumn("doc_id", F.coalesce("doc_id", F.lit(0)))
        joined = joined.withColumn("_id", F.coalesce("doc_id", F.lit(0))).join(found.withColumnRenamed("doc_id", "_id"), ["_id", "_null", *ROW], "left")
        out = joined.select(*rows.columns, "first", "last", "items").mapInArrow(_digest(with_spans, back), told)
    out = out.withColumnsRenamed({"text": text} | {f"keep_{i}": k for i, k in enumerate(keep)})
    named = ["n_words", "n_hit", "n_items", "items_sha256", *(["items", "spans"] if with_spans else [])]
    return out.select("doc_id", *named, *(F.col(f"`{k}`") for k in keep)).withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))


def _keyed(rows: DataFrame, kept: bool = False) -> DataFrame:
    t = F.coalesce("text", F.lit(""))
    cols = rows.columns if kept else ["doc_id", "text"]
    return rows.select(*cols, F.xxhash64(t).alias("x1"), F.xxhash64(F.lit(1), t).alias("x2"))


def _by_block(rows: DataFrame, items: DataFrame, store: Store, block_words: int, width: int) -> DataFrame:
    out = None
    for block in _blocks(items, block_words, width):
        sent = store.spark.sparkContext.broadcast(block)
        run, schema = _found(uuid.uuid4().hex, sent)
        found = store.put(_keyed(rows).mapInArrow(run, schema).dropDuplicates(["doc_id", *ROW]), "block")
        sent.unpersist()
        out = found if out is None else out.unionByName(found)
    return out


def _by_join(rows: DataFrame, items: DataFrame, store: Store, width: int) -> DataFrame:
    run, schema = _pattern_rows(width)
    patterns = store.put(items.mapInArrow(run, schema).groupBy("n", "h1", "h2").agg(F.collect_set("item").alias("items")), "patterns")
    # sizes are at most ``width`` numbers
    run, schema = _windows(sorted(r.n for r in patterns.select("n").distinct().collect()))
    hits = _keyed(rows).mapInArrow(run, schema).join(patterns, ["n", "h1", "h2"]).withColumn("last", F.col("first") + F.col("n"))
    by = hits.select("doc_id", *ROW, "first", "last", "items").distinct().groupBy("doc_id", *ROW)
    return by.agg(F.collect_list("first").alias("first"), F.collect_list("last").alias("last"), F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"))
