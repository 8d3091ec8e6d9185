"""N-gram Jaccard join by chosen paths.

A document is the set of its runs of ``n`` words. In each of several independent runs a set samples a few of its
tokens, by a hash that all sets share, and goes into the bucket of each; tokens are sampled so that two sets of
similarity ``threshold`` share ``paths * threshold`` of them on average. Buckets of few sets are compared outright;
larger ones are split again on a token sampled given the path so far, unless splitting no longer parts them (their
sets resemble each other) or ``depth`` is reached, and then they are compared in blocks of bounded size. The number of
runs follows from the target recall (``runs_needed``).

Comparing in buckets uses short sketches (the least hashes of a set) and draws candidate links, a spanning forest of
them in each block. Documents so connected form a family. Families are then compared whole, block by block, with all
their tokens: links are counted by exact Jaccard similarity, without ever writing pairs out, and a spanning forest of
the true links gives the groups. Sets that are equal are one class throughout and are counted by weight.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._components import connected_components
from ._store import Store
from ._words import U64, Chunk, mix, pieces, powers, roll, signed


@dataclass(frozen=True)
class Join:
    """``n`` words a token, ``threshold`` of similarity, ``recall`` of links at the threshold itself, ``paths`` sampled
    tokens a run and level, ``bucket`` and ``block`` sizes, ``sketch`` length, ``depth`` of paths, ``max_listed`` ids that may be sent to the executors."""

    n: int = 5
    threshold: float = 0.8
    recall: float = 0.99999
    paths: float = 4.0
    bucket: int = 512
    block: int = 256
    sketch: int = 48
    depth: int = 3
    max_listed: int = 1_000_000

    @property
    def runs(self) -> int:
        return runs_needed(self.threshold, self.paths, self.recall)


def runs_needed(threshold: float, paths: float, recall: float) -> int:
    """A pair at the threshold shares a Poisson number of children with mean m = paths * threshold at every level, so the
    chance q that its line dies out is the least root of q = exp(-m (1 - q)), and r runs miss it with chance q ** r."""
    q = 0.0
    for _ in range(200):
        q = math.exp(-threshold * paths * (1 - q))
    return max(1, math.ceil(math.log(1 - recall) / math.log(q)))


def _lists(values: np.ndarray, counts: np.ndarray) -> pa.Array:
    offsets = np.zeros(len(counts) + 1, np.int32)
    np.cumsum(counts, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))


def _token_sets(piece: pa.RecordBatch, n: int) -> tuple[list[np.ndarray], np.ndarray]:
    """Of each text its tokens, sorted and distinct, and two hashes of the whole set."""
    c = Chunk(piece.column(piece.schema.get_field_index("text")))
    h = c.word_hashes(0)
    grams = roll(h, n) if len(h) >= n else np.zeros(0, U64)
    sets, sums = [], np.zeros((2, len(c)), U64)
    for i in range(len(c)):
        a, b = c.first[i], c.first[i + 1]
        if b - a >= n:
            t = np.unique(grams[a : b - n + 1])
        elif b > a:
            # a text of fewer words than a token is one token
            t = mix((h[a:b] * powers(0, b - a)).sum(keepdims=True), 1000 + int(b - a))
        else:
            t = np.zeros(0, U64)
        sets.append(t)
        for w in (0, 1):
            sums[w, i] = mix(t, 40 + w).sum(dtype=U64)
    return sets, sums


def _signatures(j: Join, kept: str):
    """row_id -> size and two hashes of its set, the paths of level 1 and the sketch; the tokens themselves are not kept. Columns
    after the text come back behind."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches, "text"):
            sets, sums = _token_sets(piece, j.n)
            sizes = np.array([len(t) for t in sets])
            tokens = np.concatenate(sets)
            # a token is taken where its hash is below paths / size: the larger set of a pair decides
            bound = np.repeat(np.minimum(j.paths / np.maximum(sizes, 1), 1.0) * 2.0**64, sizes)
            doc = np.repeat(np.arange(len(sizes)), sizes)
            docs, paths = [], []
            for r in range(j.runs):
                h = mix(tokens, 100 + r)
                at = np.flatnonzero(h.astype(np.float64) < bound)
                docs.append(doc[at])
                paths.append(mix(h[at], 7))
            docs, paths = np.concatenate(docs), np.concatenate(paths)
            order = np.argsort(docs, kind="stable")
            sketch = [(t[: j.sketch] >> U64(32)).astype(np.uint32).view(np.int32) for t in sets]
            yield pa.RecordBatch.from_arrays(
                [piece.column(0), pa.array(sizes.astype(np.int32)), *(pa.array(signed(x)) for x in sums), _lists(signed(paths[order]), np.bincount(docs, minlength=len(sizes))), _lists(np.concatenate(sketch), np.array([len(x) for x in sketch])), *piece.columns[2:]],
                names=["row_id", "size", "k1", "k2", "paths", "sketch", *piece.schema.names[2:]],
            )

    return run, f"row_id long, size int, k1 long, k2 long, paths array<long>, sketch array<int>, {kept}"


def _tokens_of(docs: DataFrame, wanted: DataFrame, j: Join) -> DataFrame:
    """(row_id, k1, k2, tokens) of the rows listed in ``wanted`` (row_id), read from their texts again. A row_id may stand for several texts.

    While the list is short it goes to the executors and no text moves; beyond ``max_listed`` texts are joined with it.
    """
    wanted = wanted.select("row_id").distinct()
    listed = None
    if wanted.count() <= j.max_listed:
        # at most max_listed numbers
        listed = np.sort(wanted.toArrow().column("row_id").to_numpy())
    else:
        docs = docs.join(wanted, "row_id", "left_semi")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if listed is not None:
                ids = batch.column(0).to_numpy()
                at = np.minimum(np.searchsorted(listed, ids), max(len(listed) - 1, 0))
                batch = batch.filter(pa.array(listed[at] == ids if len(listed) else np.zeros(len(ids), bool)))
            for piece in pieces([batch], "text"):
                sets, sums = _token_sets(piece, j.n)
                yield pa.RecordBatch.from_arrays([piece.column(0), *(pa.array(signed(x)) for x in sums), _lists(signed(np.concatenate(sets)), np.array([len(t) for t in sets]))], names=["row_id", "k1", "k2", "tokens"])

    return docs.select("row_id", "text").mapInArrow(run, "row_id long, k1 long, k2 long, tokens array<long>")


def _arrays(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(offsets from 0, values) of a list column, as unsigned longs."""
    off = np.asarray(col.offsets).astype(np.int64)
    values = np.asarray(col.values)[off[0] : off[-1]]
    return off - off[0], values.view(np.uint64 if values.dtype == np.int64 else np.uint32)


def _next_buckets(j: Join, level: int):
    """Children of large buckets: rows (doc_id, tokens, paths) -> (doc_id, parent, path)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            off, tokens = _arrays(batch.column(1))
            poff, paths = _arrays(batch.column(2))
            ids, out = [], []
            doc_ids = batch.column(0).to_numpy()
            for i in range(batch.num_rows):
                t = tokens[off[i] : off[i + 1]]
                bound = min(j.paths / max(len(t), 1), 1.0) * 2.0**64
                for p in paths[poff[i] : poff[i + 1]]:
                    h = mix(mix(t, 200 + level) ^ p, 300 + level)
                    h = h[h.astype(np.float64) < bound]
                    ids.append(np.full(len(h), doc_ids[i]))
                    out.append(np.stack([np.full(len(h), p), mix(h, 9)]))
            if ids:
                both = np.concatenate(out, axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(ids)), pa.array(signed(np.ascontiguousarray(both[0]))), pa.array(signed(np.ascontiguousarray(both[1])))], names=["doc_id", "parent", "path"])

    return run, "doc_id long, parent long, path long"


def _blocked(rows: DataFrame, size: int) -> DataFrame:
    """Rows (group, doc_id, n: the group's size, ...) dealt into pairs of blocks: each row meets each other of its group in
    exactly one cell (group, x, y); rows of the block x and y are marked by ``side`` (0, 1, or 0 where x = y)."""
    blocks = F.ceil(F.col("n") / size).cast("int")
    mine = F.pmod(F.xxhash64("doc_id", F.lit(17)), F.col("blocks").cast("long")).cast("int")
    d = rows.withColumn("blocks", blocks).withColumn("own", mine)
    d = d.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return d.withColumn("x", F.least("own", "other")).withColumn("y", F.greatest("own", "other")).withColumn("side", (F.col("own") > F.col("other")).cast("int")).drop("blocks", "own", "other", "n")


def _cells(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Cells of rows sorted by (group, x, y), which are the first three columns; a cell may span batches."""
    held: list[pa.RecordBatch] = []
    key = None
    for batch in batches:
        if not batch.num_rows:
            continue
        k = np.stack([batch.column(i).to_numpy(zero_copy_only=False) for i in range(3)])
        cuts = np.flatnonzero((k[:, 1:] != k[:, :-1]).any(axis=0)) + 1
        for a, b in zip([0, *cuts], [*cuts, batch.num_rows], strict=True):
            now = tuple(k[:, a])
            if now != key and held:
                yield pa.Table.from_batches(held)
                held = []
            key = now
            held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held)


def _overlap(off: np.ndarray, values: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Sizes of the common parts of the sets numbered ``left`` and those numbered ``right``, slab by slab of the values."""
    sets = np.repeat(np.arange(len(off) - 1), np.diff(off))
    uniq, code, count = np.unique(values, return_inverse=True, return_counts=True)
    shared = count > 1
    number = np.cumsum(shared) - 1
    keep = shared[code]
    code, sets = number[code[keep]], sets[keep]
    out = np.zeros((len(left), len(right)), np.float32)
    total = int(number[-1]) + 1 if len(number) else 0
    order = np.argsort(code, kind="stable")
    code, sets = code[order], sets[order]
    for a in range(0, total, 4096):
        lo, hi = np.searchsorted(code, [a, a + 4096])
        m = np.zeros((len(off) - 1, min(4096, total - a)), np.float32)
        m[sets[lo:hi], code[lo:hi] - a] = 1
        out += m[left] @ m[right].T
    return out


def _tree(links: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """Of a symmetric graph: the component of each node, and the edges of a spanning forest. Each node is visited once."""
    n = len(links)
    label = np.full(n, -1)
    edges: list[tuple[int, int]] = []
    for start in range(n):
        if label[start] >= 0:
            continue
        label[start] = start
        stack = [start]
        while stack:
            i = stack.pop()
            new = np.flatnonzero(links[i] & (label < 0))
            label[new] = start
            stack.extend(new.tolist())
            edges.extend((i, int(k)) for k in new)
    return label, edges


def _forest(links: np.ndarray, left: np.ndarray, right: np.ndarray) -> list[tuple[int, int]]:
    """Edges that connect what the links of a cell connect. Links within a block are those of the block's own cell; between
    two blocks only edges that join components of theirs are given, so dense groups cost about one edge a set."""
    if left is right:
        return _tree(links)[1]
    label = np.empty(len(links), np.int64)
    for part in (left, right):
        label[part] = part[_tree(links[np.ix_(part, part)])[0]]
    x, y = np.nonzero(links[np.ix_(left, right)])
    x, y = left[x], right[y]
    _, first = np.unique(label[x] * len(links) + label[y], return_index=True)
    root = {}

    def find(i: int) -> int:
        while root.get(i, i) != i:
            i = root[i]
        return i

    out = []
    for i in first:
        a, b = find(int(label[x[i]])), find(int(label[y[i]]))
        if a != b:
            root[b] = a
            out.append((int(x[i]), int(y[i])))
    return out


def _sides(table: pa.Table):
    side = table.column("side").to_numpy()
    x, y = table.column("x")[0].as_py(), table.column("y")[0].as_py()
    left = np.flatnonzero(side == 0)
    return (left, left) if x == y else (left, np.flatnonzero(side == 1))


def _candidates(j: Join):
    """Cells of sketches -> candidate links."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a_out: list[int] = []
        b_out: list[int] = []
        for cell in _cells(batches):
            if cell.num_rows < 2:
                continue
            left, right = _sides(cell)
            if not len(left) or not len(right):
                continue
            ids = cell.column("doc_id").to_numpy()
            off, values = _arrays(cell.column("sketch").combine_chunks())
            size = np.diff(off)
            every = np.arange(len(size))
            # the least hashes of sets at the threshold agree in that share, give or take; a set below 5/8 of it is no candidate
            links = _overlap(off, values, every, every) >= 0.625 * j.threshold * np.minimum(size[:, None], size[None, :])
            np.fill_diagonal(links, False)
            for x, y in _forest(links, left, right):
                a_out.append(ids[x])
                b_out.append(ids[y])
            if len(a_out) > 50_000:
                yield pa.RecordBatch.from_arrays([pa.array(a_out, pa.int64()), pa.array(b_out, pa.int64())], names=["a", "b"])
                a_out, b_out = [], []
        yield pa.RecordBatch.from_arrays([pa.array(a_out, pa.int64()), pa.array(b_out, pa.int64())], names=["a", "b"])

    return run, "a long, b long"


def _verify(j: Join):
    """Cells of whole sets -> per set the weight of its links in the cell (b null), and a forest of links (n null)."""
    # the threshold as it is written, so that links at the edge are not moved by rounding
    part, of = Fraction(str(j.threshold)).as_integer_ratio()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cell in _cells(batches):
            if cell.num_rows < 2:
                continue
            left, right = _sides(cell)
            if not len(left) or not len(right):
                continue
            ids, weight = cell.column("doc_id").to_numpy(), cell.column("weight").to_numpy()
            off, values = _arrays(cell.column("tokens").combine_chunks())
            size = np.diff(off)
            every = np.arange(len(size))
            common = _overlap(off, values, every, every).astype(np.int64)
            links = of * common >= part * (size[:, None] + size[None, :] - common)
            np.fill_diagonal(links, False)
            across = links[np.ix_(left, right)]
            n = across @ weight[right]
            back = [] if left is right else across.T @ weight[left]
            forest = _forest(links, left, right)
            a = [*ids[left], *([] if left is right else ids[right]), *(ids[x] for x, _ in forest)]
            b = [None] * (len(a) - len(forest)) + [ids[y] for _, y in forest]
            w = [*n, *back] + [None] * len(forest)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(w, pa.int64())], names=["a", "b", "n"])

    return run, "a long, b long, n long"


def _in_cells(rows: DataFrame) -> DataFrame:
    return rows.repartition("group", "x", "y").sortWithinPartitions("group", "x", "y")


def _leaves(docs: DataFrame, reps: DataFrame, j: Join, store: Store) -> DataFrame:
    """(group, doc_id, n) of the buckets to compare, of all runs and levels."""
    # a bucket whose sets mostly share their least token holds sets that resemble each other, which no split would part
    rows = reps.select("doc_id", F.explode("paths").alias("path"), F.lit(1 << 62).alias("parent_n"), F.col("sketch")[0].alias("least"))
    out = None
    for level in range(1, j.depth + 1):
        # sizes are written before they are joined: a join of plain scans can be split where a bucket is very large
        alike = rows.groupBy("path", "least").agg(F.count("*").alias("n"), F.max("parent_n").alias("pn"))
        sizes = alike.groupBy("path").agg(F.sum("n").alias("n"), F.max("pn").alias("pn"), F.max(F.when(F.col("least").isNotNull(), F.col("n"))).alias("same")).where("n > 1")
        sizes = store.put(sizes, "sizes")
        rows = store.put(rows.select("doc_id", "path").join(sizes, "path"), "sized")
        last = F.lit(level == j.depth)
        leaf = (F.col("n") <= j.bucket) | (2 * F.col("n") > F.col("pn")) | F.coalesce(2 * F.col("same") > F.col("n"), F.lit(False)) | last
        found = rows.where(leaf).select(F.col("path").alias("group"), "doc_id", "n")
        out = found if out is None else out.unionByName(found)
        large = rows.where(~leaf)
        if level == j.depth or large.isEmpty():
            break
        paths = large.groupBy("doc_id").agg(F.collect_set("path").alias("paths"))
        run, schema = _next_buckets(j, level)
        wanted = store.put(reps.select("doc_id", "row_id").join(large, "doc_id", "left_semi").select("row_id"), "wanted")
        # rows that share an id are told apart by the hashes of their sets
        sets = _tokens_of(docs, wanted, j).join(reps.select("doc_id", "row_id", "k1", "k2"), ["row_id", "k1", "k2"])
        children = sets.select("doc_id", "tokens").join(paths, "doc_id").mapInArrow(run, schema)
        parents = store.put(large.select(F.col("path").alias("parent"), F.col("n").alias("parent_n")).distinct(), "parents")
        rows = store.put(children.distinct().join(parents, "parent").select("doc_id", "path", "parent_n", F.lit(None).cast("int").alias("least")), "buckets")
    return out


def similar_groups(docs: DataFrame, j: Join = Join(), text: str = "text", key: str = "doc_id", keep: list[str] | None = None) -> DataFrame:
    """One row per input row: doc_id, class_id (least doc_id of its group: documents connected by links), copy_id (least
    doc_id of those with an equal token set), n_links (other rows of similarity ``threshold`` or more), n_tokens, and the columns
    named in ``keep``.

    Words are runs of bytes other than space and tab to carriage return, taken unchanged. A text of fewer words than a
    token is one token of all its words; a null, empty or blank text has none, links with nothing and is its own class.
    Repeated rows are copies of each other; rows that share a key but differ in their sets are documents of their own. A row
    without a key takes part under a number of 2**62 or more made from its text, and so does a set whose least key is that of
    another set too, all but one. Such a number names a class only if none of its sets has a key of its own. An empty table gives
    an empty result. Other columns are ignored.
    """
    keep = keep or []
    store = Store(docs.sparkSession, "chosen-path")
    own = F.col(key).cast("long")
    made = F.lit(1 << 62) + F.xxhash64(F.coalesce(F.col(text), F.lit(""))).bitwiseAND(F.lit((1 << 62) - 1))
    kept = docs.select(own.alias("key"), *(F.col(f"`{k}`").alias(f"keep_{i}") for i, k in enumerate(keep)))
    run, schema = _signatures(j, ", ".join(f"{c} {kind}" for c, kind in kept.dtypes))
    rows = docs.select(F.coalesce(own, made).alias("row_id"), F.col(text).alias("text"), own.alias("key"), *(F.col(f"`{k}`").alias(f"keep_{i}") for i, k in enumerate(keep)))
    signatures = store.put(rows.mapInArrow(run, schema), "signatures")
    same = ["k1", "k2", "size"]
    classes = store.put(signatures.where("size > 0").groupBy(*same).agg(F.min("row_id").alias("row_id"), F.count("*").alias("weight")), "classes")
    # an id names one set; the others that it is the least id of go by numbers of their own
    shared = classes.groupBy("row_id").agg(F.min(F.struct(*same)).alias("named"), F.count("*").alias("sets")).where("sets > 1").drop("sets")
    shared = store.put(shared, "shared-ids")
    other = F.lit(1 << 62) + F.xxhash64("row_id", *same).bitwiseAND(F.lit((1 << 62) - 1))
    classes = classes.join(shared, "row_id", "left").withColumn("doc_id", F.when(F.col("named") != F.struct(*same), other).otherwise(F.col("row_id"))).drop("named")
    classes = store.put(classes, "named-classes")
    # one set of each class, by its least document
    reps = signatures.join(classes, ["row_id", *same])
    reps = store.put(reps.dropDuplicates(["row_id", *same]), "representatives")

    leaves = _leaves(rows, reps, j, store)
    cells = _in_cells(_blocked(leaves.join(reps.select("doc_id", "sketch"), "doc_id"), max(j.block, j.bucket)).select("group", "x", "y", "side", "doc_id", "sketch"))
    run, schema = _candidates(j)
    families = store.put(connected_components(cells.mapInArrow(run, schema), store), "families")

    sizes = store.put(families.groupBy("root").agg(F.count("*").alias("n")), "family-sizes")
    members = families.join(sizes, "root").select(F.col("root").alias("group"), F.col("node").alias("doc_id"), "n")
    members = store.put(members.join(reps.select("doc_id", "row_id", "weight", "k1", "k2"), "doc_id"), "members")
    members = members.join(_tokens_of(rows, members, j), ["row_id", "k1", "k2"]).dropDuplicates(["row_id", "k1", "k2"])
    run, schema = _verify(j)
    cells = _in_cells(_blocked(members, j.block).select("group", "x", "y", "side", "doc_id", "weight", "tokens"))
    found = store.put(cells.mapInArrow(run, schema), "links")
    links = found.where("b is null").groupBy("a").agg(F.sum("n").alias("links")).withColumnRenamed("a", "copy_id")
    groups = connected_components(found.where("b is not null").select("a", "b"), store).toDF("copy_id", "root")

    verdicts = classes.withColumnRenamed("doc_id", "copy_id").join(links, "copy_id", "left").join(groups, "copy_id", "left")
    verdicts = verdicts.select(*same, "copy_id", F.coalesce("root", "copy_id").alias("class_id"), (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"))
    verdicts = store.put(verdicts, "verdicts")
    out = signatures.select("row_id", *same, "key", *(f"keep_{i}" for i in range(len(keep)))).join(verdicts, same, "left")
    cols = [F.coalesce("class_id", "row_id").alias("class_id"), F.coalesce("copy_id", "row_id").alias("copy_id"), F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), F.col("size").cast("long").alias("n_tokens")]
    return out.select(F.col("key").alias("doc_id"), *cols, *(F.col(f"keep_{i}").alias(k) for i, k in enumerate(keep)))
