"""Mixing sources to target weights.

Each source's target in words is fixed by weight. A source is cut into blocks of words; its quota of blocks is exact:
as many whole passes as the target holds, and of one more pass as many blocks, in a random order fixed by hashes, as
reach the rest, the last one cut to size. The quotas of all sources are parted among the output shards by a splitting
tree: a node's blocks go to its two halves by a multivariate hypergeometric draw, so every shard's blocks are a
uniform draw from the whole mix and the shards' quotas add up to the sources'. A shard then takes its range of each
source's permuted blocks, disjoint from all others', and orders them by a hash of its own.

Ranks in a source's order are found without gathering a source (``ranked``): blocks fall into buckets by the upper bits of their
hash, and only those of one bucket are ordered together. Buckets and blocks in a bucket both grow with the square
root of the input.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._store import Store

SPACES = r"[ \t-\r]+"


@dataclass(frozen=True)
class Mix:
    """``weights`` repeat over the sources in order of name (null last); the mix has ``share`` times the words of the input
    and a source at most ``most`` times its own. ``block``: words. The output has ``shards`` shards at least, and more where one would
    hold over ``shard_blocks`` blocks. Up to ``listed`` sources are planned at the driver, more in Spark, alike. The tree makes at most
    ``cells`` numbers, a shard and source each; where that is too few it parts groups of sources, each in one random order."""

    weights: Sequence[float] = (5, 2, 1)
    share: float = 1.5
    most: float = 2.0
    block: int = 512
    shards: int = 64
    shard_blocks: int = 1 << 16
    seed: int = 1
    listed: int = 10_000
    cells: int = 4_000_000


def targets(sizes: Sequence[int], m: Mix) -> list[float]:
    """Words wanted of each source, in order: by weight, none above ``most`` times its size, the excess shared again."""
    n = len(sizes)
    weight = [m.weights[i % len(m.weights)] for i in range(n)]
    out, open_ = [0.0] * n, list(range(n))
    left = m.share * sum(sizes)
    while open_:
        total = sum(weight[i] for i in open_)
        for i in open_:
            out[i] = left * weight[i] / total
        full = [i for i in open_ if out[i] > m.most * sizes[i]]
        if not full:
            break
        for i in full:
            out[i] = float(m.most * sizes[i])
            left -= out[i]
        closed = set(full)
        open_ = [i for i in open_ if i not in closed]
    return out


def split_tree(quotas: Sequence[int], shards: int, seed: int) -> np.ndarray:
    """(shards, sources): how many blocks of each source each shard gets; columns add up to ``quotas``.

    A node of k shards keeps floor(k / 2) / k of its blocks on the left, drawn without replacement from its sources.
    """
    out = np.zeros((shards, len(quotas)), np.int64)

    def part(lo: int, hi: int, have: np.ndarray) -> None:
        if hi - lo == 1:
            out[lo] = have
            return
        mid = (lo + hi) // 2
        draw = int(have.sum()) * (mid - lo) // (hi - lo)
        rng = np.random.default_rng([seed, lo, hi])
        left = _hypergeometric(rng, have, draw)
        part(lo, mid, left)
        part(mid, hi, have - left)

    part(0, shards, np.asarray(quotas, np.int64))
    return out


def _hypergeometric(rng: np.random.Generator, have: np.ndarray, draw: int) -> np.ndarray:
    """Source after source, given what is left."""
    left, rest = np.zeros_like(have), int(have.sum())
    for i, n in enumerate(have.tolist()):
        others = rest - n
        left[i] = k = _drawn_of(rng, n, others, draw)
        draw -= k
        rest = others
    return left


def _drawn_of(rng: np.random.Generator, n: int, others: int, draw: int) -> int:
    """How many of ``n`` are among ``draw`` of ``n + others``. numpy's own draw holds for populations below 10**9. Beyond, the distribution
    is inverted: its terms follow from each other around the mode, as far as twelve standard deviations to either side, and what lies
    beyond is far below the precision of a double."""
    if not draw or not n:
        return 0
    low, high = max(0, draw - others), min(n, draw)
    if low == high:
        return low
    if n + others < 10**9:
        return int(rng.hypergeometric(n, others, draw))
    total = n + others
    mode = min(high, max(low, (draw + 1) * (n + 1) // (total + 2)))
    sd = math.sqrt(max(1.0, draw * (n / total) * (others / total) * ((total - draw) / (total - 1))))
    low, high = max(low, mode - int(12 * sd) - 12), min(high, mode + int(12 * sd) + 12)
    k = np.arange(low, high, dtype=float)
    # log of P(k + 1) / P(k)
    ratio = np.log(n - k) + np.log(draw - k) - np.log(k + 1) - np.log(others - draw + k + 1)
    logs = np.concatenate([[0.0], np.cumsum(ratio)])
    mass = np.cumsum(np.exp(logs - logs.max()))
    return low + int(np.searchsorted(mass, rng.random() * mass[-1], side="right"))


def n_words(text: Column) -> Column:
    return F.size(F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACES), "")).cast("long")


def ranked(rows: DataFrame, group: str, hash: str, total: int, sums: Sequence[str], ties: Sequence[str]) -> DataFrame:
    """``rows`` with ``rank``, from 0, in the order of ``hash`` within each group, and the sums of the named columns before each row.

    Rows fall into buckets by the upper bits of the hash; bucket sums are added up, and only the rows of one bucket are ordered together.
    """
    bits = max(1, math.ceil(math.log2(total + 1) / 2))
    cut = rows.withColumn("_bucket", F.shiftrightunsigned(hash, 64 - bits))
    by = cut.groupBy(group, "_bucket").agg(F.count("*").alias("_n"), *(F.sum(c).alias(f"_sum_{c}") for c in sums))
    ahead = Window.partitionBy(group).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    by = by.select(group, "_bucket", *(F.coalesce(F.sum(c).over(ahead), F.lit(0)).alias(f"{c}_0") for c in ("_n", *(f"_sum_{c}" for c in sums))))
    inside = Window.partitionBy(group, "_bucket").orderBy(hash, *ties)
    so_far = inside.rowsBetween(Window.unboundedPreceding, 0)
    cut = cut.withColumns({"rank": F.row_number().over(inside) - 1} | {f"{c}_before": F.sum(c).over(so_far) - F.col(c) for c in sums})
    cut = cut.join(by, [group, "_bucket"])
    cut = cut.withColumns({"rank": F.col("rank") + F.col("_n_0")} | {f"{c}_before": F.col(f"{c}_before") + F.col(f"_sum_{c}_0") for c in sums})
    return cut.drop("_bucket", "_n_0", *(f"_sum_{c}_0" for c in sums))


def _numbered(rows: DataFrame, store: Store) -> DataFrame:
    """``rows`` (row, doc_id, x1, x2, ...) with ``copy``: the number, from 0, of a row among those equal to it.

    Equal rows are counted by input partition (the upper bits of ``row``), so none of them need meet in one task.
    """
    same = ["_none", "_id", "x1", "x2"]
    rows = rows.withColumns({"_none": F.col("doc_id").isNull(), "_id": F.coalesce("doc_id", F.lit(0)), "_part": F.shiftrightunsigned("row", 33)})
    parts = store.put(rows.groupBy(*same, "_part").agg(F.count("*").alias("n")), "parts")
    many = store.put(parts.groupBy(*same).agg(F.sum("n").alias("c")).where("c > 1").select(*same), "repeats")
    ahead = Window.partitionBy(*same).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.join(many, same).withColumn("before", F.coalesce(F.sum("n").over(ahead), F.lit(0))).select(*same, "_part", "before")
    again = rows.join(store.put(parts, "before"), [*same, "_part"])
    again = again.withColumn("copy", F.col("before") + F.row_number().over(Window.partitionBy(*same, "_part").orderBy("row")) - 1).drop("before")
    once = rows.join(many, same, "left_anti").withColumn("copy", F.lit(0).cast("long"))
    return once.unionByName(again).drop("_none", "_id", "_part")


def _planned(stats: DataFrame, m: Mix, store: Store) -> DataFrame:
    """(source, s, source_size, blocks, target): the sources in order and their targets, found without listing them.

    A source ends at the level, in words for each unit of weight, that all open sources share, or at its own bound; the level rises until
    no open source is above its bound, so a round needs two sums over the sources.
    """
    spread = stats.repartitionByRange(F.col("source").isNull(), "source").sortWithinPartitions(F.col("source").isNull(), "source")
    spread = store.put(spread.withColumn("_row", F.monotonically_increasing_id()), "sources").withColumn("_part", F.shiftrightunsigned("_row", 33))
    # a number for each partition
    sizes = {r["_part"]: r.n for r in spread.groupBy("_part").agg(F.count("*").alias("n")).collect()}
    first, at = {}, 0
    for part in sorted(sizes):
        first[part] = at
        at += sizes[part]
    starts = store.spark.createDataFrame(sorted(first.items()), "_part long, start long")
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in m.weights)), (F.col("s") % len(m.weights) + 1).cast("int"))
    named = spread.join(F.broadcast(starts), "_part").withColumn("s", F.col("start") + F.col("_row").bitwiseAND(F.lit((1 << 33) - 1)))
    named = store.put(named.select("source", "s", "size", "blocks", weight.alias("w")), "ranked-sources")
    bound = F.col("size") * float(m.most)
    want = m.share * (named.agg(F.sum("size")).first()[0] or 0)
    level, full = 0.0, -1
    while True:
        closed = bound < level * F.col("w")
        got = named.agg(F.coalesce(F.sum(F.when(closed, bound)), F.lit(0.0)).alias("mass"), F.coalesce(F.sum(F.when(~closed, F.col("w"))), F.lit(0.0)).alias("w"), F.count_if(closed).alias("n")).first()
        if got.n == full or not got.w:
            break
        full, level = got.n, (want - got.mass) / got.w
    return named.select("source", "s", F.col("size").alias("source_size"), "blocks", F.least(bound, level * F.col("w")).alias("target"))


class Mixture:
    """``documents``: (row, doc_id, source, size, source_size, target); ``draws``: (shard, place, row, doc_id, x1, x2, source, pass_, first,
    words), where a draw is ``words`` words of a document from word ``first``, ``place`` orders a shard, and x1 and x2 are hashes
    of the text.

    Null and empty texts have no words and are never drawn. A null source is a source. Repeated rows, and rows that share a doc_id or have
    none, are documents of their own. Order goes by hashes of doc_id, text and number of the copy, so the mix does not depend on how the
    input is parted. An empty table gives empty results. Other columns are ignored.
    """

    def __init__(self, docs: DataFrame, mix: Mix = Mix(), text: str = "text", source: str = "source", key: str = "doc_id"):
        spark = docs.sparkSession
        store = Store(spark, "mix")
        rows = _texts(docs, text, key, source).select("doc_id", "source", n_words(F.col("text")).alias("size"), "x1", "x2")
        # small: sizes, no texts; written once, which also fixes the row numbers
        rows = store.put(rows.withColumn("row", F.monotonically_increasing_id()), "sizes")
        rows = _numbered(rows, store)
        stats = rows.groupBy("source").agg(F.sum("size").alias("size"), F.sum(F.ceil(F.col("size") / mix.block)).cast("long").alias("blocks"))
        stats = store.put(stats, "sources")
        n, total = stats.agg(F.count("*"), F.coalesce(F.sum("blocks"), F.lit(0))).first()
        if n <= mix.listed:
            sources = sorted(stats.collect(), key=lambda r: (r.source is None, r.source or ""))
            want = targets([r["size"] for r in sources], mix)
            plan = spark.createDataFrame([(r.source, i, r["size"], r.blocks, t) for i, (r, t) in enumerate(zip(sources, want, strict=True))], "source string, s long, source_size long, blocks long, target double")
        else:
            plan = _planned(stats, mix, store)
        passes = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("int")
        rest = F.round(F.col("target") - F.col("passes") * F.col("source_size")).cast("long")
        plan = plan.withColumn("passes", passes).withColumn("rest", rest)
        named = rows.withColumnRenamed("source", "name")
        # at most ``listed`` rows of a few numbers; more are joined as they are written
        plan = F.broadcast(plan) if n <= mix.listed else store.put(plan, "plan")
        named = named.join(plan, F.col("name").eqNullSafe(F.col("source"))).drop("name")
        self.documents = named.select("row", "doc_id", "source", "size", "source_size", "target")

        number = F.sequence(F.lit(0), F.ceil(F.col("size") / mix.block).cast("int") - 1)
        cut = named.where("size > 0").select("row", "doc_id", "x1", "x2", "copy", "source", "s", "size", "passes", "rest", F.col("blocks").alias("in_source"), F.explode(number).alias("no"))
        cut = cut.withColumn("first", F.col("no").cast("long") * mix.block).withColumn("words", F.least(F.lit(mix.block).cast("long"), F.col("size") - F.col("first")))
        # one order a source for all its passes: the place in a shard mixes passes anew
        cut = cut.withColumn("hash", F.xxhash64(F.lit(mix.seed), "doc_id", "x1", "x2", "copy", "no"))
        order = ranked(cut, "s", "hash", total, ["words"], ["size", "x1", "first", "copy"])
        # whole passes take every block; the last pass takes them until ``rest`` words are full
        part = F.greatest(F.lit(0), F.least("words", F.col("rest") - F.col("words_before")))
        none = F.array().cast("array<struct<pass_:int,words:bigint>>")
        drawn = order.select(
            "row", "doc_id", "x1", "x2", "copy", "source", "s", "first", "rank", "in_source",
            F.explode(F.concat(
                F.when(F.col("passes") > 0, F.transform(F.sequence(F.lit(0), F.col("passes") - 1), lambda p: F.struct(p.alias("pass_"), F.col("words").alias("words")))).otherwise(none),
                F.when(part > 0, F.array(F.struct(F.col("passes").alias("pass_"), part.cast("long").alias("words")))).otherwise(none),
            )).alias("d"),
        ).select("row", "doc_id", "x1", "x2", "copy", "source", "s", "first", "d.*", (F.col("in_source") * F.col("d.pass_") + F.col("rank")).alias("turn"))
        self.shards = max(mix.shards, math.ceil(mix.share * total / mix.shard_blocks))
        groups = max(1, mix.cells // self.shards)
        if n > groups:
            # a group's blocks in one random order: a shard's range of it is a draw from its sources as the tree would make it
            drawn = store.put(drawn.drop("turn"), "ungrouped")
            drawn = drawn.withColumn("g", F.pmod(F.xxhash64(F.lit(mix.seed + 1), "s"), F.lit(groups)).cast("long")).withColumn("hash", F.xxhash64(F.lit(mix.seed + 2), "s", "doc_id", "x1", "x2", "copy", "first", "pass_"))
            drawn = ranked(drawn, "g", "hash", 2 * total, [], ["x1", "first", "copy"]).drop("hash").withColumnRenamed("rank", "turn")
        else:
            drawn = drawn.withColumn("g", F.col("s"))
        self._store, self._mix = store, mix
        self._drawn = store.put(drawn, "drawn")
        # a number for each source or group
        quotas = {r.g: r.n for r in self._drawn.groupBy("g").agg(F.count("*").alias("n")).collect()}
        self._groups = sorted(quotas)
        self.shares = split_tree([quotas[g] for g in self._groups], self.shards, mix.seed)

    @property
    def draws(self) -> DataFrame:
        # of each source or group, the turn at which each shard's range ends
        sent = self._store.spark.sparkContext.broadcast({g: np.cumsum(self.shares[:, i]) for i, g in enumerate(self._groups)})
        cols = ["row", "doc_id", "x1", "x2", "copy", "source", "first", "pass_", "words"]

        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                g, turn = batch.column(0).to_numpy(), batch.column(1).to_numpy()
                shard = np.zeros(len(g), np.int32)
                for i in np.unique(g):
                    mine = g == i
                    shard[mine] = np.searchsorted(sent.value[int(i)], turn[mine], side="right")
                yield pa.RecordBatch.from_arrays([pa.array(shard), *batch.columns[2:]], names=["shard", *batch.schema.names[2:]])

        rows = self._drawn.select("g", "turn", *cols)
        out = rows.mapInArrow(run, "shard int, " + ", ".join(f"{c} {dict(rows.dtypes)[c]}" for c in cols))
        return out.withColumn("place", F.xxhash64(F.lit(self._mix.seed), "shard", "doc_id", "x1", "x2", "copy", "first", "pass_"))

    def taken(self) -> DataFrame:
        """One row per input row: doc_id, size, source, source_size, target, taken (words the mix takes, repeats counted), n_draws and
        n_shards (its blocks in the mix and the shards that hold them)."""
        took = self.draws.groupBy("row").agg(F.sum("words").alias("taken"), F.count("*").alias("n_draws"), F.size(F.collect_set("shard")).alias("n_shards"))
        none = F.lit(0)
        counts = [F.coalesce("taken", none.cast("long")).alias("taken"), F.coalesce("n_draws", none.cast("long")).alias("n_draws"), F.coalesce("n_shards", none).alias("n_shards")]
        return self.documents.join(took, "row", "left").select("doc_id", "size", "source", "source_size", "target", *counts)

    def blocks(self, docs: DataFrame, text: str = "text", source: str = "source", key: str = "doc_id") -> DataFrame:
        """The mix itself, from the table it was planned on: (shard, place, doc_id, source, pass_, first, words, text: the block's words
        joined by one space). A shard is read in the order of ``place``."""
        same = ["_none", "_id", "x1", "x2"]
        marks = {"_none": F.col("doc_id").isNull(), "_id": F.coalesce("doc_id", F.lit(0))}
        # a text is split once for all its blocks; equal texts are one
        each = self.draws.groupBy("row", "doc_id", "x1", "x2", "source").agg(F.collect_list(F.struct("shard", "place", "pass_", "first", "words")).alias("d"))
        texts = _texts(docs, text, key, source).withColumns(marks).where("text <> ''").groupBy(*same).agg(F.first("text").alias("text"))
        each = self._store.put(each.withColumns(marks), "by-document")
        joined = each.join(self._store.put(texts, "texts"), same).withColumn("_w", F.array_remove(F.split("text", SPACES), ""))
        out = joined.select("doc_id", "source", "_w", F.explode("d").alias("d"))
        body = F.array_join(F.slice("_w", F.col("d.first").cast("int") + 1, F.col("d.words").cast("int")), " ")
        return out.select("d.shard", "d.place", "doc_id", "source", "d.pass_", "d.first", "d.words", body.alias("text"))

    def write(self, docs: DataFrame, path: str, text: str = "text", source: str = "source", key: str = "doc_id") -> None:
        """The mix as Parquet, a folder a shard, each in its own order."""
        d = self.blocks(docs, text, source, key)
        d.repartition(self.shards, "shard").sortWithinPartitions("shard", "place").write.partitionBy("shard").parquet(path)


def _texts(docs: DataFrame, text: str, key: str, source: str) -> DataFrame:
    t = F.coalesce(F.col(text), F.lit(""))
    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col(source).cast("string").alias("source"), t.alias("text"), F.xxhash64(t).alias("x1"), F.xxhash64(F.lit(1), t).alias("x2"))
