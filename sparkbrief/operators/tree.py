"""Parent links: lineage, active branch, and checks of the whole forest.

Paths are found by pointer doubling: each round doubles how far every entry sees, so a path of n entries takes log2 n joins
and no session is gathered in one task. Every round is written, since the next reads it twice. Cycles show as entries that still see an ancestor after enough rounds.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..plans.shared import written

KEY = ["session_id", "entry_id"]


def nodes(blocks: DataFrame) -> DataFrame:
    """(session_id, entry_id, seq, parent_id): one row an entry, the first of those that share an id."""
    d = blocks.groupBy(*KEY).agg(F.min("seq").alias("seq"), F.min_by("parent_id", "seq").alias("parent_id"))
    return d.withColumn("parent_id", F.nullif("parent_id", F.lit("")))


def duplicates(blocks: DataFrame) -> DataFrame:
    """(session_id, entry_id, n) of ids that several entries have."""
    return blocks.select(*KEY, "seq").distinct().groupBy(*KEY).agg(F.count("*").alias("n")).where("n > 1")


def missing_parents(blocks: DataFrame) -> DataFrame:
    """Entries whose parent is not in their session."""
    n = nodes(blocks)
    return n.where("parent_id is not null").join(n.select("session_id", F.col("entry_id").alias("parent_id")), ["session_id", "parent_id"], "left_anti").select(*KEY, "parent_id")


def orphans_to_roots(n: DataFrame) -> DataFrame:
    """Nodes with unknown parents taken away."""
    known = n.select("session_id", F.col("entry_id").alias("parent_id"), F.lit(True).alias("known"))
    return n.join(known, ["session_id", "parent_id"], "left").withColumn("parent_id", F.when(F.col("known"), F.col("parent_id"))).drop("known").select(*KEY, "seq", "parent_id")


def _rounds(n: DataFrame) -> int:
    most = n.groupBy("session_id").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0]
    return max(1, math.ceil(math.log2((most or 0) + 1)))


def in_cycles(blocks: DataFrame) -> DataFrame:
    """(session_id, entry_id) of entries whose path up never ends."""
    n = written(orphans_to_roots(nodes(blocks)), "nodes")
    up = n.where("parent_id is not null").select(*KEY, F.col("parent_id").alias("far"))
    for _ in range(_rounds(n)):
        up = written(up.join(up.select("session_id", F.col("entry_id").alias("far"), F.col("far").alias("farther")), ["session_id", "far"]).select(*KEY, F.col("farther").alias("far")), "up")
        if up.isEmpty():
            break
    return up.select(*KEY)


def cut_reanchored(n: DataFrame) -> DataFrame:
    """Nodes (session_id, entry_id, seq, parent_id, logical) without the logical links that lead back to their own start: of each cycle the
    first such link is taken away. Cycles of other links stay, for ``check`` to find.

    By doubling: far enough up, an entry that never reaches a root stands on its cycle, and the least logical link that it has passed on
    the way round is the one to cut.
    """
    n = written(n.select(*KEY, "seq", "parent_id", "logical"), "linked")
    if n.where("logical").isEmpty():
        return n
    known = n.select("session_id", F.col("entry_id").alias("parent_id"))
    up = n.join(known, ["session_id", "parent_id"], "left_semi").select(*KEY, F.col("parent_id").alias("far"), F.when(F.col("logical"), F.col("seq")).alias("least"))
    for _ in range(_rounds(n)):
        more = up.select("session_id", F.col("entry_id").alias("far"), F.col("far").alias("farther"), F.col("least").alias("then"))
        up = written(up.join(more, ["session_id", "far"]).select(*KEY, F.col("farther").alias("far"), F.least("least", "then").alias("least")), "up")
        if up.isEmpty():
            return n
    round_ = up.select("session_id", F.col("far").alias("entry_id")).distinct()
    cut = up.join(round_, KEY, "left_semi").select(*KEY, "least")
    out = n.join(cut, KEY, "left")
    return out.withColumn("parent_id", F.when(~(F.col("logical") & (F.coalesce("least", F.lit(-1)) == F.col("seq"))), F.col("parent_id"))).drop("least")


def depths(blocks: DataFrame) -> DataFrame:
    """(session_id, entry_id, seq, depth, root): entries on the way up; those in or above cycles are left out."""
    n = written(orphans_to_roots(nodes(blocks)), "nodes")
    d = n.select(*KEY, "seq", F.col("parent_id").alias("far"), F.when(F.col("parent_id").isNull(), 0).otherwise(1).alias("depth"), F.coalesce("parent_id", "entry_id").alias("root"))
    for _ in range(_rounds(n)):
        o = d.select("session_id", F.col("entry_id").alias("far"), F.col("far").alias("f2"), F.col("depth").alias("d2"), F.col("root").alias("r2"))
        d = written(d.join(o, ["session_id", "far"], "left").select(*KEY, "seq", F.col("f2").alias("far"), (F.col("depth") + F.coalesce("d2", F.lit(0))).alias("depth"), F.coalesce("r2", "root").alias("root")), "depths")
    return d.where("far is null").drop("far")


def lineage(blocks: DataFrame, leaves: DataFrame | None = None) -> DataFrame:
    """(session_id, entry_id, seq, pos): the entries from root to leaf, numbered from 0.

    ``leaves`` (session_id, entry_id): one a session, the last entry if not given. A path that meets a missing parent or a cycle is an
    error of ``check``; here it ends there. By doubling: who is reached in 2**k steps from a leaf reaches on.
    """
    n = written(orphans_to_roots(nodes(blocks)), "nodes")
    leaves = n.groupBy("session_id").agg(F.max_by("entry_id", "seq").alias("entry_id")) if leaves is None else leaves.select(*KEY)
    jump = n.where("parent_id is not null").select(*KEY, F.col("parent_id").alias("far"))
    # of those reached, how many steps from the leaf
    reached = leaves.join(n.select(*KEY), KEY, "left_semi").withColumn("steps", F.lit(0))
    for k in range(_rounds(n)):
        more = reached.join(jump, KEY).select("session_id", F.col("far").alias("entry_id"), (F.col("steps") + 2**k).alias("steps"))
        reached = written(reached.unionByName(more).groupBy(*KEY).agg(F.min("steps").alias("steps")), "reached")
        jump = written(jump.join(jump.select("session_id", F.col("entry_id").alias("far"), F.col("far").alias("f2")), ["session_id", "far"]).select(*KEY, F.col("f2").alias("far")), "jump")
        if jump.isEmpty():
            break
    path = n.join(reached, KEY)
    return path.withColumn("pos", F.row_number().over(Window.partitionBy("session_id").orderBy(F.desc("steps"))) - 1).select(*KEY, "seq", "pos")


def active_branch(blocks: DataFrame) -> DataFrame:
    """As lineage from the last entry, where an entry without a parent in its session takes the entry before it."""
    n = orphans_to_roots(nodes(blocks))
    w = Window.partitionBy("session_id").orderBy("seq")
    linked = n.withColumn("parent_id", F.coalesce("parent_id", F.lag("entry_id").over(w)))
    return lineage(linked.withColumn("kind", F.lit("message")))


def check(blocks: DataFrame) -> None:
    """Raise for repeated ids, missing parents and cycles. Runs jobs."""
    for what, bad in (("duplicate entry id", duplicates(blocks)), ("missing parent", missing_parents(blocks)), ("cycle", in_cycles(blocks))):
        if row := bad.select(*KEY).first():
            raise ValueError(f"{what}: {row.entry_id} in session {row.session_id}")


def tool_names(blocks: DataFrame) -> DataFrame:
    """Tool results named by the latest earlier call of the same id; (session_id, seq, block_ix, call_id, tool_name), empty if there is none."""
    d = blocks.where("kind = 'message' and type in ('toolCall', 'toolResult') and coalesce(call_id, '') <> ''")
    before = Window.partitionBy("session_id", "call_id").orderBy("seq", "block_ix").rowsBetween(Window.unboundedPreceding, -1)
    name = F.last(F.when(F.col("type") == "toolCall", F.col("tool_name")), ignorenulls=True).over(before)
    return d.withColumn("named", name).where("type = 'toolResult'").select("session_id", "seq", "block_ix", "call_id", F.coalesce("named", F.lit("")).alias("tool_name"))
