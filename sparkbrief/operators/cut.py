"""Where a session can be cut: the live span, the last N user turns, a token budget, a growing tail.

All rules are windows and sums by session. A cut is the index, among a session's live messages, of the first one kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import tokens
from ..schema import Compact
from .messages import sizes


def live_entries(blocks: DataFrame) -> DataFrame:
    """(session_id, first_seq, orphan): from which ``seq`` on messages are live. Only sessions with a compaction are listed.

    The last compaction's kept entry opens the span; if it is missing, the span starts after the compaction.
    """
    last = blocks.where("kind = 'compaction'").groupBy("session_id").agg(F.max("seq").alias("at"), F.max_by("first_kept_id", "seq").alias("entry_id"))
    found = last.where("entry_id <> ''").join(blocks.select("session_id", "entry_id", "seq"), ["session_id", "entry_id"]).groupBy("session_id").agg(F.min("seq").alias("kept_seq"))
    return last.join(found, "session_id", "left").select("session_id", F.coalesce("kept_seq", F.col("at") + 1).alias("first_seq"), F.col("kept_seq").isNull().alias("orphan"))


def live_blocks(blocks: DataFrame) -> DataFrame:
    """The blocks of live messages."""
    d = blocks.where("kind = 'message'").join(live_entries(blocks), "session_id", "left")
    return d.where("first_seq is null or seq >= first_seq").drop("first_seq", "orphan")


def numbered(blocks: DataFrame, c: Compact = Compact()) -> DataFrame:
    """Live messages with their index, the sums from each to the end, and of user turns the count from the end."""
    here = Window.partitionBy("session_id").orderBy("seq")
    back = Window.partitionBy("session_id").orderBy(F.desc("seq")).rowsBetween(Window.unboundedPreceding, 0)
    user = F.col("role") == "user"
    d = sizes(live_blocks(blocks)).withColumn("idx", F.row_number().over(here) - 1).withColumn("tokens", tokens(F.col("bytes"), c.chars_per_token))
    return d.withColumn("bytes_to_end", F.sum("bytes").over(back)).withColumn("tokens_to_end", F.sum("tokens").over(back)).withColumn("turn", F.when(user, F.sum(user.cast("int")).over(back)))


def _at(condition: Column, value: str = "idx") -> Column:
    return F.min(F.when(condition, F.col(value)))


def cuts(blocks: DataFrame, c: Compact = Compact(), live: DataFrame | None = None) -> DataFrame:
    """One row a session with live messages: keep (turns kept), grown, cut (index of the first message kept; null if all are
    compacted, or if there is no safe cut), compact_all, reason (of a cut by budget) and possible. ``live``: ``numbered``, if at hand.
    """
    d = numbered(blocks, c) if live is None else live
    explicit = c.keep is not None
    # the budget's place is found first, then the next message that is no tool result
    budget = d.groupBy("session_id").agg(
        F.count("*").alias("n"),
        F.max("turn").alias("users"),
        F.coalesce(F.max(F.when(F.col("tokens_to_end") >= c.max_tail, F.greatest("idx", F.lit(1)))), F.lit(1)).alias("from"),
        F.coalesce(F.max(F.when((F.col("turn") == 1) & (tokens(F.col("bytes_to_end"), c.chars_per_token) <= c.min_tail), 1)), F.lit(0)).alias("small"),
        F.max(F.when((F.col("idx") > 0) & (tokens(F.col("bytes_to_end"), c.chars_per_token) <= c.max_tail), F.col("turn"))).alias("most"),
    )
    d = d.join(budget, "session_id").withColumn("users", F.coalesce("users", F.lit(0)))
    grow = c.smart and not explicit
    grown = F.when((F.col("users") >= 2) & (F.col("small") == 1), F.greatest(F.lit(1), F.least(F.col("most"), F.col("users") - 1))).otherwise(1)
    d = d.withColumn("keep", grown.cast("int") if grow else F.lit(c.keep if explicit else 1))
    s = d.groupBy("session_id").agg(
        F.first("n").alias("n"), F.first("users").alias("users"), F.first("keep").alias("keep"),
        _at((F.col("idx") >= F.col("from")) & (F.col("role") != "toolResult")).alias("budget"),
        _at(F.col("turn") == F.col("keep")).alias("turn_at"),
    )
    all_ = (F.col("keep") == 0) | ((F.col("users") >= 2) & ((F.col("keep") == F.col("users")) | (F.col("turn_at") == 0)))
    split = (F.col("keep") > 0) & (F.col("users") < 2)
    cut = F.when(all_, F.lit(None)).when(split, F.when(F.col("n") >= 4, F.col("budget"))).otherwise(F.col("turn_at"))
    s = s.withColumn("all_", all_).withColumn("cut0", cut).withColumn("possible", all_ | cut.isNotNull())
    if explicit:
        return s.select("session_id", "n", "users", "keep", F.lit(False).alias("grown"), F.col("cut0").alias("cut"), F.col("all_").alias("compact_all"), F.lit(None).cast("string").alias("reason"), "possible")
    tail = d.select("session_id", "idx", "tokens_to_end").withColumnRenamed("idx", "cut0")
    s = s.join(tail, ["session_id", "cut0"], "left")
    no_anchor = F.col("all_") & F.col("budget").isNotNull()
    oversized = ~F.col("all_") & (F.col("tokens_to_end") > c.max_tail * c.oversized) & (F.col("budget") > F.col("cut0"))
    reason = F.when(no_anchor, "no_anchor").when(oversized, "oversized_tail")
    return s.select("session_id", "n", "users", "keep", (F.col("keep") != 1).alias("grown"), F.when(reason.isNotNull(), F.col("budget")).otherwise(F.col("cut0")).alias("cut"), (F.col("all_") & ~no_anchor).alias("compact_all"), reason.alias("reason"), "possible")


def split_at(blocks: DataFrame, c: Compact = Compact(), live: DataFrame | None = None, at: DataFrame | None = None) -> DataFrame:
    """Live blocks with ``idx`` and ``kept``: false for those that the brief replaces. Sessions without a safe cut keep all."""
    live = numbered(blocks, c) if live is None else live
    at = cuts(blocks, c, live) if at is None else at
    d = live.select("session_id", "seq", "idx").join(at.select("session_id", "cut", "compact_all"), "session_id")
    d = d.withColumn("kept", ~F.col("compact_all") & F.coalesce(F.col("idx") >= F.col("cut"), F.lit(True))).drop("cut", "compact_all")
    return blocks.where("kind = 'message'").join(d, ["session_id", "seq"])


def clean_cut(blocks: DataFrame, at: DataFrame) -> DataFrame:
    """``at`` (session_id, kept_seq) with ``clean_seq``: the first user entry from there on that carries no tool result; else -1."""
    e = blocks.where("kind = 'message'").groupBy("session_id", "seq").agg(F.first("role").alias("role"), F.max((F.col("type") == "toolResult").cast("int")).alias("has"))
    good = e.where("role = 'user' and has = 0").select("session_id", "seq")
    j = at.join(good, "session_id", "left").groupBy("session_id", "kept_seq").agg(F.min(F.when(F.col("seq") >= F.col("kept_seq"), F.col("seq"))).alias("s"))
    return j.select("session_id", "kept_seq", F.coalesce("s", F.lit(-1)).alias("clean_seq"))
