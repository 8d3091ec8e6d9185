"""Compaction of many sessions in one plan: live span, cut, sections, merge, transcript, brief and token accounts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import block_size, tokens
from ..operators import brief, cut, sections
from ..schema import Compact, Transcript
from .shared import written


def previous_briefs(blocks: DataFrame) -> DataFrame:
    """(session_id, summary) of the last compaction."""
    return blocks.where("kind = 'compaction'").groupBy("session_id").agg(F.max_by("summary", "seq").alias("summary")).where("summary is not null")


def _steps(blocks: DataFrame, c: Compact) -> tuple[DataFrame, DataFrame]:
    """(cuts, split blocks), written: both are read several times."""
    live = written(cut.numbered(blocks, c), "live")
    at = written(cut.cuts(blocks, c, live), "cuts")
    return at, written(cut.split_at(blocks, c, live, at), "split")


def _accounts(at: DataFrame, split: DataFrame, c: Compact) -> DataFrame:
    d = split.withColumn("bytes", block_size())
    sums = d.groupBy("session_id").agg(F.coalesce(F.sum(F.when(F.col("kept"), F.col("bytes"))), F.lit(0)).alias("kept_bytes"), F.coalesce(F.sum(F.when(~F.col("kept"), F.col("bytes"))), F.lit(0)).alias("summarized_bytes"))
    return at.join(sums, "session_id").select("session_id", "n", "users", "keep", "grown", "cut", "compact_all", "reason", "possible", tokens(F.col("kept_bytes"), c.chars_per_token).alias("kept_tokens"), tokens(F.col("summarized_bytes"), c.chars_per_token).alias("summarized_tokens"))


def plan(blocks: DataFrame, c: Compact = Compact()) -> DataFrame:
    """One row a session: the cut and the tokens on both sides of it, without a brief."""
    return _accounts(*_steps(blocks, c), c)


def compact(blocks: DataFrame, c: Compact = Compact(), t: Transcript = Transcript(), previous: DataFrame | None = None) -> DataFrame:
    """One row a session that can be cut: its plan, ``summary``, ``sections``, tokens_before, tokens_after and saved_pct.

    ``previous``: (session_id, summary) of earlier briefs; the log's last compactions if not given.
    """
    previous = previous_briefs(blocks) if previous is None else previous
    at, split = _steps(blocks, c)
    gone = split.where(~F.col("kept"))
    merged = written(brief.merge(brief.parse_items(previous), sections.extract(gone)), "merged")
    windows = written(brief.transcript_window(gone, t), "transcript")
    out = _accounts(at, split, c).where("possible").join(brief.render(merged, windows), "session_id").join(brief.present(merged, windows), "session_id")
    out = out.join(previous.select("session_id", tokens(F.octet_length("summary"), c.chars_per_token).alias("previous_tokens")), "session_id", "left")
    before = F.col("summarized_tokens") + F.col("kept_tokens") + F.coalesce("previous_tokens", F.lit(0))
    after = tokens(F.octet_length("summary"), c.chars_per_token) + F.col("kept_tokens")
    out = out.withColumn("tokens_before", before).withColumn("tokens_after", after)
    return out.withColumn("saved_pct", F.when(F.col("tokens_before") > 0, F.round(100.0 * (F.col("tokens_before") - F.col("tokens_after")) / F.col("tokens_before"), 4)).otherwise(0.0)).drop("previous_tokens")
