"""Blocks gathered to messages, and rollups of them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import block_size, searchable, tokens

KEY = ["session_id", "seq"]


def sizes(blocks: DataFrame) -> DataFrame:
    """(session_id, seq, entry_id, role, bytes) of every message."""
    d = blocks.where("kind = 'message'").withColumn("bytes", block_size())
    return d.groupBy(*KEY).agg(F.first("entry_id").alias("entry_id"), F.first("role").alias("role"), F.sum("bytes").alias("bytes"))


def texts(blocks: DataFrame) -> DataFrame:
    """(session_id, seq, entry_id, role, ts, tools, text): the searchable text of every message, its blocks a line each."""
    d = blocks.where("kind = 'message'").withColumn("piece", searchable())
    d = d.groupBy(*KEY).agg(
        F.first("entry_id").alias("entry_id"),
        F.first("role").alias("role"),
        F.first("ts").alias("ts"),
        F.collect_set(F.when(F.col("type") == "toolResult", F.col("tool_name"))).alias("tools"),
        F.array_sort(F.collect_list(F.when(F.col("piece").isNotNull(), F.struct("block_ix", "piece")))).alias("p"),
    )
    return d.select(*KEY, "entry_id", "role", "ts", "tools", F.array_join(F.col("p.piece"), "\n").alias("text"))


def stats_by_role(blocks: DataFrame) -> DataFrame:
    return sizes(blocks).groupBy("session_id", "role").agg(F.count("*").alias("messages"), F.sum("bytes").alias("bytes"))


def stats_by_session(blocks: DataFrame, chars_per_token: float = 3.8) -> DataFrame:
    """Messages, bytes and estimated tokens (a fraction, not cut) of each session."""
    d = sizes(blocks).groupBy("session_id").agg(F.count("*").alias("messages"), F.sum("bytes").alias("bytes"))
    return d.withColumn("est_tokens", F.round(F.col("bytes") / chars_per_token, 6))


def token_estimates(blocks: DataFrame, chars_per_token: float = 3.8) -> DataFrame:
    return sizes(blocks).withColumn("tokens", tokens(F.col("bytes"), chars_per_token))
