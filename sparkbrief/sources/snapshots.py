"""Snapshots of logs: the blocks of all sessions at one time, with a note of when and why, listed without reading them."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_META = "created long, reason string, sessions long, entries long, blocks long"


def write_snapshot(blocks: DataFrame, path: str, reason: str, created: int) -> None:
    """Blocks below ``path/data/created=N``, and then their note: a snapshot that was not finished has none and is not listed."""
    spark = blocks.sparkSession
    to = f"{path}/data/created={created}"
    blocks.write.mode("overwrite").parquet(to)
    d = spark.read.schema(blocks.schema).parquet(to)
    note = d.select("session_id", "seq").agg(F.countDistinct("session_id").alias("sessions"), F.countDistinct("session_id", "seq").alias("entries"), F.count("*").alias("blocks"))
    note.select(F.lit(created).cast("long").alias("created"), F.lit(reason).alias("reason"), "sessions", "entries", "blocks").write.mode("overwrite").parquet(f"{path}/notes/{created}")


def list_snapshots(spark: SparkSession, path: str) -> DataFrame:
    """(created, reason, sessions, entries, blocks), newest first. No snapshots: no rows."""
    try:
        return spark.read.schema(_META).parquet(f"{path}/notes/*").orderBy(F.desc("created"))
    except AnalysisException:
        return spark.createDataFrame([], _META)


def read_snapshot(spark: SparkSession, path: str, created: int, schema) -> DataFrame:
    return spark.read.schema(schema).parquet(f"{path}/data/created={created}")


def write_json(rows: DataFrame, path: str) -> None:
    """Rows as JSON lines, written in parts by all executors; nulls are left out."""
    rows.write.mode("overwrite").json(path)
