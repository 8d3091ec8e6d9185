"""Streams over the test tables, run until all that is there has been handled."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..plans.shared import written
from ..sources import derived
from ..streaming import incremental
from . import registry

QUERIES, ORACLES, register = registry()


def _folder(spark) -> str:
    written(spark.range(1), "touch")  # sets the shared folder where it is unset
    return f"{spark.conf.get('spark.checkpoint.dir').rstrip('/')}/stream-{uuid.uuid4().hex}"


def _as_stream(spark, blocks, folder: str, parts: int):
    blocks.repartitionByRange(parts, "seq").write.parquet(f"{folder}/in")
    return spark.readStream.schema(blocks.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")


@register(f"WITH {derived.BLOCKS_SQL} SELECT session_id, count(*) AS blocks, CAST(max(seq) AS BIGINT) AS last FROM blocks GROUP BY session_id")
def stream_archive_append(spark, sf_dir):
    folder = _folder(spark)
    s = _as_stream(spark, derived.blocks(spark, sf_dir), folder, 3)
    incremental.run_all(lambda: incremental.archive(s, f"{folder}/out", f"{folder}/cp"))
    return spark.read.schema(s.schema).parquet(f"{folder}/out").groupBy("session_id").agg(F.count("*").alias("blocks"), F.max("seq").alias("last"))


@register()
def stream_brief_merge(spark, sf_dir):
    """Sections after three batches of each session's log."""
    folder = _folder(spark)
    s = _as_stream(spark, derived.tools(spark, sf_dir), folder, 3)
    incremental.run_all(lambda: incremental.brief_stream(s, f"{folder}/state", f"{folder}/cp"))
    return incremental.brief_state(spark.read.parquet(f"{folder}/state"))


@register(f"""WITH {derived.BLOCKS_SQL}, t AS (SELECT session_id, CAST(trunc(sum(CASE type WHEN 'toolCall' THEN strlen(arguments) ELSE strlen(text) END) / 3.8) AS BIGINT) AS tokens FROM blocks WHERE kind = 'message' GROUP BY session_id)
    SELECT session_id, tokens, tokens >= 300 AS due FROM t""")
def compaction_due(spark, sf_dir):
    return incremental.over_threshold(derived.blocks(spark, sf_dir), 1000)


@register("SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def event_windows(spark, sf_dir):
    """A Spark extension: events by hour and type."""
    return incremental.event_counts(spark.read.parquet(f"{sf_dir}/events.parquet")).select("start", "event_type", "n")
