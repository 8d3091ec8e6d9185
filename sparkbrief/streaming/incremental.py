"""Incremental forms: an archive that grows by batches, briefs folded batch by batch, and a token trigger."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.text import block_size, tokens
from ..operators import brief, sections


def part_of(parts: int) -> Column:
    """The part, of a fixed number, that a session's rows are kept in."""
    return F.pmod(F.xxhash64("session_id"), F.lit(parts)).cast("int")


def archive(stream: DataFrame, path: str, checkpoint: str, parts: int = 64) -> StreamingQuery:
    """Append blocks to an archive, a folder for each part of the sessions: every block once, whatever restarts."""
    return stream.withColumn("part", part_of(parts)).writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).partitionBy("part").trigger(availableNow=True).start()


def fold_sections(old: DataFrame | None, batch: DataFrame) -> DataFrame:
    """The sections after one more batch of blocks: sticky ones accumulate, what is outstanding is the batch's."""
    new = sections.extract(batch)
    return new if old is None else brief.merge(old, new)


#: Sections by session with the part and the batch that wrote them.
STATE = "session_id string, section string, ord int, item string, batch int, part int"


def _newest(state: DataFrame, before: int | None = None) -> dict[int, int]:
    """The last batch that wrote each part; a number for each part."""
    d = state if before is None else state.where(F.col("batch") < before)
    return {r.part: r.batch for r in d.groupBy("part").agg(F.max("batch").alias("batch")).collect()}


def _parts(state: DataFrame, of: dict[int, int]) -> DataFrame:
    keep = F.lit(False)
    for batch in sorted(set(of.values())):
        keep = keep | ((F.col("batch") == batch) & F.col("part").isin([p for p, b in of.items() if b == batch]))
    return state.where(keep).where("session_id is not null").drop("batch", "part")


def brief_stream(stream: DataFrame, state_dir: str, checkpoint: str, parts: int = 16) -> StreamingQuery:
    """Fold each micro-batch into the sections written before it. Sessions are kept in ``parts`` parts, and a batch reads and writes only the
    parts of its own sessions, under ``state_dir/batch=N/part=K``.

    A batch that runs again after a failure reads the same predecessors and overwrites its own output.
    """

    def step(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        batch = batch.withColumn("part", part_of(parts))
        # at most ``parts`` numbers
        touched = sorted(r.part for r in batch.select("part").distinct().collect())
        old = None
        if number:
            state = spark.read.schema(STATE).parquet(state_dir)
            at = {p: b for p, b in _newest(state, number).items() if p in touched}
            old = _parts(state, at) if at else None
        new = fold_sections(old, batch.drop("part")).withColumn("part", part_of(parts))
        # a row without a session says that the part was written, even if nothing is left in it
        marks = spark.createDataFrame([(None, None, None, None, p) for p in touched], "session_id string, section string, ord int, item string, part int")
        new.select("session_id", "section", F.col("ord").cast("int").alias("ord"), "item", "part").unionByName(marks).write.mode("overwrite").partitionBy("part").parquet(f"{state_dir}/batch={number}")

    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def brief_state(state: DataFrame) -> DataFrame:
    """The sections of all sessions as the last batches left them. ``state``: the table under ``state_dir``."""
    return _parts(state, _newest(state))


def over_threshold(stream: DataFrame, window_tokens: int, share: float = 0.3, chars_per_token: float = 3.8) -> DataFrame:
    """(session_id, tokens, due): running token sums of sessions, and whether a share of the window is reached."""
    d = stream.where("kind = 'message'").groupBy("session_id").agg(F.sum(block_size()).alias("bytes"))
    d = d.select("session_id", tokens(F.col("bytes"), chars_per_token).alias("tokens"))
    return d.withColumn("due", F.col("tokens") >= F.lit(int(window_tokens * share)))


def event_counts(stream: DataFrame, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Events by hour and type with a watermark: a Spark extension without a counterpart in the log operators."""
    return stream.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("value")).select(F.col("w.start").alias("start"), "event_type", "n", "value")


def run_all(start: Callable[[], StreamingQuery]) -> None:
    """Start a query and wait until all that is there has been handled."""
    q = start()
    q.awaitTermination()
    if q.exception():
        raise q.exception()
