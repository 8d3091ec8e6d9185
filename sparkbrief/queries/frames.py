"""Framing of bulky documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import frames
from ..sources import derived
from . import registry

QUERIES, ORACLES, register = registry()

_D = r"""WITH d AS (SELECT doc_id, text, string_split(regexp_replace(text, '\n$', ''), chr(10)) AS l FROM documents WHERE text <> ''),
    w AS (SELECT *, list_sort(list_transform(l, lambda x: len(x))) AS n FROM d),
    c AS (SELECT *, greatest(40, least(200, CAST(ceil(n[len(n) * 9 // 10 + 1] / 8) AS INTEGER) * 8 + 8)) AS cols FROM w),
    f AS (SELECT *, greatest(1, CAST(ceil(list_sum(list_transform(l, lambda x: greatest(1, CAST(ceil(len(x) / cols) AS BIGINT)))) / 119) AS BIGINT)) AS frames FROM c),
    e AS (SELECT *, greatest(((cols * 8 + 8) * 968) // 750, 70) AS each, CAST(trunc(strlen(text) / 3.8) AS BIGINT) AS text_tokens FROM f),
    g AS (SELECT *, frames * each AS snap_tokens, frames * each * 4 <= text_tokens * 3 AS worthwhile FROM e)"""
_CLASS = r"CASE WHEN NOT regexp_matches(text, '\S') THEN 'empty' WHEN regexp_matches(text, '^\s*[{\[]') AND json_valid(text) THEN 'json' ELSE 'text' END"


def _docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text")


@register(f"{_D} SELECT doc_id, cols FROM g")
def frame_width_p90(spark, sf_dir):
    return _docs(spark, sf_dir).where("text <> ''").select("doc_id", frames.adaptive_cols(F.col("text")).alias("cols"))


@register(f"{_D} SELECT doc_id, cols, frames FROM g")
def frame_estimate(spark, sf_dir):
    return frames.economics(_docs(spark, sf_dir).where("text <> ''")).select("doc_id", "cols", "frames")


@register(f"{_D} SELECT doc_id, CAST(snap_tokens AS BIGINT) AS snap_tokens, text_tokens, worthwhile FROM g")
def frame_economics(spark, sf_dir):
    return frames.economics(_docs(spark, sf_dir).where("text <> ''")).select("doc_id", "snap_tokens", "text_tokens", "worthwhile")


@register(f"{_D} SELECT doc_id, {_CLASS} AS class, CASE WHEN {_CLASS} <> 'text' THEN {_CLASS} WHEN strlen(text) < 6000 THEN 'short' WHEN worthwhile THEN 'snap' ELSE 'no_gain' END AS decision FROM g")
def route_blocks(spark, sf_dir):
    return frames.route(_docs(spark, sf_dir).where("text <> ''")).select("doc_id", "class", "decision")


@register(f"{_D} SELECT count(*) AS blocks, count(*) FILTER (strlen(text) >= 6000 AND worthwhile) AS framed, CAST(sum(text_tokens) AS BIGINT) AS tokens_before FROM g")
def transform_totals(spark, sf_dir):
    d = frames.transform(_docs(spark, sf_dir).where("text <> ''"))
    return d.agg(F.count("*").alias("blocks"), F.count_if(F.col("decision") == "snap").alias("framed"), F.sum("tokens_before").alias("tokens_before"))


@register()
def frame_layout_pages(spark, sf_dir):
    """Pages of the documents that would be framed, without pictures."""
    d = frames.route(_docs(spark, sf_dir)).where("decision = 'snap'")
    return frames.render(d, label="source", pictures=False).drop("png")


@register()
def render_frames(spark, sf_dir):
    """Pictures of the documents that would be framed: geometry and the hash of each."""
    d = frames.route(_docs(spark, sf_dir)).where("decision = 'snap'")
    return frames.render(d, label="source").select("key", "frame_no", "frames", "width", "height", "chars", F.sha2("png", 256).alias("png_sha256"))


@register("SELECT substr(sha256(text), 1, 32) AS key, count(*) AS n, CAST(max(strlen(text)) AS BIGINT) AS bytes FROM documents WHERE text IS NOT NULL GROUP BY 1")
def dedup_blocks(spark, sf_dir):
    return frames.distinct_texts(_docs(spark, sf_dir)).withColumn("bytes", F.col("bytes").cast("long"))


@register(f"""WITH {derived.BLOCKS_SQL} SELECT b.session_id, b.seq FROM blocks b WHERE b.role = 'toolResult' AND strlen(b.text) >= 40 AND b.seq <= (SELECT max(a.seq) FROM blocks a WHERE a.session_id = b.session_id AND a.role = 'assistant')""")
def framing_candidates(spark, sf_dir):
    return frames.candidates(derived.tools(spark, sf_dir), 40).select("session_id", "seq")
