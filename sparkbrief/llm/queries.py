"""The registered queries of this subpackage: thin digests of its operators over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import disclosure, quality, sql, toxicity
from .chosen_path import similar_groups
from .contamination import scan
from .host_rules import judge
from .line_runs import dedup_lines
from .mixing import Mixture
from .passages import remove_repeats
from .url_rules import judge_urls


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Mixture(table(spark, sf_dir, "documents")).taken().drop("source")


def op2_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


def op3_host_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = judge(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    fold = remainder(F.col("doc_id"), 5)
    model = quality.fit(docs, table(spark, sf_dir, "labels").where(fold != 0), "quality")
    out = quality.score(docs, model)
    return out.select("doc_id", (fold == 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op7_line_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(table(spark, sf_dir, "documents"), with_text=False)


def remainder(key: Column, by: int) -> Column:
    """crc32 of the key's text, modulo ``by``; a null key counts as the empty text."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % by


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    fold = remainder(F.col("doc_id"), 3)
    model = toxicity.fit(docs, table(spark, sf_dir, "labels").where(fold != 1), "toxic")
    out = toxicity.score(docs, model)
    return out.select("doc_id", (fold == 1).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op5_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"), with_text=False)


def op8_contamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), with_spans=False)


def op9_chosen_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_groups(table(spark, sf_dir, "documents"))


def op10_disclosure(spark: SparkSession, sf_dir: str) -> DataFrame:
    return disclosure.find(table(spark, sf_dir, "documents")).drop("all_spans")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, f in globals().items() if k[:2] == "op" and k[2:3].isdigit()}


def oracle_sql() -> dict[str, str]:
    return {k: v for k, v in vars(sql).items() if k[:2] == "op" and k[2:3].isdigit()}
