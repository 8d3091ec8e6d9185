"""A corpus pipeline of five stages, each written as Parquet and read again by the next.

Toxic documents go, repeated lines go, one document of each group of near duplicates stays, contaminated documents go,
and what is left is mixed to target weights. Every stage works on all that its predecessor kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkbrief.llm import toxicity
from sparkbrief.llm._store import Store, freed
from sparkbrief.llm.chosen_path import similar_groups
from sparkbrief.llm.contamination import scan
from sparkbrief.llm.line_runs import dropped_lines, strip_lines
from sparkbrief.llm.mixing import Mixture
from sparkbrief.llm.queries import remainder, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity is 0.7 or more go. The model learns as op4's does, from the labelled rows of two folds in three."""
    labels = table(spark, sf_dir, "labels").where(remainder(F.col("doc_id"), 3) != 1)
    model = toxicity.fit(docs, labels, "toxic")
    return toxicity.score(docs.select("doc_id", "text", *COLUMNS[2:]), model, keep=COLUMNS[1:]).where("score < 0.7").select(*COLUMNS)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of 20 characters found in three documents stay in the largest only. ``n_chars`` is that of the text left; a null text stays null."""
    lines = dropped_lines(docs, Store(spark, "line-runs"))
    out = strip_lines(docs, lines, keep=["lang", "source", "n_chars"])
    return out.select("doc_id", F.col("kept").alias("text"), "lang", "source", F.when(F.col("n_dropped") > 0, F.char_length("kept").cast("long")).otherwise(F.col("n_chars")).alias("n_chars"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates one row stays: the least doc_id, a row without one only if all of the group are. Texts without words
    belong to no group and stay."""
    text = F.coalesce("text", F.lit(""))
    # a row is known by its doc_id and two hashes of its text; rows alike in these are copies
    rows = docs.select(*COLUMNS, F.col("doc_id").isNull().alias("none"), F.coalesce("doc_id", F.lit(0)).alias("id"), F.xxhash64(text).alias("x1"), F.xxhash64(F.lit(1), text).alias("x2"))
    row = ["none", "id", "x1", "x2"]
    # compared under a key of their own: texts that share a doc_id are texts apart
    groups = similar_groups(rows.withColumn("key", F.xxhash64(*row)), key="key", keep=row).where("n_tokens > 0")
    first = Store(spark, "near-copies").put(groups.groupBy("class_id").agg(F.min(F.struct(*row)).alias("r")).select("r.*"), "first")
    worded = F.col("text").rlike(r"[^ \t-\r]")
    # equal rows become one before any of them meet
    once = rows.where(worded).groupBy(*row).agg(F.first("text").alias("text"), F.min(F.struct("lang", "source", "n_chars")).alias("o"))
    once = once.join(first, row, "left_semi").select(F.when(~F.col("none"), F.col("id")).alias("doc_id"), "text", "o.*")
    return once.select(*COLUMNS).unionByName(docs.where(~F.coalesce(worded, F.lit(False))).select(*COLUMNS))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which a twentieth of the words or more lie in benchmark windows go."""
    out = scan(docs, table(spark, sf_dir, "benchmark"), with_spans=False, keep=COLUMNS[1:])
    return out.where(~F.col("contaminated")).select(*COLUMNS)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix itself: (shard, place, doc_id, source, pass_, first, words, text), a row a block of a document's words. A shard is read in the
    order of ``place``."""
    return Mixture(docs).blocks(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", drop_lines),
    ("n-gram Jaccard join", drop_near_copies),
    ("benchmark decontamination", drop_contaminated),
    ("mixing sources to target weights", mix),
]

#: SQL expresses neither the classifier nor the draw.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The result of the last stage. Columns of documents beyond ``COLUMNS`` take no part. A stage's own tables go once its result is written,
    and its input with them."""
    store = Store(spark, "pipeline")
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        with freed():
            docs = store.put(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        if before is not None:
            store.drop(before)
        before = docs
    return docs
