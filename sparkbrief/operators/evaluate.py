"""Measures of recall and compaction."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..plans.shared import written


def rare_terms(items: DataFrame, most: int = 4, least: int = 4) -> DataFrame:
    """(item_id, w): an item's longest distinct words of ``least`` letters, by length and then spelling."""
    words = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(f"([a-z]{{{least},}})"), 1))
    longest = F.slice(F.array_sort(F.transform(words, lambda w: F.struct((-F.length(w)).alias("n"), w.alias("w")))), 1, most)
    return items.select("item_id", F.explode(longest).alias("x")).select("item_id", F.col("x.w").alias("w"))


#: Fixed words that say nothing of a text.
STOP = "the a an and or of to in for with is are was were be been this that these those it its as at on by from not no yes true false error failed warning line file will can cannot into your you".split()


def query_terms(texts: DataFrame, key: str, most: int = 4) -> DataFrame:
    """(key, terms): of each text its longest words of four characters or more, rarer ones first and then earlier ones, without stop words."""
    words = F.filter(F.regexp_extract_all(F.lower("text"), F.lit(r"([a-z][a-z0-9_.-]{3,})"), 1), lambda w: ~w.isin(*STOP))
    d = texts.select(key, F.posexplode(words).alias("at", "w")).groupBy(key, "w").agg(F.count("*").alias("n"), F.min("at").alias("at"))
    best = F.slice(F.array_sort(F.collect_list(F.struct((-F.length("w")).alias("l"), "n", "at", "w"))), 1, most)
    return d.groupBy(key).agg(F.array_join(best["w"], " ").alias("terms"))


def _occurrences(words: list[str], parts: list[tuple]):
    """Documents (doc_id, t, text) -> (kind, no, doc_id, k): how often word ``no`` stands in t without overlap (kind 0), that part ``no``
    stands in the text (kind 1), and how many documents were read (kind 2). One scan by two automata, built once a task."""
    import ahocorasick

    def automaton(patterns: list[str]):
        a = ahocorasick.Automaton()
        for i, p in enumerate(patterns):
            a.add_word(p, (i, len(p)))
        a.make_automaton()
        return a.iter if patterns else lambda _: ()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find, hold = automaton(words), automaton(parts)
        for batch in batches:
            out = [(2, 0, None, batch.num_rows)]
            for doc, t, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                count: dict[int, int] = {}
                end: dict[int, int] = {}
                for at, (i, n) in find(t):
                    if at - n >= end.get(i, -1):
                        end[i] = at
                        count[i] = count.get(i, 0) + 1
                out += [(0, i, doc, k) for i, k in count.items()]
                out += [(1, i, doc, 1) for i in {i for _, (i, _) in hold(text)}]
            yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*out, strict=True), (pa.int32(), pa.int32(), pa.int64(), pa.int64()), strict=True)], names=["kind", "no", "doc_id", "k"])

    return run, "kind int, no int, doc_id long, k long"


def _best_ranks(items: list, docs: DataFrame, most: int) -> DataFrame:
    """(item, best) of the items of one block that some document holds: the best rank of such a document among the first ``most``, else null."""
    spark = docs.sparkSession
    named = spark.createDataFrame([(i, r.text) for i, r in enumerate(items)], "item_id int, text string")
    asked = [(r.item_id, r.w) for r in rare_terms(named).collect()]
    words = sorted({w for _, w in asked})
    parts = sorted({r.text for r in items})
    run, schema = _occurrences(words, parts)
    low = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.lower("text").alias("t"), "text").where("text <> ''")
    found = written(low.mapInArrow(run, schema), "occurrences")
    total = found.where("kind = 2").agg(F.coalesce(F.sum("k"), F.lit(0))).first()[0]
    n = found.where("kind = 0")
    df = n.groupBy("no").agg(F.count("*").alias("df"))
    weight = F.greatest(F.log(F.lit(float(total)) / F.col("df")), F.lit(0.5))
    # a few rows an item
    terms = spark.createDataFrame([(i, words.index(w)) for i, w in asked], "item int, no int")
    truths = spark.createDataFrame([(i, parts.index(r.text)) for i, r in enumerate(items)], "item int, no int")
    scored = n.join(F.broadcast(df), "no").join(F.broadcast(terms), "no").groupBy("item", "doc_id").agg(F.sum(F.log1p("k") * weight).alias("score"))
    order = Window.partitionBy("item").orderBy(F.desc(F.round("score", 9)), "doc_id")
    ranked = scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)
    held = found.where("kind = 1").join(F.broadcast(truths), "no").select("item", "doc_id")
    return held.join(F.broadcast(ranked), ["item", "doc_id"], "left").groupBy("item").agg(F.min("rank").alias("best"))


def hit_at_k(items: DataFrame, docs: DataFrame, block: int = 2_000) -> DataFrame:
    """Items whose text a document holds, and for how many such a document is ranked first, or among five.

    The items are a query set, read to the driver ``block`` at a time; each block is one scan of the documents.
    """
    out, held = None, []

    def add(held: list) -> DataFrame:
        best = _best_ranks(held, docs, 5)
        return best if out is None else out.unionByName(best)

    for r in items.where("text <> ''").select("text").toLocalIterator():
        held.append(r)
        if len(held) == block:
            out, held = add(held), []
    out = add(held) if held or out is None else out
    return out.agg(F.count("*").alias("items"), F.count_if(F.col("best") == 1).alias("hit_1"), F.count_if(F.col("best") <= 5).alias("hit_5"))


def facts_change(old: DataFrame, new: DataFrame, section: str = "key_facts") -> DataFrame:
    """(session_id, change, item): facts that one set of sections has and the other has not."""
    a, b = (d.where(F.col("section") == section).select("session_id", "item").distinct() for d in (old, new))
    return b.exceptAll(a).withColumn("change", F.lit("added")).unionByName(a.exceptAll(b).withColumn("change", F.lit("removed")))


def retention(codes: DataFrame, briefs: DataFrame) -> DataFrame:
    """(session_id, codes, kept): how many of a session's codes its brief still holds."""
    d = codes.join(briefs, "session_id", "left").withColumn("has", F.coalesce(F.col("summary").contains(F.col("code")), F.lit(False)))
    return d.groupBy("session_id").agg(F.count("*").alias("codes"), F.count_if("has").alias("kept"))


def paired(old: DataFrame, new: DataFrame, section: str = "key_facts") -> DataFrame:
    """(session_id, old_items, new_items, added, removed): two sets of sections of the same sessions, compared."""
    a, b = (d.where(F.col("section") == section).select("session_id", "item").distinct() for d in (old.withColumn("x", F.lit(0)), new))
    d = a.withColumn("old", F.lit(1)).join(b.withColumn("new", F.lit(1)), ["session_id", "item"], "full")
    return d.groupBy("session_id").agg(F.count("old").alias("old_items"), F.count("new").alias("new_items"), F.count_if(F.col("old").isNull()).alias("added"), F.count_if(F.col("new").isNull()).alias("removed"))


def answers(truth: DataFrame, answer: DataFrame) -> DataFrame:
    """(session_id, truth, full_hits, name_hits, lines): how many true paths (session_id, path), and how many of their names, each session's
    answer (session_id, answer) holds, and its lines with text."""
    d = truth.join(answer, "session_id", "left").withColumn("answer", F.coalesce("answer", F.lit("")))
    name = F.regexp_extract("path", r"([^/]*)\z", 1)
    lines = F.size(F.filter(F.split("answer", "\n"), lambda x: F.trim(x) != ""))
    return d.groupBy("session_id").agg(F.count("*").alias("truth"), F.count_if(F.col("answer").contains(F.col("path"))).alias("full_hits"), F.count_if(F.col("answer").contains(name)).alias("name_hits"), F.max(lines).alias("lines"))
