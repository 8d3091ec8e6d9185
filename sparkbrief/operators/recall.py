"""Ranked recall: keyword or regular-expression search over the messages of each session.

Filters come before the statistics, whose N and df are those of the filtered messages. Terms are a short list, so each is a
column rather than rows of a join. Messages are read once: what is kept of each are counts and positions, a small written table, from
which the statistics, the totals and the ranking follow. Texts are read again only for the messages of a page, whose snippets
are cut.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import occurrences, truncate_bytes
from ..functions.udfs import ln, shrunk, snippet
from ..plans.shared import written
from ..schema import Recall
from .messages import texts
from .tree import lineage


def java_pattern(pattern: str) -> str:
    """The pattern for Java's engine: Unicode classes, a newline only ends lines, ``$`` is the end of the text.

    Look-around and back-references are refused, as are patterns that do not compile.
    """
    if re.search(r"\(\?(?:[=!]|<[=!])|(?<!\\)(?:\\\\)*\\[1-9k]", pattern):
        raise ValueError("look-around and back-references are not supported")
    out, in_class, i = [], False, 0
    while i < len(pattern):
        c = pattern[i]
        if c == "\\" and i + 1 < len(pattern):
            out.append(pattern[i : i + 2])
            i += 2
            continue
        if c == "[":
            in_class = True
        elif c == "]":
            in_class = False
        out.append(r"\z" if c == "$" and not in_class else c)
        i += 1
    try:
        re.compile(pattern)
    except re.error as e:
        raise ValueError(f"bad regex: {e}") from e
    return "(?Ud)" + "".join(out)


def searched(blocks: DataFrame, r: Recall) -> DataFrame:
    """The messages that a search looks into: by role and tool, between the two entries (both exclusive), with text.

    A range holds in each session by itself; sessions that lack one of its entries are not searched.
    """
    d = texts(blocks).where("text <> ''")
    if r.role:
        d = d.where(F.col("role") == r.role)
    if r.tool_name:
        d = d.where((F.col("role") == "toolResult") & F.array_contains("tools", r.tool_name))
    for entry, after in ((r.after_entry, True), (r.before_entry, False)):
        if entry is not None:
            edge = blocks.where(F.col("entry_id") == entry).groupBy("session_id").agg(F.min("seq").alias("edge"))
            d = d.join(edge, "session_id").where(F.col("seq") > F.col("edge") if after else F.col("seq") < F.col("edge")).drop("edge")
    return d


def check_range(blocks: DataFrame, r: Recall) -> None:
    """Raise unless both ends of the range exist, in one session at least, and stand in order wherever they meet. Runs a job."""
    ends = {"after_entry": r.after_entry, "before_entry": r.before_entry}
    given = [e for e in ends.values() if e is not None]
    at = [F.min(F.when(F.col("entry_id") == e, F.col("seq"))).alias(k) for k, e in ends.items()]
    by = blocks.where(F.col("entry_id").isin(given)).groupBy("session_id").agg(*at)
    both = F.col("after_entry").isNotNull() & F.col("before_entry").isNotNull()
    got = by.agg(*(F.count(k).alias(k) for k in ends), F.count_if(both).alias("both"), F.count_if(both & (F.col("after_entry") >= F.col("before_entry"))).alias("wrong")).first()
    for k, e in ends.items():
        if e is not None and not got[k]:
            raise ValueError(f"{k} not found in selected scope")
    if len(given) == 2 and (not got.both or got.wrong):
        raise ValueError("invalid entry range")


def terms(query: str) -> list[str]:
    return query.lower().split()


def statistics(rows: DataFrame, words: list[str]) -> DataFrame:
    """(session_id, searched, df_0, df_1, ...): a term given twice counts its documents twice."""
    low = F.lower("text")
    counts = [(F.count_if(low.contains(w)) * words.count(w)).alias(f"df_{i}") for i, w in enumerate(words)]
    return rows.groupBy("session_id").agg(F.count("*").alias("searched"), *counts)


def _counted(rows: DataFrame, r: Recall) -> DataFrame:
    """Of every message searched: hit, n_i (how often it has term i), matched_terms and pos; texts are left behind. Written."""
    keep = ["session_id", "seq", "entry_id", "role", "ts"]
    if r.regex:
        p = java_pattern(r.query)
        # the match is the leftmost one, so what stands before it is as short as can be
        before = F.regexp_extract("text", rf"\A([\s\S]*?)(?:{p})", 1)
        hit = F.col("text").rlike(p)
        match = F.when(hit, F.array(truncate_bytes(F.regexp_extract("text", f"({p})", 0), 60)))
        return written(rows.select(*keep, hit.alias("hit"), match.alias("matched_terms"), F.when(hit, F.char_length(before) + 1).alias("pos")), "counted")
    words, low = terms(r.query), F.lower("text")
    d = rows.select(*keep, *(occurrences(low, w).alias(f"n_{i}") for i, w in enumerate(words)), *(F.instr(low, w).alias(f"at_{i}") for i, w in enumerate(words)))
    found = [F.col(f"n_{i}") > 0 for i in range(len(words))]
    first = F.array_min(F.array(*(F.when(f, F.col(f"at_{i}")) for i, f in enumerate(found))))
    matched = F.array_compact(F.array(*(F.when(f, w) for f, w in zip(found, words, strict=True))))
    d = d.select(*keep, F.exists(F.array(*found), lambda x: x).alias("hit"), *(f"n_{i}" for i in range(len(words))), matched.alias("matched_terms"), first.alias("pos"))
    return written(d, "counted")


def hits(blocks: DataFrame, r: Recall, by: str = "session_id") -> DataFrame:
    """(session_id, seq, entry_id, role, ts, searched, total, score, matched_terms, pos) of every hit. ``by``: N, df and totals are those of
    each of its values; ``scope`` is one for all sessions."""
    d = _counted(searched(blocks, r), r).withColumn("scope", F.lit("all"))
    words = [] if r.regex else terms(r.query)
    stats = d.groupBy(by).agg(F.count("*").alias("searched"), F.count_if("hit").alias("total"), *((F.count_if(F.col(f"n_{i}") > 0) * words.count(w)).alias(f"df_{i}") for i, w in enumerate(words)))
    found = d.where("hit").join(stats, by)
    score: Column = F.lit(0.0) if words else F.lit(1.0)
    for i in range(len(words)):
        score = score + ln(1.0 + F.col(f"n_{i}")) * F.greatest(ln(F.col("searched") / F.greatest(F.col(f"df_{i}"), F.lit(1))), F.lit(0.5))
    return found.select("session_id", "seq", "entry_id", "role", "ts", "searched", "total", score.alias("score"), "matched_terms", "pos")


def _paged(found: DataFrame, r: Recall) -> DataFrame:
    return found.where((F.col("rank") > (r.page - 1) * r.per_page) & (F.col("rank") <= r.page * r.per_page)).withColumn("page_count", F.greatest(F.lit(1), F.ceil(F.col("total") / r.per_page)).cast("int"))


def page(found: DataFrame, r: Recall) -> DataFrame:
    """One page of each session's hits, best first, equal scores in log order, with the totals; sessions with fewer pages have no rows."""
    return _paged(found.withColumn("rank", F.row_number().over(Window.partitionBy("session_id").orderBy(F.desc("score"), "seq"))), r)


def page_all(found: DataFrame, r: Recall) -> DataFrame:
    """One page of the hits of all sessions together: the first rows are found in each part and then merged, no more than the pages so far."""
    best = found.orderBy(F.desc("score"), "session_id", "seq").limit(r.page * r.per_page)
    return _paged(best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "session_id", "seq"))), r)


def _shown(blocks: DataFrame, p: DataFrame, r: Recall, by: list[str]) -> DataFrame:
    """A page with snippets, cut until what a session (or the one page) shows has ``max_output_bytes`` as JSON."""
    key = ["session_id", "seq"]
    p = written(p, "page")
    body = texts(blocks.join(p.select(*key), key, "left_semi")).select(*key, "text")
    cut = snippet("text", "pos", F.lit(r.snippet_bytes), F.lit(not r.regex)).alias("snippet")
    d = p.join(body, key).select("session_id", "rank", "entry_id", "role", "ts", "score", "matched_terms", cut, "total", "page_count", "searched")
    # pages are a few rows each; only those that are too long are shrunk
    pages = d.groupBy(*by, "total", "page_count", "searched").agg(F.array_sort(F.collect_list(F.struct("rank", "session_id", "entry_id", "role", "ts", "score", "matched_terms", "snippet"))).alias("hits"))
    whole = F.to_json(F.struct("total", "page_count", "searched", "hits"), {"ignoreNullFields": "false"})
    fits = F.octet_length(whole) <= r.max_output_bytes
    pages = pages.withColumn("cut", F.when(~fits, shrunk(whole, F.lit(r.max_output_bytes))))
    out = pages.select(*by, "total", "page_count", "searched", "cut", F.posexplode("hits").alias("i", "h"))
    text = F.when(F.col("cut").isNull(), F.col("h.snippet")).otherwise(F.get("cut", F.col("i")))
    return out.select("h.session_id", "h.rank", "h.entry_id", "h.role", "h.ts", "h.score", "h.matched_terms", text.alias("snippet"), "total", "page_count", "searched")


def search(blocks: DataFrame, r: Recall) -> DataFrame:
    """The page of each session with snippets: (session_id, rank, entry_id, role, ts, score, matched_terms, snippet, total, page_count, searched)."""
    return _shown(blocks, page(hits(blocks, r), r), r, ["session_id"])


def search_lineage(blocks: DataFrame, r: Recall, leaves: DataFrame | None = None) -> DataFrame:
    """As ``search``, over the entries from each session's root to its leaf only."""
    return search(blocks.join(lineage(blocks, leaves).select("session_id", "entry_id"), ["session_id", "entry_id"], "left_semi"), r)


def search_all(blocks: DataFrame, r: Recall) -> DataFrame:
    """The page over all sessions together: one ranking, one N and df."""
    return _shown(blocks, page_all(hits(blocks, r, "scope"), r), r, [])
