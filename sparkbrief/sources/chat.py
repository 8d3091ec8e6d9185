"""Chat lists and host rows as entries, and the digests that adapters make of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..schema import COLUMNS

_PART = "array<struct<type:string,text:string,content:string>>"
_CALL = "array<struct<id:string,function:struct<name:string,arguments:string>>>"


def text_of(content: Column) -> Column:
    """A text, or the texts of a list of parts put together."""
    parts = F.from_json(content, _PART)
    return F.when(content.startswith("[") & parts.isNotNull(), F.array_join(F.transform(parts, lambda p: F.coalesce(p["text"], p["content"], F.lit(""))), "")).otherwise(F.coalesce(content, F.lit("")))


def unwrapped(text: Column) -> Column:
    """A tool's text without the envelope that marks untrusted output, its preamble and its closing tag."""
    body = F.regexp_replace(text, r"(?s)\A\s*<untrusted_tool_result[^>]*>\s*", "")
    body = F.regexp_replace(body, r"(?s)\s*</untrusted_tool_result>\s*\z", "")
    return F.when(text.rlike(r"\A\s*<untrusted_tool_result"), body).otherwise(text)


def entries(messages: DataFrame, prefix: str = "m") -> DataFrame:
    """Blocks from chat messages (session_id, seq, message: JSON with role, content, tool_calls, tool_call_id, name).

    Users and assistants speak in text blocks, calls and results follow; arguments that are no JSON are kept under ``raw``.
    System messages and unknown roles are left out, as are assistants' messages without any block. Parents are linear.
    """
    j = lambda n: F.get_json_object("message", f"$.{n}")
    d = messages.select("session_id", "seq", j("role").alias("role0"), text_of(j("content")).alias("said"), F.from_json(j("tool_calls"), _CALL).alias("calls"), j("tool_call_id").alias("call"), j("name").alias("name"))
    d = d.where(F.col("role0").isin("user", "assistant", "tool"))
    none = F.lit(None).cast("string")

    def block(kind, text, call, name, arguments):
        return F.struct(F.lit(kind).alias("type"), text.alias("text"), call.alias("call_id"), name.alias("tool_name"), arguments.alias("arguments"))

    def arguments(c: Column) -> Column:
        raw = c["function"]["arguments"]
        return F.when(F.try_parse_json(raw).isNotNull(), raw).otherwise(F.to_json(F.struct(F.coalesce(raw, F.lit("")).alias("raw"))))

    spoken = F.when((F.col("said") != "") | (F.col("role0") == "user"), F.array(block("text", F.col("said"), none, none, none)))
    called = F.transform("calls", lambda c: block("toolCall", none, c["id"], c["function"]["name"], arguments(c)))
    empty = F.array().cast("array<struct<type:string,text:string,call_id:string,tool_name:string,arguments:string>>")
    blocks = F.when(F.col("role0") == "tool", F.array(block("toolResult", unwrapped(F.col("said")), F.col("call"), F.col("name"), none))).otherwise(F.concat(F.coalesce(spoken, empty), F.coalesce(called, empty)))
    d = d.withColumn("b", blocks).where(F.size("b") > 0).withColumn("entry_id", F.concat(F.lit(prefix), F.col("seq").cast("string")))
    d = d.withColumn("parent_id", F.lag("entry_id").over(Window.partitionBy("session_id").orderBy("seq")))
    d = d.select("session_id", "seq", "entry_id", "parent_id", F.when(F.col("role0") == "tool", "toolResult").otherwise(F.col("role0")).alias("role"), F.posexplode("b").alias("block_ix", "x"))
    d = d.select("session_id", "seq", "block_ix", "entry_id", "parent_id", F.lit("message").alias("kind"), "role", F.lit(None).cast("long").alias("ts"), "x.*", F.lit(False).alias("is_error"), none.alias("first_kept_id"), none.alias("summary"))
    return d.select(*COLUMNS)


def host_entries(rows: DataFrame) -> DataFrame:
    """Blocks from host rows (session_id, seq, role, text, tool_uses: array of {tool_use_id, tool, input}, tool_results: array of
    {tool_use_id, text, isError}). A row's results are entries ``m{i}:r{j}`` before it, named by the latest earlier use of their id."""
    none = F.lit(None).cast("string")
    head = ["session_id", "seq"]
    name = F.concat(F.lit("m"), F.col("seq").cast("string"))
    res = rows.select(*head, F.posexplode("tool_results").alias("j", "r"))
    res = res.select(*head, F.col("j").alias("order"), F.concat(name, F.lit(":r"), F.col("j").cast("string")).alias("entry_id"), F.lit("toolResult").alias("role"), F.lit(0).alias("block_ix"), F.lit("toolResult").alias("type"), F.col("r.text").alias("text"), F.col("r.tool_use_id").alias("call_id"), none.alias("tool_name"), none.alias("arguments"), F.coalesce("r.isError", F.lit(False)).alias("is_error"))
    at = F.size(F.coalesce("tool_results", F.array())).alias("order")
    said = rows.where("text <> ''").select(*head, at, name.alias("entry_id"), "role", F.lit(0).alias("block_ix"), F.lit("text").alias("type"), "text", none.alias("call_id"), none.alias("tool_name"), none.alias("arguments"), F.lit(False).alias("is_error"))
    used = rows.select(*head, at, name.alias("entry_id"), "role", F.posexplode("tool_uses").alias("k", "u"))
    used = used.select(*head, "order", "entry_id", "role", (F.col("k") + 1).alias("block_ix"), F.lit("toolCall").alias("type"), none.alias("text"), F.col("u.tool_use_id").alias("call_id"), F.col("u.tool").alias("tool_name"), F.coalesce("u.input", F.lit("null")).alias("arguments"), F.lit(False).alias("is_error"))
    d = res.unionByName(said).unionByName(used)
    before = Window.partitionBy("session_id", "call_id").orderBy("seq", "order").rowsBetween(Window.unboundedPreceding, -1)
    named = F.last(F.when(F.col("type") == "toolCall", F.col("tool_name")), ignorenulls=True).over(before)
    d = d.withColumn("tool_name", F.when(F.col("type") == "toolResult", F.coalesce(named, F.lit(""))).otherwise(F.col("tool_name")))
    d = d.withColumn("seq", F.dense_rank().over(Window.partitionBy("session_id").orderBy("seq", "order")).cast("long") - 1)
    parents = d.select("session_id", "seq", "entry_id").distinct().withColumn("parent_id", F.lag("entry_id").over(Window.partitionBy("session_id").orderBy("seq")))
    d = d.join(parents, ["session_id", "seq", "entry_id"])
    return d.withColumns({"kind": F.lit("message"), "ts": F.lit(None).cast("long"), "first_kept_id": none, "summary": none}).select(*COLUMNS)


def kept_index(entry: Column) -> Column:
    """The row of an entry id ``m12`` or ``m12:r0``; -1 for others."""
    n = F.regexp_extract(entry, r"\Am([0-9]+)(?::.*)?\z", 1)
    return F.when(n != "", n.cast("int")).otherwise(-1)


def latest_within(rows: DataFrame, budget: int, size: str = "bytes") -> DataFrame:
    """Of each session the last rows that fit into ``budget`` together: the first that does not fit ends the list."""
    back = Window.partitionBy("session_id").orderBy(F.desc("seq")).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("_run", F.sum(size).over(back)).where(F.col("_run") <= budget).drop("_run")


def tool_steps(blocks: DataFrame) -> DataFrame:
    """(session_id, steps): each tool with how often it was called, most often first."""
    c = blocks.where("type = 'toolCall'").groupBy("session_id", "tool_name").agg(F.count("*").alias("n"))
    c = c.groupBy("session_id").agg(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("k"), "tool_name", "n"))).alias("x"))
    return c.select("session_id", F.array_join(F.transform("x", lambda s: F.concat(s["tool_name"], F.lit(" ×"), s["n"].cast("string"))), ", ").alias("steps"))


def section_body(text: Column, heading: str) -> Column:
    """What stands between ``## heading`` and the next heading of that level."""
    return F.trim(F.regexp_extract(text, rf"(?s)(?:\A|\n)## {heading}[^\n]*\n(.*?)(?:\n## |\z)", 1))


def capped(summary: Column, budget: int, mark: str = "\n[summary truncated]") -> Column:
    """The summary in at most ``budget`` bytes, which count as 1 KiB at least and 64 KiB at most; a cut one ends with ``mark``."""
    from ..functions.text import truncate_bytes

    most = min(max(budget, 1024), 64 * 1024)
    return F.when(F.octet_length(summary) <= most, summary).otherwise(F.concat(truncate_bytes(summary, most - len(mark.encode())), F.lit(mark)))


def parse_instructions(text: str | None) -> dict:
    """``keep:N`` and ``policy:x`` anywhere in the text; the rest, without quotes around it, is the prompt."""
    import re

    keep = policy = None
    rest = []
    for word in (text or "").split():
        if m := re.fullmatch(r"keep:(\d+)", word):
            keep = int(m[1])
        elif m := re.fullmatch(r"policy:(\w+)", word):
            policy = m[1]
        else:
            rest.append(word)
    prompt = " ".join(rest)
    if len(prompt) > 1 and prompt[0] == prompt[-1] and prompt[0] in "\"'":
        prompt = prompt[1:-1]
    return {"keep": keep, "policy": policy, "prompt": prompt}
