"""Session logs in JSON lines, read into the block model: tree logs with a session header, and transcripts of linked records.

Files are read as text lines, so a log of any size is split over tasks; ``seq`` is a line's place in its file. Reading is
tolerant unless ``strict``: then violations raise, except for a torn last line.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import role_name
from ..operators.tree import KEY, check, cut_reanchored, orphans_to_roots
from ..schema import COLUMNS

_J = F.get_json_object


def text_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, seq, raw): lines with their place, in order of files' bytes."""
    d = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("b"), F.monotonically_increasing_id().alias("i"), F.col("value").alias("raw"))
    return d.withColumn("seq", F.row_number().over(Window.partitionBy("file").orderBy("b", "i")).cast("long") - 1).select("file", "seq", "raw").where(F.trim("raw") != "")


def result_text(content: Column) -> Column:
    """The text of a tool result: a string, the texts of a list a line each, or an object's text."""
    parts = F.transform(F.from_json(content, "array<string>"), lambda p: F.coalesce(_J(p, "$.text"), F.when(~p.startswith("{"), p)))
    return F.when(content.startswith("["), F.array_join(F.filter(parts, lambda p: p.isNotNull()), "\n")).when(content.startswith("{"), F.coalesce(_J(content, "$.text"), F.lit(""))).otherwise(F.coalesce(content, F.lit("")))


def _first(b: Column, *names: str) -> Column:
    return F.coalesce(*(_J(b, f"$.{n}") for n in names))


def block(b: Column) -> Column:
    """A content block in any of its spellings as (type, text, call_id, tool_name, arguments, is_error)."""
    kind = _J(b, "$.type")
    call = kind.isin("toolCall", "tool_call", "toolUse", "tool_use")
    result = kind.isin("toolResult", "tool_result")
    return F.struct(
        F.when(kind.isin("text", "thinking", "image"), kind).when(call, "toolCall").when(result, "toolResult").otherwise("other").alias("type"),
        F.when(result, result_text(_J(b, "$.content"))).when(kind == "thinking", _first(b, "text")).otherwise(_J(b, "$.text")).alias("text"),
        F.when(call, _first(b, "id", "toolCallId", "tool_call_id")).when(result, _first(b, "toolCallId", "tool_call_id", "toolUseId", "tool_use_id")).alias("call_id"),
        F.coalesce(_first(b, "name", "toolName", "tool_name"), F.lit("")).alias("tool_name"),
        F.when(call, F.coalesce(_first(b, "arguments", "input"), F.lit("null"))).alias("arguments"),
        F.coalesce(_first(b, "isError", "is_error") == "true", F.lit(False)).alias("is_error"),
    )


def content_blocks(content: Column) -> Column:
    """A string as one text block, a list as its objects that have a type."""
    plain = F.array(F.to_json(F.struct(F.lit("text").alias("type"), content.alias("text"))))
    listed = F.filter(F.from_json(content, "array<string>"), lambda x: _J(x, "$.type").isNotNull())
    return F.transform(F.when(content.isNull(), F.array().cast("array<string>")).when(content.startswith("[") & listed.isNotNull(), listed).otherwise(plain), block)


def _as_result(blocks: Column, message: Column) -> Column:
    """A tool message without a result block has its texts joined into one."""
    one = F.struct(
        F.lit("toolResult").alias("type"), F.array_join(F.transform(F.filter(blocks, lambda b: b["type"] == "text"), lambda b: F.coalesce(b["text"], F.lit(""))), "\n").alias("text"), _first(message, "toolCallId", "tool_call_id").alias("call_id"),
        F.coalesce(_first(message, "toolName", "tool_name"), F.lit("")).alias("tool_name"), F.lit(None).cast("string").alias("arguments"), F.coalesce(_first(message, "isError", "is_error") == "true", F.lit(False)).alias("is_error"),
    )
    return F.when(F.exists(blocks, lambda b: b["type"] == "toolResult"), blocks).otherwise(F.array(one))


def _blocks_of(entries: DataFrame) -> DataFrame:
    """Entries with an array ``content`` as block rows; an entry without content is one row without a type."""
    d = entries.select("session_id", "seq", "entry_id", "parent_id", "kind", "role", "ts", "first_kept_id", "summary", F.posexplode_outer("content").alias("block_ix", "x"))
    return d.select("session_id", "seq", F.coalesce("block_ix", F.lit(0)).alias("block_ix"), "entry_id", "parent_id", "kind", "role", "ts", "x.*", "first_kept_id", "summary").select(*COLUMNS)


def read_tree(spark: SparkSession, path: str, strict: bool = False) -> DataFrame:
    """Tree logs: a header with the session's id, then entries with ``id`` and ``parentId``."""
    rows = text_lines(spark, path)
    bad = F.try_parse_json("raw").isNull() | ~F.ltrim(F.col("raw")).startswith("{")
    if strict:
        last = rows.groupBy("file").agg(F.max("seq").alias("last"))
        marked = rows.join(last, "file").withColumn("kind", _J("raw", "$.type"))
        wrong = (bad & (F.col("seq") < F.col("last"))) | (~bad & (F.col("kind").isNull() | ((F.col("kind") == "session") != (F.col("seq") == 0)) | ((F.col("seq") > 0) & F.coalesce(_J("raw", "$.id") == "", F.lit(True)))))
        if row := marked.where(wrong).select("file", "seq").first():
            raise ValueError(f"line {row.seq + 1} of {row.file} is no valid entry")
    rows = rows.where(~bad)
    ids = rows.where(_J("raw", "$.type") == "session").groupBy("file").agg(F.min_by(_J("raw", "$.id"), "seq").alias("header"))
    d = rows.join(ids, "file", "left").where((_J("raw", "$.type") != "session") & _J("raw", "$.type").isNotNull())
    m = F.coalesce(_J("raw", "$.message"), F.col("raw"))
    kind = _J("raw", "$.type")
    role = F.when(kind == "message", role_name(F.coalesce(_J(m, "$.role"), F.lit(""))))
    content = content_blocks(_J(m, "$.content"))
    d = d.select(
        F.coalesce("header", F.regexp_extract("file", r"([^/]*?)(?:\.[^./]*)?\z", 1)).alias("session_id"), "seq", F.coalesce(_J("raw", "$.id"), F.concat(F.lit("m"), F.col("seq").cast("string"))).alias("entry_id"), _J("raw", "$.parentId").alias("parent_id"),
        F.when(kind.isin("message", "compaction"), kind).otherwise("other").alias("kind"), role.alias("role"), F.coalesce(_J("raw", "$.timestamp"), _J(m, "$.timestamp")).try_cast("long").alias("ts"),
        F.when(role == "toolResult", _as_result(content, m)).when(role.isNotNull(), content).alias("content"), F.when(kind == "compaction", _J("raw", "$.firstKeptEntryId")).alias("first_kept_id"), F.when(kind == "compaction", _J("raw", "$.summary")).alias("summary"),
    )
    out = _blocks_of(d)
    if strict:
        check(out)
    return out


def epoch_seconds(c: Column) -> Column:
    """Seconds of an ISO time; offsets and fractions do not count. Hours and minutes are taken as written, days up to 31."""
    n = lambda i: F.regexp_extract(c, r"\A([0-9]{4})-(0[1-9]|1[0-2])-(0[1-9]|[12][0-9]|3[01])[Tt ]([0-9]{2}):([0-9]{2}):([0-9]{2})", i).try_cast("int")
    days = F.datediff(F.make_date(n(1), n(2), F.lit(1)), F.lit("1970-01-01").cast("date")) + n(3) - 1
    return days.cast("long") * 86_400 + n(4) * 3600 + n(5) * 60 + n(6)


def read_transcripts(spark: SparkSession, path: str) -> DataFrame:
    """Transcripts: records keyed ``uuid`` with ``parentUuid``, else ``logicalParentUuid``.

    Malformed lines, summaries, records without a uuid and side chains are left out; of records that share a uuid the first
    stays; a parent that is unknown makes a root; a logical parent that stands among a record's own descendants is no parent; meta records
    link the tree but hold no message.
    """
    rows = text_lines(spark, path).where(F.try_parse_json("raw").isNotNull() & F.col("raw").startswith("{"))
    named = rows.groupBy("file").agg(F.min_by(_J("raw", "$.sessionId"), F.when(F.coalesce(_J("raw", "$.sessionId"), F.lit("")) != "", F.col("seq"))).alias("header"))
    kind = _J("raw", "$.type")
    d = rows.where((kind != "summary") & (F.coalesce(_J("raw", "$.uuid"), F.lit("")) != "") & ~F.coalesce(_J("raw", "$.isSidechain") == "true", F.lit(False))).join(named, "file", "left")
    d = d.withColumn("session_id", F.coalesce(F.nullif("header", F.lit("")), F.regexp_extract("file", r"([^/]*?)(?:\.[^./]*)?\z", 1))).withColumn("entry_id", _J("raw", "$.uuid"))
    d = d.withColumn("nth", F.row_number().over(Window.partitionBy(*KEY).orderBy("seq"))).where("nth = 1")
    d = d.withColumn("parent_id", F.coalesce(F.nullif(_J("raw", "$.parentUuid"), F.lit("")), F.nullif(_J("raw", "$.logicalParentUuid"), F.lit(""))))
    d = d.withColumn("logical", F.coalesce(_J("raw", "$.parentUuid"), F.lit("")) == "")
    parents = orphans_to_roots(cut_reanchored(d.select(*KEY, "seq", "parent_id", F.col("logical") & F.col("parent_id").isNotNull()).toDF(*KEY, "seq", "parent_id", "logical"))).select(*KEY, "parent_id")
    d = d.drop("parent_id").join(parents, KEY)
    content = content_blocks(_J("raw", "$.message.content"))
    results = F.forall(content, lambda b: b["type"] == "toolResult") & (F.size(content) > 0)
    said = F.coalesce(_J("raw", "$.content"), F.lit(""))
    system = (kind == "system") & (F.coalesce(_J("raw", "$.subtype"), F.lit("")) != "compact_boundary") & (said != "")
    meta = F.coalesce(_J("raw", "$.isMeta") == "true", F.lit(False))
    role = F.when(meta, None).when(system, "system").when((kind == "user") & results, "toolResult").when(kind.isin("user", "assistant"), kind)
    d = d.select(
        "session_id", "seq", "entry_id", "parent_id", F.when(role.isNotNull(), "message").otherwise("other").alias("kind"), role.alias("role"), epoch_seconds(_J("raw", "$.timestamp")).alias("ts"),
        F.when(system & ~meta, content_blocks(said)).when(role.isNotNull(), content).alias("content"), F.lit(None).cast("string").alias("first_kept_id"), F.lit(None).cast("string").alias("summary"),
    )
    d = _blocks_of(d)
    before = Window.partitionBy("session_id", "call_id").orderBy("seq", "block_ix").rowsBetween(Window.unboundedPreceding, -1)
    name = F.last(F.when(F.col("type") == "toolCall", F.col("tool_name")), ignorenulls=True).over(before)
    named_result = (F.col("type") == "toolResult") & (F.coalesce("call_id", F.lit("")) != "")
    return d.withColumn("tool_name", F.when(named_result, F.coalesce(name, F.lit(""))).otherwise(F.col("tool_name")))


def malformed(spark: SparkSession, path: str) -> DataFrame:
    """(file, n): lines that are no JSON objects."""
    return text_lines(spark, path).groupBy("file").agg(F.count_if(F.try_parse_json("raw").isNull() | ~F.col("raw").startswith("{")).alias("n"))


def sniff(spark: SparkSession, path: str) -> str:
    """``transcript`` if the first line that is not blank is such a record, else ``tree``."""
    place = [F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_block_start").alias("b"), F.monotonically_increasing_id().alias("i")]
    lines = spark.read.text(path).select(*place, "value").where(F.trim("value") != "").orderBy("f", "b", "i").limit(1)
    row = lines.select(_J("value", "$.uuid").alias("u"), _J("value", "$.sessionId").alias("s"), _J("value", "$.type").alias("t")).first()
    return "transcript" if row and row.t not in (None, "session") and (row.u or row.s) else "tree"


def read(spark: SparkSession, path: str, form: str | None = None, strict: bool = False) -> DataFrame:
    form = form or sniff(spark, path)
    if form not in ("tree", "transcript"):
        raise ValueError(f"unknown form: {form}")
    return read_tree(spark, path, strict) if form == "tree" else read_transcripts(spark, path)
