"""What a span of a session is about: goal, files, commits, diagnostics, failures and preferences, by fixed rules.

Each extractor gives (session_id, section, ord, item); a session's extractors are unions of exploded blocks with caps by rank.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import argument, collapse, lines, short_path, truncate_bytes, utrim, utrim_end

# Phrases, tool names and limits that define the sections.
SCOPE_CHANGE = ("actually, ", "wait,", "instead of", "scratch that", "change of plan", "also ", "additionally,", "one more thing", "new requirement")
PREFERENCE = ("always ", "never ", "prefer ", "make sure to ", "don't use ", "do not use ", "keep it ")
SEVERITY = ("fatal", "error", "err!", "warn", "warning", "panic", "failed", "failure")
SOURCE_READ = ("read", "view", "cat", "read_file", "readfile", "read_file_content")
MAX_FILES, MAX_COMMITS, MAX_OUTSTANDING, MAX_PREFERENCES, MAX_FACTS, MAX_FACTS_RESULT, MAX_SCOPE = 24, 8, 8, 8, 10, 4, 3
SCAN_BYTES, LINE_BYTES = 32 * 1024, 240

_WORDISH = r"[A-Za-z0-9_./\\]"
_SEV = rf"(?<!{_WORDISH})(?:{'|'.join(sorted(SEVERITY, key=len, reverse=True))})(?!{_WORDISH})"
_CODE = r"(?<![A-Za-z0-9_])(?:ts|e|err)[0-9]{3,}(?![A-Za-z0-9_])"
_LEVELS = "|".join(SEVERITY)


def user_texts(blocks: DataFrame) -> DataFrame:
    """(session_id, seq, text, nth) of user messages with text, numbered from 1."""
    d = blocks.where("kind = 'message' and role = 'user' and type = 'text'")
    d = d.groupBy("session_id", "seq").agg(F.array_join(F.array_sort(F.collect_list(F.struct("block_ix", F.coalesce("text", F.lit("")).alias("t"))))["t"], "\n").alias("text")).where("text <> ''")
    return d.withColumn("nth", F.row_number().over(Window.partitionBy("session_id").orderBy("seq")))


def is_scope_change(text: Column) -> Column:
    t = utrim(text)
    low = F.lower(t)
    starts = reduce(lambda a, b: a | b, (low.startswith(p) | low.contains(f". {p}") for p in SCOPE_CHANGE))
    return starts & (F.octet_length(t) > 8)


def _section(d: DataFrame, name: str, order: list, item: Column, most: int | None = None) -> DataFrame:
    d = d.withColumn("_item", item).withColumn("ord", F.row_number().over(Window.partitionBy("session_id").orderBy(*order)))
    return (d if most is None else d.where(F.col("ord") <= most)).select("session_id", F.lit(name).alias("section"), "ord", F.col("_item").alias("item"))


def _first_of(d: DataFrame, by: list[str], key: Column, order: list) -> DataFrame:
    """Of rows with the same key the first; order of the rest is kept."""
    w = Window.partitionBy(*by, "_key").orderBy(*order)
    return d.withColumn("_key", key).withColumn("_nth", F.row_number().over(w)).where("_nth = 1").drop("_key", "_nth")


def goal(blocks: DataFrame) -> DataFrame:
    u = user_texts(blocks)
    first = u.where("nth = 1").select("session_id", F.lit(0).cast("long").alias("seq"), truncate_bytes(utrim(F.col("text")), 1400).alias("item")).where("item <> ''")
    return _section(first.unionByName(scope_changes(blocks).select("session_id", (F.col("ord") + 1).cast("long").alias("seq"), F.concat(F.lit("[Scope change] "), F.col("item")).alias("item"))), "goal", ["seq"], F.col("item"))


def scope_changes(blocks: DataFrame) -> DataFrame:
    u = user_texts(blocks).where("nth > 1").where(is_scope_change(F.col("text")))
    return _section(u, "scope_change", ["seq"], truncate_bytes(utrim(F.col("text")), 220), MAX_SCOPE)


def preferences(blocks: DataFrame) -> DataFrame:
    d = user_texts(blocks).select("session_id", "seq", F.posexplode(lines(F.col("text"))).alias("line", "raw")).withColumn("raw", utrim(F.col("raw")))
    low = F.lower("raw")
    hit = reduce(lambda a, b: a | b, (low.startswith(p) for p in PREFERENCE))
    d = d.where(hit & F.octet_length("raw").between(8, 200))
    return _section(_first_of(d, ["session_id"], collapse(F.col("raw")), ["seq", "line"]), "preferences", ["seq", "line"], F.col("raw"), MAX_PREFERENCES)


def _calls(blocks: DataFrame, tool_name_case: str = "exact") -> DataFrame:
    name = F.lower("tool_name") if tool_name_case == "fold" else F.col("tool_name")
    return blocks.where("kind = 'message' and role = 'assistant' and type = 'toolCall'").withColumn("tool_name", name)


def files(blocks: DataFrame, tool_name_case: str = "exact") -> DataFrame:
    """Distinct paths by what was done to them, in byte order, 24 of each."""
    kind = F.when(F.col("tool_name") == "edit", "files_modified").when(F.col("tool_name") == "write", "files_created").when(F.col("tool_name") == "read", "files_read")
    d = _calls(blocks, tool_name_case).select("session_id", kind.alias("section"), short_path(argument(F.col("arguments"), "path", "file_path", "filePath")).alias("item"))
    d = d.where("section is not null and item is not null").distinct()
    d = d.withColumn("ord", F.row_number().over(Window.partitionBy("session_id", "section").orderBy("item")))
    return d.where(F.col("ord") <= MAX_FILES).select("session_id", "section", "ord", "item")


def commits(blocks: DataFrame, tool_name_case: str = "exact") -> DataFrame:
    """The messages of commit commands, newest first, 8."""
    d = _calls(blocks, tool_name_case).where("tool_name = 'bash'").select("session_id", "seq", "block_ix", F.get_json_object("arguments", "$.command").alias("command"))
    d = d.where(F.lower("command").contains("git commit")).select("session_id", "seq", "block_ix", F.posexplode(lines(F.col("command"))).alias("line", "raw"))
    d = d.withColumn("raw", utrim(F.col("raw"))).where(F.lower("raw").contains("git commit"))
    message = F.regexp_replace(utrim(F.coalesce(F.get(F.split("raw", "-m", -1), 1), F.lit(""))), "^[\"']+|[\"']+\\z", "")
    item = F.when(message == "", truncate_bytes(F.col("raw"), 120)).otherwise(F.concat(F.lit("commit: "), message))
    return _section(d, "commits", [F.desc("seq"), F.desc("block_ix"), F.desc("line")], item, MAX_COMMITS)


def results(blocks: DataFrame) -> DataFrame:
    return blocks.where("kind = 'message' and role = 'toolResult' and type = 'toolResult'").select("session_id", "seq", "block_ix", F.coalesce("text", F.lit("")).alias("text"), F.coalesce("tool_name", F.lit("")).alias("tool_name"), F.coalesce("is_error", F.lit(False)).alias("is_error"))


def looks_failed(text: Column) -> Column:
    """Short results that speak of failure; long ones are not lower-cased."""
    low = F.when(F.octet_length(text) < 20_000, F.lower(text))
    return F.coalesce(low.contains("error") | low.contains("failed") | low.contains("panic") | low.contains("fatal"), F.lit(False))


def outstanding(blocks: DataFrame) -> DataFrame:
    """Of each failed result the first line that says so; distinct, 8."""

    def says(line: Column) -> Column:
        low = F.lower(line)
        return (low.contains("error") | low.contains("failed") | low.contains("cannot")) & (F.octet_length(line) >= 12)

    d = results(blocks).where(F.col("is_error") | looks_failed(F.col("text")))
    d = d.withColumn("hit", F.get(F.filter(F.transform(lines(F.col("text")), utrim), says), 0)).where("hit is not null")
    d = d.withColumn("hit", truncate_bytes(F.col("hit"), 240))
    return _section(_first_of(d, ["session_id"], collapse(F.col("hit")), ["seq", "block_ix"]), "outstanding", ["seq", "block_ix"], F.col("hit"), MAX_OUTSTANDING)


def scan_window(text: Column) -> Column:
    """The parts of a result to look into: all of a short one, else whole lines of its first and of its last 16 KiB."""
    raw, half = text.cast("binary"), SCAN_BYTES // 2
    head = truncate_bytes(text, half)
    head = F.when(F.instr(head, "\n") > 0, F.regexp_replace(head, r"\n[^\n]*\z", "")).otherwise("")
    tail = F.substring(raw, -(half + 1), half + 1)
    # as single bytes: whole lines after the first newline, which may be the byte before the window
    after = F.instr(F.decode(tail, "ISO-8859-1"), "\n")
    tail = F.when(after > 0, F.decode(F.substr(tail, after + 1), "UTF-8")).otherwise("")
    return F.when(F.octet_length(text) <= SCAN_BYTES, F.array(text)).otherwise(F.filter(F.array(head, tail), lambda x: x != ""))


def is_diagnostic(low: Column, strict: Column) -> Column:
    """A lower-cased line with a severity and a code. Successful source reads (``strict``) must have it in an anchored form, outside quotes and comments."""
    before = F.regexp_extract(low, rf"(?s)\A(.*?)(?:{_SEV})", 1)
    dashed = (F.regexp_count(low, F.lit("-")) >= 2) & low.rlike("[0-9]")
    code = low.contains("code=") | low.contains("code ") | low.contains("code:") | dashed | low.rlike(_CODE)
    quotes = reduce(lambda a, b: a | b, ((F.octet_length(before) - F.octet_length(F.replace(before, F.lit(q), F.lit("")))) % 2 == 1 for q in ('"', "'", "`")))
    comment = low.startswith("//") | low.startswith("/*") | low.startswith("*")
    first = F.regexp_replace(F.regexp_extract(low, r"(?U)\A\s*(\S*)", 1), ":+\\z", "")
    date = F.regexp_replace(F.regexp_replace(utrim(before), r"\A\[+", ""), r"\]+\z", "")
    anchored = (
        low.rlike(rf"(?U)\A(?:{_LEVELS})(?::|\s)") | low.startswith("npm err!") | utrim_end(before).rlike(r"[):-]\z")
        | first.rlike(_CODE) | first.rlike(r"\A[a-z]{1,5}-[0-9]{2,}-[a-z0-9_-]+\z")
        | low.rlike(rf"(?U)\A\[(?:{_LEVELS})\](?::|\s)") | date.rlike(r"\A[0-9]{4}-[0-9]{2}-[0-9]{2}[0-9tz:+. -]*\z")
    )
    return low.rlike(_SEV) & code & (~strict | (~comment & ~quotes & anchored))


def diagnostic_lines(blocks: DataFrame) -> DataFrame:
    """(session_id, seq, block_ix, place, item): all diagnostic lines of each result, by ``place``: last lines first in long results."""
    d = results(blocks).withColumn("long", F.octet_length("text") > SCAN_BYTES).withColumn("strict", F.lower(utrim(F.col("tool_name"))).isin(*SOURCE_READ) & ~F.col("is_error"))
    d = d.select("session_id", "seq", "block_ix", "long", "strict", F.posexplode(F.flatten(F.transform(scan_window(F.col("text")), lines))).alias("line", "raw"))
    d = d.withColumn("raw", utrim(F.col("raw"))).where(F.octet_length("raw").between(10, LINE_BYTES))
    d = d.where(is_diagnostic(F.lower("raw"), F.col("strict")))
    return d.select("session_id", "seq", "block_ix", F.when(F.col("long"), -F.col("line")).otherwise(F.col("line")).alias("place"), F.col("raw").alias("item"))


def facts_by_result(blocks: DataFrame) -> DataFrame:
    """The first 4 distinct diagnostic lines of each result."""
    by = ["session_id", "seq", "block_ix"]
    d = _first_of(diagnostic_lines(blocks), by, collapse(F.col("item")), ["place"])
    return d.withColumn("nth", F.row_number().over(Window.partitionBy(*by).orderBy("place"))).where(F.col("nth") <= MAX_FACTS_RESULT).select(*by, "nth", "item")


def key_facts(blocks: DataFrame) -> DataFrame:
    d = _first_of(facts_by_result(blocks), ["session_id"], collapse(F.col("item")), ["seq", "block_ix", "nth"])
    return _section(d, "key_facts", ["seq", "block_ix", "nth"], F.col("item"), MAX_FACTS)


def extract(blocks: DataFrame, tool_name_case: str = "exact") -> DataFrame:
    """All sections of a span: (session_id, section, ord, item)."""
    parts = [goal(blocks), files(blocks, tool_name_case), commits(blocks, tool_name_case), key_facts(blocks), outstanding(blocks), preferences(blocks)]
    return reduce(DataFrame.unionByName, parts)
