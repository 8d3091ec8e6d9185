"""The brief: a transcript of the span that goes, the merge of sections with an earlier brief, rendering and parsing."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import argument, lines, truncate_bytes, utrim, utrim_end
from ..functions.udfs import canonical_json, debug_quote
from ..schema import SECTIONS, Transcript

#: Fixed titles of a brief's sections and the marks of its file lines, in the order in which they are shown.
TITLES = (("Session Goal", ("goal",)), ("Files And Changes", ("files_modified", "files_created", "files_read")), ("Commits", ("commits",)), ("Key Facts", ("key_facts",)), ("Outstanding Context", ("outstanding",)), ("User Preferences", ("preferences",)), ("Archived", ("archived",)))
FILE_MARKS = {"files_modified": "Modified: ", "files_created": "Created: ", "files_read": "Read: "}
#: Sections whose items count as equal whatever their case.
FOLDED = ("goal", "preferences", "key_facts")


def arguments_digest(name: Column, arguments: Column, most: int) -> Column:
    command = F.get_json_object(arguments, "$.command")
    path = argument(arguments, "path", "file_path")
    other = F.coalesce(arguments, F.lit("null"))
    return (
        F.when(name == "bash", F.when(command.isNull(), '""').otherwise(debug_quote(truncate_bytes(command, min(most, 160)))))
        .when(name.isin("read", "edit", "write"), F.when(path.isNull(), "").otherwise(debug_quote(path)))
        .otherwise(F.when(other == "null", "").otherwise(truncate_bytes(canonical_json(other), 80)))
    )


def result_digest(text: Column, is_error: Column, most: int) -> Column:
    t = utrim(F.coalesce(text, F.lit("")))
    first = F.regexp_extract(t, r"(?s)\A(.*?)(?:\r?\n|\z)", 1)
    return F.when(t == "", "(empty result)").otherwise(F.concat(F.lit("→ "), F.when(is_error, "ERROR ").otherwise(""), truncate_bytes(first, most)))


def call_references(blocks: DataFrame) -> DataFrame:
    """Calls and results with ``ref``: calls count up, a result has its latest earlier call's number or, without one, counts up itself."""
    d = blocks.where("kind = 'message' and ((role = 'assistant' and type = 'toolCall') or (role = 'toolResult' and type = 'toolResult'))")
    here = Window.partitionBy("session_id", "call_id").orderBy("seq", "block_ix").rowsBetween(Window.unboundedPreceding, -1)
    is_call = F.col("type") == "toolCall"
    place = F.when(is_call, F.struct("seq", "block_ix"))
    d = d.withColumn("call_at", F.when(is_call | (F.coalesce("call_id", F.lit("")) == ""), F.lit(None)).otherwise(F.last(place, ignorenulls=True).over(here)))
    run = Window.partitionBy("session_id").orderBy("seq", "block_ix").rowsBetween(Window.unboundedPreceding, 0)
    counts = is_call | F.col("call_at").isNull()
    d = d.withColumn("own", F.when(counts, F.sum(counts.cast("int")).over(run)))
    calls = d.where(is_call).select("session_id", F.struct("seq", "block_ix").alias("call_at"), F.col("own").alias("of_call"))
    d = d.join(calls, ["session_id", "call_at"], "left")
    return d.withColumn("ref", F.coalesce("own", "of_call")).withColumn("paired", F.col("of_call").isNotNull()).drop("own", "of_call", "call_at")


def transcript_lines(blocks: DataFrame, t: Transcript = Transcript()) -> DataFrame:
    """(session_id, seq, block_ix, ref, line) of all lines. User texts of a message make one line, other blocks one each."""
    user = blocks.where("kind = 'message' and role = 'user' and type = 'text'").groupBy("session_id", "seq")
    user = user.agg(F.min("block_ix").alias("block_ix"), F.array_join(F.array_sort(F.collect_list(F.struct("block_ix", F.coalesce("text", F.lit("")).alias("t"))))["t"], "\n").alias("text"))
    said = user.withColumn("who", F.lit("[user] ")).unionByName(blocks.where("kind = 'message' and role = 'assistant' and type = 'text'").select("session_id", "seq", "block_ix", "text", F.lit("[assistant] ").alias("who")))
    said = said.withColumn("text", utrim(F.col("text"))).where("text <> ''")
    said = said.select("session_id", "seq", "block_ix", F.lit("").alias("ref"), F.concat("who", truncate_bytes(F.col("text"), t.line_bytes)).alias("line"))
    d = call_references(blocks).withColumn("ref", F.concat(F.lit("#"), F.col("ref").cast("string")))
    name = F.coalesce("tool_name", F.lit(""))
    digest = result_digest(F.col("text"), F.coalesce("is_error", F.lit(False)), t.result_bytes)
    call = F.concat(F.lit("* "), name, F.lit(" "), arguments_digest(name, F.col("arguments"), t.line_bytes), F.lit(" ("), F.col("ref"), F.lit(")"))
    alone = F.concat(F.lit("* "), F.when(name == "", "tool").otherwise(name), F.lit(" result ("), F.col("ref"), F.lit(") "), digest)
    used = d.select("session_id", "seq", "block_ix", "ref", F.when(F.col("type") == "toolCall", call).when(F.col("paired"), digest).otherwise(alone).alias("line"))
    return said.unionByName(used)


def transcript_window(blocks: DataFrame, t: Transcript = Transcript()) -> DataFrame:
    """The last ``max_lines`` lines of each session, with how many there are and how many are left out."""
    d = transcript_lines(blocks, t)
    w = Window.partitionBy("session_id")
    d = d.withColumn("total", F.count("*").over(w)).withColumn("n", F.row_number().over(w.orderBy("seq", "block_ix")))
    d = d.withColumn("omitted", F.greatest(F.col("total") - t.max_lines, F.lit(0))).where(F.col("n") > F.col("omitted"))
    return d.select("session_id", (F.col("n") - F.col("omitted")).cast("int").alias("line_no"), "ref", "line", "total", "omitted")


def merge(previous: DataFrame, new: DataFrame) -> DataFrame:
    """Sections of an earlier brief and new ones: the earlier items first, each once; of what is outstanding only the new.

    Sessions without an earlier brief keep the new sections as they are.
    """
    had = previous.select("session_id").distinct()
    both = previous.where("section <> 'outstanding'").withColumn("gen", F.lit(0)).unionByName(new.withColumn("gen", F.lit(1)))
    key = F.when(F.col("section").isin(*FOLDED), F.lower("item")).otherwise(F.col("item"))
    w = Window.partitionBy("session_id", "section", "key").orderBy("gen", "ord")
    d = both.join(had.withColumn("had", F.lit(True)), "session_id", "left").withColumn("key", key).withColumn("nth", F.row_number().over(w))
    d = d.where((F.col("nth") == 1) | F.col("had").isNull() | (F.col("section") == "outstanding"))
    return d.withColumn("ord", F.row_number().over(Window.partitionBy("session_id", "section").orderBy("gen", "ord"))).select("session_id", "section", "ord", "item")


def parse_items(briefs: DataFrame) -> DataFrame:
    """Briefs (session_id, summary) -> (session_id, section, ord, item); a text without goal, modified file and commit gives nothing."""
    d = briefs.where("summary is not null").select("session_id", F.posexplode(lines(F.col("summary"))).alias("n", "raw")).withColumn("raw", utrim_end(F.col("raw")))
    head = F.col("raw").startswith("[") & F.col("raw").endswith("]") & (F.octet_length("raw") > 1) & ~F.col("raw").rlike(r"\A\[[a-z]+-archive")
    titled = F.when(head, F.expr("substring(raw, 2, char_length(raw) - 2)"))
    d = d.withColumn("title", F.last(titled, ignorenulls=True).over(Window.partitionBy("session_id").orderBy("n")))
    d = d.where(~head & (F.col("raw") != "") & ~F.col("raw").startswith("---")).withColumn("raw", F.regexp_replace("raw", r"\A- ", ""))
    section = F.lit(None).cast("string")
    item = F.col("raw")
    for title, names in TITLES:
        if len(names) == 1 and names[0] != "outstanding":
            section = F.when(F.col("title") == title, names[0]).otherwise(section)
    for name, mark in FILE_MARKS.items():
        hit = (F.col("title") == "Files And Changes") & F.col("raw").startswith(mark)
        section = F.when(hit, name).otherwise(section)
        item = F.when(hit, F.substr(F.col("raw"), F.lit(len(mark) + 1))).otherwise(item)
    d = d.select("session_id", "n", section.alias("section"), item.alias("item")).where("section is not null")
    real = d.where(F.col("section").isin("goal", "files_modified", "commits")).select("session_id").distinct()
    d = d.join(real, "session_id", "left_semi")
    return d.withColumn("ord", F.row_number().over(Window.partitionBy("session_id", "section").orderBy("n"))).select("session_id", "section", "ord", "item")


def present(sections: DataFrame, windows: DataFrame | None = None) -> DataFrame:
    """(session_id, sections): the titles that a brief would show, in order."""
    names = [t for t, _ in TITLES[:-1]] + ["Transcript"]
    title = F.lit(None).cast("string")
    for t, keys in TITLES:
        title = F.when(F.col("section").isin(*keys), t).otherwise(title)
    d = sections.select("session_id", title.alias("title")).distinct()
    if windows is not None:
        d = d.unionByName(windows.select("session_id", F.lit("Transcript").alias("title")).distinct())
    order = F.array(*map(F.lit, names))
    return d.groupBy("session_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.array_position(order, F.col("title")).alias("k"), "title"))), lambda x: x["title"]), ", ").alias("sections"))


def render(sections: DataFrame, windows: DataFrame, recall_name: str = "recall", end: Callable[[Column], Column] = utrim_end) -> DataFrame:
    """(session_id, summary): the text of each session's brief. ``end`` trims what its last line, which may be cut anywhere, ends with."""
    rows = None
    for k, (title, names) in enumerate(TITLES):
        for j, name in enumerate(names):
            d = sections.where(F.col("section") == name).select("session_id", F.lit(k).alias("k"), F.lit(j).alias("j"), "ord", F.lit(title).alias("title"), F.concat(F.lit("- " + FILE_MARKS.get(name, "")), "item").alias("line"))
            rows = d if rows is None else rows.unionByName(d)
    t = windows.select("session_id", F.lit(len(TITLES)).alias("k"), F.lit(0).alias("j"), F.col("line_no").alias("ord"), F.lit("Transcript").alias("title"), "line")
    note = windows.where("omitted > 0").select("session_id", "omitted").distinct()
    t = t.unionByName(note.select("session_id", F.lit(len(TITLES)).alias("k"), F.lit(0).alias("j"), F.lit(0).alias("ord"), F.lit("Transcript").alias("title"), F.format_string(f"- (%d earlier lines omitted; full history recoverable via {recall_name})", "omitted").alias("line")))
    rows = rows.unionByName(t)
    part = rows.groupBy("session_id", "k", "title").agg(F.array_join(F.array_sort(F.collect_list(F.struct("j", "ord", "line")))["line"], "\n").alias("body"))
    part = part.withColumn("body", F.concat(F.lit("["), "title", F.lit("]\n"), "body"))
    return part.groupBy("session_id").agg(end(F.array_join(F.array_sort(F.collect_list(F.struct("k", "body")))["body"], "\n\n")).alias("summary"))
