"""What hosts and engines put around briefs: views of conversations, replacements of bulky results, composed summaries, notices.

All are expressions or joins over many sessions; texts that hosts look for are fixed.
"""

from __future__ import annotations

import json
import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import tokens, truncate_bytes
from ..sources.chat import section_body, text_of, unwrapped

#: Fixed headings of composed summaries.
BRIEF, USERS, REPLIES = "Brief", "What the user said", "What the agent replied"
#: Fixed start of a message that carries an earlier compaction.
CARRIER = "[CONTEXT COMPACTION"
POLICIES = {"auto": "auto", "vcc": "vcc", "vcc-only": "vcc", "snap": "snap", "snapcompact": "snap", "snap-compact": "snap"}


def policy_name(name: str) -> str | None:
    """The policy that a name in any case, or one of its other names, stands for."""
    return POLICIES.get(name.lower())


def sees_frames(mode: Column, reported: Column) -> Column:
    """Whether frames may be sent: ``on``, ``off``, and for ``auto`` what the model reports, which unreported is no."""
    return F.when(mode == "on", True).when(mode == "off", False).otherwise(F.coalesce(reported, F.lit(False)))


def previews(blocks: DataFrame, most: int) -> DataFrame:
    """(session_id, seq, preview): the start of each message's first text, else of its first tool result, else nothing."""
    of = lambda kind: F.min_by("text", F.when((F.col("type") == kind) & F.col("text").isNotNull(), F.col("block_ix")))
    d = blocks.where("kind = 'message'").groupBy("session_id", "seq").agg(of("text").alias("a"), of("toolResult").alias("b"), F.max((F.col("type") == "text").cast("int")).alias("says"), F.max((F.col("type") == "toolResult").cast("int")).alias("has"))
    first = F.when(F.col("says") == 1, F.col("a")).when(F.col("has") == 1, F.col("b"))
    return d.select("session_id", "seq", truncate_bytes(F.coalesce(first, F.lit("")), most).alias("preview"))


def without_markers(messages: DataFrame, custom_type: str) -> DataFrame:
    """Messages (session_id, seq, message) without the host's own marks: custom messages of that type."""
    j = lambda n: F.coalesce(F.get_json_object("message", f"$.{n}"), F.lit(""))
    return messages.where(~((j("role") == "custom") & (j("customType") == custom_type)))


def conversation_view(messages: DataFrame, tool_chars: int = 0) -> DataFrame:
    """What a brief is built from: (session_id, seq, role, text). Carriers of earlier compactions go; tool results stay only if characters are
    allowed for, and then that many; of an assistant's steps with calls the words stay, without them nothing."""
    j = lambda n: F.get_json_object("message", f"$.{n}")
    d = messages.select("session_id", "seq", j("role").alias("role"), text_of(j("content")).alias("text"), F.coalesce(F.size(F.from_json(j("tool_calls"), "array<string>")), F.lit(0)).alias("calls"))
    d = d.where(~F.ltrim("text").startswith(CARRIER))
    tool, step = F.col("role") == "tool", (F.col("role") == "assistant") & (F.col("calls") > 0)
    if tool_chars > 0:
        return d.withColumn("text", F.when(tool, F.left(unwrapped(F.col("text")), F.lit(tool_chars))).otherwise(F.col("text"))).drop("calls")
    said = F.trim(F.col("text"), F.lit(" \t\n\r"))
    return d.where(~tool & ~(step & (said == ""))).withColumn("text", F.when(step, said).otherwise(F.col("text"))).drop("calls")


def compose(brief: Column, intro: str = "Deterministic brief of the condensed turns, built locally. What is not shown here can be searched.") -> Column:
    """A brief under its heading and introduction."""
    return F.concat(F.lit(f"## {BRIEF}\n{intro}\n\n"), brief)


def carried(summary: Column, previous: Column, budget: int = 4000) -> Column:
    """The summary with the earlier one's quotes of the user, at most ``budget`` characters of them, below its own."""
    old, own = F.left(section_body(previous, USERS), F.lit(budget)), section_body(summary, USERS)
    at = F.instr(summary, own)
    joined = F.concat(F.substr(summary, F.lit(1), at + F.char_length(own) - 1), F.lit("\n\n"), old, F.substr(summary, at + F.char_length(own)))
    return F.when(F.coalesce(old, F.lit("")) == "", summary).when(own != "", joined).otherwise(F.concat(summary, F.lit(f"\n\n## {USERS}\n"), old))


def _short(n: Column, whole_from: int) -> Column:
    k = F.when(n >= whole_from, F.concat(F.round(n / 1000).cast("long").cast("string"), F.lit("k")))
    tenths = F.floor((n + 50) / 100)
    return k.when(n >= 1000, F.concat(F.floor(tenths / 10).cast("string"), F.lit("."), (tenths % 10).cast("string"), F.lit("k"))).otherwise(n.cast("long").cast("string"))


def notice(before: Column, after: Column, kept: Column, name: str = "sparkbrief") -> Column:
    """One line for people: sizes before and after, the signed change in percent, and the messages kept."""
    pct = F.round((after - before) / before * 100).cast("long")
    change = F.when((before > 0) & after.isNotNull(), F.when(pct <= 0, F.concat(F.lit(" (−"), F.abs(pct).cast("string"), F.lit("%)"))).otherwise(F.concat(F.lit(" (+"), pct.cast("string"), F.lit("%)")))).otherwise("")
    zero = lambda c: F.greatest(F.coalesce(c, F.lit(0)), F.lit(0))
    tail = F.when(kept.isNotNull(), F.concat(F.lit(" · kept "), kept.cast("string"), F.lit(" messages"))).otherwise("")
    return F.concat(F.lit(f"{name} · "), _short(zero(before), 10_000), F.lit(" → "), _short(zero(after), 10_000), F.lit(" tokens"), change, tail)


def guarded(text: Column, budget: int) -> Column:
    """The text, which has some bytes and at most ``budget``; else an error."""
    return F.when((F.octet_length(text) > 0) & (F.octet_length(text) <= budget), text).otherwise(F.raise_error(F.lit(f"output is empty or has more than {budget} bytes")))


def parse_recall(text: str) -> dict:
    """Options of a recall command: a JSON object, or words with ``name:value`` options among them; ``/pattern/`` is a regular expression."""
    if text.strip().startswith("{"):
        return json.loads(text)
    numbers = ("page", "perPage", "snippetBytes", "maxOutputBytes")
    names = ("scope", "role", "toolName", "afterEntry", "beforeEntry", *numbers)
    out: dict = {}
    words = []
    for word in re.split(r"(\s+)", text):
        name, colon, value = word.partition(":")
        if name in names and colon and value:
            if name in out:
                raise ValueError(f"option given twice: {name}")
            out[name] = float(value) if name in numbers and not value.isdigit() else int(value) if name in numbers else value
        else:
            words.append(word)
    query = re.sub(r"\s{2,}", " ", "".join(words)).strip()
    return out | ({"query": query[1:-1], "regex": True} if len(query) > 2 and query[0] == query[-1] == "/" else {"query": query})


def transcript_path(config: Column, home: Column, cwd: Column, session: Column, hidden: str) -> Column:
    """Where a host keeps a session's log: below its folder for projects, named by the working folder's path with dashes."""
    base = F.when(F.trim(F.coalesce(config, F.lit(""))) != "", config).otherwise(F.concat(home, F.lit(f"/{hidden}")))
    return F.concat(base, F.lit("/projects/"), F.regexp_replace(cwd, "[^A-Za-z0-9]", "-"), F.lit("/"), session, F.lit(".jsonl"))


_PARTS = "array<struct<type:string,text:string,image_url:struct<url:string>,file:struct<file_data:string>>>"


def file_parts(content: Column) -> Column:
    """A message's list of parts with pictures given as data turned into file parts; a struct of the parts as JSON and their number."""
    parts = F.from_json(content, _PARTS)
    is_picture = lambda p: (p["type"] == "image_url") & F.coalesce(p["image_url"]["url"].startswith("data:"), F.lit(False))
    none = F.lit(None)
    as_file = lambda p: F.struct(F.lit("file").alias("type"), none.cast("string").alias("text"), none.cast("struct<url:string>").alias("image_url"), F.struct(p["image_url"]["url"].alias("file_data")).alias("file"))
    return F.struct(F.to_json(F.transform(parts, lambda p: F.when(is_picture(p), as_file(p)).otherwise(p))).alias("parts"), F.size(F.filter(parts, is_picture)).alias("changed"))


def refuses_pictures(error: Column) -> Column:
    """Whether a provider's error says that it does not take pictures."""
    e = F.lower(F.coalesce(error, F.lit("")))
    return e.rlike("image|file") & e.rlike("must contain|invalid|not supported|unexpected")


def unseen(candidates: DataFrame, *caches: DataFrame) -> DataFrame:
    """Candidates (key, ...) that no cache (key) holds, each key once."""
    for cache in caches:
        candidates = candidates.join(cache.select("key"), "key", "left_anti")
    return candidates.dropDuplicates(["key"])


def newest(cache: DataFrame, most: int = 600) -> DataFrame:
    """The ``most`` entries of a cache (key, at) put in last."""
    return cache.orderBy(F.desc("at"), "key").limit(most)


def replaced(blocks: DataFrame, targets: DataFrame, cache: DataFrame, inline: bool = False) -> DataFrame:
    """Blocks after cached replacements: (session_id, seq, block_ix, place, type, text).

    ``cache``: (key, head, tail, frames: array of names). A tool result whose text has a key there keeps head and tail with a note of its
    frames between them; its frames, under a caption, follow in place (``inline``) or at the end of the message that ``targets`` (session_id,
    seq, target) names, in the order of the results. ``place`` orders what stands for a block.
    """
    keyed = blocks.where("kind = 'message'").withColumn("key", F.when((F.col("role") == "toolResult") & (F.col("type") == "toolResult"), F.substring(F.sha2("text", 256), 1, 32)))
    d = keyed.join(cache.select("key", "head", "tail", "frames"), "key", "left")
    hit = F.col("frames").isNotNull()
    some = F.size("frames") > 0
    note = F.when(some, F.concat(F.lit("\n["), F.size("frames").cast("string"), F.lit(" frame(s) hold the archived middle: "), F.array_join("frames", ", "), F.lit("]"))).otherwise("")
    own = d.select("session_id", "seq", "block_ix", F.array(F.lit(0), F.lit(0), F.lit(0)).cast("array<long>").alias("place"), "type", F.when(hit, F.concat("head", note, "tail")).otherwise(F.col("text")).alias("text"))
    shown = F.concat(F.array(F.struct(F.lit("text").alias("type"), F.lit("[archived output follows as frames, verbatim, read in order]").alias("text"))), F.transform("frames", lambda f: F.struct(F.lit("image").alias("type"), f.alias("text"))))
    moved = d.where(hit & some).select("session_id", "seq", "block_ix", F.posexplode(shown).alias("i", "x"))
    if not inline:
        moved = moved.join(targets.where("target is not null"), ["session_id", "seq"])
        moved = moved.select("session_id", F.col("target").alias("seq"), F.lit(1 << 30).alias("block_ix"), F.array("seq", F.col("block_ix").cast("long"), F.col("i").cast("long")).alias("place"), "x.*")
    else:
        moved = moved.select("session_id", "seq", "block_ix", F.array(F.lit(1), F.lit(0), F.col("i") + 1).cast("array<long>").alias("place"), "x.*")
    return own.unionByName(moved)


def edited_paths(blocks: DataFrame, tools: Sequence[str] = ("edit", "write", "multiedit")) -> DataFrame:
    """(session_id, path): the files that a session's calls have changed, each once."""
    path = F.coalesce(F.get_json_object("arguments", "$.file_path"), F.get_json_object("arguments", "$.path"))
    return blocks.where((F.col("type") == "toolCall") & F.lower("tool_name").isin(*tools)).select("session_id", path.alias("path")).where("path <> ''").distinct()


def renamed(blocks: DataFrame, names: DataFrame) -> DataFrame:
    """Copies of the sessions in ``names`` (session_id, new_id) under their new names."""
    return blocks.join(names, "session_id").withColumn("session_id", F.col("new_id")).drop("new_id").select(*blocks.columns)


def manifest(blocks: DataFrame, min_messages: int = 30, min_bytes: int = 160_000, most: int = 300) -> DataFrame:
    """(no, session_id, messages, bytes, sha256): the first sessions, by name, that are long enough, numbered, each with a hash of its
    messages' pieces in order. The hash tells whether a frozen session has changed; a session's pieces are hashed one by one first."""
    piece = F.sha2(F.concat_ws("\0", F.coalesce("role", F.lit("")), F.coalesce("type", F.lit("")), F.coalesce("text", F.lit("")), F.coalesce("arguments", F.lit(""))), 256)
    d = blocks.where("kind = 'message'").withColumn("bytes", F.octet_length(F.coalesce("text", "arguments", F.lit("")))).withColumn("piece", piece)
    d = d.groupBy("session_id").agg(F.countDistinct("seq").alias("messages"), F.sum("bytes").alias("bytes"), F.array_sort(F.collect_list(F.struct("seq", "block_ix", "piece"))).alias("p"))
    d = d.where((F.col("messages") >= min_messages) & (F.col("bytes") >= min_bytes)).select("session_id", "messages", "bytes", F.sha2(F.array_join("p.piece", ""), 256).alias("sha256"))
    # at most ``most`` rows are numbered
    return d.orderBy("session_id").limit(most).select(F.row_number().over(Window.orderBy("session_id")).alias("no"), "*")


def handover(view: DataFrame, brief: DataFrame, previous: DataFrame, replies: DataFrame, users: DataFrame, budget: int = 4000) -> DataFrame:
    """(session_id, summary, raw_tokens, summary_tokens): the brief of the conversation under its heading, then what the agent replied and what
    the user said, with the earlier summary's quotes carried on. Each input is (session_id, text) but ``view``, the messages. Three characters
    count as a token here."""
    raw = view.groupBy("session_id").agg(F.sum(F.char_length("text")).alias("raw"))
    one = lambda d, name: d.select("session_id", F.col("text").alias(name))
    d = raw.join(one(brief, "brief"), "session_id")
    for other, name in ((previous, "previous"), (replies, "replies"), (users, "users")):
        d = d.join(one(other, name), "session_id", "left")
    part = lambda name, title: F.when(F.coalesce(name, F.lit("")) != "", F.concat(F.lit(f"\n\n## {title}\n"), F.col(name))).otherwise("")
    d = d.withColumn("summary", F.concat(compose(F.col("brief")), part("replies", REPLIES), part("users", USERS)))
    d = d.withColumn("summary", carried(F.col("summary"), F.coalesce("previous", F.lit("")), budget))
    return d.select("session_id", "summary", tokens(F.col("raw"), 3).alias("raw_tokens"), tokens(F.char_length("summary"), 3).alias("summary_tokens"))
