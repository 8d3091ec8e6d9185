"""What hosts put around briefs, over the derived log."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import adapters, brief, evaluate, frames, sections
from ..plans import compact
from ..schema import Compact, Transcript
from ..sources import derived, snapshots
from . import registry
from .sections import _FACTS, _cut
from .sessions import _CUT, _LIVE
from .streams import _folder

QUERIES, ORACLES, register = registry()

_LOG = f"WITH {derived.BLOCKS_SQL},"


@register(f"""{_LOG} m AS (SELECT session_id, seq, coalesce(CASE WHEN type IN ('text', 'toolResult') THEN text END, '') AS t FROM blocks WHERE kind = 'message') SELECT session_id, seq, {_cut('t', 80)} AS preview FROM m""")
def message_previews(spark, sf_dir):
    return adapters.previews(derived.blocks(spark, sf_dir), 80)


def _messages(spark, sf_dir):
    """The tool log as chat messages: texts, calls with a word before them in every third, results; some carry an earlier compaction."""
    b = derived.tools(spark, sf_dir).where("kind = 'message'")
    said = F.when(F.col("type") == "toolCall", F.when(F.col("seq") % 3 == 0, F.concat(F.lit(" now "), "tool_name", F.lit(" ")))).when(F.col("seq") % 7 == 0, F.concat(F.lit("[CONTEXT COMPACTION] "), "text")).otherwise(F.col("text"))
    calls = F.when(F.col("type") == "toolCall", F.array(F.struct(F.col("call_id").alias("id"), F.struct(F.col("tool_name").alias("name"), "arguments").alias("function"))))
    role = F.when(F.col("role") == "toolResult", "tool").otherwise(F.col("role"))
    kind = F.when(F.col("seq") % 11 == 0, "mark")
    return b.select("session_id", "seq", F.to_json(F.struct(role.alias("role"), said.alias("content"), calls.alias("tool_calls"), kind.alias("customType"))).alias("message"))


_VIEW = f"""{_LOG} b AS (SELECT session_id, seq, CASE role WHEN 'toolResult' THEN 'tool' ELSE role END AS role, CASE WHEN type = 'toolCall' THEN CASE WHEN seq % 3 = 0 THEN ' now ' || tool_name || ' ' ELSE '' END WHEN seq % 7 = 0 THEN '[CONTEXT COMPACTION] ' || text ELSE text END AS said, type = 'toolCall' AS step
    FROM blocks WHERE kind = 'message' AND session_id LIKE 'u%'), v AS (SELECT * FROM b WHERE NOT starts_with(ltrim(said), '[CONTEXT COMPACTION'))"""


@register(f"{_VIEW} SELECT session_id, seq, role, CASE WHEN step THEN trim(said) ELSE said END AS text FROM v WHERE role <> 'tool' AND NOT (step AND trim(said) = '')")
def conversation_view(spark, sf_dir):
    return adapters.conversation_view(_messages(spark, sf_dir))


@register(f"{_VIEW} SELECT session_id, seq, role, CASE WHEN role = 'tool' THEN left(said, 12) ELSE said END AS text FROM v")
def conversation_view_with_tools(spark, sf_dir):
    return adapters.conversation_view(_messages(spark, sf_dir), 12)


@register("""SELECT 'c' || CAST(conv_id AS VARCHAR) AS session_id, CAST(turn AS BIGINT) AS seq FROM conversations WHERE NOT (turn % 4 = 1 AND turn % 3 = 1)""")
def marker_filter(spark, sf_dir):
    """Conversations in which some messages are custom, and some of those a host's own mark."""
    d = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    role = F.when(F.col("turn") % 4 == 1, "custom").otherwise(F.col("role"))
    kind = F.when(F.col("turn") % 3 == 1, "go-on").otherwise("note")
    d = d.select(F.concat(F.lit("c"), "conv_id").alias("session_id"), F.col("turn").cast("long").alias("seq"), F.to_json(F.struct(role.alias("role"), kind.alias("customType"), F.col("text").alias("content"))).alias("message"))
    return adapters.without_markers(d, "go-on").select("session_id", "seq")


_U = "'## What the user said' || chr(10)"


@register(f"""WITH t AS (SELECT conv_id, string_agg(text, chr(10) ORDER BY turn) FILTER (role = 'user' AND turn < 3) AS old, string_agg(text, chr(10) ORDER BY turn) FILTER (role = 'user' AND turn >= 3) AS new FROM conversations GROUP BY conv_id),
    s AS (SELECT conv_id, trim(regexp_replace(coalesce(old, ''), '^\\s+|\\s+$', '', 'g')) AS old, trim(coalesce(new, '')) AS new FROM t)
    SELECT 'c' || CAST(conv_id AS VARCHAR) AS session_id, '## Brief' || chr(10) || 'x' || CASE WHEN new <> '' THEN chr(10) || chr(10) || {_U} || new ELSE '' END
           || CASE WHEN old = '' THEN '' WHEN new <> '' THEN chr(10) || chr(10) || left(old, 300) ELSE chr(10) || chr(10) || {_U} || left(old, 300) END || CASE WHEN new <> '' THEN chr(10) || '## End' ELSE '' END AS summary FROM s""")
def carried_quotes(spark, sf_dir):
    """Later turns' quotes with those of earlier turns carried on below them."""
    d = spark.read.parquet(f"{sf_dir}/conversations.parquet").where("role = 'user'")
    said = lambda c: F.array_join(F.array_sort(F.collect_list(F.when(c, F.struct("turn", "text"))))["text"], "\n")
    every = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id").distinct()
    d = every.join(d.groupBy("conv_id").agg(said(F.col("turn") < 3).alias("old"), said(F.col("turn") >= 3).alias("new")), "conv_id", "left")
    heading = f"## {adapters.USERS}\n"
    new = F.trim(F.coalesce("new", F.lit("")))
    summary = F.concat(F.lit("## Brief\nx"), F.when(new != "", F.concat(F.lit("\n\n" + heading), new, F.lit("\n## End"))).otherwise(""))
    previous = F.concat(F.lit("## Brief\ny\n\n" + heading), F.coalesce("old", F.lit("")))
    return d.select(F.concat(F.lit("c"), "conv_id").alias("session_id"), adapters.carried(summary, previous, 300).alias("summary"))


_TOK = "CASE WHEN {0} >= 10000 THEN CAST(CAST(round({0} / 1000) AS BIGINT) AS VARCHAR) || 'k' WHEN {0} >= 1000 THEN CAST((({0} + 50) // 100) // 10 AS VARCHAR) || '.' || CAST((({0} + 50) // 100) % 10 AS VARCHAR) || 'k' ELSE CAST({0} AS VARCHAR) END"


@register(f"""{_LIVE}, keeps AS (SELECT *, 1 AS k FROM tot), {_CUT},
    p AS (SELECT l.session_id, l.seq, l.bytes, NOT all_ AND coalesce(idx >= cut, true) AS kept FROM live l JOIN num USING (session_id, seq, bytes) JOIN cutk c ON c.session_id = l.session_id),
    a AS (SELECT session_id, CAST(trunc(sum(bytes) / 3.8) AS BIGINT) AS b, CAST(trunc(coalesce(sum(bytes) FILTER (kept), 0) / 3.8) AS BIGINT) AS k, count(*) FILTER (kept) AS n FROM p GROUP BY session_id),
    q AS (SELECT *, CAST(round((k - b) / b * 100) AS BIGINT) AS pct FROM a)
    SELECT session_id, 'sparkbrief · ' || {_TOK.format('b')} || ' → ' || {_TOK.format('k')} || ' tokens' || CASE WHEN b > 0 THEN CASE WHEN pct <= 0 THEN ' (−' || CAST(abs(pct) AS VARCHAR) || '%)' ELSE ' (+' || CAST(pct AS VARCHAR) || '%)' END ELSE '' END || ' · kept ' || CAST(n AS VARCHAR) || ' messages' AS line FROM q""")
def compact_notice(spark, sf_dir):
    """A line a session: its tokens and those that a cut before the last user turn keeps."""
    from ..functions.text import block_size, tokens
    from ..operators import cut

    split = cut.split_at(derived.blocks(spark, sf_dir), Compact(keep=1, max_tail=200)).withColumn("bytes", block_size())
    kept = F.col("kept")
    d = split.groupBy("session_id").agg(F.sum("bytes").alias("b"), F.coalesce(F.sum(F.when(kept, F.col("bytes"))), F.lit(0)).alias("k"), F.count_if(kept).alias("n"))
    return d.select("session_id", adapters.notice(tokens(F.col("b")), tokens(F.col("k")), F.col("n")).alias("line"))


@register("""SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 'conf' || CAST(page_id AS VARCHAR) ELSE '/home/u/.engine' END || '/projects/' || regexp_replace(url, '[^A-Za-z0-9]', '-', 'g') || '/s' || CAST(page_id AS VARCHAR) || '.jsonl' AS path FROM pages WHERE url IS NOT NULL""")
def transcript_paths(spark, sf_dir):
    """Log paths of made-up working folders."""
    d = spark.read.parquet(f"{sf_dir}/pages.parquet").where("url is not null")
    config = F.when(F.col("page_id") % 3 == 0, F.concat(F.lit("conf"), "page_id")).when(F.col("page_id") % 3 == 1, " ")
    return d.select("page_id", adapters.transcript_path(config, F.lit("/home/u"), F.col("url"), F.concat(F.lit("s"), "page_id"), ".engine").alias("path"))


@register("""SELECT page_id, CAST(CASE WHEN page_id % 2 = 0 THEN 1 ELSE 0 END AS INTEGER) AS changed, CASE WHEN page_id % 2 = 0 THEN '[{"type":"text","text":"t"},{"type":"file","file":{"file_data":"data:image/png;base64,' || base64(encode(left(url, 20))) || '"}}]'
    ELSE '[{"type":"text","text":"t"},{"type":"image_url","image_url":{"url":"https://p/' || base64(encode(left(url, 20))) || '"}}]' END AS parts FROM pages WHERE url IS NOT NULL AND regexp_full_match(url, '[ -~]*')""")
def payload_parts(spark, sf_dir):
    """Messages with a picture, as data or by address: those with data become files."""
    d = spark.read.parquet(f"{sf_dir}/pages.parquet").where("url is not null and url rlike '\\\\A[ -~]*\\\\z'")
    start = F.when(F.col("page_id") % 2 == 0, "data:image/png;base64,").otherwise("https://p/")
    url = F.concat(start, F.base64(F.left("url", F.lit(20)).cast("binary")))
    content = F.concat(F.lit('[{"type":"text","text":"t"},{"type":"image_url","image_url":{"url":"'), url, F.lit('"}}]'))
    return d.select("page_id", adapters.file_parts(content).alias("x")).select("page_id", "x.changed", "x.parts")


_K = "substr(sha256(text), 1, 32)"


@register(f"""{_LOG} r AS (SELECT {_K} AS key, text FROM blocks WHERE type = 'toolResult' AND text IS NOT NULL)
    SELECT key, any_value(text) AS text FROM r WHERE key NOT IN (SELECT {_K} FROM blocks WHERE type = 'toolResult' AND seq < 40) GROUP BY key""")
def unseen_blocks(spark, sf_dir):
    """Tool results whose text the first ten steps of no session have shown."""
    r = derived.tools(spark, sf_dir).where("type = 'toolResult' and text is not null").select("seq", F.substring(F.sha2("text", 256), 1, 32).alias("key"), "text")
    return adapters.unseen(r.select("key", "text"), r.where("seq < 40"))


_REP = f"""{_LOG} b AS (SELECT session_id, seq, block_ix, role, type, text, CASE WHEN type = 'toolResult' AND starts_with(text, 'building') THEN {_K} END AS key FROM blocks WHERE kind = 'message' AND session_id LIKE 'u%'),
    tg AS (SELECT b.session_id, b.seq, coalesce((SELECT min(u.seq) FROM b u WHERE u.session_id = b.session_id AND u.role = 'user' AND u.seq > b.seq), (SELECT max(u.seq) FROM b u WHERE u.session_id = b.session_id AND u.role = 'user' AND u.seq < b.seq)) AS target FROM b WHERE key IS NOT NULL),
    o AS (SELECT session_id, seq, 0 AS src, 0 AS i, type, CASE WHEN key IS NOT NULL THEN left(text, 4) || chr(10) || '[1 frame(s) hold the archived middle: f' || left(key, 4) || ']' || right(text, 4) ELSE text END AS text FROM b),
    m AS (SELECT b.session_id, {{0}} AS seq, b.seq AS src, x.i, CASE x.i WHEN 1 THEN 'text' ELSE 'image' END AS type, CASE x.i WHEN 1 THEN '[archived output follows as frames, verbatim, read in order]' ELSE 'f' || left(key, 4) END AS text
          FROM b JOIN tg ON tg.session_id = b.session_id AND tg.seq = b.seq, (SELECT unnest([1, 2]) AS i) x WHERE key IS NOT NULL)
    SELECT session_id, seq, type, text, CAST(row_number() OVER (PARTITION BY session_id, seq ORDER BY src, i) AS INTEGER) AS ord FROM (SELECT * FROM o UNION ALL SELECT * FROM m WHERE seq IS NOT NULL)"""


def _replaced(spark, sf_dir, inline: bool):
    from pyspark.sql.window import Window

    b = derived.tools(spark, sf_dir)
    r = b.where("type = 'toolResult' and text like 'building%'").select(F.substring(F.sha2("text", 256), 1, 32).alias("key"), "text").dropDuplicates(["key"])
    cache = r.select("key", F.left("text", F.lit(4)).alias("head"), F.right("text", F.lit(4)).alias("tail"), F.array(F.concat(F.lit("f"), F.left("key", F.lit(4)))).alias("frames"))
    d = adapters.replaced(b, frames.placements(b), cache, inline)
    return d.select("session_id", "seq", "type", "text", F.row_number().over(Window.partitionBy("session_id", "seq").orderBy("block_ix", "place")).alias("ord"))


@register(_REP.replace("{0}", "tg.target"))
def replaced_next_user(spark, sf_dir):
    """Failed builds as frames that follow the next user turn."""
    return _replaced(spark, sf_dir, False)


@register(_REP.replace("{0}", "b.seq"))
def replaced_inline(spark, sf_dir):
    return _replaced(spark, sf_dir, True)


_EDITS = "e AS (SELECT DISTINCT session_id, json_extract_string(arguments, '$.path') AS path FROM blocks WHERE type = 'toolCall' AND tool_name IN ('edit', 'write'))"


@register(f"{_LOG} {_EDITS} SELECT 'copy-' || session_id AS session_id, path FROM e")
def copied_truth(spark, sf_dir):
    """Copies of all tool sessions under new names, and the files that they have changed."""
    b = derived.tools(spark, sf_dir)
    names = b.select("session_id", F.concat(F.lit("copy-"), "session_id").alias("new_id")).distinct()
    return adapters.edited_paths(adapters.renamed(b, names))


@register(f"""{_LOG} {_EDITS}, l AS (SELECT session_id, string_agg(arguments, chr(10) ORDER BY seq) AS answer FROM blocks WHERE type = 'toolCall' AND seq < 60 GROUP BY session_id)
    SELECT e.session_id, count(*) AS truth, count(*) FILTER (contains(coalesce(answer, ''), path)) AS full_hits, count(*) FILTER (contains(coalesce(answer, ''), regexp_extract(path, '[^/]*$'))) AS name_hits,
           CAST(max(len(list_filter(string_split(coalesce(answer, ''), chr(10)), lambda x: trim(x) <> ''))) AS INTEGER) AS lines FROM e LEFT JOIN l ON e.session_id = l.session_id GROUP BY e.session_id""")
def answers_against_truth(spark, sf_dir):
    """The changed files that the calls of each session's first steps already name."""
    b = derived.tools(spark, sf_dir)
    calls = b.where("type = 'toolCall' and seq < 60").groupBy("session_id").agg(F.array_join(F.array_sort(F.collect_list(F.struct("seq", "arguments")))["arguments"], "\n").alias("answer"))
    return evaluate.answers(adapters.edited_paths(b), calls)


@register(f"""{_FACTS}, a AS (SELECT DISTINCT session_id, item FROM f WHERE seq % 8 = 2), b AS (SELECT DISTINCT session_id, item FROM f WHERE seq % 8 <> 2), j AS (SELECT coalesce(a.session_id, b.session_id) AS session_id, a.item AS x, b.item AS y FROM a FULL JOIN b ON a.session_id = b.session_id AND a.item = b.item)
    SELECT session_id, count(x) AS old_items, count(y) AS new_items, count(*) FILTER (x IS NULL) AS added, count(*) FILTER (y IS NULL) AS removed FROM j GROUP BY session_id""")
def paired_facts(spark, sf_dir):
    """The facts of every second step, held against those of the others."""
    d = sections.facts_by_result(derived.blocks(spark, sf_dir)).withColumn("section", F.lit("key_facts"))
    return evaluate.paired(d.where("seq % 8 = 2"), d.where("seq % 8 <> 2"))


@register(f"""{_FACTS}, g AS (SELECT session_id, k, arg_min(item, seq * 10 + nth) AS item, min(seq * 10 + nth) AS o FROM f WHERE nth <= 4 GROUP BY session_id, k),
    h AS (SELECT session_id, item, row_number() OVER (PARTITION BY session_id ORDER BY o) AS ord FROM g), s AS (SELECT session_id, string_agg(item, chr(10)) AS summary FROM h WHERE ord <= 10 GROUP BY session_id),
    c AS (SELECT DISTINCT session_id, regexp_extract(text, 'TS[0-9]+') AS code FROM blocks WHERE type = 'toolResult' AND regexp_matches(text, 'TS[0-9]+'))
    SELECT c.session_id, count(*) AS codes, count(*) FILTER (contains(coalesce(summary, ''), code)) AS kept FROM c LEFT JOIN s ON c.session_id = s.session_id GROUP BY c.session_id""")
def fact_retention(spark, sf_dir):
    """Of the error codes of a session, how many its key facts hold."""
    b = derived.blocks(spark, sf_dir)
    facts = sections.key_facts(b).groupBy("session_id").agg(F.array_join(F.collect_list("item"), "\n").alias("summary"))
    code = F.regexp_extract("text", "(TS[0-9]+)", 1)
    return evaluate.retention(b.where("type = 'toolResult'").select("session_id", code.alias("code")).where("code <> ''").distinct(), facts)


@register(f"""{_LOG} p AS (SELECT session_id, seq, strlen(coalesce(text, arguments, '')) AS n, sha256(concat_ws(chr(0), coalesce(role, ''), coalesce(type, ''), coalesce(text, ''), coalesce(arguments, ''))) AS h FROM blocks WHERE kind = 'message'),
    s AS (SELECT session_id, count(DISTINCT seq) AS messages, CAST(sum(n) AS BIGINT) AS bytes, sha256(string_agg(h, '' ORDER BY seq)) AS sha256 FROM p GROUP BY session_id HAVING count(DISTINCT seq) >= 8 AND sum(n) >= 400)
    SELECT CAST(row_number() OVER (ORDER BY session_id) AS INTEGER) AS no, * FROM s QUALIFY no <= 50""")
def frozen_manifest(spark, sf_dir):
    """The first fifty sessions that are long enough, with hashes of their content."""
    return adapters.manifest(derived.blocks(spark, sf_dir), 8, 400, 50)


@register(f"""{_LOG} s AS (SELECT session_id, seq FROM blocks) SELECT * FROM (SELECT CAST(2000 AS BIGINT) AS created, 'second' AS reason, count(DISTINCT session_id) AS sessions, count(DISTINCT session_id || '/' || CAST(seq AS VARCHAR)) AS entries, count(*) AS blocks FROM s
    UNION ALL SELECT CAST(1000 AS BIGINT), 'first', count(DISTINCT session_id), count(DISTINCT session_id || '/' || CAST(seq AS VARCHAR)), count(*) FROM s WHERE session_id LIKE 'u%')""")
def snapshot_list(spark, sf_dir):
    """Two snapshots, written and listed."""
    folder = _folder(spark)
    snapshots.write_snapshot(derived.tools(spark, sf_dir), folder, "first", 1000)
    snapshots.write_snapshot(derived.blocks(spark, sf_dir), folder, "second", 2000)
    return snapshots.list_snapshots(spark, folder)


@register("SELECT CAST(doc_id AS BIGINT) AS put, doc_id AS key FROM documents WHERE doc_id IS NOT NULL ORDER BY put DESC LIMIT 100")
def cache_newest(spark, sf_dir):
    """What a cache of a hundred entries keeps of the documents, put in by number."""
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").where("doc_id is not null")
    return adapters.newest(d.select(F.col("doc_id").cast("long").alias("at"), F.col("doc_id").alias("key")), 100).withColumnRenamed("at", "put")


@register()
def handover_summaries(spark, sf_dir):
    """Whole summaries for the next window: brief, replies, quotes, and the token accounts."""
    b = derived.chats(spark, sf_dir)
    texts = lambda role: b.where(F.col("role") == role).groupBy("session_id").agg(F.array_join(F.array_sort(F.collect_list(F.struct("seq", "text")))["text"], "\n").alias("text"))
    briefs = brief.render(sections.goal(b), brief.transcript_window(b, Transcript(max_lines=10))).select("session_id", F.col("summary").alias("text"))
    before = compact.previous_briefs(derived.blocks(spark, sf_dir)).select("session_id", F.col("summary").alias("text"))
    return adapters.handover(b, briefs, before, texts("assistant"), texts("user"))
