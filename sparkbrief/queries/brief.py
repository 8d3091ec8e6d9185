"""Transcripts, merges, briefs and adapters' inputs over the derived log."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import space_trim_end
from ..operators import brief, sections
from ..plans import compact
from ..schema import Compact
from ..schema import Transcript
from ..sources import chat, derived
from . import registry
from .sections import _cut

QUERIES, ORACLES, register = registry()

_LOG = f"WITH {derived.BLOCKS_SQL},"
_REFS = f"""{_LOG} t AS (SELECT * FROM blocks WHERE kind = 'message' AND session_id LIKE 'u%'),
    c AS (SELECT *, CASE WHEN type = 'toolResult' AND call_id IS NOT NULL THEN max(CASE WHEN type = 'toolCall' THEN seq END) OVER (PARTITION BY session_id, call_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) END AS of FROM t WHERE type IN ('toolCall', 'toolResult')),
    n AS (SELECT *, CASE WHEN type = 'toolCall' OR of IS NULL THEN sum(CASE WHEN type = 'toolCall' OR of IS NULL THEN 1 ELSE 0 END) OVER (PARTITION BY session_id ORDER BY seq) END AS own FROM c),
    f AS (SELECT n.*, CAST(coalesce(n.own, m.own) AS BIGINT) AS ref FROM n LEFT JOIN n m ON m.session_id = n.session_id AND m.seq = n.of)"""
_QUOTE = "'\"' || replace(replace({0}, chr(92), chr(92) || chr(92)), '\"', chr(92) || '\"') || '\"'"
_TEXTLINE = r"regexp_replace({0}, '^\s+|\s+$', '', 'g')"
_LINES = f"""{_REFS},
    d AS (SELECT *, '→ ' || CASE WHEN is_error THEN 'ERROR ' ELSE '' END || {_cut("string_split(text, chr(10))[1]", 160)} AS digest FROM f),
    g AS (SELECT session_id, seq, '#' || CAST(ref AS VARCHAR) AS ref, CASE WHEN type = 'toolCall' THEN '* ' || tool_name || ' ' || {_QUOTE.format("coalesce(json_extract_string(arguments, '$.command'), json_extract_string(arguments, '$.path'))")} || ' (#' || CAST(ref AS VARCHAR) || ')'
             WHEN of IS NOT NULL THEN digest ELSE '* ' || tool_name || ' result (#' || CAST(ref AS VARCHAR) || ') ' || digest END AS line FROM d),
    u AS (SELECT session_id, seq, role, {_TEXTLINE.format("text")} AS x FROM blocks WHERE type = 'text' AND role IN ('user', 'assistant')),
    l AS (SELECT * FROM g UNION ALL SELECT session_id, seq, '' AS ref, '[' || role || '] ' || {_cut("x", 220)} AS line FROM u WHERE x <> '')"""


@register(f"{_REFS} SELECT session_id, seq, ref, of IS NOT NULL AS paired FROM f")
def call_result_refs(spark, sf_dir):
    return brief.call_references(derived.tools(spark, sf_dir)).select("session_id", "seq", F.col("ref").cast("long").alias("ref"), "paired")


@register(f"{_LINES} SELECT session_id, seq, ref, line FROM l")
def transcript_lines(spark, sf_dir):
    return brief.transcript_lines(derived.blocks(spark, sf_dir)).select("session_id", "seq", "ref", "line")


@register(f"""{_LINES}, nn AS (SELECT *, count(*) OVER (PARTITION BY session_id) AS total, row_number() OVER (PARTITION BY session_id ORDER BY seq) AS k FROM l)
    SELECT session_id, CAST(k - greatest(total - 30, 0) AS INTEGER) AS line_no, ref, line, total, greatest(total - 30, 0) AS omitted FROM nn WHERE k > greatest(total - 30, 0)""")
def transcript_window(spark, sf_dir):
    d = brief.transcript_window(derived.blocks(spark, sf_dir), Transcript(max_lines=30))
    return d.select("session_id", "line_no", "ref", "line", "total", F.col("omitted").cast("long").alias("omitted"))


@register(rf"""{_LOG} z AS (SELECT session_id, arg_max(summary, seq) AS s FROM blocks WHERE kind = 'compaction' GROUP BY session_id),
    a AS (SELECT session_id, unnest(string_split(s, chr(10))) AS x, generate_subscripts(string_split(s, chr(10)), 1) AS n FROM z),
    t AS (SELECT *, last_value(CASE WHEN regexp_matches(x, '^\[.*\]$') THEN substr(x, 2, len(x) - 2) END IGNORE NULLS) OVER (PARTITION BY session_id ORDER BY n) AS title FROM a),
    i AS (SELECT session_id, n, CASE title WHEN 'Session Goal' THEN 'goal' WHEN 'Files And Changes' THEN 'files_modified' END AS section, regexp_replace(regexp_replace(x, '^- ', ''), '^Modified: ', '') AS item FROM t WHERE x <> '' AND NOT regexp_matches(x, '^\['))
    SELECT session_id, section, CAST(row_number() OVER (PARTITION BY session_id, section ORDER BY n) AS INTEGER) AS ord, item FROM i""")
def parse_brief_items(spark, sf_dir):
    return brief.parse_items(compact.previous_briefs(derived.blocks(spark, sf_dir)))


_FILES = r"""f AS (SELECT DISTINCT session_id, seq < 60 AS old, regexp_replace(json_extract_string(arguments, '$.path'), '^.*?/dev/', '') AS item FROM blocks WHERE type = 'toolCall' AND tool_name = 'edit' AND (seq < 60 OR seq >= 60)),
    r AS (SELECT *, row_number() OVER (PARTITION BY session_id, old ORDER BY item) AS o FROM f),
    c AS (SELECT * FROM r WHERE o <= 24),
    k AS (SELECT session_id, item, min(CASE WHEN old THEN o ELSE 1000 + o END) AS p FROM c GROUP BY session_id, item)"""


@register(f"{_LOG} {_FILES} SELECT session_id, 'files_modified' AS section, CAST(row_number() OVER (PARTITION BY session_id ORDER BY p) AS INTEGER) AS ord, item FROM k")
def merge_sections(spark, sf_dir):
    """Files edited in the first part of each session, then those of the rest."""
    b = derived.tools(spark, sf_dir)
    old, new = (sections.files(b.where(c)).where("section = 'files_modified'") for c in ("seq < 60", "seq >= 60"))
    return brief.merge(old, new)


@register(rf"""{_LOG} b AS (SELECT session_id, 1 AS k, 'Session Goal' AS t FROM blocks WHERE role = 'user' AND regexp_matches(text, '\S')
    UNION SELECT session_id, 2, 'Files And Changes' FROM blocks WHERE type = 'toolCall' AND tool_name IN ('read', 'edit', 'write') UNION SELECT session_id, 3, 'Commits' FROM blocks WHERE type = 'toolCall' AND contains(arguments, 'git commit'))
    SELECT session_id, string_agg(t, ', ' ORDER BY k) AS sections FROM b GROUP BY session_id""")
def brief_sections_present(spark, sf_dir):
    b = derived.blocks(spark, sf_dir)
    d = sections.goal(b).unionByName(sections.files(b)).unionByName(sections.commits(b))
    return brief.present(d)


@register(f"""{_LINES}, nn AS (SELECT *, count(*) OVER (PARTITION BY session_id) AS total, row_number() OVER (PARTITION BY session_id ORDER BY seq) AS k FROM l),
    w AS (SELECT * FROM nn WHERE k > greatest(total - 30, 0)),
    x AS (SELECT session_id, CASE WHEN max(total) > 30 THEN '- (' || CAST(max(total) - 30 AS VARCHAR) || ' earlier lines omitted; full history recoverable via recall)' || chr(10) ELSE '' END || string_agg(line, chr(10) ORDER BY k) AS t FROM w GROUP BY session_id),
    cm AS (SELECT session_id, seq, 'commit: ' || trim(trim(string_split(json_extract_string(arguments, '$.command'), '-m')[2]), '"''') AS item FROM blocks WHERE type = 'toolCall' AND contains(arguments, 'git commit')),
    cr AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY seq DESC) AS o FROM cm),
    cc AS (SELECT session_id, '[Commits]' || chr(10) || string_agg('- ' || item, chr(10) ORDER BY o) || chr(10) || chr(10) AS t FROM cr WHERE o <= 8 GROUP BY session_id)
    SELECT x.session_id, rtrim(coalesce(cc.t, '') || '[Transcript]' || chr(10) || x.t) AS summary FROM x LEFT JOIN cc ON x.session_id = cc.session_id""")
def brief_text(spark, sf_dir):
    """Commits and transcripts; a last line that is cut after a line end keeps it."""
    b = derived.blocks(spark, sf_dir)
    return brief.render(sections.commits(b), brief.transcript_window(b, Transcript(max_lines=30)), end=space_trim_end)


@register()
def compact_sessions(spark, sf_dir):
    """Whole briefs with their token accounts."""
    d = compact.compact(derived.blocks(spark, sf_dir), Compact(keep=1))
    return d.select("session_id", "cut", "sections", "tokens_before", "tokens_after", "saved_pct", F.sha2("summary", 256).alias("summary_sha256"))


@register()
def reduction_pct(spark, sf_dir):
    """Tokens before and after compaction of all sessions together."""
    d = compact.compact(derived.blocks(spark, sf_dir), Compact(keep=1)).agg(F.count("*").alias("sessions"), F.sum("tokens_before").alias("tokens_before"), F.sum("tokens_after").alias("tokens_after"))
    return d.withColumn("saved_pct", F.round(100 * (F.col("tokens_before") - F.col("tokens_after")) / F.col("tokens_before"), 4))


@register("""SELECT 's' || CAST(conv_id AS VARCHAR) AS session_id, CAST(turn AS BIGINT) AS seq, 'm' || CAST(turn AS VARCHAR) AS entry_id, lag('m' || CAST(turn AS VARCHAR)) OVER (PARTITION BY conv_id ORDER BY turn) AS parent_id, role, text
    FROM conversations WHERE role IN ('user', 'assistant')""")
def openai_entries(spark, sf_dir):
    """Conversations as chat messages, turned into entries."""
    d = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    msgs = d.select(F.concat(F.lit("s"), "conv_id").alias("session_id"), F.col("turn").cast("long").alias("seq"), F.to_json(F.struct("role", F.col("text").alias("content"))).alias("message"))
    return chat.entries(msgs).select("session_id", "seq", "entry_id", "parent_id", "role", "text")


@register("""WITH a AS (SELECT conv_id, turn, strlen(text) AS n, sum(strlen(text)) OVER (PARTITION BY conv_id ORDER BY turn DESC) AS run FROM conversations WHERE role = 'assistant' AND strlen(text) <= 1200)
    SELECT 'c' || CAST(conv_id AS VARCHAR) AS session_id, count(*) AS replies, CAST(sum(n) AS BIGINT) AS bytes FROM a WHERE run <= 2000 GROUP BY conv_id""")
def reply_excerpts(spark, sf_dir):
    """The latest replies of each conversation that fit together into 2000 bytes, of those of up to 1200."""
    d = chat.latest_within(derived.chats(spark, sf_dir).where("role = 'assistant' and octet_length(text) <= 1200").withColumn("bytes", F.octet_length("text")), 2000)
    return d.groupBy("session_id").agg(F.count("*").alias("replies"), F.sum("bytes").alias("bytes"))


@register(f"""{_LOG} c AS (SELECT session_id, tool_name, count(*) AS n FROM blocks WHERE type = 'toolCall' GROUP BY session_id, tool_name)
    SELECT session_id, string_agg(tool_name || ' ×' || CAST(n AS VARCHAR), ', ' ORDER BY n DESC, tool_name) AS steps FROM c GROUP BY session_id""")
def tool_step_counts(spark, sf_dir):
    return chat.tool_steps(derived.tools(spark, sf_dir))
