"""Recall over conversations, tool sessions and documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import messages, recall
from ..operators.evaluate import STOP, query_terms
from ..schema import Recall
from ..sources import derived
from . import registry

QUERIES, ORACLES, register = registry()

_LOG = f"WITH {derived.BLOCKS_SQL},"
_PIECE = "CASE WHEN type = 'text' THEN text WHEN type = 'toolResult' THEN CASE WHEN coalesce(tool_name, '') = '' THEN text ELSE '[' || tool_name || '] ' || text END WHEN type = 'toolCall' THEN '[call ' || tool_name || '] ' || arguments END"


def _sql(words: list[str], where: str, page: int = 1, per: int = 5, log: str = _LOG) -> str:
    n = ", ".join(f"(strlen(lower(t)) - strlen(replace(lower(t), '{w}', ''))) // {len(w.encode())} AS n{i}" for i, w in enumerate(words))
    df = ", ".join(f"{words.count(w)} * count(*) FILTER (n{i} > 0) AS d{i}" for i, w in enumerate(words))
    score = " + ".join(f"ln(1 + n{i}) * greatest(ln(c.searched / greatest(d{i}, 1)), 0.5)" for i in range(len(words)))
    some = " OR ".join(f"n{i} > 0" for i in range(len(words)))
    return f"""{log}
    m AS (SELECT session_id, seq, entry_id, role, tool_name, {_PIECE} AS t FROM blocks WHERE kind = 'message'),
    f AS (SELECT *, {n} FROM m WHERE t <> '' AND {where}),
    c AS (SELECT session_id, count(*) AS searched, {df} FROM f GROUP BY session_id),
    s AS (SELECT f.session_id, seq, entry_id, role, c.searched, round({score}, 6) AS score, {score} AS exact FROM f JOIN c ON f.session_id = c.session_id WHERE {some}),
    r AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY exact DESC, seq) AS rank, count(*) OVER (PARTITION BY session_id) AS total FROM s)
    SELECT session_id, CAST(rank AS INTEGER) AS rank, entry_id, role, score, total, CAST(greatest(1, ceil(total / {per})) AS INTEGER) AS page_count, searched
    FROM r WHERE rank > {(page - 1) * per} AND rank <= {page * per}"""


def _page(blocks, r: Recall):
    d = recall.page(recall.hits(blocks, r), r)
    return d.select("session_id", "rank", "entry_id", "role", F.round("score", 6).alias("score"), "total", "page_count", "searched")


@register(_sql(["the", "ent"], "session_id LIKE 'c%'"))
def recall_terms_topk(spark, sf_dir):
    return _page(derived.chats(spark, sf_dir), Recall("The ent"))


@register(_sql(["e"], "session_id LIKE 'c%'", page=2, per=2))
def recall_terms_page2(spark, sf_dir):
    return _page(derived.chats(spark, sf_dir), Recall("e", page=2, per_page=2))


@register(_sql(["ion", "ion", "der"], "session_id LIKE 'c%'"))
def recall_duplicate_terms(spark, sf_dir):
    return _page(derived.chats(spark, sf_dir), Recall("ion ion der"))


@register(_sql(["an"], "session_id LIKE 'c%' AND role = 'user'"))
def recall_role_filter(spark, sf_dir):
    return _page(derived.chats(spark, sf_dir), Recall("an", role="user"))


@register(_sql(["e"], "session_id LIKE 'c%' AND seq > 0 AND seq < 3 AND session_id IN (SELECT session_id FROM blocks WHERE seq IN (0, 3) GROUP BY session_id HAVING count(DISTINCT seq) = 2)").replace("seq, entry_id, role, tool_name, CASE", "seq, 'm' || CAST(seq AS VARCHAR) AS entry_id, role, tool_name, CASE"))
def recall_entry_range(spark, sf_dir):
    """The messages between the first and the fourth of every conversation, which all number theirs alike."""
    d = derived.chats(spark, sf_dir).withColumn("entry_id", F.concat(F.lit("m"), F.col("seq").cast("string")))
    r = Recall("e", after_entry="m0", before_entry="m3")
    recall.check_range(d, r)
    return _page(d, r)


_PATH = f"""WITH RECURSIVE {derived.BLOCKS_SQL}, nodes AS (SELECT session_id, entry_id, seq, parent_id FROM blocks WHERE session_id LIKE 'u%'),
    leaf AS (SELECT session_id, arg_max(entry_id, seq) AS entry_id FROM nodes GROUP BY session_id),
    up AS (SELECT nodes.session_id, nodes.entry_id, nodes.parent_id FROM nodes JOIN leaf USING (session_id, entry_id) UNION ALL SELECT nodes.session_id, nodes.entry_id, nodes.parent_id FROM up JOIN nodes ON nodes.session_id = up.session_id AND nodes.entry_id = up.parent_id),"""


@register(_sql(["step", "error"], "session_id LIKE 'u%'"))
def recall_scope_all(spark, sf_dir):
    """All entries of each session, on its active path or not."""
    return _page(derived.tools(spark, sf_dir), Recall("step error"))


@register(_sql(["step", "error"], "session_id LIKE 'u%' AND (session_id, entry_id) IN (SELECT session_id, entry_id FROM up)", log=_PATH))
def recall_scope_lineage(spark, sf_dir):
    """The entries from each session's root to its leaf."""
    d = recall.search_lineage(derived.tools(spark, sf_dir), Recall("step error"))
    return d.select("session_id", "rank", "entry_id", "role", F.round("score", 6).alias("score"), "total", "page_count", "searched")


@register(f"""{_LOG}
    m AS (SELECT session_id, seq, entry_id, {_PIECE} AS t FROM blocks WHERE kind = 'message'),
    f AS (SELECT *, (strlen(lower(t)) - strlen(replace(lower(t), 'report', ''))) // 6 AS n FROM m WHERE t <> ''),
    c AS (SELECT count(*) AS searched, count(*) FILTER (n > 0) AS d FROM f),
    r AS (SELECT session_id, entry_id, searched, d AS total, row_number() OVER (ORDER BY ln(1 + n) * greatest(ln(searched / greatest(d, 1)), 0.5) DESC, session_id, seq) AS rank FROM f, c WHERE n > 0)
    SELECT session_id, entry_id, CAST(rank AS INTEGER) AS rank, total, searched FROM r WHERE rank > 5 AND rank <= 10""")
def recall_all_sessions(spark, sf_dir):
    """The second page of one ranking over all sessions."""
    return recall.search_all(derived.blocks(spark, sf_dir), Recall("report", page=2)).select("session_id", "entry_id", "rank", "total", "searched")


@register(_sql(["error", "name"], "session_id LIKE 'u%' AND role = 'toolResult' AND tool_name = 'bash'"))
def recall_tool_filter(spark, sf_dir):
    return _page(derived.tools(spark, sf_dir), Recall("error name", tool_name="bash"))


@register(f"""{_LOG}
    m AS (SELECT session_id, seq, entry_id, role, {_PIECE} AS t FROM blocks WHERE kind = 'message' AND session_id LIKE 'u%'),
    h AS (SELECT *, regexp_extract(t, 'TS[0-9]+: cannot') AS hit FROM m WHERE regexp_matches(t, 'TS[0-9]+: cannot')),
    r AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY seq) AS rank, count(*) OVER (PARTITION BY session_id) AS total FROM h)
    SELECT session_id, CAST(rank AS INTEGER) AS rank, entry_id, hit, total FROM r WHERE rank <= 5""")
def recall_regex(spark, sf_dir):
    r = Recall("TS[0-9]+: cannot", regex=True)
    d = recall.page(recall.hits(derived.tools(spark, sf_dir), r), r)
    return d.select("session_id", "rank", "entry_id", F.col("matched_terms")[0].alias("hit"), "total")


@register(f"""{_LOG}
    m AS (SELECT session_id, {_PIECE} AS t FROM blocks WHERE kind = 'message' AND session_id LIKE 'c%')
    SELECT session_id, count(*) AS searched, count(*) FILTER (contains(lower(t), 'the')) AS df_0, count(*) FILTER (contains(lower(t), 'ent')) AS df_1 FROM m WHERE t <> '' GROUP BY session_id""")
def recall_df(spark, sf_dir):
    r = Recall("the ent")
    return recall.statistics(recall.searched(derived.chats(spark, sf_dir), r), recall.terms(r.query))


@register(_sql(["error", "name"], "session_id LIKE 'u%'").replace("seq, entry_id, role, c.searched,", "seq, entry_id, role, t, n0, n1, c.searched,").rsplit("SELECT session_id, CAST(rank", 1)[0] + """
    , p AS (SELECT *, least(CASE WHEN n0 > 0 THEN instr(lower(t), 'error') END, CASE WHEN n1 > 0 THEN instr(lower(t), 'name') END) AS pos FROM r WHERE rank <= 5),
    q AS (SELECT *, greatest(0, pos - 1 - 32) AS start FROM p),
    b AS (SELECT *, substr(t, start + 1) AS body, CASE WHEN start > 0 THEN '…' ELSE '' END AS lead FROM q)
    SELECT session_id, CAST(rank AS INTEGER) AS rank, entry_id, lead || CASE WHEN strlen(body) <= 128 - strlen(lead) THEN body ELSE left(body, CAST(125 - strlen(lead) AS BIGINT)) || '…' END AS snippet,
           concat_ws(' ', CASE WHEN n0 > 0 THEN 'error' END, CASE WHEN n1 > 0 THEN 'name' END) AS matched FROM b""")
def recall_snippets(spark, sf_dir):
    r = Recall("error name", snippet_bytes=128)
    d = recall.search(derived.tools(spark, sf_dir), r)
    return d.select("session_id", "rank", "entry_id", "snippet", F.array_join("matched_terms", " ").alias("matched"))


#: The four longest distinct words of an item, of at least four letters, in order of length and then of spelling.
_TERMS = "list_slice(list_sort(list_transform(list_distinct(regexp_extract_all(lower(text), '[a-z]{4,}')), lambda w: {'n': -len(w), 'w': w})), 1, 4)"


@register(f"""WITH q AS (SELECT item_id, unnest({_TERMS}).w AS w FROM benchmark),
    d AS (SELECT doc_id, lower(text) AS t FROM documents),
    w AS (SELECT DISTINCT w FROM q),
    n AS (SELECT w, doc_id, (strlen(t) - strlen(replace(t, w, ''))) // strlen(w) AS k FROM w JOIN d ON contains(t, w)),
    f AS (SELECT w, count(*) AS df FROM n GROUP BY w),
    s AS (SELECT item_id, doc_id, sum(ln(1 + k) * greatest(ln((SELECT count(*) FROM documents WHERE text <> '') / df), 0.5)) AS score FROM q JOIN n USING (w) JOIN f USING (w) GROUP BY item_id, doc_id),
    r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM s),
    t AS (SELECT item_id, doc_id FROM benchmark b JOIN documents d ON contains(d.text, b.text)),
    h AS (SELECT t.item_id, min(rank) AS best FROM t LEFT JOIN r ON t.item_id = r.item_id AND t.doc_id = r.doc_id GROUP BY t.item_id)
    SELECT count(*) AS items, count(*) FILTER (best = 1) AS hit_1, count(*) FILTER (best <= 5) AS hit_5 FROM h""")
def recall_hit_at_k(spark, sf_dir):
    """How often a document that holds an item is found first, or among five, by the item's longest words."""
    from ..operators.evaluate import hit_at_k

    return hit_at_k(spark.read.parquet(f"{sf_dir}/benchmark.parquet"), spark.read.parquet(f"{sf_dir}/documents.parquet"))


_STOP = ", ".join(f"'{w}'" for w in STOP)


@register(f"""WITH w AS (SELECT item_id, unnest(regexp_extract_all(lower(text), '[a-z][a-z0-9_.-]{{3,}}')) AS w, generate_subscripts(regexp_extract_all(lower(text), '[a-z][a-z0-9_.-]{{3,}}'), 1) AS pos FROM benchmark),
    f AS (SELECT item_id, w, count(*) AS n, min(pos) AS pos FROM w WHERE w NOT IN ({_STOP}) GROUP BY item_id, w),
    r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY length(w) DESC, n, pos) AS k FROM f)
    SELECT item_id, string_agg(w, ' ' ORDER BY k) AS terms FROM r WHERE k <= 4 GROUP BY item_id""")
def rare_term_queries(spark, sf_dir):
    return query_terms(spark.read.parquet(f"{sf_dir}/benchmark.parquet"), "item_id")


@register(f"""{_LOG} m AS (SELECT session_id, role, CASE type WHEN 'toolCall' THEN strlen(arguments) ELSE strlen(text) END AS b FROM blocks WHERE kind = 'message')
    SELECT session_id, role, count(*) AS messages, CAST(sum(b) AS BIGINT) AS bytes FROM m GROUP BY session_id, role""")
def stats_by_role(spark, sf_dir):
    return messages.stats_by_role(derived.blocks(spark, sf_dir))


@register(f"""{_LOG} m AS (SELECT session_id, CASE type WHEN 'toolCall' THEN strlen(arguments) ELSE strlen(text) END AS b FROM blocks WHERE kind = 'message')
    SELECT session_id, count(*) AS messages, CAST(sum(b) AS BIGINT) AS bytes, round(sum(b) / 3.8, 6) AS est_tokens FROM m GROUP BY session_id""")
def stats_session_totals(spark, sf_dir):
    return messages.stats_by_session(derived.blocks(spark, sf_dir))


@register("""SELECT 'c' || CAST(conv_id AS VARCHAR) AS session_id, CAST(turn AS BIGINT) AS seq, CAST(trunc(strlen(text) / 3.8) AS BIGINT) AS tokens FROM conversations""")
def token_estimate(spark, sf_dir):
    return messages.token_estimates(derived.chats(spark, sf_dir)).select("session_id", "seq", "tokens")


@register(f"""{_LOG} r AS (SELECT session_id, text FROM blocks WHERE type = 'toolResult')
    SELECT session_id, count(*) FILTER (json_valid(text) AND text[1] IN ('{{', '[')) AS json_results FROM r GROUP BY session_id""")
def json_result_count(spark, sf_dir):
    from ..functions.udfs import content_class

    d = derived.tools(spark, sf_dir).where("type = 'toolResult'")
    return d.groupBy("session_id").agg(F.count_if(content_class(F.col("text")) == "json").alias("json_results"))


@register("""SELECT conv_id, CASE WHEN tokens > 200 AND bytes > 1000 AND bytes / tokens >= 2 AND bytes / tokens <= 8 THEN round(bytes / tokens, 6) ELSE 3.8 END AS ratio
    FROM (SELECT conv_id, sum(strlen(text)) AS bytes, sum(len(regexp_extract_all(text, '[^ \\n]+'))) * 2 AS tokens FROM conversations GROUP BY conv_id)""".replace("\\\\n", "\\n"))
def calibrated_ratio(spark, sf_dir):
    from ..functions.text import calibrate

    d = spark.read.parquet(f"{sf_dir}/conversations.parquet").groupBy("conv_id").agg(F.sum(F.octet_length("text")).alias("b"), (F.sum(F.regexp_count("text", F.lit("[^ \n]+"))) * 2).alias("t"))
    return d.select("conv_id", F.round(calibrate(F.col("b"), F.col("t")), 6).alias("ratio"))
