"""Section extractors over the derived log."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import evaluate, sections
from ..sources import derived
from . import registry

QUERIES, ORACLES, register = registry()

_LOG = f"WITH {derived.BLOCKS_SQL},"
_TRIM = r"regexp_replace({0}, '^\s+|\s+$', '', 'g')"
_KEY = r"regexp_replace(lower({0}), '\s+', ' ', 'g')"
_U = f"{_LOG} u AS (SELECT session_id, seq, text, row_number() OVER (PARTITION BY session_id ORDER BY seq) AS nth FROM blocks WHERE role = 'user' AND text <> ''),"


def _cut(c: str, n: int) -> str:
    """The longest prefix of whole characters in n bytes: counted by characters only where the text is longer."""
    return f"CASE WHEN strlen({c}) <= {n} THEN {c} ELSE list_max(list_filter(list_transform(range(1, {n} + 1), lambda k: substr({c}, 1, k)), lambda s: strlen(s) <= {n})) END"


@register(f"{_U} g AS (SELECT session_id, {_TRIM.format('text')} AS t FROM u WHERE nth = 1) SELECT session_id, {_cut('t', 1400)} AS item FROM g WHERE t <> ''")
def sections_goal(spark, sf_dir):
    return sections.goal(derived.blocks(spark, sf_dir)).where("ord = 1 and not startswith(item, '[Scope change]')").select("session_id", "item")


@register(rf"""{_U} s AS (SELECT session_id, seq, {_TRIM.format('text')} AS t FROM u WHERE nth > 1),
    h AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY seq) AS ord FROM s WHERE strlen(t) > 8 AND regexp_matches(lower(t), '(?s)(^|\. )(actually, |wait,|instead of|scratch that|change of plan|also |additionally,|one more thing|new requirement)'))
    SELECT session_id, CAST(ord AS INTEGER) AS ord, {_cut('t', 220)} AS item FROM h WHERE ord <= 3""")
def sections_scope_change(spark, sf_dir):
    return sections.scope_changes(derived.blocks(spark, sf_dir)).select("session_id", "ord", "item")


@register(rf"""{_U} l AS (SELECT session_id, seq, unnest(string_split(text, chr(10))) AS x, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM u),
    p AS (SELECT session_id, seq, n, {_TRIM.format('x')} AS t FROM l),
    h AS (SELECT *, {_KEY.format('t')} AS k FROM p WHERE regexp_matches(lower(t), '^(always |never |prefer |make sure to |don''t use |do not use |keep it )') AND strlen(t) BETWEEN 8 AND 200),
    f AS (SELECT session_id, k, arg_min(t, seq * 1000 + n) AS t, min(seq * 1000 + n) AS o FROM h GROUP BY session_id, k),
    r AS (SELECT session_id, t AS item, row_number() OVER (PARTITION BY session_id ORDER BY o) AS ord FROM f)
    SELECT session_id, CAST(ord AS INTEGER) AS ord, item FROM r WHERE ord <= 8""")
def sections_preferences(spark, sf_dir):
    return sections.preferences(derived.blocks(spark, sf_dir)).select("session_id", "ord", "item")


@register(rf"""{_LOG} f AS (SELECT DISTINCT session_id, CASE tool_name WHEN 'edit' THEN 'files_modified' WHEN 'write' THEN 'files_created' ELSE 'files_read' END AS section, regexp_replace(json_extract_string(arguments, '$.path'), '^.*?/dev/', '') AS item FROM blocks WHERE type = 'toolCall' AND tool_name IN ('read', 'edit', 'write')),
    r AS (SELECT *, row_number() OVER (PARTITION BY session_id, section ORDER BY item) AS ord FROM f) SELECT session_id, section, CAST(ord AS INTEGER) AS ord, item FROM r WHERE ord <= 24""")
def sections_files(spark, sf_dir):
    return sections.files(derived.blocks(spark, sf_dir))


@register(rf"""{_LOG} c AS (SELECT session_id, seq, json_extract_string(arguments, '$.command') AS cmd FROM blocks WHERE type = 'toolCall' AND tool_name = 'bash'),
    r AS (SELECT session_id, 'commit: ' || trim(trim(string_split(cmd, '-m')[2]), '"''') AS item, row_number() OVER (PARTITION BY session_id ORDER BY seq DESC) AS ord FROM c WHERE contains(lower(cmd), 'git commit'))
    SELECT session_id, CAST(ord AS INTEGER) AS ord, item FROM r WHERE ord <= 8""")
def sections_commits(spark, sf_dir):
    return sections.commits(derived.blocks(spark, sf_dir)).select("session_id", "ord", "item")


@register(rf"""{_LOG} r AS (SELECT session_id, seq, list_filter(list_transform(string_split(text, chr(10)), lambda x: {_TRIM.format('x')}), lambda x: regexp_matches(lower(x), 'error|failed|cannot') AND strlen(x) >= 12)[1] AS t FROM blocks WHERE type = 'toolResult' AND (is_error OR (strlen(text) < 20000 AND regexp_matches(lower(text), 'error|failed|panic|fatal')))),
    f AS (SELECT session_id, {_KEY.format('t')} AS k, arg_min(t, seq) AS t, min(seq) AS seq FROM r WHERE t IS NOT NULL GROUP BY ALL HAVING true),
    g AS (SELECT session_id, k, arg_min(t, seq) AS item, min(seq) AS seq FROM f GROUP BY session_id, k),
    o AS (SELECT session_id, item, row_number() OVER (PARTITION BY session_id ORDER BY seq) AS ord FROM g) SELECT session_id, CAST(ord AS INTEGER) AS ord, item FROM o WHERE ord <= 8""")
def sections_outstanding(spark, sf_dir):
    return sections.outstanding(derived.blocks(spark, sf_dir)).select("session_id", "ord", "item")


#: Severity and code in a lower-cased line, in a dialect without look-around.
_DIAG = r"""regexp_matches({0}, '(^|[^a-z0-9_./\\])(fatal|error|err!|warning|warn|panic|failed|failure)($|[^a-z0-9_./\\])') AND (contains({0}, 'code=') OR contains({0}, 'code ') OR contains({0}, 'code:')
    OR (len({0}) - len(replace({0}, '-', '')) >= 2 AND regexp_matches({0}, '[0-9]')) OR regexp_matches({0}, '(^|[^a-z0-9_])(ts|e|err)[0-9]{{3,}}($|[^a-z0-9_])'))"""
_STRICT = r"""(NOT strict OR (NOT regexp_matches({0}, '^(//|/\*|\*)') AND regexp_matches({0}, '^(fatal|error|err!|warn|warning|panic|failed|failure)(:|\s)|^npm err!')))"""
_D = rf"""{_LOG} t AS (SELECT session_id, seq, text, lower(trim(tool_name)) IN ('read', 'view', 'cat', 'read_file', 'readfile', 'read_file_content') AND NOT is_error AS strict FROM blocks WHERE type = 'toolResult' AND strlen(text) <= 32768),
    l AS (SELECT session_id, seq, strict, unnest(string_split(text, chr(10))) AS x, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM t),
    d AS (SELECT session_id, seq, n, {_TRIM.format('x')} AS item FROM l WHERE strlen({_TRIM.format('x')}) BETWEEN 10 AND 240 AND {_DIAG.format('lower(trim(x))')} AND {_STRICT.format('lower(trim(x))')})"""


@register(f"{_D} SELECT session_id, seq, CAST(n - 1 AS INTEGER) AS place, item FROM d")
def diagnostic_lines(spark, sf_dir):
    return sections.diagnostic_lines(derived.blocks(spark, sf_dir)).select("session_id", "seq", "place", "item")


_FACTS = rf"""{_D}, e AS (SELECT session_id, seq, {_KEY.format('item')} AS k, arg_min(item, n) AS item, min(n) AS n FROM d GROUP BY session_id, seq, k),
    f AS (SELECT *, row_number() OVER (PARTITION BY session_id, seq ORDER BY n) AS nth FROM e)"""


@register(f"{_FACTS} SELECT session_id, seq, CAST(nth AS INTEGER) AS nth, item FROM f WHERE nth <= 4")
def key_facts_per_result(spark, sf_dir):
    return sections.facts_by_result(derived.blocks(spark, sf_dir)).select("session_id", "seq", "nth", "item")


@register(f"""{_FACTS}, g AS (SELECT session_id, k, arg_min(item, seq * 10 + nth) AS item, min(seq * 10 + nth) AS o FROM f WHERE nth <= 4 GROUP BY session_id, k),
    h AS (SELECT session_id, item, row_number() OVER (PARTITION BY session_id ORDER BY o) AS ord FROM g) SELECT session_id, CAST(ord AS INTEGER) AS ord, item FROM h WHERE ord <= 10""")
def key_facts_session(spark, sf_dir):
    return sections.key_facts(derived.blocks(spark, sf_dir)).select("session_id", "ord", "item")


@register(rf"""SELECT doc_id, CAST(CASE WHEN strlen(text) <= 32768 THEN strlen(text) ELSE strlen(regexp_replace({_cut('text', 16384)}, '\n[^\n]*$', '')) END AS BIGINT) AS head_bytes FROM documents WHERE strlen(text) <= 32768 OR contains({_cut('text', 16384)}, chr(10))""")
def head_tail_window(spark, sf_dir):
    """Bytes of the first part of each document that a diagnostic scan would read."""
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", sections.scan_window(F.col("text")).alias("w"))
    return d.where(F.size("w") > 0).select("doc_id", F.octet_length(F.col("w")[0]).cast("long").alias("head_bytes"))


@register(f"""{_FACTS}, a AS (SELECT DISTINCT session_id, item FROM f WHERE seq % 8 = 2), b AS (SELECT DISTINCT session_id, item FROM f WHERE seq % 8 <> 2)
    SELECT session_id, 'added' AS change, item FROM (SELECT * FROM b EXCEPT SELECT * FROM a) UNION ALL SELECT session_id, 'removed', item FROM (SELECT * FROM a EXCEPT SELECT * FROM b)""")
def facts_added_removed(spark, sf_dir):
    d = sections.facts_by_result(derived.blocks(spark, sf_dir)).withColumn("section", F.lit("key_facts"))
    return evaluate.facts_change(d.where("seq % 8 = 2"), d.where("seq % 8 <> 2"))
