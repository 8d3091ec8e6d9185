"""A log made from the ``conversations`` and ``events`` tables, as one SQL text that Spark and other engines read alike.

Conversations become chat sessions. The events of a user become a session of tool calls and results: views read files, clicks
edit, sign-ups write, purchases commit, errors fail with a compiler's message. Every ninth rank a user turn is put in, every third
user has a compaction whose kept entry exists, every third one whose kept entry does not.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Fixed texts of the derived log.
_CHAT = """
SELECT 'c' || CAST(conv_id AS STRING) AS session_id, CAST(turn AS BIGINT) AS seq, 0 AS block_ix, 'c' || CAST(conv_id AS STRING) || '-' || CAST(turn AS STRING) AS entry_id,
       CASE WHEN turn > 0 THEN 'c' || CAST(conv_id AS STRING) || '-' || CAST(turn - 1 AS STRING) END AS parent_id, 'message' AS kind, role, CAST(turn AS BIGINT) AS ts,
       'text' AS type, text, CAST(NULL AS STRING) AS call_id, CAST(NULL AS STRING) AS tool_name, CAST(NULL AS STRING) AS arguments, false AS is_error,
       CAST(NULL AS STRING) AS first_kept_id, CAST(NULL AS STRING) AS summary
FROM conversations
"""

_TOOLS = """
WITH ranked AS (
  SELECT event_id, user_id, event_type, props, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rk FROM events),
named AS (
  SELECT *, 'u' || CAST(user_id AS STRING) AS s, CAST(rk AS STRING) AS r, CAST(event_id AS STRING) AS e, CAST(event_id % 40 AS STRING) AS f,
         CASE event_type WHEN 'view' THEN 'read' WHEN 'click' THEN 'edit' WHEN 'signup' THEN 'write' ELSE 'bash' END AS tool FROM ranked),
rows_ AS (
  SELECT s AS session_id, rk * 4 AS seq, s || '-' || r || 'q' AS entry_id, 'message' AS kind, 'user' AS role, 'text' AS type,
         CASE WHEN rk = 1 THEN 'Build the report for user ' || s || chr(10) || 'Always keep the totals of ' || s || ' exact'
              WHEN rk % 27 = 10 THEN 'Always run the tests of step ' || r || chr(10) || 'and carry on'
              WHEN rk % 27 = 19 THEN 'Actually, use the new layout from step ' || r
              ELSE 'Please go on with step ' || r END AS text,
         CAST(NULL AS STRING) AS call_id, CAST(NULL AS STRING) AS tool_name, CAST(NULL AS STRING) AS arguments, false AS is_error, CAST(NULL AS STRING) AS first_kept_id, CAST(NULL AS STRING) AS summary
  FROM named WHERE rk % 9 = 1
  UNION ALL
  SELECT s, rk * 4 + 1, s || '-' || r || 'c', 'message', 'assistant', 'toolCall', CAST(NULL AS STRING), 'k' || e, tool,
         CASE WHEN tool <> 'bash' THEN '{"path":"/Users/x/dev/app/src/f' || f || '.ts"}'
              WHEN event_type = 'purchase' THEN '{"command":"git commit -q -m ''step ' || r || ' closed''"}'
              ELSE '{"command":"make f' || f || '"}' END, false, CAST(NULL AS STRING), CAST(NULL AS STRING)
  FROM named
  UNION ALL
  SELECT s, rk * 4 + 2, s || '-' || r || 'r', 'message', 'toolResult', 'toolResult',
         CASE WHEN event_type = 'error' THEN 'building f' || f || chr(10) || 'error TS' || CAST(1000 + event_id % 9000 AS STRING) || ': cannot find name v' || e || chr(10) || 'done'
              WHEN event_id % 5 = 0 THEN 'read f' || f || chr(10) || 'warning: code=W_' || CAST(event_id % 50 AS STRING) || ' in f' || f
              WHEN event_id % 7 = 0 THEN props
              ELSE 'ok ' || e || chr(10) || 'lines of f' || f END,
         CASE WHEN event_id % 11 <> 0 THEN 'k' || e END, tool, CAST(NULL AS STRING), event_type = 'error', CAST(NULL AS STRING), CAST(NULL AS STRING)
  FROM named
  UNION ALL
  SELECT s, rk * 4 + 3, s || '-' || r || 'z', 'compaction', CAST(NULL AS STRING), CAST(NULL AS STRING), CAST(NULL AS STRING), CAST(NULL AS STRING), CAST(NULL AS STRING), CAST(NULL AS STRING), false,
         CASE WHEN user_id % 3 = 0 THEN s || '-18c' ELSE 'missing' END, '[Session Goal]' || chr(10) || '- Build the report for user ' || s || chr(10) || chr(10) || '[Files And Changes]' || chr(10) || '- Modified: app/src/old' || f || '.ts'
  FROM named WHERE rk = 20 AND user_id % 3 <> 2),
linked AS (SELECT *, lag(entry_id) OVER (PARTITION BY session_id ORDER BY seq) AS p1, lag(entry_id, 3) OVER (PARTITION BY session_id ORDER BY seq) AS p3, row_number() OVER (PARTITION BY session_id ORDER BY seq) AS nth FROM rows_)
SELECT session_id, CAST(seq AS BIGINT) AS seq, 0 AS block_ix, entry_id, CASE WHEN nth % 17 = 0 THEN p3 ELSE p1 END AS parent_id, kind, role, CAST(seq AS BIGINT) AS ts, type, text, call_id, tool_name, arguments, is_error, first_kept_id, summary
FROM linked
"""

#: The body of a WITH clause that defines ``blocks``.
BLOCKS_SQL = f"chat AS ({_CHAT}), tools AS ({_TOOLS}), blocks AS (SELECT * FROM chat UNION ALL SELECT * FROM tools)"


def blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(f"SELECT * FROM ({_CHAT.replace('FROM conversations', 'FROM {conversations}')}) UNION ALL SELECT * FROM ({_TOOLS.replace('FROM events', 'FROM {events}').replace('{\"', '{{\"').replace('\"}', '\"}}')})", conversations=spark.read.parquet(f"{sf_dir}/conversations.parquet"), events=spark.read.parquet(f"{sf_dir}/events.parquet"))


def chats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(_CHAT.replace("FROM conversations", "FROM {conversations}"), conversations=spark.read.parquet(f"{sf_dir}/conversations.parquet"))


def tools(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blocks(spark, sf_dir).where("session_id like 'u%'")
