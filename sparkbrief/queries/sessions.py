"""Live spans, cuts, trees and placement over the derived log."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import cut, frames, tree
from ..plans import compact
from ..schema import Compact
from ..sources import derived
from . import registry

QUERIES, ORACLES, register = registry()

#: Small budgets, so that the rules matter on short sessions.
SMALL = Compact(min_tail=60, max_tail=200)

_LIVE = f"""WITH RECURSIVE {derived.BLOCKS_SQL},
    z AS (SELECT session_id, max(seq) AS zat, arg_max(first_kept_id, seq) AS kept FROM blocks WHERE kind = 'compaction' GROUP BY session_id),
    k AS (SELECT z.session_id, min(b.seq) AS ks FROM z JOIN blocks b ON b.session_id = z.session_id AND b.entry_id = z.kept GROUP BY z.session_id),
    g AS (SELECT z.session_id, coalesce(ks, zat + 1) AS first_seq, ks IS NULL AS orphan FROM z LEFT JOIN k ON z.session_id = k.session_id),
    live AS (SELECT b.*, CASE type WHEN 'toolCall' THEN strlen(arguments) ELSE strlen(text) END AS bytes FROM blocks b LEFT JOIN g ON b.session_id = g.session_id WHERE kind = 'message' AND (first_seq IS NULL OR seq >= first_seq)),
    num AS (SELECT session_id, seq, entry_id, role, bytes, row_number() OVER w - 1 AS idx, CAST(trunc(bytes / 3.8) AS BIGINT) AS tok,
            sum(bytes) OVER b AS bte, CAST(sum(trunc(bytes / 3.8)) OVER b AS BIGINT) AS tte, CASE WHEN role = 'user' THEN sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER b END AS turn
            FROM live WINDOW w AS (PARTITION BY session_id ORDER BY seq), b AS (PARTITION BY session_id ORDER BY seq DESC ROWS UNBOUNDED PRECEDING)),
    tot AS (SELECT session_id, count(*) AS n, coalesce(max(turn), 0) AS users FROM num GROUP BY session_id),
    bud AS (SELECT session_id, (SELECT min(j.idx) FROM num j WHERE j.session_id = t.session_id AND j.role <> 'toolResult' AND j.idx >=
              greatest(1, coalesce((SELECT max(i.idx) FROM num i WHERE i.session_id = t.session_id AND i.tte >= 200), 1))) AS budget FROM tot t)"""
_CUT = """cutk AS (SELECT t.session_id, k, n, users, CASE WHEN k = 0 THEN true WHEN users < 2 THEN false WHEN k = users OR u.idx = 0 THEN true ELSE false END AS all_,
             CASE WHEN k = 0 THEN NULL WHEN users < 2 THEN CASE WHEN n >= 4 THEN budget END WHEN k = users OR u.idx = 0 THEN NULL ELSE u.idx END AS cut
             FROM keeps t JOIN bud ON bud.session_id = t.session_id LEFT JOIN num u ON u.session_id = t.session_id AND u.turn = t.k)"""


@register(f"{_LIVE} SELECT session_id, count(*) AS messages, CAST(min(seq) AS BIGINT) AS first_seq FROM live GROUP BY session_id")
def live_span(spark, sf_dir):
    d = cut.live_blocks(derived.blocks(spark, sf_dir))
    return d.groupBy("session_id").agg(F.count("*").alias("messages"), F.min("seq").alias("first_seq"))


@register(f"{_LIVE} SELECT session_id, CAST(first_seq AS BIGINT) AS first_seq, orphan FROM g")
def live_boundary(spark, sf_dir):
    return cut.live_entries(derived.blocks(spark, sf_dir))


@register(f"""{_LIVE}, keeps AS (SELECT *, 2 AS k FROM tot), {_CUT}
    SELECT session_id, n, CAST(users AS BIGINT) AS users, CAST(cut AS BIGINT) AS cut, all_ AS compact_all, (all_ OR cut IS NOT NULL) AS possible FROM cutk""")
def cut_keep_n(spark, sf_dir):
    d = cut.cuts(derived.blocks(spark, sf_dir), Compact(keep=2, max_tail=200))
    return d.select("session_id", "n", F.col("users").cast("long").alias("users"), F.col("cut").cast("long").alias("cut"), "compact_all", "possible")


@register(f"{_LIVE} SELECT session_id, CAST(budget AS BIGINT) AS budget FROM bud WHERE budget IS NOT NULL")
def cut_budget(spark, sf_dir):
    d = cut.numbered(derived.blocks(spark, sf_dir), SMALL)
    start = d.groupBy("session_id").agg(F.coalesce(F.max(F.when(F.col("tokens_to_end") >= SMALL.max_tail, F.greatest("idx", F.lit(1)))), F.lit(1)).alias("from"))
    return d.join(start, "session_id").where("idx >= from and role <> 'toolResult'").groupBy("session_id").agg(F.min("idx").cast("long").alias("budget"))


_GROWN = """sel AS (SELECT t.session_id, t.n, t.users, CASE WHEN users < 2 THEN 1 WHEN (SELECT trunc(bte / 3.8) FROM num u WHERE u.session_id = t.session_id AND u.turn = 1) > 60 THEN 1
              ELSE greatest(1, coalesce((SELECT max(u.turn) FROM num u WHERE u.session_id = t.session_id AND u.turn < t.users AND u.idx > 0 AND trunc(bte / 3.8) <= 200), 1)) END AS k FROM tot t)"""


@register(f"{_LIVE}, {_GROWN} SELECT session_id, CAST(k AS INTEGER) AS keep, k <> 1 AS grown FROM sel")
def smart_keep(spark, sf_dir):
    return cut.cuts(derived.blocks(spark, sf_dir), SMALL).select("session_id", "keep", "grown")


@register(f"""{_LIVE}, {_GROWN}, keeps AS (SELECT * FROM sel), {_CUT},
    tl AS (SELECT c.*, budget, (SELECT tte FROM num u WHERE u.session_id = c.session_id AND u.idx = c.cut) AS tail FROM cutk c JOIN bud ON bud.session_id = c.session_id),
    rs AS (SELECT *, CASE WHEN all_ AND budget IS NOT NULL THEN 'no_anchor' WHEN NOT all_ AND tail > 400 AND budget > cut THEN 'oversized_tail' END AS reason FROM tl)
    SELECT session_id, CAST(CASE WHEN reason IS NOT NULL THEN budget ELSE cut END AS BIGINT) AS cut, (all_ AND reason IS NULL) AS compact_all, reason FROM rs""")
def cut_rescue(spark, sf_dir):
    d = cut.cuts(derived.blocks(spark, sf_dir), SMALL)
    return d.select("session_id", F.col("cut").cast("long").alias("cut"), "compact_all", "reason")


@register(f"""{_LIVE}, keeps AS (SELECT *, 1 AS k FROM tot), {_CUT},
    p AS (SELECT l.session_id, bytes, NOT all_ AND coalesce(idx >= cut, true) AS kept FROM live l JOIN num USING (session_id, seq, bytes) JOIN cutk c ON c.session_id = l.session_id)
    SELECT session_id, CAST(trunc(coalesce(sum(bytes) FILTER (kept), 0) / 3.8) AS BIGINT) AS kept_tokens, CAST(trunc(coalesce(sum(bytes) FILTER (NOT kept), 0) / 3.8) AS BIGINT) AS summarized_tokens FROM p GROUP BY session_id""")
def compact_accounting(spark, sf_dir):
    return compact.plan(derived.blocks(spark, sf_dir), Compact(keep=1, max_tail=200)).select("session_id", "kept_tokens", "summarized_tokens")


@register(f"""{_LIVE}, c AS (SELECT session_id, min(seq) AS kept_seq FROM live WHERE role <> 'user' GROUP BY session_id)
    SELECT session_id, CAST(kept_seq AS BIGINT) AS kept_seq, CAST(coalesce((SELECT min(seq) FROM blocks b WHERE b.session_id = c.session_id AND b.role = 'user' AND b.seq >= kept_seq), -1) AS BIGINT) AS clean_seq FROM c""")
def clean_cut(spark, sf_dir):
    b = derived.blocks(spark, sf_dir)
    at = cut.live_blocks(b).where("role <> 'user'").groupBy("session_id").agg(F.min("seq").alias("kept_seq"))
    return cut.clean_cut(b, at)


_TREE = f"WITH RECURSIVE {derived.BLOCKS_SQL}, n AS (SELECT session_id, entry_id, seq, parent_id FROM blocks WHERE session_id LIKE 'u%'),"


@register(f"""{_TREE} leaf AS (SELECT session_id, arg_max(entry_id, seq) AS entry_id FROM n GROUP BY session_id),
    up AS (SELECT n.session_id, n.entry_id, n.seq, n.parent_id FROM n JOIN leaf USING (session_id, entry_id) UNION ALL SELECT n.session_id, n.entry_id, n.seq, n.parent_id FROM up JOIN n ON n.session_id = up.session_id AND n.entry_id = up.parent_id)
    SELECT session_id, entry_id, row_number() OVER (PARTITION BY session_id ORDER BY seq) - 1 AS pos FROM up""")
def recall_lineage(spark, sf_dir):
    return tree.lineage(derived.tools(spark, sf_dir)).select("session_id", "entry_id", "pos")


@register(f"""{_TREE} d AS (SELECT session_id, entry_id, 0 AS depth, entry_id AS root FROM n WHERE parent_id IS NULL UNION ALL SELECT n.session_id, n.entry_id, d.depth + 1, d.root FROM d JOIN n ON n.session_id = d.session_id AND n.parent_id = d.entry_id)
    SELECT session_id, count(*) AS entries, count(DISTINCT root) AS roots, CAST(max(depth) AS INTEGER) AS deepest FROM d GROUP BY session_id""")
def tree_depths(spark, sf_dir):
    d = tree.depths(derived.tools(spark, sf_dir))
    return d.groupBy("session_id").agg(F.count("*").alias("entries"), F.countDistinct("root").alias("roots"), F.max("depth").alias("deepest"))


#: Some results name parents that are not there.
_ORPHANS = "x AS (SELECT session_id, entry_id, seq, CASE WHEN seq % 20 = 6 THEN 'gone-' || parent_id ELSE parent_id END AS parent_id FROM n)"


def _orphans(spark, sf_dir):
    d = derived.tools(spark, sf_dir)
    return d.withColumn("parent_id", F.when(F.col("seq") % 20 == 6, F.concat(F.lit("gone-"), "parent_id")).otherwise(F.col("parent_id")))


@register(f"{_TREE} {_ORPHANS} SELECT session_id, entry_id, parent_id FROM x WHERE parent_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM x p WHERE p.session_id = x.session_id AND p.entry_id = x.parent_id)")
def tree_missing_parent(spark, sf_dir):
    return tree.missing_parents(_orphans(spark, sf_dir))


_FORWARD = """m AS (SELECT session_id, seq, entry_id, parent_id, lead(entry_id, 4) OVER (PARTITION BY session_id ORDER BY seq) AS ahead FROM n),
    c AS (SELECT session_id, seq, entry_id, CASE WHEN seq % 100 = 5 THEN ahead ELSE parent_id END AS parent_id FROM m)"""


def _forward(spark, sf_dir):
    from pyspark.sql.window import Window

    ahead = F.lead("entry_id", 4).over(Window.partitionBy("session_id").orderBy("seq"))
    d = derived.tools(spark, sf_dir).withColumn("ahead", ahead)
    return d.withColumn("parent_id", F.when(F.col("seq") % 100 == 5, F.col("ahead")).otherwise(F.col("parent_id"))).drop("ahead")


@register(f"""{_TREE} {_FORWARD},
    up AS (SELECT session_id, entry_id AS start, parent_id AS pos FROM c WHERE seq % 100 = 5 AND parent_id IS NOT NULL UNION SELECT up.session_id, up.start, c.parent_id FROM up JOIN c ON c.session_id = up.session_id AND c.entry_id = up.pos WHERE up.pos <> up.start AND c.parent_id IS NOT NULL)
    SELECT DISTINCT session_id, start AS entry_id FROM up WHERE pos = start""")
def reanchored_links(spark, sf_dir):
    """The log with some parents turned forward, as links that may be cut: those cut are the ones that lead back to their start."""
    n = _forward(spark, sf_dir).select("session_id", "entry_id", "seq", "parent_id", (F.col("seq") % 100 == 5).alias("logical"))
    out = tree.cut_reanchored(n.where("entry_id is not null"))
    return n.where("logical and parent_id is not null").select("session_id", "entry_id").join(out.where("parent_id is null").select("session_id", "entry_id"), ["session_id", "entry_id"])


@register(f"""{_TREE} m AS (SELECT session_id, seq, entry_id, parent_id, lead(entry_id, 4) OVER (PARTITION BY session_id ORDER BY seq) AS ahead FROM n),
    c AS (SELECT session_id, entry_id, CASE WHEN seq % 100 = 5 THEN ahead ELSE parent_id END AS parent_id FROM m),
    d AS (SELECT session_id, entry_id FROM c WHERE parent_id IS NULL UNION ALL SELECT c.session_id, c.entry_id FROM d JOIN c ON c.session_id = d.session_id AND c.parent_id = d.entry_id)
    SELECT session_id, count(*) AS in_cycles FROM c WHERE NOT EXISTS (SELECT 1 FROM d WHERE d.session_id = c.session_id AND d.entry_id = c.entry_id) GROUP BY session_id""")
def tree_cycle_check(spark, sf_dir):
    """The log with some parents turned forward: entries from which no root is reached."""
    d = _forward(spark, sf_dir)
    return tree.in_cycles(d).groupBy("session_id").agg(F.count("*").alias("in_cycles"))


@register(f"""{_TREE} {_ORPHANS}, w AS (SELECT *, lag(entry_id) OVER (PARTITION BY session_id ORDER BY seq) AS prev FROM x),
    y AS (SELECT session_id, entry_id, seq, CASE WHEN parent_id IN (SELECT entry_id FROM w q WHERE q.session_id = w.session_id) THEN parent_id ELSE prev END AS parent_id FROM w),
    leaf AS (SELECT session_id, arg_max(entry_id, seq) AS entry_id FROM y GROUP BY session_id),
    up AS (SELECT y.session_id, y.entry_id, y.parent_id FROM y JOIN leaf USING (session_id, entry_id) UNION ALL SELECT y.session_id, y.entry_id, y.parent_id FROM up JOIN y ON y.session_id = up.session_id AND y.entry_id = up.parent_id)
    SELECT session_id, count(*) AS entries FROM up GROUP BY session_id""")
def active_branch(spark, sf_dir):
    d = tree.active_branch(_orphans(spark, sf_dir))
    return d.groupBy("session_id").agg(F.count("*").alias("entries"))


@register(f"""WITH {derived.BLOCKS_SQL} SELECT r.session_id, r.seq, r.block_ix, r.call_id, coalesce((SELECT arg_max(c.tool_name, c.seq) FROM blocks c WHERE c.session_id = r.session_id AND c.call_id = r.call_id AND c.type = 'toolCall' AND c.seq < r.seq), '') AS tool_name
    FROM blocks r WHERE r.type = 'toolResult' AND r.call_id IS NOT NULL""")
def tool_name_asof(spark, sf_dir):
    return tree.tool_names(derived.tools(spark, sf_dir))


@register(f"""WITH {derived.BLOCKS_SQL} SELECT r.session_id, r.seq, coalesce((SELECT min(u.seq) FROM blocks u WHERE u.session_id = r.session_id AND u.role = 'user' AND u.seq > r.seq), (SELECT max(u.seq) FROM blocks u WHERE u.session_id = r.session_id AND u.role = 'user' AND u.seq < r.seq)) AS target
    FROM blocks r WHERE r.role = 'toolResult'""")
def next_user_placement(spark, sf_dir):
    return frames.placements(derived.tools(spark, sf_dir))
