"""DuckDB SQL for the queries that SQL can express on whole tables, one constant a query."""

_WORDS = r"""regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"""

op3_host_rules = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, source, coalesce(text, '') AS t, {_WORDS} AS w FROM documents),
pos AS (SELECT rid, w, unnest(range(1, len(w) - 1)) AS i FROM d WHERE len(w) > 3),
win AS (SELECT rid, i, count(*) OVER (PARTITION BY rid, w[i], w[i + 1], w[i + 2]) AS n FROM pos),
hit AS (SELECT DISTINCT rid, unnest([i, i + 1, i + 2]) AS p FROM win WHERE n > 1),
rep AS (SELECT rid, count(*) AS n_repeat_words FROM hit GROUP BY rid),
m AS (
  SELECT d.rid, doc_id, source, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
         length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
         (len(list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')))
          - len(list_distinct(list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')))))::BIGINT AS n_dup_lines,
         coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words
  FROM d LEFT JOIN rep ON rep.rid = d.rid
),
b AS (SELECT *, (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed FROM m),
h AS (SELECT source, count(*) AS n, count(*) FILTER (base_failed) AS f FROM b GROUP BY source),
mv AS (SELECT avg(f / n) AS m, var_pop(f / n) AS v FROM h),
st AS (SELECT m, least(1e6, greatest(1.0, CASE WHEN v > 0 THEN m * (1 - m) / v - 1 ELSE 1e6 END)) AS s FROM mv),
q AS (SELECT source, n, s, (f + m * s) / (n + s) AS rate FROM h, st),
r AS (SELECT source, rate - 1.645 * sqrt(rate * (1 - rate) / (n + s + 1)) AS least FROM q)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, (NOT base_failed AND least <= 0.5) AS kept
FROM b JOIN r ON b.source IS NOT DISTINCT FROM r.source
"""

op7_line_runs = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
x AS (SELECT rid, doc_id, unnest(l) AS line, unnest(range(len(l))) AS k FROM d),
y AS (SELECT *, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM x),
c AS (SELECT key, max(doc_id) AS holder FROM y WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
z AS (SELECT y.*, (c.key IS NOT NULL AND y.doc_id <> c.holder) AS gone FROM y LEFT JOIN c ON y.key = c.key)
SELECT any_value(doc_id) AS doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY k) FILTER (NOT gone), '')) AS kept_sha256
FROM z GROUP BY rid
"""

op5_passages = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {_WORDS} AS w FROM documents),
p AS (SELECT rid, doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM d WHERE len(w) >= 50),
k AS (SELECT rid, doc_id, i, sha256(array_to_string(list_slice(w, i, i + 49), ' ')) AS h FROM p),
f AS (SELECT h, min(doc_id) AS first FROM k GROUP BY h),
g AS (SELECT rid, list(i) AS s FROM k JOIN f USING (h) WHERE doc_id > first GROUP BY rid),
r AS (SELECT rid, list_distinct(flatten(list_transform(s, lambda i: range(i, i + 50)))) AS gone FROM g),
u AS (SELECT d.rid, d.doc_id, w, unnest(range(1, greatest(len(w), 1) + 1)) AS i FROM d),
x AS (SELECT rid, unnest(gone) AS i, true AS gone FROM r)
SELECT any_value(u.doc_id) AS doc_id, any_value(len(w))::BIGINT AS n_words, count(*) FILTER (x.gone) AS n_removed,
       sha256(coalesce(string_agg(w[u.i], ' ' ORDER BY u.i) FILTER (x.gone IS NULL), '')) AS kept_sha256
FROM u LEFT JOIN x ON u.rid = x.rid AND u.i = x.i GROUP BY u.rid
"""

_FOLDED = r"""regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"""

op8_contamination = rf"""
WITH b AS (SELECT item_id, {_FOLDED} AS w FROM benchmark),
s AS (SELECT item_id, w, least(13, len(w)) AS n FROM b WHERE len(w) > 0),
v AS (SELECT DISTINCT item_id, n, array_to_string(list_slice(w, i, i + n - 1), ' ') AS k FROM (SELECT *, unnest(range(1, len(w) - n + 2)) AS i FROM s)),
d AS (SELECT row_number() OVER () AS rid, doc_id, {_FOLDED} AS w FROM documents),
p AS (SELECT rid, w, unnest(range(1, len(w) + 1)) AS i FROM d),
z AS (SELECT DISTINCT n FROM v),
x AS (SELECT rid, i, z.n, array_to_string(list_slice(w, i, i + z.n - 1), ' ') AS k FROM p, z WHERE i + z.n - 1 <= len(w)),
h AS (SELECT rid, i, x.n, item_id FROM x JOIN v ON x.k = v.k AND x.n = v.n),
c AS (SELECT rid, count(DISTINCT q) AS n_hit FROM (SELECT rid, unnest(range(i, i + n)) AS q FROM h) GROUP BY rid),
t AS (SELECT rid, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS names FROM (SELECT DISTINCT rid, item_id::VARCHAR AS item_id FROM h WHERE item_id IS NOT NULL) GROUP BY rid)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(names, '')) AS items_sha256,
       (coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w)) AS contaminated
FROM d LEFT JOIN c ON d.rid = c.rid LEFT JOIN t ON d.rid = t.rid
"""


_HOST = r"""translate(regexp_extract({0}, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"""
_PATH = r"""regexp_extract({0}, '(?s)^.*?://[^/?#]*([^?#]*)', 1)"""


def _rule(of: str, what: int) -> str:
    host, path = _HOST.format(of), _PATH.format(of)
    rules = (("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"), ("net", "/", "block"))
    cases = " ".join(f"WHEN ({host} = '{h}' OR ends_with({host}, '.{h}')) AND starts_with({path}, '{p}') THEN '{(h + p, v)[what]}'" for h, p, v in rules)
    return f"CASE {cases} END"


def _normal(of: str) -> str:
    query = rf"regexp_replace(regexp_replace(regexp_extract({of}, '(?s)^[^?#]*\?([^#]*)', 1), '(?:^|&)(?:utm_[A-Za-z]+|gclid|fbclid|ref)=[^&]*', '', 'g'), '^&', '')"
    return rf"CASE WHEN contains({of}, '://') THEN '//' || regexp_replace({_HOST.format(of)}, ':(?:80|443)$', '') || regexp_replace({_PATH.format(of)}, '/$', '') || CASE WHEN {query} <> '' THEN '?' || {query} ELSE '' END END"


op2_url_rules = rf"""
WITH RECURSIVE n AS (
  SELECT url, html, {_normal("url")} AS key FROM pages WHERE url IS NOT NULL),
l AS (SELECT url, key, regexp_extract(html, '(?is)<link\b[^>]*\brel\s*=\s*["'']?canonical["''\s>][^>]*>?') AS a, regexp_extract(html, '(?is)<meta\b[^>]*\bhttp-equiv\s*=\s*["'']?refresh["''\s>][^>]*>?') AS m FROM n),
t AS (SELECT key, regexp_extract(a, '(?is)\bhref\s*=\s*["'']?([^\s"''>]+)', 1) AS target FROM l UNION ALL SELECT key, regexp_extract(m, '(?is)url\s*=\s*[''"]?([^''"\s>;]+)', 1) FROM l),
k AS (SELECT key, target, {_normal("target")} AS to_key FROM t WHERE contains(target, '://')),
e AS (SELECT url AS a, key AS b FROM n WHERE key IS NOT NULL UNION SELECT key, to_key FROM k UNION SELECT target, to_key FROM k),
s AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
c AS (SELECT DISTINCT a AS node, a AS peer FROM s UNION SELECT c.node, s.b FROM c JOIN s ON c.peer = s.a),
v AS (SELECT node, bool_or(coalesce({_rule("peer", 1)} = 'block', false)) AND NOT bool_or(coalesce({_rule("peer", 1)} = 'allow', false)) AS bad FROM c GROUP BY node)
SELECT page_id, coalesce({_HOST.format("url")}, '') AS host, coalesce({_PATH.format("url")}, '') AS path, {_rule("url", 0)} AS rule,
       coalesce({_rule("url", 1)}, CASE WHEN v.bad THEN 'block' ELSE 'allow' END) AS verdict
FROM pages LEFT JOIN v ON pages.url = v.node
"""
