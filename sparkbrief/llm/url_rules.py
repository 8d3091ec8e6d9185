"""URL filters with redirect equivalence.

Rules block or allow a host with its subdomains, below a path. A url's own rule (the longest that fits) decides. A
url without a rule takes part in its equivalence class: urls connected by redirects, canonical links or a common
normal form. If a member of the class is blocked and none is explicitly allowed, the class is blocked.

Classes are connected components found in Spark over distinct urls; only urls of classes of two or more nodes are
edges, and rules, a short list given by the caller, are the only thing put into the plan as constants.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._components import connected_components
from ._store import Store


@dataclass(frozen=True)
class Rule:
    """``host`` and its subdomains, paths that start with ``path``."""

    verdict: str
    host: str
    path: str

    @classmethod
    def parse(cls, line: str) -> Rule:
        """``block example.com/de/``: a verdict, then a host and a path from the first slash."""
        verdict, _, pattern = line.strip().partition(" ")
        host, slash, path = pattern.strip().partition("/")
        if verdict not in ("allow", "block") or not host:
            raise ValueError(f"not a rule: {line!r}")
        return cls(verdict, host, slash + path)

    @property
    def pattern(self) -> str:
        return self.host + self.path


RULES = tuple(map(Rule.parse, ("block net/", "allow example.net/en/", "block example.com/de/", "allow org/fr/")))

_A_Z = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def fold(c: Column) -> Column:
    return F.translate(c, _A_Z, _A_Z.lower())


def host_of(url: Column) -> Column:
    """What follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    return fold(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; else empty."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: Sequence[Rule]) -> Column:
    """A struct of the pattern and the verdict of the longest rule that fits; at the same length, allow before block."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for r in sorted(rules, key=lambda r: (len(r.pattern), r.verdict == "allow", r.pattern)):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        out = F.when(fits, F.struct(F.lit(r.pattern).alias("rule"), F.lit(r.verdict).alias("verdict"))).otherwise(out)
    return out


def normal_form(url: Column) -> Column:
    """A key common to spellings of one address: scheme, fragment, default port, tracking parameters and a last slash go."""
    query = F.regexp_replace(F.regexp_extract(url, r"(?s)^[^?#]*\?([^#]*)", 1), r"(?:^|&)(?:utm_[A-Za-z]+|gclid|fbclid|ref)=[^&]*", "")
    query = F.regexp_replace(query, "^&", "")
    return F.when(
        url.contains("://"),
        F.concat(F.lit("//"), F.regexp_replace(host_of(url), r":(?:80|443)$", ""), F.regexp_replace(path_of(url), "/$", ""), F.when(query != "", F.concat(F.lit("?"), query)).otherwise("")),
    )


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which stands in the plan once however often ``body`` names it."""
    return F.transform(F.array(value), body)[0]


def _attribute(tag: Column, name: str) -> Column:
    pattern = rf"""(?is)\b{name}\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))"""
    return _let(tag, lambda t: F.coalesce(*(F.nullif(F.regexp_extract(t, pattern, i), F.lit("")) for i in (1, 2, 3))))


def _without_dots(url: Column) -> Column:
    """A path with what follows it, without ``.`` and ``..`` segments."""
    path, rest = F.regexp_extract(url, r"(?s)^[^?#]*", 0), F.regexp_extract(url, r"(?s)^[^?#]*(.*)", 1)
    steps = F.aggregate(
        F.split(F.substr(path, F.lit(2)), "/"),
        F.array().cast("array<string>"),
        lambda to, s: F.when(s == "..", F.slice(to, F.lit(1), F.greatest(F.size(to) - 1, F.lit(0)))).when(s == ".", to).otherwise(F.concat(to, F.array(s))),
    )
    plain = _let(steps, lambda s: F.concat(F.lit("/"), F.array_join(s, "/"), F.when(path.rlike(r"/\.\.?$") & (F.size(s) > 0), "/").otherwise("")))
    return F.concat(F.when(path.rlike(r"/\.\.?(?:/|$)"), plain).otherwise(path), rest)


def resolve(target: Column, base: Column) -> Column:
    """``target`` as an absolute url, read as a link on a page at ``base``; null for other schemes than those with ``://`` and where a
    base without ``://`` leaves it relative. Dot segments of relative targets go."""

    def of(to: Column, at: Column) -> Column:
        root, place = F.regexp_extract(at, r"(?s)^.*?://[^/?#]*", 0), path_of(at)
        joined = F.when(to.startswith("?"), F.concat(place, to))
        joined = joined.when(to.startswith("#"), F.concat(place, F.regexp_extract(at, r"(?s)^[^?#]*(\?[^#]*)", 1), to))
        joined = joined.when(to.startswith("/"), to).otherwise(F.concat(F.when(place == "", "/").otherwise(F.regexp_replace(place, "[^/]*$", "")), to))
        return (
            F.when(to.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), F.when(to.rlike(r"^[^:]*://"), to))
            .when(root == "", F.lit(None))
            .when(to.startswith("//"), F.concat(F.regexp_extract(root, r"(?s)^(.*?:)//", 1), to))
            .otherwise(F.concat(root, _let(joined, _without_dots)))
        )

    return _let(target, lambda to: _let(base, lambda at: of(to, at)))


def declared_targets(html: Column, url: Column) -> Column:
    """The urls, made absolute, that a page names as its canonical address or sends its reader to: of all its tags, seen from its
    ``<base>`` if it has one, else from its own url. Tags within comments do not count; ``&amp;`` in a target is ``&``."""

    def of(page: Column) -> Column:
        links = F.filter(F.regexp_extract_all(page, F.lit(r"(?is)<link\b[^>]*>?"), F.lit(0)), lambda tag: F.array_contains(F.split(fold(_attribute(tag, "rel")), r"\s+"), "canonical"))
        metas = F.filter(F.regexp_extract_all(page, F.lit(r"(?is)<meta\b[^>]*>?"), F.lit(0)), lambda tag: F.trim(fold(_attribute(tag, "http-equiv"))) == "refresh")
        named = F.concat(F.transform(links, lambda tag: F.trim(_attribute(tag, "href"))), F.transform(metas, lambda tag: F.regexp_extract(tag, r"""(?is)url\s*=\s*['"]?([^'"\s>;]+)""", 1)))
        base = F.trim(_attribute(F.regexp_extract(page, r"(?is)<base\b[^>]*\bhref\b[^>]*>?", 0), "href"))
        targets = F.transform(F.filter(named, lambda u: u != ""), lambda u: F.regexp_replace(u, "&(?:amp|#38);", "&"))
        return _let(F.coalesce(resolve(base, url), url), lambda at: F.filter(F.transform(targets, lambda u: resolve(u, at)), lambda u: u.isNotNull()))

    return _let(F.when(html.contains("<!--"), F.regexp_replace(html, r"(?s)<!--.*?(?:-->|\z)", "")).otherwise(html), of)


def page_edges(pages: DataFrame, url: str = "url", html: str | None = "html") -> DataFrame:
    """(a, b): every url and its normal form, and its normal form and those of its canonical and refresh targets."""
    rows = pages.select(F.col(url).alias("url"), *([F.col(html).alias("html")] if html else [])).where("url is not null")
    spelling = rows.select("url").distinct().select(F.col("url").alias("a"), normal_form(F.col("url")).alias("b"))
    if not html:
        return spelling
    # a tag that counts holds one of these words
    tagged = rows.where(F.col("html").rlike("(?i)canonical|refresh"))
    named = tagged.select("url", F.explode(declared_targets(F.col("html"), F.col("url"))).alias("to"))
    ends = named.select(normal_form(F.col("url")).alias("from"), "to", normal_form(F.col("to")).alias("b"))
    return spelling.unionByName(ends.select(F.explode(F.array("from", "to")).alias("a"), "b"))


def judge_urls(pages: DataFrame, rules: Sequence[Rule] = RULES, redirects: DataFrame | None = None, url: str = "url", html: str | None = "html", key: str = "page_id") -> DataFrame:
    """One row per input row: page_id, url, host, path, rule, verdict, class_url (least url of its class) and
    ``inherited`` (the verdict came from an alias).

    ``redirects`` may add edges (a, b) between urls; urls that only occur there take part with their own rules. A null url
    and one without ``://`` have an empty host and path; a null url has no aliases and is allowed. Repeated rows
    each come back. An empty table gives an empty result. Other columns are ignored.
    """
    store = Store(pages.sparkSession, "url-rules")
    edges = page_edges(pages, url, html)
    if redirects is not None:
        more = redirects.select("a", "b")
        edges = edges.unionByName(more)
        for side in ("a", "b"):
            edges = edges.unionByName(more.select(F.col(side).alias("a"), normal_form(F.col(side)).alias("b")))
    edges = store.put(edges.where("a is not null and b is not null and a <> b").distinct(), "aliases")
    # a normal form that only one url has, and that names no other, connects nothing
    degree = edges.groupBy("b").agg(F.count("*").alias("n"))
    named = edges.select(F.col("a").alias("b")).distinct()
    live = edges.join(degree.where("n = 1").join(named, "b", "left_anti").select("b"), "b", "left_anti")
    classes = store.put(connected_components(live, store), "classes")

    def judged(c: Column) -> Column:
        return rule_of(host_of(c), path_of(c), rules)

    # normal forms start with // and are keys, not urls: no rule is asked for them
    is_url = ~F.col("node").startswith("//")
    votes = classes.withColumn("own", F.when(is_url, judged(F.col("node"))["verdict"]))
    votes = votes.groupBy("root").agg(F.max(F.col("own") == "block").alias("blocked"), F.max(F.col("own") == "allow").alias("allowed"), F.min(F.when(is_url, F.col("node"))).alias("class_url"))
    # written, as every table here that is joined by a key of which one value may hold very many rows
    votes = store.put(votes, "votes")
    inherited = classes.join(votes, "root").select(F.col("node").alias("url"), "class_url", (F.coalesce("blocked", F.lit(False)) & ~F.coalesce("allowed", F.lit(False))).alias("bad"))

    inherited = store.put(inherited, "inherited")
    rows = pages.select(F.col(key).alias("page_id"), F.col(url).alias("url")).join(inherited, "url", "left")
    rows = rows.select("page_id", "url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), judged(F.col("url")).alias("own"), F.coalesce("class_url", "url").alias("class_url"), F.coalesce("bad", F.lit(False)).alias("bad"))
    verdict = F.coalesce(F.col("own.verdict"), F.when(F.col("bad"), "block").otherwise("allow"))
    return rows.select("page_id", "url", "host", "path", F.col("own.rule").alias("rule"), verdict.alias("verdict"), "class_url", (F.col("own").isNull() & F.col("bad")).alias("inherited"))
