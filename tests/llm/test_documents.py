"""Operators on documents against brute-force statements of their contracts, with nulls, ties, repeated rows and clashing names."""

from __future__ import annotations

import hashlib
import itertools
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkbrief.llm import disclosure, host_rules
from sparkbrief.llm._components import connected_components
from sparkbrief.llm._store import Store
from sparkbrief.llm.chosen_path import Join, runs_needed, similar_groups
from sparkbrief.llm.contamination import scan
from sparkbrief.llm.line_runs import dedup_lines
from sparkbrief.llm.mixing import Mix, Mixture, _drawn_of, split_tree, targets
from sparkbrief.llm.passages import remove_repeats
from sparkbrief.llm.url_rules import Rule, declared_targets, judge_urls

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
ODD = [(900, None), (901, ""), (902, " \n\t"), (903, "a"), (904, "a b\nc"), (905, "é ü 漢字 é ü 漢字")]


def frame(spark, rows, extra=True):
    """Rows (doc_id, text) with columns whose names operators use themselves."""
    d = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    names = ("row", "n", "h1", "lines", "size", "keep_0", "group", "host", "tokens")
    return d.withColumns({n: F.lit("x") for n in names} | {"source": F.when(F.col("doc_id") % 7 == 0, None).otherwise(F.concat(F.lit("s"), F.col("doc_id") % 3))}) if extra else d


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(2)
    base = [[rng.choice("abcdefgh") * rng.randint(1, 2) for _ in range(30)] for _ in range(6)]
    rows = []
    for i in range(120):
        w = []
        for _ in range(rng.randint(0, 5)):
            b, a = rng.choice(base), rng.randint(0, 20)
            w += b[a : a + rng.randint(1, 30)]
        rows.append((i, " ".join(w) + rng.choice(["", " ", "\n"])))
    return rows + ODD + [(950, rows[5][1]), (951, rows[5][1]), (3, rows[3][1])]


def test_host_measures(spark):
    rng = random.Random(1)
    rows = [(i, " ".join(rng.choice(["ab", "cd", "éf", "\n", "\t", "#", "||", ""]) for _ in range(rng.randint(0, 40)))) for i in range(200)] + ODD

    def brute(t):
        t = t or ""
        w = WORDS.findall(t)
        c = Counter(zip(w, w[1:], w[2:], strict=False))
        m = [False] * len(w)
        for i in range(len(w) - 2):
            if c[tuple(w[i : i + 3])] > 1:
                m[i] = m[i + 1] = m[i + 2] = True
        seen, dup = set(), 0
        for line in t.split("\n"):
            if WORDS.search(line):
                dup += line in seen
                seen.add(line)
        return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, sum(m)

    got = host_rules.judge(frame(spark, rows)).collect()
    assert {r.doc_id: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got} == {i: brute(t) for i, t in rows}


def test_bad_hosts_lose_good_documents(spark):
    good = " ".join(f"w{i}" for i in range(60))
    rows = [(i, "bad" if i < 40 else "fine", good if i % 40 == 0 or i >= 40 else "short") for i in range(80)]
    d = spark.createDataFrame(rows, "doc_id long, source string, text string")
    out = {r.doc_id: r for r in host_rules.judge(d).collect()}
    assert not out[0].kept and not out[0].base_failed and out[41].kept
    assert out[0].host_rate < 39 / 40 + 0.01 and 0.5 < out[0].host_least < out[0].host_rate
    # three of four failing documents are no certainty, thirty of forty are
    few = [(i, "few" if i < 4 else "many" if i < 44 else "fine", "short" if i % 4 and i < 44 else good) for i in range(144)]
    out = {r.doc_id: r.kept for r in host_rules.judge(spark.createDataFrame(few, "doc_id long, source string, text string")).collect()}
    assert out[0] and not out[4] and out[50]
    assert host_rules.judge(d.limit(0)).count() == 0


def test_passages(spark, texts):
    length = 7
    # repeated rows, rows of one id with other texts, rows without an id
    rows = [*texts, (7, texts[9][1]), (7, texts[11][1]), (7, texts[11][1] + " "), (8, texts[9][1] + " x y"), (None, texts[12][1]), (None, texts[12][1]), (60, None)]
    first = {}
    for d, t in rows:
        w = WORDS.findall(t or "")
        for i in range(len(w) - length + 1):
            if d is not None:
                k = tuple(w[i : i + length])
                first[k] = min(first.get(k, d), d)
    want = []
    for d, t in rows:
        w = WORDS.findall(t or "")
        gone = [False] * len(w)
        for i in range(len(w) - length + 1):
            if d is not None and first[tuple(w[i : i + length])] < d:
                gone[i : i + length] = [True] * length
        kept = " ".join(x for x, g in zip(w, gone, strict=True) if not g)
        want.append((-1 if d is None else d, len(w), sum(gone), sha(kept), kept))
    got = remove_repeats(frame(spark, rows), length).collect()
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.n_words, r.n_removed, r.kept_sha256, r.kept) for r in got) == sorted(want)
    assert sum(w[2] for w in want) > 100
    assert all(sum(b - a for a, b in r.removed) == r.n_removed for r in got)
    assert remove_repeats(frame(spark, rows[:1]).limit(0)).count() == 0


def test_lines(spark):
    rng = random.Random(3)
    pool = [" Some line that is LONG enough", "some line that is long enough\t", "short", "another line of text here ä", "", "x" * 20, "x" * 19]
    rows = [(i, "\n".join(rng.choice(pool) for _ in range(rng.randint(0, 6)))) for i in range(40)] + ODD + [(990, "only these two hold it, so it stays"), (991, "only these two hold it, so it stays")]
    # rows of one id with other texts are one document; repeated rows; rows without an id
    rows += [(7, pool[0] + "\nmine alone, and nobody else's"), (7, "own line of the second row\n" + pool[3]), (8, rows[8][1]), (None, pool[0]), (None, pool[3] + "\n"), (2000, pool[0])]
    holders = defaultdict(set)
    fold = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    key = lambda line: line.strip(" \t\n\v\f\r").translate(fold)
    for d, t in rows:
        for line in (t or "").split("\n") if d is not None else ():
            holders[key(line)].add(d)
    want = []
    for d, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if not (d is not None and len(key(x)) >= 20 and len(holders[key(x)]) >= 3 and max(holders[key(x)]) != d)]
        want.append((d or -1, len(lines), len(lines) - len(kept), sha("\n".join(kept))))
    for batches, fanout in ((1, 2), (4, 2), (5, 3)):
        got = dedup_lines(frame(spark, rows), batches=batches, fanout=fanout).collect()
        assert sorted((r.doc_id or -1, r.n_lines, r.n_dropped, r.kept_sha256) for r in got) == sorted(want)
        assert all((r.kept or "") is not None and sha(r.kept or "") == r.kept_sha256 for r in got)
    assert dedup_lines(frame(spark, rows).limit(0)).count() == 0


def test_contamination(spark):
    items = [(1, " ".join(f"q{i}" for i in range(20))), (2, "Short ITEM here"), (10, "..."), (None, "null id"), (3, None), (4, "short item here")]
    q = items[0][1].split()
    rows = [(0, "x, " + " ".join(q[2:16]).upper() + "! y"), (1, " ".join(q[:12])), (2, "a short, item; here b"), (3, "short item hereafter"), *ODD, (5, ("z " * 200) + "short item here"), (6, "null id")]
    got = {r.doc_id: r for r in scan(frame(spark, rows), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert (got[0].n_words, got[0].n_hit, got[0].n_items, got[0].contaminated) == (16, 14, 1, True)
    assert got[1].n_hit == 0 and got[3].n_hit == 0 and got[900].n_words == 0 and not got[900].contaminated
    assert (got[2].n_hit, got[2].items, got[2].items_sha256) == (3, ["2", "4"], sha("2,4"))
    a, b = got[2].spans[0]
    assert rows[2][1][a:b] == "short, item; here"
    assert got[5].n_hit == 3 and not got[5].contaminated
    bench = spark.createDataFrame(items, "item_id long, text string")
    none = spark.createDataFrame([], "item_id long, text string")
    assert scan(frame(spark, rows), none).where("n_hit > 0").count() == 0 and scan(frame(spark, rows).limit(0), bench).count() == 0
    assert got[6].n_hit == 2 and got[6].n_items == 0 and got[6].contaminated


@pytest.mark.parametrize("ways", [{}, {"block_words": 20, "max_blocks": 100}, {"block_words": 20, "max_blocks": 0}])
def test_contamination_against_brute_force(spark, ways):
    """As one block, block by block, and by a join; with repeated rows, rows of one id, and items without an id."""
    rng = random.Random(8)
    words = ["aa", "Bb", "c", "dé", "e1"]
    text = lambda n: "".join(rng.choice(words) + rng.choice([" ", ", ", "-", "\n"]) for _ in range(n))
    items = [(i, text(rng.choice([0, 1, 3, 6, 9, 30]) if i else 2)) for i in range(12)] + [(None, text(7)), (3, text(8)), (4, None)]
    items = [(i, t) for i, t in items if t is None or len(t.split()) != 1]
    rows = [(i, text(rng.randint(0, 60))) for i in range(40)] + [(i, "xx " + " yy ".join(t for _, t in rng.sample(items, 2) if t)) for i in range(40, 60)] + ODD
    rows += [(5, rows[5][1]), (5, text(20)), (None, items[-2][1]), (None, None)]
    fold = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(fold))
    windows = defaultdict(set)
    for i, t in items:
        w = split(t)
        size = min(5, len(w))
        for k in range(len(w) - size + 1 if w else 0):
            windows[tuple(w[k : k + size])].add(i)
    want = []
    for d, t in rows:
        w = split(t)
        hit, who = [False] * len(w), set()
        for a in range(len(w)):
            for n in range(1, 6):
                if a + n <= len(w) and tuple(w[a : a + n]) in windows:
                    hit[a : a + n] = [True] * n
                    who |= windows[tuple(w[a : a + n])]
        names = sorted(str(x) for x in who if x is not None)
        want.append((d or -1, len(w), sum(hit), len(names), sha(",".join(names)), sum(hit) > 0 and 20 * sum(hit) >= len(w)))
    out = scan(frame(spark, rows), spark.createDataFrame(items, "item_id long, text string"), width=5, keep=["source", "text"], **ways).collect()
    assert sorted((r.doc_id or -1, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in out) == sorted(want)
    for r in out:
        assert sum(len(split(r.text[a:b])) for a, b in r.spans) == r.n_hit and (r.text is None) == (r.n_words == 0 and r.text is None)


def test_components(spark):
    rng = random.Random(4)
    edges = [(rng.randint(0, 200), rng.randint(0, 200)) for _ in range(120)] + [(i, i + 1) for i in range(1000, 1040)] + [(2000, 2000 + i) for i in range(1, 30)] + [(None, 1), (5, 5)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    real = [(a, b) for a, b in edges if a is not None and a != b]
    for a, b in real:
        a, b = find(a), find(b)
        if a != b:
            parent[max(a, b)] = min(a, b)
    d = spark.createDataFrame(edges, "a long, b long")
    assert {r.node: r.root for r in connected_components(d, Store(spark, "t")).collect()} == {x: find(x) for e in real for x in e}
    assert connected_components(d.limit(0), Store(spark, "t")).count() == 0


def test_similar_groups(spark):
    rng = random.Random(5)
    base = [f"w{rng.randint(0, 300)}" for _ in range(120)]
    rows = [(i, " ".join(f"w{rng.randint(0, 3000)}" for _ in range(rng.randint(0, 60)))) for i in range(60)]
    for k in range(80):
        w = list(base)
        for _ in range(rng.randint(0, 5)):
            w[rng.randrange(len(w))] = f"x{rng.randint(0, 9)}"
        rows.append((500 + k, " ".join(w)))
    rows += [(700, rows[3][1]), (701, rows[3][1]), *ODD, (906, "a")]
    # rows without an id: copies of one that has one, and two that have none
    more = [(None, rows[4][1]), (None, "nobody else holds these seven words"), (None, "nobody else holds these seven words"), (None, None)]
    sets = {}
    for d, t in rows:
        w = WORDS.findall(t or "")
        sets[d] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    links, root = dict.fromkeys(sets, 0), {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(sorted(sets), 2):
        both = len(sets[a] & sets[b])
        if both and 10 * both >= 8 * (len(sets[a]) + len(sets[b]) - both):
            links[a] += 1
            links[b] += 1
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    every = similar_groups(frame(spark, rows + more), Join(bucket=16, block=32), keep=["text", "size"]).collect()
    null = sorted((r for r in every if r.doc_id is None), key=lambda r: (r.text or "", r.class_id))
    assert len(every) == len(rows) + 4 and null[0].n_tokens == 0 and null[0].n_links == 0
    assert null[1].class_id == null[2].class_id >= 1 << 62 and null[1].n_links == 1
    assert null[3].class_id == find(4) and null[3].n_links == links[4] + 1 and null[3].size == "x"
    got = similar_groups(frame(spark, rows), Join(bucket=16, block=32)).collect()
    assert sorted((r.doc_id, r.class_id, r.n_links) for r in got) == sorted((d, find(d), links[d]) for d in sets)
    # the way without a list of ids
    got = similar_groups(frame(spark, rows), Join(bucket=16, block=32, max_listed=0)).collect()
    assert sorted((r.doc_id, r.class_id, r.n_links) for r in got) == sorted((d, find(d), links[d]) for d in sets)
    assert similar_groups(frame(spark, rows).limit(0)).count() == 0
    # one id for two texts of the family, a copy of another document and a text of its own
    odd = [(2, rows[60][1]), (2, rows[61][1]), (2, rows[3][1]), (2, "these seven words stand here only once")]
    for listed in (1_000_000, 0):
        got = similar_groups(frame(spark, rows + odd), Join(bucket=16, block=32, max_listed=listed), keep=["text"]).collect()
        of = lambda d, t: next(r for r in got if (r.doc_id, r.text) == (d, t))  # noqa: E731,B023
        assert len(got) == len(rows) + 4 and of(*odd[0]).class_id == of(500, odd[0][1]).class_id == of(501, odd[1][1]).class_id
        assert of(500, odd[0][1]).n_links == links[500] + 1 + (20 * len(sets[500] & sets[501]) >= 16 * len(sets[500] | sets[501]))
        assert of(*odd[2]).class_id == of(3, odd[2][1]).class_id == of(700, odd[2][1]).class_id and of(3, odd[2][1]).n_links == links[3] + 1
        own = of(*odd[3])
        assert own.n_links == 0 and sum(r.class_id == own.class_id for r in got) == 1
        assert len({of(*o).class_id for o in [*odd[1:], rows[2]]}) == 4
    assert runs_needed(0.8, 4.0, 0.99999) == 4


def test_mix_of_rows_without_ids(spark):
    """Rows of one id or none are documents of their own: each gets its own share, and its own text."""
    rows = [(None, f"n{i} " * (20 + i)) for i in range(30)] + [(7, f"s{i} " * 33) for i in range(9)] + [(8, "same words here " * 30)] * 40 + [(None, None), (None, "")]
    m = Mixture(frame(spark, rows), Mix(block=16, shards=4))
    out = m.taken().collect()
    assert len(out) == len(rows) and all(r.taken <= 2 * r.size for r in out)
    for s in {r.source for r in out}:
        mine = [r for r in out if r.source == s]
        assert abs(sum(r.taken for r in mine) - mine[0].target) <= 1
    again = Mixture(frame(spark, rows).repartition(7), Mix(block=16, shards=4))
    key = lambda r: (r.doc_id or -1, r.size, r.taken)
    assert sorted(map(key, again.taken().collect())) == sorted(map(key, out))
    got = Counter()
    for r in m.blocks(frame(spark, rows)).collect():
        assert len(r.text.split()) == r.words and len({*r.text.split()}) in (1, 3)
        got[r.doc_id, r.text.split()[0] if r.doc_id != 8 else ""] += r.words
    assert sum(got.values()) == sum(r.taken for r in out)
    assert all(got[None, f"n{i}"] <= 2 * (20 + i) for i in range(30)) and all(got[7, f"s{i}"] <= 66 for i in range(9))


def test_written_mix(spark, tmp_path):
    rows = [(i, f"a{i} b{i} c{i} " * 10) for i in range(20)] + [(None, "x y z")]
    m = Mixture(frame(spark, rows), Mix(block=8, shards=3))
    m.write(frame(spark, rows), str(tmp_path / "mix"))
    got = spark.read.parquet(str(tmp_path / "mix")).collect()
    assert sum(len(r.text.split()) for r in got) == sum(r.taken for r in m.taken().collect())
    assert {r.shard for r in got} == {0, 1, 2}


def test_draws_from_very_large_populations():
    """The exact draw beyond numpy's own: moments of the distribution, its bounds, and the same numbers again."""
    rng = np.random.default_rng(3)
    n, others, draw = 3 * 10**9, 9 * 10**9, 4 * 10**9
    x = np.array([_drawn_of(rng, n, others, draw) for _ in range(300)], float)
    sd = (draw * 0.25 * 0.75 * (8 / 12)) ** 0.5
    assert abs(x.mean() - draw / 4) < 4 * sd / 300**0.5 and 0.85 < x.std() / sd < 1.15
    assert _drawn_of(rng, 5, 10**12, 10**12 + 5) == 5 and _drawn_of(rng, 10**12, 5, 10**12) >= 10**12 - 5 and _drawn_of(rng, 0, 10**10, 7) == 0
    small = np.array([_drawn_of(rng, 2, 2 * 10**9, 10**9) for _ in range(400)])
    assert set(small.tolist()) == {0, 1, 2} and abs(small.mean() - 1) < 0.2
    t = split_tree([7 * 10**9, 10**10, 3, 0], 5, 1)
    assert t.sum(axis=0).tolist() == [7 * 10**9, 10**10, 3, 0] and (t == split_tree([7 * 10**9, 10**10, 3, 0], 5, 1)).all()


def test_targets_and_tree():
    assert targets([100, 100, 100], Mix()) == [200.0, pytest.approx(166.67, abs=0.01), pytest.approx(83.33, abs=0.01)]
    assert targets([], Mix()) == [] and targets([0, 10], Mix()) == [0.0, 15.0]
    assert targets([1000], Mix()) == [1500.0]
    t = split_tree([1000, 10, 0, 333], 7, 1)
    assert t.sum(axis=0).tolist() == [1000, 10, 0, 333] and t.min() >= 0 and t.sum(axis=1).max() - t.sum(axis=1).min() <= 3
    assert (t == split_tree([1000, 10, 0, 333], 7, 1)).all() and (t != split_tree([1000, 10, 0, 333], 7, 2)).any()


def test_mixture(spark):
    rng = random.Random(6)
    rows = [(i, " ".join("w" for _ in range(rng.randint(0, 50)))) for i in range(150)] + ODD + [(903, "a"), (2000, "w " * 5000)]
    m = Mixture(frame(spark, rows), Mix(block=16, shards=8))
    out = m.taken().collect()
    by = defaultdict(list)
    for r in out:
        assert r.taken <= 2 * r.size
        by[r.source].append(r)
    assert len(out) == len(rows) and None in by
    for rs in by.values():
        assert sum(r.size for r in rs) == rs[0].source_size and abs(sum(r.taken for r in rs) - rs[0].target) <= 1
    d = m.draws.collect()
    # planned in Spark, and with the tree over groups of sources
    for other in (Mix(block=16, shards=8, listed=0), Mix(block=16, shards=8, cells=8)):
        far = Mixture(frame(spark, rows), other)
        assert sorted((r.doc_id, r.size, r.source or "", r.taken) for r in far.taken().collect()) == sorted((r.doc_id, r.size, r.source or "", r.taken) for r in out)
        assert far.draws.groupBy("shard").count().count() == 8
    text = {r.doc_id: r.text for r in frame(spark, rows).collect()}
    mixed = m.blocks(frame(spark, rows)).collect()
    assert sorted((r.shard, r.place, r.doc_id, r.first, r.words) for r in mixed) == sorted((r.shard, r.place, r.doc_id, r.first, r.words) for r in d)
    assert all(r.text.split() == WORDS.findall(text[r.doc_id])[r.first : r.first + r.words] for r in mixed)
    assert len({(r.row, r.first, r.pass_) for r in d}) == len(d)
    assert Counter(r.shard for r in d) == Counter({i: int(n) for i, n in enumerate(m.shares.sum(axis=1)) if n})
    again = Mixture(frame(spark, rows).repartition(5), Mix(block=16, shards=8)).taken().collect()
    assert sorted((r.doc_id, r.taken) for r in again) == sorted((r.doc_id, r.taken) for r in out)
    assert Mixture(frame(spark, rows).limit(0)).taken().count() == 0


def test_url_rules(spark):
    urls = ["http://a.net/x", "https://A.Example.NET/en/1", "http://example.com/de/1?q#f", "http://badexample.com/de/1", "x.org/fr/", "http://x.org/fr/", None, "", "http://c.com/p", "https://c.com:443/p/?utm_source=z#top", "http://d.com/", "http://net/"]
    rows = [(i, u, None) for i, u in enumerate(urls)] + [(20, "http://e.com/old", '<LINK rel="canonical" href="http://f.net/new">'), (21, "http://g.com/", "<meta http-equiv='refresh' content='0; url=http://example.net/en/z'>"), (22, "http://h.com/", '<link href="http://k.net/" rel=canonical>'), (23, "http://k.net/", None)]
    d = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({"a": F.lit(1), "host": F.lit("x"), "n": F.lit(1)})
    got = {r.page_id: r for r in judge_urls(d).collect()}
    v = {i: (r.host, r.path, r.rule, r.verdict) for i, r in got.items()}
    assert v[0] == ("a.net", "/x", "net/", "block") and v[1] == ("a.example.net", "/en/1", "example.net/en/", "allow")
    assert v[2] == ("example.com", "/de/1", "example.com/de/", "block") and v[3][2:] == (None, "allow")
    assert v[4] == ("", "", None, "allow") and v[5][2:] == ("org/fr/", "allow") and v[6] == v[7] == ("", "", None, "allow")
    assert v[11][2:] == ("net/", "block")
    assert v[20][2:] == (None, "block") and got[20].inherited
    assert v[21][2:] == (None, "allow") and v[22][2:] == (None, "block") and got[8].class_url == got[9].class_url
    more = spark.createDataFrame([("http://d.com/", "http://mid.com/"), ("http://mid.com/", "http://z.net/")], "a string, b string")
    assert {r.page_id: r.verdict for r in judge_urls(d, redirects=more).collect()}[10] == "block"
    allowed = spark.createDataFrame([("http://d.com/", "http://z.net/"), ("http://d.com/", "http://y.org/fr/")], "a string, b string")
    assert {r.page_id: r.verdict for r in judge_urls(d, redirects=allowed).collect()}[10] == "allow"
    assert judge_urls(d.limit(0)).count() == 0
    with pytest.raises(ValueError):
        Rule.parse("forbid x/")


def test_base_personal_data():
    email = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
    ip, card, phone = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), re.compile(r"[0-9]([\x20-]?[0-9])+"), re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

    def brute(t):
        digits = lambda s: re.sub("[^0-9]", "", s)
        out = [("email", *m.span()) for m in email.finditer(t)] + [("ip", *m.span()) for m in ip.finditer(t) if all(int(x) <= 255 for x in m[0].split("."))]
        out += [("card", *m.span()) for m in card.finditer(t) if 12 <= len(digits(m[0])) <= 19 and disclosure.luhn(digits(m[0]))]
        out += [("phone", *m.span()) for m in phone.finditer(t) if 9 <= len(digits(m[0])) <= 15]
        return sorted(out, key=lambda s: (s[1], disclosure.KINDS.index(s[0])))

    rng = random.Random(7)
    for _ in range(4000):
        t = "".join(rng.choice("a.@-+1 23é(4)5@.%\n") for _ in range(rng.randint(0, 40)))
        assert disclosure.base_spans(t) == brute(t)
    for _ in range(4000):
        t = "".join(rng.choice("0123456789012345.- +") for _ in range(rng.randint(10, 60)))
        assert disclosure.base_spans(t) == brute(t)


def test_disclosing_terms(spark):
    rows = [(i, f"hello filler{i} word Secretname, bob@x.org other{i} thing") for i in range(6)] + [(10 + i, f"plain text thing word {i}") for i in range(60)] + [(102, "secretname again"), *ODD]
    got = {r.doc_id: r for r in disclosure.find(frame(spark, rows)).collect()}
    assert got[0].spans == "term:0:5,hint:19:30,email:31:40" and got[0].base_sha256 == sha("email:31:40") and got[0].n_email == 1
    assert got[102].spans == got[900].spans == "" and got[900].base_sha256 == sha("")
    # the way for more terms than may be sent out
    other = {r.doc_id: r.spans for r in disclosure.find(frame(spark, rows), disclosure.Disclosure(max_terms=0)).collect()}
    assert other == {d: r.spans for d, r in got.items()}
    assert disclosure.sanitise(rows[0][1], [(s.kind, s.a, s.b) for s in got[0].all_spans]) == " filler0 word [NAME] [EMAIL] other0 thing"
    assert [disclosure.general(w) for w in ("blue", "(Ann", "A12", "1,234")] == ["[WORD]", "[NAME]", "[CODE]", "[NUMBER OF 4 DIGITS]"]
    assert disclosure.find(frame(spark, rows).limit(0)).count() == 0


def test_terms_of_rare_entities(spark):
    """Entities of one and of two documents are protected, by counts over all documents."""
    rows = [(0, "plain text Marlowe ann@y.org thing"), (1, "plain Quist bo@y.org text"), (2, "thing Quist bo@y.org plain"), (3, "word Ebbers cy@y.org thing"), (4, "plain Ebbers thing"), (5, "word Dunn dee@y.org"), (6, "Dunn plain"), (7, "Dunn thing")]
    rows += [(10 + i, f"plain text thing word {i}") for i in range(60)]
    for d in (disclosure.Disclosure(), disclosure.Disclosure(max_terms=0)):
        got = {r.doc_id: r.spans for r in disclosure.find(frame(spark, rows), d).collect()}
        assert got[0] == "term:11:18,email:19:28"
        assert got[1] == "term:6:11,email:12:20" and got[2] == "term:6:11,email:12:20"
        # in half of its documents the word stands by the entity, in a third it is left alone
        assert got[3] == "hint:5:11,email:12:20" and got[5] == "email:10:19"
        assert got[4] == got[6] == got[10] == ""


def test_relative_targets(spark):
    """Targets of all tags count, seen from the page or its base."""
    refresh, canonical = '<meta http-equiv="refresh" content="0; url={}">', '<link rel="nofollow Canonical" href="{}">'
    cases = [
        ("http://example.com/old", refresh.format("/de/new"), ["http://example.com/de/new"]),
        ("http://e.com/a", '<link rel="canonical" href="//a.net/x">', ["http://a.net/x"]),
        ("http://e.com/b", '<link rel=canonical href="http://e.com/b">' + canonical.format("http://f.net/") + refresh.format("c") + refresh.format("http://g.com/"), ["http://e.com/b", "http://f.net/", "http://e.com/c", "http://g.com/"]),
        ("http://e.com/x/y/z?q=1#f", canonical.format("../w/./v/..") + canonical.format("?p=2") + canonical.format("../../../../u"), ["http://e.com/x/w/", "http://e.com/x/y/z?p=2", "http://e.com/u"]),
        ("http://e.com", canonical.format("n") + canonical.format("/go?to=http://a.net/"), ["http://e.com/n", "http://e.com/go?to=http://a.net/"]),
        ("http://e.com/d", '<base href="/de/">' + canonical.format("m") + canonical.format("mailto:x@y.z"), ["http://e.com/de/m"]),
        ("http://e.com/c", "<!-- " + canonical.format("http://a.net/") + " -->" + canonical.format("/q?a=1&amp;b=2") + "<!-- " + refresh.format("/z"), ["http://e.com/q?a=1&b=2"]),
        ("x.org/fr/", canonical.format("/a"), []),
        ("http://e.com/n", None, None),
    ]
    d = spark.createDataFrame([(i, u, h) for i, (u, h, _) in enumerate(cases)], "page_id long, url string, html string")
    got = {r.page_id: r.t for r in d.select("page_id", declared_targets(F.col("html"), F.col("url")).alias("t")).collect()}
    assert got == {i: want for i, (_, _, want) in enumerate(cases)}
    verdicts = {r.page_id: r.verdict for r in judge_urls(d).collect()}
    assert [verdicts[i] for i in range(3)] == ["block"] * 3 and verdicts[7] == verdicts[8] == "allow"


def test_secrets(spark):
    key = "9f86d081884c7d659a2feaa0c55ad015a3bf4f1b"
    rows = [(0, f'plain token = "{key}" text'), (1, "a" * 40 + "1234 and 12345678901234567890123 and averyveryverylongwordindeed"), (2, f"mail {key}@x.org"), (3, None)]
    got = {r.doc_id: r for r in disclosure.find(frame(spark, rows)).collect()}
    assert got[0].n_secret == 1 and "secret:15:55" in got[0].spans.split(",") and got[0].base_sha256 == sha("")
    assert got[1].n_secret == got[2].n_secret == got[3].n_secret == 0 and got[2].n_email == 1
    assert disclosure.sanitise(rows[0][1], [("secret", 15, 55)]) == 'plain token = "[SECRET]" text'


def test_similar_groups_on_a_table(spark):
    """All links of a whole table, found by comparing every pair that shares a token: recall over links, and each document's count."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    sets = {}
    for r in docs.collect():
        w = WORDS.findall(r.text or "")
        sets[r.doc_id] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    at = defaultdict(list)
    for d, s in sets.items():
        for t in s:
            at[t].append(d)
    shared = Counter(p for ids in at.values() for p in itertools.combinations(sorted(ids), 2))
    links = Counter()
    for (a, b), n in shared.items():
        if 5 * n >= 4 * (len(sets[a]) + len(sets[b]) - n):
            links[a] += 1
            links[b] += 1
    got = {r.doc_id: r.n_links for r in similar_groups(docs).collect()}
    assert sum(links.values()) > 150
    assert sum(min(got[d], n) for d, n in links.items()) >= 0.9 * sum(links.values())
    assert got == {d: links[d] for d in sets}


def test_repeated_rows_and_long_texts(spark):
    """Every operator gives a row for each row, alike for equal ones, with repeated ids, and with a text of several megabytes."""
    from sparkbrief.llm import quality, toxicity

    long = " ".join(f"word{i % 977}" for i in range(400_000))
    rows = [(1, "one two three"), (1, "one two three"), (1, "another text under this id"), (None, "no id"), (None, "no id"), (2, long), (3, None), (3, ""), (4, "x" * 300_000)]
    d = frame(spark, rows)
    bench = spark.createDataFrame([(1, "one two three"), (1, "one two three")], "item_id long, text string")
    labels = spark.createDataFrame([(1, 1, 0), (1, 0, 0), (2, 1, 1), (None, 1, 1), (9, 0, 1)], "doc_id long, quality int, toxic int")
    results = [
        Mixture(d).taken(), host_rules.judge(d), remove_repeats(d), dedup_lines(d), scan(d, bench), similar_groups(d), disclosure.find(d),
        toxicity.score(d, toxicity.fit(d, labels, "toxic")), quality.score(d, quality.fit(d, labels, "quality")),
        judge_urls(d.select(F.col("doc_id").alias("page_id"), F.lit("http://a.net/x").alias("url"), F.col("text").alias("html"))).withColumnRenamed("page_id", "doc_id"),
    ]
    for df in results:
        out = df.collect()
        assert Counter(r.doc_id for r in out) == Counter(i for i, _ in rows)
