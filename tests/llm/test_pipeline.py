"""The corpus pipeline, stage by stage and end to end, against brute-force statements of its stages."""

from __future__ import annotations

import re
from collections import Counter, defaultdict

import duckdb
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as c
from sparkbrief.llm import toxicity
from sparkbrief.llm.mixing import Mix, targets
from sparkbrief.llm.queries import remainder, table

SF = "/root/testdata/sf0.001"
WORDS = re.compile(r"[^\x20\x09-\x0D]+")
FOLD = str.maketrans({chr(x): chr(x + 32) for x in range(65, 91)})


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """sf0.001 with near copies, repeated rows, rows of one id, rows without an id, toxic and contaminated ones, an odd label."""
    to = str(tmp_path_factory.mktemp("sf"))
    docs, labels, bench = (table(spark, SF, t) for t in ("documents", "labels", "benchmark"))
    item, toxic = bench.orderBy("item_id").first().text, docs.join(labels.where("toxic = 1"), "doc_id").orderBy("doc_id").first()
    long = " ".join(f"w{i}" for i in range(60))
    lines = "\n".join(f"this line is common enough {i}" for i in range(3))
    extra = [
        (10_000, f"{long} a", "en", "s", 1), (10_001, f"{long} b", "en", "s", 1), (10_001, f"{long} b", "de", "s", 1), (10_002, f"x {item} y", "en", "s", 1), (10_003, None, None, None, None),
        (10_004, toxic.text, "en", None, 5), (None, f"{long} c", "en", "s", 1), (None, None, "en", "s", 0), (None, " ", "en", "s", 1), (10_005, lines + "\nfirst", "en", "s", 1), (10_006, lines + "\nsecond one", "en", "t", 1),
        (10_007, lines, "en", "t", 1), (10_000, "another text under the same id, of a few words", "en", "t", 1), (None, "a text of its own without an id", "en", "t", 1), (None, "a text of its own without an id", "en", "t", 1),
    ]
    docs.unionByName(spark.createDataFrame(extra, docs.schema)).withColumn("row", F.lit("clash")).repartition(4).write.parquet(f"{to}/documents.parquet")
    labels.unionByName(spark.createDataFrame([(None, 1, 1), (10_000, None, None)], labels.schema)).write.parquet(f"{to}/labels.parquet")
    bench.write.parquet(f"{to}/benchmark.parquet")
    return to


def rows_of(df):
    return [tuple(r) for r in df.select(*c.COLUMNS).collect()]


def toxic(spark, rows, folder):
    docs, labels = table(spark, folder, "documents"), table(spark, folder, "labels")
    model = toxicity.fit(docs, labels.where(remainder(F.col("doc_id"), 3) != 1), "toxic")
    return [r for r, s in zip(rows, model.score(pa.array([r[1] for r in rows], pa.string())), strict=True) if s < 0.7]


def stripped(rows):
    key = lambda line: line.strip(" \t\n\v\f\r").translate(FOLD)
    holders = defaultdict(set)
    for r in rows:
        for line in (r[1] or "").split("\n") if r[0] is not None else ():
            holders[key(line)].add(r[0])
    out = []
    for r in rows:
        lines = (r[1] or "").split("\n")
        stay = [x for x in lines if r[0] is None or len(key(x)) < 20 or len(holders[key(x)]) < 3 or max(holders[key(x)]) == r[0]]
        text = None if r[1] is None else "\n".join(stay)
        out.append((r[0], text, *r[2:4], len(text) if len(stay) < len(lines) else r[4]))
    return out


def near(rows):
    sets = []
    for r in rows:
        w = WORDS.findall(r[1] or "")
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set()))
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    at = defaultdict(list)
    for i, s in enumerate(sets):
        for t in s:
            at[t].append(i)
    shared = Counter((a, b) for ids in at.values() for k, a in enumerate(ids) for b in ids[k + 1 :])
    for (a, b), n in shared.items():
        if 5 * n >= 4 * (len(sets[a]) + len(sets[b]) - n):
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    groups = defaultdict(list)
    for i in range(len(rows)):
        groups[find(i)].append(i)
    return sets, groups


def contaminated(rows, folder):
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(FOLD))
    windows = set()
    for (t,) in duckdb.sql(f"SELECT text FROM '{folder}/benchmark.parquet/*.parquet'").fetchall():
        w = split(t)
        size = min(13, len(w))
        windows |= {tuple(w[i : i + size]) for i in range(len(w) - size + 1) if w}
    sizes = {len(w) for w in windows}
    out = []
    for r in rows:
        w = split(r[1])
        hit = set()
        for n in sizes:
            for i in range(len(w) - n + 1):
                if tuple(w[i : i + n]) in windows:
                    hit |= {*range(i, i + n)}
        if not hit or 20 * len(hit) < len(w):
            out.append(r)
    return out


def key(r):
    return (r[0] is None, r[0] or 0, r[1] or "", str(r[2:]))


def test_stages_and_run_against_brute_force(spark, folder):
    assert [n for n, _ in c.STAGES] == ["toxicity", "line dedup", "n-gram Jaccard join", "benchmark decontamination", "mixing sources to target weights"]
    stages = [f for _, f in c.STAGES]
    docs = table(spark, folder, "documents")
    rows = [tuple(r) for r in docs.select(*c.COLUMNS).collect()]

    def written(rows):
        return spark.createDataFrame(rows, docs.select(*c.COLUMNS).schema).repartition(3).checkpoint()

    spark.sparkContext.setCheckpointDir(spark.conf.get("spark.checkpoint.dir"))
    want = toxic(spark, rows, folder)
    assert sorted(rows_of(stages[0](spark, docs, folder)), key=key) == sorted(want, key=key) and 0 < len(rows) - len(want)

    rows, want = want, stripped(want)
    assert sorted(rows_of(stages[1](spark, written(rows), folder)), key=key) == sorted(want, key=key)
    assert {r[0]: r[1] for r in want}[10_006] == "second one" and sum(a != b for a, b in zip(rows, want, strict=True)) > 3

    rows = want
    got = rows_of(stages[2](spark, written(rows), folder))
    sets, groups = near(rows)
    have, left = Counter((r[0], r[1]) for r in got), 0
    for members in groups.values():
        mine = [rows[i] for i in members]
        if not sets[members[0]]:
            assert have[mine[0][:2]] == sum(r[:2] == mine[0][:2] for r in rows)
            left += len(mine)
            continue
        texts = {r[:2] for r in mine}
        least = min((r[0] for r in mine if r[0] is not None), default=None)
        assert [k for k in texts if have[k]] == [k for k in texts if k[0] == least][:1] and sum(have[k] for k in texts) == 1
        left += 1
    assert len(got) == left < len(rows)
    assert have[10_000, "another text under the same id, of a few words"] == have[None, "a text of its own without an id"] == 1 and have[None, None] == have[None, " "] == 1

    rows, want = got, contaminated(got, folder)
    assert sorted(rows_of(stages[3](spark, written(rows), folder)), key=key) == sorted(want, key=key)
    assert 10_002 in {r[0] for r in rows} and 10_002 not in {r[0] for r in want}

    def mixed(out, rows):
        words = {(r[0], r[1]): WORDS.findall(r[1] or "") for r in rows}
        by = defaultdict(list)
        for r in rows:
            by[r[3]].append(len(words[r[:2]]))
        names = sorted(by, key=lambda s: (s is None, s or ""))
        goal = dict(zip(names, targets([sum(by[s]) for s in names], Mix()), strict=True))
        took, each, seen = Counter(), Counter(), set()
        texts = defaultdict(list)
        for (d, _), w in words.items():
            texts[d].append(w)
        for r in out:
            assert any(r.text.split() == w[r.first : r.first + r.words] for w in texts[r.doc_id]) and r.words > 0
            took[r.source] += r.words
            each[r.doc_id] += r.words
            assert (r.shard, r.place) not in seen
            seen.add((r.shard, r.place))
        assert all(abs(took[s] - goal[s]) <= 1 for s in names)
        assert all(n <= 2 * sum(len(w) for w in texts[d]) for d, n in each.items())

    mixed(stages[4](spark, written(want), folder).collect(), want)
    # all of it, each stage on what its predecessor kept; which of equal rows stays is fixed, so the kept documents are the same
    mixed(c.run(spark, folder).collect(), want)
    again = [c.run(spark, folder).select("shard", "place", "doc_id", "first", "words").collect() for _ in range(2)]
    assert sorted(again[0]) == sorted(again[1])


def test_pipeline_on_empty_tables(spark, folder, tmp_path):
    for name in ("documents", "labels", "benchmark"):
        table(spark, folder, name).limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert c.run(spark, str(tmp_path)).count() == 0
