"""Cuts, sections, briefs, trees and readers on literal logs."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from sparkbrief.operators import brief, cut, frames, recall, sections, tree
from sparkbrief.plans import compact
from sparkbrief.schema import BLOCKS, Compact, Recall
from sparkbrief.sources import chat, logs


def row(seq, role="user", text=None, kind="message", type_="text", entry=None, parent=None, call=None, tool=None, args=None, error=False, kept=None, summary=None, session="s"):
    return (session, seq, 0, entry or f"e{seq}", parent, kind, role, seq, type_ if kind == "message" else None, text, call, tool, args, error, kept, summary)


def log(spark, *rows):
    return spark.createDataFrame(list(rows), BLOCKS)


def items(df, section):
    return [r.item for r in df.where(F.col("section") == section).orderBy("ord").collect()]


@pytest.fixture(scope="module")
def sample(spark):
    """A session about a ledger: a request with a standing wish, a written file, a failing check, a commit, a result without its call."""
    return log(
        spark,
        row(1, text="Sum the ledger by month\nPrefer whole cents everywhere"),
        row(2, "assistant", type_="toolCall", call="w7", tool="write", args=json.dumps({"path": "/home/q/dev/ledger/sum.py"})),
        row(3, "toolResult", "checking sum.py\nfatal: code=LEDGER_41 unbalanced month\nbye", type_="toolResult", call="w7", tool="write", error=True),
        row(4, "assistant", type_="toolCall", call="b8", tool="bash", args=json.dumps({"command": "git commit -q -m 'balance the ledger'"})),
        row(5, "toolResult", "", type_="toolResult", call="b8", tool="bash"),
        row(6, "toolResult", "stray output", type_="toolResult", call="nobody"),
        row(7, text="Scratch that, group by quarter"),
        row(8, "assistant", "Grouped by quarter now"),
        row(9, text="thanks, carry on"),
    )


FACT = "fatal: code=LEDGER_41 unbalanced month"


def test_sections(spark, sample):
    s = sections.extract(sample)
    assert items(s, "goal") == ["Sum the ledger by month\nPrefer whole cents everywhere", "[Scope change] Scratch that, group by quarter"]
    assert items(s, "preferences") == ["Prefer whole cents everywhere"]
    assert items(s, "files_created") == ["ledger/sum.py"] and items(s, "files_modified") == []
    assert items(s, "commits") == ["commit: balance the ledger"]
    assert items(s, "key_facts") == [FACT]


def results(spark, texts, tool):
    d = log(spark, *(row(i, "toolResult", t, type_="toolResult", tool=tool) for i, t in enumerate(texts)))
    return sorted(r.seq for r in sections.diagnostic_lines(d).collect())


def test_diagnostics(spark):
    """A line tells something if it has a severity as a word of its own and a code."""
    good = ["Error E4410 while loading rates", "warn: code=rate-limit reached", "the check failed with ERR907 at noon", "PANIC code: 12 in the pump", "fatal X-77-PUMP gave up", "npm err! code EPUMP"]
    bad = ["all 12 checks passed today", "pump.error.ts code=3 loaded", "error without any number", "err E1", "interrorem E4410 rates", "warnings are code words"]
    assert results(spark, good + bad, "bash") == [*range(len(good))]
    # of a file that was read, only lines that look like output count: no comments, quotes, or lines led by a time
    read = ["// Error E4410 in a comment", "let text = 'Error E4410 rates';", "error: E4410 while loading rates", "12:30:01 error code=12 in the pump", "* fatal code=9 in a list"]
    assert results(spark, read, "read") == [2]


def test_long_results_are_scanned_from_the_end(spark):
    body = "Error E1111 at the head\n" + "nothing to see on this line\n" * 4000 + "Error E2222 at the foot\n"
    d = log(spark, row(1, "toolResult", body, type_="toolResult", tool="bash"), row(2, "toolResult", "y" * 1_300_000, type_="toolResult", tool="bash"))
    assert [r.item for r in sections.facts_by_result(d).orderBy("nth").collect()] == ["Error E2222 at the foot", "Error E1111 at the head"]


def test_transcript_and_brief(spark, sample):
    lines = [r.line for r in brief.transcript_lines(sample).orderBy("seq").collect()]
    assert lines[:2] == ["[user] Sum the ledger by month\nPrefer whole cents everywhere", '* write "/home/q/dev/ledger/sum.py" (#1)']
    assert lines[2:] == ["→ ERROR checking sum.py", "* bash \"git commit -q -m 'balance the ledger'\" (#2)", "(empty result)", "* tool result (#3) → stray output", "[user] Scratch that, group by quarter", "[assistant] Grouped by quarter now", "[user] thanks, carry on"]
    out = compact.compact(sample, Compact(keep=1)).first()
    assert out.cut == 8 and out.summary.startswith("[Session Goal]\n- Sum the ledger") and "[Transcript]" in out.summary
    parsed = brief.parse_items(spark.createDataFrame([("s", out.summary)], "session_id string, summary string"))
    assert items(parsed, "files_created") == ["ledger/sum.py"] and items(parsed, "commits") == ["commit: balance the ledger"] and items(parsed, "key_facts") == [FACT]


def test_merge_keeps_what_was_earned(spark):
    old = spark.createDataFrame([("s", "key_facts", 1, "Error A"), ("s", "outstanding", 1, "old"), ("s", "commits", 1, "x")], "session_id string, section string, ord int, item string")
    new = spark.createDataFrame([("s", "key_facts", 1, "error a"), ("s", "key_facts", 2, "B"), ("s", "outstanding", 1, "new"), ("s", "commits", 1, "X")], "session_id string, section string, ord int, item string")
    m = brief.merge(old, new)
    assert items(m, "key_facts") == ["Error A", "B"] and items(m, "outstanding") == ["new"] and items(m, "commits") == ["x", "X"]


def test_cuts(spark):
    six = log(spark, *(row(i, text="t") for i in range(6)))
    got = cut.cuts(six, Compact()).first()
    assert (got.keep, got.grown, got.cut) == (5, True, 1)
    assert cut.cuts(six, Compact(keep=0)).first().compact_all and cut.cuts(six, Compact(keep=6)).first().compact_all
    assert not cut.cuts(six, Compact(keep=7)).first().possible
    split = log(spark, row(0, text="go"), *(row(i, "assistant" if i % 2 else "toolResult", "x" * 40, type_="text" if i % 2 else "toolResult") for i in range(1, 41)))
    got = cut.cuts(split, Compact(max_tail=50)).first()
    assert 0 < got.cut < 41 and got.cut % 2 == 1
    assert not cut.cuts(log(spark, row(0), row(1, "assistant", "x")), Compact()).first().possible


def test_live_span(spark):
    rows = [row(i, text=str(i)) for i in range(4)]
    kept = log(spark, *rows, row(4, None, kind="compaction", kept="e2"), row(5, text="5"))
    assert [r.seq for r in cut.live_blocks(kept).orderBy("seq").collect()] == [2, 3, 5]
    lost = log(spark, *rows, row(4, None, kind="compaction", kept="gone"), row(5, text="5"))
    assert [r.seq for r in cut.live_blocks(lost).collect()] == [5]


def test_trees(spark):
    d = log(spark, row(0, parent=None), row(1, parent="e0"), row(2, parent="e0"), row(3, parent="e2"))
    assert [r.entry_id for r in tree.lineage(d).orderBy("pos").collect()] == ["e0", "e2", "e3"]
    tree.check(d)
    for bad, what in ((row(4, parent="zz"), "missing"), (row(1, entry="e1", parent="e0"), None)):
        if what:
            with pytest.raises(ValueError, match=what):
                tree.check(log(spark, row(0), bad))
    with pytest.raises(ValueError, match="cycle"):
        tree.check(log(spark, row(0, parent="e1"), row(1, parent="e0")))
    with pytest.raises(ValueError, match="duplicate"):
        tree.check(log(spark, row(0), row(1, entry="e0")))


def test_recall(spark, sample):
    r = recall.search(sample, Recall("LEDGER_41 month", snippet_bytes=128)).orderBy("rank").collect()
    assert [(x.entry_id, x.total, x.matched_terms) for x in r] == [("e3", 2, ["ledger_41", "month"]), ("e1", 2, ["month"])]
    assert recall.search(sample, Recall("LEDGER_\\d+", regex=True)).first().matched_terms == ["LEDGER_41"]
    with pytest.raises(ValueError):
        recall.check_range(sample, Recall("x", after_entry="e5", before_entry="e2"))
    with pytest.raises(ValueError):
        recall.check_range(sample, Recall("x", after_entry="zz"))
    assert [(x.entry_id, x.total) for x in recall.search_all(sample, Recall("quarter")).collect()] == [("e7", 2), ("e8", 2)]
    assert recall.search_lineage(sample, Recall("quarter")).count() == 0


def test_ranges_hold_in_each_session(spark):
    d = log(spark, *(row(i, text=f"word {i}", entry=f"m{i}", session=f"s{k}") for k in range(6) for i in range(4)), row(0, text="word", entry="m0", session="t"), row(1, text="word", entry="m1", session="t"))
    r = Recall("word", after_entry="m0", before_entry="m3")
    recall.check_range(d, r)
    got = recall.search(d, r).collect()
    assert sorted((x.session_id, x.entry_id) for x in got) == sorted((f"s{k}", f"m{i}") for k in range(6) for i in (1, 2))
    back = d.withColumn("seq", F.when(F.col("session_id") == "s2", 3 - F.col("seq")).otherwise(F.col("seq")))
    with pytest.raises(ValueError, match="invalid"):
        recall.check_range(back, r)


def test_positions_of_patterns(spark):
    d = log(spark, row(0, text="afoo " * 200 + "foo end"), row(1, text="end " * 300 + "😀 the end"))
    got = {x.seq: x.pos for x in recall.hits(d, Recall(r"\bfoo", regex=True)).collect()} | {x.seq: x.pos for x in recall.hits(d, Recall("end$", regex=True)).where("seq = 1").collect()}
    assert got == {0: 1001, 1: 1207}
    assert "foo end" in recall.search(d, Recall(r"\bfoo", regex=True, snippet_bytes=128)).first().snippet


def test_pages_are_cut_to_their_budget(spark):
    d = log(spark, *(row(i, text="needle " + "straw " * 800) for i in range(6)))
    for budget in (1024, 4096):
        page = recall.search(d, Recall("needle", per_page=4, snippet_bytes=2000, max_output_bytes=budget)).collect()
        assert len(page) == 4 and sum(len(x.snippet.encode()) for x in page) < budget and any(x.snippet for x in page)
    with pytest.raises(Exception, match="too small"):
        long = d.withColumn("entry_id", F.concat(F.repeat(F.lit("e"), 600), "entry_id"))
        recall.search(long, Recall("needle", max_output_bytes=1024)).collect()


def test_empty_log(spark):
    d = log(spark).limit(0)
    assert recall.search(d, Recall("x")).count() == sections.extract(d).count() == brief.transcript_lines(d).count() == cut.cuts(d).count() == tree.lineage(d).count() == 0


def test_frames():
    assert frames.layout("abcdef\ngh\n", 4, 2) == [["abcd", "ef"], ["gh"]]
    assert frames.layout("", 4, 2) == [[""]] and frames.layout("漢字", 1, 5) == [["漢", "字"]]
    w, h, data = frames.draw("ab\nc", 5, 3)
    assert (w, h) == (48, 32) and data[:4] == b"\x89PNG" and data == frames.draw("ab\nc", 5, 3)[2]


def test_tree_log_reader(spark, tmp_path):
    f = tmp_path / "a.jsonl"
    rows = [{"type": "session", "id": "S"}, {"type": "message", "id": "1", "parentId": None, "message": {"role": "user", "content": "hi"}}, {"type": "message", "id": "2", "parentId": "1", "message": {"role": "assistant", "content": [{"type": "toolCall", "id": "k", "name": "bash", "arguments": {"command": "ls"}}]}}, {"type": "message", "id": "3", "parentId": "2", "message": {"role": "tool", "toolCallId": "k", "toolName": "bash", "isError": True, "content": [{"type": "text", "text": "a"}, {"type": "text", "text": "b"}]}}]
    f.write_text("\n".join(map(json.dumps, rows)) + "\n{torn")
    d = logs.read(spark, str(f), strict=True).orderBy("seq").collect()
    assert [(r.session_id, r.entry_id, r.role, r.type) for r in d] == [("S", "1", "user", "text"), ("S", "2", "assistant", "toolCall"), ("S", "3", "toolResult", "toolResult")]
    assert d[2].text == "a\nb" and d[2].is_error and json.loads(d[1].arguments) == {"command": "ls"}
    f.write_text("{torn\n" + "\n".join(map(json.dumps, rows)))
    with pytest.raises(ValueError):
        logs.read_tree(spark, str(f), strict=True)
    assert logs.malformed(spark, str(f)).first().n == 1


def test_transcript_reader(spark, tmp_path):
    def rec(uuid, parent, kind="user", **more):
        return {"type": kind, "uuid": uuid, "parentUuid": parent, "sessionId": "ledger", "isSidechain": False, "timestamp": "2024-03-01T00:00:30+02:00"} | more

    said = lambda role, content: {"message": {"role": role, "content": content}}
    rows = [
        rec("n1", None, **said("user", "sum it")),
        rec("n2", "n1", "assistant", **said("assistant", [{"type": "tool_use", "id": "t1", "name": "Grep", "input": {"pattern": "cents"}}])),
        rec("n3", "n2", **said("user", [{"type": "tool_result", "tool_use_id": "t1", "content": "three lines"}])),
        rec("n3", "n2", **said("user", "the id again")),
        rec("n4", "n3", isSidechain=True, **said("user", "beside")),
        rec("n5", None, "system", logicalParentUuid="unknown", content="a remark"),
    ]
    f = tmp_path / "t.jsonl"
    f.write_text("\n" + "\n".join(map(json.dumps, rows)) + "\n{half\n")
    assert logs.sniff(spark, str(f)) == "transcript"
    d = logs.read(spark, str(f)).orderBy("seq").collect()
    assert [(r.session_id, r.entry_id, r.role, r.tool_name) for r in d] == [("ledger", "n1", "user", ""), ("ledger", "n2", "assistant", "Grep"), ("ledger", "n3", "toolResult", "Grep"), ("ledger", "n5", "system", "")]
    # as written, whatever the offset: the first of March, half a minute past midnight
    assert d[0].ts == 19_783 * 86_400 + 30 and d[3].parent_id is None


def test_logical_links_that_lead_back_are_cut(spark, tmp_path):
    def rec(uuid, parent, logical=None):
        return {"type": "user", "uuid": uuid, "parentUuid": parent, "logicalParentUuid": logical, "sessionId": "s", "message": {"role": "user", "content": uuid}}

    # a boundary whose logical parent was written again behind it; another one that stands where it should
    rows = [rec("a", None), rec("b", "a"), rec("edge", None, "d"), rec("c", "edge"), rec("d", "c"), rec("e", "d"), rec("edge2", None, "e"), rec("f", "edge2")]
    f = tmp_path / "t.jsonl"
    f.write_text("\n".join(map(json.dumps, rows)))
    d = logs.read(spark, str(f))
    assert {r.entry_id: r.parent_id for r in d.collect()} == {"a": None, "b": "a", "edge": None, "c": "edge", "d": "c", "e": "d", "edge2": "e", "f": "edge2"}
    assert [r.entry_id for r in tree.lineage(d).orderBy("pos").collect()] == ["edge", "c", "d", "e", "edge2", "f"]
    tree.check(d)


def test_chat_and_host_rows(spark):
    msgs = [{"role": "system", "content": "x"}, {"role": "user", "content": "hi"}, {"role": "assistant", "content": "", "tool_calls": [{"id": "k", "type": "function", "function": {"name": "f", "arguments": "{bad"}}]}, {"role": "tool", "tool_call_id": "k", "name": "f", "content": "out"}, {"role": "assistant", "content": ""}]
    d = chat.entries(spark.createDataFrame([("s", i, json.dumps(m)) for i, m in enumerate(msgs)], "session_id string, seq long, message string")).orderBy("seq").collect()
    assert [(r.entry_id, r.parent_id, r.role, r.type) for r in d] == [("m1", None, "user", "text"), ("m2", "m1", "assistant", "toolCall"), ("m3", "m2", "toolResult", "toolResult")]
    assert json.loads(d[1].arguments) == {"raw": "{bad"}
    rows = [("s", 0, "user", "go", [], []), ("s", 1, "assistant", "", [("k", "Bash", "{}")], []), ("s", 2, "user", "more", [], [("k", "out", False)])]
    h = chat.host_entries(spark.createDataFrame(rows, "session_id string, seq long, role string, text string, tool_uses array<struct<tool_use_id:string,tool:string,input:string>>, tool_results array<struct<tool_use_id:string,text:string,isError:boolean>>")).orderBy("seq").collect()
    assert [(r.entry_id, r.role, r.tool_name) for r in h] == [("m0", "user", None), ("m1", "assistant", "Bash"), ("m2:r0", "toolResult", "Bash"), ("m2", "user", None)]
    assert chat.parse_instructions('keep:2 policy:vcc "do it"') == {"keep": 2, "policy": "vcc", "prompt": "do it"}


def test_helpers_of_hosts(spark, tmp_path):
    from sparkbrief.operators import adapters
    from sparkbrief.schema import Settings
    from sparkbrief.sources import snapshots

    assert adapters.parse_recall("month totals role:user page:2") == {"query": "month totals", "role": "user", "page": 2}
    assert adapters.parse_recall("/cent(s)?/ scope:all") == {"query": "cent(s)?", "regex": True, "scope": "all"}
    assert adapters.parse_recall('{"query": "a b", "page": 3}') == {"query": "a b", "page": 3}
    with pytest.raises(ValueError):
        adapters.parse_recall("x page:1 page:2")
    assert [adapters.policy_name(x) for x in ("AUTO", "vcc-only", "Snap-Compact", "none")] == ["auto", "vcc", "snap", None]
    assert Settings.parse({"policy": "snap", "keepUserTurns": 2.9, "debug": "yes", "snap": {"minChars": -1, "providers": ["a", 1]}, "other": 1}) == Settings(policy="snap", keep=2, min_chars=0, providers=("a",))
    assert Settings.parse(None) == Settings.parse({"keepUserTurns": True, "snap": 3}) == Settings()
    one = spark.createDataFrame([("auto", None, "Invalid image in request", 12_345, 900, 3), ("on", False, "quota exceeded", 1_234, 1_300, None), ("off", True, None, 10, 10, 1)], "mode string, seen boolean, error string, b long, a long, k long")
    got = one.select(adapters.sees_frames(F.col("mode"), F.col("seen")).alias("v"), adapters.refuses_pictures(F.col("error")).alias("r"), adapters.notice(F.col("b"), F.col("a"), F.col("k"), "x").alias("n")).collect()
    assert [tuple(r) for r in got] == [(False, True, "x · 12k → 900 tokens (−93%) · kept 3 messages"), (True, False, "x · 1.2k → 1.3k tokens (+5%)"), (False, False, "x · 10 → 10 tokens (−0%) · kept 1 messages")]
    assert one.select(adapters.guarded(F.col("mode"), 4).alias("m")).count() == 3
    with pytest.raises(Exception, match="more than 2 bytes"):
        one.select(adapters.guarded(F.col("mode"), 2).alias("m")).collect()
    assert snapshots.list_snapshots(spark, str(tmp_path / "none")).count() == 0
    snapshots.write_json(one, str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).count() == 3


def test_state_of_streams(spark, tmp_path):
    """Sections folded batch by batch are those of the plain fold, and a batch writes only the parts of its own sessions."""
    from sparkbrief.streaming import incremental

    batches = [
        log(spark, row(1, text="Sum the ledger", session="a"), row(1, text="Sort the mail", session="b")),
        log(spark, row(2, "toolResult", "Error E4410 while loading rates", type_="toolResult", tool="bash", error=True, session="a")),
        log(spark, row(3, text="Never round up the cents", session="a")),
    ]
    for i, b in enumerate(batches):
        b.write.parquet(f"{tmp_path}/in/{i}")
    s = spark.readStream.schema(BLOCKS).option("maxFilesPerTrigger", 1).option("latestFirst", "false").parquet(f"{tmp_path}/in/*")
    incremental.run_all(lambda: incremental.brief_stream(s, f"{tmp_path}/state", f"{tmp_path}/cp"))
    got = incremental.brief_state(spark.read.parquet(f"{tmp_path}/state"))
    assert {(r.session_id, r.section, r.item) for r in got.where("section in ('goal', 'key_facts', 'preferences')").collect()} >= {("a", "key_facts", "Error E4410 while loading rates"), ("b", "goal", "Sort the mail")}
    empty = log(spark).limit(0)
    assert recall.search_all(empty, Recall("x")).count() == 0
