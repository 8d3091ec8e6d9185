"""Text expressions against plain Python statements of the same rules."""

from __future__ import annotations

import json
import random

import pytest
from pyspark.sql import functions as F

from sparkbrief.functions import text, udfs
from sparkbrief.functions.udfs import shrink
from sparkbrief.operators import recall
from sparkbrief.schema import Recall


def cut(s: str, n: int) -> str:
    return s.encode()[:n].decode(errors="ignore")


@pytest.fixture(scope="module")
def strings():
    rng = random.Random(1)
    return ["", " ", "a", "é", "\n", "a\n", "a\r\nb", "a\n\nb\n", "İx", "𝄞𝄞", *("".join(rng.choice("aé漢𝄞 \n\r\t") for _ in range(rng.randint(0, 12))) for _ in range(150))]


def column(spark, strings, expr):
    return [r.v for r in spark.createDataFrame([(i, s) for i, s in enumerate(strings)], "i int, s string").orderBy("i").select(expr(F.col("s")).alias("v")).collect()]


def test_truncation_keeps_characters(spark, strings):
    for n in (1, 3, 5):
        assert column(spark, strings, lambda c: text.truncate_bytes(c, n)) == [cut(s, n) for s in strings]  # noqa: B023
    want = [s if len(s.encode()) <= 6 else cut(s, 3) + "…" for s in strings]
    assert column(spark, strings, lambda c: text.truncate_ellipsis(c, 6)) == want


def test_lines(spark, strings):
    def of(s):
        out = s.split("\n")
        out = out[:-1] if out[-1] == "" else out
        return [x[:-1] if x.endswith("\r") and (i < len(out) - 1 or s.endswith("\n")) else x for i, x in enumerate(out)]

    assert column(spark, strings, text.lines) == [of(s) for s in strings]


def test_trim_and_collapse(spark, strings):
    assert column(spark, strings, text.utrim) == [s.strip() for s in strings]
    assert column(spark, strings, text.collapse) == [" ".join(s.lower().split()) for s in strings]
    assert column(spark, [" x "], text.utrim) == ["x"]


def test_tokens_and_calibration(spark):
    d = spark.createDataFrame([(38, 0), (39, 500), (2000, 500), (2000, 250), (9000, 300)], "b long, t long")
    assert [r.v for r in d.select(text.tokens(F.col("b")).alias("v")).collect()] == [10, 10, 526, 526, 2368]
    assert [r.v for r in d.select(text.calibrate(F.col("b"), F.col("t")).alias("v")).collect()] == [3.8, 3.8, 4.0, 8.0, 3.8]


def test_short_path(spark):
    paths = ["/Users/x/dev/app/a.ts", "/Users/x/app/a.ts", "/Users/x", "src/a.ts"]
    assert column(spark, paths, text.short_path) == ["app/a.ts", "app/a.ts", "/Users/x", "src/a.ts"]


def test_classes_and_quotes():
    assert [udfs.classify(x) for x in ("", " \n", '{"a":1}', '{"a":1} x', "[1, 2]", "[NaN]", "{", None)] == ["empty", "empty", "json", "text", "json", "text", "text", "empty"]
    assert udfs.quoted('a"\\\n\u0001é') == '"a\\"\\\\\\n\\u{1}é"'


def test_snippet_is_bounded():
    s = "é" * 500 + "needle" + "漢" * 500
    out = udfs.snippet_of(s, s.index("needle"), 128, False)
    assert len(out.encode()) <= 128 and "needle" in out and out.startswith("…") and out.endswith("…")
    assert udfs.snippet_of("short", 0, 128, True) == "short"
    folded = "İ" * 40 + "term"
    assert "term" in udfs.snippet_of(folded, folded.lower().index("term"), 128, True)


def test_recall_options():
    for bad in ({"query": " "}, {"query": "x" * 513}, {"query": "x", "page": 0}, {"query": "x", "per_page": 21}, {"query": "x", "snippet_bytes": 127}, {"query": "x", "max_output_bytes": 1023}, {"query": "x", "role": "system"}, {"query": "x", "tool_name": ""}):
        with pytest.raises(ValueError):
            Recall(**bad)
    for bad in ("(?=a)", r"(a)\1", "("):
        with pytest.raises(ValueError):
            recall.java_pattern(bad)
    assert recall.java_pattern("a$") == r"(?Ud)a\z"


def test_shrink():
    page = json.dumps({"total": 2, "hits": [{"rank": 1, "snippet": "x" * 900}, {"rank": 2, "snippet": "é" * 400}]}, ensure_ascii=False)
    out = shrink(page, 1024)
    assert 300 < sum(len(x.encode()) for x in out) < 1024 and out[0].endswith("…")
    with pytest.raises(ValueError):
        shrink(page, 10)
