"""Text handling at the edges: segments, long texts, long words, and results that do not depend on neighbours."""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
import pytest

from sparkbrief.llm import _words, line_runs, passages, quality, toxicity
from sparkbrief.llm._words import BASES, SPACE, Chunk, cut, mix, roll, span_hashes, spans, whole

M = 1 << 64


def poly(values, which=0):
    return sum(int(v) * pow(BASES[which], i, M) for i, v in enumerate(values)) % M


@pytest.fixture
def small(monkeypatch):
    """Segments of a few values, so that all edges occur in short texts."""
    monkeypatch.setattr(_words, "SEGMENT", 16)
    monkeypatch.setattr(_words, "_POW", {})


def test_spans_and_runs(small):
    rng = np.random.default_rng(1)
    v = rng.integers(0, 1 << 63, 200).astype(np.uint64)
    edges = np.sort(rng.choice(200, 24, replace=False))
    a, b = edges[::2], edges[1::2]
    for which in (0, 1):
        assert spans(lambda lo, hi: v[lo:hi], a, b, which).tolist() == [poly(v[x:y], which) for x, y in zip(a, b, strict=True)]
    assert spans(lambda lo, hi: v[lo:hi], np.array([0, 3, 3]), np.array([0, 3, 190])).tolist() == [0, 0, poly(v[3:190])]
    for n in (1, 3, 15, 16, 40):
        want = [int(mix(np.array([poly(v[i : i + n])], np.uint64), 31 * n)[0]) for i in range(200 - n + 1)]
        assert roll(v, n).tolist() == want
    assert len(roll(v, 201)) == 0


def test_words_do_not_depend_on_segments(small):
    rng = random.Random(2)
    texts = ["".join(rng.choice("ab é\n") for _ in range(rng.choice([0, 1, 5, 60]))) for _ in range(40)] + ["x" * 100, None, "y z" * 30]
    c = Chunk(pa.array(texts))
    seen = {}
    words = [c.data[a:b].tobytes() for a, b in zip(c.starts, c.ends, strict=True)]
    for w, h in zip(words, c.word_hashes(0).tolist(), strict=True):
        assert seen.setdefault(w, h) == h
    assert len(set(seen.values())) == len(seen)
    assert whole(c, c.word_hashes(0)).tolist() == [int(whole(Chunk(pa.array([t], pa.string())), Chunk(pa.array([t], pa.string())).word_hashes(0))[0]) for t in texts]
    assert span_hashes(c.data, c.starts, c.ends, 1).tolist() == c.word_hashes(1).tolist()


def test_cuts_stand_at_spaces():
    rng = random.Random(3)
    texts = ["".join(rng.choice("ab \n") for _ in range(rng.choice([0, 3, 50, 400]))) for _ in range(30)] + ["", "q" * 300, "r" * 70 + " s", None, ""]
    back = [b""] * len(texts)
    for data, off, text in cut(pa.array(texts), 64):
        for t, a, b in zip(text, off[:-1], off[1:], strict=True):
            part = data[a:b].tobytes()
            assert not back[t] or not part or SPACE[part[0]]
            assert len(part) <= 64 or not SPACE[data[a + 1 : a + 64]].any()
            back[t] += part
    assert back == [(t or "").encode() for t in texts]


@pytest.mark.parametrize("text", ["word " * 10_000_000, "line of some words\n" * 2_500_000, "x" * 20_000_000], ids=["words", "lines", "one word"])
def test_very_long_texts(text):
    """Texts of 20 to 50 MB through all measures, beside short ones, which come out as they do alone."""
    arr = pa.array([text, "a short text", None])
    m = toxicity.Model((3, 5, 7), np.linspace(-1, 1, 1 << 17).astype(np.float32), 0.1, 200.0, 200.0)
    assert np.allclose(m.score(arr)[1:], m.score(arr.slice(1)))
    assert np.allclose(quality.features(arr)[1:], quality.features(arr.slice(1)))
    data, _, starts, ends, doc = line_runs._lines(arr)
    at, h1, _ = line_runs._keyed(data, starts, ends, 5)
    assert len(np.unique(h1[doc[at] == 0])) == 1
    run, _ = passages._sketch(50)
    batch = pa.RecordBatch.from_arrays([pa.array([1, 2, 3]), arr, pa.array([0, 0, 0]), pa.array([0, 0, 0])], names=["doc_id", "text", "x1", "x2"])
    got = pa.Table.from_batches(run([batch]))
    assert got.column("n_words").to_pylist() == [len(text.split()), 3, 0]
    assert max(map(len, _words._POW.values())) <= _words.SEGMENT + 1


def test_long_texts_are_trained_in_pieces(spark):
    rows = [(i, " ".join(["plain"] * 30), 0) for i in range(30)] + [(100, "vile nasty " * 4000, 1)]
    d = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    t = toxicity.Training(piece=1000, max_rows=60)
    labelled = d.select("doc_id", "text", d.toxic.alias("label"))
    s = toxicity.sample(labelled, t)
    assert len(s) == 60 and s.column("label").to_pylist().count(1) > 20
    assert sum(len(x) for x in toxicity.sample(labelled, toxicity.Training(piece=1000, max_bytes=5000)).column("text").to_pylist()) <= 5000
    m = toxicity.fit(d, d, "toxic", t)
    assert m.score(pa.array(["vile nasty " * 50]))[0] > 0.5 > m.score(pa.array(["plain " * 50]))[0]
    two = d.select("doc_id", "toxic").unionByName(d.selectExpr("doc_id", "0 as toxic"))
    assert (toxicity.fit(d, two, "toxic", t).value == m.value).all()


def test_lower_case_is_the_same_wherever_terms_are_counted(spark):
    """A term with letters whose lower case depends on the mapping is found as any other."""
    from sparkbrief.llm import disclosure

    rows = [(0, "plain ΟΔΟΣ ann@y.org"), (1, "plain İzmİr bo@y.org")] + [(10 + i, f"plain text {i}") for i in range(60)]
    got = {r.doc_id: r.spans for r in disclosure.find(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[0] == "term:6:10,email:11:20" and got[1] == "term:6:11,email:12:20"
