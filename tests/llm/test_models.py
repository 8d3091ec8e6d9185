"""Classifiers: held-out accuracy, determinism, odd inputs."""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sparkbrief.llm import quality, toxicity
from sparkbrief.llm.queries import remainder, table

SF = "/root/testdata/sf0.01"


def toxic_texts(n, words, seed):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        w = ["".join(rng.choice(("the", "an", "on", "er", "ing", "re")) for _ in range(3)) for _ in range(rng.randint(20, 60))]
        if i % 4 == 0:
            for _ in range(5):
                w[rng.randrange(len(w))] = rng.choice(words)
        out.append(" ".join(w))
    return pa.array(out), np.array([int(i % 4 == 0) for i in range(n)])


def test_misspellings_share_vectors():
    t = toxicity.Training(epochs=20, bits=14)
    m = toxicity.train(*toxic_texts(400, ["scoundrel", "blockhead"], 1), t)
    texts, y = toxic_texts(200, ["scoundrel", "blockhead"], 3)
    assert ((m.score(texts) >= 0.7) == y).mean() > 0.95
    texts, y = toxic_texts(200, ["sc0undrel", "blokhead"], 2)
    s = m.score(texts)
    # the share of pairs of a toxic and a clean text that are ranked right; at the cut of 0.7 a fifth of them is found, and no clean text
    assert (s[y == 1][:, None] > s[y == 0][None, :]).mean() > 0.9
    assert (s[y == 1] >= 0.7).mean() > 0.15 and (s[y == 0] >= 0.7).mean() < 0.02
    assert (s == toxicity.train(*toxic_texts(400, ["scoundrel", "blockhead"], 1), t).score(texts)).all()
    odd = m.score(pa.array([None, "", " ", "a", "x" * 5000]))
    assert odd.shape == (5,) and np.isfinite(odd).all() and odd[0] == odd[1]


def test_toxicity_held_out(spark):
    docs, labels = table(spark, "/root/testdata/sf0.1", "documents"), table(spark, "/root/testdata/sf0.1", "labels")
    fold = remainder(F.col("doc_id"), 3)
    m = toxicity.fit(docs, labels.where(fold != 1), "toxic")
    s = toxicity.score(docs, m).join(labels.where(fold == 1), "doc_id").where("toxic is not null").collect()
    assert np.mean([r.score >= 0.7 for r in s if r.toxic]) > 0.7 and np.mean([r.score >= 0.7 for r in s if not r.toxic]) < 0.03


def test_training_without_two_labels():
    m = toxicity.train(pa.array([], pa.string()), np.zeros(0))
    assert m.score(pa.array(["x"]))[0] == pytest.approx(0.5)
    q = quality.train(np.zeros((3, len(quality.NAMES))), np.ones(3))
    assert q.score(np.zeros((1, len(quality.NAMES))))[0] > 0.8


def test_trees_learn_a_rule():
    rng = np.random.default_rng(1)
    x = rng.random((3000, 4))
    y = (x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)
    m = quality.train(x[:2000], y[:2000])
    assert ((m.score(x[2000:]) > 0.5) == y[2000:]).mean() > 0.97


def test_measures_do_not_depend_on_neighbours():
    texts = ["one two three. one two three.\nA!\nA!", None, "", "ÄÖ 漢字 $$$ x", "\n\n", "B " * 50]
    alone = np.concatenate([quality.features(pa.array([t], pa.string())) for t in texts])
    assert np.allclose(alone, quality.features(pa.array(texts))) and np.isfinite(alone).all()


def test_quality_held_out(spark):
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    m = quality.fit(docs, labels.where(remainder(F.col("doc_id"), 5) != 0), "quality")
    s = quality.score(docs, m).join(labels.where(remainder(F.col("doc_id"), 5) == 0), "doc_id").collect()
    assert np.mean([(r.score >= 0.3) == r.quality for r in s]) > 0.95
    clash = docs.limit(5).withColumns({"score": F.lit(1), "keep_0": F.lit(2)})
    assert quality.score(clash, m).count() == 5 and quality.score(docs.limit(0), m).count() == 0
    assert toxicity.score(docs.limit(0), toxicity.train(pa.array([], pa.string()), np.zeros(0))).count() == 0
