"""The factorisation machine against sums over all pairs, numerical gradients and a word that tells something only in pairs."""

import random

import numpy as np
from pyspark.sql import functions as F

from strataq.llm import toxicity

FILL = "alder birch cedar elm fir hazel larch maple oak pine rowan spruce willow yew aspen".split()


def test_score_is_the_sum_over_pairs():
    rng = np.random.default_rng(3)
    w, v, b = rng.normal(size=9), rng.normal(size=(9, 4)), 0.3
    active = [np.flatnonzero(rng.random(9) < 0.5) for _ in range(40)] + [np.zeros(0, np.int64)]
    rows, cols = np.repeat(np.arange(41), [len(a) for a in active]), np.concatenate(active)
    x = rng.random(len(cols))
    got = toxicity._forward(b, w, v, rows, cols, 41, x)[0]
    for i in range(41):
        own = [(c, xc) for r, c, xc in zip(rows, cols, x) if r == i]
        want = b + sum(w[c] * xc for c, xc in own)
        for k, (c, xc) in enumerate(own):
            want += sum(float(v[c] @ v[d]) * xc * xd for d, xd in own[:k])
        assert abs(got[i] - want) < 1e-9
    model = toxicity.Model({}, b, w, v)
    flat = toxicity._forward(b, w, v, rows, cols, 41)[0]
    assert np.allclose(model.score(active), 1 / (1 + np.exp(-flat)))


def test_strength_is_folded_into_the_model():
    rng = np.random.default_rng(4)
    active = [np.flatnonzero(rng.random(6) < 0.5) for _ in range(200)]
    y = np.array([float(0 in a and 1 in a) for a in active])
    index, strength = {t: t for t in range(6)}, np.array([1.0, 1.0, 0.5, 0.1, 0.1, 0.1])
    model = toxicity.fit(active, y, index, strength, np.array([True] * 3 + [False] * 3))
    assert (abs(model.factors[3:]) < 0.2).all()
    assert ((model.score(active) >= 0.5) == (y == 1)).mean() > 0.98


def test_a_word_that_tells_only_beside_another(spark):
    """Half of the clean texts name the group (a ratio under 2), many hold the insult; only both together are toxic."""
    rng = random.Random(2)
    texts, labels = [], []
    for i in range(3000):
        insult, group = rng.random() < 0.3, rng.random() < 0.55
        words = [rng.choice(FILL) for _ in range(20)] + ["nasty"] * insult + ["martians"] * group
        rng.shuffle(words)
        texts.append((i, " ".join(words)))
        labels.append((i, int(insult and group)))
    docs, y = spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    model = toxicity.learn(docs, y)
    assert {toxicity._hash(b"nasty"), toxicity._hash(b"martians"), toxicity._hash(b"alder")} <= set(model.index)
    got = {r["doc_id"]: r for r in toxicity.score(docs, model).collect()}
    held = [(got[i]["predicted"], v) for i, v in labels if got[i]["held_out"]]
    assert sum(a == b for a, b in held) / len(held) > 0.97


def test_reject_judges_every_row(spark):
    index = {toxicity._hash(b"nasty"): 0}
    model = toxicity.Model(index, -2.0, np.array([5.0]), np.zeros((1, toxicity.FACTORS)))
    rows = [(1, "nasty", "a"), (1, "fine", "b"), (None, "nasty thing", "c"), (None, None, "d"), (2, "", None), (3, "fine " * 5000, "e"), (3, "fine " * 5000, "e")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string")
    kept = toxicity.reject(docs, model)
    assert kept.schema == docs.schema
    assert sorted(kept.select(F.coalesce("score", F.lit("-"))).collect()) == sorted([("b",), ("d",), ("-",), ("e",), ("e",)])
    assert toxicity.reject(docs.limit(0), model).count() == 0


def test_blocks_hold_every_row_once(monkeypatch):
    rng = np.random.default_rng(5)
    for block in (1, 3, 50, 10_000):
        monkeypatch.setattr(toxicity, "BLOCK", block)
        for n in (1, 2, 40):
            rows = np.repeat(np.arange(n, dtype=np.int32), rng.integers(0, 6, n))
            cols = rng.integers(0, 9, len(rows)).astype(np.int32)
            blocks = toxicity._blocks(rows, cols, n)
            assert [lo for lo, *_ in blocks] == [0, *[hi for _, hi, *_ in blocks][:-1]] and blocks[-1][1] == n
            assert np.concatenate([r + lo for lo, _, r, _ in blocks]).tolist() == rows.tolist()
            assert np.concatenate([c for *_, c in blocks]).tolist() == cols.tolist()


def test_fit_does_not_depend_on_blocks(monkeypatch):
    rng = np.random.default_rng(6)
    active = [np.flatnonzero(rng.random(6) < 0.5) for _ in range(300)]
    y = np.array([float(0 in a and 1 in a) for a in active])
    index, strength, core = {t: t for t in range(6)}, np.array([1.0, 1.0, 0.5, 0.1, 0.1, 0.1]), np.array([True] * 3 + [False] * 3)
    whole = toxicity.fit(active, y, index, strength, core)
    monkeypatch.setattr(toxicity, "BLOCK", 20)
    parts = toxicity.fit(active, y, index, strength, core)
    assert np.allclose(whole.weights, parts.weights) and np.allclose(whole.factors, parts.factors) and np.isclose(whole.bias, parts.bias)
