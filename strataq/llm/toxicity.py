"""Toxicity: a factorisation machine over hashed terms.

A linear score can't tell an insult beside a group's name from either alone; the machine adds a learned
inner product for each pair of terms that a text holds. Its terms are those that the label speaks for or against, and,
whatever the label says, all frequent ones, so that a term which tells something only beside another one is there.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataq.llm import common

#: Labelled rows that are learned from at most, those first by a hash of their ids.
MAX_TRAIN = 20_000
#: Terms in this share of the rows at least are the machine's, whatever their association with the label.
FREQUENT = 0.02
#: Steps on the associated terms alone, then on all of them, with their rates.
STEPS, ALL_STEPS = (120, 0.05), (15, 0.02)
FACTORS, DECAY = 6, 1e-4
#: Terms of a block of rows, whose gradients are added up at a time.
BLOCK = 1 << 17
#: What a term without association counts for, where a fully associated one counts 1.
FLOOR = 0.1
#: A word also counts as its first bytes, so that unseen forms of a seen root are met.
PREFIX = 5


def _hash(term: bytes) -> int:
    return zlib.crc32(term)


def words(text: str) -> list[bytes]:
    return text.encode().translate(common.ALNUM).split()


def terms(word: bytes) -> tuple[int, ...]:
    """Hashed terms of one word."""
    return (_hash(word), _hash(b"^" + word[:PREFIX])) if len(word) > PREFIX else (_hash(word),)


class Model(NamedTuple):
    index: dict[int, int]
    bias: float
    weights: np.ndarray
    factors: np.ndarray

    def score(self, active: list[np.ndarray]) -> np.ndarray:
        """Probability of label 1 for each text, from the numbers of its distinct terms."""
        n = np.array([len(a) for a in active])
        rows = np.repeat(np.arange(len(active)), n)
        cols = np.concatenate(active).astype(np.int64) if len(rows) else np.zeros(0, np.int64)
        return _sigmoid(_forward(self.bias, self.weights, self.factors, rows, cols, len(active))[0])


class _Known(dict):
    """Words seen before, and the numbers of the model's terms among theirs."""

    def __init__(self, index: dict[int, int]):
        super().__init__()
        self.index = index

    def __missing__(self, word: bytes) -> tuple[int, ...]:
        out = tuple(i for t in terms(word) if (i := self.index.get(t)) is not None)
        if len(self) > 400_000:
            self.clear()
        self[word] = out
        return out


def active_terms(texts: list[str], known: _Known) -> list[np.ndarray]:
    return [np.array(sorted({i for found in map(known.__getitem__, words(t)) if found for i in found}), dtype=np.int64) for t in texts]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _forward(bias, w, v, rows, cols, n, x=None):
    """Scores of n rows whose terms are cols, each with the value x (1 if not given), and the sums of their factors."""
    x = np.ones(len(cols)) if x is None else x
    sums = np.stack([np.bincount(rows, v[cols, f] * x, n) for f in range(v.shape[1])], 1)
    squares = np.bincount(rows, (v**2).sum(1)[cols] * x**2, n)
    return bias + np.bincount(rows, w[cols] * x, n) + 0.5 * ((sums**2).sum(1) - squares), sums


def _blocks(rows: np.ndarray, cols: np.ndarray, n: int) -> list[tuple[int, int, np.ndarray, np.ndarray]]:
    """Ranges of whole rows with about BLOCK terms each, and their terms: (first row, end, rows counted from the first, terms)."""
    ends = np.searchsorted(rows, np.arange(n), "right")
    cuts = np.unique(np.searchsorted(ends, np.arange(BLOCK, len(rows) + BLOCK, BLOCK)) + 1).clip(max=n).tolist()
    starts = [0, *cuts]
    if starts[-1] < n:
        cuts.append(n)
    out = []
    for lo, hi in zip(starts, cuts, strict=False):
        if lo < hi:
            at = slice(ends[lo - 1] if lo else 0, ends[hi - 1])
            out.append((lo, hi, rows[at] - np.int32(lo), cols[at]))
    return out


def fit(active: list[np.ndarray], labels: np.ndarray, index: dict[int, int], strength: np.ndarray, core: np.ndarray) -> Model:
    """Adam on the mean log loss, first over the core terms, then over all; the same rows give the same model.

    A term counts as its strength, which is folded into its weight and factors at the end. Each step adds up the gradients of
    blocks of rows, so it needs little memory beside the terms themselves.
    """
    rng = np.random.default_rng(7)
    size, n = len(index), len(labels)
    rate = float(np.clip(labels.mean() if n else 0.05, 0.01, 0.4))
    w, v, b = np.zeros(size), rng.normal(0, 0.05, (size, FACTORS)), np.log(rate / (1 - rate))
    if not n or not size or labels.min() == labels.max():
        return Model(index, float(b if not n or labels.min() < 1 else -b), w, v * 0)
    v[~core] *= 0.2
    rows = np.repeat(np.arange(n, dtype=np.int32), [len(a) for a in active])
    cols = np.concatenate(active).astype(np.int32)
    for steps, pace, moving in ((*STEPS, core), (*ALL_STEPS, np.ones(size, dtype=bool))):
        used = moving[cols]
        blocks = _blocks(rows[used], cols[used], n)
        m, s = [0.0, 0.0, 0.0], [0.0, 0.0, 0.0]
        for step in range(1, steps + 1):
            gw, own, gv, gb = np.zeros(size), np.zeros(size), np.zeros((size, FACTORS)), 0.0
            for lo, hi, r, c in blocks:
                x = strength[c]
                out, sums = _forward(b, w, v, r, c, hi - lo, x)
                g = (_sigmoid(out) - labels[lo:hi]) / n * 10
                gx = g[r] * x
                gw += np.bincount(c, gx, size)
                own += np.bincount(c, gx * x, size)
                for f in range(FACTORS):
                    gv[:, f] += np.bincount(c, gx * sums[r, f], size)
                gb += g.sum()
            gw += DECAY * w
            gv += DECAY * v - own[:, None] * v
            for i, grad in enumerate((gw * moving, gv * moving[:, None], gb)):
                m[i] = 0.9 * m[i] + 0.1 * grad
                s[i] = 0.99 * s[i] + 0.01 * grad**2
                move = pace * (m[i] / (1 - 0.9**step)) / (np.sqrt(s[i] / (1 - 0.99**step)) + 1e-8)
                if i == 0:
                    w = w - move
                elif i == 1:
                    v = v - move
                else:
                    b = b - move
    return Model(index, float(b), w * strength, v * strength[:, None])


def learn(docs: DataFrame, labels: DataFrame, folds: int = 5, max_train: int = MAX_TRAIN) -> Model:
    """A model of labels.toxic, from rows whose crc32(doc_id as text) modulo folds isn't 0.

    Learns from max_train labelled rows at most; the sample of (doc_id, toxic), its size bounded by that
    parameter, is broadcast, so texts don't move. Terms are counted over the whole sample on the executors;
    only the sums of chosen terms, and which row has which, reach the driver. Chosen are terms in FREQUENT of the
    sample's rows, by that alone, and rarer ones in 3 rows or more with an association (|z| > 4, |log ratio| > 0.7); a
    rare term that no label speaks for is none. Their number has no cap: it is bounded by the sample. A labelled row
    without a text or an id is not learned from; of contrary labels of one id the higher counts.
    """
    spark = common.prepare(docs.sparkSession)
    sample = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
        .where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & (common.crc_mod(F.col("doc_id"), folds) != 0))
        .groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_train)
    )
    sample = common.settle(sample.coalesce(1))
    train = common.settle(common.whole_texts(docs).join(F.broadcast(sample), "doc_id"))

    def tally(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cache: dict[bytes, tuple[int, ...]] = {}
        sums: dict[int, list[int]] = {}
        for pdf in batches:
            for text, y in zip(pdf["text"], pdf["toxic"], strict=True):
                own = {t for w in set(words(text)) for t in (cache.get(w) or cache.setdefault(w, terms(w)))}
                for t in own:
                    sums.setdefault(t, [0, 0])[y] += 1
            if len(cache) > 400_000:
                cache.clear()
        yield pd.DataFrame([(t, a, b) for t, (a, b) in sums.items()], columns=["term", "n0", "n1"])

    counts = train.mapInPandas(tally, "term long, n0 long, n1 long").groupBy("term").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    totals = train.groupBy("toxic").count().collect()
    n = {r["toxic"]: r["count"] for r in totals}
    n0, n1 = n.get(0, 0), n.get(1, 0)
    if not n0 or not n1:
        return fit([], np.array([1.0] * bool(n1)), {}, np.zeros(0), np.zeros(0, dtype=bool))
    a, b = F.col("n1") / n1, F.col("n0") / n0
    spread = (F.col("n1") + F.col("n0")) / (n0 + n1)
    z = (a - b) / F.sqrt(spread * (1 - spread) * (1 / n0 + 1 / n1) + 1e-12)
    ratio = F.log((F.col("n1") + 0.5) / (n1 + 1)) - F.log((F.col("n0") + 0.5) / (n0 + 1))
    told = (F.col("n0") + F.col("n1") >= 3) & (F.abs(z) > 4) & (F.abs(ratio) > 0.7)
    chosen = counts.where(told | (spread >= FREQUENT))
    strength = F.least(F.lit(1.0), F.greatest(F.lit(FLOOR), F.abs(ratio) * z * z / (z * z + 16)))
    picked = sorted(chosen.select("term", strength.alias("strength"), told.alias("told")).collect())
    index = {r["term"]: i for i, r in enumerate(picked)}
    shared = spark.sparkContext.broadcast(index)

    def reduce(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = _Known(shared.value)
        for pdf in batches:
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "toxic": pdf["toxic"], "active": active_terms(pdf["text"].tolist(), known)})

    rows = train.mapInPandas(reduce, "doc_id long, toxic int, active array<int>").toArrow()
    common.discard(sample, train)
    order = np.argsort(rows["doc_id"].to_numpy(), kind="stable")
    lists = rows["active"].combine_chunks()
    flat, at = lists.values.to_numpy(zero_copy_only=False), lists.offsets.to_numpy()
    weights, core = np.array([r["strength"] for r in picked]), np.array([r["told"] for r in picked], dtype=bool)
    model = fit([flat[at[i] : at[i + 1]] for i in order], rows["toxic"].to_numpy()[order].astype(float), index, weights, core)
    del rows, lists, flat
    common.trim()
    return model


def score(docs: DataFrame, model: Model, folds: int = 5) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of docs (doc_id, text).

    Only the text is an input of the score. A null or empty text has the score of a text without known terms;
    repeated rows each give a row; an empty table gives an empty one; other columns are ignored.
    """
    spark = common.prepare(docs.sparkSession)
    shared = spark.sparkContext.broadcast(model)

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = _Known(shared.value.index)
        for pdf in batches:
            p = shared.value.score(active_terms(pdf["text"].tolist(), known))
            yield pd.DataFrame({"doc_id": pdf["doc_id"].astype("Int64"), "score": p})

    out = common.whole_texts(docs).mapInPandas(scan, "doc_id long, score double")
    return out.select("doc_id", (common.crc_mod(F.col("doc_id"), folds) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def reject(docs: DataFrame, model: Model) -> DataFrame:
    """The rows that the machine doesn't call toxic, with all their columns, as they are.

    Rows are judged one by one, so rows without an id or with a repeated one are, too; a null text is judged as an empty
    one. Nothing moves.
    """
    spark = common.prepare(docs.sparkSession)
    shared, at = spark.sparkContext.broadcast(model), docs.columns.index("text")

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.trim()
        known = _Known(shared.value.index)
        for batch in batches:
            p = shared.value.score(active_terms([t or "" for t in batch.column(at).to_pylist()], known))
            yield batch.filter(pa.array(p < 0.5))

    return docs.mapInArrow(keep, docs.schema)
