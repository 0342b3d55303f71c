"""Benchmark decontamination with suffix arrays over shards of the training text.

Every batch of documents is one or more shards. A shard's words become numbers of the test vocabulary (0: a word that
no test item has, which no match can cross), its suffixes that can match at all are sorted by their first 13 words (or
all of a shorter item), and every suffix of the test set is binary-searched among them. Each place that is found is
extended, word by word, to the longest match with that item. Documents never move, so one very common passage costs
no skew.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import reduce
from itertools import repeat
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataq.llm import common

WINDOW = 13
#: Bytes of test text that are searched for at a time; a larger test set is taken in blocks of about this size.
BLOCK_BYTES = 8 << 20
#: Bytes of training text in one shard.
SHARD_BYTES = 8 << 20


def words(text: str) -> list[bytes]:
    return text.encode().translate(common.ALNUM).split()


class Suffixes(NamedTuple):
    """Test suffixes of one length: the distinct ones, sorted, and the places of the k-th: places[at[k]:at[k + 1]]."""

    keys: np.ndarray
    at: np.ndarray
    places: np.ndarray


class TestSet:
    """One block of test items (item_id, number of its first word, words) as arrays; built once, on the driver."""

    __test__ = False

    def __init__(self, items: list[tuple[str, int, list[bytes]]], window: int = WINDOW):
        self.vocabulary: dict[bytes, int] = {}
        self.names = [item for item, _, _ in items]
        self.first = np.array([first for _, first, _ in items], dtype=np.int64)
        sizes = np.array([len(w) for _, _, w in items], dtype=np.int64)
        self.end = np.cumsum(sizes)
        self.begin = self.end - sizes
        number = self.vocabulary.setdefault
        self.words = np.array([number(w, len(self.vocabulary) + 1) for _, _, ws in items for w in ws], dtype=np.uint32)
        self.suffixes: dict[int, Suffixes] = {}
        length = np.minimum(sizes, window)
        for n in np.unique(length[length > 0]).tolist():
            own = np.flatnonzero(length == n)
            count = sizes[own] - n + 1
            places = np.repeat(self.begin[own] - (np.cumsum(count) - count), count) + np.arange(count.sum())
            rows = self.words[places[:, None] + np.arange(n)]
            order = np.lexsort(rows.T[::-1])
            rows, places = rows[order], places[order]
            new = np.flatnonzero(np.concatenate([[True], (rows[1:] != rows[:-1]).any(1)]))
            self.suffixes[n] = Suffixes(_strings(rows[new]), np.append(new, len(places)), places)

    def item(self, places: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.begin, places, "right") - 1


def _strings(rows: np.ndarray) -> np.ndarray:
    """Rows of word numbers as Unicode arrays, which numpy sorts and compares by number."""
    return np.ascontiguousarray(rows.astype("=u4")).view(f"<U{rows.shape[1]}").ravel()


def search(shard: np.ndarray, tests: TestSet) -> Iterator[tuple[np.ndarray, int, np.ndarray]]:
    """(start positions, length, places in the test set) of every test suffix that the shard's suffix array holds."""
    gap = np.flatnonzero(np.concatenate([shard == 0, [True]]))
    run = gap[np.searchsorted(gap, np.arange(len(shard)))] - np.arange(len(shard))  # words before the next gap
    for n, (keys, at, places) in tests.suffixes.items():
        starts = np.flatnonzero(run >= n)
        if not len(starts):
            continue
        rows = shard[starts[:, None] + np.arange(n)]
        order = np.lexsort(rows.T[::-1])
        starts, array = starts[order], _strings(rows[order])
        lo, hi = np.searchsorted(array, keys, "left"), np.searchsorted(array, keys, "right")
        for k in np.flatnonzero(hi > lo):
            yield starts[lo[k] : hi[k]], n, places[at[k] : at[k + 1]]


def longest(text: np.ndarray, tests: TestSet, item: int, found: dict[int, tuple[int, np.ndarray]]) -> list[tuple[int, int, int]]:
    """(item_start, start, length) of the matches with one item, from (length, places) of the windows found at each start.

    From the left, each is the longest that begins at its start; windows inside it begin none of their own.
    """
    out, done = [], 0
    for start in sorted(found):
        n, places = found[start]
        if start + n <= done:
            continue
        while start + n < len(text):
            more = places[places + n < tests.end[item]]
            more = more[tests.words[more + n] == text[start + n]]
            if not len(more):
                break
            n, places = n + 1, more
        out.append((int(places[0] - tests.begin[item] + tests.first[item]), start, n))
        done = start + n
    return out


class Found(NamedTuple):
    n_words: int
    n_hit: int
    items: list[str]
    matches: list[dict]


def shard_matches(texts: list[str], tests: TestSet) -> list[Found]:
    """What the test set has in each of these texts, which make up one shard."""
    parts = [words(t) for t in texts]
    n = np.array([len(p) for p in parts], dtype=np.int64)
    begin = np.concatenate([[0], np.cumsum(n + 1)])  # a gap after each document
    shard = np.zeros(begin[-1], dtype=np.uint32)
    for p, at in zip(parts, begin, strict=False):
        shard[at : at + len(p)] = np.fromiter(map(tests.vocabulary.get, p, repeat(0)), dtype=np.uint32, count=len(p))
    found: list[dict[int, dict[int, tuple[int, np.ndarray]]]] = [{} for _ in texts]
    for starts, length, places in search(shard, tests):
        doc = np.searchsorted(begin, starts, "right") - 1
        item = tests.item(places)
        edge = np.flatnonzero(np.concatenate([[True], item[1:] != item[:-1], [True]]))
        for a, b in zip(edge[:-1], edge[1:], strict=True):  # places are sorted, so those of one item lie together
            for d, s in zip(doc.tolist(), (starts - begin[doc]).tolist(), strict=True):
                found[d].setdefault(int(item[a]), {})[s] = (length, places[a:b])
    out = []
    for d, of_item in enumerate(found):
        matches = [
            {"item": tests.names[i], "item_start": a, "start": s, "length": k}
            for i, at in of_item.items()
            for a, s, k in longest(shard[begin[d] : begin[d] + n[d]], tests, i, at)
        ]
        matches.sort(key=lambda m: (m["start"], m["item"], m["item_start"]))
        hit = np.zeros(n[d] + 1, dtype=np.int32)
        for m in matches:
            hit[m["start"]] += 1
            hit[m["start"] + m["length"]] -= 1
        out.append(Found(int(n[d]), int((np.cumsum(hit) > 0).sum()), sorted({m["item"] for m in matches}), matches))
    return out


def _shards(texts: list[str]) -> Iterator[tuple[int, int]]:
    size, first = 0, 0
    for i, t in enumerate(texts):
        size += len(t)
        if size > SHARD_BYTES or i == len(texts) - 1:
            yield first, i + 1
            size, first = 0, i + 1


def _scan(texts: list[str], tests: TestSet) -> list[Found]:
    return [f for a, b in _shards(texts) for f in shard_matches(texts[a:b], tests)]


PIECE_WORDS = 200_000


def _blocks(benchmark: DataFrame, window: int, block_bytes: int) -> Iterator[TestSet]:
    """The test set as built blocks of about block_bytes of text. An item longer than PIECE_WORDS is cut into pieces that overlap by window - 1 words."""
    tests = benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.coalesce("text", F.lit("")).alias("text"))

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for item, text in zip(pdf["item_id"], pdf["text"], strict=True):
                w = words(text)
                for a in range(0, max(1, len(w) - window + 1), PIECE_WORDS):
                    rows.append((item or "", a, b" ".join(w[a : a + PIECE_WORDS + window - 1])))
            yield pd.DataFrame(rows, columns=["item", "first", "raw"])

    pieces = common.settle(tests.mapInPandas(cut, "item string, first long, raw binary").where("octet_length(raw) > 0"))
    total = pieces.agg(F.sum(F.octet_length("raw"))).first()[0] or 0
    n = max(1, -(-total // block_bytes))
    for b in range(n):
        rows = pieces.where(F.pmod(F.xxhash64("item", "first"), F.lit(n)) == b).collect()  # bounded by block_bytes
        yield TestSet([(r["item"], r["first"], bytes(r["raw"]).split()) for r in sorted(rows)], window)
    common.discard(pieces)


MATCH = "struct<item string, item_start long, start long, length long>"
RESULT = f"doc_id long, n_words long, n_hit long, items array<string>, matches array<{MATCH}>"


def match(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, n_words, n_hit, items and matches (item, item_start, start, length; in words) for every row of docs.

    Each match is verbatim in the document and in its item, and the longest that begins at its start; windows inside
    a match with the same item begin none. The test set is taken in blocks of about block_bytes, built on the driver and
    broadcast one by one; with more than one the documents are read once for each, and only rows with matches meet.
    A null text, in either table, has no words; an item without words matches nothing; repeated items and rows count
    each for itself; a row without an id is compared like any other; empty tables give no rows, or rows without hits.
    Other columns are ignored.
    """
    spark = common.prepare(docs.sparkSession)
    texts = common.whole_texts(docs)

    def scan(shared, key: bool, every: bool) -> Callable:
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                found = _scan(pdf["text"].tolist(), shared.value)
                out = pd.DataFrame(found, columns=Found._fields)
                out.insert(0, "doc_id", pdf["doc_id"].astype("Int64").array)
                if key:
                    out["content"] = [hashlib.sha256(t.encode()).digest() for t in pdf["text"]]
                yield out if every else out[out["n_hit"] > 0]

        return run

    blocks = [spark.sparkContext.broadcast(b) for b in _blocks(benchmark, window, block_bytes)]
    if len(blocks) == 1:
        return texts.mapInPandas(scan(blocks[0], False, True), RESULT)
    keyed = f"{RESULT}, content binary"
    rest = reduce(DataFrame.union, [texts.mapInPandas(scan(b, True, False), keyed) for b in blocks[1:]])
    rest = rest.dropDuplicates(["doc_id", "content", "matches"]).groupBy("doc_id", "content").agg(F.flatten(F.collect_list("matches")).alias("more"))
    base = texts.mapInPandas(scan(blocks[0], True, True), keyed)
    on = base["doc_id"].eqNullSafe(rest["doc_id"]) & (base["content"] == rest["content"])
    joined = base.join(rest, on, "left").select(base["doc_id"], "n_words", F.array_sort(F.concat("matches", F.coalesce("more", F.array().cast(f"array<{MATCH}>")))).alias("found"))
    order = F.array_sort(F.transform("found", lambda m: F.struct(m["start"], m["item"], m["item_start"], m["length"])))
    matches = F.transform(order, lambda m: F.struct(m["item"], m["item_start"], m["start"], m["length"])).cast(f"array<{MATCH}>")
    joined = joined.select("doc_id", "n_words", matches.alias("matches"))
    covered = F.aggregate(
        "matches",
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("end")),
        lambda s, m: F.struct(
            (s["n"] + F.greatest(F.lit(0).cast("long"), m["start"] + m["length"] - F.greatest(s["end"], m["start"]))).alias("n"),
            F.greatest(s["end"], m["start"] + m["length"]).alias("end"),
        ),
        lambda s: s["n"],
    )
    return joined.select("doc_id", "n_words", covered.alias("n_hit"), F.array_sort(F.array_distinct(F.transform("matches", lambda m: m["item"]))).alias("items"), "matches")


def digest(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The query's columns."""
    return match(docs, benchmark).select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"),
        ((F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"),
    )


def remove(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The documents in which no window of the benchmark occurs, with all their columns, as they are.

    One occurrence is enough to go, however long the document is. Rows are judged one by one, so rows without an id and
    rows that repeat an id are, too; a null text stays. Nothing moves: each block of the test set filters in place.
    """
    spark = common.prepare(docs.sparkSession)
    out = docs
    for tests in _blocks(benchmark, window, block_bytes):
        shared = spark.sparkContext.broadcast(tests)

        def keep(batches: Iterator[pa.RecordBatch], shared=shared, at=docs.columns.index("text")) -> Iterator[pa.RecordBatch]:
            common.trim()
            for batch in batches:
                texts = [t or "" for t in batch.column(at).to_pylist()]
                yield batch.filter(pa.array([not f.n_hit for f in _scan(texts, shared.value)], pa.bool_()))

        out = out.mapInArrow(keep, docs.schema)
    return out


ORACLE = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bl AS (SELECT item_id, w, least(13, len(w)) AS n FROM b WHERE len(w) > 0),
bw AS (SELECT DISTINCT item_id, n, array_to_string(list_slice(w, i, i + n - 1), ' ') AS g FROM (SELECT item_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM bl)),
ns AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT doc_id, n, i, array_to_string(list_slice(w, i, i + n - 1), ' ') AS g FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d CROSS JOIN ns WHERE len(w) >= n)),
m AS (SELECT dw.doc_id, dw.i, dw.n, bw.item_id FROM dw JOIN bw ON dw.n = bw.n AND dw.g = bw.g),
h AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT doc_id, i, n FROM m)) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS items FROM (SELECT DISTINCT doc_id, item_id FROM m) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN t USING (doc_id)
"""
