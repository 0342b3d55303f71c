"""Near-duplicates from bottom-k sketches with one hash function.

Inverted lists of the retained values generate overlaps, the sketch of a pair's union estimates its similarity,
and the full shingle sets confirm it. Documents with equal sets are one class from the start.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataq.llm import common
from strataq.llm.components import connected

#: Values that a sketch retains, and how many of the union's K must be shared. A pair at a similarity of 0.8 shares
#: 51.2 of 64 on average, 34 or more with a probability over 1 - 1e-6.
K, SHARED = 64, 34
#: A longer sketch of the listed documents, as 32-bit values, decides which pairs of a list are worth confirming: 170
#: of 256 at least, 204.8 on average at 0.8. Sets that it holds whole are compared exactly.
BRIEF, BRIEF_SHARED = 256, 170
WIDTH, PERCENT = 5, 80
_P = np.uint64(0x9E3779B97F4A7C15)


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        out = self[word] = xxhash.xxh3_64_intdigest(word)
        return out


def _mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(29))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(32))


def shingles(text: str, width: int, hashes: dict) -> np.ndarray:
    """The text's distinct shingles as sorted signed 64-bit hashes; fewer words than width are one shingle."""
    words = text.encode().lower().split()
    w = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    if not len(w):
        return w.view(np.int64)
    wide = min(width, len(w))
    h = w[: len(w) - wide + 1]
    for i in range(1, wide):
        h = h * _P + w[i : len(w) - wide + 1 + i]
    return np.unique(_mix(h + np.uint64(wide)).view(np.int64))


def _scan(docs: DataFrame, schema: str, row, width: int) -> DataFrame:
    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        common.trim()
        hashes = _Hashes()
        for pdf in batches:
            if len(hashes) > 400_000:
                hashes.clear()
            rows = [row(shingles(t, width, hashes)) for t in pdf["text"]]
            out = pd.DataFrame(rows, columns=[x.split()[0] for x in schema.split(", ")][1:])
            out.insert(0, "doc_id", pdf["doc_id"].astype("Int64").array)
            yield out

    return docs.mapInPandas(scan, schema)


def sketches(docs: DataFrame, width: int = WIDTH, k: int = K) -> DataFrame:
    """doc_id, n, digest (of the whole set), sketch (the k smallest hashes) of (doc_id, text)."""

    def row(s: np.ndarray) -> tuple:
        return len(s), xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None, s[:k]

    return _scan(docs, "doc_id long, n long, digest binary, sketch array<long>", row, width)


def _estimate(x: str, y: str, percent: int):
    """Whether the sketch of a pair's union has enough values of both; for sets that the sketches hold whole, whether they are similar.

    A value that is among the union's BRIEF smallest and in both sets is in both sketches. Two values of a set may agree in
    their 32 bits, so whole sets get the benefit of one more.
    """
    a, b, n_a, n_b = (F.col(f"{c}_{s}") for c in ("brief", "n") for s in (x, y))
    both = F.size(F.array_intersect(a, b)) + 1
    whole = (n_a <= BRIEF) & (n_b <= BRIEF)
    exact = 100 * both >= percent * (n_a + n_b - both)
    return F.when(whole, exact).otherwise(both >= F.least(F.lit(BRIEF_SHARED), F.ceil(F.least(n_a, n_b) * percent / 100)))


#: Lists up to this size are compared by a join, longer ones in blocks of about BLOCK documents on either side.
SHORT_LIST, BLOCK = 64, 1000
#: In blocks, documents come with their LONG smallest hashes: sets up to that size are compared in full there, of larger
#: ones 750 of the union's 1024 at least, 819.2 on average at 0.8.
LONG, LONG_SHARED = 1024, 750


def _in_blocks(lists: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of different components in one list; a task holds two blocks of a list, whatever its length.

    Of the pairs whose whole sets are similar, those that make a spanning forest of the components they connect;
    of pairs with a larger set, all that the estimate passes and that the forest leaves apart.
    """
    n_blocks = F.ceil(F.col("size") / BLOCK).cast("int")
    dealt = lists.withColumn("nb", n_blocks).withColumn("own", F.pmod(F.xxhash64("doc_id"), F.col("nb")).cast("int"))
    dealt = dealt.select("value", "doc_id", "n", "c", "held", "own", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)).alias("other"))
    keyed = dealt.select("value", "doc_id", "n", "c", "held", "own", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))
    return keyed.groupBy("value", "i", "j").applyInPandas(lambda pdf: _block(pdf, percent), "a long, b long")


def _block(pdf: pd.DataFrame, percent: int) -> pd.DataFrame:
    i, j = int(pdf["i"].iloc[0]), int(pdf["j"].iloc[0])
    own = pdf["own"].to_numpy()
    x, y = np.flatnonzero(own == i), np.flatnonzero(own == j)
    size = np.array([len(b) for b in pdf["held"]])
    _, column, seen = np.unique(np.concatenate(pdf["held"].to_numpy()), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(len(pdf)), size)
    shared = seen[column] > 1
    row, column = row[shared], (np.cumsum(seen > 1) - 1)[column[shared]]
    both = np.zeros((len(x), len(y)), np.float32)
    for at in range(0, int((seen > 1).sum()), 2048):
        part = (column >= at) & (column < at + 2048)
        held = np.zeros((len(pdf), 2048), np.float32)
        held[row[part], column[part] - at] = 1
        both += held[x] @ held[y].T
    n, c, ids = (pdf[k].to_numpy(np.int64) for k in ("n", "c", "doc_id"))
    low, high = np.minimum(n[x][:, None], n[y][None]), np.maximum(n[x][:, None], n[y][None])
    whole = high <= LONG
    similar = 100 * both >= percent * (low + high - both)
    near = np.where(whole, similar, both >= np.minimum(LONG_SHARED, np.ceil(low * percent / 100)))
    near &= (c[x][:, None] != c[y][None]) & (100 * low >= percent * high)
    sure, open_ = ((x[p], y[q]) for p, q in (np.nonzero(near & whole), np.nonzero(near & ~whole)))
    root: dict[int, int] = {}
    pairs = [(u, v) for u, v in zip(*sure) if _join(root, c[u], c[v])]
    pairs += [(u, v) for u, v in zip(*open_) if _root(root, c[u]) != _root(root, c[v])]
    a, b = ids[np.array(pairs, np.int64).reshape(-1, 2)].T
    return pd.DataFrame({"a": np.minimum(a, b), "b": np.maximum(a, b)}).drop_duplicates()


def _root(root: dict[int, int], k: int) -> int:
    while root.setdefault(k, k) != k:
        root[k] = k = root[root[k]]
    return k


def _join(root: dict[int, int], u: int, v: int) -> bool:
    """Whether u and v were apart; they are together from now on."""
    u, v = _root(root, u), _root(root, v)
    root[max(u, v)] = min(u, v)
    return u != v


def confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that the full sets confirm; pairs are settled. The set of a document in very many pairs goes to several tasks."""
    side = lambda t, x, c: t.select(F.col("doc_id").alias(x), F.col(c).alias(f"{c}_{x}"))
    full = common.join_salted(pairs, side(sets, "a", "all"), "a", "b").join(side(sets, "b", "all"), "b")
    counted = full.select("a", "b", F.size(F.array_intersect("all_a", "all_b")).alias("i"), (F.size("all_a") + F.size("all_b")).alias("s"))
    return counted.where(100 * F.col("i") >= percent * (F.col("s") - F.col("i"))).select("a", "b")


def groups(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT, k: int = K, shared: int = SHARED) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of docs (doc_id, text).

    Two documents are linked if 100 * intersection >= percent * union of their sets of distinct shingles.
    A null or empty text, or one without words, has an empty set and is linked with nothing. Repeated rows
    each give a row and belong together; an empty table gives an empty one; a row without an id is in no component
    and kept; other columns are ignored.

    Values in one sketch only can't be shared, and a document with too few others has no partner. Of the rest, a
    document is listed under its rarest, so that each possible pair meets in a list. First all of a list are
    compared with the one whose values are the most common. What then lies in one component needs no further
    comparison; all pairs of different components in a list are compared in a second round. No list is cut. A pair
    leaves a list only if the estimate from longer sketches passes it; of long lists, similar sets that these hold
    whole leave as a spanning forest. The full sets confirm all of them. Digests that many documents have, and documents
    that meet very many, are dealt over several tasks.
    """
    common.prepare(docs.sparkSession)
    texts = common.whole_texts(docs)
    base = common.settle(sketches(texts, width, k))
    some = base.where("n > 0 and doc_id is not null")
    classes = common.settle(some.groupBy("digest").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n")))
    rows = classes.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    ids = some.select("doc_id", "digest")
    member = common.join_groups(ids, classes, "digest", rows, F.col("doc_id").cast("string").cast("binary")).select("doc_id", "rep").distinct()
    first = common.settle(some.join(member.where("doc_id = rep").select("doc_id"), "doc_id", "left_semi").select("doc_id", "n", "sketch").dropDuplicates(["doc_id"]))
    posted = first.select("doc_id", "n", F.explode("sketch").alias("value"))
    often = posted.groupBy("value").count().where("count > 1")
    least = F.least(F.lit(shared), F.ceil(F.col("n") * percent / 100)).cast("int")
    found = posted.join(often, "value").groupBy("doc_id", "n").agg(F.sort_array(F.collect_list(F.struct("count", "value"))).alias("values"))
    common_ = F.aggregate("values", F.lit(0).cast("long"), lambda s, v: s + v["count"]).alias("shares")
    listed = found.where(F.size("values") >= least).select("doc_id", "n", common_, F.explode(F.slice("values", F.lit(1), F.size("values") - least + 1)).alias("x")).select("doc_id", "n", "shares", "x.value")
    listed = common.settle(listed)
    wanted = listed.select("doc_id").distinct()
    row = lambda s: ((s[:BRIEF] >> 32).astype(np.int32), s)
    sets = common.settle(_scan(texts.join(wanted.hint("shuffle_hash"), "doc_id"), "doc_id long, brief array<int>, all array<long>", row, width).dropDuplicates(["doc_id"]))
    brief = sets.select("doc_id", "brief")
    side = lambda t, x: t.select("value", *[F.col(c).alias(f"{c}_{x}") for c in t.columns if c != "value"])
    fits = (100 * F.least("n_x", "n_y") >= percent * F.greatest("n_x", "n_y")) & _estimate("x", "y", percent)
    picked = lambda df: df.select(F.least("doc_id_x", "doc_id_y").alias("a"), F.greatest("doc_id_x", "doc_id_y").alias("b")).distinct()

    hub = listed.groupBy("value").agg(F.max_by("doc_id", F.struct("shares", -F.col("doc_id"))).alias("hub"))
    spokes = common.settle(listed.join(hub, "value").where("doc_id <> hub").select(F.col("hub").alias("doc_id_x"), F.col("doc_id").alias("doc_id_y"), F.col("n").alias("n_y")).distinct())
    size = listed.select(F.col("doc_id").alias("doc_id_x"), F.col("n").alias("n_x")).distinct()
    of = lambda x: brief.select(F.col("doc_id").alias(f"doc_id_{x}"), F.col("brief").alias(f"brief_{x}"))
    near = common.settle(picked(common.join_salted(spokes, size.join(of("x"), "doc_id_x"), "doc_id_x", "doc_id_y").join(of("y"), "doc_id_y").where(fits)))
    links = common.settle(confirm(near, sets, percent))
    common.discard(spokes, near)
    reached = connected(links)

    labelled = common.settle(
        listed.join(hub, "value").join(reached.select(F.col("node").alias("doc_id"), "component"), "doc_id", "left").select("value", "doc_id", "n", "hub", F.coalesce("component", "doc_id").alias("c"))
    )
    mixed = labelled.groupBy("value").agg(F.min("c").alias("lo"), F.max("c").alias("hi"), F.count("*").alias("size")).where("lo < hi").select("value", "size")
    open_ = common.settle(labelled.join(mixed, "value").where("doc_id <> hub").select("value", "doc_id", "n", "c", "size"))
    few = common.settle(open_.where(F.col("size") <= SHORT_LIST).drop("size").join(brief, "doc_id"))
    many = open_.where(F.col("size") > SHORT_LIST).join(sets.select("doc_id", F.slice("all", 1, LONG).alias("held")), "doc_id")
    apart = (F.col("c_x") != F.col("c_y")) & (F.col("doc_id_x") < F.col("doc_id_y"))
    rest = picked(side(few, "x").join(side(few, "y"), "value").where(apart & fits)).union(_in_blocks(many, percent)).distinct()
    rest = common.settle(rest)
    reached = connected(links.union(confirm(rest, sets, percent)))
    common.discard(first, listed, sets, links, labelled, open_, few, rest)

    of_member = member.join(reached.select(F.col("node").alias("rep"), "component"), "rep", "left").select("doc_id", F.coalesce("component", "rep").alias("component_id"))
    out = base.select("doc_id", F.col("n").alias("n_shingles")).join(of_member.groupBy("doc_id").agg(F.min("component_id").alias("component_id")), "doc_id", "left")
    component = F.coalesce("component_id", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def deduplicate(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """One document of each group, with all its columns; rows without an id stay."""
    gone = groups(docs, width, percent).where("not kept").select("doc_id")
    return docs.join(gone, "doc_id", "left_anti")
