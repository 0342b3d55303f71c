"""Removal of repeated passages with a sparse suffix array.

Not every suffix is indexed. Of the q-grams in each LENGTH-byte string the one with the smallest hash is its anchor
(the leftmost, if tied). Equal strings have equal anchors, at equal places, so the suffixes at anchors suffice, with
the LENGTH - Q bytes before them: about one suffix in sixteen. Anchors that
no other document has with the same HALF bytes on one side are dropped; the others are dealt by sampled splitters over their leading bytes, sorted in their bucket by multikey quicksort, and
compared with their neighbours. Equal strings have the same leading bytes at their anchor, so no group of equal
strings lies across a splitter. Leading bytes that very many runs have are split further: their runs are compared in
salted parts, and what is the first of its kind in a part is dealt again by all its bytes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strataq.llm import common

LENGTH, Q = 50, 20
WINDOW = LENGTH - Q + 1  # q-grams in a string
REACH = LENGTH - Q  # most bytes before the anchor
HALF = REACH // 2
#: Bytes of text that are hashed at a time, and that are gathered before anchors are handed on.
CHUNK, FLUSH = 2 << 20, 16 << 20
#: Bytes of text whose anchors one bucket compares; buckets grow with the input, not in size.
BUCKET_BYTES = 16 << 20
#: Runs with the same leading bytes that one task compares; more are split. Leads of that kind that are broadcast at most.
HOT_RUNS, MOST_LEADS = 8_000, 200_000
#: A text is known by so many bytes of its SHA-256: 96 bits.
IDENTITY = 12
_RNG = np.random.default_rng(20)
_BYTE = _RNG.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_P1 = np.uint64(0x9E3779B97F4A7C15)


class Runs(NamedTuple):
    """Runs of strings with one anchor: document number, anchor, first and last start (bytes of the document), hashes.

    left and right are hashes of the anchor with the HALF bytes before and after it, 0 where the text has fewer. A
    string with this anchor holds one of the two.
    """

    doc: np.ndarray
    anchor: np.ndarray
    first: np.ndarray
    last: np.ndarray
    hash: np.ndarray
    left: np.ndarray
    right: np.ndarray


def _power(n: int) -> np.uint64:
    return np.uint64(pow(int(_P1), n, 1 << 64))


def _mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(32))
    h *= np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(29))


def _grams(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the Q bytes and, unmixed, of the 16 bytes from each place on."""
    h = {1: _BYTE[data]}
    for n in (1, 2, 4, 8):
        h[2 * n] = h[n][:-n] * _power(n) + h[n][n:]
    return _mixed(h[16][: len(data) - Q + 1] * _power(4) + h[4][16 : len(data) - Q + 17]), h[16]


def anchors(texts: list[bytes]) -> Iterator[Runs]:
    """The runs of these texts, some at a time; texts longer than a chunk are taken in overlapping pieces."""
    held: list[tuple[int, int, bytes]] = []  # document, offset, bytes
    size = 0
    for i, t in enumerate(texts):
        for a in range(0, max(1, len(t) - LENGTH + 1), CHUNK):
            piece = t[a : a + CHUNK + LENGTH - 1]
            if len(piece) < LENGTH:
                continue
            held.append((i, a, piece))
            size += len(piece)
            if size >= CHUNK:
                yield _runs(held)
                held, size = [], 0
    if held:
        yield _runs(held)


def _runs(held: list[tuple[int, int, bytes]]) -> Runs:
    data = np.frombuffer(b"".join(p for _, _, p in held), dtype=np.uint8)
    sizes = np.array([len(p) for _, _, p in held])
    h, wide = _grams(data)
    low = (h & ~np.uint64(0xFFFFFF)) | np.arange(len(h), dtype=np.uint64)
    span = 1
    while span * 2 <= WINDOW:
        low = np.minimum(low[:-span], low[span:])
        span *= 2
    if span < WINDOW:
        low = np.minimum(low[: len(low) - (WINDOW - span)], low[WINDOW - span :])
    begin = np.cumsum(sizes) - sizes
    n = sizes - LENGTH + 1
    which = np.repeat(np.arange(len(held)), n)
    start = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + begin[which]
    at = (low[start] & np.uint64(0xFFFFFF)).astype(np.int64)
    new = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1]) | (which[1:] != which[:-1])]))
    end = np.concatenate([new[1:] - 1, [len(at) - 1]])
    piece = which[new]
    shift = np.array([a for _, a, _ in held])[piece] - begin[piece]
    p, a, z = at[new], start[new], start[end] + LENGTH  # the run's bytes are a..z
    left = _pair(h, wide, p, p - HALF, p - HALF >= a)
    right = _pair(h, wide, p, p + Q + HALF - 16, p + Q + HALF <= z)
    return Runs(np.array([i for i, _, _ in held])[piece], p + shift, a + shift, start[end] + shift, h[p], left, right)


def _pair(h: np.ndarray, wide: np.ndarray, p: np.ndarray, other: np.ndarray, whole: np.ndarray) -> np.ndarray:
    """Hash of the anchor with the 16 bytes at `other`, which overlap or touch it; 0 where no string of the run holds both."""
    out = _mixed(h[p] * _P1 + wide[np.where(whole, other, p)]) | np.uint64(1)
    return np.where(whole, out, np.uint64(0))


def _joined(parts: list[Runs]) -> Runs:
    return Runs(*(np.concatenate(x) for x in zip(*parts, strict=True)))


def _shared(key: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Whether each key other than 0 is in two documents or more."""
    order = np.argsort(key, kind="stable")
    k = key[order]
    new = np.concatenate([[True], k[1:] != k[:-1]])[: len(k)]
    group = np.cumsum(new) - 1
    d = doc[order]
    other = d != d[np.flatnonzero(new)][group]
    out = np.zeros(len(key), dtype=bool)
    out[order] = (np.bincount(group, other)[group] > 0) & (k != 0) if len(k) else False
    return out


_ARRAYS = ("docs", "idx", "left", "right", "low", "high", "left_marks", "right_marks")
_IDS = np.dtype([("high", ">u8"), ("low", ">u4")])


def _numbered(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct ids in order, and the number among them of each."""
    order = np.lexsort((ids["low"], ids["high"]))
    own = ids[order]
    new = np.concatenate([[True], (own["high"][1:] != own["high"][:-1]) | (own["low"][1:] != own["low"][:-1])])[: len(own)]
    number = np.empty(len(ids), np.int64)
    number[order] = np.cumsum(new) - 1
    return own[new], number
PROPOSED = "bucket int, sure boolean, " + ", ".join(f"{x} binary" for x in _ARRAYS)


def _propose(buckets: int):
    """Anchors of each part of the table by bucket.

    Those that two of the part's documents have are known to repeat: they are sent as such, to buckets in turn, and
    only one mark for each of their fingerprints goes to the bucket that compares it.
    """

    def row(bucket, sure, doc, left, right, pos, docs, marks=None):
        present, idx = np.unique(doc, return_inverse=True)
        none = np.zeros(0, np.uint32)
        arrays = (docs[present], idx.astype(np.uint16), left, right, (pos & 0xFFFF).astype(np.uint16), (pos >> 16).astype(np.uint16), *(marks or (none, none)))
        return (bucket, sure, *(x.tobytes() for x in arrays))

    def flush(ids: list[bytes], parts: list[Runs], turn: int) -> Iterator[pd.DataFrame]:
        r = _joined(parts)
        docs, none = np.frombuffer(b"".join(ids), _IDS), np.zeros(0, np.uint32)
        many = _shared(r.left, r.doc) | _shared(r.right, r.doc)
        pos, bucket = r.anchor.astype(np.uint32), (r.hash % np.uint64(buckets)).astype(np.int64)
        left, right = ((x >> np.uint64(32)).astype(np.uint32) | (x != 0).astype(np.uint32) for x in (r.left, r.right))
        marks = []
        for x in (left, right):
            keys = np.unique((bucket[many & (x != 0)].astype(np.uint64) << np.uint64(32)) | x[many & (x != 0)])
            at = np.searchsorted(keys >> np.uint64(32), np.arange(buckets + 1, dtype=np.uint64))
            marks.append((keys.astype(np.uint32), at))
        rows = []
        if many.any():
            rows.append(row(turn % buckets, True, r.doc[many], none, none, pos[many], docs))
        own = np.flatnonzero(~many)
        own = own[np.argsort(bucket[own], kind="stable")]
        edges = np.searchsorted(bucket[own], np.arange(buckets + 1))
        for b in range(buckets):
            i = own[edges[b] : edges[b + 1]]
            here = tuple(keys[at[b] : at[b + 1]] for keys, at in marks)
            if len(i) or len(here[0]) or len(here[1]):
                rows.append(row(b, False, r.doc[i], left[i], right[i], pos[i], docs, here))
        yield pd.DataFrame(rows, columns=["bucket", "sure", *_ARRAYS])

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        parts, size, turn = {}, 0, TaskContext.get().partitionId()
        for pdf in batches:
            for t in pdf["text"]:
                if len(t) * 4 < LENGTH or len(raw := t.encode()) < LENGTH or (content := hashlib.sha256(raw).digest()[:IDENTITY]) in parts:
                    continue  # of copies of a whole text one is enough
                parts[content] = raw
                size += len(raw)
                if size >= FLUSH or len(parts) >= 60_000:
                    yield from flush(list(parts), _all_runs(parts.values()), turn)
                    parts, size, turn = {}, 0, turn + 1
        if parts:
            yield from flush(list(parts), _all_runs(parts.values()), turn)

    return scan


def _all_runs(texts) -> list[Runs]:
    return list(anchors(list(texts)))


PACKED = "part int, ids binary, counts binary, pos binary"


def _repeating(parts: int):
    """One bucket: the places of the anchors of which a fingerprint is in two different texts or more.

    They are packed into a row for each part of the texts, so rows do not grow with documents times buckets.
    """
    return lambda pdf: _packed(*_repeats(pdf), parts)


def _packed(known: np.ndarray, doc: np.ndarray, pos: np.ndarray, parts: int) -> pd.DataFrame:
    """Identity, count and places of each text, a row a part; a part is a range of identities. doc: numbers among known, which are in order."""
    by = np.lexsort((pos, doc))
    doc, pos = doc[by], pos[by].astype(np.uint32)
    first = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]]))[: len(doc)]
    ids, at = known[doc[first]], np.append(first, len(doc))
    own = ((ids["high"].astype(np.uint64) >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)
    edges = np.searchsorted(own, np.arange(parts + 1, dtype=np.uint64))
    counts = np.diff(at).astype(np.uint32)
    rows = [(k, ids[a:z].tobytes(), counts[a:z].tobytes(), pos[at[a] : at[z]].tobytes()) for k, (a, z) in enumerate(zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)) if a < z]
    return pd.DataFrame(rows, columns=["part", "ids", "counts", "pos"])


def _unpacked(pdf: pd.DataFrame) -> pd.DataFrame:
    """One part of the texts: (content, all its places)."""
    ids, counts, pos = (np.frombuffer(b"".join(pdf[x]), t) for x, t in (("ids", _IDS), ("counts", np.uint32), ("pos", np.uint32)))
    known, number = _numbered(ids)
    doc = np.repeat(number, counts)
    by = np.argsort(doc, kind="stable")
    pos, at = pos[by], np.searchsorted(doc[by], np.arange(len(known) + 1)).tolist()
    return pd.DataFrame({"content": [x.tobytes() for x in known], "pos": [pos[a:z].tobytes() for a, z in zip(at[:-1], at[1:], strict=True)]})


def _repeats(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Identities of the bucket's texts; number among them and place of the anchors that repeat."""
    of = {"docs": _IDS, "idx": np.uint16, "low": np.uint16, "high": np.uint16}
    out, held, marks = [], [], ([], [])
    known, number = _numbered(np.frombuffer(b"".join(pdf["docs"]), _IDS))
    ends = np.cumsum(pdf["docs"].map(len).to_numpy() // IDENTITY)
    for r, end in zip(pdf.itertuples(), ends.tolist(), strict=True):
        x = {n: np.frombuffer(getattr(r, n), of.get(n, np.uint32)) for n in _ARRAYS}
        doc, pos = number[end - len(x["docs"]) : end][x["idx"]], x["low"].astype(np.uint32) | (x["high"].astype(np.uint32) << np.uint32(16))
        if r.sure:
            out.append((doc, pos))
        else:
            held.append((doc, pos, x["left"], x["right"]))
            marks[0].append(x["left_marks"])
            marks[1].append(x["right_marks"])
    if held:
        doc, pos, *sides = (np.concatenate(x) for x in zip(*held, strict=True))
        good = np.zeros(len(doc), dtype=bool)
        for side, own in zip(sides, marks, strict=True):
            mark = np.unique(np.concatenate(own))  # stands for a document that isn't here
            owner = np.concatenate([doc, np.full(len(mark), -1, np.int64)])
            good |= _shared(np.concatenate([side, mark]), owner)[: len(doc)]
        out.append((doc[good], pos[good]))
    return known, *(np.concatenate(x) for x in zip(*out, strict=True))


RUNS = "lead long, doc_id long, row long, first long, before int, strings int, bytes binary, sure boolean"


def _emit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The runs at repeating anchors with their bytes. Of equal runs in one batch only the smallest document's goes on; the others are removed for sure."""
    for pdf in batches:
        held: dict[bytes, tuple[int, tuple]] = {}
        rows = []
        texts = [t.encode() for t in pdf["text"]]
        keep = np.concatenate([(np.int64(i) << 32) + np.unique(np.frombuffer(x, np.uint32)) for i, x in enumerate(pdf["pos"])])
        ids, numbers = pdf["doc_id"].tolist(), pdf["row"].tolist()
        for r in anchors(texts):
            place = (r.doc.astype(np.int64) << 32) + r.anchor
            own = np.flatnonzero(keep[np.minimum(np.searchsorted(keep, place), len(keep) - 1)] == place)
            if len(own):
                for i, p, a, z in zip(*(x[own].tolist() for x in (r.doc, r.anchor, r.first, r.last)), strict=True):
                    raw, doc_id = texts[i], ids[i]
                    run = raw[a : z + LENGTH]
                    lead = int.from_bytes(raw[p : p + 8], "big") - (1 << 63)
                    row = (lead, doc_id, numbers[i], a, p - a, z - a + 1, run, False)
                    old = held.get(run)
                    if old is None:
                        held[run] = (doc_id, row)
                    elif old[0] == doc_id:
                        rows.append(row)
                    else:
                        lose, win = (old, (doc_id, row)) if doc_id < old[0] else ((doc_id, row), old)
                        rows.append((*lose[1][:6], b"", True))
                        held[run] = win
        rows += [x for _, x in held.values()]
        yield pd.DataFrame(rows, columns=[x.split()[0] for x in RUNS.split(", ")])


def multikey_groups(words: np.ndarray) -> np.ndarray:
    """Group numbers of equal rows, by multikey quicksort: sort by a word at a time, and go on only where rows still tie."""
    n = len(words)
    label, active = np.zeros(n, dtype=np.int64), np.arange(n)
    top = 0
    for j in range(words.shape[1]):
        if not len(active):
            break
        k, g = words[active, j], label[active]
        order = np.lexsort((k, g))
        k, g = k[order], g[order]
        new = np.concatenate([[True], (k[1:] != k[:-1]) | (g[1:] != g[:-1])])
        number = np.cumsum(new) - 1
        label[active[order]] = number + top
        top += number[-1] + 1
        active = active[order][np.bincount(number)[number] > 1]
    return label


HITS = "doc_id long, row long, first long, mask long, string binary"


def _by_lead(f: Callable[[pd.DataFrame], Iterator[pd.DataFrame]], keys: list[str]):
    """f over the rows of a task, which are sorted by keys: some whole keys at a time."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tail: list[pd.DataFrame] = []
        for pdf in batches:
            if not len(pdf):
                continue
            tail.append(pdf)
            last = pdf[keys].iloc[-1]
            if (tail[0][keys].iloc[0] == last).all() or sum(map(len, tail)) < 20_000:
                continue
            whole = pd.concat(tail, ignore_index=True)
            same = (whole[keys] == last).all(axis=1).to_numpy()
            cut = len(whole) - int(same.sum())  # the last key's rows are the last rows
            yield from f(whole.iloc[:cut])
            tail = [whole.iloc[cut:]]
        if tail:
            yield from f(pd.concat(tail, ignore_index=True))

    return run


def _bucket(pdf: pd.DataFrame) -> Iterator[pd.DataFrame]:
    """Which strings of each run are in a smaller document of these."""
    mask = np.zeros(len(pdf), np.int64)
    doc, before = pdf["doc_id"].to_numpy(np.int64), pdf["before"].to_numpy(np.int64)
    for back, valid, g, least, _ in _equal_strings(pdf, None):
        hit = valid[least[g] < doc[valid]]
        mask[hit] |= np.int64(1) << (before[hit] - back)
    some = np.flatnonzero(mask)
    yield pd.DataFrame({"doc_id": doc[some], "row": pdf["row"].to_numpy(np.int64)[some], "first": pdf["first"].to_numpy(np.int64)[some], "mask": mask[some], "string": None})


def _salted(pdf: pd.DataFrame) -> Iterator[pd.DataFrame]:
    """As _bucket, over parts of hot leads; and each string of a part once, with its smallest document, to be compared with the other parts'."""
    yield from _bucket(pdf)
    row, first, doc = (pdf[c].to_numpy(np.int64) for c in ("row", "first", "doc_id"))
    before = pdf["before"].to_numpy(np.int64)
    for back, valid, g, least, ctx in _equal_strings(pdf, 1):
        mine = np.flatnonzero(least[g] == doc[valid])
        one = valid[mine[np.unique(g[mine], return_index=True)[1]]]
        yield pd.DataFrame({"doc_id": doc[one], "row": row[one], "first": first[one], "mask": np.int64(1) << (before[one] - back), "string": [x.tobytes() for x in ctx[one, REACH - back : REACH - back + LENGTH]]})


def _equal_strings(pdf: pd.DataFrame, least_runs: int | None) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(back, runs, group of each run's string, smallest document of each group, bytes around all anchors) for the strings that begin `back` bytes before their anchor.

    Runs are only taken together with others of the same part, if there are parts. Without least_runs, strings that can't have an equal are left out.
    """
    n = len(pdf)
    if n < (least_runs or 2):
        return
    doc = pdf["doc_id"].to_numpy(np.int64)
    before = pdf["before"].to_numpy(np.int64)
    size = np.array([len(b) for b in pdf["bytes"]])
    flat = np.frombuffer(b"".join(pdf["bytes"]), np.uint8)
    wide = -(-(REACH + LENGTH) // 8) * 8
    ctx = np.zeros((n, wide), np.uint8)  # the anchor is at REACH
    row = np.repeat(np.arange(n), size)
    col = np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size) + np.repeat(REACH - before, size)
    ctx[row, col] = flat
    strings = size - LENGTH + 1
    words = _words(ctx[:, REACH : REACH + Q])
    if "salt" in pdf:
        words = np.column_stack([pdf["salt"].to_numpy(np.uint64), words])
    groups = multikey_groups(words)
    alone = np.bincount(groups)[groups] == 1 if least_runs is None else np.zeros(n, dtype=bool)
    for back in range(WINDOW):
        valid = np.flatnonzero(~alone & (back <= before) & (before - back < strings))
        if len(valid) < (least_runs or 2):
            continue
        g = multikey_groups(np.column_stack([groups[valid].astype(np.uint64), _words(ctx[valid, REACH - back : REACH - back + LENGTH])]))
        least = np.full(g.max() + 1, np.iinfo(np.int64).max)
        np.minimum.at(least, g, doc[valid])
        yield back, valid, g, least, ctx


def _hits(runs: DataFrame, parts: int) -> DataFrame:
    """row, first, mask: the strings of runs (lead, doc_id, row, first, before, bytes) that a smaller document has, too.

    A lead of more than HOT_RUNS runs goes to several tasks. Such leads are broadcast if there are MOST_LEADS at most, and joined by shuffle otherwise.
    """
    hot = common.settle(runs.groupBy("lead").agg(F.count("*").alias("n")).where(F.col("n") > HOT_RUNS).withColumnRenamed("lead", "hot"))
    many = hot.count()
    deal = lambda df: df.repartitionByRange(parts, "lead").sortWithinPartitions("lead")
    if not many:
        return deal(runs).mapInPandas(_by_lead(_bucket, ["lead"]), HITS).select("row", "first", "mask")
    side = F.broadcast(hot) if many <= MOST_LEADS else hot
    on = F.col("lead") == F.col("hot")
    usual = deal(runs.join(side, on, "left_anti")).mapInPandas(_by_lead(_bucket, ["lead"]), HITS)
    salt = F.pmod(F.xxhash64("doc_id"), F.ceil(F.col("n") / HOT_RUNS)).cast("int").alias("salt")
    salted = runs.join(side, on).select("lead", "doc_id", "row", "first", "before", "bytes", salt).repartition(parts, "lead", "salt").sortWithinPartitions("lead", "salt")
    parted = common.settle(salted.mapInPandas(_by_lead(_salted, ["lead", "salt"]), HITS), codec="zstd")
    found = usual.where("string is null").union(parted.where("string is null")).select("row", "first", "mask")
    left = parted.where("string is not null")
    again = left.withColumn("least", F.min("doc_id").over(Window.partitionBy("string"))).where("least < doc_id")  # a string has a row a part at most
    return found.union(again.select("row", "first", "mask"))


def _words(rows: np.ndarray) -> np.ndarray:
    pad = -rows.shape[1] % 8
    rows = np.ascontiguousarray(np.pad(rows, ((0, 0), (0, pad))))
    return rows.view(">u8").astype(np.uint64)


def _cut(keep_text: bool):
    """What is left of each text: its marked strings are spread to bytes for all hits at once, a bounded number at a time."""
    columns = ["n_removed", "n_spans", "kept_sha256", "kept"][: 3 + keep_text]

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bits = np.arange(WINDOW)
        for pdf in batches:
            rows = []
            for t, first, mask in zip(pdf["text"], pdf["first"], pdf["mask"], strict=True):
                raw = t.encode()
                edge = np.zeros(len(raw) + 1, np.int32)
                for i in range(0, len(first), 1 << 16):
                    hit, bit = np.nonzero((mask[i : i + (1 << 16), None] >> bits) & 1)
                    starts = first[i + hit] + bit
                    np.add.at(edge, starts, 1)
                    np.add.at(edge, starts + LENGTH, -1)
                gone = np.cumsum(edge)[:-1] > 0
                spans = int(gone[:1].sum()) + int((gone[1:] & ~gone[:-1]).sum())
                left = np.frombuffer(raw, np.uint8)[~gone].tobytes()
                rows.append((int(gone.sum()), spans, hashlib.sha256(left).hexdigest(), left)[: len(columns)])
            out = pd.DataFrame(rows, columns=columns)
            out.insert(0, "doc_id", pdf["doc_id"].array)
            out.insert(1, "content", pdf["content"].array)
            yield out

    return cut


def repeated(docs: DataFrame, keep_text: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 for every row of docs (doc_id, text).

    Each byte is removed that a LENGTH-byte string covers which also starts in a document with a smaller doc_id.
    A null text is empty; texts under LENGTH bytes lose nothing; rows with the same id, of one text or of several, are
    one document and never each other's reason; a row without an id is neither searched nor cut; an empty table gives an empty one; other
    columns are ignored. keep_text adds `kept`, the remaining bytes, null where nothing was removed.

    Copies of a whole text, after the first, go at once. What moves: about 12 bytes for each anchor, the texts once, the
    runs at anchors of two documents or more, and those texts that lose something.
    """
    spark = common.prepare(docs.sparkSession)
    texts = common.whole_texts(docs)
    known = texts.where("doc_id is not null")
    keyed = common.settle(texts.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), F.unhex(F.sha2("text", 256)).alias("sha")))
    first = common.settle(keyed.where("doc_id is not null").groupBy("sha").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n")))
    total, rows = keyed.agg(F.coalesce(F.sum("n_bytes"), F.lit(0)), F.count("*")).first()
    buckets = max(8, -(-total // BUCKET_BYTES))
    parts = max(buckets, int(spark.conf.get("spark.sql.shuffle.partitions")))

    proposed = known.select("text").mapInPandas(_propose(buckets), PROPOSED)
    found = proposed.groupBy("bucket").applyInPandas(_repeating(parts), PACKED)
    gathered = found.groupBy("part").applyInPandas(_unpacked, "content binary, pos binary")
    content = lambda sha: F.substring(sha, 1, IDENTITY)
    places = gathered.join(first.select(content("sha").alias("content"), F.col("rep").alias("doc_id")), "content")
    met = known.join(places.hint("shuffle_hash"), "doc_id").where(content(F.unhex(F.sha2("text", 256))) == F.col("content"))
    suspects = common.settle(met.select("doc_id", "content", F.monotonically_increasing_id().alias("row"), "text", "pos"), codec="zstd")
    runs = common.settle(suspects.select("doc_id", "row", "text", "pos").mapInPandas(_emit, RUNS), codec="zstd")
    certain = runs.where("sure").select("row", "first", F.expr("shiftleft(1L, strings) - 1").alias("mask"))
    hits = _hits(runs.where("not sure").drop("sure", "strings"), parts).union(certain).groupBy("row").agg(F.collect_list(F.struct("first", "mask")).alias("hits"))
    schema = "doc_id long, content binary, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * keep_text
    marked = suspects.select("doc_id", "content", "row", "text").join(hits, "row").select("doc_id", "content", "text", "hits.first", "hits.mask")
    cut = marked.mapInPandas(_cut(keep_text), schema).dropDuplicates(["doc_id", "content"])

    copy = (F.col("doc_id") > F.col("rep")) & (F.col("n_bytes") >= LENGTH)
    spread = F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")  # shorter than a digest
    out = common.join_groups(keyed, first, "sha", rows, spread).withColumn("content", content("sha")).join(cut, ["doc_id", "content"], "left")
    columns = [
        F.when(copy, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(copy, F.lit(1)).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(copy, F.lit(hashlib.sha256(b"").hexdigest())).otherwise(F.coalesce("kept_sha256", F.lower(F.hex("sha")))).alias("kept_sha256"),
    ]
    return out.select("doc_id", "n_bytes", *columns, *([F.when(copy, F.lit(b"")).otherwise(F.col("kept")).alias("kept")] if keep_text else []))
