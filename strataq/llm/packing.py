"""Packing into sequences of fixed length: shortest-pack-first over the histogram of piece lengths."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import repeat
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strataq.llm import common

LENGTH = 2048
END_ID = 1
#: Words whose ids a worker keeps.
MOST_WORDS = 600_000
#: Characters of text whose pre-tokens a worker holds at a time, or one text if it is longer.
BLOCK_CHARS = 1 << 20
_SHIFT = np.int64(44)

# For texts that are of these characters only when lower-cased, pre-tokens can be found here and looked up one by one; all
# others, those with a letter from elsewhere whose lower case is among these characters, and those that hold a special
# token's string go to the library whole.
_FROM_ELSEWHERE = "\u1e9e\u212a\u212b\u2c7e\u2c7f"
_OTHER = re.compile("[^\t\n\r\x20-\x7e\xa1-ɏ]")
_PRETOKEN = re.compile("[a-zªµºß-öø-ɏ]+|'s|'t|'re|'ve|'m|'ll|'d|[0-9²³¹¼½¾]|[^\\sa-zªµºß-öø-ɏ0-9²³¹¼½¾]+")
_WORD_END = "</w>"


class WordTokenizer:
    """Ids of a tokenizer file whose words are encoded apart: each distinct word is encoded once and kept."""

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.lib = Tokenizer.from_file(path)
        self.lib.no_truncation()
        self.lib.no_padding()
        self.special = [t.content for t in self.lib.get_added_tokens_decoder().values()]
        size = self.lib.get_vocab_size()
        self.ends = np.zeros(size, dtype=bool)
        for token, i in self.lib.get_vocab().items():
            self.ends[i] = token.endswith(_WORD_END)
        self.reset()

    def reset(self) -> None:
        self.number: dict[str, int] = {}
        self.flat, self.start, self.size = np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def whole(self, text: str) -> np.ndarray:
        return np.array(self.lib.encode(text, add_special_tokens=False).ids, dtype=np.uint32)

    def _learn(self, missing: list[str]) -> None:
        """Encode new words in one text; each word ends where an id ends words. Odd ones are encoded alone."""
        ids = np.array(self.lib.encode(" ".join(missing), add_special_tokens=False).ids, dtype=np.uint32)
        stop = np.flatnonzero(self.ends[ids]) + 1
        if len(stop) != len(missing) or len(ids) and stop[-1] != len(ids):
            parts = [self.whole(w) for w in missing]
            ids = np.concatenate(parts)
            stop = np.cumsum([len(p) for p in parts])
        begin = np.concatenate([[0], stop[:-1]])
        self.start = np.concatenate([self.start, begin + len(self.flat)])
        self.size = np.concatenate([self.size, stop - begin])
        self.flat = np.concatenate([self.flat, ids])
        for w in missing:
            self.number[w] = len(self.number)

    def _pretokens(self, text: str) -> list[str] | None:
        low = text.lower()
        if _OTHER.search(low) or any(c in text for c in _FROM_ELSEWHERE) or "<|" in text and any(s in text for s in self.special):
            return None
        return _PRETOKEN.findall(low)

    def encode(self, texts: list[str]) -> Iterator[np.ndarray]:
        """Ids of each text. Texts are taken in blocks, as pre-tokens need many times the memory of their text."""
        first, size = 0, 0
        for i, t in enumerate(texts):
            if i > first and size + len(t) > BLOCK_CHARS:
                yield from self._encode(texts[first:i])
                first, size = i, 0
            size += len(t)
        yield from self._encode(texts[first:])

    def _encode(self, texts: list[str]) -> list[np.ndarray]:
        if len(self.number) > MOST_WORDS:
            self.reset()
        parts = [self._pretokens(t) for t in texts]
        found = [None if p is None else np.fromiter(map(self.number.get, p, repeat(-1)), np.int64, len(p)) for p in parts]
        new = [(p, w, np.flatnonzero(w < 0).tolist()) for p, w in zip(parts, found, strict=True) if p and w.min() < 0]
        missing = list(dict.fromkeys(p[k] for p, _, at in new for k in at))
        for i in range(0, len(missing), 50_000):
            self._learn(missing[i : i + 50_000])
        for p, w, at in new:
            w[at] = [self.number[p[k]] for k in at]
        out = []
        for t, words in zip(texts, found, strict=True):
            if words is None:
                out.append(self.whole(t))
                continue
            n = self.size[words]
            out.append(self.flat[np.repeat(self.start[words] - (np.cumsum(n) - n), n) + np.arange(n.sum())])
        return out


@lru_cache(maxsize=2)
def tokenizer(path: str) -> WordTokenizer:
    return WordTokenizer(path)


class Slot(NamedTuple):
    """Pieces of this length with ranks lo..hi-1 go to sequences base.. at offset."""

    length: int
    lo: int
    hi: int
    base: int
    offset: int


def pack(histogram: dict[int, int], length: int = LENGTH) -> list[Slot]:
    """Slots for all pieces of the histogram.

    Lengths are placed longest first. A pattern is a multiset of lengths with the number of sequences that
    have it; patterns are kept by how much they hold. As many pieces of a length as fit go to the patterns that
    hold least; a pattern of which only some sequences get one is split in two; what fits nowhere begins new ones.
    """
    held: dict[int, list[tuple[int, tuple[tuple[int, int], ...]]]] = {}  # used -> (sequences, runs of (length, times))
    for size in sorted(histogram, reverse=True):
        left = histogram[size]
        while left:
            used = min((u for u in held if u + size <= length), default=None)
            if used is None:
                per = 1
                held.setdefault(size, []).append((left, ((size, 1),)))
                left = 0
                continue
            count, runs = held[used].pop()
            if not held[used]:
                del held[used]
            take = min(left, count)
            if take < count:
                held.setdefault(used, []).append((count - take, runs))
            per = 1
            if runs[-1][0] == size:
                runs = (*runs[:-1], (size, runs[-1][1] + per))
            else:
                runs = (*runs, (size, per))
            held.setdefault(used + size, []).append((take, runs))
            left -= take
    slots, given, base = [], dict.fromkeys(histogram, 0), 0
    for used in sorted(held):
        for count, runs in held[used]:
            offset = 0
            for size, times in runs:
                for _ in range(times):
                    slots.append(Slot(size, given[size], given[size] + count, base, offset))
                    given[size] += count
                    offset += size
            base += count
    return slots


PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, part int, place long"


def cut(docs: DataFrame, path: str, length: int = LENGTH) -> DataFrame:
    """Each document's ids and END_ID, cut every `length` ids; place: the number of earlier pieces of that length in the same part."""
    common.prepare(docs.sparkSession)

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        common.trim()  # what stages before left in this worker
        tok, seen, part = tokenizer(path), np.zeros(length + 1, np.int64), TaskContext.get().partitionId()
        for pdf in batches:
            rows = []
            for doc_id, ids in zip(pdf["doc_id"], tok.encode(pdf["text"].tolist()), strict=True):
                ids = np.append(ids, np.uint32(END_ID)).astype("<u4")
                for a in range(0, len(ids), length):
                    own = ids[a : a + length]
                    rows.append((doc_id, a, len(own), zlib.crc32(own.tobytes()), len(ids), part, int(seen[len(own)])))
                    seen[len(own)] += 1
            out = pd.DataFrame(rows, columns=[x.split()[0] for x in PIECES.split(", ")])
            out["doc_id"] = out["doc_id"].astype("Int64")
            yield out

    return common.whole_texts(docs).mapInPandas(scan, PIECES)


def sequences(docs: DataFrame, path: str, length: int = LENGTH) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset for every piece of docs (doc_id, text).

    A null or empty text is END_ID alone. Repeated rows are packed each for itself; an empty table gives an
    empty one; other columns are ignored. Pieces are written once; their histogram (at most `length` rows) is
    packed on the driver, and a piece finds its place by its rank within its length: the pieces of that length in
    earlier parts, plus its place in its own. So no task holds all pieces of one length.
    """
    spark = common.prepare(docs.sparkSession)
    pieces = common.settle(cut(docs, path, length))
    counts = common.settle(pieces.groupBy("part", "length").count())
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("count").alias("n")).collect()}
    slots = sorted(pack(histogram, length))
    table = np.array(slots, dtype=np.int64).reshape(len(slots), 5)
    shared = spark.sparkContext.broadcast(((table[:, 0] << _SHIFT) + table[:, 1], table))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select("part", "length", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("earlier"))

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tokenizer.cache_clear()  # a worker of the first stage has no more use for it
        common.trim()
        keys, rows = shared.value
        for pdf in batches:
            rank = pdf["rank"].to_numpy(np.int64)
            own = rows[np.searchsorted(keys, (pdf["length"].to_numpy(np.int64) << _SHIFT) + rank, "right") - 1]
            pdf = pdf.drop(columns="rank")
            pdf["doc_id"] = pdf["doc_id"].astype("Int64")
            yield pdf.assign(sequence_id=own[:, 3] + rank - own[:, 1], offset=own[:, 4])

    ranked = pieces.join(base, ["part", "length"]).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", (F.col("earlier") + F.col("place")).alias("rank"))
    return ranked.mapInPandas(place, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
