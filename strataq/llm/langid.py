"""Language identification with interpolated Kneser-Ney models of characters, one for each language.

N-grams stay within words: each word is scored from its start mark to its end mark. A language's n-grams are
kept as sorted arrays of hashed keys with their probabilities, and found by binary search. How improbable a text may
be before it is rejected is calibrated, for each language, on texts that a second model of it hasn't seen.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator
from functools import reduce
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataq.llm import common

ORDER = 4
#: N-grams over all languages up to which models are broadcast; larger ones stay in the shared folder and are joined. Both keep all.
BROADCAST_GRAMS = 2_000_000
#: Characters of text that are looked up together in stored models; a longer text is a chunk of its own.
CHUNK_CHARS = 1 << 21
#: One in so many training texts calibrates rejection, and this share of them is within a language's limit.
CALIBRATE, WITHIN = 16, 0.995
#: Texts from which a language has a limit of its own; others share that of all languages together.
LEAST_TEXTS = 200
_WORD = re.compile(r"[^\W\d_]+")
_START, _END = "\x02" * (ORDER - 1), "\x03"
UNKNOWN = 1e-5


def words(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def _codes(text: str) -> np.ndarray:
    """16 bits a character. Those beyond are hashed to the codes of surrogates and private use, which no letter has: none is taken for another script's."""
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    wide = c > 0xFFFF
    if wide.any():
        c[wide] = np.uint64(0xD800) + (c[wide] * np.uint64(0x9E3779B1) >> np.uint64(7)) % np.uint64(0x2100)
    return c


def grams(vocabulary: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The 64-bit keys of all n-grams of these words, 16 bits a character, and how many each word has."""
    n = np.array([len(w) + 1 for w in vocabulary], dtype=np.int64)
    c = _codes("".join(_START + w + _END for w in vocabulary))
    keys = c.copy()
    for back in range(1, ORDER):
        keys[back:] |= c[:-back] << np.uint64(16 * back)
    ends = np.cumsum(n + ORDER - 1)
    at = np.repeat(ends - n, n) + _ramp(n)
    return keys[at], n


def _ramp(n: np.ndarray) -> np.ndarray:
    """0..n[0]-1, 0..n[1]-1, ..."""
    return np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)


def _low(keys: np.ndarray, n: int) -> np.ndarray:
    """The last n characters of each key."""
    return keys & np.uint64((1 << (16 * n)) - 1) if n < 4 else keys


class Level(NamedTuple):
    keys: np.ndarray
    p: np.ndarray
    contexts: np.ndarray
    backoff: np.ndarray


class Language(NamedTuple):
    """entropy and spread: of a character, as the model's own n-grams have it, until calibrated.

    A text of n characters is rejected if its entropy lies more than limit times sqrt(spread^2 / n + wander^2) above.
    """

    name: str
    levels: list[Level]  # from one character to ORDER
    entropy: float
    spread: float
    wander: float = 0.0
    limit: float = 6.0

    def rejects(self, entropy: float, size: int) -> bool:
        return bool(entropy > self.entropy + self.limit * (self.spread**2 / size + self.wander**2) ** 0.5)

    def probability(self, keys: np.ndarray) -> np.ndarray:
        p = np.full(len(keys), UNKNOWN)
        for n, level in enumerate(self.levels, 1):
            if n > 1:
                back, seen = _find(level.contexts, level.backoff, _low(keys, n) >> np.uint64(16))
                p = np.where(seen, back * p, p)
            own, seen = _find(level.keys, level.p, _low(keys, n))
            p = np.where(seen, own, p)
        return p


def _find(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(keys):
        return np.ones(len(wanted)), np.zeros(len(wanted), dtype=bool)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return values[at], keys[at] == wanted


def fit(name: str, keys: np.ndarray, counts: np.ndarray) -> Language:
    """Interpolated Kneser-Ney from the counts of the longest n-grams; shorter ones count distinct continuations."""
    order = np.argsort(keys)
    top_keys, top_counts = keys[order], counts[order].astype(float)
    at_level = {ORDER: (top_keys, top_counts)}
    for n in range(ORDER - 1, 0, -1):
        at_level[n] = tuple(np.unique(_low(at_level[n + 1][0], n), return_counts=True))
    levels: list[Level] = []
    for n in range(1, ORDER + 1):
        k, c = at_level[n][0], at_level[n][1].astype(float)
        once, twice = (c == 1).sum(), (c == 2).sum()
        discount = once / (once + 2 * twice) if once and twice else 0.5
        context, inverse, types = np.unique(k >> np.uint64(16), return_inverse=True, return_counts=True)
        total = np.bincount(inverse, c)
        back = discount * types / total
        lower = np.full(len(k), UNKNOWN) if n == 1 else levels[-1].p[np.searchsorted(levels[-1].keys, _low(k, n - 1))]
        p = np.maximum(c - discount, 0) / total[inverse] + back[inverse] * lower
        levels.append(Level(k, p, context, back))
    cost = -np.log(levels[-1].p)
    share = top_counts / top_counts.sum()
    mean = float((share * cost).sum())
    return Language(name, levels, mean, float((share * (cost - mean) ** 2).sum()) ** 0.5)


class Stored(NamedTuple):
    """Models too large to broadcast.

    values: key, slot, lang, value, settled in the shared folder. slot is 2 n for the probability of a key of n characters,
    2 n + 1 for the backoff of a context of the n-grams; lang is a place in languages, which have no levels of their own.
    """

    languages: list[Language]
    values: DataFrame
    tables: tuple[DataFrame, ...] = ()  # what values is made of


def learn(docs: DataFrame, mod: int = 4, held_out: int = 2) -> list[Language] | Stored:
    """A model for each non-null lang, from all texts whose crc32(doc_id as text) modulo mod isn't held_out.

    All those texts are counted, on the executors, and every n-gram is kept. Up to BROADCAST_GRAMS the counts reach the
    driver; beyond, the same models are computed and kept as tables. One in CALIBRATE of the texts is scored with models
    of the others, which sets the limits of rejection; the models themselves hold all.
    """
    common.prepare(docs.sparkSession)
    train = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (common.crc_mod(F.col("doc_id"), mod) != held_out))
    apart = F.floor(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) / mod) % CALIBRATE == 0
    train = train.select("lang", "text", apart.alias("apart"))

    def tally(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[tuple[str, bool], tuple[np.ndarray, np.ndarray]] = {}
        for pdf in batches:
            for key, own in pdf.groupby(["lang", "apart"])["text"]:
                count = Counter()
                for t in own:
                    count.update(words(t))
                if not count:
                    continue
                keys, n = grams(list(count))
                weights = np.repeat(np.fromiter(count.values(), np.int64, len(count)), n)
                if key in sums:
                    keys, weights = np.concatenate([keys, sums[key][0]]), np.concatenate([weights, sums[key][1]])
                distinct, inverse = np.unique(keys, return_inverse=True)
                sums[key] = distinct, np.bincount(inverse, weights).astype(np.int64)
        for (lang, apart), (keys, n) in sums.items():
            yield pd.DataFrame({"lang": lang, "apart": apart, "gram": keys.view(np.int64), "n": n})

    counted = train.mapInPandas(tally, "lang string, apart boolean, gram long, n long").groupBy("lang", "gram")
    counts = common.settle(counted.agg(F.sum("n").alias("n"), F.sum(F.when(F.col("apart"), 0).otherwise(F.col("n"))).alias("others")))
    models = _models(counts.select("lang", "gram", "n"))
    others = _models(counts.where("others > 0").select("lang", "gram", F.col("others").alias("n")))
    limits = _calibrate(train.where("apart").select(F.lit(0).cast("long").alias("doc_id"), "text", "lang"), others)
    common.discard(counts)
    if isinstance(others, Stored):
        common.discard(*others.tables)
    if isinstance(models, Stored):
        return models._replace(languages=[limits(x) for x in models.languages])
    return [limits(x) for x in models]


def _models(counts: DataFrame) -> list[Language] | Stored:
    """Uncalibrated models from (lang, gram, n)."""
    if counts.count() > BROADCAST_GRAMS:
        return _store(counts)
    pdf = counts.toPandas()
    return [fit(lang, own["gram"].to_numpy(np.int64).view(np.uint64), own["n"].to_numpy()) for lang, own in pdf.groupby("lang")]


def _calibrate(docs: DataFrame, models: list[Language] | Stored):
    """Sets a language's limit so that WITHIN of these texts, which its model hasn't seen, are not rejected; moments and quantiles are taken on the executors."""
    languages = models.languages if isinstance(models, Stored) else models
    at = {lang.name: j for j, lang in enumerate(languages)}

    def cost(pdf: pd.DataFrame, languages: list[Language]) -> pd.DataFrame:
        counted, sizes, entropies = _entropies(pdf["text"].tolist(), languages)
        own = [at.get(pdf["lang"].iloc[i]) for i in counted]
        rows = [(languages[j].name, float(entropies[i, j]), int(sizes[i]), languages[j].spread) for i, j in enumerate(own) if j is not None]
        return pd.DataFrame(rows, columns=["lang", "h", "n", "spread"])

    if not languages:
        return lambda x: x
    seen = common.settle(_apply(docs, models, cost, "lang string, h double, n long, spread double"))
    noise = F.col("spread") ** 2 / F.col("n")
    moments = seen.groupBy("lang").agg((F.sum(F.col("h") * F.col("n")) / F.sum("n")).alias("mean"))
    apart = seen.join(F.broadcast(moments), "lang").withColumn("off", F.col("h") - F.col("mean"))  # a row a language
    wander = apart.groupBy("lang").agg(F.sqrt(F.greatest(F.lit(0.0), F.sum((F.col("off") ** 2 - noise) * F.col("n")) / F.sum("n"))).alias("wander"))
    scaled = apart.join(F.broadcast(wander), "lang").withColumn("u", F.col("off") / F.sqrt(noise + F.col("wander") ** 2))
    limit = F.percentile_approx("u", WITHIN, 10_000).alias("limit")
    of_lang = {r["lang"]: r for r in scaled.groupBy("lang").agg(F.count("*").alias("texts"), F.first("mean").alias("mean"), F.first("wander").alias("wander"), limit).collect()}
    every = scaled.agg(limit, F.percentile_approx("wander", 0.5).alias("wander")).first()
    common.discard(seen)

    def limits(lang: Language) -> Language:
        r = of_lang.get(lang.name)
        if r is not None and r["texts"] >= LEAST_TEXTS:
            return lang._replace(entropy=r["mean"], wander=r["wander"], limit=max(r["limit"], 0.0))
        if every["limit"] is not None:
            return lang._replace(wander=every["wander"], limit=max(every["limit"], 0.0))
        return lang

    return limits


def _store(counts: DataFrame) -> Stored:
    """The models of fit() by joins, from all (lang, gram, n)."""
    names = sorted(r["lang"] for r in counts.select("lang").distinct().collect())
    number = counts.sparkSession.createDataFrame(list(enumerate(names)), "no int, lang string")
    at_level = {ORDER: common.settle(counts.join(F.broadcast(number), "lang").select(F.col("no").alias("lang"), F.col("gram").alias("key"), F.col("n").cast("double").alias("c")))}
    for n in range(ORDER - 1, 0, -1):
        shorter = at_level[n + 1].groupBy("lang", F.col("key").bitwiseAND(F.lit((1 << (16 * n)) - 1)).alias("key"))
        at_level[n] = common.settle(shorter.agg(F.count("*").cast("double").alias("c")))
    values, tables, p = [], [], None
    for n in range(1, ORDER + 1):
        of_lang = at_level[n].groupBy("lang").agg(F.sum((F.col("c") == 1).cast("double")).alias("once"), F.sum((F.col("c") == 2).cast("double")).alias("twice"))
        discount = of_lang.select("lang", F.when((F.col("once") > 0) & (F.col("twice") > 0), F.try_divide("once", F.col("once") + 2 * F.col("twice"))).otherwise(0.5).alias("d"))
        rows = at_level[n].withColumn("context", F.shiftrightunsigned("key", 16)).join(F.broadcast(discount), "lang")
        context = rows.groupBy("lang", "context").agg(F.sum("c").alias("total"), (F.max("d") * F.count("*") / F.sum("c")).alias("back"))
        context = common.settle(context)
        rows = rows.join(context, ["lang", "context"])
        if n == 1:
            rows = rows.withColumn("lower", F.lit(UNKNOWN))
        else:
            lower = p.select("lang", F.col("key").alias("low"), F.col("p").alias("lower"))
            rows = rows.withColumn("low", F.col("key").bitwiseAND(F.lit((1 << (16 * (n - 1))) - 1))).join(lower, ["lang", "low"])
        p = common.settle(rows.select("lang", "key", "c", (F.greatest(F.col("c") - F.col("d"), F.lit(0.0)) / F.col("total") + F.col("back") * F.col("lower")).alias("p")))
        tables += [p, context]
        values += [p.select("key", F.lit(2 * n).alias("slot"), "lang", F.col("p").alias("value")), context.select(F.col("context").alias("key"), F.lit(2 * n + 1).alias("slot"), "lang", F.col("back").alias("value"))]
    cost, total = -F.log("p"), F.sum("c")
    of_lang = p.groupBy("lang").agg((F.sum(F.col("c") * cost) / total).alias("mean"), (F.sum(F.col("c") * cost * cost) / total).alias("square"))
    languages = [Language(names[r["lang"]], [], r["mean"], max(r["square"] - r["mean"] ** 2, 0.0) ** 0.5) for r in of_lang.orderBy("lang").collect()]
    common.discard(*at_level.values())
    return Stored(languages, reduce(DataFrame.union, values), tuple(tables))


def _entropies(texts: list[str], languages: list[Language]) -> tuple[list[int], np.ndarray, np.ndarray]:
    """The texts that have letters, their characters, and their cross-entropy a character by each language.

    Every distinct word of these texts, and every distinct n-gram of those, is scored once.
    """
    number: dict[str, int] = {}
    parts = [[number.setdefault(w, len(number)) for w in words(t)] if any(map(str.isalpha, t)) else [] for t in texts]
    counted = [i for i, p in enumerate(parts) if p]
    if not number or not languages:
        return [], np.zeros(0, np.int64), np.zeros((0, len(languages)))
    keys, n = grams(list(number))
    distinct, inverse = np.unique(keys, return_inverse=True)
    places, starts = np.concatenate([parts[i] for i in counted]), np.cumsum([0] + [len(parts[i]) for i in counted[:-1]])
    sizes = np.add.reduceat(n[places], starts)
    entropies = np.empty((len(counted), len(languages)))
    for j, lang in enumerate(languages):
        of_word = np.add.reduceat(-np.log(lang.probability(distinct))[inverse], np.cumsum(n) - n)
        entropies[:, j] = np.add.reduceat(of_word[places], starts) / sizes
    return counted, sizes, entropies


def classify(texts: list[str], languages: list[Language]) -> list[tuple[str, float, bool]]:
    """(language, score, rejected) for each text."""
    out = [("und", 0.0, True)] * len(texts)
    for i, size, entropy in zip(*_entropies(texts, languages), strict=True):
        best = int(np.argmin(entropy))
        score = 1 / np.exp(-(entropy - entropy[best]) * min(size, 100)).sum()
        out[i] = languages[best].name, float(score), languages[best].rejects(entropy[best], size)
    return out


PREDICTED = "doc_id long, lang_pred string, score double, rejected boolean"


def predict(docs: DataFrame, languages: list[Language] | Stored, mod: int = 4, held_out: int = 2) -> DataFrame:
    """doc_id, held_out, lang_pred, score, rejected for every row of docs (doc_id, text).

    lang_pred is the language of the lowest cross-entropy a character; score is its posterior among the
    languages; rejected says that even this is higher than its calibrated limit for a text of that length.
    A text that is null or has no letters gives und, 0, true, and so does every text if nothing was learned.
    Repeated rows each give a row, an empty table an empty one; other columns are ignored.
    """

    def say(pdf: pd.DataFrame, languages: list[Language]) -> pd.DataFrame:
        out = pd.DataFrame(classify(pdf["text"].tolist(), languages), columns=["lang_pred", "score", "rejected"])
        out.insert(0, "doc_id", pdf["doc_id"].astype("Int64").array)
        return out

    out = _apply(common.whole_texts(docs).withColumn("lang", F.lit("")), languages, say, PREDICTED)
    return out.select("doc_id", (common.crc_mod(F.col("doc_id"), mod) == held_out).alias("held_out"), "lang_pred", "score", "rejected")


def _apply(docs: DataFrame, models: list[Language] | Stored, f: Callable[[pd.DataFrame, list[Language]], pd.DataFrame], schema: str) -> DataFrame:
    """f(rows, languages) over docs (doc_id, text, lang), with models that are broadcast or looked up for each chunk of texts."""
    spark = common.prepare(docs.sparkSession)
    if isinstance(models, Stored):
        return _look_up(docs, models, f, schema)
    shared = spark.sparkContext.broadcast(models)

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield f(pdf, shared.value)

    return docs.mapInPandas(scan, schema)


def _look_up(docs: DataFrame, models: Stored, f: Callable[[pd.DataFrame, list[Language]], pd.DataFrame], schema: str) -> DataFrame:
    """Each chunk of texts meets what all models say about its own n-grams.

    Texts are written once, with the numbers of their chunks, so that both reads see the same chunks.
    """

    def number(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        chunk, size = TaskContext.get().partitionId() << 32, 0
        for pdf in batches:
            at = []
            for length in pdf["text"].str.len():
                if size and size + length > CHUNK_CHARS:
                    chunk, size = chunk + 1, 0
                size += length
                at.append(chunk)
            yield pdf.assign(chunk=np.array(at, dtype=np.int64))

    texts = common.settle(docs.mapInPandas(number, "doc_id long, text string, lang string, chunk long"), codec="zstd")

    def want(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for chunk, own in pdf.groupby("chunk")["text"]:
                found = list({w for t in own for w in words(t)})
                if not found:
                    continue
                keys = np.unique(grams(found)[0])
                for n in range(1, ORDER + 1):
                    low = np.unique(_low(keys, n))
                    for slot, k in ((2 * n, low), (2 * n + 1, np.unique(low >> np.uint64(16)))):
                        yield pd.DataFrame({"chunk": chunk, "slot": slot, "key": k.view(np.int64)})

    languages = models.languages

    def score(own: pd.DataFrame, seen: pd.DataFrame) -> pd.DataFrame:
        tables = {k: _table(g) for k, g in seen.groupby(["lang", "slot"])}
        none = np.zeros(0, np.uint64), np.zeros(0)
        at = lambda j, slot: tables.get((j, slot), none)
        return f(own, [lang._replace(levels=[Level(*at(j, 2 * n), *at(j, 2 * n + 1)) for n in range(1, ORDER + 1)]) for j, lang in enumerate(languages)])

    wanted = texts.select("chunk", "text").mapInPandas(want, "chunk long, slot int, key long")
    seen = wanted.join(models.values, ["slot", "key"]).select("chunk", "slot", "key", "lang", "value")
    return texts.groupBy("chunk").cogroup(seen.groupBy("chunk")).applyInPandas(score, schema)


def _table(rows: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Sorted keys and their values; a chunk that was read in parts asks for a key more than once."""
    keys, first = np.unique(rows["key"].to_numpy(np.int64).view(np.uint64), return_index=True)
    return keys, rows["value"].to_numpy()[first]
