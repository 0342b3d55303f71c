"""Token counts through a cache keyed by digests of the content and of the tokenizer's version."""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strataq.llm import common

CACHE = T.StructType(
    [
        T.StructField("content", T.BinaryType()),
        T.StructField("version", T.StringType()),
        T.StructField("n_tokens", T.LongType()),
    ]
)
#: Texts of these characters alone may go to the faster encoder with the same vocabulary and pattern.
_PLAIN = re.compile("[^\t\n\r\x20-\x7e\xa1-ɏ]")


def version(tokenizer: str, kind: str = "json") -> str:
    """Digest of the vocabulary file and of how it is used; a changed file never meets old counts."""
    with open(tokenizer, "rb") as f:
        return hashlib.sha256(f.read() + f"|{kind}|no-special|1".encode()).hexdigest()


@lru_cache(maxsize=4)
def counter(tokenizer: str, ranks: str | None):
    """A function from texts to counts, as the tokenizers library gives them for this file.

    ranks: the same vocabulary as ranks. Plain texts without a special token's string are then encoded with
    it, which gives the same counts in less time; all others go to the library itself.
    """
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    if tokenizer.endswith(".model"):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=tokenizer)
        return lambda texts: [len(x) for x in sp.encode(texts, num_threads=1)]
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(tokenizer)
    tok.no_truncation()
    tok.no_padding()
    slow = lambda texts: [len(e.ids) for e in tok.encode_batch(texts, add_special_tokens=False)]
    if not ranks:
        return slow
    import public_tokenizers
    import tiktoken

    with open(ranks, "rb") as f:
        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    fast = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})
    special = [t.content for t in tok.get_added_tokens_decoder().values()]

    def count(texts: list[str]) -> list[int]:
        out = [-1] * len(texts)
        rest = []
        for i, t in enumerate(texts):
            if len(t) > 1_000_000 or _PLAIN.search(t) or any(s in t for s in special):
                rest.append(i)
            else:
                out[i] = len(fast.encode_ordinary(t))
        for i in rest:
            out[i] = slow([texts[i]])[0]
        return out

    return count


def read_cache(spark: SparkSession, path: str) -> DataFrame:
    """The cache's rows; a cache that isn't there yet is empty."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop):
        return spark.createDataFrame([], CACHE)
    return spark.read.schema(CACHE).parquet(path)


def count_tokens(docs: DataFrame, tokenizer: str, ranks: str | None = None, cache: str | None = None, limit: int = 1024) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for every row of docs (doc_id, text).

    cache: the folder of the cache, below spark.checkpoint.dir if not given. Each distinct content that it
    lacks for this tokenizer's version is encoded once and appended; all counts are then read from it.
    A null text counts as empty (0 bytes, 0 tokens). Repeated rows and copies each give a row; an empty
    table gives an empty one; rows without an id, and different texts of one id, are counted each for itself; other
    columns are ignored. Texts move once, keyed by doc_id, which is even however many copies one content has; digests
    that many rows have, a thousand at most, meet their counts in a broadcast, all others in a shuffle.
    """
    spark = common.prepare(docs.sparkSession)
    cache = cache or common.scratch(spark)
    ver = version(tokenizer)
    texts = common.whole_texts(docs)
    keyed = texts.select("doc_id", F.unhex(F.sha2("text", 256)).alias("content"), F.octet_length("text").cast("long").alias("n_bytes"))
    contents = common.settle(keyed.groupBy("content").agg(F.min(F.coalesce("doc_id", F.lit(-1))).alias("doc_id"), F.count("*").alias("n")))
    stored = read_cache(spark, cache).where(F.col("version") == ver)
    missing = contents.select("content", "doc_id").join(stored, "content", "left_anti")

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        count = counter(tokenizer, ranks)
        for pdf in batches:
            pdf = pdf.drop_duplicates("content")
            yield pd.DataFrame({"content": pdf["content"], "version": ver, "n_tokens": count(pdf["text"].tolist())})

    wanted = texts.select(F.coalesce("doc_id", F.lit(-1)).alias("doc_id"), "text").join(missing.hint("shuffle_hash"), "doc_id")
    fresh = wanted.where(F.unhex(F.sha2("text", 256)) == F.col("content")).select("content", "text").mapInPandas(encode, CACHE)
    fresh.write.mode("append").parquet(cache)
    counts = read_cache(spark, cache).where(F.col("version") == ver).groupBy("content").agg(F.max("n_tokens").alias("n_tokens"))
    total = contents.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    spread = F.coalesce("doc_id", F.lit(-1)).cast("string").cast("binary")  # shorter than a digest
    out = common.join_groups(keyed, contents.select("content", "n").join(counts, "content"), "content", total, spread)
    return out.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
