"""What the operators of this subpackage share."""

from __future__ import annotations

import ctypes
import os
import tempfile
import uuid
import weakref
import zipfile

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_shipped: set[str] = set()
_own_dir: dict[str, str] = {}
_folders: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()

#: Lower-cases A-Z and turns every ASCII byte that isn't a letter or digit into a space; other bytes stay.
ALNUM = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256)
)


def prepare(spark: SparkSession) -> SparkSession:
    """Bound Arrow batches by bytes and ship this package to the Python workers, once a session.

    The bounds stay set for the session: plans are lazy, and read them only when the caller runs them.
    """
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))
    app = spark.sparkContext.applicationId
    if app not in _shipped:
        _shipped.add(app)
        root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
        target = os.path.join(tempfile.mkdtemp(), "strataq_package.zip")
        with zipfile.ZipFile(target, "w") as z:
            for folder, _, names in os.walk(root):
                for name in names:
                    if name.endswith(".py"):
                        path = os.path.join(folder, name)
                        z.write(path, os.path.relpath(path, os.path.dirname(root)))
        spark.sparkContext.addPyFile(target)
    return spark


def trim() -> None:
    """In a Python worker: give freed memory, Arrow's too, back to the system. Workers live on from one stage to the next."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass  # not every C library has it


def scratch(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir. Where that is unset, a local folder serves one-machine sessions; on a cluster it must be set."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.partition("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = _own_dir.setdefault(spark.sparkContext.applicationId, tempfile.mkdtemp(prefix="strataq"))
    return f"{base.rstrip('/')}/strataq-{uuid.uuid4().hex}"


def settle(df: DataFrame, where: str | None = None, codec: str = "snappy") -> DataFrame:
    """Write a table to the shared folder and read it back: it is computed once, and outlives lost executors.

    zstd as codec trades a little time for space where texts are written. The folder stays until discard(), or until
    whoever owns the shared folder clears it.
    """
    spark = df.sparkSession
    where = where or scratch(spark)
    df.write.option("compression", codec).parquet(where)
    out = spark.read.schema(df.schema).parquet(where)
    _folders[out] = where
    return out


def discard(*settled: DataFrame) -> None:
    """Delete the folders of settled tables that nothing reads any more: what was derived from them is itself settled or collected."""
    for df in settled:
        if where := _folders.pop(df, None):
            path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(where)
            path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


#: A key that over one in so many rows have is hot, if it has over LEAST_HOT: there are no more than HOT_KEYS of them, whatever the input.
HOT_KEYS, LEAST_HOT = 1000, 100


def hot(groups: DataFrame, total: int) -> DataFrame:
    """Of groups (..., n: rows with the key), those whose key is hot among total rows; HOT_KEYS rows at most."""
    return groups.where(F.col("n") > max(LEAST_HOT, total // HOT_KEYS))


def join_groups(rows: DataFrame, groups: DataFrame, key: str, total: int, spread: Column) -> DataFrame:
    """rows left-joined with groups (key, n, ...), n the number of rows with the key, total of all rows.

    Hot keys meet a broadcast of their groups, HOT_KEYS rows at most, and are then dealt by `spread`, a value of the key's
    type that is no key; all other keys are shuffled. n is left out.
    """
    others = [c for c in groups.columns if c not in (key, "n")]
    few = F.broadcast(hot(groups, total).select(F.col(key).alias("__hot"), *[F.col(c).alias(f"__hot_{c}") for c in others]))
    rest = groups.where(F.col("n") <= max(LEAST_HOT, total // HOT_KEYS)).select(F.col(key).alias("__own"), *[F.col(c).alias(f"__own_{c}") for c in others])
    marked = rows.join(few, F.col(key) == F.col("__hot"), "left")
    dealt = marked.withColumn("__at", F.when(F.col("__hot").isNull(), F.col(key)).otherwise(spread))
    out = dealt.join(rest, F.col("__at") == F.col("__own"), "left")
    return out.select(*rows.columns, *[F.coalesce(f"__hot_{c}", f"__own_{c}").alias(c) for c in others])


def join_salted(rows: DataFrame, side: DataFrame, key: str, other: str) -> DataFrame:
    """rows joined with side (key unique there). Rows of a hot key are dealt by `other` over as many tasks as they are times the usual most, and its row of side goes to each.

    rows must be settled: they are counted first.
    """
    counts = rows.groupBy(key).agg(F.count("*").alias("n"))
    total = rows.count()
    many = max(LEAST_HOT, total // HOT_KEYS)
    salts = F.broadcast(hot(counts, total).select(F.col(key).alias("__key"), F.ceil(F.col("n") / many).cast("int").alias("__n")))
    dealt = rows.join(salts, F.col(key) == F.col("__key"), "left").withColumn("__salt", F.coalesce(F.pmod(F.xxhash64(other), "__n"), F.lit(0)).cast("int")).drop("__key", "__n")
    wide = side.join(salts, F.col(key) == F.col("__key"), "left").withColumn("__salt", F.explode(F.sequence(F.lit(0), F.coalesce("__n", F.lit(1)) - 1))).drop("__key", "__n")
    return dealt.join(wide, [key, "__salt"]).drop("__salt")


def whole_texts(docs: DataFrame) -> DataFrame:
    """(doc_id, text), null texts as empty; other columns, whatever their names, are left behind."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))


def crc_mod(doc_id: Column, mod: int) -> Column:
    """crc32 of the id as text, modulo mod."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % mod


def hex_digest(text: Column) -> Column:
    return F.sha2(text, 256)
