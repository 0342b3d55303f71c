"""Tables that a query writes once and reads several times, in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}


def folder(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir; a one-machine session without it gets a local one."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if spark.sparkContext.master.partition("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = _own.setdefault(spark.sparkContext.applicationId, tempfile.mkdtemp(prefix="strataq"))
    return f"{base.rstrip('/')}/strataq-{uuid.uuid4().hex}"


def parts(spark: SparkSession) -> int:
    """A number of partitions to state for few or short rows that are much work: Spark merges those that it chose itself by their bytes."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)


def settle(df: DataFrame) -> DataFrame:
    """df, written and read back."""
    where = folder(df.sparkSession)
    df.write.parquet(where)
    return df.sparkSession.read.schema(df.schema).parquet(where)
