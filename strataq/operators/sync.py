"""Incremental indexing: what changed, what to embed, what is stale."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataq.functions import expressions as X

KEY = ["repo_id", "relative_path"]


def changes(now: DataFrame, before: DataFrame) -> DataFrame:
    """repo_id, relative_path, change (added, updated, unchanged, removed) from one full outer join."""
    a = now.select(*KEY, F.col("content_hash").alias("new"))
    b = before.select(*KEY, F.col("content_hash").alias("old"))
    change = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").when(F.col("old") != F.col("new"), "updated").otherwise("unchanged")
    return a.join(b, KEY, "full_outer").select(*KEY, change.alias("change"))


def summary(changed: DataFrame) -> DataFrame:
    """Counters of every repository; total counts the files that are there now."""
    count = lambda c: F.count_if(F.col("change") == c).alias(c)
    return changed.groupBy("repo_id").agg(*map(count, ("added", "updated", "removed", "unchanged")), F.count_if(F.col("change") != "removed").alias("total_files"))


def repo_changed(changed: DataFrame) -> DataFrame:
    return changed.groupBy("repo_id").agg(F.bool_or(F.col("change") != "unchanged").alias("changed"))


def changed_chunks(chunks: DataFrame, changed: DataFrame) -> DataFrame:
    """Chunks of added or updated files."""
    return chunks.join(changed.where(F.col("change").isin("added", "updated")), KEY, "left_semi")


def stale_points(stored: DataFrame, expected: DataFrame) -> DataFrame:
    return stored.select("point_id").join(expected.select("point_id"), "point_id", "left_anti")


def to_embed(expected: DataFrame, stored: DataFrame) -> DataFrame:
    """Chunks whose point with this very content isn't stored: failed runs are made up for."""
    return expected.join(stored.select("point_id", "content_hash"), ["point_id", "content_hash"], "left_anti")


def with_point_ids(points: DataFrame) -> DataFrame:
    return points.withColumn("point_id", X.point_id(F.col("repo_id"), F.col("chunk_id")))
