"""State of indexed repositories in Parquet tables. Each repository's part of a table is a folder of its own: a write touches no other's."""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMAS = {
    "repositories": "repo_id long, path string, name string, created_at string, last_indexed_at string",
    "files": "relative_path string, language string, content_hash string, size_bytes long, last_modified string, repo_id long",
    "modules": "relative_path string, content_hash string, data string, repo_id long",
    "vectors": "point_id string, chunk_id string, kind string, relative_path string, start_line int, end_line int, content string, content_hash string, embedding array<float>, repo_id long",
    "collection": "vector_size int",
}
#: Tables that don't grow with repositories' contents are one part.
WHOLE = 0


class Catalog:
    """Tables below one folder: table/part/version. A write makes a new version of a part, and readers take the latest whole one: no plan reads what it overwrites."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, x: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(x)

    def _below(self, x: str) -> list[str]:
        return [s.getPath().getName() for s in self._fs.listStatus(self._path(x))] if self._fs.exists(self._path(x)) else []

    def _versions(self, part: str) -> list[int]:
        return sorted(int(v[1:]) for v in self._below(part) if self._fs.exists(self._path(f"{part}/{v}/_SUCCESS")))

    def _part(self, name: str, repo_id: int) -> str:
        return f"{self.root}/{name}/repo{repo_id}"

    def read(self, name: str, repo_id: int | None = None) -> DataFrame:
        """A table's current rows, of one repository or of all; what isn't there yet is empty."""
        parts = [self._part(name, repo_id)] if repo_id is not None else [f"{self.root}/{name}/{p}" for p in self._below(f"{self.root}/{name}")]
        paths = [f"{p}/v{v[-1]}" for p in parts if (v := self._versions(p))]
        if not paths:
            return self.spark.createDataFrame([], SCHEMAS[name])
        return self.spark.read.schema(SCHEMAS[name]).parquet(*paths)

    def replace(self, name: str, repo_id: int, rows: DataFrame) -> None:
        """One part of a table, replaced as a whole; the version before stays for plans that read it."""
        part = self._part(name, repo_id)
        versions = self._versions(part)
        fields = [x.split()[0] for x in SCHEMAS[name].split(", ")]
        if "repo_id" in fields and name != "repositories":
            rows = rows.withColumn("repo_id", F.lit(repo_id).cast("long"))
        rows.select(*fields).write.mode("overwrite").parquet(f"{part}/v{(versions or [0])[-1] + 1}")
        for old in versions[:-1]:
            self._fs.delete(self._path(f"{part}/v{old}"), True)

    def repository(self, path: str) -> int | None:
        found = self.read("repositories").where(F.col("path") == path).first()
        return found and found["repo_id"]

    def repository_by_id(self, repo_id: int) -> DataFrame:
        return self.read("repositories").where(F.col("repo_id") == repo_id)

    def get_or_create(self, path: str, name: str) -> int:
        """The id of a repository; a new one gets the next id."""
        if (known := self.repository(path)) is not None:
            return known
        old = self.read("repositories")
        new = (old.agg(F.max("repo_id")).first()[0] or 0) + 1
        row = self.spark.createDataFrame([(new, path, name, _now(), None)], SCHEMAS["repositories"])
        self.replace("repositories", WHOLE, old.union(row))
        return new

    def list_repositories(self) -> DataFrame:
        return self.read("repositories").orderBy("repo_id")

    def touch(self, repo_id: int) -> None:
        stamp = F.when(F.col("repo_id") == repo_id, F.lit(_now())).otherwise(F.col("last_indexed_at"))
        self.replace("repositories", WHOLE, self.read("repositories").withColumn("last_indexed_at", stamp))

    def file_hashes(self, repo_id: int) -> DataFrame:
        return self.read("files", repo_id).select("relative_path", "content_hash")

    def upsert_modules(self, repo_id: int, rows: DataFrame) -> None:
        """By path, the new row wins."""
        old = self.read("modules", repo_id)
        self.replace("modules", repo_id, old.join(rows.select("relative_path"), "relative_path", "left_anti").select(*old.columns).unionByName(rows.withColumn("repo_id", F.lit(repo_id).cast("long")).select(*old.columns)))

    def delete_modules(self, repo_id: int, paths: DataFrame) -> int:
        """Forget the parsed modules of these paths (relative_path); how many there were. Files and the repository stay."""
        old = self.read("modules", repo_id)
        gone = old.join(paths.select("relative_path"), "relative_path", "left_semi").count()
        if gone:
            self.replace("modules", repo_id, old.join(paths.select("relative_path"), "relative_path", "left_anti"))
        return gone

    def clear_modules(self, repo_id: int) -> int:
        return self.delete_modules(repo_id, self.read("modules", repo_id))

    def vector_size(self) -> int | None:
        found = self.read("collection").first()
        return found and found["vector_size"]

    def create_collection(self, vector_size: int) -> None:
        """State the size of all vectors; a collection that is there stays as it is."""
        if self.vector_size() is None:
            self.replace("collection", WHOLE, self.spark.createDataFrame([(vector_size,)], SCHEMAS["collection"]))

    def upsert_vectors(self, repo_id: int, rows: DataFrame) -> None:
        """By point_id, the new row wins; nothing is written for no rows, and vectors of another size than the collection's are refused."""
        if rows.isEmpty():
            return
        wrong = rows.where(F.size("embedding") != self.vector_size()).select(F.size("embedding").alias("n")).first() if self.vector_size() else None
        if wrong:
            raise ValueError(f"a vector of size {wrong['n']} where the collection has {self.vector_size()}")
        old = self.read("vectors", repo_id)
        kept = old.join(rows.select("point_id"), "point_id", "left_anti").select(*old.columns)
        self.replace("vectors", repo_id, kept.unionByName(rows.withColumn("repo_id", F.lit(repo_id).cast("long")).select(*old.columns)))

    def delete_vectors(self, repo_id: int, ids: DataFrame) -> None:
        if ids.isEmpty():
            return
        old = self.read("vectors", repo_id)
        self.replace("vectors", repo_id, old.join(ids.select("point_id"), "point_id", "left_anti").select(*old.columns))

    def list_point_ids(self, repo_id: int) -> DataFrame:
        return self.read("vectors", repo_id).select("point_id")

    def remove(self, repo_id: int) -> None:
        """A repository with all that hangs on it, itself last."""
        for name in ("vectors", "modules", "files"):
            self._fs.delete(self._path(self._part(name, repo_id)), True)
        self.replace("repositories", WHOLE, self.read("repositories").where(F.col("repo_id") != repo_id))


def _now() -> str:
    return datetime.datetime.now(datetime.UTC).isoformat()
