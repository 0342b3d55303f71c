"""What a session asks of services, and providers of each kind that speak HTTP or need no service."""

from __future__ import annotations

import json
import urllib.request
import zlib
from typing import Protocol

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataq.operators import retrieve
from strataq.sources.catalog import Catalog


class EmbeddingProvider(Protocol):
    @property
    def dimension(self) -> int: ...

    def embed(self, texts: list[str]) -> list[list[float]]:
        """A vector for each text, in their order."""


class AnswerProvider(Protocol):
    def generate(self, prompt: str) -> str: ...


class VectorStore(Protocol):
    """Vectors of all repositories; rows are DataFrames, so that a store may be of any size."""

    def collection_exists(self) -> bool: ...

    def create_collection(self, vector_size: int) -> None: ...

    def upsert(self, repo_id: int, points: DataFrame) -> None: ...

    def delete(self, repo_id: int, point_ids: DataFrame) -> None: ...

    def query(self, vector: list[float], repo_id: int, limit: int) -> DataFrame: ...

    def list_ids(self, repo_id: int) -> DataFrame: ...


class HashedWords:
    """Embeddings without a service: signed feature hashing of words."""

    def __init__(self, dimension: int = 64):
        self.dimension = dimension

    def embed(self, texts: list[str]) -> list[list[float]]:
        out = []
        for t in texts:
            v = [0.0] * self.dimension
            for w in t.lower().split():
                h = zlib.crc32(w.encode())
                v[h % self.dimension] += 1.0 if h >> 31 else -1.0
            out.append(v)
        return out


class HttpEmbeddings:
    """Embeddings from a service that takes {"model", "input"} at /api/embed and returns {"embeddings"}."""

    def __init__(self, url: str, model: str, dimension: int = 768, timeout: float | None = None):
        self.url, self.model, self.dimension, self.timeout = url.rstrip("/"), model, dimension, timeout

    def embed(self, texts: list[str]) -> list[list[float]]:
        body = json.dumps({"model": self.model, "input": texts}).encode()
        asked = urllib.request.Request(f"{self.url}/api/embed", body, {"Content-Type": "application/json"})
        with urllib.request.urlopen(asked, timeout=self.timeout) as r:
            return json.load(r)["embeddings"]


class Echo:
    """The prompt itself as the answer, for use without a service."""

    def generate(self, prompt: str) -> str:
        return prompt


class CatalogVectors:
    """The catalog's own table as a vector store."""

    def __init__(self, catalog: Catalog):
        self.catalog = catalog

    def collection_exists(self) -> bool:
        return self.catalog.vector_size() is not None

    def create_collection(self, vector_size: int) -> None:
        self.catalog.create_collection(vector_size)

    def upsert(self, repo_id: int, points: DataFrame) -> None:
        self.catalog.upsert_vectors(repo_id, points)

    def delete(self, repo_id: int, point_ids: DataFrame) -> None:
        self.catalog.delete_vectors(repo_id, point_ids)

    def query(self, vector: list[float], repo_id: int, limit: int) -> DataFrame:
        """The closest points of a repository, with their payload, score and rank."""
        q = self.catalog.spark.createDataFrame([(0, repo_id, [float(x) for x in vector])], "query_id int, repo_id long, query_embedding array<float>")
        stored = self.catalog.read("vectors", repo_id)
        best = retrieve.vector_topk(stored.select(F.col("chunk_id").alias("vec_id"), "repo_id", "embedding"), q, limit)
        return best.withColumnRenamed("vec_id", "chunk_id").drop("query_id").join(stored.drop("embedding"), "chunk_id")

    def list_ids(self, repo_id: int) -> DataFrame:
        return self.catalog.list_point_ids(repo_id)
