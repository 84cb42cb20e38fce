"""Stored vectors and a stored search index that is refreshed by fingerprints (V01, V02, K19 to K21, D53, ST01)."""
from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioforge.functions.text import words
from folioforge.operators.ledger import merge_runs
from folioforge.operators.search import bm25, top_k, vector_search


class Embedder(Protocol):
    """Anything that gives unit vectors for a batch of texts."""

    dim: int

    def embed(self, texts: list[str]) -> np.ndarray: ...


class HashEmbedder:
    """Signed hashing of words and word pairs into ``dim`` places, unit length; needs no model."""

    def __init__(self, dim: int = 256) -> None:
        self.dim = dim

    def embed(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.dim), np.float32)
        for row, text in enumerate(texts):
            w = "".join(c if c.isalnum() else " " for c in text.lower()).split()
            for f in [*w, *(" ".join(p) for p in zip(w, w[1:]))]:
                h = int.from_bytes(hashlib.blake2b(f.encode(), digest_size=8).digest(), "big")
                out[row, h % self.dim] += 1.0 if h >> 63 else -1.0
        return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)


def embedded(df: DataFrame, key: str, text: str, embedder: Embedder) -> DataFrame:
    """(key, embedding) of every text that isn't null, in Arrow batches."""
    kind = dict(df.dtypes)[key]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({key: b[key], "embedding": list(embedder.embed(b[text].tolist()))})

    return df.select(key, text).where(F.col(text).isNotNull()).mapInPandas(run, f"`{key}` {kind}, embedding array<float>")


class Stored:
    """A table in versions below a folder: a new version is written whole before the pointer to it is moved."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")

    def _path(self, name: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}" if name else self.folder)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def versions(self) -> list[str]:
        fs, p = self._path("")
        return sorted(s.getPath().getName() for s in fs.listStatus(p) if s.getPath().getName().startswith("v")) if fs.exists(p) else []

    def read(self) -> DataFrame | None:
        """The last version that was written to its end; None without one."""
        for v in reversed(self.versions()):
            fs, done = self._path(f"{v}/_SUCCESS")
            if fs.exists(done):
                return self.spark.read.parquet(f"{self.folder}/{v}")
        return None

    def save(self, df: DataFrame) -> DataFrame:
        """A new version (K20); the ones before the last are removed."""
        old = self.versions()
        name = f"v{len(old) and int(old[-1].split('-')[0][1:]) + 1:08d}-{uuid.uuid4().hex[:8]}"
        df.write.parquet(f"{self.folder}/{name}")
        for v in old[:-1]:
            fs, p = self._path(v)
            fs.delete(p, True)
        return self.spark.read.parquet(f"{self.folder}/{name}")

    def reset(self) -> None:
        """Remove all versions."""
        fs, p = self._path("")
        fs.delete(p, True)


class VectorStore(Stored):
    """(vec_id, embedding) that can be replaced by id and searched exactly."""

    def put(self, vectors: DataFrame) -> DataFrame:
        now = self.read()
        return self.save(vectors if now is None else merge_runs(now, vectors.select(*now.columns), ["vec_id"]))

    def search(self, queries: DataFrame, k: int) -> DataFrame:
        now = self.read()
        if now is None:
            raise ValueError("the store is empty")
        return vector_search(now, queries, k)


class SearchIndex(Stored):
    """Chunks with their documents' fingerprints; a refresh works on new, changed and vanished documents only (D53, ST01)."""

    @staticmethod
    def fingerprints(chunks: DataFrame) -> DataFrame:
        h = F.conv(F.substring(F.sha2(F.concat(F.col("chunk_id").cast("string"), F.lit(":"), F.coalesce("text", F.lit(""))), 256), 1, 12), 16, 10).cast("decimal(38,0)")
        return chunks.groupBy("doc_hash").agg(F.sum(h).cast("string").alias("fingerprint"))

    @staticmethod
    def _entries(chunks: DataFrame) -> DataFrame:
        w: Column = words(F.coalesce("text", F.lit("")))
        return chunks.select("doc_hash", "chunk_id", "text", F.size(w).alias("n_words"))

    def refresh(self, chunks: DataFrame) -> tuple[DataFrame, int, int]:
        """(index, documents worked on, documents removed)."""
        now, stored = self.fingerprints(chunks), self.read()
        if stored is None:
            out = self._entries(chunks).join(now, "doc_hash")
            return self.save(out), now.count(), 0
        had = stored.select("doc_hash", "fingerprint").distinct()
        changed = now.join(had, ["doc_hash", "fingerprint"], "left_anti")
        gone = had.join(now, "doc_hash", "left_anti").count()
        kept = stored.join(now, ["doc_hash", "fingerprint"], "left_semi").select(*stored.columns)
        fresh = self._entries(chunks.join(changed.select("doc_hash"), "doc_hash", "left_semi")).join(changed, "doc_hash")
        n = changed.count()
        return (stored if not n and not gone else self.save(kept.unionByName(fresh.select(*stored.columns)))), n, gone

    def query(self, queries: DataFrame, k: int) -> DataFrame:
        """The k best chunks of each query."""
        now = self.read()
        if now is None:
            raise ValueError("the index is empty")
        return top_k(bm25(now, queries, "chunk_id", "text"), k, "chunk_id")
