"""Vector stores behind one protocol, and one kept in Parquet: each change writes a new version beside the old."""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.operators import search, store
from vellum.sources import scratch


class VectorStore(Protocol):
    """What retrieval needs of a store of chunk vectors (chunk_id, doc_id, embedding, payload columns)."""

    def ensure_collection(self, dim: int) -> None: ...

    def upsert_chunks(self, rows: DataFrame) -> None: ...

    def search(self, queries: DataFrame, k: int, filters: dict | None = None) -> DataFrame: ...

    def delete_document_chunks(self, doc_ids: DataFrame) -> None: ...

    def delete_chunk_vectors(self, chunk_ids: DataFrame) -> None: ...


class TableStore:
    """A collection as Parquet tables in the scratch folder. ``rows`` is the present version."""

    def __init__(self, spark: SparkSession, dim: int, payload: str = "doc_id long"):
        self.spark, self.dim = spark, dim
        self.rows = spark.createDataFrame([], f"chunk_id long, {payload}, embedding array<double>")

    def _write(self, rows: DataFrame) -> None:
        self.rows = scratch.keep(rows.select(*self.rows.columns), "vectors")

    def ensure_collection(self, dim: int) -> None:
        """Another dimension empties the collection."""
        if dim != self.dim:
            self.dim = dim
            self.rows = store.emptied(self.rows)

    def upsert_chunks(self, rows: DataFrame) -> None:
        """Unit vectors in place of those with their chunk ids; a vector of another dimension ends the job."""
        self._write(store.upsert(self.rows, store.vectors_checked(rows, self.dim), ["chunk_id"]))

    def search(self, queries: DataFrame, k: int = 20, filters: dict | None = None) -> DataFrame:
        return search.vector_top_k(self.rows, queries, k, filters)

    def delete_document_chunks(self, doc_ids: DataFrame) -> None:
        self._write(store.delete(self.rows, doc_ids, "doc_id"))

    def delete_chunk_vectors(self, chunk_ids: DataFrame) -> None:
        self._write(store.delete(self.rows, chunk_ids, "chunk_id"))

    def count(self) -> int:
        return self.rows.agg(F.count("*")).first()[0]
