"""Incremental indexing: chunks of changed documents are compared by hash with those held, and only new ones are embedded."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DIMENSIONS = 64
Embed = Callable[[list[str]], np.ndarray]


def hashed_embedding(texts: list[str]) -> np.ndarray:
    """A deterministic stand-in for a model: each word hashed to four signed axes, so few words rarely cancel; unit length (zero without words)."""
    out = np.zeros((len(texts), DIMENSIONS))
    for row, text in zip(out, texts, strict=True):
        for word in text.lower().split():
            h = xxhash.xxh64_intdigest(word)
            for part in (h >> shift for shift in (0, 16, 32, 48)):
                row[part % DIMENSIONS] += 1 if part >> 15 & 1 else -1
    norms = np.linalg.norm(out, axis=1, keepdims=True)
    return np.divide(out, norms, out=out, where=norms > 0)


def embed(chunks: DataFrame, model: Embed = hashed_embedding) -> DataFrame:
    """chunk_hash, embedding: each distinct text is embedded once, a batch at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = np.asarray(model(batch.column(1).to_pylist()), dtype=np.float32).reshape(batch.num_rows, -1)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(list(vectors), pa.list_(pa.float32()))], ["chunk_hash", "embedding"])

    once = chunks.groupBy("chunk_hash").agg(F.min("chunk_text").alias("chunk_text"))
    return once.mapInArrow(run, "chunk_hash string, embedding array<float>")


def index(held: DataFrame, vectors: DataFrame, fresh: DataFrame, model: Embed = hashed_embedding) -> tuple[DataFrame, DataFrame]:
    """Chunk table and vector table after taking ``fresh``, all chunks (doc_id, chunk_index, chunk_text, chunk_hash) of the
    documents in it. Their old chunks go, other documents stay; hashes with a vector are not embedded again, and vectors no
    chunk uses go. A document named with a null hash only is removed. Write both results to new paths."""
    touched = fresh.select("doc_id").distinct()
    chunks = held.join(touched, "doc_id", "left_anti").unionByName(fresh.filter("chunk_hash IS NOT NULL").select(*held.columns))
    known = vectors.select("chunk_hash").distinct()
    new = embed(chunks.join(known, "chunk_hash", "left_anti"), model)
    return chunks, vectors.join(chunks.select("chunk_hash").distinct(), "chunk_hash", "left_semi").unionByName(new)
