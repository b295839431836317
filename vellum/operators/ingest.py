"""Folders into the stores: files are read, cut, scored and described, become rows of the document table, and their chunks are indexed."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.functions import text as X
from vellum.operators import indexing
from vellum.sources import blocks, files
from vellum.sources.scratch import keep


@dataclass
class Stores:
    """documents (doc_id, title, file_path, file_type, content, content_hash, company, filing_type, fiscal_year, quality), chunks (doc_id, chunk_index,
    chunk_text, chunk_hash) and vectors (chunk_hash, embedding); failed (path, error) are the files that could not be read."""

    documents: DataFrame
    chunks: DataFrame
    vectors: DataFrame
    failed: DataFrame


def empty(spark: SparkSession) -> Stores:
    made = lambda schema: spark.createDataFrame([], schema)
    return Stores(
        made("doc_id long, title string, file_path string, file_type string, content string, content_hash string, company string, filing_type string, fiscal_year string, quality double"),
        made("doc_id long, chunk_index long, chunk_text string, chunk_hash string"), made("chunk_hash string, embedding array<float>"), made("path string, error string"),
    )


def folder(spark: SparkSession, path: str, held: Stores, model: indexing.Embed = indexing.hashed_embedding, extra: dict[str, Callable[[bytes], str]] | None = None) -> Stores:
    """The stores after taking a folder in. A file's id is the hash of its path, so a file that is read again replaces itself, and only chunks that
    are new to the index are embedded; a file that fails leaves what is held of it."""
    parsed = keep(files.parsed_folder(spark, path, extra), "parsed")
    good = parsed.filter("error IS NULL")
    title = F.regexp_extract("path", r"([^/\\]+?)(?:\.[^./\\]*)?$", 1)
    described = good.select(
        "doc_id", title.alias("title"), F.col("path").alias("file_path"), "file_type", "content", X.content_hash(F.col("content")).alias("content_hash"), X.finance_metadata(title, F.col("content")).alias("m"), "quality",
    ).select("doc_id", "title", "file_path", "file_type", "content", "content_hash", "m.*", "quality")
    documents = held.documents.join(described.select("doc_id"), "doc_id", "left_anti").unionByName(described)
    made = blocks.block_chunks(good.select("doc_id", "blocks")).select("doc_id", "chunk_index", "chunk_text", "chunk_hash")
    none = F.lit(None).cast("string")
    without = good.select("doc_id").join(made.select("doc_id").distinct(), "doc_id", "left_anti").select("doc_id", F.lit(0).cast("long").alias("chunk_index"), none.alias("chunk_text"), none.alias("chunk_hash"))
    chunks, vectors = indexing.index(held.chunks, held.vectors, keep(made.unionByName(without), "fresh"), model)
    return Stores(keep(documents, "documents"), keep(chunks, "chunks"), keep(vectors, "vectors"), parsed.filter("error IS NOT NULL").select("path", "error"))
