"""Folders of text, Markdown and Word files as documents. Files are read by Spark's binary reader and decoded in Arrow batches.

A file that cannot be read gives a row with ``error`` and null text, so one bad file never ends a job. PDF files are read by
:mod:`vellum.sources.pdf`, which knows simple ones; pass ``extra`` to read them with a library."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.functions import text as X
from vellum.sources import blocks, pdf, quality

# fixed values: encodings in the order they are tried, and the namespace of Word files
ENCODINGS = ["utf-8-sig", "gbk", "gb18030", "latin-1"]
W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def decode(data: bytes) -> str:
    """Text in the first encoding that takes every byte, without a byte order mark or outer white space."""
    for encoding in ENCODINGS:
        try:
            return data.decode(encoding).lstrip("﻿").strip()
        except UnicodeDecodeError:
            continue
    raise ValueError("no encoding fits")


def docx(data: bytes) -> str:
    """Body of a Word file in reading order as Markdown: headings with #, list items with -, table rows between pipes."""
    with zipfile.ZipFile(io.BytesIO(data)) as archive:
        body = ElementTree.fromstring(archive.read("word/document.xml")).find(f"{W}body")
    said = lambda node: "".join(t.text or "" for t in node.iter(f"{W}t")).strip()
    out: list[str] = []
    for node in body if body is not None else ():
        if node.tag == f"{W}tbl":
            out.append("\n".join("| " + " | ".join(said(cell) for cell in row.iter(f"{W}tc")) + " |" for row in node.iter(f"{W}tr")))
        elif node.tag == f"{W}p" and said(node):
            style = node.find(f"{W}pPr/{W}pStyle")
            name = style.get(f"{W}val", "").lower() if style is not None else ""
            level = name.removeprefix("heading").strip()
            mark = "#" * min(6, int(level)) + " " if name.startswith("heading") and level.isdigit() and level != "0" else "# " if name == "title" else ""
            listed = "- " if not mark and (node.find(f"{W}pPr/{W}numPr") is not None or name.startswith("list")) else ""
            out.append(mark + listed + said(node))
    return "\n\n".join(out)


READERS: dict[str, Callable[[bytes], str]] = {"text": decode, "docx": docx, "pdf": pdf.read}


def read_folder(spark: SparkSession, folder: str, extra: dict[str, Callable[[bytes], str]] | None = None) -> DataFrame:
    """path, file_type, text, error, content_hash of every file below ``folder``, to be ordered by path where order counts; ``extra`` adds readers by file type."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    return read_bytes(files.select("path", "content"), extra)


def read_bytes(files: DataFrame, extra: dict[str, Callable[[bytes], str]] | None = None) -> DataFrame:
    """path, file_type, text, error, content_hash of files (path, content)."""
    readers = {**READERS, **(extra or {})}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, errors = [], []
            for kind, data in zip(batch.column(1).to_pylist(), batch.column(2), strict=True):
                text = error = None
                try:
                    if kind in readers:
                        text = readers[kind](data.as_py())
                    else:
                        error = f"no reader for {kind} files"
                except Exception as e:  # a bad file must not end the job
                    error = f"{type(e).__name__}: {e}"
                texts.append(text)
                errors.append(error)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(errors, pa.string())], ["path", "file_type", "text", "error"])

    typed = files.select("path", X.file_type(F.col("path")).alias("file_type"), "content")
    return typed.mapInArrow(run, "path string, file_type string, text string, error string").withColumn("content_hash", F.md5("text"))


def parsed_folder(spark: SparkSession, folder: str, extra: dict[str, Callable[[bytes], str]] | None = None) -> DataFrame:
    """path, file_type, doc_id (the hash of the path), error, content, blocks, quality of every file below ``folder``: read, cut into blocks, cleaned
    and scored. Failed files keep their error and have no blocks."""
    read = read_folder(spark, folder, extra).withColumn("doc_id", F.xxhash64("path"))
    clean = blocks.clean(blocks.typed_blocks(read.select("doc_id", "text")))
    content = blocks.content(clean)
    scores = quality.text_scores(blocks.exploded(clean), content).select("doc_id", "quality")
    return read.select("path", "file_type", "doc_id", "error").join(clean, "doc_id").join(content, "doc_id").join(scores, "doc_id")
