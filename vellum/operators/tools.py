"""Operators as tools that an agent may call by name: each answers with rows, or with an error that names itself."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.operators import answers, retrieve, search, store
from vellum.operators.index import Index


@dataclass
class Library:
    """What the tools work on: the index, documents, chats, and how a question is turned into candidates."""

    index: Index
    documents: DataFrame
    messages: DataFrame
    candidates: Callable[[DataFrame], DataFrame]
    tools: dict[str, Callable[..., DataFrame]] = field(init=False)

    def __post_init__(self) -> None:
        self.tools = {
            "search_documents": self.search_documents, "search_chunks": self.search_chunks, "list_documents": self.list_documents, "get_document": self.get_document, "get_chunks": self.get_chunks,
            "retrieve": self.retrieve, "build_context": self.build_context, "list_sessions": self.list_sessions, "get_history": self.get_history, "summarise": self.summarise, "answer": self.answer,
        }

    def call(self, name: str, *args: Any, limit: int = 50, **options: Any) -> dict[str, Any]:
        """{"ok", "tool", "data" or "error"}: at most ``limit`` rows of a tool's result (a report for an agent), or what went wrong."""
        if name not in self.tools:
            return {"ok": False, "tool": name, "error": {"type": "UnknownTool", "message": f"no tool named {name}"}}
        try:
            rows = [r.asDict(recursive=True) for r in self.tools[name](*args, **options).limit(limit).collect()]
        except Exception as e:  # an agent gets the error as an answer
            return {"ok": False, "tool": name, "error": {"type": type(e).__name__, "message": str(e)[:500]}}
        return {"ok": True, "tool": name, "data": rows}

    def _asked(self, query: str) -> DataFrame:
        if not query.strip():
            raise ValueError("empty query")
        return self.documents.sparkSession.createDataFrame([(1, query)], "query_id long, query string")

    def search_documents(self, keyword: str) -> DataFrame:
        return store.like_search(self.documents, keyword, [c for c, kind in self.documents.dtypes if kind == "string"])

    def search_chunks(self, query: str, k: int = 10) -> DataFrame:
        return search.fulltext(self.index, self._asked(query), k)

    def list_documents(self) -> DataFrame:
        return self.documents.orderBy(F.desc("doc_id"))

    def get_document(self, doc_id: int) -> DataFrame:
        return self.documents.filter(F.col("doc_id") == doc_id)

    def get_chunks(self, doc_id: int) -> DataFrame:
        return self.index.chunks.filter(F.col("doc_id") == doc_id).orderBy("chunk_index")

    def retrieve(self, query: str, k: int = retrieve.FINAL) -> DataFrame:
        return retrieve.single(self.candidates(self._asked(query)), self.index.chunks, k)

    def _ranked(self, asked: DataFrame, k: int = answers.CONTEXT_CHUNKS) -> DataFrame:
        found = retrieve.single(self.candidates(asked), self.index.chunks, k).withColumnRenamed("final_score", "score")
        return found.join(self.index.chunks, "chunk_id").withColumn("page_end", F.col("page_start"))

    def build_context(self, query: str) -> DataFrame:
        return answers.context(self._ranked(self._asked(query)))

    def answer(self, query: str) -> DataFrame:
        return answers.answer(self._asked(query), self._ranked)

    def list_sessions(self) -> DataFrame:
        return store.sessions(self.messages).orderBy(F.desc("last_turn"), "conv_id")

    def get_history(self, conv_id: int, limit: int = 30) -> DataFrame:
        return store.messages_of(self.messages.filter(F.col("conv_id") == conv_id), limit).orderBy("turn")

    def summarise(self, doc_id: int) -> DataFrame:
        """The first sentences of a document, in place of a model's summary."""
        from vellum.functions import text as X

        return self.get_document(doc_id).select("doc_id", F.array_join(X.key_sentences(F.col("text")), " ").alias("summary"))
