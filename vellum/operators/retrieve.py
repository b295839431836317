"""Retrieval as one plan: recalled candidates are fused, freed of near copies, widened by neighbours, capped by page and cut.

Candidates (query_id, query, chunk_id, doc_id, chunk_index, chunk_text, title, section, page_start, embedding, bm25) come from
:mod:`vellum.operators.search`; recall bounds them a query, so all steps after it touch few rows. Models (embeddings of sections,
reranking) are functions handed in; without them the heuristics decide alone."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vellum.operators import ranking, search
from vellum.sources.scratch import keep

RECALLED, FINAL, FIRST, SECTION_CHARS = 20, 3, 5, 1500
Dense = Callable[[DataFrame], DataFrame]


def fused(candidates: DataFrame) -> DataFrame:
    """Candidates with keyword and final scores, written: what follows reads them several times."""
    scored = search.keyword_components(candidates).withColumnsRenamed({"keyword_score": "keyword", "coverage_score": "coverage"})
    scored = ranking.keyword_recalled(scored.withColumns({"block_count": F.lit(1), "depth": F.lit(1)}), RECALLED)
    return keep(ranking.fused_score(scored).drop("dl"), "fused")


def _finished(ranked: DataFrame, chunks: DataFrame) -> DataFrame:
    """Near copies out, neighbours in, pages capped: query_id, chunk_id, page_start, final_score, is_neighbor."""
    chosen = ranking.greedy_distinct(ranked, RECALLED)
    centers = keep(ranked.join(chosen, ["query_id", "chunk_id"]), "centers")
    wide = ranking.with_neighbors(centers, chunks, RECALLED, spare=2, carry=("page_start",))
    return ranking.page_capped(wide, RECALLED).drop("rank")


def single(candidates: DataFrame, chunks: DataFrame, k: int = FINAL, doc_filter: int | None = None) -> DataFrame:
    """query_id, chunk_id, final_score, is_neighbor, rank: the k best chunks of each query. The best chunk of a page is lifted by its
    neighbouring pages. ``doc_filter`` restricts what was ranked to one document, before near copies are taken out."""
    ranked = ranking.clustered(fused(candidates))
    if doc_filter is not None:
        ranked = ranked.filter(F.col("doc_id") == doc_filter)
    return search.top_k(_finished(keep(ranked, "ranked"), chunks).drop("page_start"), k, "final_score")


def best_chunk_scores(sections: DataFrame) -> DataFrame:
    """Without a model: no section has a dense score, so the best chunk of its first page decides."""
    return sections.select("query_id", "doc_id", "start", F.lit(0.0).alias("dense"))


def best_sections(ranked: DataFrame, dense: Dense = best_chunk_scores, k: int = ranking.BEST_SECTIONS) -> DataFrame:
    """The best sections of each query's first RECALLED candidates. ``dense`` gives a score to sections (query_id, query, doc_id, start, text)."""
    top = search.top_k(ranked, RECALLED, "final_score").drop("rank")
    grouped = ranking.sections(top).join(top.select("query_id", "query").distinct(), "query_id")
    text = F.concat_ws("\n", "section", F.substring("combined_text", 1, SECTION_CHARS))
    lexical = ranking.section_lexical(grouped)
    return ranking.section_scored(grouped, lexical, dense(grouped.select("query_id", "query", "doc_id", "start", text.alias("text"))), k)


def section_relevance(ranked: DataFrame, sections: DataFrame, boost: float = ranking.RELEVANCE) -> DataFrame:
    """Candidates on the first page of a section gain ``boost`` times its score; kept are these and each query's FIRST best."""
    told = sections.select("query_id", "doc_id", F.col("start").alias("page_start"), F.col("section_score").alias("_relevance"))
    at = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("final_score"), F.desc("chunk_id")))
    met = ranked.withColumn("_at", at).join(told, ["query_id", "doc_id", "page_start"], "left").filter((F.col("_at") <= FIRST) | F.col("_relevance").isNotNull())
    gained = F.col("final_score") + boost * F.greatest(F.coalesce("_relevance", F.lit(0.0)), F.lit(0.0))
    return met.withColumn("final_score", F.round(gained, 8)).drop("_at", "_relevance")


def multistage(candidates: DataFrame, chunks: DataFrame, k: int = FINAL, dense: Dense = best_chunk_scores) -> DataFrame:
    """query_id, chunk_id, final_score, is_neighbor, rank by sections first: the candidates of the best sections go on, with a bonus, and
    at the end every chunk of a page is lifted to the smoothed score of its page."""
    ranked = fused(candidates)
    near = section_relevance(ranked, keep(best_sections(ranked, dense), "sections"))
    lifted = ranking.clustered(keep(_finished(keep(near, "near"), chunks), "finished"), every=True)
    return search.top_k(lifted.select("query_id", "chunk_id", "final_score", "is_neighbor"), k, "final_score")


def rerank(candidates: DataFrame, scores: DataFrame, top: int = 8, weight: float = 0.40, missing: float = 0.1) -> DataFrame:
    """Adds combined_score and applied: of each query's first ``top`` candidates (by final_score) a model's ``scores`` (query_id, chunk_id,
    relevance) count ``weight``; those it left out get ``missing``. Queries that it gave no score keep their order and scores."""
    at = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("final_score"), F.desc("chunk_id")))
    given = scores.groupBy("query_id", "chunk_id").agg(F.max("relevance").alias("relevance"))
    met = candidates.withColumn("_at", at).join(given, ["query_id", "chunk_id"], "left")
    told = F.max(F.when(F.col("_at") <= top, F.col("relevance"))).over(Window.partitionBy("query_id")).isNotNull()
    mixed = F.when(F.col("_at") <= top, (1 - weight) * F.col("final_score") + weight * F.coalesce("relevance", F.lit(missing))).otherwise(F.col("final_score"))
    return met.withColumns({"applied": told, "combined_score": F.round(F.when(told, mixed).otherwise(F.col("final_score")), 6)}).drop("_at", "relevance")
