"""Chunk ids, the stored index and its searches on small hand-made inputs."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from vellum.operators import index as idx
from vellum.operators import ranking, retrieve, search
from vellum.sources import chunking, scratch


def test_chunk_ids_are_unique_past_a_thousand_chunks(spark):
    """A text of 1,100 chunks beside the next document; both halves are read back from an id."""
    docs = spark.createDataFrame([(7, "word " * 88_000, "s", "en"), (8, "word " * 200, "s", "en"), (9, None, "s", "en")], "doc_id long, text string, source string, lang string")
    got = chunking.word_windows(docs).select("chunk_id", "doc_id", "chunk_index", chunking.document_of(F.col("chunk_id")).alias("d"), chunking.index_of(F.col("chunk_id")).alias("i")).collect()
    assert len(got) == 1100 + 3 and len({r.chunk_id for r in got}) == len(got)
    assert all((r.d, r.i) == (r.doc_id, r.chunk_index) for r in got)


@pytest.fixture(scope="module")
def chunks(spark):
    texts = ["cash flow of the year", "cash and cash", "the flower", "nothing", "flow", "Fluß und Flow"]
    return spark.createDataFrame([(i, i // 2, i % 2, t, "t", "s", 1) for i, t in enumerate(texts)], "chunk_id long, doc_id long, chunk_index long, chunk_text string, title string, section string, page_start long")


def test_stored_and_planned_index_agree(spark, chunks):
    stored, planned = idx.stored(chunks, 1 << 30), idx.planned(chunks)
    asked = spark.createDataFrame([(1, "cash flow"), (2, "flo"), (3, ""), (4, "missing")], "query_id long, query string")
    for f in (search.fulltext, search.boolean_prefix, search.lexical_recall):
        a, b = (sorted(map(repr, f(i, asked).collect())) for i in (stored, planned))
        assert a == b and a
    assert {(r.query_id, r.chunk_id) for r in search.boolean_prefix(stored, asked).collect() if r.query_id == 2} == {(2, 0), (2, 2), (2, 4), (2, 5)}


def test_scores_stay_where_the_postings_are(spark, chunks):
    """No exchange between the stored postings and the sum of a chunk's scores."""
    stored = idx.stored(chunks, 0)
    asked = spark.createDataFrame([(1, "cash flow")], "query_id long, query string")
    plan = search.ranked(stored.postings, search.counted(stored, search.query_tokens(asked)), stored.size)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in plan and "BroadcastHashJoin" in plan


@pytest.mark.parametrize("room", [32 << 20, 64])
def test_vector_search_in_blocks(spark, monkeypatch, room):
    monkeypatch.setattr(search, "QUERY_BYTES", room)
    rng = np.random.default_rng(3)
    x = rng.normal(size=(300, 5)).round(3)
    rows = [(i, [float(a) for a in v]) for i, v in enumerate(x)] + [(900, None), (901, []), (902, [0.0] * 5), (903, [1.0, 2.0]), (904, [float(a) for a in x[0]])]
    vectors = spark.createDataFrame(rows, "chunk_id long, embedding array<double>").repartition(3)
    asked = spark.createDataFrame([(q, rows[q][1]) for q in range(0, 40, 2)] + [(950, None), (951, [0.0] * 5), (952, [3.0, 1.0])], "query_id long, vector array<double>")
    got = {}
    for r in search.vector_top_k(vectors, asked, 6).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.chunk_id, r.score))
    want = {}
    for q in [*range(0, 40, 2), 952]:
        v = np.array(rows[q][1] if q < 900 else [3.0, 1.0])
        scored = [(i, round(float(v @ np.array(w) / np.linalg.norm(v) / np.linalg.norm(w)), 6)) for i, w in rows if w and len(w) == len(v) and any(w)]
        want[q] = sorted([s for s in scored if s[1] > 0], key=lambda s: (-s[1], -s[0]))[:6]
    assert got == want


def test_no_question_no_rows(spark, chunks):
    none = spark.createDataFrame([], "query_id long, query string")
    vectors = spark.createDataFrame([(1, [1.0])], "chunk_id long, embedding array<double>")
    assert search.fulltext(chunks, none).collect() == search.boolean_prefix(chunks, none).collect() == search.lexical_recall(chunks, none).collect() == []
    assert search.vector_top_k(vectors, spark.createDataFrame([], "query_id long, vector array<double>")).collect() == []


def test_greedy_choice(spark):
    """Near copies go, a fourth of a section goes, table slices stay."""
    words = [f"w{i}" for i in range(100)]
    texts = {1: " ".join(words), 2: " ".join(words[:91]), 3: " ".join(words[:80]), 4: "own words here", 5: "other words", 6: "yet more", 7: "and again", 8: "col_0=and again", 9: "elsewhere"}
    rows = [(1, i, 9, t, "s" if i != 9 else "z", 1 - i / 100) for i, t in texts.items()]
    df = spark.createDataFrame(rows, "query_id long, chunk_id long, doc_id long, chunk_text string, section string, final_score double")
    assert [r.chunk_id for r in ranking.greedy_distinct(df, 20).orderBy("rank").collect()] == [1, 3, 4, 8, 9]
    assert [r.chunk_id for r in ranking.greedy_distinct(df, 2).orderBy("rank").collect()] == [1, 3]


def test_model_scores_rerank(spark):
    df = spark.createDataFrame([(1, 1, 0.9), (1, 2, 0.8), (2, 3, 0.5)], "query_id long, chunk_id long, final_score double")
    said = spark.createDataFrame([(1, 2, 1.0), (1, 2, 0.2)], "query_id long, chunk_id long, relevance double")
    got = {r.chunk_id: (r.applied, r.combined_score) for r in retrieve.rerank(df, said).collect()}
    assert got == {1: (True, 0.58), 2: (True, 0.88), 3: (False, 0.5)}


def test_scratch_needs_a_shared_folder(spark, monkeypatch):
    assert scratch.root(spark) == spark.conf.get("spark.checkpoint.dir").rstrip("/")
    spark.range(3).write.mode("overwrite").parquet(scratch.root(spark) + "/x")
    first = scratch.stamp(spark, scratch.root(spark) + "/x")
    spark.range(4000).write.mode("overwrite").parquet(scratch.root(spark) + "/x")
    assert scratch.stamp(spark, scratch.root(spark) + "/x") != first


def test_candidates_are_lowered_once(spark):
    """A candidate's text is lowered once for its keywords and once for all signals, not for each term, word and branch."""
    found = spark.createDataFrame([(1, 1, "is it U.S. cash e.g. now", "the U.S. cash, e.g. now", "t", "s", 1, 0.5, 0.5)], "query_id long, chunk_id long, query string, chunk_text string, title string, section string, page_start long, embedding double, bm25 double")
    words = search.keyword_components(found).withColumnsRenamed({"keyword_score": "keyword", "coverage_score": "coverage"})
    fused = ranking.fused_score(words.withColumns({"block_count": F.lit(1), "depth": F.lit(1)}))
    assert fused.columns == [*words.columns, "block_count", "depth", "final_score"]
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    assert plan(words).count("lower(chunk_text") == 1
    assert len(re.findall(r"lower\(concat\(chunk_text#\d+,\s+, chunk_text", plan(fused))) == 1
    assert [r.coverage for r in words.collect()] == [4 / 6]  # "e.g." and "U.S." are words of the text where no word character follows
