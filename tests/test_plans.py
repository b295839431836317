"""Queries of the newer modules against their SQL on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as entry
from vellum.plans import answers, evaluations, ingestion, labels, retrieval, stores, texts

SMALL = "/root/testdata/sf0.001"
TABLES = "lineitem events documents embeddings pages benchmark labels conversations".split()
MODULES = (answers, evaluations, ingestion, labels, retrieval, stores, texts)
#: Seconds each, and each step of them is a query of its own.
SLOW = {"retrieve_single", "retrieve_filtered", "section_retrieval", "section_relevance", "section_capped"}
QUERIES, ORACLES = entry.queries(), entry.oracle_sql()
NAMES = sorted(n for n in ORACLES if n not in SLOW and any(QUERIES[n] is getattr(m, n, None) for m in MODULES))
OLDER = ["query_rewrite", "greedy_dedup", "section_group", "section_scores", "evidence_similarity", "verify_heuristic", "answer_labels", "boolean_prefix_any", "boolean_prefix_all", "rerank_fused", "doc_quality_score", "repeated_lines"]


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    return con


def tidy(row):
    return repr(tuple(round(x, 9) + 0.0 if isinstance(x, float) else x for x in row))


@pytest.mark.parametrize("name", [*NAMES, *OLDER])
def test_query_matches_sql(spark, db, name):
    got = QUERIES[name](spark, SMALL)
    columns = sorted(got.columns)
    want = db.sql(ORACLES[name])
    assert columns == sorted(want.columns)
    rows = want.project(", ".join(f'"{c}"' for c in columns)).fetchall()
    assert sorted(map(tidy, got.select(*columns).collect())) == sorted(map(tidy, rows))


def test_every_query_is_named_once():
    assert len(NAMES) >= 90 and set(ORACLES) <= set(QUERIES)
