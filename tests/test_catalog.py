"""Queries against their SQL on the smallest tables, and small properties."""

import duckdb
import pytest

from vellum.plans import catalog
from vellum.sources.chunking import split_text

SMALL = "/root/testdata/sf0.001"
TABLES = "orders events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", ["text_normalize", "token_count", "noise_flags", "chunk_fixed", "query_intent", "fulltext_topk", "vector_topk_cosine", "hash_diff_incremental", "upsert_chunks", "history_prompt", "doc_hit_mrr", "failure_reason", "stream_sessions"])
def test_query_matches_sql(spark, db, name):
    got = catalog.QUERIES[name](spark, SMALL)
    columns = sorted(got.columns)
    want = db.sql(catalog.ORACLES[name])
    assert columns == sorted(want.columns)
    rows = want.project(", ".join(columns)).fetchall()
    assert sorted(map(repr, map(tuple, got.select(*columns).collect()))) == sorted(map(repr, rows))


def test_split_text_bounds():
    text = "\n\n".join(" ".join(f"Word{i}." for i in range(n)) for n in (5, 80, 400))
    chunks = split_text(text, 300, 50)
    assert all(0 < len(c) <= 300 for c in chunks)
    assert all(f"Word{i}." in " ".join(chunks) for i in range(400))
    assert split_text(None) == [] and split_text(" short ") == ["short"]
    assert max(map(len, split_text("x" * 1000, 300, 50))) == 300
