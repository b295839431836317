"""The recall of 400 by words and prefixes with the financial expansion, against SQL and planted chunks."""

import duckdb
import pytest

from vellum.operators import search
from vellum.plans import catalog

SMALL = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["hybrid_merge_whole", "rerank_fused_whole"])
def test_query_matches_sql(spark, name):
    db = duckdb.connect()
    for t in ("documents", "embeddings", "benchmark"):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    got = (catalog.flagship if name == "rerank_fused_whole" else catalog.QUERIES[name])(spark, SMALL)
    columns = sorted(got.columns)
    rows = db.sql(catalog.ORACLES[name]).project(", ".join(columns)).fetchall()
    assert sorted(map(repr, map(tuple, got.select(*columns).collect()))) == sorted(map(repr, rows))


def test_deep_prefix_and_expanded_hits_are_recalled(spark):
    """60 chunks hold the word, one only a longer word, one only a word of the expansion, one only the ratio's liabilities."""
    texts = {i: "the liquidity " + "pad " * i for i in range(60)}
    texts |= {100: "liquidityish", 101: "receivables", 102: "liabilities", 103: "nothing here"}
    chunks = spark.createDataFrame(list(texts.items()), "chunk_id long, chunk_text string")
    asked = spark.createDataFrame([(1, "liquidity"), (2, "pad")], "query_id long, query string")
    found = {(r["query_id"], r["chunk_id"]) for r in search.lexical_recall(chunks, asked).collect()}
    assert {(1, i) for i in (*range(60), 100, 101, 102)} <= found and (1, 103) not in found
    assert {i for q, i in found if q == 2} == set(range(1, 60))
