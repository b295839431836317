"""Nearest neighbours and exact search against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.helpers import crowded
from vellum.llm import ann, exact

SCHEMA = "vec_id long, embedding array<float>"


def brute(rows, k, scale=None):
    """query -> [(vec_id, score)], each id by its best row."""
    usable = [(i, np.floor(scale * np.array(v, float)) if scale else np.array(v, float)) for i, v in rows if i is not None and v and None not in v and np.isfinite(np.array(v, float)).all() and (scale or np.any(v))]
    out = {}
    for i, q in usable:
        if i % 20 == 0:
            got = out.setdefault(i, {})
            for j, x in usable:
                if j != i and len(x) == len(q):
                    got[j] = max(got.get(j, -np.inf), float(x @ q))
    return {i: sorted(got.items(), key=lambda p: (-p[1], p[0]))[:k] for i, got in out.items()}


def awkward():
    rng = np.random.default_rng(3)
    rows = [(i, [float(np.float32(x)) for x in rng.normal(size=6)]) for i in range(400)]
    rows += [(1000 + i, [1.0, 0.0, 0.0, 0.0, 0.0, 0.0]) for i in range(60)]  # equal vectors
    rows += [(rows[20][0], rows[20][1]), (40, [0.5] * 6)]  # a repeated row, a repeated id
    rows += [(2000, None), (2020, []), (2040, [None] * 6), (2060, [float("nan")] * 6), (2080, [float("inf")] * 6), (None, [1.0] * 6), (2100, [0.0] * 6), (2120, [1.0, 2.0]), (2121, [2.0, 2.0])]
    return rows


def test_exact_top_k(spark):
    rows = awkward()
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    got = {}
    for r in exact.exact_top_k(df, df.filter("vec_id % 20 = 0"), k=7).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    assert got == {i: [(j, int(s)) for j, s in best] for i, best in brute(rows, 7, 64.0).items() if best}


def test_clashing_columns(spark):
    """Columns named like the operators' own, after the two that are read."""
    df = crowded(spark.createDataFrame(awkward(), SCHEMA).repartition(3)).withColumns({"vector": F.lit("mine"), "high": F.lit(1), "bucket": F.lit(2)})
    pair = df.select("vec_id", "embedding", "score", "rank", "vector", "high", "bucket")
    plain = df.select("vec_id", "embedding")
    some = "vec_id % 20 = 0"
    assert sorted(exact.exact_top_k(pair, pair.filter(some), k=3).collect()) == sorted(exact.exact_top_k(plain, plain.filter(some), k=3).collect())
    assert sorted(ann.search(pair, pair.filter(some), k=3).collect()) == sorted(ann.search(plain, plain.filter(some), k=3).collect())


def test_exact_reads_in_rounds(spark, monkeypatch):
    """With two cells a component nearly all survive the bounds; the result stays exact."""
    monkeypatch.setattr(exact, "CELLS", 2)
    rng = np.random.default_rng(14)
    rows = [(i, [float(np.float32(x)) for x in rng.normal(size=5)]) for i in range(500)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = {}
    for r in exact.exact_top_k(df, df.filter("vec_id % 20 = 0"), k=4).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    assert got == {i: [(j, int(s)) for j, s in best] for i, best in brute(rows, 4, 64.0).items()}


def test_exact_with_large_numbers(spark):
    rows = [(i, [float(10**9 * (i + 1)), float(i), 3.0]) for i in range(45)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = [(r["query_id"], r["vec_id"], r["score"]) for r in exact.exact_top_k(df, df.filter("vec_id % 20 = 0"), k=3).orderBy("query_id", "rank").collect()]
    whole = {i: [int(64 * x) for x in v] for i, v in rows}
    want = []
    for q in (0, 20, 40):
        best = sorted(((sum(a * b for a, b in zip(whole[q], whole[j], strict=True)), -j) for j in whole if j != q), reverse=True)[:3]
        want += [(q, -j, min(s, 2**63 - 1)) for s, j in best]
    assert got == want


@pytest.mark.parametrize("spread", [False, True])
def test_search_recall(spark, spread):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(4000, 24))
    x /= np.linalg.norm(x, axis=1)[:, None]
    if spread:
        x *= rng.uniform(0.2, 3.0, (4000, 1))
    rows = [(i, [float(a) for a in v]) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4)
    want = brute(rows, 10)
    hits = 0
    for r in ann.search(df, df.filter("vec_id % 20 = 0"), k=10).collect():
        near = dict(want[r["query_id"]])
        if r["vec_id"] in near:
            hits += 1
            assert abs(near[r["vec_id"]] - r["score"]) < 1e-12
    assert hits / sum(map(len, want.values())) >= 0.9


def test_search_awkward(spark):
    rows = awkward()
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    want = brute(rows, 5)
    got = {}
    for r in ann.search(df, df.filter("vec_id % 20 = 0"), k=5).orderBy("query_id", "rank").collect():
        assert r["rank"] == len(got.setdefault(r["query_id"], [])) + 1
        got[r["query_id"]].append(r["vec_id"])
    assert set(got) == {i for i, best in want.items() if best}
    assert {i: len(v) for i, v in got.items()} == {i: len(v) for i, v in want.items() if v}
    found = sum(len({j for j, _ in want[i]} & set(v)) for i, v in got.items())
    assert found >= 0.9 * sum(len(v) for v in want.values())


def test_empty(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert ann.search(df, df).collect() == [] == exact.exact_top_k(df, df).collect()


def test_hadamard_keeps_norms():
    x = np.random.default_rng(1).normal(size=(5, 16))
    assert np.allclose(np.linalg.norm(ann.hadamard(x), axis=1), np.linalg.norm(x, axis=1))
    assert np.allclose(ann.hadamard(ann.hadamard(x)), x)
