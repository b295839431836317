"""Exact top-k search with a vector-approximation file.

Vectors are integers; each component is approximated by one of at most 256 cells (a byte), whose edges come
from a bounded sample of vectors and whose outer bounds are those of all vectors. Cells of whole blocks are
scanned for bounds of the inner product. A query's k-th largest lower bound rules out all vectors whose
upper bound is less. Those left are read exactly in two rounds, by falling upper bound (nearest possible
first): the first 2 k of them, then those whose upper bound still reaches the k-th exact score found, after
which the k-th result is certain.

Blocks of queries meet blocks of cells; both are bounded in rows, and only cells (a byte a component) are
repeated for the blocks of queries. Exact vectors are sent once for each query that still needs them, and no
task holds more of a query's survivors than the first round and those that reach its k-th score.

Each vector length is searched by itself, in a loop on the driver: lengths are expected to be few.

Edge cases: vectors that are null, empty, or hold null or non-finite components take no part, nor rows
without id. Vectors of different length are not compared. Of rows that repeat an id, the best scored
counts. Scores beyond a long are clamped to it after ranking. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vellum.llm._shared import binary, dense, keep, unbinary

CELLS, SAMPLE, DATA_BLOCK, QUERY_BLOCK = 256, 4096, 16384, 256
_EXACT = float(1 << 53)


def _profile(scale: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[int, list] = {}
        for batch in batches:
            for _, x in dense(batch.column(0), batch.column(1)):
                x = np.floor(scale * x)
                old = seen.setdefault(x.shape[1], [0, x.min(0), x.max(0)])
                old[0] += len(x)
                old[1], old[2] = np.minimum(old[1], x.min(0)), np.maximum(old[2], x.max(0))
        for d, (n, low, high) in seen.items():
            yield pa.RecordBatch.from_arrays([pa.array([d] * d, pa.int32()), pa.array(range(d), pa.int32()), pa.array(low), pa.array(high), pa.array([n] * d, pa.int64())], ["dim", "at", "low", "high", "n"])

    return run


def _packed(scale: float, dim: int):
    """Vectors of length ``dim`` as id and float64 bytes of the floors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, x in dense(batch.column(0), batch.column(1)):
                if x.shape[1] == dim:
                    yield pa.RecordBatch.from_arrays([pa.array(ids), binary(np.floor(scale * x))], ["id", "vector"])

    return run


class Cells:
    """Edges of the cells of each component and the bounds that they stand for."""

    def __init__(self, sample: np.ndarray, low: np.ndarray, high: np.ndarray):
        inner = [np.unique(np.ceil(np.quantile(sample[:, d], np.arange(1, CELLS) / CELLS))) if len(sample) else np.zeros(0) for d in range(len(low))]
        self.edges = [e[(e > a) & (e <= b)] for e, a, b in zip(inner, low, high, strict=True)]
        most = max((len(e) for e in self.edges), default=0) + 1
        self.middle, self.half = np.zeros((len(low), most)), np.zeros((len(low), most))
        for d, e in enumerate(self.edges):
            # cell j holds edges[j - 1] <= value < edges[j]; values are whole numbers
            a, b = np.concatenate([[low[d]], e]), np.concatenate([np.maximum(e - 1, low[d]), [high[d]]])
            self.middle[d, : len(a)], self.half[d, : len(a)] = (a + b) / 2, (b - a) / 2

    def encode(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, d], side="right") for d, e in enumerate(self.edges)], 1).astype(np.uint8)

    def spread(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.arange(codes.shape[1])
        return self.middle[at, codes], self.half[at, codes]


def _encode(cells: Cells):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([batch.column(0), binary(cells.encode(unbinary(batch.column(1), np.float64)))], ["id", "cells"])

    return run


def _scan(cells: Cells, k: int):
    """Of a block of cells and a block of queries: the pairs whose upper bound reaches the query's k-th lower bound within the block."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), np.zeros(0)]
        if left.num_rows and right.num_rows:
            ids, codes = left["id"].to_numpy(), unbinary(left["cells"], np.uint8)
            order = np.argsort(ids, kind="stable")
            ids, codes = ids[order], codes[order]
            first = np.flatnonzero(np.concatenate([[True], ids[1:] != ids[:-1]]))
            middle, half = cells.spread(codes)
            queries, q = right["id"].to_numpy(), unbinary(right["vector"], np.float64)
            parts = []
            for at in range(0, len(queries), 64):
                own, rows = queries[at : at + 64], q[at : at + 64]
                centre, width = rows @ middle.T, np.abs(rows) @ half.T
                slack = (np.abs(rows) @ (np.abs(middle) + half).T) * 1e-12
                slack[slack < _EXACT * 1e-12] = 0  # whole and half numbers below 2**53 are exact
                low, high = centre - width - slack, centre + width + slack
                if len(first) < len(ids):
                    low, high = np.maximum.reduceat(low, first, axis=1), np.maximum.reduceat(high, first, axis=1)
                names = ids[first]
                same = names[None, :] == own[:, None]
                low[same] = high[same] = -np.inf
                n = low.shape[1]
                floor = np.partition(low, n - k, axis=1)[:, n - k] if n > k else np.full(len(low), -np.inf)
                r, c = np.nonzero((high >= floor[:, None]) & (high > -np.inf))
                parts.append((own[r], names[c], low[r, c], high[r, c]))
            out = [np.concatenate(p) for p in zip(*parts, strict=True)]
            if len(np.unique(queries)) < len(queries):  # a repeated query scores a vector by its better row
                order = np.lexsort((out[1], out[0]))
                out = [p[order] for p in out]
                heads = np.flatnonzero(np.concatenate([[True], (out[0][1:] != out[0][:-1]) | (out[1][1:] != out[1][:-1])])) if len(order) else order
                out = [out[0][heads], out[1][heads], *(np.maximum.reduceat(p, heads) if len(heads) else p for p in out[2:])]
        return pa.table({"query_id": out[0], "vec_id": out[1], "low": out[2], "high": out[3]})

    return run


def _dots(x: np.ndarray, q: np.ndarray) -> list[int] | np.ndarray:
    """Exact inner products of whole numbers."""
    if float(np.abs(x).max(initial=0)) * float(np.abs(q).max(initial=0)) * x.shape[1] < _EXACT:
        return (x @ q).astype(np.int64)
    whole = [int(v) for v in q]
    return [sum(int(a) * b for a, b in zip(row, whole, strict=True)) for row in x]


def _refine(k: int):
    """Of the queries of a block and their surviving vectors: the exact k best."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        rows: list[tuple[int, int, int, int]] = []
        if left.num_rows and right.num_rows:
            owner, ids, high, x = left["query_id"].to_numpy(), left["vec_id"].to_numpy(), left["high"].to_numpy(), unbinary(left["vector"], np.float64)
            order = np.lexsort((ids, -high, owner))
            owner, ids, high, x = owner[order], ids[order], high[order], x[order]
            queries, q = right["id"].to_numpy(), unbinary(right["vector"], np.float64)
            found: dict[int, dict[int, int]] = {}
            for query, vector in zip(queries.tolist(), q, strict=True):
                a, b = np.searchsorted(owner, [query, query + 1])
                got = found.setdefault(query, {})
                while a < b:
                    last = min(b, a + 2 * k)
                    for name, score in zip(ids[a:last].tolist(), _dots(x[a:last], vector), strict=True):
                        got[name] = max(got.get(name, score), score)
                    a = last
                    if len(got) >= k and a < b and sorted(got.values(), reverse=True)[k - 1] > high[a]:
                        break
            for query, got in found.items():
                for rank, (name, score) in enumerate(sorted(got.items(), key=lambda p: (-p[1], p[0]))[:k], 1):
                    rows.append((query, rank, name, min(max(int(score), -(1 << 63)), (1 << 63) - 1)))
        kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64())
        columns = zip(*rows, strict=True) if rows else [[]] * 4
        return pa.table([pa.array(list(c), t) for c, t in zip(columns, kinds, strict=True)], ["query_id", "rank", "vec_id", "score"])

    return run


def exact_top_k(vectors: DataFrame, queries: DataFrame, k: int = 20, scale: float = 64.0) -> DataFrame:
    """The k vectors of largest inner product of floor(scale * x), for each query but itself.

    Both frames hold a long id and an array of numbers, in this order."""
    spark = vectors.sparkSession
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    profile = vectors.mapInArrow(_profile(scale), "dim int, at int, low double, high double, n long")
    profile = profile.groupBy("dim", "at").agg(F.min("low").alias("low"), F.max("high").alias("high"), F.sum("n").alias("n")).orderBy("dim", "at").collect()  # a row a component
    out = empty
    for dim in sorted({r["dim"] for r in profile}):
        rows = [r for r in profile if r["dim"] == dim]
        n, low, high = rows[0]["n"], np.array([r["low"] for r in rows]), np.array([r["high"] for r in rows])
        data = vectors.mapInArrow(_packed(scale, dim), "id long, vector binary")
        asked = queries.mapInArrow(_packed(scale, dim), "id long, vector binary")
        sample = data.filter(F.pmod(F.xxhash64("id"), F.lit(max(1, n // SAMPLE))) == 0).limit(2 * SAMPLE).collect()
        cells = Cells(np.array([np.frombuffer(r["vector"]) for r in sample]).reshape(-1, dim), low, high)
        n_queries = asked.count()
        blocks, groups = max(4, -(-n // DATA_BLOCK)), max(4, -(-n_queries // QUERY_BLOCK))
        each = lambda name, count: F.explode(F.sequence(F.lit(0), F.lit(count - 1))).alias(name)
        block = lambda name, count: F.pmod(F.xxhash64("id"), F.lit(count)).cast("int").alias(name)
        coded = data.mapInArrow(_encode(cells), "id long, cells binary").select("id", "cells", block("block", blocks), each("group", groups))
        met = asked.select("id", "vector", block("group", groups), each("block", blocks))
        pairs = coded.groupBy("block", "group").cogroup(met.groupBy("block", "group")).applyInArrow(_scan(cells, k), "query_id long, vec_id long, low double, high double")
        pairs = keep(pairs, "va-bounds")
        # the k-th largest lower bound: Spark keeps k rows of a query in each task before the shuffle
        rank = lambda by: F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc(by), "vec_id"))
        kth = pairs.select("query_id", "vec_id", "low").withColumn("at", rank("low")).filter(F.col("at") <= k)
        kth = kth.groupBy("query_id").agg(F.when(F.count("*") == k, F.min("low")).alias("kth"))
        left = pairs.join(kth, "query_id").filter(F.col("kth").isNull() | (F.col("high") >= F.col("kth"))).select("query_id", "vec_id", "high")
        left = keep(left.withColumn("at", rank("high")), "va-survivors")
        exact = data.select(F.col("id").alias("vec_id"), "vector")
        first = keep(left.filter(F.col("at") <= 2 * k).join(exact, "vec_id").select("query_id", "vec_id", "high", "vector"), "va-first")
        keyed = lambda df, name: df.withColumn("group", F.pmod(F.xxhash64(name), F.lit(4 * groups)))
        asked = keyed(asked, "id")
        refined = lambda rows: keyed(rows, "query_id").groupBy("group").cogroup(asked.groupBy("group")).applyInArrow(_refine(k), "query_id long, rank int, vec_id long, score long")
        # the k-th exact score so far, a little less for the rounding of scores beyond 2**53; clamped ones rule nothing out
        certain = F.col("score").cast("double") - F.abs(F.col("score").cast("double")) * 1e-12
        told = refined(first).filter((F.col("rank") == k) & (F.col("score") > -(1 << 63))).select("query_id", F.when(F.abs("score") < 1 << 53, F.col("score").cast("double")).otherwise(certain).alias("certain"))
        rest = left.filter(F.col("at") > 2 * k).join(told, "query_id", "left").filter(F.col("certain").isNull() | (F.col("high") >= F.col("certain")))
        second = rest.select("query_id", "vec_id", "high").join(exact, "vec_id").select("query_id", "vec_id", "high", "vector")
        out = out.unionByName(refined(first.unionByName(second)))
    return out
