"""Approximate nearest neighbours by cross-polytope hashing.

A pseudo-rotation (three rounds of random signs and a fast Hadamard transform) is followed by the nearest
signed axis; that axis is the hash. A bucket of a table is named by as many such hashes as bring its mean
size near ``BUCKET`` rows, the last taken over fewer axes. Queries probe, in every table, the buckets of
least loss (squared distance below the best axis). Candidates are reranked exactly, in double precision,
within the bucket; of each bucket only a query's k best go on.

Where norms differ, vectors get one coordinate more, sqrt(M^2 - |x|^2), and queries a zero there: the
largest inner product is then the smallest angle.

The number of hashes and probes is fitted on a bounded sample: up to 64 queries, whose exact neighbours
are found by a scan of all vectors. The cheapest setting that finds ``recall`` of them is taken; every
vector is indexed. A query that finds fewer than k vectors in its buckets is answered by a blocked scan.

Vectors travel as they are stored (four bytes a component for floats) and are widened where they are scored.

Buckets of more than ``SPLIT`` rows or probes are cut into blocks, each pair of blocks being one task's
group; their sizes come from counts, so one bucket may hold any share of the rows.

Edge cases: vectors that are null, empty, zero, or hold null or non-finite components take no part, nor
rows without id. Vectors of different length are not compared. Of rows that repeat an id, the best scored
counts. An empty table gives no rows. Each vector length is searched by itself, in a loop on the driver:
lengths are expected to be few.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vellum.llm._shared import best, binary, dense, keep, unbinary

TABLES, BUCKET, SPLIT, SAMPLE, MOST_PROBES, LEAST_BITS = 8, 256, 4096, 64, 512, 3
PAIR = "query_id long, vec_id long, score double"


def hadamard(x: np.ndarray) -> np.ndarray:
    """The normalised Walsh-Hadamard transform of rows whose length is a power of two."""
    n, d = x.shape
    h = 1
    while h < d:
        y = x.reshape(n, d // (2 * h), 2, h)
        x = np.stack([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], 2).reshape(n, d)
        h *= 2
    return x / np.sqrt(d)


class CrossPolytope:
    """Hash functions for vectors of one length. ``bits``: log2 of the buckets of a table."""

    def __init__(self, dim: int, top: float, low: float, bits: int, seed: int = 29):
        self.grow = top > low * (1 + 1e-3)
        self.dim, self.top, self.bits = dim, top, bits
        self.width = 1 << (dim + self.grow - 1).bit_length()
        whole = self.width.bit_length()  # log2 of the 2 * width signed axes
        self.axes = [self.width] * (bits // whole) + ([1 << (bits % whole - 1)] if bits % whole else [])
        self.signs = np.random.default_rng([seed, dim]).choice([-1.0, 1.0], (TABLES, len(self.axes), 3, self.width))

    def _rotated(self, x: np.ndarray, query: bool) -> Iterator[tuple[int, int, np.ndarray]]:
        if self.grow:
            more = np.zeros(len(x)) if query else np.sqrt(np.maximum(self.top**2 - (x * x).sum(1), 0))
            x = np.concatenate([x, more[:, None]], 1)
        x = x / np.linalg.norm(x, axis=1)[:, None]
        x = np.pad(x, ((0, 0), (0, self.width - x.shape[1])))
        for t in range(TABLES):
            for j, axes in enumerate(self.axes):
                y = x
                for s in self.signs[t, j]:
                    y = hadamard(y * s)
                yield t, j, y[:, :axes]

    def buckets(self, x: np.ndarray) -> np.ndarray:
        """The bucket of every row in every table, rows x tables."""
        out = np.zeros((len(x), TABLES), np.int64)
        for t, j, y in self._rotated(x, False):
            axis = np.abs(y).argmax(1)
            out[:, t] = out[:, t] * (2 * self.axes[j]) + 2 * axis + (y[np.arange(len(y)), axis] < 0)
        return out

    def probes(self, q: np.ndarray, count: int) -> list[np.ndarray]:
        """For each table the ``count`` buckets of least loss, queries x buckets, best first."""
        best_of = [(np.zeros((len(q), 1)), np.zeros((len(q), 1), np.int64)) for _ in range(TABLES)]
        for t, j, y in self._rotated(q, True):
            signed = np.stack([y, -y], 2).reshape(len(q), -1)
            loss = (signed.max(1, keepdims=True) - signed) ** 2
            order = np.argsort(loss, axis=1, kind="stable")[:, :count]
            losses, codes = best_of[t]
            losses = (losses[:, :, None] + np.take_along_axis(loss, order, 1)[:, None, :]).reshape(len(q), -1)
            codes = (codes[:, :, None] * (2 * self.axes[j]) + order[:, None, :]).reshape(len(q), -1)
            order = np.argsort(losses, axis=1, kind="stable")[:, :count]
            best_of[t] = np.take_along_axis(losses, order, 1), np.take_along_axis(codes, order, 1)
        return [codes for _, codes in best_of]


def _usable(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for ids, x in dense(batch.column(0), batch.column(1)):
        some = (x != 0).any(1)
        if some.any():
            yield ids[some], x[some]


def _profile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen: dict[int, list[float]] = {}
    for batch in batches:
        for _, x in _usable(batch):
            norm = np.linalg.norm(x, axis=1)
            old = seen.setdefault(x.shape[1], [0, np.inf, 0.0])
            seen[x.shape[1]] = [old[0] + len(x), min(old[1], norm.min()), max(old[2], norm.max())]
    for d, (n, low, top) in seen.items():
        yield pa.RecordBatch.from_arrays([pa.array([d], pa.int32()), pa.array([int(n)], pa.int64()), pa.array([float(low)]), pa.array([float(top)])], ["dim", "n", "low", "top"])


def _packed(dim: int, kind: type):
    """Vectors of length ``dim`` as id and bytes; ``kind`` holds every stored component exactly."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, x in _usable(batch):
                if x.shape[1] == dim:
                    yield pa.RecordBatch.from_arrays([pa.array(ids), binary(x.astype(kind))], ["id", "vector"])

    return run


def _wide(column: pa.Array | pa.ChunkedArray, kind: type) -> np.ndarray:
    return unbinary(column, kind).astype(np.float64, copy=False)


def _nearest(queries: np.ndarray, own: np.ndarray, k: int, kind: type):
    """The k best of a batch for each of a few given queries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                ids, x = batch.column(0).to_numpy(), _wide(batch.column(1), kind)
                order = np.argsort(ids, kind="stable")
                ids, x = ids[order], x[order]
                r, c = best(queries @ x.T, ids, own, k)
                yield pa.RecordBatch.from_arrays([pa.array(own[r]), pa.array(ids[c]), pa.array((queries[r] * x[c]).sum(1)), binary(x[c]) if len(c) else pa.array([], pa.binary())], ["query_id", "vec_id", "score", "vector"])

    return run


def _rows(hashes: CrossPolytope, probes: int, kind: type):
    """A row for every table (and probe); ``probes`` 0: data."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                x = _wide(part.column(1), kind)
                codes = hashes.probes(x, probes) if probes else [c[:, None] for c in hashes.buckets(x).T]
                for t, code in enumerate(codes):
                    who = np.repeat(np.arange(len(x)), code.shape[1])
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(code.size, t, np.int32)), pa.array(code.ravel()), part.column(0).take(pa.array(who)), part.column(1).take(pa.array(who))], ["tbl", "bucket", "id", "vector"])

    return run


def _rerank(k: int, kind: type):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        parts = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        if left.num_rows and right.num_rows:
            ids, x = left["id"].to_numpy(), _wide(left["vector"], kind)
            order = np.argsort(ids, kind="stable")
            ids, x = ids[order], x[order]
            own, q = right["id"].to_numpy(), _wide(right["vector"], kind)
            for at in range(0, len(own), 128):
                some, rows = own[at : at + 128], q[at : at + 128]
                r, c = best(rows @ x.T, ids, some, k)
                parts.append((some[r], ids[c], (rows[r] * x[c]).sum(1)))
        out = [np.concatenate(p) for p in zip(*parts, strict=True)]
        return pa.table({"query_id": out[0], "vec_id": out[1], "score": out[2]})

    return run


def _meet(data: DataFrame, asked: DataFrame, k: int, kind: type) -> DataFrame:
    """Reranks the data rows (tbl, bucket, id, vector) against the query rows of the same bucket, large buckets in blocks."""
    counts = data.groupBy("tbl", "bucket").agg(F.count("*").alias("rows"))
    counts = counts.join(asked.groupBy("tbl", "bucket").agg(F.count("*").alias("probes")), ["tbl", "bucket"])
    parts = lambda c: F.ceil(F.col(c) / F.lit(SPLIT)).cast("int")
    large = counts.filter((F.col("rows") > SPLIT) | (F.col("probes") > SPLIT)).select("tbl", "bucket", parts("rows").alias("data_parts"), parts("probes").alias("query_parts"))
    one = lambda c: F.coalesce(F.col(c), F.lit(1))
    each = lambda c: F.explode(F.sequence(F.lit(0), one(c) - 1))
    own = lambda c, seed: F.pmod(F.xxhash64("id", F.lit(seed)), one(c)).cast("int")
    key = ["tbl", "bucket", "data_part", "query_part"]
    left = data.join(large, ["tbl", "bucket"], "left").select("tbl", "bucket", "id", "vector", own("data_parts", 1).alias("data_part"), each("query_parts").alias("query_part"))
    right = asked.join(large, ["tbl", "bucket"], "left").select("tbl", "bucket", "id", "vector", own("query_parts", 2).alias("query_part"), each("data_parts").alias("data_part"))
    return left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(_rerank(k, kind), PAIR)


def _top(found: DataFrame, k: int) -> DataFrame:
    found = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def fit(dim: int, n: int, low: float, top: float, queries: np.ndarray, answers: list[tuple[int, np.ndarray]], recall: float) -> tuple[CrossPolytope, int]:
    """The cheapest hashes and number of probes that find ``recall`` of the answers (query number, vector)."""
    most = max(LEAST_BITS, int(np.log2(max(1, n / BUCKET))))
    choices = []
    for bits in range(most, LEAST_BITS - 1, -1):
        hashes = CrossPolytope(dim, top, low, bits)
        if not answers:
            return hashes, 1
        probes = hashes.probes(queries, MOST_PROBES)
        where = hashes.buckets(np.array([v for _, v in answers]))
        rank = np.full(len(answers), MOST_PROBES)
        for t in range(TABLES):
            hit = probes[t][[i for i, _ in answers]] == where[:, t : t + 1]
            rank = np.minimum(rank, np.where(hit.any(1), hit.argmax(1), MOST_PROBES))
        need = int(np.sort(rank)[int(np.ceil(recall * len(rank))) - 1]) + 1
        choices.append((need / 2**bits if need <= MOST_PROBES else np.inf, -bits, hashes, need))
    _, _, hashes, need = min(choices, key=lambda c: c[:2])
    return hashes, min(need, 1 << hashes.bits)


def search(vectors: DataFrame, queries: DataFrame, k: int = 20, recall: float = 0.96) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest vectors found for each query but itself.

    Both frames hold a long id and an array of numbers, in this order."""
    out = None
    narrow = [df.schema[df.columns[1]].dataType.elementType.typeName() == "float" for df in (vectors, queries)]
    kind = np.float32 if all(narrow) else np.float64
    profile = vectors.mapInArrow(_profile, "dim int, n long, low double, top double")
    for row in profile.groupBy("dim").agg(F.sum("n").alias("n"), F.min("low").alias("low"), F.max("top").alias("top")).orderBy("dim").collect():  # a row a vector length
        dim = row["dim"]
        data, asked = (df.mapInArrow(_packed(dim, kind), "id long, vector binary") for df in (vectors, queries))
        sample = asked.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).collect()
        own, q = np.array([r["id"] for r in sample], np.int64), np.array([np.frombuffer(r["vector"], kind) for r in sample], np.float64).reshape(-1, dim)
        answers = []
        if len(own):
            near = data.mapInArrow(_nearest(q, own, k, kind), f"{PAIR}, vector binary")
            rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
            at = {int(i): j for j, i in enumerate(own)}
            answers = [(at[r["query_id"]], np.frombuffer(r["vector"])) for r in near.withColumn("rank", rank).filter(F.col("rank") <= k).collect()]
        hashes, probes = fit(dim, row["n"], row["low"], row["top"], q, answers, recall)
        schema = "tbl int, bucket long, id long, vector binary"
        met = _meet(data.mapInArrow(_rows(hashes, 0, kind), schema), asked.mapInArrow(_rows(hashes, probes, kind), schema), k, kind)
        found = keep(_top(met, k), "ann-found")
        full = min(k, row["n"] - 1)
        few = asked.join(found.filter(F.col("rank") == full).select(F.col("query_id").alias("id")), "id", "left_anti") if full > 0 else asked.limit(0)
        if few.limit(1).count():
            whole = lambda df: df.select(F.lit(0).alias("tbl"), F.lit(0).cast("long").alias("bucket"), "id", "vector")
            again = _top(_meet(whole(data), whole(few), k, kind), k)
            found = found.join(few.select(F.col("id").alias("query_id")).distinct(), "query_id", "left_anti").unionByName(again)
        out = found if out is None else out.unionByName(found)
    if out is None:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    return out
