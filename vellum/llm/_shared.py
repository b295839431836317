"""Pieces that several operators share: scratch tables, Arrow slices, byte-level words, dense vectors."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
#: Java and RE2 pattern of a word: the bytes above separate, all else belongs to words.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"

_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_BYTE = np.random.default_rng(20240607).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_BYTE[SPACE] = 0
_LOWER = _BYTE.copy()
_LOWER[ord("A") : ord("Z") + 1] = _BYTE[ord("a") : ord("z") + 1]
_powers: tuple[np.ndarray, np.ndarray] = (np.ones(0, np.uint64), np.ones(0, np.uint64))


def scratch_root(spark: SparkSession) -> str:
    """The shared folder of the session. Only a plain local session may go without the setting; it gets a folder of its own."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    root = tempfile.mkdtemp(prefix="vellum-")
    spark.conf.set("spark.checkpoint.dir", root)
    return root


def keep(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared scratch folder: cuts the lineage, and a lost executor costs no more than a reread."""
    spark = df.sparkSession
    path = f"{scratch_root(spark)}/vellum/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_kept(spark: SparkSession) -> None:
    """Deletes the session's scratch tables. Call it once no result that reads them is needed."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(f"{scratch_root(spark)}/vellum/{spark.sparkContext.applicationId}")
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def mix(h: np.ndarray) -> np.ndarray:
    """Bijective finaliser over uint64."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the hash base and of its inverse modulo 2**64."""
    global _powers
    if len(_powers[0]) < n:
        size = max(1 << 16, 1 << (n - 1).bit_length())
        a, b = np.full(size, _BASE, np.uint64), np.full(size, _INVERSE, np.uint64)
        a[0] = b[0] = 1
        made = np.cumprod(a, dtype=np.uint64), np.cumprod(b, dtype=np.uint64)
        if size > 1 << 23:  # for one huge text; not worth holding on to
            return made
        _powers = made
    return _powers


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and its n + 1 row offsets; null rows are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    _, where, data = column.buffers()
    kind = np.int64 if wide else np.int32
    offsets = np.frombuffer(where, kind, count=column.offset + len(column) + 1)[column.offset :].astype(np.int64) if len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(offsets: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``limit`` bytes each; a longer row comes alone."""
    start, n = 0, len(offsets) - 1
    while start < n:
        end = int(np.searchsorted(offsets, offsets[start] + limit, side="right")) - 1
        end = min(n, max(start + 1, end))
        yield start, end
        start = end


def words(data: np.ndarray, offsets: np.ndarray, lower: bool) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hash and row of every word in the rows of ``data``, in text order. ``lower``: A-Z count as a-z."""
    solid = ~SPACE[data]
    first = solid.copy()
    first[1:] &= ~solid[:-1]
    heads = offsets[:-1][offsets[:-1] < offsets[1:]]
    first[heads] = solid[heads]
    starts = np.flatnonzero(first)
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    power, inverse = powers(len(data))
    values = (_LOWER if lower else _BYTE)[data]
    values *= power[: len(data)]
    h = np.add.reduceat(values, starts)
    h *= inverse[starts]
    return mix(h), np.searchsorted(offsets, starts, side="right") - 1


def binary(rows: np.ndarray) -> pa.Array:
    """A 2-d array as a binary column, one value a row."""
    rows = np.ascontiguousarray(rows)
    n, width = rows.shape[0], rows.dtype.itemsize * int(np.prod(rows.shape[1:]))
    offsets = (np.arange(n + 1, dtype=np.int64) * width).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(offsets), pa.py_buffer(rows)])


def unbinary(column: pa.Array | pa.ChunkedArray, dtype: np.dtype) -> np.ndarray:
    """The inverse of :func:`binary` for rows of equal width."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not len(column):
        return np.zeros((0, 0), dtype)
    _, where, data = column.buffers()
    offsets = np.frombuffer(where, np.int32, count=column.offset + len(column) + 1)[column.offset :]
    return np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]].reshape(len(column), -1).copy().view(dtype)


def dense(ids: pa.Array, vectors: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """(ids, float64 rows) for each vector length in a batch, without rows whose id or vector is null, empty, or holds null or non-finite values."""
    if not len(ids):
        return []
    where = np.asarray(vectors.offsets, dtype=np.int64)
    flat = vectors.values.to_numpy(zero_copy_only=False).astype(np.float64)
    length = np.diff(where)
    bad = np.concatenate([[0], np.cumsum(~np.isfinite(flat))])
    good = np.asarray(ids.is_valid()) & np.asarray(vectors.is_valid()) & (length > 0) & (bad[where[1:]] == bad[where[:-1]])
    key = np.asarray(ids.fill_null(0), dtype=np.int64)
    out = []
    for d in np.unique(length[good]):
        rows = np.flatnonzero(good & (length == d))
        out.append((key[rows], flat[where[rows][:, None] + np.arange(d)]))
    return out


def best(scores: np.ndarray, ids: np.ndarray, own: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and column numbers of the k largest scores of each row, ties to smaller ids, without columns whose id is the row's own. ``ids`` ascend."""
    scores = np.where(ids[None, :] == own[:, None], -np.inf, scores)
    n = scores.shape[1]
    floor = np.partition(scores, n - k, axis=1)[:, n - k] if n > k else np.full(len(scores), -np.inf)
    rows, cols = np.nonzero((scores >= floor[:, None]) & (scores > -np.inf))
    order = np.lexsort((cols, -scores[rows, cols], rows))
    rows, cols = rows[order], cols[order]
    rank = np.arange(len(rows)) - np.searchsorted(rows, rows, side="left")
    return rows[rank < k], cols[rank < k]
