"""Language ID: multinomial naive Bayes over hashed character n-grams.

Training counts the n-grams (1 to 3 characters, lower case) of every training text into ``BUCKETS`` hash
buckets a language, in numpy within partitions, then by a Spark aggregate. The smoothed log-probability
matrix, languages x buckets, is broadcast; texts are scored in batches, one gather and one segmented sum
for all their n-grams.

The matrix takes 4 bytes x BUCKETS x languages; more than ``MOST_LANGUAGES`` languages are refused, so it
stays under 128 MB.

Edge cases: a text that is null or has no letters, or a model that has learned nothing, gives ``und`` with
score 0. Ties go to the language first in code point order. Repeated rows count each. Other columns pass
through untouched; those named like the results are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

BUCKETS, ORDERS, SMOOTHING, CHUNK, MOST_LANGUAGES = 1 << 15, 3, 0.5, 1 << 19, 1000
DOUBT = 3.0  # deviations that a text's evidence may lack
_FACTORS = [np.uint32(x) for x in (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D)]


def _chunks(texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Code points of some texts, the row of each text or piece of one, and where each begins. A text longer than a chunk comes in pieces, each with the start of the next."""
    held, rows, size = [], [], 0
    for i, text in enumerate(texts):
        text = (text or "").lower()
        for at in range(0, len(text), CHUNK):
            piece = text[at : at + CHUNK + ORDERS - 1]
            if held and size + len(piece) > CHUNK:
                yield _points(held, rows)
                held, rows, size = [], [], 0
            held.append(piece)
            rows.append(i)
            size += len(piece)
    if held:
        yield _points(held, rows)


def _points(held: list[str], rows: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    points = np.frombuffer("".join(held).encode("utf-32-le", "surrogatepass"), np.uint32)
    return points, np.array(rows), np.concatenate([[0], np.cumsum([len(t) for t in held])])


def _buckets(points: np.ndarray, bounds: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each order the bucket of the n-gram at every place, and whether it lies within one text and begins in this piece of it."""
    at = np.arange(len(points))
    rest = np.repeat(bounds[1:], np.diff(bounds)) - at
    own = at - np.repeat(bounds[:-1], np.diff(bounds)) < CHUNK
    h = np.zeros(len(points), np.uint32)
    for order in range(ORDERS):
        h[: len(points) - order] ^= points[order:] * _FACTORS[order]
        h *= np.uint32(0x01000193)
        yield (h ^ (h >> np.uint32(15))) % np.uint32(BUCKETS), (rest > order) & own


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """lang, text -> lang, bucket, n; bucket -1 counts texts."""
    counts: dict[str, np.ndarray] = {}
    for batch in batches:
        langs, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        for lang in set(langs):
            own = counts.setdefault(lang, np.zeros(BUCKETS + 1, np.int64))
            own[BUCKETS] += langs.count(lang)
            for points, _, bounds in _chunks([t for x, t in zip(langs, texts, strict=True) if x == lang]):
                for bucket, whole in _buckets(points, bounds):
                    own[:BUCKETS] += np.bincount(bucket[whole], minlength=BUCKETS)
        if len(counts) > 64:  # many languages: hand over what there is
            yield from _told(counts)
            counts = {}
    yield from _told(counts)


def _told(counts: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
    for lang, own in counts.items():
        some = np.flatnonzero(own)
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(some), pa.string()), pa.array(np.where(some == BUCKETS, -1, some).astype(np.int32)), pa.array(own[some])], ["lang", "bucket", "n"])


class Model:
    """languages, log prior and log-probability matrix (buckets x languages, with a row of zeros at the end)."""

    def __init__(self, languages: list[str], prior: np.ndarray, table: np.ndarray):
        self.languages, self.prior, self.table = languages, prior, table

    def totals(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Log-likelihood of each text in each language, with the prior, and the number of its n-grams."""
        total, grams = np.tile(self.prior, (len(texts), 1)), np.zeros(len(texts))
        for points, rows, bounds in _chunks(texts):
            for bucket, whole in _buckets(points, bounds):
                np.add.at(grams, rows, np.add.reduceat(whole, bounds[:-1], dtype=np.float64))
                bucket = np.where(whole, bucket, BUCKETS)
                for lang in range(len(self.languages)):
                    np.add.at(total[:, lang], rows, np.add.reduceat(self.table[lang].take(bucket), bounds[:-1], dtype=np.float64))
        return total, grams

    def posterior(self, texts: list[str | None]) -> np.ndarray:
        return _shares(self.totals(texts)[0])

    @cached_property
    def expected(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Log-likelihood a n-gram of texts of each language (row) in each (column) by the model itself, its deviation,
        and the mean and deviation of the row's lead over the column."""
        logs = self.table[:, :-1].astype(np.float64)
        shares = np.exp(logs)
        shares /= shares.sum(1, keepdims=True)
        mean, square = shares @ logs.T, shares @ (logs**2).T
        own, own_square = np.diag(mean), np.diag(square)
        lead = own[:, None] - mean
        both = np.array([(p * x) @ logs.T for p, x in zip(shares, logs, strict=True)])
        return mean, np.sqrt(np.maximum(own_square - own**2, 0)), lead, np.sqrt(np.maximum(own_square[:, None] + square - 2 * both - lead**2, 0))

    def evidence(self, total: np.ndarray, grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Lead and misfit of each text, a n-gram, so neither saturates with length; both benefit from the doubt a short text leaves.

        Lead: that of the best language over the next, 1 as in a text of one language, 1 - 2 f if a share f is in the next.
        Misfit: 0 as in a text of the best language, 1 as in one of the language most like it."""
        mean, spread, lead, lead_spread = self.expected
        each = (total - self.prior) / np.maximum(grams, 1)[:, None]
        order, at = np.argsort(-each, axis=1, kind="stable"), np.arange(len(each))
        best = order[:, 0]
        doubt = DOUBT * np.sqrt(ORDERS / np.maximum(grams, 1))  # the orders overlap
        if len(self.languages) < 2:
            return np.ones(len(each)), np.zeros(len(each))
        after = order[:, 1]
        wanted = lead[best, after]
        leads = np.where(wanted > 0, (each[at, best] - each[at, after] + doubt * lead_spread[best, after]) / np.where(wanted > 0, wanted, 1), 1.0)
        apart = np.diag(mean)[:, None] - mean.T  # [b, y]: how much less a text of y fits b than one of b does
        apart = np.where(np.eye(len(apart), dtype=bool) | (apart <= 0), np.inf, apart).min(1)
        return leads, (mean[best, best] - each[at, best] - doubt * spread[best]) / apart[best]


def _shares(total: np.ndarray) -> np.ndarray:
    total = np.exp(total - total.max(1, keepdims=True))
    return total / total.sum(1, keepdims=True)


def train(labelled: DataFrame) -> Model:
    """A model of all rows (lang, text) that have both."""
    rows = labelled.filter("lang IS NOT NULL AND text IS NOT NULL").select("lang", "text")
    counts = rows.mapInArrow(_count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    # a row a language, its counts packed into arrays; BUCKETS values at most
    packed = counts.groupBy("lang").agg(F.collect_list(F.struct("bucket", "n")).alias("told")).orderBy("lang")
    languages, totals, tables = [], [], []
    for row in packed.toLocalIterator():
        if len(languages) == MOST_LANGUAGES:
            raise ValueError(f"more than {MOST_LANGUAGES} languages")
        own = np.zeros(BUCKETS)
        texts = 0
        for bucket, n in row["told"]:
            if bucket < 0:
                texts = n
            else:
                own[bucket] = n
        languages.append(row["lang"])
        totals.append(texts)
        logs = np.log((own + SMOOTHING) / (own.sum() + SMOOTHING * BUCKETS))
        tables.append(np.concatenate([logs, [0.0]]).astype(np.float32))
    prior = np.log(np.array(totals, float) / max(sum(totals), 1)) if languages else np.zeros(0)
    return Model(languages, prior, np.array(tables))


def words_only(text: Column) -> Column:
    """Words of letters: those with digits, @ or _ go (numbers, addresses, keys), and all punctuation, which no language owns."""
    return F.regexp_replace(F.regexp_replace(text, r"\S*[\p{N}@_]\S*", " "), r"[^\p{L}\p{M}\s]+", "")


def predict(docs: DataFrame, model: Model, evidence: bool = False) -> DataFrame:
    """``docs`` with lang_pred and score, the posterior probability of that language; with ``evidence`` also lead and misfit (see ``Model.evidence``), 0 where ``und``."""
    more = ["lead", "misfit"] if evidence else []
    docs = docs.drop("lang_pred", "score", *more)
    told = docs.withColumn("_letters", F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)))
    given = docs.sparkSession.sparkContext.broadcast(model)
    schema = T.StructType([*docs.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), *(T.StructField(x, T.DoubleType()) for x in more)])
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = given.value
        for batch in batches:
            letters = batch.column(batch.num_columns - 1).to_pylist()
            names, scores, told = ["und"] * len(letters), np.zeros(len(letters)), np.zeros((len(more), len(letters)))
            some = [i for i, x in enumerate(letters) if x and known.languages]
            if some:
                texts = batch.column(at).take(pa.array(some)).to_pylist()
                total, grams = known.totals(texts)
                sure = _shares(total)
                if more:
                    told[:, some] = known.evidence(total, grams)
                best = sure.argmax(1)
                scores[some] = sure[np.arange(len(some)), best]
                for i, b in zip(some, best.tolist(), strict=True):
                    names[i] = known.languages[b]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(names, pa.string()), pa.array(scores), *map(pa.array, told)], schema=_arrow(batch, len(letters)))

    def _arrow(batch: pa.RecordBatch, n: int) -> pa.Schema:
        return pa.schema([*list(batch.schema)[:-1], pa.field("lang_pred", pa.string()), pa.field("score", pa.float64()), *(pa.field(x, pa.float64()) for x in more)])

    return told.mapInArrow(run, schema)


def held_out(parts: int, left: int):
    """Whether a document is kept from training: crc32 of its id's text, modulo ``parts``, is ``left``."""
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(parts)) == left, F.lit(False))
