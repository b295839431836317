"""Quality classifier: ordinal cumulative-link regression on graded ratings.

Texts become hashed features: words (A-Z as a-z), runs of punctuation and a feature for words in capitals, each
weighing log(1 + count), scaled to unit length; and one feature for how repetitive a text is: how often its most
frequent pair of adjacent units (words or punctuation) occurs, and what share of all pairs that is, both by powers
of two (the top 2-gram of published repetition filters, without a fitted threshold), weighing 1. One weight vector serves all grades; ordered thresholds
cut its score: P(grade > j) = sigmoid(w.x - t_j), t_0 < t_1 < ... . Their sum over j is the expected grade;
P(grade >= g) is the tail probability by which documents are selected.

Only features whose share of texts differs clearly between grades are fitted, and weights are at most 0: a
text loses grade by what it has, not by what it lacks, so short texts and unknown words do no harm.

Grades from labels: 0 poor, 1 fair but toxic, 2 clean. The model is fitted on at most ``SAMPLE`` labelled
documents of each grade (those of least id hash), found through a join with the bounded sample of labels,
so texts are not shuffled; of each sampled doc_id one text's features (least hash, where a doc_id repeats) reach the driver. Scoring covers every document, with the
weights broadcast (a fixed 2**18 of them).

Edge cases: documents without text, or with white space only, get the features of an empty text. Labels
with a null id or null quality count as no labels; of several labels of one document the worst counts.
Without labels of two grades at least, every document gets the one known grade (the top one, if none).
Repeated rows get equal results. Columns named like the results are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vellum.llm._shared import SPACE, mix, powers, slices, text_bytes

GRADES, DIMENSIONS, SAMPLE, CHUNK = 3, 1 << 18, 3000, 1 << 21
_VALUE = np.random.default_rng(31).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_VALUE[SPACE] = 0
_VALUE[ord("A") : ord("Z") + 1] = _VALUE[ord("a") : ord("z") + 1]
_WORD = np.zeros(256, np.uint8)  # 0 space, 1 punctuation, 2 word
_WORD[~SPACE] = 1
_WORD[[*range(ord("0"), ord("9") + 1), *range(ord("A"), ord("Z") + 1), *range(ord("a"), ord("z") + 1), *range(128, 256)]] = 2
_UPPER, _SMALL = np.zeros(256, np.uint8), np.zeros(256, np.uint8)
_UPPER[ord("A") : ord("Z") + 1] = 1
_SMALL[ord("a") : ord("z") + 1] = 1
_CAPITALS, _REPEATS = np.uint32(12345), np.uint32(54321)  # _REPEATS begins 256 features


def grade_of(quality: Column, toxic: Column) -> Column:
    return F.when(quality == 0, 0).when(quality.isNull(), None).when(F.coalesce(toxic, F.lit(0)) == 1, 1).otherwise(2)


def repetition(h: np.ndarray, row: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of two units at least, and the feature for the count and share of their most frequent pair of adjacent units."""
    same = row[1:] == row[:-1]
    pair, owner = mix(h[:-1][same] + mix(h[1:][same])), row[1:][same]
    if not len(pair):
        return np.zeros(0, np.int64), np.zeros(0, np.uint32)
    # one sort: pairs of a text share a key, by 64 bits of both
    _, first, count = np.unique(mix(pair + mix(owner.astype(np.uint64) + np.uint64(1))), return_index=True, return_counts=True)
    owner = owner[first]
    total, top = np.bincount(owner, count, minlength=n), np.zeros(n)
    np.maximum.at(top, owner, count)
    some = np.flatnonzero(total)
    often = np.minimum(np.log2(top[some]).astype(np.int64), 15)
    rare = np.minimum(-np.log2(top[some] / total[some]).astype(np.int64), 15)
    return some, (_REPEATS + 16 * often + rare).astype(np.uint32)


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, feature and weight of the features of some texts; rows ascend."""
    kind = _WORD[data]
    first = kind > 0
    first[1:] &= kind[1:] != kind[:-1]
    heads = offsets[:-1][offsets[:-1] < offsets[1:]]
    first[heads] = kind[heads] > 0
    starts = np.flatnonzero(first)
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros(0, np.uint32), np.zeros(0, np.float32)
    power, inverse = powers(len(data))
    h = np.add.reduceat(_VALUE[data] * power[: len(data)], starts) * inverse[starts]
    name = (mix(h) % np.uint64(DIMENSIONS)).astype(np.uint32)
    row = np.searchsorted(offsets, starts, side="right") - 1
    capital = (np.add.reduceat(_UPPER[data], starts, dtype=np.int64) > 1) & (np.add.reduceat(_SMALL[data], starts, dtype=np.int64) == 0)
    some, often = repetition(h, row, len(offsets) - 1)
    key = np.concatenate([row * DIMENSIONS + name, row[capital] * DIMENSIONS + _CAPITALS])
    key, n = np.unique(key, return_counts=True)
    row, name, weight = key // DIMENSIONS, (key % DIMENSIONS).astype(np.uint32), np.log1p(n)
    norm = np.sqrt(np.bincount(row, weight * weight, minlength=len(offsets) - 1))
    row, name, weight = np.concatenate([row, some]), np.concatenate([name, often]), np.concatenate([weight / norm[row], np.ones(len(some))])
    order = np.argsort(row, kind="stable")
    return row[order], name[order], weight[order].astype(np.float32)


def _sparse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc_id, grade, text -> doc_id, grade and the packed features."""
    for batch in batches:
        data, offsets = text_bytes(batch.column(2))
        for a, b in slices(offsets, CHUNK):
            row, name, weight = features(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
            ends = np.searchsorted(row, np.arange(b - a + 1))
            packed = [(name[x:y].tobytes(), weight[x:y].tobytes()) for x, y in zip(ends[:-1], ends[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), pa.array([p[0] for p in packed], pa.binary()), pa.array([p[1] for p in packed], pa.binary())], ["doc_id", "grade", "names", "weights"])


class Model:
    """Weights and ascending thresholds; ``known`` is the one grade seen, if there were not two."""

    def __init__(self, weights: np.ndarray, thresholds: np.ndarray, known: int | None = None):
        self.weights, self.thresholds, self.known = weights, thresholds, known

    def tails(self, row: np.ndarray, name: np.ndarray, weight: np.ndarray, n: int) -> np.ndarray:
        """n x (GRADES - 1): P(grade > j)."""
        if self.known is not None:
            return np.tile((self.known > np.arange(GRADES - 1)).astype(float), (n, 1))
        score = np.bincount(row, self.weights[name] * weight, minlength=n)
        return 1 / (1 + np.exp(np.clip(self.thresholds[None, :] - score[:, None], -500, 500)))


def informative(name: np.ndarray, grade: np.ndarray, texts: np.ndarray, least: float = 6.0) -> np.ndarray:
    """Features whose share of texts differs between two grades by ``least`` standard errors. Without the others a text of
    few or unknown words scores 0, as most clean texts do, instead of what chance gave its words."""
    share = np.stack([np.bincount(name[grade == g], minlength=DIMENSIONS) / max(n, 1) for g, n in enumerate(texts)])
    out = np.zeros(DIMENSIONS, bool)
    for a in range(GRADES):
        for b in range(a):
            if texts[a] and texts[b]:
                pooled = (share[a] * texts[a] + share[b] * texts[b]) / (texts[a] + texts[b])
                error = np.sqrt(pooled * (1 - pooled) * (1 / texts[a] + 1 / texts[b]))
                out |= (np.abs(share[a] - share[b]) > least * error) & (error > 0)
                out |= (error == 0) & (share[a] != share[b])
    return np.flatnonzero(out)


def fit(names: list[np.ndarray], weights: list[np.ndarray], grades: np.ndarray, rounds: int = 300, ridge: float = 1e-5) -> Model:
    """Maximum likelihood with a ridge, by Adam over the whole sample; grades weigh equally."""
    seen = np.unique(grades)
    if len(seen) < 2:
        return Model(np.zeros(DIMENSIONS, np.float32), np.zeros(GRADES - 1), int(seen[0]) if len(seen) else GRADES - 1)
    n = len(grades)
    row = np.repeat(np.arange(n), [len(x) for x in names])
    every, value = np.concatenate(names), np.concatenate(weights).astype(np.float64)
    told = informative(every, grades[row], np.bincount(grades, minlength=GRADES))
    some = np.isin(every, told)
    row, value = row[some], value[some]
    columns, name = np.unique(every[some], return_inverse=True)
    share = (1 / np.bincount(grades, minlength=GRADES).clip(1))[grades] / len(seen)
    # thresholds: the first, then the logarithms of the steps
    p = np.zeros(len(columns) + GRADES - 1)
    p[len(columns)] = -4.0
    first, second = np.zeros_like(p), np.zeros_like(p)
    sigmoid = lambda x: 1 / (1 + np.exp(-np.clip(x, -500, 500)))
    for step in range(1, rounds + 1):
        w, base, logs = p[: len(columns)], p[len(columns)], p[len(columns) + 1 :]
        t = base + np.concatenate([[0], np.cumsum(np.exp(logs))])
        score = np.bincount(row, w[name] * value, minlength=n)
        edges = np.concatenate([[-np.inf], t, [np.inf]])
        low, high = sigmoid(edges[grades] - score), sigmoid(edges[grades + 1] - score)
        mass = np.maximum(high - low, 1e-12)
        dl, dh = low * (1 - low), high * (1 - high)
        by_score = share * (dh - dl) / mass  # d(-log mass)/d score
        by_edge = np.zeros(GRADES + 1)
        np.add.at(by_edge, grades + 1, -share * dh / mass)
        np.add.at(by_edge, grades, share * dl / mass)
        by_t = by_edge[1:-1]
        gradient = np.concatenate([np.bincount(name, by_score[row] * value, minlength=len(columns)) + ridge * w, [by_t.sum()], np.cumsum(by_t[::-1])[::-1][1:] * np.exp(logs)])
        first = 0.9 * first + 0.1 * gradient
        second = 0.999 * second + 0.001 * gradient**2
        p = p - 0.1 * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-9)
        p[: len(columns)] = np.minimum(p[: len(columns)], 0)
    out = np.zeros(DIMENSIONS, np.float32)
    out[columns] = p[: len(columns)]
    return Model(out, p[len(columns)] + np.concatenate([[0], np.cumsum(np.exp(p[len(columns) + 1 :]))]))


def sample_labels(labels: DataFrame, most: int = SAMPLE) -> DataFrame:
    """doc_id and grade of at most ``most`` labelled documents of each grade."""
    told = labels.filter("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg(F.min(grade_of(F.col("quality"), F.col("toxic"))).cast("int").alias("grade"))
    parts = [told.filter(F.col("grade") == g).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most) for g in range(GRADES)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def train(docs: DataFrame, labels: DataFrame, most: int = SAMPLE) -> Model:
    # the sample is bounded by GRADES * most rows of 12 bytes
    rows = docs.select("doc_id", "text").join(F.broadcast(sample_labels(labels, most)), "doc_id").select("doc_id", "grade", "text")
    made = rows.mapInArrow(_sparse, "doc_id long, grade int, names binary, weights binary")
    one = F.min_by(F.struct("grade", "names", "weights"), F.struct(F.xxhash64("names", "weights"), "names", "weights"))
    got = made.groupBy("doc_id").agg(one.alias("one")).select("doc_id", "one.*").orderBy("doc_id").collect()  # GRADES * most rows at most
    return fit([np.frombuffer(r["names"], np.uint32) for r in got], [np.frombuffer(r["weights"], np.float32) for r in got], np.array([r["grade"] for r in got], np.int64))


RESULTS = [T.StructField("expected_grade", T.DoubleType()), T.StructField("tail", T.DoubleType())]


def score(docs: DataFrame, model: Model, at_least: int = GRADES - 1) -> DataFrame:
    """``docs`` with expected_grade and tail = P(grade >= at_least)."""
    docs = docs.drop(*(f.name for f in RESULTS))
    at, given = docs.columns.index("text"), docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = given.value
        for batch in batches:
            data, offsets = text_bytes(batch.column(at))
            tails = [np.zeros((0, GRADES - 1))]
            for a, b in slices(offsets, CHUNK):
                tails.append(known.tails(*features(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]), b - a))
            tail = np.concatenate(tails)
            fields = [*list(batch.schema), pa.field("expected_grade", pa.float64()), pa.field("tail", pa.float64())]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(tail.sum(1)), pa.array(tail[:, at_least - 1])], schema=pa.schema(fields))

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, *RESULTS]))
