"""N-gram Jaccard join: MinHash banding finds candidates, full n-gram sets verify them.

1. Every text becomes a class (the hash of its words; equal word sequences are copies), MinHash values over
   its word n-grams, and a hash for each band. Bands and rows are chosen so that a pair at the threshold is
   missed with probability ``1 - recall`` at most.
2. Band hashes of distinct classes are shuffled; a bucket that holds several classes links them to its least
   one. Components of these links are the only places where similar pairs can be.
3. Small components share tasks; one text of each of their classes goes there once. A component of more than
   ``BLOCK_GRAMS`` n-grams or ``BLOCK_ROWS`` classes goes, whichever sends fewer rows, in pairs of blocks of that
   size, or bucket by bucket (equal buckets once, large ones in pairs of blocks), so that a long chain of texts
   is never sent more than once a band. No task's key is a component or bucket above that bound.
4. A task sorts its classes by band and compares those that share one on their full n-gram sets, in the
   first band that they share, so that no pair counts twice, in whatever task it is met.

A pair never becomes a row, unless asked for: tasks return a class's number of links and its group.

Edge cases: words are maximal runs without white space, A-Z as a-z. Texts of fewer words than n have one
n-gram, all their words. Null texts and texts without words are similar to nothing. Repeated rows are
copies of each other. doc_id may be null. An empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellum.llm._shared import keep, mix, slices, text_bytes, words
from vellum.llm.components import components, spread_join

N, THRESHOLD, RECALL, MOST_HASHES = 5, 0.8, 0.9995, 128
CHUNK, BLOCK_GRAMS, BLOCK_ROWS, GROUP_GRAMS, PAIRS = 2 << 20, 500_000, 1024, 250_000, 200_000
_STEP = np.uint64(0xD6E8FEB86659FD93)
_FACTORS = np.random.default_rng(977).integers(1, 1 << 63, MOST_HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def bands_and_rows(threshold: float, recall: float, most: int = MOST_HASHES) -> tuple[int, int]:
    """The most rows a band (fewest false candidates) for which enough bands fit into ``most`` hashes."""
    for rows in range(most, 0, -1):
        hit = threshold**rows
        bands = 1 if hit >= 1 else math.ceil(math.log(1 - recall) / math.log1p(-hit)) if hit > 0 else most + 1
        if bands * rows <= most:
            return bands, rows
    raise ValueError(f"{most} hashes can't reach recall {recall} at {threshold}")


def grams(h: np.ndarray, row: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and row of every n-gram of words; a row of fewer words gives one."""
    if not len(h):
        return h, row
    out, step, full = h.copy(), np.uint64(1), np.ones(len(h), bool)
    for j in range(1, n):
        step = np.uint64(int(step) * int(_STEP) & (1 << 64) - 1)
        same = np.zeros(len(h), bool)
        same[:-j] = row[j:] == row[:-j]
        out[:-j] += np.where(same[:-j], h[j:] * step, np.uint64(0))
        full = same
    first = np.concatenate([[True], row[1:] != row[:-1]])
    if n > 1:
        full |= first & ~full
    return mix(out[full]), row[full]


def band_hashes(g: np.ndarray, heads: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """Texts x bands; ``heads`` are the first positions of each text in ``g``."""
    out = np.zeros((len(heads), bands), np.uint64)
    for b in range(bands):
        for r in range(rows):
            least = np.minimum.reduceat(g * _FACTORS[b * rows + r], heads)
            out[:, b] = mix(out[:, b] + least)
        out[:, b] = mix(out[:, b] + np.uint64(b + 1))
    return out


def _sketch(n: int, bands: int, rows: int):
    """doc_id, row_key, text -> doc_id, row_key, class, number of words, band hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_bytes(batch.column(2))
            for a, b in slices(offsets, CHUNK):
                h, row = words(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], True)
                count = np.bincount(row, minlength=b - a)
                some = np.flatnonzero(count)
                same = np.zeros(b - a, np.uint64)
                hashes = np.zeros((len(some), bands), np.uint64)
                if len(some):
                    # the class: a polynomial over the words, by position within the text
                    heads = np.concatenate([[0], np.cumsum(count[some])[:-1]])
                    at = np.arange(len(h)) - np.repeat(heads, count[some])
                    same[some] = mix(np.add.reduceat(mix(h + mix(at.astype(np.uint64))), heads))
                    g, gram_row = grams(h, row, n)
                    hashes = band_hashes(g, np.flatnonzero(np.concatenate([[True], gram_row[1:] != gram_row[:-1]])), bands, rows)
                where = np.concatenate([[0], np.cumsum((count > 0) * bands)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(a, b - a),
                        batch.column(1).slice(a, b - a),
                        pa.array(same.view(np.int64), mask=count == 0),
                        pa.array(count),
                        pa.ListArray.from_arrays(pa.array(where), pa.array(hashes.ravel().view(np.int64))),
                    ],
                    ["doc_id", "row_key", "cls", "words", "bands"],
                )

    return run


def _sets(n: int):
    """cls, size, band, group, a, b, part, text -> the sorted n-gram set in place of the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_bytes(batch.column(batch.num_columns - 1))
            for a, b in slices(offsets, CHUNK):
                g, row = grams(*words(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], True), n)
                order = np.lexsort((g, row))
                g, row = g[order], row[order]
                new = np.concatenate([[True], (g[1:] != g[:-1]) | (row[1:] != row[:-1])]) if len(g) else np.zeros(0, bool)
                g, row = g[new], row[new]
                ends = np.searchsorted(row, np.arange(b - a + 1))
                packed = pa.Array.from_buffers(pa.binary(), b - a, [None, pa.py_buffer((ends * 8).astype(np.int32)), pa.py_buffer(g)])
                yield pa.RecordBatch.from_arrays([*(batch.column(i).slice(a, b - a) for i in range(batch.num_columns - 1)), packed], [*batch.schema.names[:-1], "grams"])

    return run


def _met(keys: np.ndarray, band: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows that share a band, each in the first band that it shares, at most ``PAIRS`` at once unless one row has more.
    Rows sent for one band (``band`` >= 0) meet only there."""
    for b in range(keys.shape[1]):
        some = np.flatnonzero((band < 0) | (band == b))
        order = some[np.argsort(keys[some, b], kind="stable")]
        own = keys[order, b]
        ends = np.searchsorted(own, own, side="right")
        others = ends - np.arange(len(order)) - 1
        total = np.concatenate([[0], np.cumsum(others)])
        at = 0
        while at < len(order) and total[-1] > total[at]:
            stop = max(at + 1, int(np.searchsorted(total, total[at] + PAIRS, side="right")) - 1)
            count = others[at:stop]
            left = np.repeat(np.arange(at, stop), count)
            right = left + 1 + np.arange(len(left)) - np.repeat(total[at:stop] - total[at], count)
            left, right = order[left], order[right]
            fresh = np.ones(len(left), bool)
            for earlier in range(b):
                fresh &= keys[left, earlier] != keys[right, earlier]
            if fresh.any():
                yield left[fresh], right[fresh]
            at = stop


def _roots(parent: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """The roots of some rows; the rows then point to them."""
    found = parent[rows]
    while True:
        above = parent[found]
        if (above == found).all():
            parent[rows] = found
            return found
        found = above


def _verify(threshold: float, bands: int, rows: int, as_pairs: bool):
    """A group's classes -> links and least class of the linked ones (within the group) of those that have any, or the similar pairs."""

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        cls, size, band, part = (table[c].to_numpy() for c in ("cls", "size", "band", "part"))
        order = np.lexsort((cls, band))
        order = order[np.concatenate([[True], (cls[order][1:] != cls[order][:-1]) | (band[order][1:] != band[order][:-1])])]  # rows repeat with their row keys
        cls, size, band, part = cls[order], size[order], band[order], part[order]
        column = table["grams"].combine_chunks()
        _, where, data = column.buffers()
        where = np.frombuffer(where, np.int32, count=column.offset + len(column) + 1)[column.offset :].astype(np.int64) // 8
        g = np.frombuffer(data, np.uint64)
        length = np.diff(where)[order]
        ends = np.concatenate([[0], np.cumsum(length)])
        g = g[np.repeat(where[:-1][order] - ends[:-1], length) + np.arange(ends[-1])]
        keys = band_hashes(g, ends[:-1], bands, rows)
        names, g = np.unique(g, return_inverse=True)
        parent = np.arange(len(cls))
        across = key[1].as_py() != key[2].as_py()
        links, pairs, mark = np.zeros(len(cls), np.int64), [], np.zeros(len(names), bool)
        for left, right in _met(keys, band):
            if across:
                apart = part[left] != part[right]
                left, right = left[apart], right[apart]
            if not len(left):
                continue
            heads = np.flatnonzero(np.concatenate([[True], left[1:] != left[:-1]]))
            for x, y in zip(heads, [*heads[1:], len(left)], strict=True):
                i, other = left[x], right[x:y]
                own = slice(ends[i], ends[i + 1])
                mark[g[own]] = True
                step = np.cumsum(length[other])
                held = mark[g[np.repeat(ends[other] - step + length[other], length[other]) + np.arange(step[-1])]]
                mark[g[own]] = False
                shared = np.add.reduceat(held, step - length[other], dtype=np.int64)
                alike = shared / (length[i] + length[other] - shared)
                good = alike >= threshold
                if not good.any():
                    continue
                other = other[good]
                links[i] += size[other].sum()
                links[other] += size[i]
                tops = np.unique(_roots(parent, np.append(other, i)))
                parent[tops] = tops[0]
                if as_pairs:
                    pairs.append((np.full(len(other), cls[i]), cls[other], alike[good]))
        if as_pairs:
            a, b, s = (np.concatenate(p) for p in zip(*pairs, strict=True)) if pairs else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
            return pa.table({"a": a, "b": b, "similarity": s})
        some = np.flatnonzero(links)
        return pa.table({"cls": cls[some], "links": links[some], "root": cls[_roots(parent, some)] if len(some) else cls[some]})

    return run


def _parts() -> Column:
    """Into how many blocks rows (rows, grams) are cut."""
    return F.ceil(F.greatest(F.col("grams") / BLOCK_GRAMS, F.col("rows") / BLOCK_ROWS, F.lit(1.0))).cast("int")


class Join:
    """The parts of a join over documents (doc_id, text): ``docs`` has doc_id, row_key and cls; ``classes`` cls,
    size, row_key, doc_id and words; ``groups`` the classes that have candidates, dealt into groups for :func:`_verify`."""

    def __init__(self, docs: DataFrame, n: int = N, threshold: float = THRESHOLD, recall: float = RECALL):
        self.n, self.threshold = n, threshold
        self.bands, self.rows = bands_and_rows(threshold, recall)
        self.texts = docs.select("doc_id", F.xxhash64("doc_id", "text").alias("row_key"), "text")
        sketch = self.texts.mapInArrow(_sketch(n, self.bands, self.rows), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, row_key long, cls long, words long, bands array<long>")
        self.docs = keep(sketch, "jaccard-sketch")
        told = self.docs.filter("cls IS NOT NULL")
        classes = told.groupBy("cls").agg(F.count("*").alias("size"), F.min("row_key").alias("row_key"), F.min("doc_id").alias("doc_id"), F.max("words").alias("words"), F.any_value("bands").alias("bands"))
        classes = keep(classes, "jaccard-classes")
        self.classes = classes.drop("bands")
        hashed = classes.select("cls", F.explode("bands").alias("band"))
        buckets = hashed.groupBy("band").agg(F.min("cls").alias("first"), F.max("cls").alias("last")).filter("first <> last")
        links = hashed.join(buckets, "band").select(F.col("cls").alias("u"), F.col("first").alias("v"))
        found = components(links)
        self.found = keep(classes.join(found.select(F.col("node").alias("cls"), "root"), "cls").drop("doc_id"), "jaccard-found")
        whole = self.found.groupBy("root").agg(F.sum("words").alias("grams"), F.count("*").alias("rows"))
        large = keep(whole.filter((F.col("grams") > BLOCK_GRAMS) | (F.col("rows") > BLOCK_ROWS)).withColumn("parts", _parts()), "jaccard-large")
        self.cut = large
        total = self.found.agg(F.sum("words")).first()[0] or 0
        tasks = F.lit(max(8, total // GROUP_GRAMS))
        one = lambda c: F.lit(0).alias(c)
        base = ["cls", "size", "row_key"]
        small = self.found.join(large.select("root"), "root", "left_anti").select(*base, F.lit(-1).alias("band"), F.pmod(F.xxhash64("root"), tasks).alias("group"), one("a"), one("b"), one("part"))
        # large components: what blocks of the whole send, and what their buckets send
        members = self.found.join(large.select("root", "parts"), "root").select(*base, "root", "words", "bands", "parts")
        each = members.select(*base, "root", "words", "parts", F.posexplode("bands").alias("band", "name"))
        stats = each.groupBy("root", "parts", "band", "name").agg(F.count("*").alias("rows"), F.sum("words").alias("grams"), F.bit_xor("cls").alias("sum"), F.bit_xor(F.xxhash64("cls")).alias("hash")).filter("rows > 1")
        firsts = stats.groupBy("root", "parts", "rows", "grams", "sum", "hash").agg(F.min(F.struct("band", "name")).alias("first"))
        firsts = keep(firsts.select("root", F.col("parts").alias("whole"), "rows", "first.*", _parts().alias("parts")), "jaccard-buckets")
        sent = firsts.groupBy("root").agg(F.sum(F.col("rows") * F.col("parts")).alias("sent"))
        by_bucket = keep(large.join(sent, "root").filter(F.col("sent") < F.col("rows") * F.col("parts")).select("root"), "jaccard-by-bucket")
        blocks = members.join(by_bucket, "root", "left_anti").select(*base, F.lit(-1).alias("band"), F.col("root").alias("group"), "parts")
        chosen = firsts.join(by_bucket, "root").select("root", "band", "name", "parts")
        dealt = each.drop("parts").join(chosen, ["root", "band", "name"]).select(*base, "band", F.when(F.col("parts") == 1, F.pmod(F.xxhash64("name"), tasks)).otherwise(F.col("name")).alias("group"), "parts")
        cut = blocks.unionByName(dealt).withColumn("part", F.pmod(F.xxhash64("cls"), F.col("parts")).cast("int"))
        cut = cut.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        cut = cut.select(*base, "band", "group", F.least("part", "other").alias("a"), F.greatest("part", "other").alias("b"), "part")
        self.groups = small.unionByName(cut)

    def _verified(self, as_pairs: bool, schema: str) -> DataFrame:
        # the same plan at every size: texts are dealt by row key to the few that are wanted
        texts = self.texts.select("row_key", "text").join(self.groups.hint("shuffle_hash"), "row_key").select("cls", "size", "band", "group", "a", "b", "part", "text")
        sets = texts.mapInArrow(_sets(self.n), "cls long, size long, band int, group long, a int, b int, part int, grams binary")
        return sets.groupBy("group", "a", "b").applyInArrow(_verify(self.threshold, self.bands, self.rows, as_pairs), schema)

    def pairs(self) -> DataFrame:
        """doc_a, doc_b, similarity: the similar pairs of classes, by their least doc_id."""
        found = self._verified(True, "a long, b long, similarity double")
        name = lambda c: self.classes.select(F.col("cls").alias(c), F.col("doc_id").alias(f"doc_{c}"))
        return found.join(name("a"), "a").join(name("b"), "b").select(F.least("doc_a", "doc_b").alias("doc_a"), F.greatest("doc_a", "doc_b").alias("doc_b"), "similarity")

    def members(self) -> DataFrame:
        """A row a document: doc_id, row_key, root (null without words), class_id (least doc_id of its group of
        linked documents) and n_links, the number of documents similar to it."""
        found = keep(self._verified(False, "cls long, links long, root long"), "jaccard-links")
        links = found.groupBy("cls").agg(F.sum("links").alias("links"), F.min("root").alias("root"))
        if self.cut.limit(1).count():
            joined = components(found.select(F.col("cls").alias("u"), F.col("root").alias("v")))
            links = links.drop("root").join(joined.select(F.col("node").alias("cls"), "root"), "cls", "left")
        # only linked classes have a group to be named after; the others are their own
        linked = keep(self.classes.join(links, "cls").withColumn("root", F.coalesce("root", "cls")).select("cls", "root", "doc_id", "links"), "jaccard-linked")
        least = linked.groupBy("root").agg(F.min("doc_id").alias("class_id"))
        named = spread_join(linked.drop("doc_id"), least, "root", "cls").withColumn("_linked", F.lit(True))
        own = lambda name, else_: F.when(F.col("_linked"), F.col(name)).otherwise(F.col(else_)).alias(name)
        classes = self.classes.join(named, "cls", "left").select("cls", F.coalesce("root", "cls").alias("root"), own("class_id", "doc_id"), (F.coalesce("links", F.lit(0)) + F.col("size") - 1).alias("n_links"))
        out = self.docs.select("doc_id", "row_key", "cls").join(classes, "cls", "left")
        return out.select("doc_id", "row_key", "root", F.when(F.col("cls").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))


def deduplicate(docs: DataFrame, n: int = N, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with one document of each group of linked ones (that of the least doc_id; texts without words all stay)."""
    rows = keep(Join(docs, n, threshold).members(), "jaccard-members")
    firsts = rows.filter("root IS NOT NULL").groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row_key")).alias("first"))
    stay = keep(firsts.select(F.col("first.row_key").alias("row_key")), "jaccard-stay")
    alone = rows.filter("root IS NULL").select("row_key").distinct()
    keyed = docs.withColumn("_row_key", F.xxhash64("doc_id", "text"))
    kept = keyed.join(stay.unionByName(alone).withColumnRenamed("row_key", "_row_key").hint("shuffle_hash"), "_row_key", "left_semi")
    again = rows.filter("root IS NOT NULL").groupBy("row_key").count().filter("count > 1").join(stay, "row_key", "left_semi")
    if again.limit(1).count():  # the row that stays is there several times
        wordless = kept.join(alone.withColumnRenamed("row_key", "_row_key"), "_row_key", "left_semi")
        kept = kept.join(alone.withColumnRenamed("row_key", "_row_key"), "_row_key", "left_anti").dropDuplicates(["_row_key"]).unionByName(wordless)
    return kept.select(*docs.columns)
