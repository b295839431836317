"""SentencePiece encoding by forward-filtering backward-sampling, and lossless decoding.

A text, with a space put before it, falls into spans: some spaces and the characters up to the next space.
No piece of the vocabulary crosses from one span into the next (checked when it is loaded), so the lattice
of pieces is a chain of span lattices. Distinct spans are filtered forwards once a batch: the log weight of
all segmentations up to each character. Every occurrence then samples backwards, from the last character,
a piece in proportion to the weight of the segmentations that end with it. The random numbers are hashes of
row key, seed, span and character, so any rerun gives the same pieces.

A span of more than ``LONG`` characters (a text without spaces may be one) is filtered window by window: only its
forward weights, a number a character, are held whole. Going back, each window's table is made again from them.

A piece of rank r weighs (r + 2) ** -theta: the vocabulary's scores are merge ranks, not probabilities.
Characters without a piece become their bytes' pieces, and so does a literal U+2581, which otherwise stands for a space:
decoding gives back every text exactly.

Edge cases: null text gives null pieces, empty text none; a text of any length is one lattice; repeated
rows (same row key and text) get the same pieces. Columns named like the results are replaced.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vellum.llm._shared import mix, powers

MARK, LITERAL, CHUNK, CELLS, LONG, THETA = 0x2581, 0x110000, 1 << 21, 1 << 16, 1 << 14, 1.0
_STEP, _JUMP = np.uint64(0x9FB21C651E98DF25), np.uint64(0xD1B54A32D192ED03)


def _power_hash(points: np.ndarray) -> np.ndarray:
    return mix(points.astype(np.uint64) + np.uint64(0x5851F42D4C957F2D))


class Pieces:
    """A vocabulary: ids and texts of its pieces, ids of the 256 bytes, and a hash table over piece texts."""

    def __init__(self, texts: dict[int, str], byte_ids: list[int], theta: float = THETA):
        # texts: normal pieces, U+2581 for a space
        self.byte_ids = np.array(byte_ids, np.int32)
        self.most = max((len(t) for t in texts.values()), default=1)
        if any("▁" in t.lstrip("▁") for t in texts.values()):
            raise ValueError("a piece reaches over a space into the next span")
        self.out = [b""] * (max([*texts, *byte_ids], default=0) + 1)
        for b, i in enumerate(byte_ids):
            self.out[i] = bytes([b])
        for i, t in texts.items():
            self.out[i] = t.replace("▁", " ").encode()
        ids = sorted(texts)
        self.log_weight = np.full(len(self.out) + 1, -np.inf)
        self.log_weight[ids] = -theta * np.log(np.arange(len(ids)) + 2.0)
        self.byte_weight = -theta * np.log(len(ids) + 2.0)
        self.slots = 1 << max(4, (4 * len(ids) - 1).bit_length())
        self.keys, self.found = np.zeros(self.slots, np.uint64), np.full(self.slots, -1, np.int32)
        power, _ = powers(max(self.most, 1))
        for i in ids:
            points = np.frombuffer(texts[i].encode("utf-32-le"), np.uint32)
            h = mix((_power_hash(points) * power[: len(points)]).sum(dtype=np.uint64)[None] + np.uint64(len(points)))[0]
            at = int(h) % self.slots
            while self.keys[at]:
                at = (at + 1) % self.slots
            self.keys[at], self.found[at] = h, i

    @classmethod
    def load(cls, path: str, theta: float = THETA) -> Pieces:
        """From a SentencePiece model file with byte pieces."""
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        every = range(model.get_piece_size())
        named = {i: model.id_to_piece(i) for i in every if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))}
        return cls(named, [model.piece_to_id(f"<0x{b:02X}>") for b in range(256)], theta)

    def lookup(self, h: np.ndarray) -> np.ndarray:
        """The piece of each hash, -1 for none."""
        shape, h = h.shape, h.ravel()
        at = (h % np.uint64(self.slots)).astype(np.int64)
        key = self.keys[at]
        out = np.where(key == h, self.found[at], np.int32(-1))
        open_ = np.flatnonzero((key != h) & (key != 0))
        while len(open_):
            at[open_] = (at[open_] + 1) % self.slots
            key = self.keys[at[open_]]
            hit = key == h[open_]
            out[open_[hit]] = self.found[at[open_[hit]]]
            open_ = open_[~hit & (key != 0)]
        return out.reshape(shape)


class Lattices:
    """Some spans of one length: for each place and piece length the piece that ends there, and the sampling table."""

    def __init__(self, pieces: Pieces, points: np.ndarray):
        n, length = points.shape
        most = min(pieces.most, length)
        power, inverse = powers(length)
        sums = np.zeros((n, length + 1), np.uint64)
        np.cumsum(_power_hash(points) * power[:length], axis=1, out=sums[:, 1:])
        self.piece = np.full((n, length + 1, most), -1, np.int32)
        for size in range(1, most + 1):
            h = mix((sums[:, size:] - sums[:, : length + 1 - size]) * inverse[: length + 1 - size] + np.uint64(size))
            self.piece[:, size:, size - 1] = pieces.lookup(h)
        width = utf8_width(points)
        weight = pieces.log_weight[self.piece]
        bare = self.piece[:, 1:, 0] < 0
        weight[:, 1:, 0] = np.where(bare, pieces.byte_weight * width, weight[:, 1:, 0])
        forward = np.full((n, length + 1), -np.inf)
        forward[:, 0] = 0
        self.table = np.zeros((n, length + 1, most))
        for t in range(1, length + 1):
            m = min(t, most)
            into = forward[:, t - m : t][:, ::-1] + weight[:, t, :m]
            top = into.max(1, keepdims=True)
            share = np.cumsum(np.exp(into - top), axis=1)
            forward[:, t] = top[:, 0] + np.log(share[:, -1])
            self.table[:, t, :m] = share / share[:, -1:]
            self.table[:, t, m:] = 1.0

    def last(self, row: np.ndarray, at: np.ndarray, uniform: np.ndarray) -> np.ndarray:
        """The length of the sampled last piece before place ``at`` of each row."""
        return (self.table[row, at] <= uniform[:, None]).sum(1) + 1


def _uniform(seed: np.ndarray, place: np.ndarray) -> np.ndarray:
    return (mix(seed + place.astype(np.uint64) * _JUMP) >> np.uint64(11)) * 2.0**-53


def _window(pieces: Pieces, points: np.ndarray, a: int, b: int) -> tuple[np.ndarray, np.ndarray]:
    """For the places a + 1 to b of a span: the piece of each length that ends there, -1 for none, and its log weight."""
    start = max(0, a - pieces.most)
    part = points[start:b]
    power, inverse = powers(len(part))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_power_hash(part) * power[: len(part)])])
    end = np.arange(a + 1, b + 1) - start
    piece = np.full((b - a, pieces.most), -1, np.int32)
    for size in range(1, pieces.most + 1):
        own = end[end >= size]
        if len(own):
            piece[b - a - len(own) :, size - 1] = pieces.lookup(mix((sums[own] - sums[own - size]) * inverse[own - size] + np.uint64(size)))
    weight = pieces.log_weight[piece]
    bare = piece[:, 0] < 0
    weight[:, 0] = np.where(bare, pieces.byte_weight * utf8_width(points[a:b]), weight[:, 0])
    return piece, weight


def _long_span(pieces: Pieces, points: np.ndarray, seeds: np.ndarray, window: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Samples a long span once a seed: of each window, last first, the number of the seed, the places where pieces end (falling) and the pieces."""
    length = len(points)
    forward = np.zeros(length + 1)
    for a in range(0, length, window):
        b = min(length, a + window)
        _, weight = _window(pieces, points, a, b)
        place, size = np.nonzero(weight > -np.inf)
        known = weight[place, size].tolist()
        bounds = np.searchsorted(place, np.arange(b - a + 1)).tolist()
        size = (size + 1).tolist()
        held = forward[max(0, a - pieces.most) : a + 1].tolist()
        base = a + 1 - len(held)  # held[i] is the weight at place base + i
        for t in range(b - a):
            top = held[-1]
            here = a + t + 1 - base
            total = sum(math.exp(held[here - size[j]] - top + known[j]) for j in range(bounds[t], bounds[t + 1]))
            held.append(top + math.log(total))
        forward[a + 1 : b + 1] = held[len(held) - (b - a) :]
    place = [length] * len(seeds)
    for a in range((length - 1) // window * window, -1, -window):
        b = min(length, a + window)
        piece, weight = _window(pieces, points, a, b)
        back = np.arange(a + 1, b + 1)[:, None] - np.arange(1, pieces.most + 1)
        into = np.where(back >= 0, forward[np.maximum(back, 0)] + weight, -np.inf)
        share = np.cumsum(np.exp(into - into.max(1, keepdims=True)), axis=1)
        share /= share[:, -1:]
        for i, seed in enumerate(seeds):
            step = ((share <= _uniform(seed, np.arange(a + 1, b + 1))[:, None]).sum(1) + 1).tolist()
            at, ends = place[i], []
            while at > a:
                ends.append(at)
                at -= step[at - a - 1]
            place[i] = at
            ends = np.array(ends, np.int64)
            yield i, ends, piece[ends - a - 1, np.array(step, np.int64)[ends - a - 1] - 1]


def utf8_width(points: np.ndarray) -> np.ndarray:
    width = 1 + (points > 0x7F).astype(np.int64) + (points > 0x7FF) + (points > 0xFFFF)
    return np.where(points == LITERAL, 3, width)


def _utf8(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of code points, n x 4, and how many of each count."""
    points = np.where(points == LITERAL, MARK, points).astype(np.int64)
    width = utf8_width(points)
    out = np.zeros((len(points), 4), np.int64)
    for w, lead in ((1, 0x00), (2, 0xC0), (3, 0xE0), (4, 0xF0)):
        some = width == w
        for j in range(w):
            part = points[some] >> (6 * (w - 1 - j))
            out[some, j] = part | lead if j == 0 else (part & 0x3F) | 0x80
    return out, width


def sample(pieces: Pieces, texts: list[str], seeds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Piece ids of some texts, end to end, and the n + 1 bounds. ``seeds``: uint64, one a text."""
    marked = [" " + t if t else "" for t in texts]
    lengths = np.array([len(t) for t in marked], np.int64)
    points = np.frombuffer("".join(marked).encode("utf-32-le", "surrogatepass"), np.uint32).copy()
    if not len(points):
        return np.zeros(0, np.int32), np.zeros(len(texts) + 1, np.int64)
    points[points == MARK] = LITERAL
    points[points == 0x20] = MARK
    ends = np.cumsum(lengths)
    begins = points == MARK
    begins[1:] &= points[:-1] != MARK
    begins[(ends - lengths)[lengths > 0]] = True
    start = np.flatnonzero(begins)
    size = np.diff(np.concatenate([start, [len(points)]]))
    owner = np.searchsorted(ends, start, side="right")
    within = np.arange(len(start)) - np.searchsorted(owner, owner, side="left")
    power, inverse = powers(len(points))
    name = mix(np.add.reduceat(_power_hash(points) * power[: len(points)], start) * inverse[start] + size.astype(np.uint64))
    _, first, which = np.unique(name, return_index=True, return_inverse=True)
    seed = mix(seeds[owner] + within.astype(np.uint64) * _STEP)
    by_span = np.argsort(which, kind="stable")
    span_at = np.searchsorted(which[by_span], np.arange(len(first) + 1))
    by_length = np.argsort(size[first], kind="stable")
    sizes = size[first][by_length]
    spans, used, ids, codes = [], [], [], []
    so_far = np.zeros(len(start), np.int64)
    at = 0
    while at < len(first):
        length = int(sizes[at])
        if length > LONG:
            own = points[start[first[by_length[at]]] :][:length]
            owners = by_span[span_at[by_length[at]] : span_at[by_length[at] + 1]]
            for i, end, piece in _long_span(pieces, own, seed[owners], LONG):
                code, bare = own[end - 1], piece < 0
                used_by = so_far[owners[i]] + np.cumsum(np.where(bare, utf8_width(code), 1))
                spans.append(np.full(len(end), owners[i]))
                used.append(used_by)
                ids.append(piece)
                codes.append(np.where(bare, code, 0))
                if len(end):
                    so_far[owners[i]] = used_by[-1]
            at += 1
            continue
        stop = min(int(np.searchsorted(sizes, length, side="right")), at + max(1, CELLS // length))
        some = by_length[at:stop]
        lattice = Lattices(pieces, points[start[first[some]][:, None] + np.arange(length)])
        row = np.repeat(np.arange(len(some)), span_at[some + 1] - span_at[some])
        span = by_span[np.repeat(span_at[some] - np.concatenate([[0], np.cumsum(span_at[some + 1] - span_at[some])[:-1]]), span_at[some + 1] - span_at[some]) + np.arange(len(row))]
        place = np.full(len(row), length, np.int64)
        while len(row):
            step = lattice.last(row, place, _uniform(seed[span], place))
            piece = lattice.piece[row, place, step - 1]
            code = points[start[span] + place - 1]
            bare = piece < 0
            so_far[span] += np.where(bare, utf8_width(code), 1)
            spans.append(span)
            used.append(so_far[span])
            ids.append(piece)
            codes.append(np.where(bare, code, 0))
            place = place - step
            left = place > 0
            row, span, place = row[left], span[left], place[left]
        at = stop
    span, used, piece, code = (np.concatenate(x) for x in (spans, used, ids, codes))
    bounds = np.concatenate([[0], np.cumsum(so_far)])
    out = np.zeros(bounds[-1], np.int32)
    to = bounds[span + 1] - used  # sampled from the end
    whole = piece >= 0
    out[to[whole]] = piece[whole]
    octets, width = _utf8(code[~whole])
    for j in range(4):
        some = width > j
        out[to[~whole][some] + j] = pieces.byte_ids[octets[some, j]]
    return out, bounds[np.searchsorted(owner, np.arange(len(texts) + 1), side="left")]


def join(pieces: Pieces, ids: list[int]) -> str:
    """The text of some pieces."""
    return b"".join([pieces.out[i] for i in ids]).decode("utf-8", "surrogatepass")[1:]


def join_all(table: pa.LargeBinaryArray, listed: pa.ListArray) -> list[str | None]:
    """``join`` of each list of ids, None for null; the pieces of all lists are gathered at once from ``table``."""
    lengths = np.where(listed.is_valid().to_numpy(zero_copy_only=False), pc.fill_null(pc.list_value_length(listed), 0).to_numpy(), 0)
    got = table.take(listed.flatten())
    offsets = np.frombuffer(got.buffers()[1], np.int64)[got.offset : got.offset + len(got) + 1] if len(got) else np.zeros(1, np.int64)
    data = memoryview(got.buffers()[2] or b"")
    ends = offsets[np.concatenate([[0], np.cumsum(lengths)])]
    told = zip(ends[:-1].tolist(), ends[1:].tolist(), listed.is_valid().to_pylist(), strict=True)
    return [str(data[a:b], "utf-8", "surrogatepass")[1:] if valid else None for a, b, valid in told]


def _groups(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    start, size = 0, 0
    for i, t in enumerate(texts):
        if i > start and size + len(t or "") > CHUNK // 2:
            yield start, i
            start, size = i, 0
        size += len(t or "")
    if start < len(texts):
        yield start, len(texts)


def encode(docs: DataFrame, pieces: Pieces, seed: int = 0) -> DataFrame:
    """``docs`` (doc_id, text and others) with ``pieces``, an array of ids. The row key is doc_id."""
    docs = docs.drop("pieces")
    keyed = docs.withColumn("_seed", F.xxhash64("doc_id", F.lit(seed)))
    at, given = docs.columns.index("text"), docs.sparkSession.sparkContext.broadcast(pieces)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = given.value
        for batch in batches:
            texts = batch.column(at).to_pylist()
            seeds = batch.column(batch.num_columns - 1).to_numpy().view(np.uint64)
            for a, b in _groups(texts):
                ids, bounds = sample(known, [t or "" for t in texts[a:b]], seeds[a:b])
                gone = np.array([t is None for t in texts[a:b]])
                listed = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(ids), mask=pa.array(gone))
                part = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], listed], [*part.schema.names[:-1], "pieces"])

    return keyed.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField("pieces", T.ArrayType(T.IntegerType()))]))


def decode(encoded: DataFrame, pieces: Pieces) -> DataFrame:
    """``encoded`` with ``decoded``, the text of its pieces."""
    encoded = encoded.drop("decoded")
    at, given = encoded.columns.index("pieces"), encoded.sparkSession.sparkContext.broadcast(pieces)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.array(given.value.out, pa.large_binary())
        for batch in batches:
            for a in range(0, batch.num_rows, 500):
                part = batch.slice(a, 500)
                texts = join_all(table, part.column(at))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.string())], [*part.schema.names, "decoded"])

    return encoded.mapInArrow(run, T.StructType([*encoded.schema.fields, T.StructField("decoded", T.StringType())]))
