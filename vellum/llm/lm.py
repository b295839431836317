"""LM scoring with an Elias-Fano n-gram trie.

The model is an interpolated bigram with absolute discounting over an add-one unigram:
p(w | v) = max(c(vw) - D, 0) / c(v) + D * T(v) / c(v) * p1(w), p1(w) = (c(w) + 1) / (N + V + 1), where T(v)
counts the distinct successors of v. A text begins in the state "start" and ends with an end token.

Counts and the trie are far larger than one task's memory, so both are dealt into shards by context:

1. Texts become token batches, written once: the distinct words of a batch and its texts as local ids.
2. Each batch sends every shard, in one binary, its distinct words and bigrams with their training counts.
3. A shard adds the counts and builds the trie of its training bigrams: levels of monotone word hashes and
   pointers, 8-bit quantised log probabilities. The trie, as bytes, goes into the table of answers in the shared
   folder: it is the model. The shard then maps those bytes and looks up every bigram asked for by its hashes, by
   successor search within its context's range, and answers each batch in its own order. Nothing else tells it a
   bigram's probability.
4. A batch joins its answers and adds up its texts.

:func:`train` gives the stored tries as a :class:`Model`, which scores other documents by the same search, without counting.

Contexts of more than 1/1024 of all training tokens (so there are fewer than 1024, and their exact counts can be
broadcast) are dealt by context and successor, so that no shard grows with one frequent word. Nothing is
pruned or sampled; rows sent are never more than the distinct words and bigrams of the batches.

Words are told apart by 64-bit hashes, successors of a context by 40 bits: of a context with n successors in a shard a
word that is none of them is taken for one with probability n / 2**40.

Edge cases: null text is empty (its one token is the end); a null doc_id trains; repeated rows count each;
with nothing to train on, p1 is uniform; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.llm._shared import keep, mix, slices, text_bytes, words
from vellum.llm.eliasfano import Trie, map_trie

DISCOUNT, BATCH, SHARD, CHUNK, HEAVY = 0.75, 600_000, 750_000, 1 << 20, 1024
START, END = np.uint64(0x51A7_0000_0000_0001), np.uint64(0xE4D0_0000_0000_0003)
_SHORT_BYTES = 5
_SHORT = np.uint64((1 << 8 * _SHORT_BYTES) - 1)
_codec = pa.Codec("zstd", compression_level=1)


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays as one compressed binary, each with its bytes in planes."""
    parts = []
    for a in arrays:
        plane = np.ascontiguousarray(a.view(np.uint8).reshape(len(a), -1).T) if len(a) else np.zeros(0, np.uint8)
        body = _codec.compress(plane.tobytes(), asbytes=True) if len(a) else b""
        parts += [np.array([len(a), a.dtype.itemsize, len(body)], np.int64).tobytes(), body]
    return b"".join(parts)


def unpack(data: bytes, *kinds: type) -> list[np.ndarray]:
    out, at = [], 0
    for kind in kinds:
        n, width, size = (int(x) for x in np.frombuffer(data, np.int64, 3, at))
        body = np.frombuffer(_codec.decompress(data[at + 24 : at + 24 + size], n * width, asbytes=True), np.uint8) if n else np.zeros(0, np.uint8)
        out.append(np.ascontiguousarray(body.reshape(width, n).T).view(f"u{width}").ravel().astype(kind) if n else np.zeros(0, kind))
        at += 24 + size
    return out


def _narrow(a: np.ndarray) -> np.ndarray:
    top = int(a.max(initial=0))
    return a.astype(np.uint8 if top < 1 << 8 else np.uint16 if top < 1 << 16 else np.uint32 if top < 1 << 32 else np.uint64)


def _batch(held: list[tuple]) -> tuple[bytes, bytes]:
    """Texts as local ids, most frequent word first in the code: (names, training counts), (lengths, codes)."""
    h, lengths, trains = (np.concatenate(p) for p in zip(*held, strict=True))
    names, local, count = np.unique(h, return_inverse=True, return_counts=True)
    train = np.bincount(local, np.repeat(trains, lengths), minlength=len(names)).astype(np.uint64)
    order = np.argsort(-count, kind="stable")
    code = np.empty(len(names), np.uint32)
    code[order] = np.arange(len(names))
    return pack(names, _narrow(train), _narrow(code)), pack(_narrow(lengths.astype(np.uint64)), _narrow(code[local]))


def _tokenise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc_id, held_out, text -> token batches."""
    made, held, ids, outs, size = 0, [], [], [], 0

    def flush() -> pa.RecordBatch:
        lengths = np.concatenate([x[1] for x in held])
        trains = np.concatenate([x[2] for x in held])
        vocabulary, texts = _batch(held)
        row = [
            pa.array([TaskContext.get().partitionId() << 32 | made], pa.int64()),
            pa.ListArray.from_arrays(pa.array([0, len(lengths)], pa.int32()), pa.concat_arrays(ids)),
            pa.ListArray.from_arrays(pa.array([0, len(lengths)], pa.int32()), pa.concat_arrays(outs)),
            pa.array([int(lengths.sum() + len(lengths))], pa.int64()),
            pa.array([int(lengths[trains].sum())], pa.int64()),
            pa.array([int(trains.sum())], pa.int64()),
            pa.array([vocabulary], pa.binary()),
            pa.array([texts], pa.binary()),
        ]
        return pa.RecordBatch.from_arrays(row, ["batch", "ids", "outs", "tokens", "train_words", "train_texts", "vocabulary", "texts"])

    for batch in batches:
        data, offsets = text_bytes(batch.column(2))
        for a, b in slices(offsets, CHUNK):
            h, row = words(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], True)
            out = batch.column(1).slice(a, b - a)
            held.append((h, np.bincount(row, minlength=b - a), ~np.asarray(out)))
            ids.append(batch.column(0).slice(a, b - a))
            outs.append(out)
            size += len(h)
            if size >= BATCH:
                yield flush()
                made, held, ids, outs, size = made + 1, [], [], [], 0
    if held:
        yield flush()


def _vocabulary(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return tuple(unpack(data, np.uint64, np.uint64, np.uint32))


def _frequent(only: np.ndarray | None):
    """Words of 1/4096 of a batch's training tokens at least, or the given ones, with their counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column(0):
                names, train, _ = _vocabulary(data.as_py())
                some = np.isin(names, only) if only is not None else train * 4 * HEAVY > train.sum()
                yield pa.RecordBatch.from_arrays([pa.array(names[some].view(np.int64)), pa.array(train[some].astype(np.int64))], ["name", "n"])

    return run


class _Bigrams:
    """The distinct words and bigrams of a token batch, and where each shard's are."""

    def __init__(self, vocabulary: bytes, texts: bytes, shards: int, heavy: np.ndarray, held_out: np.ndarray):
        self.names, self.train, code = _vocabulary(vocabulary)
        self.lengths, codes = unpack(texts, np.int64, np.int64)
        n, texts_n = len(self.names), len(self.lengths)
        local = np.empty(n, np.int64)
        local[code] = np.arange(n)
        # start, words, end of each text; the names of the two ends come after the words'
        ends = np.cumsum(self.lengths + 2)
        line = np.empty(int(ends[-1]) if texts_n else 0, np.int64)
        inner = np.ones(len(line), bool)
        inner[ends - 1] = inner[ends - self.lengths - 2] = False
        line[inner] = local[codes]
        line[ends - 1], line[ends - self.lengths - 2] = n + 1, n
        pair = np.ones(len(line), bool)
        pair[ends - 1] = False
        at = np.flatnonzero(pair)
        self.current = line[at + 1]
        key, self.inverse = np.unique(line[at] * (n + 2) + self.current, return_inverse=True)
        trained = np.repeat(~held_out, self.lengths + 1)
        self.count = np.bincount(self.inverse, trained, minlength=len(key)).astype(np.int64)
        self.before, self.after = key // (n + 2), key % (n + 2)
        self.starts = np.cumsum(self.lengths + 1) - self.lengths - 1
        self.named = np.concatenate([self.names, [START, END]])
        self.word_count = np.concatenate([self.train, [np.uint64(0), np.uint64((~held_out).sum())]]).astype(np.uint64)
        shard = lambda h: ((h >> np.uint64(32)) % np.uint64(shards)).astype(np.int64)
        self.word_shard = shard(mix(self.named))
        by_word = np.isin(self.named, heavy)
        self.heavy = by_word
        self.pair_shard = np.where(by_word[self.before], shard(mix(self.named[self.before] + mix(self.named[self.after]))), self.word_shard[self.before])

    def of(self, shards: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """For each shard that has any, its words and its bigrams, in order."""
        w, p = np.argsort(self.word_shard, kind="stable"), np.argsort(self.pair_shard, kind="stable")
        we, pe = np.searchsorted(self.word_shard[w], np.arange(shards + 1)), np.searchsorted(self.pair_shard[p], np.arange(shards + 1))
        for s in range(shards):
            own_w, own_p = w[we[s] : we[s + 1]], p[pe[s] : pe[s + 1]]
            if len(own_w) or len(own_p):
                yield s, own_w, own_p


def _ask(shards: int, heavy: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                name, outs, vocabulary, texts = (batch.column(c)[i] for c in range(4))
                own = _Bigrams(vocabulary.as_py(), texts.as_py(), shards, heavy, np.asarray(outs.values).astype(bool))
                rows, data = [], []
                for s, w, p in own.of(shards):
                    first = np.flatnonzero(np.concatenate([[True], own.before[p][1:] != own.before[p][:-1]])) if len(p) else p
                    degree = np.diff(np.concatenate([first, [len(p)]])).astype(np.uint64)
                    short = own.named[own.after[p]] & _SHORT
                    octets = np.ascontiguousarray(short.view(np.uint8).reshape(-1, 8)[:, :_SHORT_BYTES])
                    body = pack(own.named[w], _narrow(own.word_count[w]), own.named[own.before[p][first]], _narrow(degree), _narrow(own.count[p].astype(np.uint64)), octets.ravel())
                    rows.append(s)
                    data.append(body)
                yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int32()), pa.array([name.as_py()] * len(rows), pa.int64()), pa.array(data, pa.binary())], ["shard", "batch", "asked"])

    return run


class _Asked:
    """All that batches ask of a shard: its distinct words and bigrams, their training counts, and where each batch's are."""

    def __init__(self, messages: pa.ChunkedArray):
        asked = [unpack(x.as_py(), np.uint64, np.uint64, np.uint64, np.int64, np.int64, np.uint8) for x in messages]
        bounds = lambda i: np.concatenate([[0], np.cumsum([len(a[i]) for a in asked])]).astype(np.int64)
        together = lambda i, kind: np.concatenate([np.zeros(0, kind), *(a[i] for a in asked)])
        self.word_at, self.pair_at = bounds(0), bounds(4)
        self.names, self.word = np.unique(together(0, np.uint64), return_inverse=True)
        self.count = np.bincount(self.word, together(1, np.uint64).astype(np.float64), minlength=len(self.names)).astype(np.int64)
        self.contexts, context = np.unique(together(2, np.uint64), return_inverse=True)
        wide = np.concatenate([together(5, np.uint8).reshape(-1, _SHORT_BYTES), np.zeros((self.pair_at[-1], 8 - _SHORT_BYTES), np.uint8)], 1)
        self.successors, successor = np.unique(np.ascontiguousarray(wide).view(np.uint64).ravel(), return_inverse=True)
        self.key, self.pair = np.unique(np.repeat(context, together(3, np.int64)) * len(self.successors) + successor, return_inverse=True)
        self.total = np.bincount(self.pair, together(4, np.int64).astype(np.float64), minlength=len(self.key)).astype(np.int64)

    def grams(self, some: np.ndarray | slice) -> np.ndarray:
        """The hashes of some bigrams, in lexicographic order."""
        n = max(len(self.successors), 1)
        return np.stack([self.contexts[self.key[some] // n], self.successors[self.key[some] % n]], 1)


def _built(asked: _Asked, heavy: dict[int, int], step: float) -> bytes:
    """A shard's share of the model: the trie of the bigrams that training has seen, and its words with their counts and distinct successors."""
    seen = asked.total > 0
    grams, owner = asked.grams(seen), asked.key[seen] // max(len(asked.successors), 1)
    distinct = np.bincount(owner, minlength=len(asked.contexts))
    of_context = np.bincount(owner, asked.total[seen].astype(np.float64), minlength=len(asked.contexts))
    known = np.array([c in heavy for c in asked.contexts.tolist()], bool)
    of_context[known] = [heavy[c] for c in asked.contexts[known].tolist()]
    share = np.maximum(asked.total[seen] - DISCOUNT, 0) / of_context[owner]
    value = np.clip(np.rint(-np.log10(share) / step), 0, 254).astype(np.uint8)
    roots = asked.contexts[distinct > 0]
    trie = Trie.of([(roots[:, None], np.zeros(len(roots), np.uint8)), (grams, value)]).tobytes()
    counted = asked.count > 0
    after = np.zeros(len(asked.names), np.uint64)
    at = np.searchsorted(asked.contexts, asked.names)
    hit = at < len(asked.contexts)
    hit[hit] = asked.contexts[at[hit]] == asked.names[hit]
    after[hit] = distinct[at[hit]]
    after[np.isin(asked.names, asked.contexts[known])] = 0  # those of heavy contexts are added up over the shards
    words_ = pack(asked.names[counted], _narrow(asked.count[counted].astype(np.uint64)), _narrow(after[counted]), asked.contexts[known], _narrow(distinct[known].astype(np.uint64)))
    return np.array([len(trie)], np.int64).tobytes() + trie + words_


def _replies(model: bytes, asked: _Asked, batches: list[int]) -> list[tuple[int, bytes]]:
    """What a shard's share of the model says of the words and bigrams asked: for each batch counts and distinct successors of its words, and codes of its bigrams, 0 for none."""
    size = int(np.frombuffer(model, np.int64, 1)[0])
    trie = map_trie(model[8 : 8 + size])
    known, count, after, *_ = unpack(model[8 + size :], np.uint64, np.int64, np.int64, np.uint64, np.int64)
    code = np.zeros(len(asked.key), np.uint8)
    for at in range(0, len(code), CHUNK // 16):
        node = trie.find(asked.grams(slice(at, at + CHUNK // 16)))
        code[at : at + CHUNK // 16][node >= 0] = trie.values[1][node[node >= 0]] + np.uint8(1)
    at = np.searchsorted(known, asked.names)
    hit = at < len(known)
    hit[hit] = known[at[hit]] == asked.names[hit]
    told = np.zeros((2, len(asked.names)), np.uint64)
    told[:, hit] = count[at[hit]], after[at[hit]]
    bounds = zip(batches, asked.word_at[:-1], asked.word_at[1:], asked.pair_at[:-1], asked.pair_at[1:], strict=True)
    return [(b, pack(_narrow(told[0][asked.word[w:x]]), _narrow(told[1][asked.word[w:x]]), code[asked.pair[p:y]])) for b, w, x, p, y in bounds]


ANSWER = "batch long, shard int, answer binary"


def _answers(shard: int, rows: list[tuple[int, bytes]]) -> pa.Table:
    batch, data = zip(*rows, strict=True) if rows else ((), ())
    return pa.table([pa.array(batch, pa.int64()), pa.array([shard] * len(rows), pa.int32()), pa.array(data, pa.binary())], ["batch", "shard", "answer"])


def _shard(heavy: dict[int, int], step: float, reply: bool):
    """All that batches ask of a shard -> the shard's share of the model, as batch -1, and, with ``reply``, an answer for each batch."""

    def run(table: pa.Table) -> pa.Table:
        asked = _Asked(table["asked"])
        model = _built(asked, heavy, step)
        return _answers(table["shard"][0].as_py(), [(-1, model), *(_replies(model, asked, table["batch"].to_pylist()) if reply else [])])

    return run


def _look_up(left: pa.Table, right: pa.Table) -> pa.Table:
    """What batches ask of a shard and its share of the model -> an answer for each batch."""
    if not left.num_rows:
        return _answers(0, [])
    asked = _Asked(left["asked"])
    model = right["answer"][0].as_py() if right.num_rows else _built(_Asked(pa.chunked_array([], pa.binary())), {}, 1.0)
    return _answers(left["shard"][0].as_py(), _replies(model, asked, left["batch"].to_pylist()))


def _summary(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Shares of the model -> their number of words, as name 0, and the distinct successors of heavy contexts."""
    for batch in batches:
        for data in batch.column(0):
            model = data.as_py()
            size = int(np.frombuffer(model, np.int64, 1)[0])
            known, *_, contexts, distinct = unpack(model[8 + size :], np.uint64, np.int64, np.int64, np.uint64, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.append(contexts.view(np.int64), 0)), pa.array(np.append(distinct, 0)), pa.array(np.append(np.zeros(len(contexts), np.int64), len(known)))], ["name", "n", "words"])


def _add_up(shards: int, heavy: dict[int, tuple[int, int]], total: int, words_seen: int, step: float):
    """A token batch and its answers -> a row a text."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        outs = np.asarray(left["outs"].combine_chunks().flatten()).astype(bool)
        own = _Bigrams(left["vocabulary"][0].as_py(), left["texts"][0].as_py(), shards, np.array(list(heavy), np.uint64), outs)
        count, after = np.zeros(len(own.named), np.int64), np.zeros(len(own.named), np.int64)
        code = np.zeros(len(own.before), np.uint8)
        answers = dict(zip(right["shard"].to_pylist(), right["answer"], strict=True))
        for s, w, p in own.of(shards):
            count[w], after[w], code[p] = unpack(answers[s].as_py(), np.int64, np.int64, np.uint8)
        context = count.copy()
        for i in np.flatnonzero(own.heavy):
            context[i], after[i] = heavy[int(own.named[i])]
        single = (count + 1) / (total + words_seen + 1)
        back = np.where(context > 0, DISCOUNT * after / np.maximum(context, 1), 1.0)
        share = np.where(code > 0, 10.0 ** (-step * (code.astype(np.float64) - 1)), 0.0)
        logs = np.log10(share + back[own.before] * single[own.after])
        base = np.log10(single)
        tokens = own.lengths + 1
        sums = lambda x: np.add.reduceat(x, own.starts) if len(own.starts) else np.zeros(0)
        return pa.table(
            [
                left["ids"].combine_chunks().flatten(),
                pa.array(outs),
                pa.array(tokens),
                pa.array(sums((count > 0)[own.current].astype(np.int64))),
                pa.array(np.full(len(tokens), total)),
                pa.array(sums(base[own.current])),
                pa.array(sums(logs[own.inverse])),
            ],
            ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
        )

    return run


def _kind(docs: DataFrame) -> str:
    return docs.schema["doc_id"].dataType.simpleString()


def _tokens(docs: DataFrame) -> DataFrame:
    made = docs.select("doc_id", "held_out", "text").mapInArrow(
        _tokenise, f"batch long, ids array<{_kind(docs)}>, outs array<boolean>, tokens long, train_words long, train_texts long, vocabulary binary, texts binary"
    )
    return keep(made, "lm-tokens")


@dataclass
class Model:
    """A stored model: ``shares`` (shard, answer) hold the tries, the rest a bounded number of figures."""

    shares: DataFrame
    shards: int
    heavy: dict[int, tuple[int, int]]
    total: int
    words_seen: int
    step: float

    def _scored(self, tokens: DataFrame, answers: DataFrame, kind: str) -> DataFrame:
        left, right = tokens.select("batch", "ids", "outs", "vocabulary", "texts"), answers.select("batch", "shard", "answer")
        return left.groupBy("batch").cogroup(right.groupBy("batch")).applyInArrow(
            _add_up(self.shards, self.heavy, self.total, self.words_seen, self.step),
            f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double",
        )

    def score(self, docs: DataFrame) -> DataFrame:
        """As :func:`score`, for documents (doc_id, held_out, text) that the model need not know."""
        tokens = _tokens(docs)
        asked = tokens.select("batch", "outs", "vocabulary", "texts").mapInArrow(_ask(self.shards, np.array(list(self.heavy), np.uint64)), "shard int, batch long, asked binary")
        found = asked.groupBy("shard").cogroup(self.shares.groupBy("shard")).applyInArrow(_look_up, ANSWER)
        return self._scored(tokens, found, _kind(docs))


def _trained(docs: DataFrame, reply: bool) -> tuple[Model, DataFrame, DataFrame]:
    tokens = _tokens(docs)
    everything = tokens.agg(F.sum("tokens"), F.sum("train_words"), F.sum("train_texts")).first()
    all_tokens, train_words, train_texts = (x or 0 for x in everything)
    shards = 3 + all_tokens // SHARD
    total = train_words + train_texts
    # contexts frequent anywhere, then the exact counts of the frequent ones: under 4 * HEAVY, then HEAVY rows
    found = lambda only: tokens.select("vocabulary").mapInArrow(_frequent(only), "name long, n long").groupBy("name").agg(F.sum("n").alias("n"))
    likely = found(None).filter(F.col("n") > train_words / (2 * HEAVY)).select("name").collect()
    exact = found(np.array([r["name"] for r in likely], np.int64).view(np.uint64)).filter(F.col("n") > train_words / HEAVY).collect()
    heavy = {int(np.int64(r["name"]).view(np.uint64)): r["n"] for r in exact} | {int(START): train_texts}
    step = max(np.log10(total + 10.0) + 0.7, 1.0) / 254
    asked = tokens.select("batch", "outs", "vocabulary", "texts").mapInArrow(_ask(shards, np.array(list(heavy), np.uint64)), "shard int, batch long, asked binary")
    answers = keep(asked.groupBy("shard").applyInArrow(_shard(heavy, step, reply), ANSWER), "lm-answers")
    shares = answers.filter("batch = -1").select("shard", "answer")
    told = shares.select("answer").mapInArrow(_summary, "name long, n long, words long").groupBy("name").agg(F.sum("n").alias("n"), F.sum("words").alias("words")).collect()  # HEAVY + 2 rows at most
    after = {int(np.int64(r["name"]).view(np.uint64)): r["n"] for r in told}
    return Model(shares, shards, {name: (n, after.get(name, 0)) for name, n in heavy.items()}, total, sum(r["words"] for r in told), step), tokens, answers


def train(docs: DataFrame) -> Model:
    """The model of the documents (doc_id, held_out, text) that are not held out."""
    return _trained(docs, False)[0]


def score(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every document (doc_id, held_out, text); those not held out train
    the model. Each shard answers right after it has built its share, so counts and questions travel once."""
    model, tokens, answers = _trained(docs, True)
    return model._scored(tokens, answers.filter("batch >= 0"), _kind(docs))
