"""Text operators against plain Python."""

import collections
import hashlib
import math
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tests.llm.helpers import crowded, documents, frame
from vellum.llm import catalog, chat, components, eliasfano, jaccard, langid, lm, mixing, pieces, quality, shard

WORD = re.compile(r"[^\x20\x09-\x0D]+")


# --- shards


@pytest.mark.parametrize("wide", [False, True])
def test_shards(spark, wide):
    df = frame(spark)
    got = shard.shard_documents(crowded(df) if wide else df, shards=7).collect()
    rows = documents()
    assert sorted((r["doc_id"] is None, r["doc_id"], r["size"], r["text_crc32"]) for r in got) == sorted((i is None, i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t, *_ in rows)
    slots = collections.defaultdict(list)
    for r in got:
        slots[r["shard"]].append(r["slot"])
    assert set(slots) <= set(range(7)) and max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())


def test_shards_keep_groups_together(spark):
    rows = [(i, f"text {i // 3}") for i in range(600)] + [(1000 + i, "huge") for i in range(300)] + [(2000 + i, f"single {i}") for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    where = {r["doc_id"]: r["shard"] for r in shard.shard_documents(df, shards=8).collect()}
    together = sum(len({where[3 * g], where[3 * g + 1], where[3 * g + 2]}) == 1 for g in range(200))
    assert together >= 190
    huge = collections.Counter(where[1000 + i] for i in range(300))
    assert len(huge) <= 5  # 300 rows, 150 to a shard
    assert set(collections.Counter(where.values()).values()) == {150}


def test_shards_of_nothing(spark):
    assert shard.shard_documents(frame(spark, []), shards=3).collect() == []


# --- quality


def test_quality(spark):
    rows, labels = [], []
    for i in range(300):
        words = ["good", "plain", "text", "of", "words"] * (1 + i % 4)
        kind = i % 3
        words += ["!!!", "$$$"] if kind == 0 else ["nasty"] if kind == 1 else ["fine"]
        rows.append((i, " ".join(words), "en", "s", 1))
        if i % 2:
            labels.append((i, 0 if kind == 0 else 1, 1 if kind == 1 else 0))
    labels += [(None, 1, 0), (4, None, None)]
    docs, told = frame(spark, rows + documents(5)), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = quality.train(docs, told, most=200)
    assert (np.diff(model.thresholds) > 0).all()
    got = {r["text"]: r for r in quality.score(docs, model).collect()}
    for i, text, *_ in rows:
        r = got[text]
        assert round(r["expected_grade"]) == i % 3 and (r["tail"] >= 0.5) == (i % 3 == 2)
    assert quality.score(docs, model).count() == len(rows) + len(documents(5))


def test_quality_without_labels(spark):
    empty = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = quality.score(crowded(frame(spark)), quality.train(frame(spark), empty))
    assert {(r["expected_grade"], r["tail"]) for r in got.collect()} == {(2.0, 1.0)}
    assert quality.score(frame(spark, []), quality.train(frame(spark, []), empty)).collect() == []


def units_of(text):
    """Words (letters, digits, all beyond ASCII; A-Z as a-z) and runs of other characters, in order; and the words in capitals."""
    spaceless = re.findall(r"[0-9A-Za-z\x80-\U0010ffff]+|[^0-9A-Za-z\x80-\U0010ffff \t\n\x0b\x0c\r]+", text or "")
    low = ["".join(c.lower() if "A" <= c <= "Z" else c for c in u) for u in spaceless]
    capital = sum(sum("A" <= c <= "Z" for c in u) > 1 and not any("a" <= c <= "z" for c in u) for u in spaceless)
    return low, capital


def plain_features(text):
    low, capital = units_of(text)
    own = {u: math.log1p(n) for u, n in collections.Counter(low).items()} | ({"CAPITALS": math.log1p(capital)} if capital else {})
    norm = math.sqrt(sum(w * w for w in own.values()))
    own = {u: w / norm for u, w in own.items()}
    pairs = collections.Counter(zip(low[:-1], low[1:], strict=True))
    if pairs:
        top = max(pairs.values())
        own["REPEATS", min(int(math.log2(top)), 15), min(int(-math.log2(top / pairs.total())), 15)] = 1.0
    return own


def test_quality_features_against_plain_python():
    texts = [t or "" for _, t, *_ in documents(80)] + ["Ab ab!! XY", "go go go go", "", "one"]
    data = [t.encode() for t in texts]
    row, name, weight = quality.features(np.frombuffer(b"".join(data), np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in data])]))
    assert (np.diff(row) >= 0).all()
    for i, text in enumerate(texts):
        want = sorted(plain_features(text).values())
        assert np.allclose(np.sort(weight[row == i]), want, atol=1e-6)
        repeats = [int(x) - 54321 for x, w in zip(name[row == i], weight[row == i], strict=True) if 54321 <= x < 54321 + 256 and w == 1]
        assert [(x // 16, x % 16) for x in repeats][-1:] == [k[1:] for k in plain_features(text) if isinstance(k, tuple)]


def test_quality_fit_is_the_maximum():
    """The fitted model against the likelihood computed by definition: nothing near it is better."""
    rng = np.random.default_rng(12)
    grades = np.repeat([0, 1, 2], [60, 40, 100])
    names = [np.unique(np.concatenate([rng.integers(0, 6, 3), rng.choice([100 + g, 103], 1), [200]])).astype(np.uint32) for g in grades]
    weights = [rng.uniform(0.2, 1, len(x)).astype(np.float32) for x in names]
    model = quality.fit(names, weights, grades, rounds=3000)
    share = (1 / np.bincount(grades))[grades] / 3

    def loss(w, t):
        total = 0.5e-5 * (w**2).sum()
        for x, v, g, s in zip(names, weights, grades, share, strict=True):
            above = [1.0, *(1 / (1 + math.exp(min(500, c - float(w[x] @ v)))) for c in t), 0.0]
            total -= s * math.log(max(above[g] - above[g + 1], 1e-12))
        return total

    w = model.weights.astype(float)
    best = loss(w, model.thresholds)
    assert (w <= 0).all() and (w < 0).any()
    for i in np.flatnonzero(w < 0):
        for step in (-0.05, 0.05):
            near = w.copy()
            near[i] = min(0, near[i] + step)
            assert loss(near, model.thresholds) >= best - 1e-5
    for j in range(2):
        for step in (-0.05, 0.05):
            near = model.thresholds.copy()
            near[j] += step
            assert loss(w, near) >= best - 1e-5


def test_quality_of_repeated_documents(spark):
    """A labelled document that is there a thousand times counts once in training."""
    rows = [(i, "good words here" if i % 2 else "bad !!! words", "en", "s", 1) for i in range(40)]
    told = spark.createDataFrame([(i, i % 2, 0) for i in range(40)], "doc_id long, quality int, toxic int")
    once = quality.train(frame(spark, rows), told)
    many = quality.train(frame(spark, rows + [rows[3]] * 1000), told)
    assert (once.weights == many.weights).all() and (once.thresholds == many.thresholds).all()


# --- language


def test_language_matches_counting(spark, monkeypatch):
    monkeypatch.setattr(langid, "CHUNK", 1 << 19)
    rows = documents()
    docs = frame(spark, rows)
    model = langid.train(docs)
    counts = {}
    for _, text, lang, *_ in rows:
        if text is not None and lang is not None:
            own = counts.setdefault(lang, collections.Counter())
            t = text.lower()
            for n in (1, 2, 3):
                own.update(t[i : i + n] for i in range(len(t) - n + 1))

    def bucket(gram):
        points = np.array([ord(c) for c in gram], np.uint32)
        *_, (b, ok) = [x for x, _ in zip(langid._buckets(points, np.array([0, len(points)])), gram, strict=False)]
        return int(b[0])

    logs = {}
    for lang, own in counts.items():
        table = np.zeros(langid.BUCKETS)
        for gram, n in own.items():
            table[bucket(gram)] += n
        logs[lang] = np.log((table + langid.SMOOTHING) / (table.sum() + langid.SMOOTHING * langid.BUCKETS))
    assert model.languages == sorted(counts)
    for j, lang in enumerate(model.languages):
        assert np.allclose(model.table[j][:-1], logs[lang], atol=1e-5)
    got = langid.predict(crowded(docs), model).collect()
    assert len(got) == len(rows)
    for r in got:
        if not re.search(r"[^\W\d_]", r["text"] or ""):
            assert (r["lang_pred"], r["score"]) == ("und", 0.0)
        else:
            assert r["lang_pred"] in model.languages and 0 <= r["score"] <= 1


def test_language_predictions_against_plain_python(spark):
    rows = documents()
    model = langid.train(frame(spark, rows))
    counts, texts = {}, collections.Counter()
    grams = lambda t: [t[i : i + n] for n in (1, 2, 3) for i in range(len(t) - n + 1)]

    def bucket(gram):
        points = np.array([ord(c) for c in gram], np.uint32)
        return int([b for b, _ in langid._buckets(points, np.array([0, len(points)]))][len(gram) - 1][0])

    known = {}
    for _, text, lang, *_ in rows:
        if text is not None and lang is not None:
            texts[lang] += 1
            counts.setdefault(lang, collections.Counter()).update(known.setdefault(g, bucket(g)) for g in grams(text.lower()))
    for r in langid.predict(frame(spark, rows), model).collect():
        text = (r["text"] or "").lower()
        if not re.search(r"[^\W\d_]", text):
            continue
        logs = {}
        for lang, own in counts.items():
            total = own.total() + langid.SMOOTHING * langid.BUCKETS
            logs[lang] = math.log(texts[lang] / texts.total()) + sum(math.log((own[known.setdefault(g, bucket(g))] + langid.SMOOTHING) / total) for g in grams(text))
        top = max(logs, key=logs.get)
        share = 1 / sum(math.exp(x - logs[top]) for x in logs.values())
        if share > 0.51:
            assert r["lang_pred"] == top
        assert math.isclose(r["score"], share, rel_tol=0.01, abs_tol=0.01)


def test_language_accuracy(spark):
    de = ["der und die das ist nicht schön", "ich habe keine zeit für das", "über die brücke geht der mann"]
    en = ["the quick brown fox is not here", "i have no time for this", "over the bridge goes the man"]
    rows = [(i, " ".join(np.random.default_rng(i).permutation((de if i % 2 else en)[i % 3].split())), "de" if i % 2 else "en", "s", 1) for i in range(90)]
    got = langid.predict(frame(spark, rows), langid.train(frame(spark, rows[:45]))).collect()
    assert sum(r["lang_pred"] == r["lang"] for r in got) >= 88


def test_language_pieces_of_long_texts(monkeypatch):
    text = "abcdefghij" * 50
    whole = [np.sort(b[ok]) for p, _, bounds in langid._chunks([text]) for b, ok in langid._buckets(p, bounds)]
    monkeypatch.setattr(langid, "CHUNK", 64)
    parts = [[], [], []]
    for p, _, bounds in langid._chunks([text]):
        for i, (b, ok) in enumerate(langid._buckets(p, bounds)):
            parts[i].append(b[ok])
    assert all((np.sort(np.concatenate(a)) == b).all() for a, b in zip(parts, whole, strict=True))


def test_language_nothing_learned(spark):
    got = langid.predict(frame(spark), langid.train(frame(spark, [])))
    assert {(r["lang_pred"], r["score"]) for r in got.collect()} == {("und", 0.0)}


# --- language model


def brute_lm(rows, held=None):
    def tokens(text):
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        return [*WORD.findall(low), None]

    texts = [(i, i in held if held else zlib.crc32(str(i).encode()) % 7 == 2 if i is not None else False, tokens(t)) for i, t, *_ in rows]
    one, two, after = collections.Counter(), collections.Counter(), collections.defaultdict(set)
    before = collections.Counter()
    for _, out, words in texts:
        if not out:
            one.update(words)
            for v, w in zip(["<s>", *words[:-1]], words, strict=True):
                two[v, w] += 1
                before[v] += 1
                after[v].add(w)
    n, kinds = sum(one.values()), len(one)
    result = []
    for i, out, words in texts:
        p1 = {w: (one[w] + 1) / (n + kinds + 1) for w in words}
        total = 0.0
        for v, w in zip(["<s>", *words[:-1]], words, strict=True):
            back = lm.DISCOUNT * len(after[v]) / before[v] if before[v] else 1.0
            total += math.log10((max(two[v, w] - lm.DISCOUNT, 0) / before[v] if before[v] else 0) + back * p1[w])
        result.append((i, out, len(words), sum(one[w] > 0 for w in words), n, sum(math.log10(p1[w]) for w in words), total))
    return result


@pytest.mark.parametrize("batch", [50, 1_500_000])
def test_language_model(spark, monkeypatch, batch):
    rows = documents(120)
    df = crowded(frame(spark, rows)).withColumn("held_out", langid.held_out(7, 2))
    monkeypatch.setattr(lm, "SHARD", 200)
    got = [tuple(r) for r in lm.score(df).collect()]
    want = brute_lm(rows)
    key = lambda r: (r[0] is None, r[0] or 0, r[2])
    assert len(got) == len(want)
    step = (math.log10(want[0][4] + 10) + 0.7) / 254
    for a, b in zip(sorted(got, key=key), sorted(want, key=key), strict=True):
        assert a[:5] == b[:5]
        assert math.isclose(a[5], b[5], rel_tol=1e-9)
        assert abs(a[6] - b[6]) <= a[2] * step / 2 + 1e-9


def test_stored_model_scores_by_its_trie(spark, monkeypatch):
    """The stored tries score the documents they were made of as scoring at once does, other documents by definition, and otherwise once a byte of theirs changes."""
    monkeypatch.setattr(lm, "SHARD", 200)
    monkeypatch.setattr(lm, "BATCH", 60)
    rows = documents(80)
    df = frame(spark, rows).withColumn("held_out", langid.held_out(7, 2))
    model = lm.train(df)
    columns = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    tidy = lambda got: sorted(repr(tuple(round(x, 9) if isinstance(x, float) else x for x in r)) for r in got.select(*columns).collect())
    assert tidy(model.score(df)) == tidy(lm.score(df))
    new = [(9000, "alpha beta gamma unknownword the of", "en", "s", 1), (9001, None, "en", "s", 1)]
    asked = spark.createDataFrame([(*r, True) for r in new], "doc_id long, text string, lang string, source string, n_chars long, held_out boolean")
    want = {r[0]: r for r in brute_lm([r for r in rows if not (r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 2)] + new, held={9000, 9001})}
    step = (math.log10(model.total + 10) + 0.7) / 254
    for r in model.score(asked).collect():
        w = want[r["doc_id"]]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == w[2:5] and math.isclose(r["base_score"], w[5], rel_tol=1e-9)
        assert abs(r["score"] - w[6]) <= r["n_tokens"] * step / 2 + 1e-9

    def broken(data):
        size = int(np.frombuffer(bytes(data), np.int64, 1)[0])
        trie = eliasfano.Trie.frombytes(np.frombuffer(bytes(data[8 : 8 + size]), np.uint8))
        trie.values[1] = 254 - trie.values[1]
        return bytes(data[:8]) + trie.tobytes() + bytes(data[8 + size :])

    model.shares = model.shares.select("shard", F.udf(broken, "binary")("answer").alias("answer"))
    assert tidy(model.score(df)) != tidy(lm.score(df))


def test_language_model_of_nothing(spark):
    assert lm.score(frame(spark, []).withColumn("held_out", F.lit(False))).collect() == []
    got = lm.score(frame(spark, [(1, "a b", "en", "s", 1)]).withColumn("held_out", F.lit(True))).collect()
    assert [(r["n_tokens"], r["n_known"], r["train_tokens"], r["score"]) for r in got] == [(3, 0, 0, 0.0)]


def test_elias_fano():
    rng = np.random.default_rng(2)
    for values in (np.array([], np.uint64), np.array([0, 0, 7, 7, 1 << 40], np.uint64), np.sort(rng.integers(0, 1 << 63, 999).astype(np.uint64)), np.sort(rng.integers(0, 300, 2000).astype(np.uint64)), np.array([2**64 - 1], np.uint64)):
        ef = eliasfano.EliasFano.of(values)
        assert (ef.access(np.arange(len(values))) == values).all()
        wanted = np.concatenate([values, values + np.uint64(1), np.zeros(1, np.uint64)])
        place = ef.successor(np.zeros(len(wanted), np.int64), np.full(len(wanted), len(values)), wanted)
        assert (place == np.searchsorted(values, wanted)).all()


def test_trie_of_trigrams():
    rng = np.random.default_rng(4)
    three = np.unique(rng.integers(0, 12, (400, 3)), axis=0)
    levels = [np.unique(three[:, : k + 1], axis=0) for k in range(3)]
    trie = eliasfano.Trie.of([(x, np.arange(len(x)) % 256) for x in levels]).mapped()
    for k, rows in enumerate(levels):
        assert (trie.find(rows) == np.arange(len(rows))).all()
        other = rng.integers(0, 14, (300, k + 1))
        known = {tuple(r): i for i, r in enumerate(rows.tolist())}
        assert trie.find(other).tolist() == [known.get(tuple(r), -1) for r in other.tolist()]
    with pytest.raises(ValueError):
        eliasfano.Trie.of([(np.array([[1]]), np.array([0])), (np.array([[2, 3]]), np.array([0]))])


# --- chat


def test_chat(spark):
    rows = [(1, 0, "user", "hi <|im_end|>"), (1, 1, "assistant", "a<\\|b"), (1, 2, "assistant", None), (1, 3, "assistant", "<<|\\<\\\\|im_start|>\n"), (2, None, None, "x"), (2, 5, "us\ner<|", "y"), (2, 5, "us\ner<|", "y"), (None, 0, "assistant", ""), (3, 1, "assistant", "late"), (3, 0, "assistant", "early")]
    df = crowded(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3))
    made = chat.format_conversations(df)
    got = {r["conv_id"]: r for r in chat.digest(made).collect()}
    text = {r["conv_id"]: r["formatted"] for r in made.collect()}
    for conv in (1, 2, 3, None):
        turns = sorted([(-1 if t is None else t, r or "", x or "") for c, t, r, x in rows if c == conv])
        loss = "".join(x for _, r, x in turns if r == "assistant")
        r = got[conv]
        assert r["n_turns"] == len(turns)
        assert r["turns_sha256"] == hashlib.sha256("".join(f"{b}\n{c}\n" for _, b, c in turns).encode()).hexdigest()
        assert (r["loss_chars"], r["loss_sha256"]) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
        assert r["formatted_chars"] == len(text[conv])
    assert got[1]["n_messages"] == 2 and text[3] == "<|im_start|>assistant\nearly<|im_part|>late<|im_end|>\n"
    assert chat.format_conversations(df.limit(0)).collect() == []


def test_chat_needs_no_python(spark):
    made = catalog.op6_chat_format(spark, "/root/testdata/sf0.001")
    assert "Python" not in made._jdf.queryExecution().toRdd().toDebugString()


# --- mix


def test_mix(spark):
    rows = documents(300)
    df = crowded(frame(spark, rows))
    got = mixing.mix_plan(df).collect()
    size = collections.Counter()
    for _, t, _, s, _ in rows:
        size[s] += len(WORD.findall(t or ""))
    order = sorted(size, key=lambda s: (s is None, s or ""))
    weight = {s: 1 + i % 3 for i, s in enumerate(order)}
    target, free, rest = {}, set(size), sum(size.values())
    while True:
        share = {s: rest * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if share[s] > 3 * size[s]}
        if not over:
            break
        target |= {s: 3.0 * size[s] for s in over}
        rest -= sum(3 * size[s] for s in over)
        free -= over
    target |= share
    taken, largest = collections.Counter(), collections.Counter()
    for r in got:
        assert r["size"] == len(WORD.findall(r["text"] or "")) and r["source_size"] == size[r["source"]]
        assert math.isclose(r["target"], target[r["source"]], rel_tol=1e-12)
        assert 0 <= r["taken"] <= 3 * r["size"]
        taken[r["source"]] += r["taken"]
        largest[r["source"]] = max(largest[r["source"]], r["size"])
    assert len(got) == len(rows)
    assert all(abs(taken[s] - target[s]) <= 2 * largest[s] for s in size)
    again = mixing.mix_plan(df.repartition(5)).collect()
    assert sorted(map(repr, got)) == sorted(map(repr, again))
    assert mixing.mix(df).count() == sum(r["copies"] for r in got)
    assert mixing.mix(df).columns == df.columns
    assert mixing.mix_plan(frame(spark, [])).collect() == []


# --- pieces


@pytest.fixture(scope="module")
def vocabulary():
    return pieces.Pieces.load(catalog.VOCABULARY)


def test_pieces_are_lossless(spark, vocabulary):
    df = crowded(frame(spark))
    made = pieces.decode(pieces.encode(df, vocabulary), vocabulary).collect()
    assert len(made) == len(documents())
    for r in made:
        assert r["decoded"] == r["text"] and (r["pieces"] is None) == (r["text"] is None)
    again = {(r["doc_id"], r["text"], tuple(r["pieces"] or ())) for r in pieces.encode(frame(spark).repartition(7), vocabulary).collect()}
    assert again == {(r["doc_id"], r["text"], tuple(r["pieces"] or ())) for r in made}
    other = {r["doc_id"]: r["pieces"] for r in pieces.encode(frame(spark), vocabulary, seed=1).collect()}
    assert any(other[r["doc_id"]] != r["pieces"] for r in made)
    assert pieces.encode(frame(spark, []), vocabulary).collect() == []


def test_pieces_follow_their_distribution():
    small = pieces.Pieces({300: "▁a", 301: "b", 302: "▁", 303: "a", 304: "ab", 305: "▁ab"}, list(range(256)))
    ids, bounds = pieces.sample(small, ["ab"] * 20000, np.random.default_rng(0).integers(0, 1 << 63, 20000, dtype=np.uint64))
    got = collections.Counter(tuple(ids[a:b].tolist()) for a, b in zip(bounds[:-1], bounds[1:], strict=True))
    weigh = lambda path: math.prod(1 / (i - 300 + 2) for i in path)
    paths = [(300, 301), (302, 303, 301), (302, 304), (305,)]
    total = sum(map(weigh, paths))
    assert set(got) == set(paths)
    for p in paths:
        assert abs(got[p] / 20000 - weigh(p) / total) < 0.015


def test_long_spans_in_windows(vocabulary, monkeypatch):
    """Texts without spaces, by windows of three sizes and by one lattice."""
    rng = np.random.default_rng(1)
    base = "中文维基百科的人工智能是研究开发用于模拟延伸abc▁日本語🙂"
    texts = ["".join(base[i] for i in rng.integers(0, len(base), n)) for n in (3000, 1999, 40)]
    texts = [*texts, texts[0], "plain words", texts[1] + " and after"]
    seeds = np.arange(len(texts), dtype=np.uint64) * np.uint64(7919)
    whole = pieces.sample(vocabulary, texts, seeds)
    for window in (1, 17, 1000):
        monkeypatch.setattr(pieces, "LONG", window)
        ids, bounds = pieces.sample(vocabulary, texts, seeds)
        assert ids.tolist() == whole[0].tolist() and bounds.tolist() == whole[1].tolist()


def test_two_million_characters_without_a_space(vocabulary):
    text = "".join(chr(0x4E00 + i) for i in np.random.default_rng(2).integers(0, 900, 2_000_000))
    ids, _ = pieces.sample(vocabulary, [text], np.array([5], np.uint64))
    assert pieces.join(vocabulary, ids.tolist()) == text


def test_memory_of_unspaced_text(vocabulary):
    """What one text holds at once: far less than a table of all places and piece lengths."""
    import tracemalloc

    text = "".join(chr(0x4E00 + i) for i in np.random.default_rng(2).integers(0, 900, 200_000))
    tracemalloc.start()
    pieces.sample(vocabulary, [text], np.array([5], np.uint64))
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 400 * len(text)


def test_pieces_refuse_crossing_vocabulary():
    with pytest.raises(ValueError):
        pieces.Pieces({300: "a▁b"}, list(range(256)))


# --- near duplicates


def brute_sets(rows):
    sets = []
    for i, t, *_ in rows:
        w = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        sets.append((i, {tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))} if w else set()))
    return sets


def near_rows(n=150, seed=9):
    rng = np.random.default_rng(seed)
    rows = []
    for g in range(n // 10):
        words = [f"w{x}" for x in rng.integers(0, 5000, 120)]
        for j in range(10):
            own = list(words)
            for at in rng.integers(0, len(own), int(rng.integers(0, 5))):
                own[at] = f"z{rng.integers(0, 999)}"
            rows.append((10 * g + j, " ".join(own), "en", "s", 1))
    return rows + [(1000 + i, *r[1:]) for i, r in enumerate(documents(20))]


def closure(links, nodes):
    root = {x: x for x in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    return {x: find(x) for x in nodes}


@pytest.mark.parametrize(("block", "rows_", "pairs"), [(500_000, 1024, 200_000), (300, 1024, 50), (10**9, 2, 1), (100, 3, 7)])
def test_jaccard_join(spark, monkeypatch, block, rows_, pairs):
    monkeypatch.setattr(jaccard, "BLOCK_GRAMS", block)
    monkeypatch.setattr(jaccard, "BLOCK_ROWS", rows_)
    monkeypatch.setattr(jaccard, "PAIRS", pairs)
    rows = near_rows()
    sets = brute_sets(rows)
    links = [(a, b) for i, (a, x) in enumerate(sets) for b, y in sets[:i] if x and y and len(x & y) / len(x | y) >= 0.8]
    count = collections.Counter(x for pair in links for x in pair)
    group = closure(links, [i for i, _ in sets])
    got = jaccard.Join(crowded(frame(spark, rows))).members().collect()
    assert len(got) == len(rows)
    assert {r["doc_id"]: (r["class_id"], r["n_links"]) for r in got} == {i: (group[i], count[i]) for i, _ in sets}


@pytest.mark.parametrize("rows_", [1024, 4])
def test_jaccard_chain(spark, monkeypatch, rows_):
    """A chain of texts, each similar to the next ones only: one group, sent bucket by bucket where it is large."""
    monkeypatch.setattr(jaccard, "BLOCK_ROWS", rows_)
    words = [f"w{i}" for i in range(400)]
    rows = [(i, " ".join(words[3 * i : 3 * i + 60]), "en", "s", 1) for i in range(100)]
    sets = brute_sets(rows)
    links = [(a, b) for i, (a, x) in enumerate(sets) for b, y in sets[:i] if len(x & y) / len(x | y) >= 0.8]
    count = collections.Counter(x for pair in links for x in pair)
    group = closure(links, [i for i, _ in sets])
    join = jaccard.Join(frame(spark, rows))
    if rows_ == 4:
        assert join.groups.filter("band >= 0").count() and join.groups.count() <= 21 * 100 * 2
    assert {r["doc_id"]: (r["class_id"], r["n_links"]) for r in join.members().collect()} == {i: (group[i], count[i]) for i, _ in sets}


def test_jaccard_pairs(spark):
    rows = near_rows(60)
    sets = brute_sets(rows)
    # one text stands for equal word sequences
    first = {}
    for i, t, *_ in rows:
        w = tuple(WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")))
        if w:
            first[w] = min(first.get(w, i), i)
    names = set(first.values())
    want = {(min(a, b), max(a, b)): len(x & y) / len(x | y) for i, (a, x) in enumerate(sets) for b, y in sets[:i] if a in names and b in names and x and len(x & y) / len(x | y) >= 0.8}
    got = {(r["doc_a"], r["doc_b"]): r["similarity"] for r in jaccard.Join(frame(spark, rows)).pairs().collect()}
    assert got == want


def test_deduplicate(spark):
    rows = [*near_rows(80), (5, near_rows(80)[5][1], "en", "s", 1), (0, near_rows(80)[0][1], "en", "s", 1), *documents(8)]
    df = crowded(frame(spark, rows))
    left = jaccard.deduplicate(df)
    assert left.columns == df.columns
    kept = left.collect()
    texts = collections.Counter((r["doc_id"], r["text"]) for r in kept)
    wordless = collections.Counter((i, t) for i, t, *_ in rows if not WORD.findall(t or ""))
    assert {k: v for k, v in texts.items() if not WORD.findall(k[1] or "")} == dict(wordless)
    members = jaccard.Join(frame(spark, rows)).members().filter("root IS NOT NULL").collect()
    assert sum(v for k, v in texts.items() if WORD.findall(k[1] or "")) == len({r["root"] for r in members})
    assert jaccard.deduplicate(frame(spark, [])).collect() == []


def test_bands_reach_recall():
    bands, rows = jaccard.bands_and_rows(0.8, 0.9995)
    assert 1 - (1 - 0.8**rows) ** bands >= 0.9995 and bands * rows <= jaccard.MOST_HASHES
    with pytest.raises(ValueError):
        jaccard.bands_and_rows(0.01, 0.999)


def test_components(spark):
    rng = np.random.default_rng(6)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 300, (220, 2))] + [(i, i + 1) for i in range(400, 460)] + [(7, 7)]
    got = {r["node"]: r["root"] for r in components.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    nodes = {x for a, b in edges if a != b for x in (a, b)}
    assert got == closure([e for e in edges if e[0] != e[1]], nodes)
    assert components.components(spark.createDataFrame([], "u long, v long")).collect() == []


def test_pieces_joined_at_once():
    known = pieces.Pieces.load(catalog.VOCABULARY)
    texts = ["", "a", "été  \n", "gone", "多 x"]
    ids, bounds = pieces.sample(known, texts, np.arange(len(texts), dtype=np.uint64))
    listed = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(ids), mask=pa.array([t == "gone" for t in texts]))
    want = [None if x is None else pieces.join(known, x) for x in listed.to_pylist()]
    table = pa.array(known.out, pa.large_binary())
    assert pieces.join_all(table, listed) == want == [None if t == "gone" else t for t in texts]
    assert pieces.join_all(table, listed.slice(1, 3)) == want[1:4] and pieces.join_all(table, listed.slice(0, 0)) == []
