import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from molloom.llm import context_mixing as cm
from molloom.llm.common import fold

from .data import CASES, frame, made


def words(t):
    raw = re.sub(rb"[A-Z]", lambda m: m[0].lower(), (t or "").encode())
    return [x for x in re.split(rb"[\x20\x09-\x0D]+", raw) if x]


def test_base_equals_brute_force(spark):
    texts = CASES + made(120, 8) + ["the cat the dog The"] * 5
    df = frame(spark, texts).selectExpr("*", "1 AS HELD_OUT", "2 AS score")
    held = {r.doc_id for r in df.where(fold("doc_id", 7) == 2).collect()}
    counts = Counter(x for i, t in enumerate(texts) if i not in held for x in [*words(t), None])
    n, v = sum(counts.values()), len(counts)
    got = {r.doc_id: r for r in cm.scores(df, fold("doc_id", 7) == 2).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        tokens = [*words(t), None]
        r = got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (i in held, len(tokens), sum(x in counts for x in tokens), n)
        assert r.base_score == pytest.approx(sum(math.log10((counts[x] + 1) / (n + v + 1)) for x in tokens))
        assert r.score < 0


def test_the_model_learns(spark):
    texts = [f"the cat number {k} sat on the mat and looked at the other cat for {k} minutes " * 3 for k in range(80)]
    got = cm.scores(frame(spark, texts), fold("doc_id", 7) == 2).collect()
    bits = [-r.score / math.log10(2) / len(texts[r.doc_id]) for r in got if r.held_out]
    assert bits and max(bits) < 1.5
    assert all(r.score > r.base_score for r in got if r.held_out)
    assert all(r.bits_per_byte == pytest.approx(-r.score / math.log10(2) / len(texts[r.doc_id])) for r in got)


def test_copies_stand_apart(spark):
    """A text with a copy is scored by that copy, one without by the others only, whether it taught or not."""
    r = random.Random(4)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(r.randint(2, 7)))
    texts = [" ".join(word() for _ in range(120)) for _ in range(40)]
    texts += texts[:10]
    got = {x.doc_id: x.score / x.n_tokens for x in cm.scores(frame(spark, texts), F.lit(False)).collect()}
    double = [*range(10), *range(40, 50)]
    assert max(got[k] for k in range(10, 40)) < 3 * min(got[k] for k in double) and max(got[k] for k in range(10, 40)) < -3


def words_of(texts):
    """Layout and inputs of texts that are words with a space behind each."""
    data = [b"".join(w + b" " for w in words(t)) for t in texts]
    return np.frombuffer(b"".join(data), np.uint8), np.array([len(words(t)) for t in texts]), np.array([len(x) for x in data])


def decision_path(tree, before, symbol):
    pair = before << 8 | symbol
    code = tree.codes[tree.at[pair] : tree.at[pair] + tree.size[pair]].tolist()
    return [(c & 255, c >> 8 & 1, c >> 9) for c in code]


def context_bytes(word, k):
    """What each predictor sees behind the letters of a word so far."""
    size = cm.PREDICTORS[k][0]
    return (word[-size:], min(len(word), size if size < 8 else 255)) if word else (b"", 0)


def test_symbol_costs_decision_by_decision():
    """Against a loop over single decisions with random tables; one text is longer than STEP."""
    texts = ["", "a bc", "the cat " * 60, "\u00e9t\u00e9 longlongword", "", "q"]
    flat, n, sizes = words_of(texts)
    entries = cm.Words(flat)
    tree = cm.Tree(np.random.default_rng(5).integers(0, 50, (256, 256)))
    r = np.random.default_rng(1)
    tables = [r.integers(-60, 60, 1 << bits).astype(np.int8) for _, bits in cm.PREDICTORS]
    keys = cm.Keys(entries, n, 3)
    tokens = np.full(len(keys.token_doc), len(entries.distinct))
    tokens[keys.word_at] = entries.code
    got = cm.symbol_costs(tables, tree, entries, tokens, n + 1)
    letters, length = entries.contexts()
    hashes = [cm.hashed(k, letters, length) for k in range(len(tables))]
    seen: list[dict] = [{} for _ in tables]
    place = 0
    for t in texts:
        weights, grads = {}, {}
        for number, w in enumerate([*words(t), None]):
            if number % cm.STEP == 0:
                for gate, g in grads.items():
                    weights[gate] = [a + b * cm.RATE / cm.SCALE for a, b in zip(weights.get(gate, cm.WEIGHTS), g)]
                grads = {}
            entry = len(entries.distinct) if w is None else entries.distinct.to_pylist().index(w)
            symbols, cost = [cm.END] if w is None else [*w, 32], 0.0
            for at, symbol in enumerate(symbols):
                spot = entries.at[entry] + at
                assert entries.symbols[spot] == symbol
                for k in range(len(tables)):  # equal contexts hash alike, different ones apart
                    own = context_bytes(b"" if w is None else w[:at], k)
                    assert seen[k].setdefault(own, hashes[k][spot]) == hashes[k][spot]
                for node, bit, depth in decision_path(tree, symbols[at - 1] if at else 32, symbol):
                    x = [float(t_[cm.slot(k, hashes[k][spot : spot + 1], np.array([node], np.uint32))[0]]) for k, t_ in enumerate(tables)]
                    gate = (min(depth, 5), abs(x[1]) > 7, abs(x[0]) > 7)
                    z = sum(a * b for a, b in zip(weights.get(gate, cm.WEIGHTS), x)) / cm.SCALE
                    p = 1 / (1 + math.exp(-min(max(z, -9), 9)))
                    cost += math.log2(max(p if bit else 1 - p, cm.FLOOR))
                    g = grads.setdefault(gate, [0.0] * len(tables))
                    for k in range(len(tables)):
                        g[k] += (bit - p) * x[k]
            assert got[place] == pytest.approx(cost, rel=1e-3, abs=1e-3)
            place += 1
    assert all(len(set(x.values())) == len(x) for x in seen)


def test_symbols_share_one_probability():
    """Over all 256 symbols at a word's start the probabilities sum to 1."""
    r = np.random.default_rng(2)
    tree = cm.Tree(r.integers(0, 9999, (256, 256)))
    tables = [r.integers(-60, 60, 1 << bits).astype(np.int8) for _, bits in cm.PREDICTORS]
    total = 0.0
    for symbol in range(256):
        one = cm.Words(np.frombuffer(b"x ", np.uint8))
        one.symbols[0], one.pairs[0] = symbol, 32 << 8 | symbol
        first, size, packed = cm.prepared(tables, tree, one)
        own = packed[: tree.size[32 << 8 | symbol]].view(np.int8).reshape(-1, 4).astype(float)
        p = 1 / (1 + np.exp(-np.clip(own[:, : len(tables)] @ np.array(cm.WEIGHTS) / cm.SCALE, -9, 9)))
        total += np.prod(np.where(own[:, 3].astype(int) & 1, p, 1 - p))
    assert total == pytest.approx(1, abs=1e-6)


def test_slots_count_every_training_symbol(spark):
    texts = ["ab ab c", "c", "held out", None, ""]
    docs = spark.createDataFrame([(k, t, t == "held out") for k, t in enumerate(texts)], "doc_id long, text string, held_out boolean")
    tree = cm.Tree(np.arange(1 << 16).reshape(256, 256) % 977)
    got = cm.train(cm.sliced(docs), tree)
    symbols = []
    for t in texts:
        if t != "held out":
            for w in words(t):
                symbols += [(w[:k], s) for k, s in enumerate([*w, 32])]
            symbols.append((b"", cm.END))
    for k, table in enumerate(got):
        counts = Counter()
        for context, symbol in symbols:
            letters = np.array([int.from_bytes(context[-8:], "big")], np.uint64)
            for node, bit, _ in decision_path(tree, context[-1] if context else 32, symbol):
                counts[int(cm.slot(k, cm.hashed(k, letters, np.array([len(context)])), np.array([node], np.uint32))[0]), bit] += 1
        want = np.zeros(len(table), np.int8)
        for at in {a for a, _ in counts}:
            want[at] = np.clip(np.rint(cm.SCALE * np.log((counts[at, 1] + 0.4) / (counts[at, 0] + 0.4))), -127, 127)
        assert (table == want).all() and want.any()


def test_experts_token_by_token():
    texts = ["the cat sat on the cat sat on the mat", "", "a b c", "the cat sat " * 30, "x"]
    learn = np.array([True, True, False, True, False])
    flat, n, sizes = words_of(texts)
    keys = cm.Keys(cm.Words(flat), n, 5)
    tokens = [[*words(t), None] for t in texts]
    c, grams = Counter(), Counter()
    for t, teaches in zip(tokens, learn):
        if teaches:
            c.update(t[:-1])
            for k in range(2, len(t)):
                grams[tuple(t[k - 2 : k])] += 1
                grams[tuple(t[k - 2 : k + 1])] += 1
    # through the rows that a slice sends, and back
    batch = pa.RecordBatch.from_arrays([pa.array([7]), cm._one(pa.array(~learn)), cm._one(pa.array(n)), pa.array([cm._pack(flat.tobytes())], pa.binary())], names=list("abcd"))
    back = [r for b in cm._counted(cm._sent(5)(iter([batch]))) for r in b.to_pylist()]
    totals, two, three = cm.totals_of(keys, back)
    assert [r["bucket"] for r in back] == sorted(r["bucket"] for r in back) and sum(r["n_distinct"] for r in back) == len(c)
    assert totals[keys.word].tolist() == [c[w] for t in tokens for w in t[:-1]]
    known = lambda key: grams[key] if grams[key] >= 2 or grams[key] and any(key == tuple(t[k - 2 : k + d]) for t, x in zip(tokens, learn) if not x for d in (0, 1) for k in range(2, len(t))) else 0
    assert two.tolist() == [known(tuple(t[k - 2 : k])) for t in tokens for k in range(2, len(t))]
    assert three.tolist() == [known(tuple(t[k - 2 : k + 1])) for t in tokens for k in range(2, len(t))]
    cost = -np.random.default_rng(3).random(sum(map(len, tokens))) * 30
    cost[4] = -2000.0  # beyond what a number holds
    total, n_texts = sum(c.values()) + int(learn.sum()), int(learn.sum())
    got = cm.token_scores(keys, cost, *cm.known_chances(keys, learn, totals, two, three, total, n_texts))
    at = 0
    for d, t in enumerate(tokens):
        own, own_grams = Counter(t[:-1]), Counter()
        for k in range(2, len(t)):
            own_grams.update([tuple(t[k - 2 : k]), tuple(t[k - 2 : k + 1])])
        share, new, bits = [list(x) for x in cm.EXPERTS], [[0.0] * 3 for _ in range(4)], 0.0
        for k, w in enumerate(t):
            if k % cm.FEW == 0:
                share = [[a + b for a, b in zip(x, y)] for x, y in zip(share, new)]
                new = [[0.0] * 3 for _ in range(4)]
            off = lambda counts, own, key: counts[key] - (own[key] if learn[d] else 0)
            alone = off(c, own, w) if w is not None else n_texts - int(learn[d])
            two_ = off(grams, own_grams, tuple(t[k - 2 : k])) if k >= 2 else 0
            three_ = off(grams, own_grams, tuple(t[k - 2 : k + 1])) if k >= 2 else 0
            gate = 0 if two_ <= 0 else 1 if two_ == 1 else 2 if two_ <= 4 else 3
            p = [2.0 ** cost[at] if cost[at] > -1000 else 0.0, alone / (total - (len(t) if learn[d] else 0) + 1), three_ / two_ if two_ else 0.0]
            mixed = sum(a * b for a, b in zip(share[gate], p))
            bits += math.log2(mixed / sum(share[gate])) if mixed else cost[at] + math.log2(share[gate][0] / sum(share[gate]))
            for e in range(3):
                new[gate][e] += share[gate][e] * p[e] / mixed if mixed else 0.0
            at += 1
        assert got[d] == pytest.approx(bits, rel=1e-6, abs=1e-6), texts[d]


def test_scores_do_not_depend_on_partitions(spark):
    texts = CASES + made(60, 5) + ["long words and more " * 4000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    a, b = ({r.doc_id: tuple(r) for r in cm.scores(df.repartition(n), fold("doc_id", 7) == 2).collect()} for n in (1, 5))
    assert set(a) == set(b) and all(a[k] == pytest.approx(b[k], rel=1e-4) for k in a)


def test_no_training_rows_and_empty_tables(spark):
    df = frame(spark, ["a b", None])
    rows = cm.scores(df, F.lit(True)).orderBy("doc_id").collect()
    assert [(r.n_tokens, r.n_known, r.train_tokens) for r in rows] == [(3, 0, 0), (1, 0, 0)] and rows[0].base_score == 0
    assert cm.scores(df.limit(0), F.lit(False)).count() == 0


def test_totals_of_a_bucket_take_little_memory():
    """N-grams of several slices against a plain count, in at most 48 bytes each at once besides what comes in and goes out."""
    import tracemalloc

    r = np.random.default_rng(5)
    slices = [np.sort(r.choice(1 << 32, 400_000, replace=False)) for _ in range(2)]
    slices.append(np.unique(np.concatenate([slices[0][::3], slices[1][::5]])))
    asks = [r.integers(0, 8, len(k)).astype("<i4") for k in slices]
    packed = lambda x: cm._pack(x.tobytes())
    words = np.array([[1, 2], [3, 4]], "<u8")
    rows = [(7, s, words.tobytes(), packed(np.array([s, 0], "<i4")), packed(np.diff(k, prepend=0).astype("<u4")), packed(a)) for s, (k, a) in enumerate(zip(slices, asks))]
    names = ["bucket", "slice", "words", "word_counts", "grams", "gram_counts"]
    batch = pa.RecordBatch.from_arrays([pa.array(list(c)) for c in zip(*rows)], names=names)
    tracemalloc.start()
    out = pa.Table.from_batches(cm._counted(iter([batch]))).to_pylist()
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 48 * sum(map(len, slices)) + 2 * batch.nbytes

    total = Counter()
    for k, a in zip(slices, asks):
        total.update(dict(zip(k.tolist(), (a >> 1).tolist())))
    assert [x["slice"] for x in out] == [0, 1, 2] and [x["n_distinct"] for x in out] == [1, 0, 0]
    for x, k, a in zip(out, slices, asks):
        want = [(g, total[g]) for g, m in zip(k.tolist(), a.tolist()) if total[g] >= 2 or total[g] == 1 and m & 1]
        got = np.cumsum(cm._unpack(x["grams"], "<u4"), dtype=np.int64)
        assert list(zip(got.tolist(), cm._unpack(x["gram_counts"], "<i8").tolist())) == want
        assert cm._unpack(x["words"], "<i8").tolist() == [3, 0]


def test_counting_slots_takes_little_memory():
    """Slices add to one table of counts; none makes a second table of that size."""
    import tracemalloc

    flat, n, _ = words_of(["the cat sat on the mat", "", "a b c " * 40])
    batch = pa.RecordBatch.from_arrays([cm._one(pa.array([False, True, False])), cm._one(pa.array(n)), pa.array([cm._pack(flat.tobytes())], pa.binary())], names=list("abc"))
    tree = cm.Tree(np.arange(1 << 16).reshape(256, 256) % 977)
    tracemalloc.start()
    rows = [r for b in cm._slot_counts(tree)(iter([batch, batch])) for r in b.to_pylist()]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert rows and peak < 1.5 * sum(4 * (2 << bits) for _, bits in cm.PREDICTORS)


def test_numbers_are_packed_by_their_bytes():
    r = np.random.default_rng(8)
    for kind in ("<i4", "<u4", "<i8", "<u8", "<i2", "u1"):
        for x in (r.integers(0, 100, 1000).astype(kind), np.zeros(0, kind)):
            packed = cm._pack(x)
            assert (cm._unpack(packed, kind) == x).all() and cm._unpack(packed, kind).dtype == x.dtype
    x = r.integers(0, 1 << 18, 10_000).astype("<u4")  # as differences of keys
    assert len(cm._pack(x)) < 0.9 * len(cm._pack(x.tobytes()))
    assert (cm._unpack(cm._pack(x.tobytes()), "<u4") == x).all()


def test_neighbouring_symbols_are_counted_across_pieces():
    text = np.random.default_rng(9).integers(97, 100, (1 << 18) + 999).astype(np.uint8)
    want = Counter(zip([32, *text[:-1].tolist()], text.tolist()))
    got = cm._neighbours(text)
    assert {(k >> 8, k & 255): int(got[k]) for k in np.flatnonzero(got)} == dict(want) and not cm._neighbours(text[:0]).any()
