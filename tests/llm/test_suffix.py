import random

import numpy as np
import pytest

from molloom.llm import suffix_dedup as sd
from molloom.llm.suffix_sort import suffix_order

from .data import CASES, frame


def test_order_and_common_prefixes():
    r = random.Random(1)
    for _ in range(200):
        alphabet = r.choice([b"ab", b"abc\x00\xff", bytes(range(256))])
        base = bytes(r.choice(alphabet) for _ in range(400))
        text = b"".join(base[r.randint(0, 100) :][: r.randint(50, 300)] + bytes([r.choice(alphabet)]) for _ in range(r.randint(1, 8)))
        depth = r.choice([16, 40, 200])
        text += bytes(max(0, depth - len(text)))
        starts = np.array([r.randint(0, len(text) - depth) for _ in range(r.randint(1, 60))])
        order, lcp = suffix_order(np.frombuffer(text + bytes(16 + depth), np.uint8), starts, depth)
        own = [text[s : s + depth] for s in starts]
        assert [own[k] for k in order] == sorted(own)
        for k in range(1, len(order)):
            a, b = own[order[k - 1]], own[order[k]]
            assert lcp[k] == next((c for c in range(depth) if a[c] != b[c]), depth)


def planted(seed):
    r = random.Random(seed)
    word = lambda n: " ".join(r.choice("abcdefghijklmnop") * r.randint(1, 6) for _ in range(n))
    hot, base = word(60), word(900)
    texts = [*CASES, "x" * 900, "ab" * 300, "x" * 199, "x" * 200, base, base, base[:700] + "!" + base[701:]]
    for k in range(60):
        texts.append(word(r.randint(0, 80)) + (hot[r.randint(0, 80) :] if k % 3 else "") + word(r.randint(0, 80)) + base[(a := r.randint(0, 900)) : a + r.randint(150, 450)])
    return texts


@pytest.mark.parametrize("piece", [sd.PIECE, 500])
def test_equals_brute_force(spark, monkeypatch, piece):
    monkeypatch.setattr(sd, "PIECE", piece)  # workers see it where the driver forks them; the default covers the rest
    texts = planted(piece)
    want = sd.brute_force([(t or "").encode() for t in texts])
    for r in sd.dedup(frame(spark, texts).selectExpr("*", "1 AS KEPT")).collect():
        import hashlib

        assert (r.n_removed, r.n_spans, hashlib.sha256(bytes(r.kept)).hexdigest()) == want[r.doc_id], repr(texts[r.doc_id])[:80]
        assert r.n_bytes == len((texts[r.doc_id] or "").encode())


@pytest.mark.parametrize("hot", [3, 20])
def test_windows_of_hot_grams(spark, monkeypatch, hot):
    monkeypatch.setattr(sd, "HOT", hot)  # read on the driver alone
    monkeypatch.setattr(sd, "PART_BLOCKS", 40)
    texts = planted(5)
    want = sd.brute_force([(t or "").encode() for t in texts])
    for r in sd.dedup(frame(spark, texts)).collect():
        assert (r.n_removed, r.n_spans) == want[r.doc_id][:2], repr(texts[r.doc_id])[:80]


def test_window_hashes_of_single_windows():
    data = np.frombuffer(random.Random(4).randbytes(300) * 2, np.uint8)
    hashes = sd.window_hashes(sd.gram_hashes(data))
    assert len(hashes) == len(data) - sd.LENGTH + 1
    for a in range(0, len(hashes), 7):
        for b in range(0, len(hashes), 5):
            assert (hashes[a] == hashes[b]) == (bytes(data[a : a + sd.LENGTH]) == bytes(data[b : b + sd.LENGTH]))
    gram, lo, hi, doc = sd.single_windows(np.array([False, True]), np.array([7, 8]), np.array([0, 50]), np.array([9, 52]), np.array([0, 1]), hashes)
    assert lo.tolist() == [0, 50, 51, 52] and hi.tolist() == [9, 50, 51, 52] and doc.tolist() == [0, 1, 1, 1]
    assert gram.tolist() == [7, *hashes[50:53].tolist()]


def test_pieces_cover_every_window(monkeypatch):
    monkeypatch.setattr(sd, "PIECE", 500)
    data = np.frombuffer(random.Random(3).randbytes(4000), np.uint8)
    seen = [base + w for _, base, _, lo, hi, _ in sd.anchored(np.array([0, 1700, 1750, 4000]), data) for a, b in zip(lo, hi) for w in range(a, b + 1)]
    assert sorted(seen) == [w for a, b in ((0, 1700), (1750, 4000)) for w in range(a, b - sd.LENGTH + 1)]


def test_repeated_rows_and_empty_table(spark):
    rows = spark.createDataFrame([(1, "word " * 60 + "x"), (1, "word " * 60 + "x"), (None, "y" * 100)], "doc_id long, text string")
    assert sorted(r.n_removed for r in sd.dedup(rows).collect()) == [0, 301, 301]
    assert sd.dedup(rows.limit(0)).count() == 0
