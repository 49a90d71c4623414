import re

import numpy as np
import pytest
import xxhash

from molloom.llm import simhash_pigeonhole as sp
from molloom.llm import winnow_decontamination as wd
from molloom.llm import components as components_
from molloom.llm.components import components

from .data import CASES, frame, made


def simhash(t):
    raw = re.sub(rb"[A-Z]", lambda m: m[0].lower(), (t or "").encode())
    w = [x for x in re.split(rb"[\x20\x09-\x0D]+", raw) if x]
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(x, 42) for x in [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or [b" ".join(w)]]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_fingerprints(spark):
    texts = CASES + made(200, 5)
    for r in sp.fingerprints(frame(spark, texts).selectExpr("*", "1 AS FP")).collect():
        assert r.fp & (1 << 64) - 1 == simhash(texts[r.doc_id]), repr(texts[r.doc_id])


def roots(links):
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {x: find(x) for x in parent}


def clustered(seed, n=400):
    r = np.random.default_rng(seed)
    centres = r.integers(0, 1 << 63, 6, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    out = []
    for _ in range(n):
        x = int(centres[r.integers(6)])
        for b in r.integers(0, 64, r.integers(0, 7)):
            x ^= 1 << int(b)
        out.append(x)
    return sorted(set(out))


@pytest.mark.parametrize("partitions, hot", [(4, sp.HOT), (3, sp.HOT), (4, -900)])
def test_links_reach_what_all_pairs_reach(spark, partitions, hot):
    fps = clustered(partitions)
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    nodes = spark.createDataFrame([(x,) for x in signed], "fp long")
    got = {r.node: r.root for r in components(sp.links(nodes, partitions, hot)).collect()}
    want = roots([(a, b) for a, x in zip(signed, fps) for b, y in zip(signed, fps) if a < b and (x ^ y).bit_count() <= 3])
    assert got == want and len(want) > 100


@pytest.mark.parametrize("base", [components_.BASE, -1])
def test_components(spark, monkeypatch, base):
    monkeypatch.setattr(components_, "BASE", base)
    r = np.random.default_rng(3)
    links = [(i, i + 1) for i in range(60)] + [(int(a) + 100, int(b) + 100) for a, b in r.integers(0, 80, (50, 2))] + [(900, 900)]
    got = {x.node: x.root for x in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {k: v for k, v in roots([x for x in links if x[0] != x[1]]).items()}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_groups_of_odd_tables(spark):
    texts = CASES + ["One two three four."] * 3
    got = {r.doc_id: r for r in sp.groups(frame(spark, texts)).collect()}
    zero = [i for i, t in enumerate(texts) if simhash(t) == 0]
    assert {got[i].component_id for i in zero} == {min(zero)} and len(got) == len(texts)
    assert len({got[len(CASES) + k].component_id for k in range(3)}) == 1
    assert sp.groups(frame(spark, ["a"]).limit(0)).count() == 0


SPLIT = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def brute(docs, items):
    lower = lambda t: SPLIT.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    windows = {}
    for i, t in items:
        w = lower(t)
        n = min(13, len(w))
        for k in range(len(w) - n + 1) if n else ():
            windows.setdefault(tuple(w[k : k + n]), set()).add(str(i))
    out = {}
    for d, t in docs:
        w, hit, found = lower(t), set(), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if got := windows.get(tuple(w[k : k + n])):
                    found |= got
                    hit |= set(range(k, k + n))
        out[d] = (len(w), len(hit), sorted(found))
    return out


@pytest.mark.parametrize("bound", [wd.BROADCAST_ROWS, -1])
def test_decontamination(spark, monkeypatch, bound):
    monkeypatch.setattr(wd, "BROADCAST_ROWS", bound)
    r = np.random.default_rng(7)
    word = lambda n, k=9: " ".join("abcdefghij"[x] * 2 for x in r.integers(0, k, n))
    items = [(i, word(n)) for i, n in enumerate([30, 14, 13, 5, 3, 20])] + [(90, None), (91, ""), (92, "!!"), (7, word(30, 2)), (8, "É über ß " * 5)]
    items.append((95, items[0][1]))
    texts = CASES + [word(50) + " ," + items[k % 11][1].upper() + "! " + word(9) if items[k % 11][1] else word(4) for k in range(40)] + [word(200, 2), "é ÜBER ß", items[10][1]]
    got = wd.decontaminate(frame(spark, texts), spark.createDataFrame(items, "item_id long, text string"))
    assert {x.doc_id: (x.n_words, x.n_hit, x["items"]) for x in got.collect()} == brute(list(enumerate(texts)), items)


def test_decontamination_of_null_and_repeated_ids(spark):
    item = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen"
    rows = [(None, item), (None, "clean " * 20), (None, None), (5, item + " more"), (5, "other words only"), (5, item + " more"), (6, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    bench = spark.createDataFrame([(1, item), (None, "clean clean")], "item_id long, text string")
    got = sorted((-1 if r.doc_id is None else r.doc_id, r.n_words, r.n_hit, r["items"]) for r in wd.decontaminate(docs, bench).collect())
    assert got == [(-1, 0, 0, []), (-1, 14, 14, ["1"]), (-1, 20, 20, [""]), (5, 3, 0, []), (5, 15, 14, ["1"]), (5, 15, 14, ["1"]), (6, 0, 0, [])]


def test_decontamination_of_empty_tables(spark):
    none, some = frame(spark, ["a"]).limit(0), frame(spark, ["a b", None])
    bench = spark.createDataFrame([], "item_id long, text string")
    assert wd.decontaminate(none, bench).count() == 0
    assert [(r.n_words, r.n_hit, r["items"]) for r in wd.decontaminate(some, bench).orderBy("doc_id").collect()] == [(2, 0, []), (0, 0, [])]


def test_places_beyond_a_fingerprint_s_bits(spark, monkeypatch):
    """Documents of more words than a block: items at its ends, across them and far behind are all found."""
    monkeypatch.setattr(wd, "BLOCK", 50)
    item = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen"
    texts = [" ".join(["pad"] * n + [item] + ["pad"] * 30) for n in (0, 36, 37, 38, 43, 49, 50, 51, 100, 163)] + ["pad " * 50, "pad " * 51, "short"]
    items = [(1, item), (2, "short")]
    got = wd.decontaminate(frame(spark, texts), spark.createDataFrame(items, "item_id long, text string"))
    want = brute(list(enumerate(texts)), items)
    assert {x.doc_id: (x.n_words, x.n_hit, x["items"]) for x in got.collect()} == want and all(want[k][1] == 14 for k in range(10))
