import hashlib
import random
import re
import zlib

import pytest

from molloom.llm import conversation_trie as ct
from molloom.llm.ordered import numbered, running

SCHEMA = "conv_id long, turn long, role string, text string, K string, saved_tokens int"


def brute(rows):
    """The contract's table, from every rebuilt conversation's prefixes."""
    own = {}
    sha = lambda r, x: hashlib.sha256(f"{len(r.encode())}:{r}{x}".encode()).digest()
    for c, t, r, x in rows:
        if c is not None:
            own.setdefault(c, []).append((t is not None, t or 0, r or "", sha(r or "", x or ""), x or ""))
    own = {c: [(x[2], x[4]) for x in sorted(v)] for c, v in own.items()}
    built = {}
    for c, v in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        base = c - int(c - 20 * int(c / 20))
        built[c] = own.get(base, [])[:h] + v[h:]
    nodes = {}
    for c, v in built.items():
        for d in range(len(v) + 1):
            nodes.setdefault(tuple(v[:d]), []).append(c)
    kids = {}
    for p in nodes:
        if p:
            kids.setdefault(p[:-1], []).append(p)
    out = set()
    for p, m in nodes.items():
        under = [q for q in nodes if q[: len(p)] == p]
        saved = sum((len(nodes[q]) - 1) * len([w for w in re.split("[ \t-\r]+", q[-1][1]) if w]) for q in under if q)
        ends = ",".join(str(c) for c in sorted(m) if len(built[c]) == len(p))
        out.add((min(m), len(p), min(nodes[p[:-1]]) if p else None, len(m), len(kids.get(p, [])), sum(q not in kids for q in under), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return out


def got(spark, rows, base=None):
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA).repartition(3)
    return [tuple(r) for r in ct.trie(ct.rebuilt(ct.turns(df)), base=base).collect()]


def conversations(seed, n=60, long=0):
    r = random.Random(seed)
    words = ["a", "b b", "c  d", "", None, "long one here", "é\t中 "]
    rows = [(c, None if r.random() < 0.1 else t, r.choice(["user", "assistant", None]), r.choice(words)) for c in range(-25, n) if r.random() < 0.9 for t in range(r.choice([0, 1, 2, 3, 5]))]
    rows += [(40, t, "user", str(t % 3)) for t in range(long)]
    return rows + [(None, 1, "user", "no id"), *rows[:3]]


@pytest.mark.parametrize("seed, base", [(1, None), (2, 20)])
def test_equals_brute_force(spark, seed, base):
    rows = conversations(seed, long=150 if base else 0)
    out = got(spark, rows, base)
    assert len(out) == len(set(out)) and set(out) == brute(rows)


def test_empty_and_one(spark):
    assert got(spark, []) == []
    assert set(got(spark, [(4, None, None, None)])) == brute([(4, None, None, None)])


def test_list_places(spark):
    r = random.Random(3)
    order = r.sample(range(0, 4000, 2), 1500)
    arcs = spark.createDataFrame(list(zip(order, [*order[1:], None])), "arc long, next long").repartition(5)
    assert {x.arc: x.place for x in ct.list_places(arcs, base=30).collect()} == {a: k for k, a in enumerate(order, 1)}


def test_running_goes_over_ranges(spark):
    r = random.Random(4)
    rows = [(k, p, r.randrange(1 << 60)) for k, n in enumerate([3, 700, 1, 1, 90]) for p in range(n)]
    df = spark.createDataFrame(rows, "k long, p long, v long").repartition(7)
    want, total = {}, {}
    for k, p, v in rows:
        total[k] = total.get(k, 0) ^ v
        want[k, p] = total[k]
    assert {(x.k, x.p): x.v for x in running(df, ["k", "p"], ["v"], "k", xor=True).collect()} == want
    assert {(x.k, x.p): x.n for x in numbered(df, ["k", "p"], "n", "k").collect()} == {(k, p): p + 1 for k, p, _ in rows}
    assert sorted(x.n for x in numbered(df, ["k", "p"], "n").collect()) == list(range(1, len(rows) + 1))
    assert numbered(df.limit(0), ["k", "p"], "n").count() == 0


def test_two_prefixes_with_one_key_are_refused(spark, monkeypatch):
    rows = spark.createDataFrame([(1, 0, b"", 0), (1, 1, b"a", 1), (2, 0, b"", 0), (2, 1, b"b", 1)], "conv_id long, k long, said binary, tokens long")
    real = ct.members
    monkeypatch.setattr(ct, "members", lambda p, seed: real(p, seed).selectExpr("conv_id", "k", "said", "tokens", "0L x1", "0L x2", "p1", "p2"))
    with pytest.raises(ValueError):
        ct.trie(rows)
