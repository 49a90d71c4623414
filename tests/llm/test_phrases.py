import random
import re
from collections import Counter

import pyarrow as pa
import pytest

from molloom.llm import phrase_mining as pm
from molloom.llm.common import utf8

from .data import CASES, made

SCHEMA = "text string, lang string, phrase string, N int"


def pieces(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return [w for p in re.split("[.,;:!?\x0a-\x0d]", low) if (w := re.findall("[^ \t]+", p))]


def brute(docs, longest=3, least=10, cover=50, top=2000):
    f, n = {}, Counter()
    for text, lang in docs:
        c = f.setdefault(lang or ("und" if lang is None else lang), Counter())
        for w in pieces(text):
            n["und" if lang is None else lang] += len(w)
            c.update(tuple(w[i : i + z]) for z in range(1, longest + 1) for i in range(len(w) - z + 1))
    out = set()
    for lang, c in f.items():
        rows, good = [], {p: a for p, a in c.items() if len(p) > 1 and a >= least}
        for p, a in good.items():
            inside = [b for q, b in good.items() if len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q)))]
            if any(100 * b >= cover * a for b in inside):
                continue
            cuts = [(10**6 * a * a // (c[p[:k]] * c[p[k:]]), k) for k in range(1, len(p))]
            score, k = min(cuts)
            rows.append((-score, -a, " ".join(p).encode(), c[p[:k]], c[p[k:]]))
        for rank, (s, a, p, left, right) in enumerate(sorted(rows)[:top], 1):
            out.add((lang, rank, p.decode(), -a, left, right, n[lang], -s))
    return out


def corpus(seed, n=400):
    r = random.Random(seed)
    vocabulary = [*"abcdefg", "The", "é", "中", "x\0y", "A" * 40] + [f"rare{k}" for k in range(300)]
    weights = [30] * 12 + [1] * 300
    gaps = [" "] * 12 + ["  ", "\t", ". ", ",", "\n", "!? "]
    return [("".join(w + r.choice(gaps) for w in r.choices(vocabulary, weights, k=r.randint(0, 40))), r.choice(["en", "de", None, ""])) for _ in range(n)]


@pytest.mark.parametrize("longest, cover, top", [(3, 50, 2000), (4, 30, 15)])
def test_equals_brute_force(spark, monkeypatch, longest, cover, top):
    docs = corpus(longest) + [(t, "en") for t in CASES + made(60)] + [("hot pair " * 5000, "fr"), (None, None)]
    docs += docs[:50]
    monkeypatch.setattr(pm, "SLICE", 3000)  # many slices a task
    df = spark.createDataFrame([(*d, "x", 1) for d in docs], SCHEMA).repartition(3)
    got = [tuple(r) for r in pm.collocations(df.select("text", "lang"), longest, cover=cover, top=top).collect()]
    assert len(got) == len(set(got)) and set(got) == brute(docs, longest, cover=cover, top=top)


def test_shared_bits_change_nothing(spark):
    docs = corpus(9) + [("hot pair of words. " * 12, "fr"), ("new york, " * 11 + "york " * 5, "en")]
    df = spark.createDataFrame([(*d, "x", 1) for d in docs], SCHEMA)
    want = brute(docs)
    assert want and {tuple(r) for r in pm.collocations(df, n_bits=64).collect()} == want


def test_words_of():
    texts = CASES + made(200, 7) + ["x" * 100_000, "a b\x0bc"]
    words, text, follows = pm.words_of(*utf8(pa.array(texts)))
    want = [(w, i, k + 1 < len(p)) for i, t in enumerate(texts) for p in pieces(t) for k, w in enumerate(p)]
    assert list(zip(words.to_pylist(), text.tolist(), follows.tolist())) == want


def test_scores_pass_64_bits(spark):
    out = spark.range(1).selectExpr("900000000000000L a", "900000000000001L l", "900000000000007L r").selectExpr("CAST(a AS DECIMAL(15,0)) * CAST(a AS DECIMAL(15,0)) * CAST(1000000 AS DECIMAL(7,0)) div (CAST(l AS DECIMAL(18,0)) * CAST(r AS DECIMAL(18,0))) s").first().s
    a, left, right = 900_000_000_000_000, 900_000_000_000_001, 900_000_000_000_007
    assert out == 10**6 * a * a // (left * right)


def test_no_rows(spark):
    assert pm.collocations(spark.createDataFrame([], SCHEMA)).count() == 0
    assert pm.collocations(spark.createDataFrame([(None, "en", "x", 1), ("", None, "x", 1)], SCHEMA)).count() == 0
