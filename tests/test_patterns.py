import random
import re

import pytest

from molloom.operators import patterns as pt

CASES = {"abc": "abc", "a?bcd": "bcd", "abc?d": "ab", "x|yyy": "", "(foo)bar": "bar", "(a|b)cd": "cd", "ab+cde": "cde", "[abc]def": "def", "a\\.b": "a.b", "\\dabc": "abc", "^start$": "start", "a{2}bcd": "bcd", "ab{0,1}": "a", "(?i)abc": "", "[]x]yz": "yz", "[^]x]yz": "yz", "a.*bcd": "bcd", "": "", "\\Qa|b\\E": "", "(ab(c)d)efg": "efg", "[a[bc]]de": "de"}


@pytest.mark.parametrize("pattern", sorted(CASES))
def test_literals(pattern):
    assert pt.literal(pattern) == CASES[pattern]


def frames(spark, texts, patterns):
    return spark.createDataFrame(list(enumerate(texts)), "key long, text string").repartition(3), spark.createDataFrame(list(enumerate(patterns)), "number long, pattern string").repartition(3)


@pytest.mark.parametrize("bound, block", [(pt.BROADCAST_ROWS, pt.BLOCK), (-1, 3)])
def test_matches_equal_every_test(spark, monkeypatch, bound, block):
    monkeypatch.setattr(pt, "BROADCAST_ROWS", bound)
    monkeypatch.setattr(pt, "BLOCK", block)
    r = random.Random(5)
    texts = ["".join(r.choices("abcdé ", k=r.randint(0, 30))) for _ in range(150)] + [None, "", "abcabc" * 3000]
    patterns = ["".join(r.choices("abcd", k=r.randint(1, 5))) for _ in range(120)] + ["a?bcd", "ab|cd", "[ab]c+d", "(ab)+c", "é.d", "^ab", "d$", None, "^$", "a{2,3}b"]
    t, p = frames(spark, texts, patterns)
    want = {(i, j) for i, x in enumerate(texts) for j, q in enumerate(patterns) if x is not None and q is not None and re.search(q, x)}
    assert {(x.key, x.number) for x in pt.matches(t, p).collect()} == want
    first = {i: min((j for k, j in want if k == i), default=None) for i in range(len(texts))}
    assert {x.key: x.number for x in pt.first_matches(t, p).collect()} == first


def test_thousands_of_patterns_are_one_plan(spark):
    few = [f"w{k:04}x" for k in range(50)]
    many = [f"w{k:04}x" for k in range(5000)]
    texts = [f"see w{k * 7 % 6000:04}x and w{k:04}x" for k in range(300)]
    sizes = []
    for patterns in (few, many):
        t, p = frames(spark, texts, patterns)
        out = pt.matches(t, p)
        sizes.append(len(out._jdf.queryExecution().optimizedPlan().toString()))
        assert {(x.key, x.number) for x in out.collect()} == {(i, j) for i in range(300) for j in {i * 7 % 6000, i} if j < len(patterns)}
    assert abs(sizes[0] - sizes[1]) < 100


def test_empty_sides(spark):
    t, p = frames(spark, ["abc"], ["abc"])
    assert pt.matches(t.limit(0), p).count() == pt.matches(t, p.limit(0)).count() == 0


def test_a_long_text_is_read_once(spark):
    """A text of hundreds of thousands of letters takes time by its length, not by its square."""
    import time

    texts = ["é b " * 100_000 + "straßenbahnen", "straßenbahn" * 20_000, "strassenbahnen", "straßenbahne", "photosynthesisphotosynt"]
    patterns = ["straßenbahnen", "strass", "photosynthesis", "photosynth?esis", "synthetic", "bahnens"]
    t, p = frames(spark, texts, patterns)
    began = time.time()
    want = {(i, j) for i, x in enumerate(texts) for j, q in enumerate(patterns) if re.search(q, x)}
    assert {(x.key, x.number) for x in pt.matches(t, p).collect()} == want
    assert time.time() - began < 60
