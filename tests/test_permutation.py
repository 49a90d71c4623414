from collections import Counter

import pytest
from pyspark.sql import functions as F

from molloom.operators import enumerate as en
from molloom.operators import permutation as pm


@pytest.mark.parametrize("size", [1, 2, 3, 7, 30, 1000, 1001, 99_999])
def test_every_number_once(spark, size):
    base = pm.halves(size)[1]
    for seed in (0, 5):
        got = pm.permuted(spark.range(size), "id", size, seed).select((F.col("hi") * base + F.col("lo")).alias("x")).collect()
        assert sorted(r.x for r in got) == list(range(size))


def test_seeds_differ(spark):
    one, two = ([r.lo for r in pm.permuted(spark.range(50), "id", 10**6, s).orderBy("id").collect()] for s in (1, 2))
    assert one != two


def blocks(spark, sizes):
    lists = [spark.range(n).selectExpr(f"'BB{k}' cycle", "lpad(id, 9, '0') bb_id") for k, n in enumerate(sizes, 1)]
    out = lists[0]
    for x in lists[1:]:
        out = out.unionByName(x)
    return en.positions(out)


def chi(counts, cells, n):
    return sum((counts.get(c, 0) - n / cells) ** 2 / (n / cells) for c in range(cells))


def test_sample_of_a_large_product_is_even(spark):
    b = blocks(spark, [1000, 1000, 1000])
    n = 20_000
    rows = en.sample_product(b, ["BB1", "BB2", "BB3"], n, seed=3).collect()
    members = {(r.bb_1, r.bb_2, r.bb_3) for r in rows}
    assert len(rows) == n == len(members) and {r.sample_id for r in rows} == set(range(n))
    for k in range(3):  # 999 degrees of freedom: beyond 1176 once in 10,000
        assert chi(Counter(int(m[k]) for m in members), 1000, n) < 1176
    # pairs of leading digits too
    assert chi(Counter(int(m[0]) // 100 * 10 + int(m[1]) // 100 for m in members), 100, n) < 162
    assert len({m[0] for m in en.sample_product(b, ["BB1", "BB2", "BB3"], 500).select("bb_1").collect()}) > 350


def test_products_beyond_64_bits(spark):
    sizes = [1500] * 7  # 1.7e22
    b = blocks(spark, sizes)
    names = [f"BB{k}" for k in range(1, 8)]
    assert int(en.library_size(b).first().n_products) == 1500**7 > 1 << 63
    rows = en.sample_product(b, names, 3000).collect()
    assert len({tuple(r[1:]) for r in rows}) == 3000
    for k in range(1, 8):  # 14 degrees of freedom
        assert chi(Counter(int(r[k]) // 100 for r in rows), 15, 3000) < 45


def test_small_products_and_empty_lists(spark):
    b = blocks(spark, [3, 2])
    assert {tuple(r[1:]) for r in en.sample_product(b, ["BB1", "BB2"], 100).collect()} == {(f"{i:09}", f"{j:09}") for i in range(3) for j in range(2)}
    assert en.sample_product(b, ["BB1", "BB9"], 5).count() == 0 and en.pick_product(b, ["BB1", "BB9"], 5).count() == 0
    with pytest.raises(ValueError):
        pm.halves(pm.LARGEST + 1)


def test_picks_with_replacement(spark):
    b = blocks(spark, [5, 40, 7])
    rows = en.pick_product(b, ["BB1", "BB2"], 4000, seed=2).collect()
    assert len(rows) == 4000 and chi(Counter(int(r.bb_1) for r in rows), 5, 4000) < 25 and chi(Counter(int(r.bb_2) for r in rows), 40, 4000) < 80
    tuples = en.test_tuples(b, "BB3", ["BB1", "BB2", "BB3"], 9).collect()
    by = {}
    for r in tuples:
        by.setdefault(r.bb_3, set()).add((r.sample_id, r.bb_1, r.bb_2))
    assert len(tuples) == 63 and len(by) == 7 and all(x == by[f"{0:09}"] for x in by.values())


def test_positions_of_a_large_cycle(spark):
    rows = [("a", f"{k:04}") for k in range(500)] + [("b", "x"), (None, "y")]
    got = {(r.cycle, r.bb_id): r.pos for r in en.positions(spark.createDataFrame(rows, "cycle string, bb_id string").repartition(5)).collect()}
    assert got == {(c, b): int(b) if c == "a" else 0 for c, b in rows}
