from pyspark.sql import functions as F

from molloom.plans import flows

ROWS = [("a", "c1ccccc1CCN"), ("b", "c1ccccc1"), ("c", "C1CCCCC1O.Cl"), ("d", "nope"), ("e", None), ("f", "C1CCCC1Br"), ("g", "C1CCCC1N"), ("h", "CCCC"), ("x", "C1CC1")]


def test_filter_flow(spark):
    df = spark.createDataFrame(ROWS, "vendor_id string, smiles string")
    got = {r.vendor_id: r for r in flows.prepare_and_filter(df, {"MW_high": 110.0}, ["Br"], ["Cl"]).collect()}
    assert {k for k, r in got.items() if r.removed} == {"a", "d", "e", "f"}
    assert got["c"].cleaned == "C1CCCCC1O" and got["a"].first_fail == "MW" and got["f"].pattern == 0


def test_one_of_each_scaffold(spark):
    df = spark.createDataFrame(ROWS, "vendor_id string, smiles string")
    out = spark.createDataFrame([("x",)], "vendor_id string")
    got = {r.vendor_id for r in flows.diverse_selection(df, out, {"MW_high": 150.0}, ["Br"], ["Cl"], F.col("smiles").contains("N")).collect()}
    # six-rings: a has priority over b and c; five-rings: g; no ring: h
    assert got == {"a", "g", "h"}
