import random

import pytest
from pyspark.sql import functions as F

from molloom.operators import transform
from molloom.sources import compounds
from molloom.streaming import rows as stream


def read(spark, path):
    return sorted(tuple(r) for r in spark.read.parquet(path).select("id", "x", "batch").collect())


def test_a_replayed_batch_changes_nothing(spark, tmp_path):
    path = f"file://{tmp_path}/out"
    batches = [[("a", 2), ("a", 1), ("b", 5)], [("b", 0), ("c", 3)], [("c", 1), ("d", 9), ("a", 0)]]
    frames = [spark.createDataFrame(b, "id string, x int") for b in batches]
    for k, df in enumerate(frames):
        compounds.append_once(df, path, k, ["id"])
    want = [("a", 1, 0), ("b", 5, 0), ("c", 3, 1), ("d", 9, 2)]
    assert read(spark, path) == want
    for k in (1, 0, 2, 2):
        compounds.append_once(frames[k], path, k, ["id"])
        assert read(spark, path) == want
    compounds.append_once(frames[0], f"{path}2", 0)
    compounds.append_once(frames[0], f"{path}2", 0)
    assert spark.read.parquet(f"{path}2").count() == 3


def test_a_stream_keeps_first_rows(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for k, text in enumerate(["id,x\na,1\nb,2\n", "id,x\nb,3\nc,4\n"]):
        (tmp_path / "in" / f"f{k}.csv").write_text(text)
    args = (spark, f"file://{tmp_path}/in", "id string, x int", ["id"], f"file://{tmp_path}/out", f"file://{tmp_path}/cp")
    stream.keep_first(*args).awaitTermination()
    (tmp_path / "in" / "g.csv").write_text("id,x\na,9\nd,5\n")
    stream.keep_first(*args).awaitTermination()
    got = [(i, x) for i, x, _ in read(spark, f"file://{tmp_path}/out")]
    assert [i for i, _ in got] == ["a", "b", "c", "d"] and got[0][1] == 1 and got[3][1] == 5


@pytest.mark.parametrize("n", [0, 1, 40, 10_000])
def test_rows_up_to_the_nth_that_passes(spark, n):
    r = random.Random(n)
    rows = [(k, r.random() < 0.3 if k % 7 else None) for k in range(600)]
    df = spark.createDataFrame(r.sample(rows, 600), "k int, ok boolean").repartition(9)
    got, looked = transform.until_passing(df, [F.col("k")], F.col("ok"), n)
    want, passed = [], 0
    for k, ok in rows:
        if passed >= n:
            break
        want.append((k, bool(ok)))
        passed += bool(ok)
    assert sorted((x.k, x.passes) for x in got.collect()) == want
    assert looked <= 4 and (n != 1 or looked == 1)
