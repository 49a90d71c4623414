import random

import numpy as np
import pytest

from molloom.operators import cluster


def vectors(seed, groups, n, d=6, k=4):
    r = np.random.default_rng(seed)
    out = []
    for g in groups:
        mid = r.normal(size=(k, d)) * 8
        out += [(g, len(out) + i, (mid[i % k] + r.normal(size=d)).tolist()) for i in range(n)]
    return out


def frame(spark, rows):
    return spark.createDataFrame(rows, "cycle string, id long, v array<double>").repartition(5)


def brute_lloyd(rows, centres, rounds):
    """Of one group: centres after so many iterations, empty ones re-seeded at the farthest points."""
    ids = np.array([r[1] for r in rows])
    x = np.array([r[2] for r in rows])
    c = np.array(centres, float)
    for _ in range(rounds):
        d = ((x[:, None] - c[None]) ** 2).sum(-1)
        at = d.argmin(1)
        new = c.copy()
        far = sorted(range(len(x)), key=lambda i: (-d[i].min(), ids[i]))
        for k in range(len(c)):
            if (at == k).any():
                new[k] = x[at == k].mean(0)
        for k, i in zip([k for k in range(len(c)) if not (at == k).any()], far):
            if d[i].min() > 0:
                new[k] = x[i]
        if (new == c).all():
            break
        c = new
    return c


@pytest.mark.parametrize("cells", [cluster.BLOCK_CELLS, 30])
def test_lloyd_of_all_groups_at_once(spark, monkeypatch, cells):
    monkeypatch.setattr(cluster, "BLOCK_CELLS", cells)
    rows = vectors(1, ["a", "b", "c"], 60)
    points = cluster.points_of(frame(spark, rows), "cycle", "id", "v")
    start = {g: [r[2] for r in rows if r[0] == g][:k] for g, k in (("a", 3), ("b", 5))}
    start["b"][1] = [1e6] * 6  # gets no points
    start["b"][3] = [-1e6] * 6
    centres = spark.createDataFrame([(g, 0, k, c) for g, cs in start.items() for k, c in enumerate(cs)], cluster.CENTRES)
    got, _ = cluster.lloyd(points, centres, 7)
    for g in start:
        mine = np.array([r.centre for r in sorted(got.collect(), key=lambda r: r.cluster) if r.grp == g])
        assert np.allclose(mine, brute_lloyd([r for r in rows if r[0] == g], start[g], 7))
    near = {(r.grp, r.row): r for r in cluster.assigned(points, got).collect()}
    assert {g for g, _ in near} == {"a", "b"} and len(near) == 120
    med = {(r.grp, r.cluster): r.medoid for r in cluster.medoids(points, got).collect()}
    for r in got.collect():
        own = [x for x in rows if x[0] == r.grp]
        assert med[r.grp, r.cluster] == min((round(float(np.linalg.norm(np.array(x[2]) - r.centre)), 6), x[1]) for x in own)[1]


def test_seeding_finds_separate_clusters(spark):
    rows = vectors(3, ["a", "b"], 160, k=5)
    got, centres = cluster.kmeans(frame(spark, rows), "cycle", "id", "v", {"a": 5, "b": 5, "none": 2}, starts=2)
    labels = {r.row: (r.grp, r.clustnum) for r in got.collect()}
    for g in ("a", "b"):
        own = [r[1] for r in rows if r[0] == g]
        first = min(own)
        assert len({labels[i] for i in own}) == 5
        assert all((labels[i] == labels[j]) == ((i - first) % 5 == (j - first) % 5) for i in own[:40] for j in own[:40])
    assert centres.count() == 10


def test_few_distinct_points_null_vectors_and_empty_tables(spark):
    rows = [("a", 1, [0.0, 0.0]), ("a", 2, [0.0, 0.0]), ("a", 3, [1.0, 0.0]), ("a", 4, None), ("a", 5, [None, 1.0]), ("a", 6, []), (None, 7, [2.0, 2.0])]
    got, centres = cluster.kmeans(frame(spark, rows), "cycle", "id", "v", 3, starts=1)
    out = {r.row: (r.grp, r.clustnum, r.distance) for r in got.collect()}
    assert set(out) == {1, 2, 3, 7} and out[1] == out[2] != out[3] and all(x[2] == 0 for x in out.values())
    assert centres.where("grp = 'a'").count() == 2
    assert cluster.kmeans(frame(spark, rows).limit(0), "cycle", "id", "v", 3)[0].count() == 0


def test_block_lists(spark):
    r = random.Random(1)
    rows = [(f"BB{1 + i % 2}", f"id{i // 2}", float(r.randint(100, 500)), [float(r.randint(0, 1)) for _ in range(12)] if i % 9 else None) for i in range(120)]
    df = spark.createDataFrame(rows, "cycle string, bb_id string, mw double, fp array<double>")
    out = cluster.cluster_blocks(df, {"BB1": 3, "BB2": 4}, 400.0, starts=1).collect()
    assert {(x.cycle, x.bb_id) for x in out} == {x[:2] for x in rows if x[2] <= 400 and x[3]}
    assert {c: len({x.clustnum for x in out if x.cycle == c}) for c in ("BB1", "BB2")} == {"BB1": 3, "BB2": 4}


def test_models_are_saved_and_loaded(spark, tmp_path):
    from pyspark.ml import Pipeline, PipelineModel

    from molloom.operators.models import CycleKMeans, CycleKMeansModel

    rows = vectors(7, ["a", "b"], 40)
    df = frame(spark, [*rows, ("c", 900, [0.0] * 6), ("a", 901, None)])
    model = CycleKMeans(row="id", vector="v", k=4, starts=1, seed=5).fit(df.where("cycle <> 'c'"))
    path = f"file://{tmp_path}/model"
    model.write().overwrite().save(path)
    again = CycleKMeansModel.load(path)
    want = {r.id: r.clustnum for r in model.transform(df).collect()}
    assert again.uid == model.uid and {r.id: r.clustnum for r in again.transform(df).collect()} == want
    assert want[900] is None and want[901] is None and len(set(want.values())) == 5 and len(want) == 82
    assert again.medoids(df).count() == 8
    whole = Pipeline(stages=[model]).fit(df)
    whole.write().overwrite().save(f"file://{tmp_path}/pipeline")
    assert {r.id: r.clustnum for r in PipelineModel.load(f"file://{tmp_path}/pipeline").transform(df).collect()} == want
