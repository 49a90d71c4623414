import os
import random
from decimal import ROUND_HALF_UP, Decimal

import pytest
from pyspark.sql import functions as F

from molloom.functions import fingerprints as fp
from molloom.operators import neighbour_graph as ng
from molloom.operators import popcount_index as pi

SF = "/root/testdata/sf0.01"


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def prints(seed, n, words=2):
    r = random.Random(seed)
    mids = [[r.getrandbits(64) & r.getrandbits(64) if k % 3 else r.getrandbits(64) for _ in range(words)] for k in range(12)]
    out = []
    for i in range(n):
        w = list(mids[i % 12])
        for _ in range(r.randint(0, 12)):
            w[r.randrange(words)] ^= 1 << r.randrange(64)
        out.append((i, [signed(x) for x in w]))
    return out + [(n, [0] * words), (n + 1, [0] * words), (n + 2, [signed((1 << 64) - 1)] * words), (n + 3, out[0][1])]


def tanimoto(x, y):
    bits = lambda f: sum((a % (1 << 64)).bit_count() for a in f)
    c = bits([a & b for a, b in zip(x, y)])
    u = bits(x) + bits(y) - c
    return round(c / u, 6) if u else None


@pytest.mark.parametrize("k", [1, 5, 400])
def test_search_equals_all_scores(spark, k):
    rows = prints(2, 300)
    index = pi.build(spark.createDataFrame([*rows, (999, None)], "id long, w array<long>"), "id", "w")
    queries = [rows[0], rows[7], rows[300], rows[302], (5000, [3, 0])]
    got, read = pi.search(index, spark.createDataFrame(queries, "q long, words array<long>"), k)
    found = {}
    for r in got.orderBy("q", "rank").collect():
        found.setdefault(r.q, []).append((r.row, r.score))
    for q, w in queries:
        want = sorted(((i, tanimoto(w, x)) for i, x in rows), key=lambda r: (r[1] is None, -(r[1] or 0), r[0]))[:k]
        assert [r[0] for r in found[q]] == [r[0] for r in want], q
        assert all(a[1] is None and b[1] is None or abs(a[1] - b[1]) < 2e-6 for a, b in zip(found[q], want))
    assert sum(index.sizes.values()) == len(rows)


def test_far_counts_are_not_read(spark):
    rows = prints(3, 400)
    index = pi.build(spark.createDataFrame(rows, "id long, w array<long>"), "id", "w")
    most = 0
    for q, w in rows[:3]:
        got, read = pi.search(index, spark.createDataFrame([(q, w)], "q long, words array<long>"), 2)
        kth = got.agg(F.min("score")).first()[0]
        way = pi.schedule(index, sum((a % (1 << 64)).bit_count() for a in w))
        needed = sum(b >= kth for _, b in way)
        seen = set().union(*read)
        # all that may hold a result, and at most what the last round took beyond
        assert {n for n, _ in way[:needed]} <= seen and len(seen) <= 2 * needed + 1
        most = max(most, len(seen))
    assert most < len(way) / 2
    plan = index.rows.where(F.col("n_bits").isin(sorted(read[0])))._jdf.queryExecution().executedPlan().toString()
    assert "n_bits" in plan.partition("PartitionFilters:")[2].partition("]")[0]


def test_search_leaves_excluded_rows_out(spark):
    rows = prints(4, 60)
    df = spark.createDataFrame(rows, "id long, w array<long>")
    index = pi.build(df, "id", "w")
    gone = spark.createDataFrame([(i,) for i, _ in rows if i % 2 == 0], "row long")
    got, _ = pi.search(index, spark.createDataFrame(rows[:3], "q long, words array<long>"), 4, gone)
    assert got.where("row % 2 = 0").count() == 0 and got.count() == 12


def truth(points):
    a, b = points.toDF("point", "w"), points.toDF("near", "x")
    return a.join(b, F.col("point") != F.col("near")).select("point", "near", fp.tanimoto_words(F.col("w"), F.col("x")).alias("score"))


def test_neighbour_graph_of_made_points(spark):
    r = random.Random(9)
    mids = [r.getrandbits(64) for _ in range(40)]
    rows = []
    for i in range(900):
        w = mids[i % 40]
        for _ in range(r.randint(0, 14)):
            w ^= 1 << r.randrange(64)
        rows.append((i, signed(w)))
    rows += [(2000 + i, rows[0][1]) for i in range(200)] + [(3000, None)]
    points, members = ng.points_of(spark.createDataFrame(rows, "id long, w long"), "id", "w")
    assert members.count() == 1100 and members.where("point = 0 AND row >= 2000").count() == 200
    graph, improved = ng.neighbour_graph(points, k=10)
    assert graph.groupBy("point").count().where("count <> 10").count() == 0 and graph.where("point = near").count() == 0
    assert ng.recall(graph, truth(points), 10) >= 0.9 and improved[-1] < improved[0]


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
def test_recall_over_vectors(spark):
    from molloom.plans import queries

    words = queries.words_of(spark, SF)
    points, _ = ng.points_of(words, "vec_id", "word")
    graph, _ = ng.neighbour_graph(points)
    assert ng.recall(graph, truth(points), 25) >= 0.9


def test_graphs_of_few_points(spark):
    for rows in ([], [(1, 5)], [(1, 5), (2, 5)]):
        points, _ = ng.points_of(spark.createDataFrame(rows, "id long, w long"), "id", "w")
        assert ng.neighbour_graph(points)[0].count() == 0
    points, _ = ng.points_of(spark.createDataFrame([(1, 5), (2, 6), (3, 0)], "id long, w long"), "id", "w")
    assert {(r.point, r.near) for r in ng.neighbour_graph(points)[0].collect()} == {(a, b) for a in (1, 2, 3) for b in (1, 2, 3) if a != b}


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
def test_recall_of_hashed_neighbours(spark):
    from molloom.operators import similarity
    from molloom.plans import queries

    prints_ = queries.sparse_prints(spark, SF)
    near = similarity.lsh_neighbours(prints_, "row", "bits", 64, 0.3).select("a", "b")
    a, b = prints_.toDF("a", "x"), prints_.toDF("b", "y")
    every = a.join(b, F.col("a") < F.col("b")).where(fp.tanimoto_bits(F.col("x"), F.col("y")) >= 0.3).select("a", "b")
    assert near.join(every, ["a", "b"]).count() >= 0.9 * every.count()


@pytest.mark.parametrize("twice", [False, True])
def test_score_rows_are_made_where_the_row_is(spark, twice):
    """Scores beside each other without a shuffle of scores; null, empty and repeated rows as in SQL."""
    from molloom.operators import similarity

    rows = [(i, w[0]) for i, w in prints(6, 70, 1)] + [(500, None), (501, 0)] + [(3, 12345)] * twice
    df = spark.createDataFrame(rows, "vec_id long, word long").repartition(3)
    queries = [(i, w) for i, w in rows if i % 10 == 0 or i in (70, 71)]
    out = similarity.score_rows(df, spark.createDataFrame(queries, "q long, qword long"))
    want = {}
    for i, w in rows:
        for q, x in queries:
            c, u = (0, 0) if w is None or x is None else (((w & x) % (1 << 64)).bit_count(), ((w | x) % (1 << 64)).bit_count())
            # half up from the double, as SQL rounds
            want.setdefault(i, []).append((q, int(Decimal(repr(100 * (c / u))).quantize(Decimal(1), ROUND_HALF_UP)) if u else -1))
    got = {r.vec_id: r.scores for r in out.collect()}
    assert got == {i: ",".join("-" if p < 0 else str(p) for _, p in sorted(x)) for i, x in want.items()}
    assert ("collect_list" in out._jdf.queryExecution().optimizedPlan().toString()) == twice
    assert similarity.score_rows(df, spark.createDataFrame([], "q long, qword long")).count() == 0


@pytest.mark.parametrize("kind", ["long", "string"])
def test_tasks_pass_on_the_best_alone(spark, kind):
    """What leaves a task is k rows a query, not a score for every pair; ids of any type."""
    rows = prints(7, 500)
    index = pi.build(spark.createDataFrame([(str(i) if kind == "string" else i, w) for i, w in rows], f"id {kind}, w array<long>"), "id", "w")
    queries = spark.createDataFrame([(q, w) for q, w in rows[:20]], "q long, words array<long>")
    open_ = queries.select("q", F.col("words").alias("qwords"), fp.count_bits(F.col("words")).alias("a"), F.lit(-2.0).alias("kth"))
    every = {n: [(a, pi.bound(a, n)) for a in range(129)] for n in index.sizes}
    met = pi._scored(index.rows.coalesce(1), open_, every, 4)
    assert kind == "string" or met.groupBy("q").count().where("count <> 4").count() == 0
    assert met.count() < len(rows) * 20 / 4
    got, _ = pi.search(index, queries, 4)
    for r in got.collect():
        want = sorted(((str(i) if kind == "string" else i, tanimoto(rows[r.q][1], x)) for i, x in rows if tanimoto(rows[r.q][1], x) is not None), key=lambda x: (-x[1], x[0]))
        assert r.row == want[r["rank"] - 1][0]


def test_pairs_stay_in_their_tasks(spark, monkeypatch):
    """Of the pairs that meet at a point only those leave a task that reach what an end holds; small files are not broadcast."""
    monkeypatch.setattr(ng, "WINDOW", 8)
    met = spark.createDataFrame([(1, 10, True), (1, 11, False), (1, 12, True), (1, 13, False)], "point long, near long, new boolean")
    known = spark.createDataFrame([(10, 7, 0.5), (11, 3, 0.9), (12, 7, -1.0), (13, 3, 0.0)], "x_ long, w long, least double")
    out = ng._local(met, known)
    got = {(r.point, r.near): round(r.score, 3) for r in out.collect()}
    assert got == {(10, 11): 0.667, (10, 12): 1.0, (10, 13): 0.667, (12, 10): 1.0, (12, 11): 0.667, (12, 13): 0.667, (13, 10): 0.667, (13, 12): 0.667}
    r = random.Random(2)
    points, _ = ng.points_of(spark.createDataFrame([(i, signed(r.getrandbits(64))) for i in range(120)], "id long, w long"), "id", "w")
    starts = ng._starts(points.select("point", "words"), 5)
    assert starts.groupBy("point").count().where("count < 5 OR count > 15").count() == 0
    assert "Broadcast" not in out._jdf.queryExecution().executedPlan().toString()
