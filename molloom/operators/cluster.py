"""K-means for all groups (building-block cycles) at once.

Centres are a relation keyed by (group, start, cluster). One iteration is one pass over the points: tasks assign their
points and sum them up by centre, so a pass shuffles a row for each task and centre, however many points a group has.
Several starts run in the same passes, and each group keeps its best. Centres reach the tasks in blocks of at most
BLOCK_CELLS numbers; with more centres a pass reads the points once a block and keeps the nearest of the blocks.

Seeding is k-means||: rounds of oversampling by the squared distance to what was drawn before, then a weighted k-means++
over the few drawn points of each group. All draws are hashes of the row and the seed, so they do not depend on partitions.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from molloom.operators.store import kept

#: Numbers of all centres that are broadcast at once.
BLOCK_CELLS = 4_000_000
#: Points whose distances a task computes at once.
ROWS = 4096
CENTRES = "grp string, start int, cluster int, centre array<double>"


def points_of(df: DataFrame, group: str, row: str, vector: str) -> DataFrame:
    """(grp, row, v): points with a vector without nulls; groups as text, a null group under ''."""
    v = F.transform(vector, lambda x: x.cast("double"))
    ok = F.col(vector).isNotNull() & (F.size(vector) > 0) & ~F.exists(vector, lambda x: x.isNull())
    return df.where(ok).select(F.coalesce(F.col(group).cast("string"), F.lit("")).alias("grp"), F.col(row).cast("long").alias("row"), v.alias("v"))


def _matrix(column: pa.Array) -> np.ndarray:
    n = len(column)
    return column.flatten().to_numpy(zero_copy_only=False).reshape(n, -1) if n else np.zeros((0, 0))


def _blocks(centres: DataFrame) -> list[dict[str, list[tuple[int, int, np.ndarray]]]]:
    """The centres by group, in blocks of BLOCK_CELLS numbers. Collected block by block behind a count."""
    width = centres.select(F.max(F.size("centre"))).first()[0] or 1
    n = centres.count()
    blocks = max(1, -(-n * width // BLOCK_CELLS))
    out = []
    for b in range(blocks):
        part = centres if blocks == 1 else centres.where(F.pmod(F.xxhash64("grp", "start", "cluster"), F.lit(blocks)) == b)
        by: dict[str, list[tuple[int, int, np.ndarray]]] = {}
        for r in part.orderBy("grp", "start", "cluster").toLocalIterator():
            by.setdefault(r.grp, []).append((r.start, r.cluster, np.asarray(r.centre, float)))
        out.append(by)
    return out


def _nearest(v: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each point the nearest centre (of equals the first) and the squared distance, from differences: equal points give 0."""
    best, at = np.full(len(v), np.inf), np.zeros(len(v), np.int64)
    for k in range(len(c)):
        d = ((v - c[k]) ** 2).sum(axis=1)
        near = d < best
        best[near], at[near] = d[near], k
    return at, best


def assigned(points: DataFrame, centres: DataFrame) -> DataFrame:
    """(grp, start, row, cluster, d2): of each point and start the nearest centre of its group; points of groups without centres go."""
    spark, parts = points.sparkSession, []
    for by in _blocks(centres):
        held = spark.sparkContext.broadcast(by)

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i in range(0, batch.num_rows, ROWS):
                    yield from assign(batch.slice(i, ROWS), held.value)

        parts.append(points.select("grp", "row", "v").mapInArrow(run, "grp string, start int, row long, cluster int, d2 double"))
    if len(parts) == 1:
        return parts[0]
    both = parts[0]
    for p in parts[1:]:
        both = both.unionByName(p)
    return both.groupBy("grp", "start", "row").agg(F.min(F.struct("d2", "cluster")).alias("m")).select("grp", "start", "row", F.col("m.cluster").alias("cluster"), F.col("m.d2").alias("d2"))


def assign(batch: pa.RecordBatch, by: dict[str, list[tuple[int, int, np.ndarray]]]) -> Iterator[pa.RecordBatch]:
    groups = np.array(batch.column(0).to_pylist(), object)
    rows = batch.column(1).to_numpy()
    for g in pd.unique(groups):
        own = np.flatnonzero(groups == g)
        v = _matrix(batch.column(2).take(pa.array(own)))
        for start in sorted({s for s, _, _ in by.get(g, [])}):
            known = [(k, c) for s, k, c in by[g] if s == start]
            at, d2 = _nearest(v, np.stack([c for _, c in known]))
            names = np.array([k for k, _ in known], np.int32)
            yield pa.RecordBatch.from_arrays([pa.array([g] * len(own), pa.string()), pa.array(np.full(len(own), start, np.int32)), pa.array(rows[own]), pa.array(names[at]), pa.array(d2)], names=["grp", "start", "row", "cluster", "d2"])


def _moved(points: DataFrame, centres: DataFrame) -> DataFrame:
    """(grp, start, cluster, n, inertia, centre): of each centre that has points their mean."""
    blocks = _blocks(centres)
    if len(blocks) > 1:
        rows = assigned(points, centres).join(points.select(F.col("row").alias("of"), "v"), F.col("row") == F.col("of"))
        each = rows.select("grp", "start", "cluster", "d2", F.posexplode("v").alias("i", "x")).groupBy("grp", "start", "cluster", "i").agg(F.sum("x").alias("s"), F.count("*").alias("n"), F.sum("d2").alias("inertia"))
    else:
        held = points.sparkSession.sparkContext.broadcast(blocks[0])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums: dict[tuple[str, int, int], list] = {}
            for batch in batches:
                for i in range(0, batch.num_rows, ROWS):
                    part = batch.slice(i, ROWS)
                    v = _matrix(part.column(2))
                    place = {r: k for k, r in enumerate(part.column(1).to_pylist())}
                    for out in assign(part, held.value):
                        at = np.array([place[r] for r in out.column(2).to_pylist()], np.int64)
                        cluster, d2 = out.column(3).to_numpy(), out.column(4).to_numpy()
                        for k in np.unique(cluster).tolist():
                            own = cluster == k
                            s = sums.setdefault((out.column(0)[0].as_py(), out.column(1)[0].as_py(), k), [np.zeros(v.shape[1]), 0, 0.0])
                            s[0] += v[at[own]].sum(axis=0)
                            s[1] += int(own.sum())
                            s[2] += float(d2[own].sum())
            yield pa.RecordBatch.from_pylist([{"grp": g, "start": st, "cluster": k, "s": x.tolist(), "n": n, "inertia": d} for (g, st, k), (x, n, d) in sums.items()], schema=pa.schema([("grp", pa.string()), ("start", pa.int32()), ("cluster", pa.int32()), ("s", pa.list_(pa.float64())), ("n", pa.int64()), ("inertia", pa.float64())]))

        partial = points.select("grp", "row", "v").mapInArrow(run, "grp string, start int, cluster int, s array<double>, n long, inertia double")
        each = partial.select("grp", "start", "cluster", "n", "inertia", F.posexplode("s").alias("i", "x")).groupBy("grp", "start", "cluster", "i").agg(F.sum("x").alias("s"), F.sum("n").alias("n"), F.sum("inertia").alias("inertia"))
    mean = F.array_sort(F.collect_list(F.struct("i", (F.col("s") / F.col("n")).alias("x"))))
    return each.groupBy("grp", "start", "cluster").agg(F.max("n").alias("n"), F.max("inertia").alias("inertia"), F.transform(mean, lambda e: e["x"]).alias("centre"))


def lloyd(points: DataFrame, centres: DataFrame, rounds: int = 100) -> tuple[DataFrame, int]:
    """points (grp, row, v) and start centres (grp, start, cluster, centre): the centres after Lloyd's iterations until none
    moves or rounds are done, and the number of iterations. A centre that loses all its points goes to the point that is
    farthest from its own centre; several of them to the farthest points in turn, equal distances by row."""
    points, centres = kept(points), kept(centres.select("grp", "start", "cluster", "centre"))
    for turn in range(1, rounds + 1):
        moved = kept(_moved(points, centres))
        both = centres.join(moved.select("grp", "start", "cluster", F.col("centre").alias("new")), ["grp", "start", "cluster"], "left")
        empty = both.where("new IS NULL")
        if empty.limit(1).count():
            w = Window.partitionBy("grp", "start")
            lost = kept(empty.withColumn("n", F.row_number().over(w.orderBy("cluster"))).select("grp", "start", "cluster", "n"))
            most = lost.groupBy(F.col("grp").alias("of_grp"), F.col("start").alias("of_start")).agg(F.max("n").alias("most"))
            far = assigned(points, centres).join(F.broadcast(most), (F.col("grp") == F.col("of_grp")) & (F.col("start") == F.col("of_start")))
            far = far.withColumn("n", F.row_number().over(w.orderBy(F.col("d2").desc(), "row"))).where((F.col("n") <= F.col("most")) & (F.col("d2") > 0))
            far = far.join(points.select(F.col("grp").alias("g"), F.col("row").alias("r"), "v"), (F.col("row") == F.col("r")) & (F.col("grp") == F.col("g"))).select("grp", "start", "n", F.col("v").alias("far"))
            put = lost.join(far, ["grp", "start", "n"]).drop("n")
            both = both.join(put, ["grp", "start", "cluster"], "left").withColumn("new", F.coalesce("new", "far"))
        new = kept(both.select("grp", "start", "cluster", F.coalesce("new", "centre").alias("centre"), (~F.col("centre").eqNullSafe(F.coalesce("new", "centre"))).alias("moves")))
        centres = new.drop("moves")
        if not new.where("moves").limit(1).count():
            break
    return centres, turn


def seeded(points: DataFrame, k: dict[str, int] | int, starts: int = 1, seed: int = 0, rounds: int = 4) -> DataFrame:
    """Start centres (grp, start, cluster, centre) by k-means||: k of each group, or its number of distinct points if less.

    k: a number, or one for each group (others get none). Expected 2 * k * rounds points of a group are drawn.
    """
    spark = points.sparkSession
    if isinstance(k, dict):
        wanted = spark.createDataFrame([(str(g), n) for g, n in k.items() if n > 0] or [("", 0)], "of_grp string, k int").where("k > 0")
        points = points.join(F.broadcast(wanted), F.col("grp") == F.col("of_grp")).drop("of_grp")
    else:
        points = points.withColumn("k", F.lit(k))
    points = kept(points)
    runs = spark.range(starts).select(F.col("id").cast("int").alias("start"))
    chance = lambda turn: (F.pmod(F.xxhash64(F.lit(seed), F.lit(turn), "start", "row"), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    first = points.select("grp", "row").join(F.broadcast(runs)).groupBy("grp", "start").agg(F.min(F.struct(chance(0).alias("u"), "row")).alias("f"))
    drawn = kept(first.select("grp", "start", F.col("f.row").alias("row")))

    def centres(rows: DataFrame) -> DataFrame:
        named = rows.join(points.select(F.col("grp").alias("g"), F.col("row").alias("r"), "v"), (F.col("grp") == F.col("g")) & (F.col("row") == F.col("r")))
        return named.select("grp", "start", F.dense_rank().over(Window.partitionBy("grp", "start").orderBy("row")).alias("cluster"), F.col("v").alias("centre"), "row")

    for turn in range(1, rounds + 1):
        near = kept(assigned(points, centres(drawn)))
        cost = near.groupBy(F.col("grp").alias("of_grp"), F.col("start").alias("of_start")).agg(F.sum("d2").alias("total"))
        size = points.groupBy(F.col("grp").alias("in_grp")).agg(F.max("k").alias("k"))
        odds = near.join(F.broadcast(cost), (F.col("grp") == F.col("of_grp")) & (F.col("start") == F.col("of_start"))).join(F.broadcast(size), F.col("grp") == F.col("in_grp"))
        more = odds.where((F.col("d2") > 0) & (chance(turn) < 2 * F.col("k") * F.col("d2") / F.col("total"))).select("grp", "start", "row")
        drawn = kept(drawn.unionByName(more))
    candidates = kept(centres(drawn))
    weight = assigned(points, candidates).groupBy("grp", "start", "cluster").agg(F.count("*").alias("n"))
    size = points.groupBy(F.col("grp").alias("in_grp")).agg(F.max("k").alias("k"))
    weighed = candidates.join(weight, ["grp", "start", "cluster"], "left").join(F.broadcast(size), F.col("grp") == F.col("in_grp")).select("grp", "start", "row", "centre", F.coalesce("n", F.lit(0)).alias("n"), "k")

    def plus_plus(g: pd.DataFrame) -> pd.DataFrame:
        """Weighted k-means++ over the drawn points of a group; candidates without points count least, but do count."""
        g = g.sort_values("row")
        v, w = np.stack(g["centre"]), g["n"].to_numpy(float) + 1e-9
        rng = np.random.default_rng([seed, int(g["start"].iloc[0]), len(g)])
        chosen = [int(rng.choice(len(v), p=w / w.sum()))]
        best = ((v - v[chosen[0]]) ** 2).sum(axis=1)
        while len(chosen) < int(g["k"].iloc[0]) and (best * w).sum() > 0:
            chosen.append(int(rng.choice(len(v), p=best * w / (best * w).sum())))
            best = np.minimum(best, ((v - v[chosen[-1]]) ** 2).sum(axis=1))
        return pd.DataFrame({"grp": g["grp"].iloc[0], "start": g["start"].iloc[0], "cluster": np.arange(len(chosen)), "centre": [v[i].tolist() for i in chosen]})

    return kept(weighed.groupBy("grp", "start").applyInPandas(plus_plus, CENTRES))


def medoids(points: DataFrame, centres: DataFrame) -> DataFrame:
    """(grp, cluster, medoid, distance): of each centre the nearest point of its group, whichever cluster that is in; ties by row."""
    by = _blocks(centres)
    parts = []
    for block in by:
        held = points.sparkSession.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            best: dict[tuple[str, int], tuple[float, int]] = {}
            for batch in batches:
                groups, rows = np.array(batch.column(0).to_pylist(), object), batch.column(1).to_numpy()
                for g in pd.unique(groups):
                    own = np.flatnonzero(groups == g)
                    v = _matrix(batch.column(2).take(pa.array(own)))
                    for _, k, c in held.value.get(g, []):
                        d = np.round(np.sqrt(((v - c) ** 2).sum(axis=1)), 6)
                        at = np.lexsort((rows[own], d))[0]
                        best[g, k] = min(best.get((g, k), (np.inf, 0)), (float(d[at]), int(rows[own][at])))
            yield pa.RecordBatch.from_arrays([pa.array([g for g, _ in best], pa.string()), pa.array([k for _, k in best], pa.int32()), pa.array([d for d, _ in best.values()], pa.float64()), pa.array([r for _, r in best.values()], pa.int64())], names=["grp", "cluster", "distance", "row"])

        parts.append(points.select("grp", "row", "v").mapInArrow(run, "grp string, cluster int, distance double, row long"))
    both = parts[0]
    for p in parts[1:]:
        both = both.unionByName(p)
    near = both.groupBy("grp", "cluster").agg(F.min(F.struct("distance", "row")).alias("m"))
    return near.select("grp", "cluster", F.col("m.row").alias("medoid"), F.col("m.distance").alias("distance"))


def kmeans(df: DataFrame, group: str, row: str, vector: str, k: dict[str, int] | int, starts: int = 3, rounds: int = 100, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """(rows, centres) of the best of several starts in each group: rows (grp, row, clustnum, distance), centres as of lloyd().

    k is lowered to a group's number of distinct points. Rows without a vector, and groups without a k, have no cluster.
    """
    points = kept(points_of(df, group, row, vector))
    centres, _ = lloyd(points, seeded(points, k, starts, seed), rounds)
    near = kept(assigned(points, centres))
    cost = near.groupBy("grp", "start").agg(F.sum("d2").alias("cost")).groupBy("grp").agg(F.min(F.struct("cost", "start"))["start"].alias("best"))
    best = F.broadcast(kept(cost).toDF("of_grp", "best"))  # a row a group
    is_best = (F.col("grp") == F.col("of_grp")) & (F.col("start") == F.col("best"))
    rows = near.join(best, is_best).select("grp", "row", F.col("cluster").alias("clustnum"), F.sqrt("d2").alias("distance"))
    return rows, centres.join(best, is_best).select("grp", "start", "cluster", "centre")


def cluster_blocks(blocks: DataFrame, k: dict[str, int], mw_cutoff: float | None = None, cycle: str = "cycle", row: str = "bb_id", vector: str = "fp", mw: str = "mw", **more) -> DataFrame:
    """Building-block lists of several cycles with clustnum: rows up to a mass, without a fingerprint left out, k clusters a cycle.

    Rows are known by cycle and row; columns of the input are kept.
    """
    light = blocks if mw_cutoff is None else blocks.where(F.col(mw) <= mw_cutoff)
    light = kept(light.where(F.col(vector).isNotNull()))
    keyed = light.withColumn("__row", F.xxhash64(cycle, row))
    rows, _ = kmeans(keyed.dropDuplicates(["__row"]), cycle, "__row", vector, k, **more)
    return keyed.join(rows.select("grp", F.col("row").alias("of_row"), "clustnum"), (F.col("__row") == F.col("of_row")) & (F.coalesce(F.col(cycle).cast("string"), F.lit("")) == F.col("grp"))).drop("__row", "of_row", "grp")
