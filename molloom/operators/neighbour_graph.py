"""The graph of nearest neighbours of all points by NN-descent: neighbours of neighbours are likely neighbours.

Rows with one fingerprint are one point. A round joins samples of each point's new and old neighbours, and of the points that
have it as theirs, among each other: at most (4 * sample)^2 / 2 pairs a point, however popular it is, and never all pairs. The
samples are hashes, so that a run can be repeated. It ends when a round improves fewer than stop of all edges.

Fingerprints of one word under the Tanimoto are compared in the tasks that hold a point's samples, and a pair leaves them only if
its score reaches the least one that an end holds now; they start from the nearest in windows of the points in a few orders. Tables grow with the
points and are small as files, so joins are told to merge: none is broadcast for its size on disk.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from molloom.functions import fingerprints as fp
from molloom.operators.store import kept
from molloom.operators.transform import number_rows


def points_of(df: DataFrame, row: str, words: str) -> tuple[DataFrame, DataFrame]:
    """(point = least row, words) of each fingerprint, and (row, point). Rows without a fingerprint are left out."""
    rows = df.where(F.col(words).isNotNull()).select(F.col(row).alias("row"), F.col(words).alias("words"))
    points = kept(rows.groupBy("words").agg(F.min("row").alias("point")))
    return points.select("point", "words"), rows.join(points, "words").select("row", "point")


def _first(df: DataFrame, key: str, order: list, n: int) -> DataFrame:
    """The first n rows of each key; tasks keep n of their own before rows are dealt."""
    w = Window.partitionBy(key).orderBy(*order)
    return df.withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= n).drop("__n")


#: Points of a window, orders of the points, pairs that a task compares at once.
WINDOW, ORDERS, CHUNK = 256, (0, 21, 43), 1 << 20


def by_key(batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
    """Columns of rows sorted by the first one, complete keys only."""
    held: list[list[np.ndarray]] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append([c.to_numpy(zero_copy_only=False) for c in batch.columns])
        if held[-1][0][0] == held[-1][0][-1] and len(held) < 1000:
            continue
        every = [np.concatenate(c) for c in zip(*held)]
        cut = int(np.searchsorted(every[0], every[0][-1]))
        yield [c[:cut] for c in every]
        held = [[c[cut:] for c in every]]
    if held:
        yield [np.concatenate(c) for c in zip(*held)]


def _tanimoto(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    common, union = np.bitwise_count(x & y), np.bitwise_count(x | y)
    return np.where(union > 0, common / np.maximum(union, 1), 0.0)


def pairs_within(key: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs of rows of equal key, a few at a time."""
    starts = np.flatnonzero(np.diff(key, prepend=key[:1] - 1)) if len(key) else np.zeros(0, np.int64)
    after = np.repeat(np.append(starts[1:], len(key)), np.diff(starts, append=len(key))) - np.arange(len(key)) - 1
    upto, i = np.cumsum(after), 0
    while i < len(key):
        j = max(i + 1, int(np.searchsorted(upto, (upto[i - 1] if i else 0) + CHUNK, "right")))
        a = np.repeat(np.arange(i, j), after[i:j])
        yield a, a + 1 + np.arange(len(a)) - np.repeat(np.cumsum(after[i:j]) - after[i:j], after[i:j])
        i = j


def _told(point: np.ndarray, near: np.ndarray, score: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(point), pa.array(near), pa.array(score)], names=["point", "near", "score"])


def _starts(points: DataFrame, k: int) -> DataFrame:
    """(point, near, score): of each point the k nearest in its windows."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for window, point, words in by_key(batches):
            words = words.view(np.uint64)
            for w in np.unique(window).tolist():
                i, j = np.searchsorted(window, [w, w + 1])
                of, x = point[i:j], words[i:j]
                score = _tanimoto(x[:, None], x[None, :])
                np.fill_diagonal(score, -1)
                best = np.lexsort((np.broadcast_to(of, score.shape), -score), axis=1)[:, : min(k, j - i - 1)]
                yield _told(np.repeat(of, best.shape[1]), of[best.ravel()], np.take_along_axis(score, best, 1).ravel())

    found = None
    for r in ORDERS:
        turned = points.select("point", "words", F.shiftleft("words", r).bitwiseOR(F.shiftrightunsigned("words", 64 - r) if r else F.col("words")).alias("turned"))
        placed = number_rows(turned, [F.col("turned"), F.col("point")], "number").select(F.floor(F.col("number") / WINDOW).cast("long").alias("window"), "point", "words")
        own = placed.repartition("window").sortWithinPartitions("window").mapInArrow(run, "point long, near long, score double")
        found = own if found is None else found.unionByName(own)
    return found.distinct()


def _local(met: DataFrame, known: DataFrame) -> DataFrame:
    """met (point, near, new), known (x_, w, least): (point, near, score) of pairs met at a point, one of them new at least, that
    reach the least score of their first."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for point, near, new, words, least in by_key(batches):
            words = words.view(np.uint64)
            for a, b in pairs_within(point):
                use = new[a] | new[b]
                a, b = a[use], b[use]
                score = _tanimoto(words[a], words[b])
                for x, y in ((a, b), (b, a)):
                    up = score >= least[x]
                    yield _told(near[x[up]], near[y[up]], score[up])

    rows = met.join(known.hint("merge"), F.col("near") == F.col("x_")).select("point", "near", "new", "w", "least")
    return rows.repartition("point").sortWithinPartitions("point").mapInArrow(run, "point long, near long, score double")


def neighbour_graph(points: DataFrame, k: int = 25, sample: int = 15, rounds: int = 12, stop: float = 0.002, seed: int = 0, score: Callable[[Column, Column], Column] = fp.tanimoto_words) -> tuple[DataFrame, list[int]]:
    """points (point, words), distinct: (point, near, score) of about the k nearest of each, equal scores by near; and the
    edges that each round improved. score: of two fingerprints, the larger the nearer."""
    numbered = kept(number_rows(points, [F.col("point")], "number"))
    n = numbered.count()
    words = numbered.select("point", "words")
    if n <= 1:
        return points.select("point", F.col("point").alias("near"), F.lit(0.0).alias("score")).limit(0), []
    value = lambda c: F.coalesce(score(F.col(f"w_{c[0]}"), F.col(f"w_{c[1]}")), F.lit(0.0)).alias("score")

    def scored(pairs: DataFrame) -> DataFrame:
        """pairs (x, y): with their score, both ways."""
        both = pairs.join(words.toDF("x_", "w_x").hint("merge"), F.col("x") == F.col("x_")).join(words.toDF("y_", "w_y").hint("merge"), F.col("y") == F.col("y_")).select("x", "y", value("xy"))
        return both.select(F.explode(F.array(F.struct(F.col("x").alias("point"), F.col("y").alias("near"), "score"), F.struct(F.col("y").alias("point"), F.col("x").alias("near"), "score"))).alias("e")).select("e.*")

    drawn = numbered.select(F.col("point").alias("x"), "number", F.explode(F.sequence(F.lit(1), F.lit(min(k, n - 1)))).alias("j"))
    # distinct steps around a ring, so that none is the point itself
    drawn = drawn.withColumn("to", F.pmod(F.col("number") + 1 + F.pmod(F.xxhash64(F.lit(seed), "x", "j"), F.lit(n - 1)), F.lit(n)))
    drawn = drawn.join(numbered.select(F.col("number").alias("at"), F.col("point").alias("y")).hint("merge"), F.col("to") == F.col("at")).select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).distinct()
    best = [F.col("score").desc(), F.col("near")]
    local = score is fp.tanimoto_words and dict(points.dtypes)["point"] == dict(points.dtypes)["words"] == "bigint"
    graph = kept(_first(_starts(words, k) if local else scored(drawn).distinct(), "point", best, k).withColumn("new", F.lit(True)))
    improved = []
    for turn in range(rounds):
        luck = lambda *c: F.xxhash64(F.lit(seed), F.lit(turn), *c)
        new = kept(_first(graph.where("new"), "point", [luck("point", "near")], sample))
        old = _first(graph.where("NOT new"), "point", [luck("point", "near")], sample)
        ends = new.select("point", "near", F.lit(True).alias("new")).unionByName(old.select("point", "near", F.lit(False).alias("new")))
        back = ends.select(F.col("near").alias("point"), F.col("point").alias("near"), "new")
        back = _first(back.where("new"), "point", [luck("near", "point")], sample).unionByName(_first(back.where("NOT new"), "point", [luck("near", "point")], sample))
        met = kept(ends.unionByName(back).groupBy("point", "near").agg(F.max("new").alias("new")))
        if local:
            holds = graph.groupBy(F.col("point").alias("of")).agg(F.count("*").alias("n"), F.min("score").alias("least"))
            floor = F.when(F.col("n") >= k, F.col("least")).otherwise(F.lit(-1.0)).alias("least")
            found = _local(met, words.join(holds.hint("merge"), F.col("point") == F.col("of"), "left").select(F.col("point").alias("x_"), F.col("words").alias("w"), floor))
        else:
            a, b = met.toDF("v", "x", "new_x"), met.toDF("u", "y", "new_y")
            pairs = a.join(b.hint("merge"), F.col("v") == F.col("u")).where("x < y AND (new_x OR new_y)").select("x", "y").distinct()
            found = scored(pairs)
        used = new.select(F.col("point").alias("p_"), F.col("near").alias("n_"), F.lit(True).alias("used"))
        aged = graph.join(used.hint("merge"), (F.col("point") == F.col("p_")) & (F.col("near") == F.col("n_")), "left").select("point", "near", "score", (F.col("new") & F.col("used").isNull()).alias("new"), F.lit(True).alias("held"))
        found = found.select("*", F.lit(True).alias("new"), F.lit(False).alias("held"))
        # an edge that is known keeps its age
        every = aged.unionByName(found).groupBy("point", "near").agg(F.max("score").alias("score"), F.min("new").alias("new"), F.max("held").alias("held"))
        graph = kept(_first(every, "point", best, k))
        improved.append(graph.where("NOT held").count())
        graph = graph.drop("held")
        if improved[-1] < stop * n * k:
            break
    return graph.select("point", "near", "score"), improved


def recall(graph: DataFrame, truth: DataFrame, k: int) -> float:
    """The share of the k true neighbours of each point, truth (point, near, score), that the graph has or equals in score."""
    true = _first(truth, "point", [F.col("score").desc(), F.col("near")], k)
    cut = true.groupBy(F.col("point").alias("of")).agg(F.min("score").alias("cut"), F.count("*").alias("n"))
    hits = cut.join(graph, F.col("of") == F.col("point"), "left").groupBy("of").agg(F.least(F.max("n"), F.count_if(F.col("score") >= F.col("cut"))).alias("hit"), F.max("n").alias("n"))
    return float(hits.agg(F.sum("hit") / F.sum("n")).first()[0])
