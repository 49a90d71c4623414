"""Order-dependent selections as rounds of joins instead of a walk over ordered rows."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from molloom.operators.store import kept
from molloom.operators.transform import number_rows


#: Undecided rows, and links among them, that one task decides in their order at the end of the rounds.
TAIL_ROWS, TAIL_LINKS = 20_000, 1_000_000


def _tail(left: DataFrame, live: DataFrame, order: DataFrame) -> DataFrame:
    """The rows of left that the ordered walk chooses, by one task. live (better, worse): all links among them."""
    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(list(batches), schema)
        chosen: dict = {}
        for _, links in groupby(sorted(zip(*(rows.column(c).to_pylist() for c in ("at", "row", "better"))), key=itemgetter(0)), itemgetter(0)):
            links = list(links)
            if not any(better in chosen for _, _, better in links):
                chosen[links[0][1]] = True
        yield pa.RecordBatch.from_arrays([pa.array(list(chosen), schema.field("row").type)], names=["row"])

    numbered = number_rows(order.join(left, "row", "left_semi"), ["o"], "at").select("row", "at")
    tied = numbered.join(live.select(F.col("worse").alias("row"), "better"), "row", "left").select("at", "row", "better")
    schema = to_arrow_schema(tied.schema)
    return kept(tied.coalesce(1).mapInArrow(walk, left.schema))


def _enough(order: DataFrame, left: DataFrame, chosen: DataFrame, n: int) -> bool:
    """Whether n rows are chosen before the first undecided one, so that no later row matters."""
    first = order.join(left.select("row"), "row", "left_semi").agg(F.min("o").alias("first"))
    return order.join(chosen.select("row"), "row", "left_semi").join(F.broadcast(first), F.col("o") < F.col("first")).limit(n).count() >= n


def sphere_exclusion(rows: DataFrame, pairs: DataFrame, n_chosen: int | None = None, strict_n: bool = False) -> DataFrame:
    """Directed sphere exclusion. rows (row, rank); pairs (a, b): rows too similar to be chosen together.

    In the order of rank (then row) a row is chosen unless it is too similar to one chosen before. Adds chosen
    ('Yes', 'No', 'Unknown'), group (number of the chosen row whose sphere it lies in, from 0; the last such sphere) and
    reason. Each round chooses all rows without an undecided or chosen better neighbour and rejects their worse
    neighbours, which gives the walk's result; once TAIL_ROWS rows or fewer are undecided, one task walks over them, so long
    chains of rows that depend on each other do not take a round each. With n_chosen the walk ends after n_chosen + 1 choices
    (strict_n: n_chosen), later rows stay 'Unknown', and the rounds stop as soon as these choices are certain.
    """
    order = rows.select("row", F.struct("rank", "row").alias("o"))
    edges = pairs.select("a", "b").unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    edges = edges.join(order.toDF("a", "oa"), "a").join(order.toDF("b", "ob"), "b").where("oa < ob").select(F.col("a").alias("better"), F.col("b").alias("worse"))
    edges = kept(edges)
    left, chosen, live = kept(order.select("row")), None, edges
    while True:
        if left.count() <= TAIL_ROWS and live.limit(TAIL_LINKS + 1).count() <= TAIL_LINKS:
            last = _tail(left, live, order)
            chosen = last if chosen is None else chosen.unionByName(last)
            break
        blocked = live.select(F.col("worse").alias("row")).distinct()
        now = left.join(blocked, "row", "left_anti")
        chosen_now = kept(now)
        chosen = chosen_now if chosen is None else chosen.unionByName(chosen_now)
        gone = live.join(chosen_now.toDF("better"), "better", "left_semi").select(F.col("worse").alias("row")).distinct()
        left = kept(left.join(chosen_now, "row", "left_anti").join(gone, "row", "left_anti"))
        if not left.limit(1).count() or n_chosen is not None and _enough(order, left, chosen, n_chosen + 1):
            break
        live = kept(live.join(left.toDF("better"), "better", "left_semi").join(left.toDF("worse"), "worse", "left_semi"))
    picked = order.join(chosen, "row")
    numbered = number_rows(picked, ["o"], "group")
    spheres = edges.join(numbered.select(F.col("row").alias("better"), "group"), "better").groupBy(F.col("worse").alias("row")).agg(F.max("group").alias("in_group"))
    out = order.join(numbered.select("row", "group"), "row", "left").join(spheres, "row", "left")
    out = out.select("row", "o", F.when(F.col("group").isNotNull(), "Yes").otherwise("No").alias("chosen"), F.coalesce("group", "in_group").cast("long").alias("group"))
    if n_chosen is not None:
        last = n_chosen - 1 if strict_n else n_chosen
        end = numbered.where(F.col("group") == last).select(F.col("o").alias("end"))
        out = out.join(F.broadcast(end), F.lit(True), "left")
        late = F.coalesce(F.col("o") > F.col("end"), F.lit(False))
        out = out.select("row", "o", F.when(late, "Unknown").otherwise(F.col("chosen")).alias("chosen"), F.when(late, F.lit(-1)).otherwise(F.col("group")).cast("long").alias("group"))
    reason = F.when(F.col("chosen") == "Yes", "OK").when(F.col("chosen") == "No", "sim").otherwise("Unknown")
    return out.select("row", F.col("o")["rank"].alias("rank"), "chosen", "group", reason.alias("reason"))


def diverse_walk(rows: DataFrame, links: DataFrame, cap: int | None = None, max_sim: int = 0, max_scaff: int = 0, n_chosen: int | None = None, limit=None) -> DataFrame:
    """The ordered walk with all rules, as rounds of joins. rows (row, rank, blocks array, failed boolean), row unique; links
    (a, b, kind): 'sim', 'hard' (similar beyond the hard cutoff, a 'sim' too) or 'scaff' (scaffolds alike, texts not).

    In the order of rank (then row) a row is chosen unless its structure failed ('failed'), one of its blocks was used by
    cap chosen rows ('bbusage'), it has a hard link or max_sim similar ones to chosen rows ('sim'), or max_scaff scaffold
    links ('scaff'); a maximum of 0 counts as 1. Chosen rows with a similar one before them take its group, others found
    one; rows rejected for links take the group of the last link that rejects them, -1 stands for none. The walk ends
    after n_chosen + 1 choices, the rounds with it, and at the first rank beyond limit; what comes later is 'Unknown'.

    A round decides all rows that no undecided better row can change: the cap-th chosen row of a block closes it, rows up
    to its cap-th row that is chosen or undecided are free of the cap. The best undecided row is always decided.
    """
    sims, scaffs = max(1, max_sim), max(1, max_scaff)
    order = kept(rows.select("row", F.struct("rank", "row").alias("o"), F.coalesce("blocks", F.array()).alias("blocks"), F.coalesce("failed", F.lit(False)).alias("failed")))
    within = order if limit is None else order.where(F.col("o")["rank"] <= limit)
    walked = within.where(~F.col("failed"))
    ends = links.select("a", "b", "kind").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"), "kind"))
    ends = ends.groupBy("a", "b").agg(F.max(F.col("kind") == "hard").alias("hard"), F.max(F.col("kind") != "scaff").alias("sim"))
    place = walked.select("row", "o")
    edges = kept(ends.join(place.toDF("a", "oa"), "a").join(place.toDF("b", "ob"), "b").where("oa < ob").select(F.col("a").alias("better"), "oa", F.col("b").alias("worse"), "hard", "sim"))
    uses = kept(walked.select("row", "o", F.explode("blocks").alias("block")))

    def closing(some: DataFrame, name: str) -> DataFrame:
        """The place of each block's cap-th use."""
        used = uses.join(some.select("row"), "row", "left_semi")
        w = Window.partitionBy("block").orderBy("o")
        return used.withColumn("n", F.row_number().over(w)).where((F.col("n") <= cap) & (F.col("n") == cap)).select(F.col("block").alias(f"of_{name}"), F.col("o").alias(name))

    chosen = kept(place.limit(0).select("row"))
    left = kept(place)
    while left.limit(1).count():
        of_chosen = edges.join(chosen.toDF("better"), "better", "left_semi").groupBy("worse").agg(F.max("hard").alias("hard"), F.sum(F.col("sim").cast("int")).alias("n_sim"), F.sum((~F.col("sim")).cast("int")).alias("n_scaff"))
        out = of_chosen.where(F.col("hard") | (F.col("n_sim") >= sims) | (F.col("n_scaff") >= scaffs)).select(F.col("worse").alias("row"))
        open_ = edges.join(left.select(F.col("row").alias("better")), "better", "left_semi").select(F.col("worse").alias("row"))
        if cap is not None:
            own = uses.join(left.select("row"), "row", "left_semi").select("row", "o", "block")
            full = own.join(closing(chosen, "full"), F.col("block") == F.col("of_full")).where(F.col("o") > F.col("full")).select("row")
            out = out.unionByName(full)
            unsure = own.join(closing(chosen.unionByName(left.select("row")), "sure"), F.col("block") == F.col("of_sure")).where(F.col("o") > F.col("sure")).select("row")
            open_ = open_.unionByName(unsure)
        rest = kept(left.join(out.distinct(), "row", "left_anti"))
        now = kept(rest.join(open_.distinct(), "row", "left_anti").select("row"))
        chosen = kept(chosen.unionByName(now))
        left = kept(rest.join(now, "row", "left_anti"))
        if n_chosen is not None and _enough(place, left, chosen, n_chosen + 1):
            break

    order_of = place.join(chosen, "row")
    # the chosen row whose group a row takes: of similar ones the last; of scaffold links those from the scaffs-th on
    held = edges.join(chosen.toDF("better"), "better", "left_semi")
    nth = F.sum((~F.col("sim")).cast("int")).over(Window.partitionBy("worse").orderBy("oa").rowsBetween(Window.unboundedPreceding, 0))
    nth_sim = F.sum(F.col("sim").cast("int")).over(Window.partitionBy("worse").orderBy("oa").rowsBetween(Window.unboundedPreceding, 0))
    held = held.select("worse", "better", "oa", "sim", (F.col("sim") & ((nth_sim >= sims) | F.col("hard"))).alias("by_sim"), (~F.col("sim") & (nth >= scaffs)).alias("by_scaff"))
    parent = F.max(F.when(F.col("sim") | F.col("by_scaff"), F.struct("oa", "better")))
    why = F.max(F.when(F.col("by_sim") | F.col("by_scaff"), F.struct("oa", F.when(F.col("by_sim"), "sim").otherwise("scaff").alias("why"))))
    fate = kept(held.groupBy(F.col("worse").alias("of_row")).agg(parent["better"].alias("parent"), why["why"].alias("why")))
    up = kept(chosen.join(fate, F.col("row") == F.col("of_row"), "left").select("row", F.coalesce("parent", "row").alias("root")))
    while True:  # each step doubles the way to the row that founded the group
        step = up.toDF("of", "next")
        jumped = kept(up.join(step, F.col("root") == F.col("of")).select("row", F.col("next").alias("root"), (F.col("next") != F.col("root")).alias("moved")))
        up = jumped.select("row", "root")
        if not jumped.where("moved").limit(1).count():
            break
    founders = number_rows(up.where("row = root").select("root").join(place, F.col("root") == F.col("row")).select("root", "o"), ["o"], "group").select(F.col("root").alias("of_root"), "group")
    groups = kept(up.join(founders, F.col("root") == F.col("of_root")).select(F.col("row").alias("in_row"), F.col("group").cast("long").alias("group")))

    capped = None
    if cap is not None:
        capped = uses.join(closing(chosen, "full"), F.col("block") == F.col("of_full")).where(F.col("o") > F.col("full")).select(F.col("row").alias("capped")).distinct()
    else:
        capped = place.limit(0).select(F.col("row").alias("capped"))
    out = order.join(chosen.withColumnRenamed("row", "picked"), F.col("row") == F.col("picked"), "left").join(capped, F.col("row") == F.col("capped"), "left")
    out = out.join(fate, F.col("row") == F.col("of_row"), "left").join(groups, F.coalesce(F.col("picked"), F.col("parent")) == F.col("in_row"), "left")
    late = F.lit(False) if limit is None else F.col("o")["rank"] > limit
    if n_chosen is not None:
        last = number_rows(order_of.select("o"), ["o"], "n").where(F.col("n") == n_chosen).select(F.col("o").alias("end"))
        out = out.join(F.broadcast(last), F.lit(True), "left")  # one row at most
        late = late | F.coalesce(F.col("o") > F.col("end"), F.lit(False))
    reason = F.when(late, "Unknown").when(F.col("failed"), "failed").when(F.col("picked").isNotNull(), "OK").when(F.col("capped").isNotNull(), "bbusage").otherwise(F.col("why"))
    out = out.select("row", F.col("o")["rank"].alias("rank"), reason.alias("reason"), "group")
    group = F.when(F.col("reason").isin("Unknown", "bbusage"), F.lit(-1)).when(F.col("reason") != "failed", F.coalesce("group", F.lit(-1))).cast("long")
    return out.select("row", "rank", "reason", group.alias("group"))


def usage_cap(df: DataFrame, block: str, order: list, cap: int) -> DataFrame:
    """At most cap rows of each building block, in the given order; the others are marked 'bbusage'."""
    w = Window.partitionBy(block).orderBy(*order)
    return df.withColumn("reason", F.when(F.row_number().over(w) <= cap, "OK").otherwise("bbusage"))


def group_members(df: DataFrame, key: str, row: str) -> DataFrame:
    """The row beside its scaffold key, with the number of rows of that key and the least of them. Groups are counted
    before they are joined back, so a key of very many rows (the ring-less molecules) is never one list."""
    groups = df.groupBy(F.col(key).alias("__key")).agg(F.count("*").alias("n_rows"), F.min(row).alias("first_row"))
    return df.join(groups, F.col(key).eqNullSafe(F.col("__key"))).select(key, row, "n_rows", "first_row")


def choose_one(df: DataFrame, cluster: str, priority, medoid, row: str) -> DataFrame:
    """One row of each cluster: a row of the medoid with priority, else any with priority, else one of the medoid; ties by row."""
    w = Window.partitionBy(cluster).orderBy((priority & medoid).desc(), priority.desc(), medoid.desc(), row)
    return df.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")
