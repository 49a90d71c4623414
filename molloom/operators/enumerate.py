"""Combinatorial products and reaction schemes as relations."""

from __future__ import annotations

from functools import reduce
from math import prod

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from molloom.operators import permutation
from molloom.operators.transform import number_rows

#: Rows of a building-block list that are broadcast at most.
BROADCAST_ROWS = 200_000
#: Values that make a step pass its input on, or end the scheme with it.
SKIP, STOP = "product", "terminate"


def keep_first(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """One row for each key, the first in order."""
    w = Window.partitionBy(*keys).orderBy(order)
    return df.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def library_size(blocks: DataFrame, cycle: str = "cycle") -> DataFrame:
    """n_products: the product of the cycles' sizes (one row), up to 38 digits."""
    counts = blocks.groupBy(cycle).agg(F.count("*").cast("decimal(38,0)").alias("n"))
    return counts.agg(F.aggregate(F.collect_list("n"), F.lit(1).cast("decimal(38,0)"), lambda a, b: (a * b).cast("decimal(38,0)")).alias("n_products"))


def positions(blocks: DataFrame, order: str = "bb_id", cycle: str = "cycle") -> DataFrame:
    """Adds pos: the place of each building block in its cycle, from 0. Ranges are sorted apart, so a cycle may hold most rows."""
    rows = number_rows(blocks, [F.col(cycle), F.col(order)], "__number")
    first = rows.groupBy(F.col(cycle).alias("__cycle")).agg(F.min("__number").alias("__first"))
    return rows.join(first, F.col(cycle).eqNullSafe(F.col("__cycle"))).withColumn("pos", F.col("__number") - F.col("__first")).drop("__number", "__cycle", "__first")


def full_product(lists: list[DataFrame]) -> DataFrame:
    """Every combination of the lists' rows; their columns must differ. The output is the product by definition.

    Each list beside the first is broadcast if it has BROADCAST_ROWS rows at most, else Spark deals the product out.
    """

    def beside(a: DataFrame, b: DataFrame) -> DataFrame:
        return a.crossJoin(F.broadcast(b) if b.count() <= BROADCAST_ROWS else b)

    return reduce(beside, lists)


def cycle_sizes(blocks: DataFrame, cycles: list[str]) -> list[int]:
    counts = {r[0]: r[1] for r in blocks.where(F.col("cycle").isin(cycles)).groupBy("cycle").agg(F.count("*")).collect()}
    return [counts.get(c, 0) for c in cycles]


def decoded(numbered: DataFrame, blocks: DataFrame, cycles: list[str], sizes: list[int]) -> DataFrame:
    """(sample_id, bb_1, bb_2, ...) of rows (sample_id, hi, lo): the member hi * base + lo, base as of permuted(), written with
    the cycles' sizes as digits, the last cycle fastest."""
    base = permutation.halves(prod(sizes))[1]
    rows = numbered
    for k in range(len(cycles), 0, -1):
        size = max(sizes[k - 1], 1)
        # long division of the two limbs by a digit's size; the remainder is the digit
        rest = F.col("hi") % size
        low = rest.cast("decimal(19,0)") * F.lit(base).cast("decimal(19,0)") + F.col("lo")
        rows = rows.withColumn(f"p_{k}", (low % F.lit(size).cast("decimal(19,0)")).cast("long"))
        rows = rows.withColumn("lo", F.expr(f"((hi % {size}L) * CAST({base}L AS DECIMAL(19,0)) + lo) div CAST({size}L AS DECIMAL(19,0))")).withColumn("hi", F.expr(f"hi div {size}L"))
    for k, c in enumerate(cycles, 1):
        own = blocks.where(F.col("cycle") == c).select(F.col("pos").alias(f"of_{k}"), F.col("bb_id").alias(f"bb_{k}"))
        rows = rows.join(own, F.col(f"p_{k}") == F.col(f"of_{k}"))
    return rows.select("sample_id", *(f"bb_{k}" for k in range(1, len(cycles) + 1)))


def sample_product(blocks: DataFrame, cycles: list[str], n: int, seed: int = 0) -> DataFrame:
    """n distinct members of the product without building it: (sample_id, bb_1, bb_2, ...).

    blocks (cycle, bb_id, pos). Member k is number k of a keyed permutation of all members, so every member is as
    likely as any other; with n beyond the size each comes once. Products may have up to permutation.LARGEST members.
    """
    sizes = cycle_sizes(blocks, cycles)
    total = prod(sizes)
    ids = blocks.sparkSession.range(min(n, total)).withColumnRenamed("id", "sample_id")
    return decoded(permutation.permuted(ids, "sample_id", total, seed), blocks, cycles, sizes)


def pick_product(blocks: DataFrame, cycles: list[str], n: int, seed: int = 0) -> DataFrame:
    """n members of the product, drawn with replacement: (sample_id, bb_1, bb_2, ...). Each cycle is drawn by a hash of its own."""
    sizes = cycle_sizes(blocks, cycles)
    rows = blocks.sparkSession.range(n if prod(sizes) else 0).withColumnRenamed("id", "sample_id")
    rows = rows.select("sample_id", *(F.pmod(F.xxhash64(F.lit(seed), F.lit(k), "sample_id"), F.lit(max(size, 1))).alias(f"p_{k}") for k, size in enumerate(sizes, 1)))
    for k, c in enumerate(cycles, 1):
        own = blocks.where(F.col("cycle") == c).select(F.col("pos").alias(f"of_{k}"), F.col("bb_id").alias(f"bb_{k}"))
        rows = rows.join(own, F.col(f"p_{k}") == F.col(f"of_{k}"))
    return rows.select("sample_id", *(f"bb_{k}" for k in range(1, len(cycles) + 1)))


def test_tuples(blocks: DataFrame, static: str, cycles: list[str], n: int, seed: int = 0) -> DataFrame:
    """Every block of the static cycle beside the same n partner tuples, drawn with replacement from the other cycles:
    (sample_id, bb_1, bb_2, ...) in the order of cycles."""
    others = [c for c in cycles if c != static]
    picks = pick_product(blocks, others, n, seed)
    names = {c: f"bb_{k}" for k, c in enumerate(others, 1)}
    picks = picks.select("sample_id", *(F.col(v).alias(f"__{c}") for c, v in names.items()))
    own = blocks.where(F.col("cycle") == static).select(F.col("bb_id").alias(f"__{static}"))
    both = own.join(F.broadcast(picks) if n <= BROADCAST_ROWS else picks)
    return both.select("sample_id", *(F.col(f"__{c}").alias(f"bb_{k}") for k, c in enumerate(cycles, 1)))


def constant_side(df: DataFrame, slot: int, constants: list[str | None]) -> DataFrame:
    """Every row's reactants r0, r1, ...: its bb_id in one slot, constants in the others."""
    return df.select("*", *(F.col("bb_id").alias(f"r{k}") if k == slot else F.lit(c).cast("string").alias(f"r{k}") for k, c in enumerate(constants)))


def partner_sample(static: DataFrame, partners: DataFrame, size: int) -> DataFrame:
    """Each static block beside the same size partner tuples: those with the least hash of their columns."""
    picked = partners.withColumn("__h", F.xxhash64(*partners.columns)).orderBy("__h", *partners.columns).limit(size).drop("__h")
    return static.crossJoin(F.broadcast(picked))


def lookup_distinct(df: DataFrame, keys: list[str], name: str, value: Column) -> DataFrame:
    """Adds value, computed once for each distinct key and joined back; a null is a key like any other."""
    done = df.select(*keys).distinct().withColumn(name, value)
    done = done.select(*(F.col(k).alias(f"__key_{k}") for k in keys), name)
    same = reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(f"__key_{k}")) for k in keys])
    return df.join(done, same).drop(*(f"__key_{k}" for k in keys))


def run_scheme(df: DataFrame, first: Column, steps: list[list[tuple[Column | None, Column | str]]]) -> DataFrame:
    """Folds a scheme over each row: adds product, status and the intermediates.

    A step is an ordered list of (condition, result); the first condition that holds decides, None is the default.
    Conditions and results see the column `product`, the result of the step before; SKIP keeps it and STOP keeps it and
    skips all later steps. A row for which no condition holds has status FAIL and a null product from then on.
    """
    out = df.withColumn("product", first).withColumn("status", F.when(first.isNull(), "FAIL").otherwise("OK")).withColumn("intermediates", F.array().cast("array<string>"))
    for rules in steps:
        choice = None
        for condition, result in rules:
            marker = isinstance(result, str)
            # the rule that decides the value decides on stopping too
            one = F.struct((F.col("product") if marker else result).cast("string").alias("made"), F.lit(marker and result == STOP).alias("stop"))
            c = F.lit(True) if condition is None else condition
            choice = F.when(c, one) if choice is None else choice.when(c, one)
        going = F.col("status") == "OK"
        out = out.withColumn("__choice", choice).withColumn("__made", F.when(going, F.col("__choice.made")).otherwise(F.col("product")))
        out = out.withColumn("__stop", F.coalesce(going & F.col("__choice.stop"), F.lit(False)))
        out = out.withColumn("intermediates", F.when(going & F.col("__made").isNotNull(), F.concat("intermediates", F.array(F.col("__made")))).otherwise(F.col("intermediates")))
        status = F.when(going & F.col("__made").isNull(), "FAIL").when(F.col("__stop"), "DONE").otherwise(F.col("status"))
        out = out.withColumn("status", status).withColumn("product", F.when(F.col("status") == "FAIL", F.lit(None)).otherwise(F.col("__made"))).drop("__choice", "__made", "__stop")
    return out.withColumn("status", F.when(F.col("status") == "DONE", "OK").otherwise(F.col("status")))


def mark_multiple(product: Column, n_products: Column) -> Column:
    """The product, or the mark of a reaction that gives several."""
    return F.when(n_products > 1, "FAIL--MULTIPLE PRODUCTS").otherwise(product)


def variants(df: DataFrame, parts: Column, first_and_last: bool = False) -> DataFrame:
    """One row for each variant of a row: adds variant and n (its number, from 0). With first_and_last only those two."""
    kept = F.filter(parts, lambda x, i: (i == 0) | (i == F.size(parts) - 1)) if first_and_last else parts
    return df.select("*", F.posexplode(kept).alias("n", "variant"))


def picklist(blocks: DataFrame, picks: DataFrame, key: str) -> DataFrame:
    """Picks with their building blocks; picks without a block stay with nulls."""
    return picks.join(blocks, key, "left")
