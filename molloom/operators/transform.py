"""Column transforms of compound tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from molloom.operators.store import kept


def standardize_columns(df: DataFrame, aliases: dict[str, list[str]]) -> DataFrame:
    """Renames each name's first present alias; a second one raises, as the result would hold the name twice."""
    for name, known in aliases.items():
        found = [c for c in df.columns if c in known and c != name]
        if len(found) + (name in df.columns) > 1:
            raise ValueError(f"several columns mean {name}: {found}")
        if found:
            df = df.withColumnRenamed(found[0], name)
    return df


def find_column(df: DataFrame, part: str) -> str:
    """The first column whose name holds part, whatever the case."""
    for c in df.columns:
        if part.lower() in c.lower():
            return c
    raise ValueError(f"no column holds {part}")


def fragment_count(smiles: Column) -> Column:
    """Disconnected parts of a SMILES (ring closures across the dot aside); null for null."""
    return F.size(F.split(smiles, r"\."))


def strip_stereo(smiles: Column) -> Column:
    """Without the marks of tetrahedral and double-bond stereo."""
    return F.regexp_replace(smiles, r"[@/\\]+", "")


def union_all(frames: list[DataFrame], drop_incomplete: bool = True) -> DataFrame:
    """All rows; with drop_incomplete without those that lack a value."""
    out = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
    return out.dropna() if drop_incomplete else out


def tagged_union(frames: dict[str, DataFrame], tag: str = "color") -> DataFrame:
    """All rows, each with the name of its frame."""
    return union_all([df.withColumn(tag, F.lit(name)) for name, df in frames.items()], drop_incomplete=False)


def number_rows(df: DataFrame, order: list, name: str = "number") -> DataFrame:
    """Adds name, the place of each row in an order from 0: ranges are sorted apart, each after the rows of those before."""
    dealt = kept(df.repartitionByRange(*order).sortWithinPartitions(*order).select("*", F.spark_partition_id().alias("__part"), F.monotonically_increasing_id().alias("__at")))
    sizes = dealt.groupBy("__part").agg(F.count("*").alias("__n"), F.min("__at").alias("__first"))
    before = sizes.select(F.col("__part").alias("__of"), "__first", (F.sum("__n").over(Window.orderBy("__part")) - F.col("__n")).alias("__before"))  # a row a range
    return dealt.join(before, F.col("__part") == F.col("__of")).withColumn(name, F.col("__before") + F.col("__at") - F.col("__first")).drop("__part", "__at", "__of", "__first", "__before")


def until_passing(df: DataFrame, order: list, passing: Column, n: int) -> tuple[DataFrame, int]:
    """The rows in order up to the n-th that passes, all if fewer pass, with `passes`; and how many ranges of the order were looked at.

    Ranges are dealt once. passing, which may be costly, is evaluated on the first range, then on twice as many each time, until n
    rows pass; only the range that holds the n-th is counted row by row.
    """
    dealt = kept(df.repartitionByRange(*order).sortWithinPartitions(*order).select("*", F.spark_partition_id().alias("__part"), F.monotonically_increasing_id().alias("__at")))
    parts = [r[0] for r in dealt.select("__part").distinct().orderBy("__part").collect()]  # a row a range
    done, looked, total, last = [], 0, 0, None
    while looked < len(parts) and total < n:
        some = parts[looked : max(1, 2 * looked)]
        seen = kept(dealt.where(F.col("__part").between(some[0], some[-1])).withColumn("passes", F.coalesce(passing, F.lit(False))))
        done.append(seen)
        looked += len(some)
        for part, count in seen.groupBy("__part").agg(F.count_if("passes")).orderBy("__part").collect():
            if total < n <= total + count:
                last = (part, n - total)
            total += count
    if not done or n <= 0:
        return df.limit(0).withColumn("passes", F.lit(False)), 0
    rows = reduce(DataFrame.unionByName, done)
    if last is not None:
        part, more = last
        ended = rows.where(F.col("__part") == part).where("passes").select("__at").orderBy("__at").limit(more).agg(F.max("__at")).first()[0]
        rows = rows.where((F.col("__part") < part) | (F.col("__part") == part) & (F.col("__at") <= ended))
    return rows.drop("__part", "__at"), looked


def sample_rows(df: DataFrame, key: str, share: float) -> DataFrame:
    """About so large a share of the rows, chosen by a hash of their key: the same rows at any partitioning."""
    return df.where(F.pmod(F.xxhash64(key), F.lit(1_000_000)) < int(share * 1_000_000))


def shuffled(df: DataFrame, keys: list[str], seed: int = 0) -> list[Column]:
    """The order of a seeded shuffle: a hash of the keys, then the keys. It does not depend on partitions."""
    return [F.xxhash64(F.lit(seed), *keys), *map(F.col, keys)]


def sample_exactly(df: DataFrame, keys: list[str], n: int, seed: int = 0) -> DataFrame:
    """Exactly n rows (all, where there are fewer), the first of a seeded shuffle; partial sorts keep n rows a task."""
    return df.orderBy(*shuffled(df, keys, seed)).limit(n)


def picks_with_replacement(df: DataFrame, keys: list[str], n: int, seed: int = 0) -> DataFrame:
    """n picks, each any row: (pick, number) and the row's columns. Equal seeds give equal picks."""
    rows = number_rows(df, [F.col(k) for k in keys])
    total = rows.count()
    picks = df.sparkSession.range(n if total else 0).select(F.col("id").alias("pick"), F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(max(total, 1))).alias("__number"))
    return picks.join(rows, F.col("__number") == F.col("number")).drop("__number")
