"""Property and pattern filters."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Keys of the bounds and the order in which they are tried.
#: The order in which bounds are tried, as (statistic, key of the bound, property, upper bound or not).
BOUNDS = [
    ("MW", "MW_high", "mw", True), ("MW", "MW_low", "mw", False), ("tPSA", "tPSA", "tpsa", True), ("logP", "logP_high", "logp", True), ("logP", "logP_low", "logp", False),
    ("RotB", "RotB_low", "rotb", False), ("RotB", "RotB_high", "rotb", True), ("HBD", "HBD_low", "hbd", False), ("HBD", "HBD_high", "hbd", True), ("HBA", "HBA_low", "hba", False), ("HBA", "HBA_high", "hba", True),
]


# Marks of failed rows, which have no molecule.
FAILED = ("FAIL", "ENUMERATION_FAIL", "NOSCHEMEFAIL")


def first_failure(limits: dict[str, float], columns: dict[str, str]) -> Column:
    """The statistic of the first bound that a row breaks, null if it keeps all. columns: property to column name.

    Bounds are strict (a value equal to a bound passes) and null properties pass; no limits pass all.
    """
    out = None
    for statistic, key, name, upper in BOUNDS:
        if key in limits and name in columns:
            broken = F.col(columns[name]) > limits[key] if upper else F.col(columns[name]) < limits[key]
            out = F.when(broken, statistic) if out is None else out.when(broken, statistic)
    return F.lit(None).cast("string") if out is None else out


def filter_stats(df: DataFrame, failure: Column) -> DataFrame:
    """Rows by first failure; 'kept' for those without."""
    return df.groupBy(F.coalesce(failure, F.lit("kept")).alias("first_fail")).agg(F.count("*").alias("n"))


def first_pattern(text: Column, patterns: list[str]) -> Column:
    """Number of the first pattern (a Java regular expression) that a text holds, null if none."""
    out = None
    for k, p in enumerate(patterns):
        out = F.when(text.rlike(p), k) if out is None else out.when(text.rlike(p), k)
    return F.lit(None).cast("int") if out is None else out


def pattern_groups(text: Column, include: list[str | list[str]], exclude: list[str]) -> Column:
    """All include items (of a nested list any one) and no exclude item; null texts hold nothing."""
    text = F.coalesce(text, F.lit(""))
    alternatives = [[i] if isinstance(i, str) else i for i in include]
    wanted = [reduce(Column.__or__, [text.rlike(p) for p in group]) for group in alternatives]
    return reduce(Column.__and__, [*wanted, *(~text.rlike(p) for p in exclude)], F.lit(True))


def named_lists(df: DataFrame, text: str, specs: dict[str, dict[str, list]], names: dict[str, str | list[str]] | None = None) -> DataFrame:
    """The rows of each named list: one row for each list whose patterns a row meets, with its name as list.

    specs: of each list its include items (a nested list: any one) and exclude items. names: the files that a list is
    known under, if not its own name; a list with several names comes once for each. All lists are tried in one scan.
    """
    member = []
    for key, spec in specs.items():
        own = (names or {}).get(key, key)
        member += [F.when(pattern_groups(F.col(text), spec.get("include", []), spec.get("exclude", [])), n) for n in ([own] if isinstance(own, str) else own)]
    return df.select("*", F.explode(F.filter(F.array(*member), lambda x: x.isNotNull())).alias("list"))


def criteria_of(scheme: dict, cycle: str, field: str = "filters"):
    """A cycle's criteria in a scheme: those under its own name, else those of the list that is known under it, else None."""
    own = scheme.get(field)
    if own is None or cycle in own:
        return own and own[cycle]
    key = next((k for k, v in own.get("names", {}).items() if cycle == v or isinstance(v, list) and cycle in v), None)
    return None if key is None else own["BB_filters"][key]


def removed(failure: Column, pattern: Column, ambiguous: Column | None = None, keep: bool = False) -> Column:
    """Whether a row is removed: it fails the properties, holds a pattern or is ambiguous; with keep, unless all of these hold.

    A null in any test removes the row, as rows that cannot be read are never kept.
    """
    tests = [failure, pattern, *([] if ambiguous is None else [ambiguous])]
    hit = reduce(Column.__and__ if keep else Column.__or__, tests)
    return F.coalesce(~hit if keep else hit, F.lit(True))


def exclude_ids(df: DataFrame, excluded: DataFrame, key: str) -> DataFrame:
    """Rows whose key is not excluded; rows without key stay."""
    gone = excluded.select(F.col(key).alias("__gone")).distinct()
    return df.join(gone, F.col(key) == F.col("__gone"), "left_anti")


def drop_failures(df: DataFrame, column: str, marks: tuple[str, ...] = FAILED) -> DataFrame:
    return df.where(F.col(column).isNotNull() & ~F.col(column).isin(*marks))
