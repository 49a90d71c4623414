"""Whole flows over compound tables, each one lazy plan."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from molloom.operators import chemistry, filters, selection

#: Property names of the filters and the descriptor columns that hold them.
COLUMNS = {"mw": "AMW", "rotb": "RBs", "hbd": "HBD", "hba": "HBA"}


def prepare_and_filter(df: DataFrame, limits: dict[str, float], patterns: list[str], salts: list[str], smiles: str = "smiles", keep: bool = False) -> DataFrame:
    """Strips salts, neutralises, adds the descriptors that the limits need, and marks rows as removed.

    patterns are regular expressions on the cleaned SMILES. Unreadable molecules are removed. Adds cleaned, first_fail,
    pattern and removed.
    """
    out = df.withColumn("cleaned", chemistry.neutralize(chemistry.strip_salts(F.col(smiles), salts)))
    out = chemistry.add_properties(out, "cleaned", sorted({*COLUMNS.values(), "HAC"}))
    fail, pattern = filters.first_failure(limits, COLUMNS), filters.first_pattern(F.col("cleaned"), patterns)
    out = out.withColumn("first_fail", fail).withColumn("pattern", pattern)
    readable = F.col("HAC").isNotNull()
    gone = filters.removed(F.when(readable, F.col("first_fail").isNotNull()), F.when(readable, F.col("pattern").isNotNull()), keep=keep)
    return out.withColumn("removed", gone)


def diverse_selection(df: DataFrame, excluded: DataFrame, limits: dict[str, float], patterns: list[str], salts: list[str], priority, key: str = "vendor_id", smiles: str = "smiles") -> DataFrame:
    """One compound of each generic scaffold: rows not excluded that pass the filters, those with priority first, then by key."""
    rows = prepare_and_filter(filters.exclude_ids(df, excluded, key), limits, patterns, salts, smiles).where("NOT removed")
    grouped = chemistry.add_scaffold(rows, "cleaned").where("scaffold <> 'N/A'")
    return selection.choose_one(grouped, "scaffold", priority, F.lit(True), key)
