"""Molecule columns: Arrow-batched helpers over a SMILES column, cheap tests in Catalyst first."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from molloom.chem import molecule
from molloom.operators.filters import FAILED

PROPERTIES = "AMW double, ExactMW double, HAC int, HBD int, HBA int, RBs int, SP3 double, rings int, fragments int"


def readable(smiles: Column) -> Column:
    return F.when(smiles.isNotNull() & ~smiles.isin(*FAILED), smiles)


def _mapped(smiles: Column, kind: str, f: Callable) -> Column:
    """f of each molecule, Arrow batch by Arrow batch. Made in a function, as it needs a session."""

    @F.pandas_udf(kind)
    def made(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield s.map(f)

    return made(readable(smiles))


def _described(smiles: Column) -> Column:
    names = [x.split()[0] for x in PROPERTIES.split(", ")]

    @F.pandas_udf(PROPERTIES)
    def made(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for s in batches:
            found = [molecule.descriptors(x) for x in s]
            yield pd.DataFrame([[None] * len(names) if d is None else [d[n] for n in names] for d in found], columns=names)

    return made(readable(smiles))


def add_properties(df: DataFrame, smiles: str = "smiles", names: list[str] | None = None) -> DataFrame:
    """Adds the asked descriptors (all by default); unreadable and failed molecules have nulls."""
    out = df.withColumn("__p", _described(F.col(smiles)))
    return out.withColumns({n: F.col("__p")[n] for n in names or [x.split()[0] for x in PROPERTIES.split(", ")]}).drop("__p")


def add_scaffold(df: DataFrame, smiles: str = "smiles", name: str = "scaffold") -> DataFrame:
    """Adds the generic scaffold's key: '' without rings, 'N/A' for unreadable molecules."""
    return df.withColumn(name, F.coalesce(_mapped(F.col(smiles), "string", molecule.scaffold_key), F.lit("N/A")))


def add_fingerprint(df: DataFrame, smiles: str = "smiles", radius: int = 2, size: int = 1024, name: str = "buckets") -> DataFrame:
    """Adds the buckets of the extended-connectivity fingerprint, repeats included (array_distinct gives the bits)."""
    return df.withColumn(name, _mapped(F.col(smiles), "array<int>", lambda x: molecule.morgan(x, radius, size)))


def strip_salts(smiles: Column, salts: list[str]) -> Column:
    """Without the fragments on the list; a molecule of nothing else stays as it is. Fragments are compared as written."""
    parts = F.split(smiles, r"\.")
    left = F.filter(parts, lambda p: ~p.isin(*salts))
    return F.when(F.instr(smiles, ".") == 0, smiles).when(F.size(left) == 0, smiles).otherwise(F.array_join(left, "."))


def neutralize(smiles: Column) -> Column:
    """Cations with hydrogens, and O and S anions, as neutral. In molecules with cations that have no hydrogen (nitro
    groups, quaternary nitrogen) anions stay."""
    out = smiles
    for charged, neutral in ((r"\[NH[23]?\+\]", "N"), (r"\[nH\+\]", "n")):
        out = F.regexp_replace(out, charged, neutral)
    for charged, neutral in ((r"\[O-\]", "O"), (r"\[S-\]", "S")):
        out = F.when(out.rlike(r"\[[A-Za-z]+\+\]"), out).otherwise(F.regexp_replace(out, charged, neutral))
    return out
