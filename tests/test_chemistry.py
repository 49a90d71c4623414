import pytest
from pyspark.sql import functions as F

from molloom.chem import molecule as m
from molloom.operators import chemistry, selection

# heavy atoms, rings, fragments by hand
HAND = {"CCN": (3, 0, 1), "CCCC": (4, 0, 1), "c1ccccc1": (6, 1, 1), "CCNC1CCCC1": (8, 1, 1), "C1=NCC=N1": (5, 1, 1), "O=CCCNC(=O)OCc1ccccc1": (15, 1, 1), "CC(=O)O.[Na]": (5, 0, 2), "C[NH3+].[Cl-]": (3, 0, 2)}


@pytest.mark.parametrize("smiles", HAND)
def test_counts_by_hand(smiles):
    d = m.descriptors(smiles)
    assert (d["HAC"], d["rings"], d["fragments"]) == HAND[smiles]


def test_masses_and_hydrogens_by_hand():
    assert m.descriptors("CCN")["AMW"] == pytest.approx(2 * 12.011 + 14.007 + 7 * 1.008)
    assert m.descriptors("c1ccccc1")["AMW"] == pytest.approx(6 * 12.011 + 6 * 1.008)
    assert m.descriptors("c1ccncc1")["AMW"] == pytest.approx(5 * 12.011 + 14.007 + 5 * 1.008)
    d = m.descriptors("O=CCCNC(=O)OCc1ccccc1")
    assert (d["HBD"], d["HBA"]) == (1, 4)
    assert m.descriptors("CCCC")["RBs"] == 1 and m.descriptors("CCCC")["SP3"] == 1.0


@pytest.mark.parametrize("bad", [None, "", "not_a_smiles", "FAIL", "C(", "C1CC", "C)", "[Xx]", "C(C)(C)(C)(C)C", "11"])
def test_unreadable(bad):
    assert m.parse(bad) is None and m.scaffold_key(bad) is None and m.morgan(bad) is None


def test_order_of_atoms_does_not_matter():
    for a, b in (("CCO", "OCC"), ("c1ccccc1CCN", "NCCc1ccccc1"), ("CC(C)C(=O)N", "NC(=O)C(C)C")):
        assert m.morgan(a) == m.morgan(b) and m.scaffold_key(a) == m.scaffold_key(b)
    assert m.scaffold_key("CCNC1CCCC1") == m.scaffold_key("O=C1CCNC1") != m.scaffold_key("c1ccccc1")
    assert m.scaffold_key("CCCC") == ""


def test_columns(spark):
    df = spark.createDataFrame([("CCN",), ("FAIL",), (None,), ("nope",), ("CC(=O)O.[Na]",), ("C[NH3+].Cl",), ("C[N+](=O)[O-]",)], "smiles string")
    got = {r.smiles: r for r in chemistry.add_scaffold(chemistry.add_fingerprint(chemistry.add_properties(df))).collect()}
    assert got["CCN"].HAC == 3 and got["CCN"].scaffold == "" and len(got["CCN"].buckets) >= 3
    assert got["FAIL"].HAC is None and got[None].buckets is None and got["nope"].scaffold == "N/A"
    out = {r.smiles: (r.a, r.b) for r in df.select("smiles", chemistry.strip_salts(F.col("smiles"), ["[Na]", "Cl"]).alias("a"), chemistry.neutralize(F.col("smiles")).alias("b")).collect()}
    assert out["CC(=O)O.[Na]"][0] == "CC(=O)O" and out["C[NH3+].Cl"] == ("C[NH3+]", "CN.Cl") and out["C[N+](=O)[O-]"][1] == "C[N+](=O)[O-]"
    groups = selection.group_members(chemistry.add_scaffold(df.where("smiles IS NOT NULL")), "scaffold", "smiles").collect()
    assert {r.scaffold for r in groups} == {"", "N/A"}
