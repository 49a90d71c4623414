import pytest

from molloom.sources import compounds


def write(folder, name, text):
    (folder / name).write_text(text)


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=lambda r: [(x is None, x or "") for x in r])


def test_every_file_has_its_own_header(spark, tmp_path):
    write(tmp_path, "lib.BB1.csv", "BB_ID,SMILES\na1,CC\na2,CO\na1,XX\n")
    write(tmp_path, "lib.BB2.csv", "SMILES,BB_ID\nCN,b1\nCCC,b2\n")
    write(tmp_path, "lib.BB3.csv", 'smiles,MW,id\n"C,N",12.5,c1\n')
    write(tmp_path, "lib.BB4.csv", "")
    write(tmp_path, "other.BB1.csv", "BB_ID,SMILES\nz,Z\n")
    got = compounds.read_blocks(spark, str(tmp_path), "lib", more=["MW"])
    assert rows(got) == [("BB1", "a1", "CC", None), ("BB1", "a2", "CO", None), ("BB2", "b1", "CN", None), ("BB2", "b2", "CCC", None), ("BB3", "c1", "C,N", "12.5")]
    assert rows(compounds.read_folder(spark, str(tmp_path))) == sorted([("a1", "CC"), ("a2", "CO"), ("a1", "XX"), ("b1", "CN"), ("b2", "CCC"), ("c1", "C,N"), ("z", "Z")])


def test_names_and_missing_columns(spark, tmp_path):
    write(tmp_path, "lib.s.BB1.csv", "code,structure\na,CC\nb,\n,CO\n")
    assert rows(compounds.read_blocks(spark, str(tmp_path), "lib", "s", ids=["code"], smiles=["structure"])) == [("BB1", "a", "CC"), ("BB1", "b", None), ("BB1", None, "CO")]
    assert rows(compounds.read_folder(spark, str(tmp_path), ids=["code"], smiles=["structure"])) == [("a", "CC")]
    with pytest.raises(ValueError, match="bb_id, smiles"):
        compounds.read_blocks(spark, str(tmp_path), "lib", "s")
    assert compounds.read_blocks(spark, str(tmp_path), "nothing").count() == 0


def test_many_files_are_as_many_scans_as_headers(spark, tmp_path):
    for k in range(1000):
        write(tmp_path, f"f{k:04}.csv", f"BB_ID,SMILES\n{k},C{k}\n" if k % 2 else f"SMILES,x,BB_ID\nC{k},,{k}\n")
    df = compounds.read_folder(spark, str(tmp_path))
    assert df._jdf.queryExecution().executedPlan().toString().count("FileScan csv") == 2
    assert {(r.bb_id, r.smiles) for r in df.collect()} == {(str(k), f"C{k}") for k in range(1000)}


def test_values_that_hold_a_header_sign(spark, tmp_path):
    block = "name\n  x\n\n  0  0  0 V2000\nM  END\n"
    (tmp_path / "a.sdf").write_text(block + "> <A>\n> 5 mg\n>\n\n>  1 <B>\na > b\nsecond > line\n> <C>\nlast\n\n$$$$\n" + block + "> <A>\n<x>\n\n$$$$\n")
    got = compounds.read_sdf(spark, str(tmp_path / "a.sdf")).orderBy("record").collect()
    assert [r.props for r in got] == [{"A": "> 5 mg\n>", "B": "a > b\nsecond > line", "C": "last"}, {"A": "<x>"}]
