import os
import random

import pytest
from pyspark.sql import functions as F

from molloom.functions import fingerprints as fp
from molloom.operators import enumerate as en
from molloom.operators import filters, profile, selection, similarity, transform
from molloom.sources import compounds, schemes


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else None


def sets(n=60, seed=1):
    r = random.Random(seed)
    base = [set(r.sample(range(40), 10)) for _ in range(8)]
    return {i: frozenset(x for x in base[r.randrange(8)] if r.random() > 0.15) | frozenset(r.sample(range(40), 1)) for i in range(n)}


def test_self_join_finds_all_pairs(spark):
    rows = sets()
    df = spark.createDataFrame([(i, sorted(map(str, s))) for i, s in rows.items()], "row long, bits array<string>")
    reps, member = similarity.classes(df, "row", "bits")
    got = {(r.a, r.b) for r in similarity.similarity_self_join(reps, 0.6).collect()}
    first = {s: min(i for i, t in rows.items() if t == s) for s in rows.values()}
    assert {r.row: r.class_id for r in member.collect()} == {i: first[s] for i, s in rows.items()}
    assert got == {(i, j) for s, i in first.items() for t, j in first.items() if i < j and jaccard(s, t) >= 0.6} and got


def walk(order, near, n=None):
    chosen, out = [], {}
    for i in order:
        if n is not None and len(chosen) > n:
            out[i] = "Unknown"
        elif any(c in near[i] for c in chosen):
            out[i] = "No"
        else:
            chosen.append(i)
            out[i] = "Yes"
    return out, chosen


@pytest.mark.parametrize("n, tail", [(None, selection.TAIL_ROWS), (None, 12), (3, -1)])
def test_sphere_exclusion_is_the_walk(spark, monkeypatch, n, tail):
    """Rounds until so many rows are left for one task."""
    monkeypatch.setattr(selection, "TAIL_ROWS", tail)
    rows = sets(seed=5)
    near = {i: {j for j in rows if j != i and jaccard(rows[i], rows[j]) >= 0.4} for i in rows}
    ranks = {i: random.Random(i).randrange(20) for i in rows}
    order = sorted(rows, key=lambda i: (ranks[i], i))
    want, chosen = walk(order, near, n)
    df = spark.createDataFrame(list(ranks.items()), "row long, rank int")
    pairs = spark.createDataFrame([(i, j) for i in near for j in near[i] if i < j], "a long, b long")
    got = {r.row: r for r in selection.sphere_exclusion(df, pairs, n).collect()}
    assert {i: got[i].chosen for i in got} == want
    assert all(got[i].group == k for k, i in enumerate(chosen))
    if n is None:
        assert all(got[i].group == max(k for k, c in enumerate(chosen) if c in near[i] and order.index(c) < order.index(i)) for i in rows if want[i] == "No")
    assert selection.sphere_exclusion(df.limit(0), pairs.limit(0)).count() == 0


def test_words_and_bits_agree(spark):
    r = random.Random(2)
    df = spark.createDataFrame([([r.uniform(-1, 1) for _ in range(64)], [r.uniform(-1, 1) for _ in range(64)]) for _ in range(40)], "a array<double>, b array<double>")
    bad = df.select(fp.tanimoto_bits(fp.sign_bits(F.col("a")), fp.sign_bits(F.col("b"))).alias("x"), fp.tanimoto_words(fp.sign_word(F.col("a")), fp.sign_word(F.col("b"))).alias("y")).where("x <> y OR x IS NULL")
    assert bad.count() == 0


def test_against_queries_in_blocks(spark, monkeypatch):
    a, q = spark.range(50).toDF("a"), spark.range(7).toDF("q")
    monkeypatch.setattr(similarity, "BLOCK_ROWS", 2)
    assert similarity.against_queries(a, q).distinct().count() == 350


def test_filters(spark):
    df = spark.createDataFrame([(1, 500.0, 2, "ab"), (2, 100.0, 9, "b1"), (3, 300.0, 1, None), (4, None, 2, "c")], "id int, m double, h int, s string")
    fail = filters.first_failure({"MW_high": 400, "HBD_high": 5, "HBD_low": 2}, {"mw": "m", "hbd": "h"})
    assert {r.id: r.f for r in df.select("id", fail.alias("f")).collect()} == {1: "MW", 2: "HBD", 3: "HBD", 4: None}
    gone = filters.removed(fail.isNotNull(), F.col("s").rlike("b"))
    assert {r.id: r.g for r in df.select("id", gone.alias("g")).collect()} == {1: True, 2: True, 3: True, 4: False}
    keep = filters.pattern_groups(F.col("s"), [["a", "c"]], ["1"])
    assert {r.id for r in df.where(keep).collect()} == {1, 4}
    assert df.select(filters.first_failure({}, {}).alias("f")).where("f IS NOT NULL").count() == 0


def test_sampled_product_is_distinct_and_in_the_product(spark):
    blocks = en.positions(spark.createDataFrame([("BB1", f"a{k}") for k in range(7)] + [("BB2", f"b{k}") for k in range(11)], "cycle string, bb_id string"))
    rows = en.sample_product(blocks, ["BB1", "BB2"], 50).collect()
    assert len({(r.bb_1, r.bb_2) for r in rows}) == 50
    assert en.sample_product(blocks, ["BB1", "BB2"], 500).count() == 77 == en.library_size(blocks).first()[0]


def test_scheme_fails_and_stops(spark):
    df = spark.createDataFrame([(1,), (2,), (3,)], "k int")
    steps = [[(F.col("k") == 1, en.STOP), (F.col("k") == 2, F.lit("x"))], [(None, F.concat("product", F.lit("y")))]]
    got = {r.k: (r["product"], r.status, r.intermediates) for r in en.run_scheme(df, F.lit("s"), steps).collect()}
    assert got == {1: ("s", "OK", ["s"]), 2: ("xy", "OK", ["x", "xy"]), 3: (None, "FAIL", [])}


def test_a_later_stop_does_not_undo_an_earlier_rule(spark):
    df = spark.createDataFrame([(1,), (2,), (3,), (4,)], "k int")
    first = [(F.col("k") == 1, F.lit("x")), (F.col("k") == 2, en.STOP), (F.col("k") == 3, F.lit("z")), (None, en.STOP)]
    got = {r.k: (r["product"], r.status) for r in en.run_scheme(df, F.lit("s"), [first, [(None, F.concat("product", F.lit("y")))]]).collect()}
    assert got == {1: ("xy", "OK"), 2: ("s", "OK"), 3: ("zy", "OK"), 4: ("s", "OK")}


def test_lookup_keeps_rows_with_null_keys(spark):
    df = spark.createDataFrame([(1, None, "a"), (2, 5, None), (3, None, None), (4, None, "a")], "i int, k int, m string")
    got = sorted((r.i, r.v) for r in en.lookup_distinct(df, ["k", "m"], "v", F.concat_ws("-", F.col("k").cast("string"), "m")).collect())
    assert got == [(1, "a"), (2, "5"), (3, ""), (4, "a")]


@pytest.mark.parametrize("cutoff, n, m", [(0.56, 25, 14), (0.55, 20, 11), (0.28, 25, 7), (0.07, 100, 7), (0.57, 100, 57), (1 / 3, 9, 3), (1.0, 4, 4)])
def test_pairs_exactly_at_the_cutoff(spark, cutoff, n, m):
    rows = [(1, [f"e{k}" for k in range(n)]), (2, [f"e{k}" for k in range(n - m, n)]), (3, [f"e{k}" for k in range(n - m, n - 1)] or ["z"])]
    reps = spark.createDataFrame(rows, "class_id long, elements array<string>")
    got = {(r.a, r.b) for r in similarity.similarity_self_join(reps, cutoff).collect()}
    assert ((1, 2) in got) and ((1, 3) in got) == (jaccard(set(rows[0][1]), set(rows[2][1])) >= cutoff)


def test_transforms(spark):
    df = spark.createDataFrame([("C[C@H](O)N.Cl/C=C/C", "1")], "SMILES string, ID string")
    out = transform.standardize_columns(df, {"smiles": ["SMILES"], "bb_id": ["ID"]})
    assert out.columns == ["smiles", "bb_id"]
    r = out.select(transform.fragment_count(F.col("smiles")).alias("n"), transform.strip_stereo(F.col("smiles")).alias("s")).first()
    assert (r.n, r.s) == (2, "C[CH](O)N.ClC=CC")
    with pytest.raises(ValueError):
        transform.standardize_columns(df.selectExpr("*", "ID AS id_"), {"x": ["ID", "id_"]})


def test_numbers_samples_and_picks(spark):
    df = spark.range(1000).select((F.col("id") * 7 % 1000).alias("k"), F.lit("x").alias("number_")).repartition(7)
    assert sorted((r.k, r.number) for r in transform.number_rows(df, [F.col("k").desc()]).collect()) == [(k, 999 - k) for k in range(1000)]
    a, b = transform.sample_exactly(df, ["k"], 50, 3), transform.sample_exactly(df.repartition(2), ["k"], 50, 3)
    assert {r.k for r in a.collect()} == {r.k for r in b.collect()} and a.count() == 50 == b.distinct().count()
    assert transform.sample_exactly(df, ["k"], 5000).count() == 1000
    order = [r.k for r in df.orderBy(*transform.shuffled(df, ["k"], 1)).collect()]
    assert sorted(order) == list(range(1000)) != order and order != [r.k for r in df.orderBy(*transform.shuffled(df, ["k"], 2)).collect()]
    picks = transform.picks_with_replacement(df.where("k < 20"), ["k"], 400).collect()
    assert sorted(r.pick for r in picks) == list(range(400)) and len({r.k for r in picks}) == 20
    assert transform.picks_with_replacement(df.limit(0), ["k"], 4).count() == 0


def test_files_in_order(spark, tmp_path):
    (tmp_path / "c.csv").write_text("id;smiles\n" + "".join(f"{k};C{k}\n" for k in range(500)))
    assert [r.id for r in compounds.read_compounds(spark, f"file://{tmp_path}/c.csv", ";", limit=3).collect()] == ["0", "1", "2"]
    assert compounds.read_compounds(spark, f"file://{tmp_path}/c.csv", ";", columns=["smiles"]).count() == 500
    os.mkdir(tmp_path / "f")
    (tmp_path / "f" / "a.csv").write_text("id,smiles\n1,C\n2,\n")
    (tmp_path / "f" / "b.csv").write_text("smiles,more,id\nN,x,3\n")
    assert sorted(tuple(r) for r in compounds.read_folder(spark, f"file://{tmp_path}/f").collect()) == [("1", "C"), ("3", "N")]


def test_histogram_edges(spark):
    df = spark.createDataFrame([(0.0,), (4.9,), (5.0,), (45.0,), (45.1,), (-1.0,)], "v double")
    assert {r.bin: r.n for r in profile.histogram(df, F.col("v"), 0.0, 50.0, 11).collect()} == {0: 2, 1: 1, 8: 1}


def test_sdf_and_block_files(spark, tmp_path):
    sdf = "m1\n\n\nM  END\n> <id>\n7\n\n> <name>\na b\nc\n\n$$$$\nm2\nM  END\n>  <id>\n8\n> <x>\n1\n\n$$$$\nbroken\n$$$$\n"
    (tmp_path / "a.sdf").write_text(sdf)
    rows = compounds.read_sdf(spark, f"file://{tmp_path}/a.sdf").collect()
    assert [r.props for r in rows] == [{"id": "7", "name": "a b\nc"}, {"id": "8", "x": "1"}]
    assert compounds.properties(compounds.read_sdf(spark, f"file://{tmp_path}/a.sdf")).columns == ["record", "molblock", "id", "name", "x"]
    whole = "\n  prog\n\n  0  0  0     0  0            999 V2000\nM  END\n> <id>\n1\n\n$$$$\n"
    (tmp_path / "b.sdf").write_bytes((whole + sdf + whole).replace("\n", "\r\n").encode())
    rows = compounds.read_sdf(spark, f"file://{tmp_path}/b.sdf").collect()
    rows = sorted(rows, key=lambda r: r.record)
    assert [r.record for r in rows] == [0, 1, 2, 3] and compounds.read_sdf(spark, f"file://{tmp_path}/b.sdf", 2).count() == 2
    assert [r.props["id"] for r in rows] == ["1", "7", "8", "1"] and rows[1].props["name"] == "a b\nc"
    assert rows[0].molblock == rows[3].molblock == whole.split("\n> <id>")[0] and rows[1].molblock == "m1\n\n\nM  END"
    os.mkdir(tmp_path / "bb")
    (tmp_path / "bb" / "L.BB1.csv").write_text("id,smiles\n1,C\n1,CC\n2,N\n")
    (tmp_path / "bb" / "L.BB12.csv").write_text("id,smiles\n9,O\n")
    (tmp_path / "bb" / "M.BB1.csv").write_text("id,smiles\n5,F\n")
    got = sorted(tuple(r) for r in compounds.read_blocks(spark, f"file://{tmp_path}/bb", "L").collect())
    assert got == [("BB1", "1", "C"), ("BB1", "2", "N"), ("BB12", "9", "O")]


def test_schemes():
    steps, reactants = schemes.load_scheme('{"L": {"steps": [{"Reactants": ["r0", "None"], "Rxns": {"c": "x", "default": ["y", "z"]}}]}}', "L")
    assert steps == [(["r0", "None"], {"c": ["x"], "default": ["y", "z"]})] and reactants is None
    assert schemes.named_reactions({"a": "x"}, {"a": ["y"]}) == {"a": ["y"]}
    assert schemes.load_reaction_table('[t.s]\nsmarts = "[N:1]"') == [("t", "s", "[N:1]")]
    assert schemes.parameters({"n": None, "m": 2}, {"n": 5}, {"n": 1, "k": 3}) == {"n": 5, "k": 3, "m": 2}


def test_stream(spark, tmp_path):
    from molloom.streaming import rows as stream

    os.mkdir(tmp_path / "in")
    (tmp_path / "in" / "a.csv").write_text("id,m\n1,500\n2,100\n")
    q = stream.run(spark, f"file://{tmp_path}/in", "id long, m double", lambda d: d.where(filters.first_failure({"MW_high": 400}, {"mw": "m"}).isNull()), f"file://{tmp_path}/out", f"file://{tmp_path}/cp")
    q.awaitTermination()
    assert [r.id for r in spark.read.parquet(f"file://{tmp_path}/out").collect()] == [2]


def test_named_lists_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("1", "acid amine"), ("2", "amine"), ("2", "amide"), ("3", None), ("4", "acid salt")], "bb_id string, smiles string")
    specs = {"acids": {"include": ["acid"], "exclude": ["salt"]}, "amines": {"include": [["amine", "amide"]]}}
    lists = filters.named_lists(df, "smiles", specs, {"acids": ["L.BB1", "L.BB3"], "amines": "L.BB2"})
    compounds.export_lists(lists, f"file://{tmp_path}/lists")
    back = spark.read.option("header", True).csv(f"file://{tmp_path}/lists")
    assert sorted((r.list, r.bb_id, r.smiles) for r in back.collect()) == [("L.BB1", "1", "acid amine"), ("L.BB2", "1", "acid amine"), ("L.BB2", "2", "amide"), ("L.BB3", "1", "acid amine")]
    scheme = {"filters": {"BB2": 5, "names": {"acids": "BB1", "more": ["BB3", "BB4"]}, "BB_filters": {"acids": 7, "more": 8}}}
    assert [filters.criteria_of(scheme, c) for c in ("BB1", "BB2", "BB4", "BB9")] == [7, 5, 8, None] and filters.criteria_of({}, "BB1") is None


def test_sinks_and_lists(spark, tmp_path):
    df = spark.createDataFrame([("1", "C"), ("2", "N")], "bb_id string, smiles string")
    for part in (df.limit(1), df.subtract(df.limit(1))):
        compounds.append_csv(part.coalesce(1), f"file://{tmp_path}/out")
    assert sorted(tuple(r) for r in spark.read.option("header", True).csv(f"file://{tmp_path}/out").collect()) == [("1", "C"), ("2", "N")]
    compounds.write_split(df, f"file://{tmp_path}/split", F.when(F.col("bb_id") == "1", "pass").otherwise("fail"))
    assert {r.status: str(r.bb_id) for r in spark.read.option("header", True).csv(f"file://{tmp_path}/split").collect()} == {"pass": "1", "fail": "2"}
    (tmp_path / "f.csv").write_text("SMILES\n[Br]\nC#N\n[Br]\n")
    assert compounds.read_patterns(spark, f"file://{tmp_path}/f.csv") == ["[Br]", "C#N"]
    got = en.constant_side(df, 1, ["CN", None, None]).where("bb_id = '2'").first()
    assert (got.r0, got.r1, got.r2) == ("CN", "2", None)


def test_scheme_dialect_and_parameters():
    text = """
[reactions.a]
reactants = ["bb1", "bb2"]
reactions = ["amide"]
amide = "x>>y"
[reactions.b]
reactants = ["product"]
reactions = ["amide", "known"]
amide = "z>>w"
"""
    got = schemes.import_scheme("L", text)
    assert got["Named_Reactions"] == {"amide": "x>>y", "amide_1": "z>>w"}
    assert got["L"]["steps"] == [{"Reactants": ["r0", "r1"], "Rxns": {"default": ["amide"]}}, {"Reactants": ["p", "None"], "Rxns": {"default": ["amide_1", "known"]}}]
    assert schemes.parameter_file("scheme: L  # name\nnumstrux: 50\nremovedups: False\nspec:\nname: 'a b'\n") == {"scheme": "L", "numstrux": 50, "removedups": False, "spec": None, "name": "a b"}


def test_top_k_without_excluded(spark):
    df = spark.createDataFrame([(1, k, 1.0 - k / 10, f"x{k}") for k in range(6)], "q int, row int, score double, more string")
    got = [(r.row, r.rank, r.more) for r in similarity.top_k_but(df, df.where("row < 2"), "q", "score", "row", 2).orderBy("rank").collect()]
    assert got == [(2, 1, "x2"), (3, 2, "x3")]
