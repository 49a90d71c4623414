import itertools
import json
import re

import pytest

from molloom.plans import enumeration as pl
from molloom.sources import schemes

SCHEMES = {
    "lib": {
        "reactants": ["acid", "amine", "cap"],
        "steps": [
            {"Reactants": ["CN", "r0"], "Rxns": {"default": "^CN\\.(.*)O$>>$1N"}},
            {"Reactants": ["p", "amine"], "Rxns": {"NOSMILES": "product", "C": ["methyl", "^(.*)\\.(.*)$>>$1!$2"], "^X": "terminate", "[0-9]": ["none>>x", "join"], "default": "digit"}},
            {"Reactants": ["p", "cap"], "Rxns": {"^s": "product", "default": ["aa>>b", "^(.*)\\.(.+)$>>$1=$2"]}},
            {"Reactants": ["p", "None"], "Rxns": {"!": "bang", "product": "product"}},
        ],
    },
    "strict": {"steps": [{"Reactants": ["r0", "r1"], "Rxns": {"zzz": "a>>b"}}]},
    "Named_Reactions": {"methyl": "^(.*N)\\.C$>>$1C", "join": ["^(.*)\\.([0-9]+)$>>$1-$2", "never>>x"], "digit": "^(.*)\\.q(.*)$>>$1~$2", "bang": "!>>?"},
}


def run(row, scheme, named):
    """The walk over steps for one row: (product, count, status, intermediates)."""
    p, count, made = row[0], 1, []
    steps, names = scheme
    for slots, rules in steps:
        def fill(s):
            if s in ("None", "NOSMILES", "SKIPCYC"):
                return "None"
            if s == "p":
                return p
            if names and s in names:
                return row[names.index(s)]
            return row[int(s[1:])] if re.fullmatch("r[0-9]+", s) else s

        a, b = (fill(s) for s in slots)
        choice = None
        for key in rules:
            if key == "default":
                continue
            if key == "product":
                choice = ["product"]
                break
            if key in ("NOSMILES", "SKIPCYC"):
                if key in (a, b):
                    choice = rules[key]
                    break
                continue
            tested = a if b == "None" else b
            if key == "C" and "C" in (a, b) or tested is not None and re.search(key, tested):
                choice = rules[key]
                break
        choice = choice or rules.get("default")
        if choice == ["terminate"]:
            break
        if choice == ["product"]:
            continue
        both = a if b is None or b in ("None", "NOSMILES", "SKIPCYC") else ".".join(x for x in (a, b) if x is not None)
        for rule in [r for x in choice or [] for r in named.get(x, [x])]:
            pattern, _, new = rule.partition(">>")
            if both is not None and re.search(pattern, both):
                count *= len(re.findall(pattern, both))
                p = re.sub(pattern, lambda m: re.sub(r"\$([0-9])", lambda g: m[int(g[1])], new), both)
                made.append(p)
                break
        else:
            return "FAIL", count, "FAIL", made
    return p, count, "OK", made


ACIDS, AMINES, CAPS = ["aO", "aaO", "b", "!O"], ["C", "X1", "17", "q2", "zz", "NOSMILES", "4C"], ["s1", "t", "u!v!", "aa"]


@pytest.mark.parametrize("n", [-1, 40])
def test_scheme_over_blocks(spark, n):
    lists = {"BB1": ACIDS, "BB2": AMINES, "BB3": CAPS}
    blocks = spark.createDataFrame([(c, f"{c}-{k}", s) for c, v in lists.items() for k, s in enumerate(v)], "cycle string, bb_id string, smiles string")
    text = json.dumps(SCHEMES)
    scheme, named = schemes.load_scheme(text, "lib"), schemes.named_reactions(schemes.load_named(text))
    out = pl.enumerate_blocks(blocks, list(lists), scheme, named, n).collect()
    seen = set()
    for r in out:
        row = (r.bb1_smiles, r.bb2_smiles, r.bb3_smiles)
        product, count, status, made = run(row, scheme, named)
        if status == "OK" and count > 1:
            product, status = pl.MULTIPLE, "FAIL"
        assert (r.full_smiles, r.prod_ct, r.status, r.intermediates) == (product, count, status, made), row
        seen.add((r.bb1, r.bb2, r.bb3))
    assert len(seen) == len(out) == (112 if n < 0 else 40)
    assert {r.status for r in out} == {"OK", "FAIL"} and (n > 0 or any(r.full_smiles == pl.MULTIPLE for r in out))


def test_rows_without_a_rule_fail(spark):
    df = spark.createDataFrame([("a", "zzz"), ("q", "b"), (None, "zzz"), ("a", None)], "x string, y string")
    out = pl.run_steps(df, schemes.load_scheme(json.dumps(SCHEMES), "strict"), ["x", "y"])
    assert [(r.product, r.status) for r in out.collect()] == [("b.zzz", "OK"), ("FAIL", "FAIL"), ("FAIL", "FAIL"), ("FAIL", "FAIL")]


def test_from_files(spark, tmp_path):
    (tmp_path / "lib.BB1.csv").write_text("BB_ID,SMILES\n" + "".join(f"a{k},{s}\n" for k, s in enumerate(ACIDS)))
    (tmp_path / "lib.BB2.csv").write_text("SMILES,BB_ID\n" + "".join(f"{s},b{k}\n" for k, s in enumerate(AMINES)))
    (tmp_path / "lib.BB3.csv").write_text("id,smiles\nc0,t\nc1,t\n")
    (tmp_path / "s.json").write_text(json.dumps(SCHEMES))
    out = pl.enumerate_files(spark, str(tmp_path), "lib", str(tmp_path / "s.json"), path=str(tmp_path / "out"), once=True)
    rows = out.collect()
    good = [r for r in rows if r.status == "OK"]
    assert len({r.full_smiles for r in good}) == len(good) and {r.bb3 for r in good} == {"c0"}
    assert len([r for r in rows if r.status == "FAIL"]) % 2 == 0
    back = spark.read.option("header", True).csv(str(tmp_path / "out"))
    assert back.count() == len(rows) and {r[0] for r in back.select("status").distinct().collect()} == {"OK", "FAIL"}
    some = spark.createDataFrame([("BB1", "a0"), ("BB2", "b2"), ("BB3", "c1"), ("BB3", "missing")], "cycle string, bb_id string")
    picked = pl.enumerate_files(spark, str(tmp_path), "lib", str(tmp_path / "s.json"), picks=some).collect()
    assert sorted((r.bb1, r.bb2, r.bb3, r.status) for r in picked) == [("a0", "b2", "c1", "OK"), ("a0", "b2", "missing", "FAIL")]


def test_schemes_are_written_back(tmp_path):
    path = tmp_path / "s.json"
    path.write_text(json.dumps(SCHEMES))
    new = {"steps": [{"Reactants": ["r0", "None"], "Rxns": {"default": "a>>b"}}]}
    schemes.save_scheme(str(path), "new", new, str(path))
    again = json.loads(path.read_text())
    assert again == {**SCHEMES, "new": new} and list(itertools.islice(tmp_path.iterdir(), 5)) == [path]
    with pytest.raises(ValueError):
        schemes.save_scheme(str(path), "bad", {"steps": [{"Reactants": [], "Rxns": {}}]}, str(path))
    assert json.loads(path.read_text()) == again


def test_notes_in_parameter_files():
    text = "a: 1\nb: x#y\nc: \"q # r\" # note\n# n: 3\nd: true # t\ne:\nf: # only"
    assert schemes.parameter_file(text) == {"a": 1, "b": "x#y", "c": "q # r", "d": True, "e": None, "f": None}
