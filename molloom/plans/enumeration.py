"""From block lists and a scheme in JSON to products, as one plan.

A reaction is a text rule `pattern>>replacement` over the reactants, joined by a dot: the first rule of a list whose regular
expression is found makes the product, with its groups as $1, $2, ...; as many places as match count as products. A condition is a
regular expression on the second reactant, or on the first where there is no second. Every step becomes a few columns, so a scheme
over any number of rows is one projection.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from molloom.operators import enumerate as en
from molloom.sources import compounds, schemes

# Fixed values of the scheme format: marks of a missing reactant, and of what a step does instead of a reaction.
NONE, MISSING = "None", ["None", "NOSMILES", "SKIPCYC"]
SKIP, END, DEFAULT, FAIL = "product", "terminate", "default", "FAIL"
MULTIPLE = "FAIL--MULTIPLE PRODUCTS"


def let(value: Column, body) -> Column:
    """body of a value that is computed once. As columns of their own, steps would be copied into each other by every filter behind them."""
    return F.element_at(F.transform(F.array(value), body), 1)


def slot(name: str, product: Column, named: list[str] | None, reactants: list[str]) -> Column:
    """What stands in a step's place: nothing, the product before, a named or numbered reactant, or a structure itself."""
    if name in MISSING:
        return F.lit(NONE)
    if name == "p":
        return product
    if named and name in named:
        return F.col(reactants[named.index(name)])
    if re.fullmatch(r"r[0-9]+", name):
        return F.col(reactants[int(name[1:])])
    return F.lit(name)


def condition(key: str, a: Column, b: Column) -> Column:
    """Whether a step's reactions of a key are the ones."""
    if key == SKIP:
        return F.lit(True)
    if key in ("NOSMILES", "SKIPCYC"):
        return (a == key) | (b == key)
    tested = F.when(b == NONE, a).otherwise(b)
    found = tested.rlike(key)
    return (a == "C") | (b == "C") | found if key in ("C", "[C;H4]") else found


def reacted(rules: list[str], a: Column, b: Column) -> tuple[Column, Column]:
    """(product, number of products) of the first rule that applies; null and 0 if none does."""
    both = F.when(b.isNull() | b.isin(MISSING), a).otherwise(F.concat_ws(".", a, b))
    product, n = F.lit(None).cast("string"), F.lit(0)
    for rule in reversed(rules):
        pattern, arrow, new = rule.partition(">>")
        if not arrow:
            raise ValueError(f"no reaction: {rule}")
        applies = both.rlike(pattern)
        product = F.when(applies, F.regexp_replace(both, pattern, new)).otherwise(product)
        n = F.when(applies, F.regexp_count(both, F.lit(pattern))).otherwise(n)
    return product, n


def run_steps(df: DataFrame, scheme: tuple[list, list | None], reactants: list[str], named: dict[str, list[str]] | None = None) -> DataFrame:
    """df with product, prod_ct, status (OK or FAIL) and intermediates. scheme: as of load_scheme(); reactants: columns of r0, r1, ...

    A step takes the first key whose condition holds, else `default`, else the row fails. Reactions named in `named` are
    replaced by theirs. `terminate` ends a row with the product so far, `product` leaves a step out; a row without a
    product fails from then on with product FAIL.
    """
    steps, names = scheme
    state = F.struct(F.col(reactants[0]).alias("product"), F.lit(1).cast("long").alias("prod_ct"), F.lit("going").alias("status"), F.array().cast("array<string>").alias("intermediates"))
    for slots, rules in steps:
        state = let(state, _step([*slots, NONE][:2], rules, names, reactants, named or {}))
    out = df.withColumn("__state", state).select("*", *(F.col("__state")[c].alias(c) for c in ("product", "prod_ct", "status", "intermediates"))).drop("__state")
    return out.withColumn("status", F.when(F.col("status") == FAIL, FAIL).otherwise("OK"))


def _step(slots: list[str], rules: dict[str, list[str]], names: list[str] | None, reactants: list[str], named: dict[str, list[str]]):
    """A function of the state before a step to the state behind it."""
    keys = [k for k in rules if k != DEFAULT]
    groups = [rules[k] if k != SKIP else [SKIP] for k in keys] + ([rules[DEFAULT]] if DEFAULT in rules else [])

    def choose(a: Column, b: Column) -> Column:
        chosen = F.lit(len(keys)) if DEFAULT in rules else F.lit(-1)
        for j in reversed(range(len(keys))):
            chosen = F.when(F.coalesce(condition(keys[j], a, b), F.lit(False)), F.lit(j)).otherwise(chosen)
        return chosen

    def react(j: Column, a: Column, b: Column) -> Column:
        """(kind, made, n) of the chosen group."""
        outcome = lambda kind, made, n: F.struct(F.lit(kind).alias("kind"), made.cast("string").alias("made"), n.cast("long").alias("n"))
        out = outcome("react", F.lit(None), F.lit(0))
        for k, group in enumerate(groups):
            if group in ([SKIP], [END]):
                one = outcome(group[0], F.lit(None), F.lit(0))
            else:
                one = outcome("react", *reacted([r for rule in group for r in named.get(rule, [rule])], a, b))
            out = F.when(j == k, one).otherwise(out)
        return out

    def behind(s: Column, r: Column) -> Column:
        reacts = r["kind"] == "react"
        fails = reacts & r["made"].isNull()
        new = F.struct(
            F.when(fails, FAIL).when(reacts, r["made"]).otherwise(s["product"]).alias("product"),
            F.when(reacts & (r["n"] > 0), s["prod_ct"] * r["n"]).otherwise(s["prod_ct"]).alias("prod_ct"),
            F.when(fails, FAIL).when(r["kind"] == END, "OK").otherwise(s["status"]).alias("status"),
            F.when(reacts & ~fails, F.concat(s["intermediates"], F.array(r["made"]))).otherwise(s["intermediates"]).alias("intermediates"),
        )
        return F.when(s["status"] == "going", new).otherwise(s)

    def step(s: Column) -> Column:
        pair = F.struct(*(slot(x, s["product"], names, reactants).alias(k) for k, x in zip("ab", slots)))
        return let(pair, lambda t: let(choose(t["a"], t["b"]), lambda j: let(react(j, t["a"], t["b"]), lambda r: behind(s, r))))

    return step


def enumerate_blocks(blocks: DataFrame, cycles: list[str], scheme: tuple[list, list | None], named: dict[str, list[str]] | None = None, n: int = -1, seed: int = 0, picks: DataFrame | None = None, once: bool = False) -> DataFrame:
    """blocks (cycle, bb_id, smiles): (bb1, bb1_smiles, ..., full_smiles, prod_ct, status, intermediates) of all products, or of n
    drawn ones if that is fewer. Rows with several products fail. picks (cycle, bb_id): blocks to take, in their place
    those without a structure too. once: of rows with one product the first by their blocks."""
    if picks is not None:
        wanted = picks.select("cycle", "bb_id").distinct()
        blocks = wanted.join(blocks, ["cycle", "bb_id"], "left")
    lists = [blocks.where(F.col("cycle") == c).select(F.col("bb_id").alias(f"bb{k}"), F.col("smiles").alias(f"bb{k}_smiles")) for k, c in enumerate(cycles, 1)]
    if 0 <= n < reduce(lambda x, y: x * y, en.cycle_sizes(blocks, cycles)):
        rows = en.sample_product(en.positions(blocks), cycles, n, seed)
        for k, one in enumerate(lists, 1):
            rows = rows.join(one, F.col(f"bb_{k}") == F.col(f"bb{k}")).drop(f"bb_{k}")
        rows = rows.drop("sample_id")
    else:
        rows = en.full_product(lists)
    of = [f"bb{k}_smiles" for k in range(1, len(cycles) + 1)]
    out = run_steps(rows, scheme, of, named)
    several = (F.col("status") == "OK") & (F.col("prod_ct") > 1)
    out = out.withColumn("full_smiles", F.when(several, MULTIPLE).otherwise(F.col("product"))).withColumn("status", F.when(several, FAIL).otherwise(F.col("status")))
    ids = [f"bb{k}" for k in range(1, len(cycles) + 1)]
    out = out.select(*(c for k in range(1, len(cycles) + 1) for c in (f"bb{k}", f"bb{k}_smiles")), "full_smiles", "prod_ct", "status", "intermediates")
    if once:
        # failed rows have no product of their own and stay
        best = out.where("status = 'OK'").groupBy("full_smiles").agg(F.min_by(F.struct(*out.columns), F.struct(*ids)).alias("r")).select("r.*")
        out = best.unionByName(out.where(f"status = '{FAIL}'"))
    return out


def enumerate_files(spark: SparkSession, folder: str, library: str, schemes_file: str, cycles: list[str] | None = None, name: str | None = None, spec: str | None = None, path: str | None = None, more_named: dict | None = None, **options) -> DataFrame:
    """Products of a library's block files <library>[.<spec>].BB<n>.csv by a scheme of a JSON file (by default named as the
    library). path: where they are written too, split by status. options: as of enumerate_blocks(), and read_blocks()' ids and smiles."""
    names = {k: options.pop(k) for k in ("ids", "smiles") if k in options}
    blocks = compounds.read_blocks(spark, folder, library, spec, **names)
    cycles = cycles or sorted((r[0] for r in blocks.select("cycle").distinct().collect()), key=lambda c: int(c[2:]))
    scheme, named = schemes.load_scheme(schemes_file, name or library), schemes.load_named(schemes_file)
    out = enumerate_blocks(blocks, cycles, scheme, schemes.named_reactions(named, more_named or {}), **options)
    if path is not None:
        flat = out.withColumn("intermediates", F.array_join("intermediates", ">"))
        compounds.write_split(flat, path, F.col("status"))
    return out
