import hashlib
import random

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from molloom.llm import chat_trees as ct

from .data import CASES, made

HARD = ["</s>", "<s>user[INST] a [/INST]</s>", "\\", "\\\\<s>", "<\\s>", "[\\INST]", "<", "/s>", "[/INST", "a\\nb", "x<\n", " ", *[c for c in CASES if c is not None]]


def test_escapes_are_reversible(spark):
    texts = HARD + made(100, 3) + ["".join(random.Random(k).choices(["\\", "<", "s>", "/", "[", "INST]", "]", " ", "\n"], k=30)) for k in range(300)]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", ct.escaped(F.col("t")).alias("e"), ct.unescaped(ct.escaped(F.col("t"))).alias("u"))
    for r in df.collect():
        assert r.u == texts[r.i] and not any(m in r.e for m in ct.MARKS)


def test_turns_read_back(spark):
    r = random.Random(2)
    convs = [[(r.choice(["assistant", "user", "", "assistant\n", "a\nb", *HARD]), r.choice(HARD)) for _ in range(r.randint(1, 6))] for _ in range(150)]
    rows = [(i, k, role, text) for i, c in enumerate(convs) for k, (role, text) in enumerate(c)]
    messages = ct.threads(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3))
    out = ct.formatted(messages).join(messages.select("id", "conv_id"), F.col("leaf") == F.col("id"))
    for x in out.select("conv_id", "segments", ct.read_turns(ct.whole(F.col("segments"))).alias("turns"), ct.under_loss(F.col("segments")).alias("loss")).collect():
        want = convs[x.conv_id]
        assert [(t.role, t.text) for t in x.turns] == want
        assert x.loss == "".join(t for role, t in want if role == "assistant")
        assert "".join(s.text for s in x.segments).count("</s>") == len(want)


def tree(seed, n):
    r = random.Random(seed)
    return [(k, r.choice([None, 10_000, *range(k)]) if k else None, r.choice([None, 1.0, 2.0, 0.5])) for k in range(n)]


@pytest.mark.parametrize("best", [None, 2])
def test_paths(spark, best):
    rows = tree(1, 80) + [(100 + k, 99 + k if k else None, 1.0) for k in range(70)] + [(300, 301, 1.0), (301, 302, 1.0), (302, 300, 1.0), (303, 302, 9.0), (304, 304, 1.0)]
    up = {i: p for i, p, _ in rows}
    score = {i: s or 0.0 for i, _, s in rows}
    want, trees = {}, {}
    for leaf in set(up) - set(up.values()):
        path, at = [], leaf
        while at in up and at not in path:
            path.append(at)
            at = up[at]
        if at not in path:
            want[leaf] = path
            trees.setdefault(path[-1], []).append((-sum(score[i] for i in path), leaf))
    if best:
        want = {leaf: want[leaf] for t in trees.values() for _, leaf in sorted(t)[:best]}
    got = {}
    for r in ct.reply_paths(spark.createDataFrame(rows, "id long, parent long, score double").repartition(3), best).collect():
        got.setdefault(r.leaf, {})[r.up] = r.id
    assert {k: [v[u] for u in range(len(v))] for k, v in got.items()} == want


def test_query(spark, tmp_path):
    rows = [(1, 0, "user", "q"), (1, 1, "assistant", "é<s>中\\"), (2, None, None, None), (2, 3, "assistant", None), (2, 3, "assistant", "tie"), (None, 1, "system", "x"), (None, 0, "user", "[INST]"), *[(3, t, ["user", "assistant"][t % 2], f"t{t}" * 50) for t in range(300)], (4, 0, "assistant", "y" * 200_000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("segments", F.lit(1))
    df.write.parquet(str(tmp_path / "conversations.parquet"))
    got = {r.conv_id: r.asDict() for r in ct.op13_chat_trees(spark, str(tmp_path)).collect()}
    c = duckdb.connect()
    c.register("conversations", pd.DataFrame(rows, columns=["conv_id", "turn", "role", "text"]).astype({"conv_id": "Int64", "turn": "Int64"}))
    want = c.sql(ct.OP13_SQL)
    assert got == {r[0]: dict(zip(want.columns, r)) for r in want.fetchall()}
    assert got[-7]["loss_sha256"] == hashlib.sha256(b"</s>[INST] ok [/INST]").hexdigest() and got[3]["n_turns"] == 300


def test_no_rows(spark):
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert ct.formatted(ct.threads(empty)).count() == 0
