"""The whole pipeline on a small folder, against the brute-force versions of its stages."""

import random

import pytest

from molloom.llm import line_chunks, near_copies

from .test_models import text
from .test_pairs import brute, roots

corpus_pipeline = pytest.importorskip("corpus_pipeline")


def made_docs():
    r = random.Random(4)
    rows = []
    for i in range(90):
        lang = ("en", "fr", "de")[i % 3]
        rows.append((i, "\n".join(text(r, lang, r.randint(8, 30)) for _ in range(r.randint(2, 8))), lang))
    rows += [(100 + k, rows[3][1], "en") for k in range(4)]  # copies
    rows += [(110 + k, rows[6][1] + "\n" + rows[7][1] + f"\nlast {k}", "en") for k in range(4)]  # shared lines
    rows += [(120, None, "en"), (121, "", None), (122, "!!! 123", "en"), (123, "the", None)]
    items = [(k, text(r, "en", 30)) for k in range(4)]
    rows += [(130 + k, text(r, "en", 40) + "\n" + items[k][1].upper(), "en") for k in range(4)]
    return [(i, t, lang, "s", len(t or "")) for i, t, lang in rows], items


def test_stages(spark, tmp_path):
    rows, items = made_docs()
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    sf = f"file://{tmp_path}"
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
    docs.write.parquet(f"{sf}/documents.parquet")

    kept = [(r.doc_id, r.text) for r in corpus_pipeline.STAGES[0][1](spark, docs, sf).collect()]
    assert {d for d, _ in kept} == {i for i, t, *_ in rows if any(c.isalpha() for c in t or "")}

    lines = line_chunks.brute_force(kept)
    kept = [(d, lines[d][0]) for d, _ in kept if not lines[d][1] or lines[d][0].strip(" ")]

    sets = {d: near_copies.shingles(t) for d, t in kept}
    root = roots([(a, b) for a in sets for b in sets if a <= b and (sets[a] == sets[b] or near_copies.similar(sets[a], sets[b]))])
    kept = [(d, t) for d, t in kept if root[d] == d]

    found = brute(kept, items)
    kept = {d: t for d, t in kept if not (found[d][1] and 20 * found[d][1] >= found[d][0])}

    out = {r.doc_id: r for r in corpus_pipeline.run(spark, sf).collect()}
    assert set(out) == set(kept) and all(r.round_trip and r.n_tokens > 2 for r in out.values())
    assert set(range(90)) & set(out) and not {101, 102, 103, 120, 121, 122, 130, 131, 132, 133} & set(out)


def test_line_dedup_tells_texts_of_one_id_apart(spark):
    rows = [(1, "a\nb\n"), (2, "x\ny\na\nb\n"), (2, "p\nq\nr\ns\n"), (3, "a\nb\n")]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    out = corpus_pipeline.STAGES[1][1](spark, docs, "").collect()
    assert sorted((r.doc_id, r.text, r.n_chars) for r in out) == [(1, "a\nb\n", 4), (2, "p\nq\nr\ns\n", 8), (2, "x\ny\n", 4)]


def test_empty_table(spark, tmp_path):
    rows, items = made_docs()
    sf = f"file://{tmp_path}"
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").limit(0).write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
    assert corpus_pipeline.run(spark, sf).count() == 0


def test_stages_keep_columns_of_any_name(spark, tmp_path):
    """Extra columns named like the operators' own keep their values through every stage but the last."""
    rows, items = made_docs()
    sf = f"file://{tmp_path}"
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
    names = ["SCORE", "lang_pred", "N_lines", "n_removed_lines", "node", "bands", "component_id", "k1", "k2", "w", "n_words", "start", "fp"]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").selectExpr("*", *(f"concat('{n}', doc_id) AS {n}" for n in names))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns
        got = out.collect()
        assert got and all(r[n] == f"{n}{r.doc_id}" for r in got for n in names)
    assert corpus_pipeline.STAGES[-1][1](spark, docs, sf).count() == len(rows)
