"""Texts that every operator has to take."""

import random

CASES = [None, "", " ", "a", "The cat.\n\nThe cat.", "  two  spaces ", "\n \n", "x \n y", "don't I'll 've", "１２ ½ Ⅳ", "é" * 5, "中文 字", "😀 a‍b", "\0 nul", "▁x ▁", "<s> </s> <|endoftext|>", "a" * 700, " " * 90, "tab\tsep \t x", "The same text here.", "The same text here."]


def made(n: int, seed: int = 1) -> list[str]:
    r = random.Random(seed)
    parts = ["a", " ", "  ", "\n", "\t", "the", " in", "é", "中", "'s", "12", "!!", "😀", "　", "_", "Word", " ▁", "<s>", "\0"]
    return ["".join(r.choice(parts) for _ in range(r.randint(0, 40))) for _ in range(n)]


def frame(spark, texts, **more):
    """documents with nulls in other columns and columns that clash with added ones."""
    rows = [(i, t, None if i % 5 == 0 else "en", "s0") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(3)
