import random
from collections import Counter

from molloom.llm import line_chunks as lc

from .data import CASES, frame


def planted(seed=1):
    r = random.Random(seed)
    line = lambda: " ".join(r.choice(["lorem", "ipsum", "dolor", "sit", "é"]) for _ in range(r.randint(1, 6)))
    block = [line() + f" {k}" for k in range(12)]
    texts = [*CASES, "\n\n\n", "a\nb\n", "a\nb", "\n".join(block), "\n".join(block) + "\n"]
    for k in range(60):
        texts.append("\n".join([line() + str(r.random()) for _ in range(r.randint(0, 4))] + block[r.randint(0, 4) :] + [line() for _ in range(r.randint(0, 4))]))
    return texts


def test_equals_brute_force(spark):
    texts = planted()
    want = lc.brute_force(list(enumerate(texts)))
    got = {r.doc_id: (r.text, r.n_removed_lines) for r in lc.dedup(frame(spark, texts).selectExpr("*", "'x' AS N_LINES", "'y' AS places")).collect()}
    assert got == want
    assert sum(n for _, n in want.values()) > 200


def test_boundaries_resist_shifts():
    lines = [f"line {k}" for k in range(400)]
    a = {x for n, x in lc.chunks("\n".join(lines).encode()) if n > lc.WINDOW}
    b = {x for n, x in lc.chunks("\n".join(lines[:50] + ["new"] + lines[50:]).encode()) if n > lc.WINDOW}
    assert len(a) > 40 and len(a - b) <= 2 and max(x.count(b"\n") for x in a) < 40


def test_a_shared_hash_is_not_a_copy(spark):
    """With hashes of 3 bits nearly all chunks share one; a window is then compared with one occurrence alone."""
    texts = planted(4)
    exact = {r.doc_id: r.text for r in lc.dedup(frame(spark, texts)).collect()}
    got = {r.doc_id: (r.text, r.n_lines) for r in lc.dedup(frame(spark, texts), bits=3).collect()}
    for d, (text, n) in got.items():
        left, full = (Counter(lc.lines_of((x or "").encode())) for x in (text, exact[d]))
        # what goes is a copy: nothing is cut that the full hashes would keep
        assert full <= left and n == len(lc.lines_of((texts[d] or "").encode()))


def test_clashing_chunks_leave_their_windows(spark):
    """Two long chunks with one hash and other bytes: the windows within them are still compared."""
    passage = [f"p {k}" for k in range(40)]
    other = [f"q {k}" for k in range(40)]
    texts = ["\n".join(x) for x in (passage, other, passage, other)]
    for bits in (5, 8, 64):
        got = {r.doc_id: r.n_removed_lines for r in lc.dedup(frame(spark, texts), bits=bits).collect()}
        assert got[0] == 0 and (bits < 64 or got == {0: 0, 1: 0, 2: 40, 3: 40})


def test_rows_of_one_id_keep_what_is_their_own(spark):
    rows = [(1, "a\nb\n"), (2, "x\ny\na\nb\n"), (2, "p\nq\nr\ns\n"), (3, "u\nv\nw\n"), (3, "u\nv\nz\n"), (3, "u\nv\nw\n")]
    got = sorted(r.text for r in lc.dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect())
    assert got.count("a\nb\n") == 1 and "x\ny\n" in got and "p\nq\nr\ns\n" in got
    # of the two texts of id 3 one keeps the shared lines, whichever comes first by its hash
    assert sorted(got[got.index("p\nq\nr\ns\n") + 1 :]) in (sorted(["u\nv\nw\n", "u\nv\nw\n", "x\ny\n", "z\n"]), sorted(["u\nv\nz\n", "w\n", "w\n", "x\ny\n"]))


def test_repeated_rows_nulls_and_empty_tables(spark):
    text = "\n".join(f"line {k}" for k in range(9))
    df = spark.createDataFrame([(1, text), (1, text), (2, text), (None, text)], "doc_id long, text string")
    got = sorted(((r.doc_id or 0, r.n_removed_lines) for r in lc.dedup(df).collect()))
    assert got[:3] == [(0, 0), (1, 0), (1, 0)] and got[3][1] > 0
    assert lc.dedup(df.limit(0)).count() == 0


def test_no_repeated_passage_stays(spark):
    """Passages of two to nine lines at random places, against sets of neighbouring lines."""
    r = random.Random(8)
    passages = [[f"passage {k} {j} {r.random()}" for j in range(n)] for k, n in enumerate([2] * 20 + [3] * 10 + [4, 5, 6, 7, 8, 9])]
    docs = []
    for d in range(120):
        lines = [f"own {d} {j}" for j in range(r.randint(0, 3))]
        for p in r.sample(passages, 2):
            lines += [*p, f"between {d} {r.random()}"]
        docs.append(lines)
    docs.append(["same"] * 7)
    earlier, want = set(), {}
    for d, lines in enumerate(docs):
        hit = [k for k in range(len(lines) - 1) if (lines[k], lines[k + 1]) in earlier]
        gone = {k for h in hit for k in (h, h + 1)}
        want[d] = [x for k, x in enumerate(lines) if k not in gone]
        earlier |= set(zip(lines, lines[1:]))
    want[len(docs) - 1] = ["same"] * 2
    got = {x.doc_id: [y for y in x.text.split("\n") if y] for x in lc.dedup(frame(spark, ["\n".join(x) for x in docs])).collect()}
    assert got == want
    assert {x for lines in got.values() for x in lines} == {x for lines in docs for x in lines}
