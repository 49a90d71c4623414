import random

import pytest

from molloom.operators import selection


def walk(rows, links, cap, max_sim, max_scaff, n_chosen, limit):
    """One row after the other: {row: (reason, group)}."""
    kind = {}
    for a, b, k in links:
        kind.setdefault(frozenset((a, b)), set()).add(k)
    chosen, used, groups, out, ended = [], {}, 0, {}, False
    for row, rank, blocks, failed in sorted(rows, key=lambda r: (r[1], r[0])):
        ended = ended or (limit is not None and rank > limit)
        if ended:
            out[row] = ("Unknown", -1)
            continue
        if failed:
            out[row] = ("failed", None)
            continue
        if cap is not None and any(used.get(b, 0) >= cap for b in blocks or ()):
            out[row] = ("bbusage", -1)
            continue
        group, reason, n_sim, n_scaff = -1, "OK", 0, 0
        for other, own in chosen:
            k = kind.get(frozenset((row, other)), set())
            if k & {"sim", "hard"}:
                n_sim, group = n_sim + 1, own
                if n_sim >= max_sim or "hard" in k:
                    reason = "sim"
            elif k:
                n_scaff += 1
                if n_scaff >= max_scaff:
                    reason, group = "scaff", own
        if reason == "OK":
            if group == -1:
                group, groups = groups, groups + 1
            chosen.append((row, group))
            ended = n_chosen is not None and len(chosen) > n_chosen
            for b in blocks or ():
                used[b] = used.get(b, 0) + 1
        out[row] = (reason, group)
    return out


SETTINGS = [(None, 0, 0, None, None), (2, 0, 0, None, None), (2, 2, 2, None, 9), (1, 3, 1, 7, None), (3, 2, 3, 4, 8), (40, 1, 1, 0, None)]


@pytest.mark.parametrize("seed, setting", list(enumerate(SETTINGS)))
def test_the_rounds_give_the_walk(spark, seed, setting):
    r = random.Random(seed)
    rows = [(k, r.randint(0, 12), r.choice([None, [], ["p"], ["p", "q"], ["q", "q"], ["z", "p"], [f"b{r.randint(0, 3)}"]]), r.choice([None, False, False, True])) for k in range(36)]
    links = [(*r.sample(range(36), 2), r.choice(["sim", "sim", "hard", "scaff", "scaff"])) for _ in range(70)]
    got = selection.diverse_walk(
        spark.createDataFrame(rows, "row long, rank int, blocks array<string>, failed boolean"), spark.createDataFrame(links, "a long, b long, kind string"), *setting
    )
    assert {x["row"]: (x.reason, x.group) for x in got.collect()} == walk(rows, links, *setting)


def test_a_walk_without_rows(spark):
    rows = spark.createDataFrame([], "row long, rank int, blocks array<string>, failed boolean")
    assert selection.diverse_walk(rows, spark.createDataFrame([], "a long, b long, kind string"), 2, n_chosen=3).count() == 0
