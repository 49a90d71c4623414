import random
from collections import Counter

import pytest

from molloom.operators import count_sets, similarity


def made(seed):
    r = random.Random(seed)
    words = ["".join(r.choice("abcdé") for _ in range(r.randint(1, 4))) for _ in range(60)]
    out = []
    for k in range(60):
        base = r.choices(words, k=r.choice([3, 8, 30, 120]))
        out.append(base)
        for _ in range(3):
            own = list(base)
            for _ in range(r.randint(0, max(1, len(own) // 7))):
                own[r.randrange(len(own))] = r.choice(words)
            r.shuffle(own)
            out.append(own + [""])
    return list(enumerate(out)) + [(900, []), (901, [""]), (902, None), (903, ["a"] * 5000), (904, ["a"] * 4000)]


def brute(rows, cutoff):
    counts = {}
    for k, w in rows:
        counts.setdefault(k, Counter()).update(x for x in w or [] if x and k is not None)
    classes = {}
    for k, c in counts.items():
        classes.setdefault(frozenset(c.items()), []).append(k)
    least = {key: min((k for k in ks if k is not None), default=None) for key, ks in classes.items()}
    links = Counter()
    reps = [(least[key], dict(key)) for key in classes]
    for i, (a, x) in enumerate(reps):
        for b, y in reps[:i]:
            c = sum(min(n, y.get(w, 0)) for w, n in x.items())
            if c and c / (sum(x.values()) + sum(y.values()) - c) >= cutoff:
                links.update((a, b))
    own = {k: least[key] for key, ks in classes.items() for k in ks}
    return sorted(((k, own[k], links[own[k]]) for k, _ in rows), key=str)


@pytest.mark.parametrize("cutoff", [0.5, 0.8, 1.0])
def test_links_of_counts(spark, cutoff, monkeypatch):
    """As by brute force, repeated and null rows included; the sets themselves are not joined by their elements."""
    monkeypatch.setattr(similarity, "similarity_self_join", None)
    monkeypatch.setattr(similarity, "classes", None)
    rows = [*made(2), (7, ["zz", "a"]), (None, ["q"]), (None, ["p"])]
    linked, classes = count_sets.count_links(spark.createDataFrame(rows, "row long, tokens array<string>").repartition(3), cutoff)
    got = [(x["row"], x.class_id, x.n_links) for x in similarity.neighbour_counts(linked, classes).collect()]
    assert sorted(got, key=str) == brute(rows, cutoff)


def test_no_texts(spark):
    linked, classes = count_sets.count_links(spark.createDataFrame([], "row long, tokens array<string>"), 0.8)
    assert linked.count() == classes.count() == 0
