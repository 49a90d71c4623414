"""Count fingerprints of texts compared by prefixes, with little on disk.

A text's set holds (token, 1st), (token, 2nd), ... as 64-bit hashes. The order that prefixes need may be any: rare elements of a
sample come after those that it lacks, which only shapes the cost. A text is read twice, for its prefix and, if it has a
candidate, for its whole set; sets are not stored. Candidates are bound by sizes and places in the prefixes, and by the parity
bits of both sets: as many bits differ as elements at most.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from molloom.functions import fingerprints as fp
from molloom.operators.neighbour_graph import by_key, pairs_within
from molloom.operators.store import kept

#: Texts of the sample; bits of a signature (parities); tokens that a task takes at once.
SAMPLE, BITS, TOKENS = 40_000, 1024, 1 << 20
_ODD = np.uint64(0x9E3779B97F4A7C15)


def _sets(column: pa.ListArray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, offsets of rows, elements ascending within a row) of lists of tokens, some rows at a time. Empty tokens are none."""
    sizes = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends, i = np.cumsum(sizes), 0
    while i < len(sizes):
        j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + TOKENS, "right")))
        coded = column.slice(i, j - i).flatten().dictionary_encode()
        words = coded.dictionary.to_pylist()
        hashes = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in words), np.uint64, len(words))
        used = np.fromiter((w != "" for w in words), bool, len(words))
        which = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        row = np.repeat(np.arange(j - i), sizes[i:j])
        row, which = row[used[which]], which[used[which]]
        order = np.argsort(row * max(len(words), 1) + which, kind="stable")
        row, which = row[order], which[order]
        new = np.ones(len(row), bool)
        new[1:] = (row[1:] != row[:-1]) | (which[1:] != which[:-1])
        first = np.maximum.accumulate(np.where(new, np.arange(len(row)), 0))
        e = (hashes[which] + (np.arange(len(row)) - first).astype(np.uint64)) * _ODD
        e ^= e >> np.uint64(32)
        e = e[np.lexsort((e, row))]
        yield i, np.concatenate([[0], np.cumsum(np.bincount(row, minlength=j - i))]), e
        i = j


def _binary(values: np.ndarray, offsets: np.ndarray) -> pa.Array:
    raw = values.tobytes()
    return pa.array([raw[8 * a : 8 * b] for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())], pa.binary())


def _sample(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Elements that several texts of a sample hold, ascending, and how many do."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, e in _sets(batch.column(1)):
                yield pa.RecordBatch.from_arrays([pa.array(e.view(np.int64))], names=["e"])

    share = max(1, docs.count() // SAMPLE)
    some = docs.where(F.pmod(F.xxhash64("row", F.lit(5)), F.lit(share)) == 0)
    often = some.mapInArrow(run, "e long").groupBy("e").agg(F.count("*").alias("n")).where("n > 1").orderBy(F.col("n").desc(), "e").limit(1_000_000).toArrow()
    e, n = often.column("e").to_numpy().view(np.uint64), often.column("n").to_numpy()
    order = np.argsort(e)
    return e[order], n[order]


def _ordered(e: np.ndarray, known: np.ndarray, often: np.ndarray) -> np.ndarray:
    at = np.minimum(np.searchsorted(known, e), max(len(known) - 1, 0))
    n = np.where(known[at] == e, often[at], 0) if len(known) else np.zeros(len(e), np.int64)
    return e[np.lexsort((e, n))]


def count_links(docs: DataFrame, cutoff: float) -> tuple[DataFrame, DataFrame]:
    """docs (row long, tokens array<string>): (class_id, n) of classes that have others with a count Tanimoto of cutoff or
    more, n of them; and (row, class_id). The class of texts with equal counts is their least row. Texts of one row are one, null rows hold nothing."""
    docs = docs.select("row", F.when(F.col("row").isNotNull(), F.col("tokens")).otherwise(F.array().cast("array<string>")).alias("tokens"))
    twice = kept(docs.groupBy(F.col("row").alias("of_row")).agg(F.count("*").alias("times")).where("times > 1"))
    repeated, same = twice.limit(1).count() > 0, F.col("row").eqNullSafe(F.col("of_row"))
    if repeated:
        joined = docs.join(twice, same, "left_semi").groupBy("row").agg(F.flatten(F.collect_list("tokens")).alias("tokens"))
        docs = docs.join(twice, same, "left_anti").unionByName(joined)
    known, often = _sample(docs)
    units, one = fp.lower_cutoff(cutoff), fp.STEPS

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, offsets, e in _sets(batch.column(1)):
                keys, heads, signs = [], [], []
                for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
                    own, n = e[a:b], b - a
                    keys.append(hashlib.sha256(own.tobytes()).digest())
                    heads.append(_ordered(own, known, often)[: n - -(-n * units // one) + 1 if n else 0].tobytes())
                    signs.append(np.packbits(np.bincount((own >> np.uint64(54)).astype(np.int64), minlength=BITS) & 1).tobytes())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, len(keys)), pa.array(keys, pa.binary()), pa.array(np.diff(offsets)), pa.array(heads, pa.binary()), pa.array(signs, pa.binary())], names=["row", "key", "n", "head", "signs"])

    def exploded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, n = (batch.column(k).to_numpy() for k in (0, 1))
            heads = batch.column(2).to_pylist()
            size = np.array([len(h) // 8 for h in heads], np.int64)
            place = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
            yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(b"".join(heads), np.int64)), pa.array(np.repeat(row, size)), pa.array(np.repeat(n, size).astype(np.int32)), pa.array(place.astype(np.int32))], names=["e", "row", "n", "place"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows (e, row, n, place) sorted by e: pairs that share e and may be similar by size, and how many elements from e on they may
        have in common beyond those that they need."""
        for e, row, n, place in by_key(batches):
            for i, j in pairs_within(e):
                low, high = row[i] < row[j], (n[i].astype(np.int64), n[j].astype(np.int64))
                use = (high[0] * one >= high[1] * units) & (high[1] * one >= high[0] * units)
                a, b = np.where(low, i, j)[use], np.where(low, j, i)[use]
                total = n[a].astype(np.int64) + n[b]
                left = np.minimum(n[a] - place[a], n[b] - place[b]) + -total * units // (one + units)
                some = left + np.minimum(place[a], place[b]) >= 0  # with all before e in common as well
                a, b, left = a[some], b[some], left[some]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (row[a], row[b], n[a], n[b], left.astype(np.int32))], names=["a", "b", "na", "nb", "left"])

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, offsets, e in _sets(batch.column(1)):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, len(offsets) - 1), _binary(e, offsets)], names=["row", "elements"])

    def decided(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            use = []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                c = len(np.intersect1d(x, y, assume_unique=True))
                use.append(c / (len(x) + len(y) - c) >= cutoff)
            yield pa.RecordBatch.from_arrays(batch.columns[:2], names=["a", "b"]).filter(pa.array(use, pa.bool_()))

    heads = kept(docs.select("row", "tokens").mapInArrow(prefixes, "row long, key binary, n long, head binary, signs binary"))
    least = kept(heads.groupBy("key").agg(F.min("row").alias("class_id")))
    rows = heads.select("row", "key").join(least, "key").select("row", "class_id")
    if repeated:
        times = F.explode(F.sequence(F.lit(1).cast("long"), F.coalesce("times", F.lit(1).cast("long"))))
        rows = rows.join(twice, same, "left").select("row", "class_id", times.alias("t")).drop("t")
    reps = heads.join(least.select(F.col("class_id").alias("row")), "row", "left_semi")
    each = reps.select("row", "n", "head").mapInArrow(exploded, "e long, row long, n int, place int")
    met = each.repartition("e").sortWithinPartitions("e").mapInArrow(meet, "a long, b long, na int, nb int, left int")
    # nothing is shared before the first; from the last on no more than is left, beside the shared ones up to there
    enough = (F.max("left") >= 0) & (F.min("left") + F.count("*") > 0)
    met = kept(met.groupBy("a", "b").agg(enough.alias("enough"), F.first("na").alias("na"), F.first("nb").alias("nb")).where("enough").select("a", "b", "na", "nb"))
    signs = reps.select("row", "signs")
    beside = met.join(signs.toDF("a", "sa").hint("merge"), "a").join(signs.toDF("b", "sb").hint("merge"), "b")

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint64).reshape(-1, BITS // 64) for k in (4, 5))
            total = batch.column(2).to_numpy().astype(np.int64) + batch.column(3).to_numpy()
            # |x| + |y| - 2 common elements differ, at most total * (1 - cutoff) / (1 + cutoff)
            use = np.bitwise_count(x ^ y).sum(axis=1, dtype=np.int64) * (one + units) <= total * (one - units)
            yield pa.RecordBatch.from_arrays(batch.columns[:2], names=["a", "b"]).filter(pa.array(use))

    pairs = kept(beside.select("a", "b", "na", "nb", "sa", "sb").mapInArrow(near, "a long, b long"))
    wanted = kept(pairs.select(F.explode(F.array("a", "b")).alias("row")).distinct())
    full = kept(docs.join(wanted, "row", "left_semi").select("row", "tokens").mapInArrow(whole, "row long, elements binary"))
    both = pairs.join(full.toDF("a", "x").hint("merge"), "a").join(full.toDF("b", "y").hint("merge"), "b").select("a", "b", "x", "y")
    links = both.mapInArrow(decided, "a long, b long")
    return links.select(F.explode(F.array("a", "b")).alias("class_id")).groupBy("class_id").agg(F.count("*").alias("n")), rows
