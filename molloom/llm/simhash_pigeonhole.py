"""SimHash near-duplicates by the generalised pigeonhole principle.

Fingerprints are 64-bit majorities over the XXH64 hashes of 3-word shingles. Bits that vary together are grouped into
partitions. If two fingerprints differ in DISTANCE bits at most and a fingerprint's thresholds t sum to
DISTANCE - partitions + 1 (-1: not probed), some partition differs in t bits at most. Each distinct fingerprint gets
the thresholds with the fewest estimated candidates, by dynamic programming over exact counts of partition values;
it probes the values within t of its own, and candidates are verified. Tasks reduce the links that they find to stars,
so a group of near copies costs one row a member and not all pairs.

Where even the best thresholds meet more than HOT candidates (a very large group of near copies), a fingerprint is
linked in balls instead: it emits the values within 2 bits, every fingerprint those within 1; two that share a value
are within 3. That is linear in the members and exact. Null texts and texts without words have fingerprint zero and
are linked like any other; texts of fewer words hash their whole sequence; repeated rows share a fingerprint.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import keep_columns, mapped, ranges, slices, stored, table, utf8
from .components import components, local_roots

SHINGLE, SEED, DISTANCE = 3, 42, 3
#: Candidates of one fingerprint beyond which it is linked in balls.
HOT = 20_000
#: Pairs that a task compares at once.
CHUNK = 2_000_000
#: Distinct fingerprints beyond which 3 partitions of 22 bits replace 4 of 16.
WIDE = 1 << 23


def word_spans(offsets: np.ndarray, data: np.ndarray) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray]:
    """The texts in lower case (A-Z) with single spaces, each word's start and end in them, and words of each text."""
    size = np.diff(offsets)
    flat = np.full(len(data) + len(size), 32, np.uint8)
    flat[ranges(offsets[:-1] + np.arange(len(size)), size)] = data
    flat = np.where((flat >= 65) & (flat <= 90), flat + 32, flat).astype(np.uint8)
    space = (flat == 32) | (flat >= 9) & (flat <= 13)
    keep = ~space
    keep[1:] |= ~space[:-1]
    flat, space = np.where(space, 32, flat).astype(np.uint8)[keep], space[keep]
    ends = np.flatnonzero(space)
    starts = np.concatenate([[0], ends[:-1] + 1]).astype(np.int64) if len(ends) else np.zeros(0, np.int64)
    kept = np.concatenate([[0], np.cumsum(keep)])[offsets + np.arange(len(offsets))]
    return flat.tobytes(), starts, ends, np.diff(np.searchsorted(ends, kept))


def fingerprint(offsets: np.ndarray, data: np.ndarray) -> np.ndarray:
    raw, starts, ends, words = word_spans(offsets, data)
    shingles = np.where(words >= SHINGLE, words - SHINGLE + 1, np.minimum(words, 1))
    first = np.cumsum(words) - words
    at = ranges(first, shingles)
    to = at + np.repeat(np.minimum(words, SHINGLE), shingles) - 1
    digest, seed = xxhash.xxh64_intdigest, SEED
    hashes = np.fromiter((digest(raw[a:b], seed) for a, b in zip(starts[at].tolist(), ends[to].tolist())), np.uint64, len(at))
    bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    out = np.zeros(len(words), np.uint64)
    full = np.flatnonzero(shingles)
    if len(full):
        heads = (np.cumsum(shingles) - shingles)[full]
        ones = np.add.reduceat(bits, heads, axis=0, dtype=np.int64)
        major = (2 * ones > shingles[full][:, None]).astype(np.uint8)
        out[full] = np.packbits(major, axis=1, bitorder="little").view(np.uint64)[:, 0]
    return out


def fingerprints(df: DataFrame, text: str = "text") -> DataFrame:
    """Adds fp (long)."""
    kept = keep_columns(df, "fp")
    schema = df.select(kept).withColumn("fp", F.lit(0).cast("long")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(kept.index(text))
            for i, j in slices(utf8(column)[0]):
                yield pa.RecordBatch.from_arrays([*batch.slice(i, j - i).columns, pa.array(fingerprint(*utf8(column.slice(i, j - i))).view(np.int64))], names=schema.names)

    return mapped(df.select(kept), run, schema)


def bits_of(fps: np.ndarray) -> np.ndarray:
    return np.unpackbits(np.ascontiguousarray(fps).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def value_of(bits: np.ndarray, group: list[int]) -> np.ndarray:
    """The partition's bits of each fingerprint as a number."""
    return bits[:, group].astype(np.int64) @ (1 << np.arange(len(group), dtype=np.int64))


def _column(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
    for batch in batches:
        yield batch.column(0).to_numpy()


def bit_groups(nodes: DataFrame, partitions: int) -> list[list[int]]:
    """Bits in partitions of about equal size; each partition grows by the bit most correlated with it."""

    def run(batches):
        total = np.zeros((65, 65))
        for fps in _column(batches):
            b = np.column_stack([bits_of(fps), np.ones(len(fps))]).astype(np.float64)
            total += b.T @ b
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(65 * 65)), pa.array(total.ravel())], names=["cell", "n"])

    cells = nodes.select("fp").mapInArrow(run, "cell long, n double").groupBy("cell").agg(F.sum("n").alias("n")).collect()
    m = np.zeros(65 * 65)
    for r in cells:
        m[r.cell] = r.n
    return correlated(m.reshape(65, 65), partitions)


def correlated(m: np.ndarray, partitions: int) -> list[list[int]]:
    """The partitions, from sums of products of the 64 bits and a one."""
    m = m / max(m[64, 64], 1)
    p = m[64, :64]
    spread = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    corr = np.abs(m[:64, :64] - np.outer(p, p)) / np.outer(spread, spread)
    left, groups = list(range(64)), []
    for k in range(partitions):
        group = [left.pop(0)]
        while len(group) < 64 * (k + 1) // partitions - 64 * k // partitions and left:
            best = max(left, key=lambda b: (round(float(corr[b, group].mean()), 9), -b))
            left.remove(best)
            group.append(best)
        groups.append(sorted(group))
    return groups


def balls(width: int) -> list[np.ndarray]:
    """Masks of at most 0, 1 and 2 bits."""
    one = 1 << np.arange(width, dtype=np.int64)
    two = np.array([a | b for a, b in combinations(one.tolist(), 2)], np.int64)
    zero = np.zeros(1, np.int64)
    return [zero, np.concatenate([zero, one]), np.concatenate([zero, one, two])]


def value_counts(nodes: DataFrame, groups: list[list[int]]) -> list[np.ndarray]:
    """How many fingerprints hold each value of each partition. Bounded by partitions * 2 ** bits."""

    def run(batches):
        total = [np.zeros(1 << len(g), np.int64) for g in groups]
        for fps in _column(batches):
            b = bits_of(fps)
            for k, g in enumerate(groups):
                total[k] += np.bincount(value_of(b, g), minlength=1 << len(g))
        for k, t in enumerate(total):
            at = np.flatnonzero(t)
            yield pa.RecordBatch.from_arrays([pa.array(k << 32 | at), pa.array(t[at])], names=["key", "n"])

    got = nodes.select("fp").mapInArrow(run, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).toPandas()
    key, n = got["key"].to_numpy(np.int64), got["n"].to_numpy(np.int64)
    out = []
    for k, g in enumerate(groups):
        t = np.zeros(1 << len(g), np.int64)
        own = key >> 32 == k
        t[key[own] & 0xFFFFFFFF] = n[own]
        out.append(t)
    return out


def allocate(costs: list[list[np.ndarray]], total: int) -> tuple[np.ndarray, np.ndarray]:
    """Thresholds [fingerprint, partition] that sum to total, with the least summed cost, by dynamic programming over partitions.

    costs[k][t + 1]: of threshold t in partition k.
    """
    n, m = len(costs[0][0]), len(costs)
    best = {0: (np.zeros(n), np.zeros((n, 0), np.int8))}
    for k in range(m):
        new: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for s, (cost, chosen) in best.items():
            for t in range(-1, len(costs[k]) - 1):
                if s + t > total + (m - 1 - k) or s + t + (m - 1 - k) * (len(costs[k]) - 2) < total:
                    continue
                c = cost + costs[k][t + 1]
                path = np.column_stack([chosen, np.full(n, t, np.int8)])
                if s + t in new:
                    old, old_path = new[s + t]
                    better = c < old
                    new[s + t] = (np.where(better, c, old), np.where(better[:, None], path, old_path))
                else:
                    new[s + t] = (c, path)
        best = new
    return best[total][1], best[total][0]


def links(nodes: DataFrame, partitions: int | None = None, hot: int = HOT) -> DataFrame:
    """nodes (fp long, distinct): links (a, b) whose components are those of all pairs within DISTANCE."""
    if partitions is None:
        partitions = 4 if nodes.count() <= WIDE else 3
    groups = bit_groups(nodes, partitions)
    counts = value_counts(nodes, groups)
    # fingerprints within 0, 1 and (in narrow partitions) 2 bits of each value
    near = []
    for g, c in zip(groups, counts):
        sums = [c.astype(np.int32)]
        masks = balls(len(g))
        for radius in (1, 2) if len(g) <= 16 else (1,):
            total = sums[-1].copy()
            for m in masks[radius][len(masks[radius - 1]) :].tolist():
                total += sums[0][np.arange(len(c)) ^ m]
            sums.append(total)
        near.append(sums)
    shared = nodes.sparkSession.sparkContext.broadcast(near)

    def plan(fps: np.ndarray):
        bits = bits_of(fps)
        values = [value_of(bits, g) for g in groups]
        costs = [[np.zeros(len(fps)), *(0.5 * len(balls(len(g))[t]) + near_[t][v] for t in range(len(near_)))] for g, near_, v in zip(groups, shared.value, values)]
        chosen, cost = allocate(costs, DISTANCE - partitions + 1)
        return values, chosen, cost > hot + 1000

    def probes(batches):
        for fps in _column(batches):
            if not len(fps):
                continue
            values, chosen, crowded = plan(fps)
            key, kind, who = [], [], []
            for k, g in enumerate(groups):
                used = shared.value[k][0][values[k]] <= hot + 1000  # no probe meets a larger value
                key.append(k << 32 | values[k][used])
                kind.append(np.zeros(int(used.sum()), np.int8))
                who.append(fps[used])
                for t, masks in enumerate(balls(len(g))):
                    own = (chosen[:, k] == t) & ~crowded
                    key.append((k << 32 | values[k][own][:, None] ^ masks).ravel())
                    who.append(np.repeat(fps[own], len(masks)))
                    kind.append(np.ones(len(who[-1]), np.int8))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (key, kind, who)], names=["key", "kind", "fp"])

    def compare(batches):
        """Rows sorted by key, those of the index first. Complete keys are compared in chunks."""
        held = [np.zeros(0, np.int64), np.zeros(0, np.int8), np.zeros(0, np.int64)]
        for batch in batches:
            held = [np.concatenate([h, c.to_numpy()]) for h, c in zip(held, batch.columns)]
            cut = int(np.searchsorted(held[0], held[0][-1])) if len(held[0]) else 0
            if cut:
                yield from found(*(h[:cut] for h in held))
                held = [h[cut:] for h in held]
        yield from found(*held)

    def found(key, kind, fp):
        index, query = np.flatnonzero(kind == 0), np.flatnonzero(kind == 1)
        lo, hi = np.searchsorted(key[index], key[query], "left"), np.searchsorted(key[index], key[query], "right")
        size = hi - lo
        ends = np.cumsum(size)
        i = 0
        while i < len(query):
            j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + CHUNK, "right")))
            a = np.repeat(fp[query[i:j]], size[i:j])
            b = fp[index[ranges(lo[i:j], size[i:j])]]
            near_ = (np.bitwise_count((a ^ b).view(np.uint64)) <= DISTANCE) & (a != b)
            if near_.any():
                node, root = local_roots(a[near_], b[near_])
                yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(root)], names=["a", "b"])
            i = j

    rows = mapped(nodes.select("fp"), probes, "key long, kind byte, fp long")
    out = rows.repartition("key").sortWithinPartitions("key", "kind").mapInArrow(compare, "a long, b long")

    def is_crowded(batches):
        for fps in _column(batches):
            if len(fps):
                yield pa.RecordBatch.from_arrays([pa.array(fps), pa.array(plan(fps)[2])], names=["fp", "crowded"])

    marked = stored(nodes.select("fp").mapInArrow(is_crowded, "fp long, crowded boolean"))
    if not marked.where("crowded").limit(1).count():
        return out
    return out.unionByName(ball_links(marked))


def ball_links(marked: DataFrame) -> DataFrame:
    """marked (fp, crowded): links of crowded fingerprints with all within DISTANCE, by values within 2 and 1 bits."""

    def run(batches):
        masks = balls(64)
        for batch in batches:
            fps, crowded = batch.column(0).to_numpy(), batch.column(1).to_numpy(zero_copy_only=False)
            for i in range(0, len(fps), 500):
                f, c = fps[i : i + 500], crowded[i : i + 500]
                wide = f[c]
                z = np.concatenate([(f[:, None] ^ masks[1]).ravel(), (wide[:, None] ^ masks[2]).ravel()])
                who = np.concatenate([np.repeat(f, len(masks[1])), np.repeat(wide, len(masks[2]))])
                close = np.arange(len(z)) < len(f) * len(masks[1])
                yield pa.RecordBatch.from_arrays([pa.array(z), pa.array(who), pa.array(close)], names=["z", "fp", "close"])

    rows = marked.mapInArrow(run, "z long, fp long, close boolean")
    hubs = rows.groupBy("z").agg(F.min(F.when(F.col("close"), F.col("fp"))).alias("hub"), F.min("close").alias("all_close"), F.min("fp").alias("least"), F.max("fp").alias("most"))
    hubs = hubs.where("hub IS NOT NULL AND NOT all_close AND least <> most").select(F.col("z").alias("at"), "hub")
    return rows.join(hubs, F.col("z") == F.col("at")).where("fp <> hub").select(F.col("fp").alias("a"), F.col("hub").alias("b")).distinct()


def groups(df: DataFrame, text: str = "text", partitions: int | None = None, hot: int = HOT) -> DataFrame:
    """(doc_id, fp, component_id): component_id is the smallest doc_id whose fingerprint is reachable."""
    prints = stored(fingerprints(df.select("doc_id", F.col(text).alias("text"))).drop("text"))
    nodes = stored(prints.groupBy("fp").agg(F.min("doc_id").alias("least")))
    roots = components(links(nodes, partitions, hot))
    named = roots.join(nodes, F.col("node") == F.col("fp")).select("node", "root", "least")
    least = named.groupBy("root").agg(F.min("least").alias("component"))
    of_node = named.select("node", "root").join(least, "root").select("node", "component")
    full = nodes.join(of_node, F.col("fp") == F.col("node"), "left").select(F.col("fp").alias("of_fp"), F.coalesce("component", "least").alias("component_id"))
    full = stored(full)  # so that the rows of a fingerprint with very many copies can be split in the join
    return prints.join(full, F.col("fp") == F.col("of_fp")).select("doc_id", "fp", "component_id")


def op8_simhash_pigeonhole(spark, sf_dir: str) -> DataFrame:
    found = groups(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
