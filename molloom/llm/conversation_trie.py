"""Prefix trie of conversations by the Euler-tour technique.

Every distinct sequence of first turns is a node. A prefix is known by two 64-bit exclusive ors of hashes of its turns
with their places; nodes are accepted only if all their members agree in the parent's key and in the SHA-256 of the last
turn, which by induction makes their prefixes equal (otherwise the operator raises, and another seed can be given).

Each node has an arc that enters and one that leaves it. Entering leads to the first child, or out again; leaving leads
to the next sibling, or out of the parent. The list of arcs is ranked in rounds: ranges of arcs shorten to chains,
splitters drawn by a hash take up the arcs before them by pointer jumping, and so on with the splitters until BASE are
left, which one task ranks. Ranks give places; leaves and savings of a subtree are differences of running sums at the
places of its two arcs.

A conversation, first turn or node of very many rows is never one group: rows are numbered and summed by ranges of an
order, groups are counted with partial aggregation, joins read stored tables so that their keys can be split. Only
the SHA-256 of a node's members must read them in one go: they come as chunks of CHUNK bytes in order, one at a time.

Rows without conv_id are left out. Null role and text are empty. Turns are ordered by turn (null first), then role, then
SHA-256 of the turn; equal rows stay as turns of their own. A table without rows has no node. Further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mapped, stored, table
from .ordered import numbered, running

#: Arcs that a task shortens to chains at once; list elements that one task ranks; of so many elements one is a splitter.
BLOCK, BASE, EVERY = 1 << 18, 5_000, 8
#: Bytes of member ids that are hashed at once.
CHUNK = 1 << 16
KEY = ["k", "x1", "x2"]


def turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, place from 1, said: the turn's SHA-256, tokens)."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    said = F.unhex(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256))
    tokens = F.size(F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")).cast("long")
    rows = conversations.where("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), role.alias("role"), said.alias("said"), tokens.alias("tokens"))
    return numbered(rows, ["conv_id", "turn", "role", "said"], "place", "conv_id").select("conv_id", "place", "said", "tokens")


def rebuilt(own: DataFrame, family: int = 20, heads: int = 4) -> DataFrame:
    """own as of turns(). Every conversation c with the first h turns of conversation c - c % family in place of its own
    first h, h = crc32(c) % heads: (conv_id, k from 1, said, tokens), and a row with k = 0 for each conversation."""
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % heads
    base = F.col("conv_id") - F.col("conv_id") % family
    sizes = stored(own.groupBy("conv_id").agg(F.count("*").alias("n")))
    lengths = sizes.where(F.col("conv_id") == base).select(F.col("conv_id").alias("of_base"), F.col("n").alias("n_base"))
    taken = sizes.select("conv_id", base.alias("base"), h.alias("h")).join(lengths, F.col("base") == F.col("of_base"), "left")
    taken = stored(taken.select("conv_id", "base", "h", F.least("h", F.coalesce("n_base", F.lit(0))).alias("taken")))
    first = own.where((F.col("conv_id") == base) & (F.col("place") < heads)).select(F.col("conv_id").alias("of_base"), F.col("place").alias("k"), "said", "tokens")
    given = taken.join(first, (F.col("base") == F.col("of_base")) & (F.col("k") <= F.col("h"))).select("conv_id", "k", "said", "tokens")
    rest = own.join(taken.select(F.col("conv_id").alias("of_conv"), "h", "taken"), F.col("conv_id") == F.col("of_conv")).where("place > h").select("conv_id", (F.col("place") - F.col("h") + F.col("taken")).alias("k"), "said", "tokens")
    roots = sizes.select("conv_id", F.lit(0).cast("long").alias("k"), F.lit(b"").alias("said"), F.lit(0).cast("long").alias("tokens"))
    return roots.unionByName(given).unionByName(rest)


def members(paths: DataFrame, seed: int = 0) -> DataFrame:
    """paths as of rebuilt(), with the keys of each prefix (x1, x2) and of the one before it (p1, p2)."""
    term = lambda n: F.when(F.col("k") > 0, F.xxhash64(F.lit(seed + n), "k", "said")).otherwise(F.lit(0).cast("long"))
    rows = running(paths.select("*", term(1).alias("x1"), term(2).alias("x2")), ["conv_id", "k"], ["x1", "x2"], "conv_id", xor=True)
    return rows.select("*", F.col("x1").bitwiseXOR(term(1)).alias("p1"), F.col("x2").bitwiseXOR(term(2)).alias("p2"))


def chained(arcs: DataFrame) -> DataFrame:
    """arcs (arc, next): (arc, head, off, next, weight). Each arc's place in a chain of successors within a range of
    arcs; the head's row (off 0) has the arc behind the chain and the chain's length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n >= BLOCK:
                yield shorten(held)
                held, n = [], 0
        if n:
            yield shorten(held)

    def shorten(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        arc, after = (np.concatenate([b.column(c).fill_null(-1).to_numpy(zero_copy_only=False) for b in held]).astype(np.int64) for c in (0, 1))
        at = np.minimum(np.searchsorted(arc, after), len(arc) - 1)
        inside = arc[at] == after
        up = np.arange(len(arc))
        up[at[inside]] = np.flatnonzero(inside)
        off = (up != np.arange(len(arc))).astype(np.int64)
        while (off[up] > 0).any():
            off, up = off + off[up], up[up]
        ends = np.flatnonzero(~inside)
        behind, weight = np.full(len(arc), -1), np.zeros(len(arc), np.int64)
        behind[up[ends]], weight[up[ends]] = after[ends], off[ends] + 1
        return pa.RecordBatch.from_arrays([pa.array(arc), pa.array(arc[up]), pa.array(off), pa.array(behind, mask=behind < 0), pa.array(weight)], names=["arc", "head", "off", "next", "weight"])

    return stored(mapped(arcs.repartitionByRange("arc").sortWithinPartitions("arc"), run, "arc long, head long, off long, next long, weight long"))


def _ranked_here(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The ranks of a list of BASE elements at most."""
    full = pa.Table.from_batches(list(batches))
    if not full.num_rows:
        return
    full = full.sort_by("node")
    node, after, rank = (full.column(c).combine_chunks().fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64) for c in range(3))
    end = len(node)
    to = np.where(after < 0, end, np.searchsorted(node, after))
    rank, to = np.append(rank, 0), np.append(to, end)
    while (to < end).any():
        rank, to = rank + rank[to], to[to]
    yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(rank[:end])], names=["node", "rank"])


def ranks(nodes: DataFrame, level: int = 0, base: int | None = None) -> DataFrame:
    """nodes (node, next, weight) of a list: (node, rank), the weights from each node to the end, its own included."""
    if nodes.count() <= (BASE if base is None else base):
        return mapped(nodes.coalesce(1), _ranked_here, "node long, rank long")
    splitter = lambda c: F.pmod(F.xxhash64(F.lit(level), c), F.lit(EVERY)) == 0
    way = stored(nodes.select("node", "next", "weight", (F.col("next").isNull() | splitter("next")).alias("done")))
    while way.where("NOT done").limit(1).count():  # each round doubles the way that is behind
        step = way.where(~splitter("node")).toDF("of", "to", "more", "there")
        jumped = way.where("NOT done").join(step, F.col("next") == F.col("of")).select("node", F.col("to").alias("next"), (F.col("weight") + F.col("more")).alias("weight"), F.col("there").alias("done"))
        way = stored(way.where("done").unionByName(jumped))
    found = ranks(way.where(splitter("node")).select("node", "next", "weight"), level + 1, base).toDF("of", "more")
    return stored(way.join(stored(found), F.col("next") == F.col("of"), "left").select("node", (F.col("weight") + F.coalesce("more", F.lit(0))).alias("rank")))


def list_places(arcs: DataFrame, base: int | None = None) -> DataFrame:
    """arcs (arc, next) of one list, next null at its end: (arc, place from 1)."""
    chains = chained(arcs)
    heads = stored(chains.where("off = 0").select(F.col("head").alias("node"), "next", "weight"))
    found = ranks(heads, base=base).toDF("of", "rank")
    total = chains.count()
    return chains.join(found, F.col("head") == F.col("of")).select("arc", (F.lit(total) - F.col("rank") + F.col("off") + 1).alias("place"))


def member_digests(ends: DataFrame) -> DataFrame:
    """ends (k, x1, x2, conv_id): (k, x1, x2, ends_sha256) of the ids of each key, ascending and comma-joined."""

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = list(zip(*(c.to_pylist() for c in batch.columns[:3])))
            ids = batch.column(3).to_pylist()
            out, i = [], 0
            while i < len(ids):
                j, size = i, 0
                while j < len(ids) and keys[j] == keys[i] and size < CHUNK:
                    size += 20
                    j += 1
                out.append((*keys[i], ids[i], ",".join(map(str, ids[i:j])).encode()))
                i = j
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), [pa.int64()] * 4 + [pa.binary()])], names=[*KEY, "least", "piece"])

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("k", pa.int64()), ("x1", pa.int64()), ("x2", pa.int64()), ("ends_sha256", pa.string())])
        last, now = None, None
        for batch in batches:
            done = []
            for *key, piece in zip(*(batch.column(c).to_pylist() for c in (0, 1, 2, 4))):
                if key == last:
                    now.update(b"," + piece)
                    continue
                if last is not None:
                    done.append((*last, now.hexdigest()))
                last, now = key, hashlib.sha256(piece)
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*done), schema.types)], schema=schema)
        if last is not None:
            yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip((*last, now.hexdigest()), schema.types)], schema=schema)

    rows = ends.select(*KEY, "conv_id").repartitionByRange(*KEY, "conv_id").sortWithinPartitions(*KEY, "conv_id")
    packed = stored(mapped(rows, pieces, "k long, x1 long, x2 long, least long, piece binary"))
    return mapped(packed.repartition(*KEY).sortWithinPartitions(*KEY, "least"), digest, "k long, x1 long, x2 long, ends_sha256 string")


def trie(paths: DataFrame, seed: int = 0, base: int | None = None) -> DataFrame:
    """paths as of rebuilt(): (conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256) a node.

    conv_id is the smallest member; with depth it names the node. saved_tokens are those that stand once and not once a member.
    """
    rows = stored(members(paths, seed))
    of = F.struct("p1", "p2", "said")
    nodes = rows.groupBy(*KEY).agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.max("tokens").alias("tokens"), F.min(of).alias("of"), F.max(of).alias("of_last"))
    nodes = stored(numbered(nodes, ["conv_id", "k"], "id"))
    if nodes.where("of <> of_last").limit(1).count():
        raise ValueError("two prefixes share a key: give another seed")
    nodes = nodes.select("id", *KEY, "conv_id", "n_convs", "tokens", "of.p1", "of.p2")

    above = stored(nodes.select((F.col("k") + 1).alias("of_k"), F.col("x1").alias("of_1"), F.col("x2").alias("of_2"), F.col("id").alias("parent"), F.col("conv_id").alias("parent_conv_id")))
    same = (F.col("k") == F.col("of_k")) & (F.col("p1") == F.col("of_1")) & (F.col("p2") == F.col("of_2"))
    kids = nodes.where("k > 0").join(above, same).select("parent", "conv_id", F.col("id").alias("child"), "parent_conv_id")
    kids = stored(numbered(kids, ["parent", "conv_id"], "m"))
    after = kids.select((F.col("m") - 1).alias("of_m"), F.col("parent").alias("of_parent"), F.col("child").alias("sibling"))
    beside = kids.join(after, (F.col("m") == F.col("of_m")) & (F.col("parent") == F.col("of_parent")), "left").select("child", "parent", "parent_conv_id", "sibling")
    below = kids.groupBy(F.col("parent").alias("of_id")).agg(F.min(F.struct("conv_id", "child"))["child"].alias("first"), F.count("*").alias("n_children"))
    tied = nodes.join(below, F.col("id") == F.col("of_id"), "left").join(beside, F.col("id") == F.col("child"), "left")
    own = F.when(F.col("k") > 0, (F.col("n_convs") - 1) * F.col("tokens")).otherwise(F.lit(0))
    tied = tied.select("id", *KEY, "conv_id", "parent_conv_id", "parent", "first", "sibling", "n_convs", F.coalesce("n_children", F.lit(0)).cast("long").alias("n_children"), own.cast("long").alias("own"))
    tied = stored(tied)

    enter, leave = 2 * F.col("id"), 2 * F.col("id") + 1
    arcs = tied.select(F.explode(F.array(
        F.struct(enter.alias("arc"), F.coalesce(2 * F.col("first"), leave).alias("next")),
        F.struct(leave.alias("arc"), F.coalesce(2 * F.col("sibling"), 2 * F.col("parent") + 1).alias("next")),
    )).alias("a")).select("a.*")
    places = list_places(arcs, base).select((F.col("arc") % 2 == 0).alias("enters"), F.floor(F.col("arc") / 2).alias("of_id"), "place")
    weights = tied.select("id", (F.col("n_children") == 0).cast("long").alias("leaves"), F.col("own").alias("saved"))
    at = places.join(weights, F.col("of_id") == F.col("id")).select("id", "place", "enters", *(F.when(F.col("enters"), F.col(c)).otherwise(F.lit(0)).cast("long").alias(c) for c in ("leaves", "saved")))
    sums = running(at.select("*", F.col("leaves").alias("leaf"), F.col("saved").alias("one")), ["place"], ["leaves", "saved"])
    until = lambda c, mine: F.sum(F.when(F.col("enters"), F.col(mine) - F.col(c)).otherwise(F.col(c))).alias(c)
    sums = sums.groupBy(F.col("id").alias("of_id")).agg(until("leaves", "leaf"), until("saved", "one"))

    ends = rows.groupBy("conv_id").agg(F.max(F.struct(*KEY)).alias("e")).select("e.*", "conv_id")
    digests = member_digests(ends).toDF("of_k", "of_1", "of_2", "ends_sha256")
    out = tied.join(sums, F.col("id") == F.col("of_id")).join(digests, (F.col("k") == F.col("of_k")) & (F.col("x1") == F.col("of_1")) & (F.col("x2") == F.col("of_2")), "left")
    none = hashlib.sha256(b"").hexdigest()
    return out.select("conv_id", F.col("k").alias("depth"), "parent_conv_id", "n_convs", "n_children", F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(none)).alias("ends_sha256"))


def op11_conversation_trie(spark, sf_dir: str) -> DataFrame:
    return trie(rebuilt(stored(turns(table(spark, sf_dir, "conversations")))))


# prefixes as text, ancestors of each node by joins; crc32 step by step
OP11_SQL = r"""
WITH t AS (SELECT conv_id, coalesce(role, '') r, coalesce(text, '') x, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) p FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT DISTINCT conv_id, conv_id - conv_id % 20 b, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(conv_id::VARCHAR, ''), lambda ch: ascii(ch)::BIGINT)),
  lambda a, y: list_reduce([xor(a, y), 0, 0, 0, 0, 0, 0, 0, 0], lambda u, _: xor(u >> 1, 3988292384 * (u & 1))))) % 4 h FROM t),
u AS (SELECT c.conv_id, p o, r, x FROM c JOIN t ON t.conv_id = c.b AND p <= h UNION ALL SELECT c.conv_id, p + 1000000000, r, x FROM c JOIN t USING (conv_id) WHERE p > h),
v AS (SELECT conv_id, row_number() OVER w k, sha256(r || chr(0) || x) z, len(list_filter(regexp_split_to_array(x, '[\x20\x09-\x0D]+'), lambda y: y <> '')) m FROM u WINDOW w AS (PARTITION BY conv_id ORDER BY o)),
s AS (SELECT conv_id, k, m, string_agg(z, '') OVER (PARTITION BY conv_id ORDER BY k) g FROM v UNION ALL SELECT conv_id, 0, 0, '' FROM c),
l AS (SELECT conv_id, max(k) k FROM s GROUP BY 1),
n AS (SELECT k, g, min(conv_id) conv_id, count(*) n_convs, max(m) m FROM s GROUP BY k, g),
e AS (SELECT k, g, string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) ids FROM s JOIN l USING (conv_id, k) GROUP BY k, g),
q AS (SELECT n.*, p.conv_id parent_conv_id FROM n LEFT JOIN s o ON o.conv_id = n.conv_id AND o.k = n.k - 1 LEFT JOIN n p ON p.k = o.k AND p.g = o.g),
i AS (SELECT parent_conv_id conv_id, k - 1 k, count(*) n_children FROM q WHERE k > 0 GROUP BY ALL),
a AS (SELECT o.k, o.g, count(*) FILTER (n_children IS NULL) n_leaves, sum((n.n_convs - 1) * n.m) saved FROM n LEFT JOIN i USING (conv_id, k) JOIN s o ON o.conv_id = n.conv_id AND o.k <= n.k GROUP BY o.k, o.g)
SELECT q.conv_id, q.k::BIGINT depth, parent_conv_id, n_convs, coalesce(n_children, 0)::BIGINT n_children, n_leaves, saved::BIGINT saved_tokens, sha256(coalesce(ids, '')) ends_sha256
FROM q LEFT JOIN i USING (conv_id, k) JOIN a ON a.k = q.k AND a.g = q.g LEFT JOIN e ON e.k = q.k AND e.g = q.g
"""
