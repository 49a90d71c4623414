"""Exact substring dedup by a sparse, distributed suffix array with deep-shallow sorting.

Every window of LENGTH bytes has an anchor: its least GRAM-gram by hash, the first of equals. Equal windows have equal
anchors at the same offset, so only windows whose anchor's gram occurs more than once can repeat; Spark counts the
grams. A document's consecutive windows of one repeated anchor form a block (the text that they cover). Blocks are
dealt by anchor gram, equal blocks of a slice once, packed by destination. A gram that occurs more than HOT times has a
block for each window, dealt by a hash of the whole window, so that a passage in very many different texts is spread
over as many tasks as it has windows, each with one distinct text. Parts grow with the counted blocks. Each task sorts the window suffixes of its
distinct blocks by suffix_sort (multikey sort to a shallow depth, blind tries beyond); neighbours with a common prefix
of LENGTH bytes are repeats. The bytes that repeated windows cover are removed.

Null texts count as empty, texts shorter than LENGTH keep everything, matches never cross documents. Repeated rows
(equal id and text) are documents of their own and repeat each other. Tables without rows give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import binaries, ranges, slices, stored, table, utf8
from .suffix_sort import suffix_order

LENGTH, GRAM = 200, 64
SLICE = 1 << 20
#: Occurrences of a gram beyond which its windows are dealt one by one, and repeated blocks of a part.
HOT, PART_BLOCKS = 50_000, 200_000
#: Longer texts are cut into pieces of windows.
PIECE = 8 << 20
PLACE = np.uint64((1 << 24) - 1)


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """Hash of the GRAM bytes from each place on (len(data) - GRAM + 1 of them), by doubling."""
    h = data.astype(np.uint64) + np.uint64(1)
    h *= np.uint64(0x9E3779B97F4A7C15)
    size = 1
    while size < GRAM:
        a, b = h[:-size], h[size:]
        h = a * np.uint64(0xBF58476D1CE4E5B9 + 2 * size)
        h ^= h >> np.uint64(32)
        h += b
        size *= 2
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(29)
    return h


def window_anchors(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gram hashes, and each window's anchor as a place. len(data) >= LENGTH."""
    h = gram_hashes(data)
    key = (h & ~PLACE) | np.arange(len(h), dtype=np.uint64)
    width, size = LENGTH - GRAM + 1, 1
    while size * 2 <= width:
        key = np.minimum(key[:-size], key[size:])
        size *= 2
    key = np.minimum(key[: len(key) - (width - size)], key[width - size :])
    return h, (key & PLACE).astype(np.int64)


def window_hashes(h: np.ndarray) -> np.ndarray:
    """Hash of the LENGTH bytes from each place on, of the gram hashes that cover them."""
    n = len(h) - (LENGTH - GRAM)
    out = np.zeros(n, np.uint64)
    for at in (*range(0, LENGTH - GRAM, GRAM), LENGTH - GRAM):
        out = (out ^ h[at : at + n]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(31)
    return out.view(np.int64)


def single_windows(runs: np.ndarray, gram: np.ndarray, lo: np.ndarray, hi: np.ndarray, doc: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(gram, first window, last window, document) where each marked run became its windows, with their hashes for grams."""
    n = np.where(runs, hi - lo + 1, 1)
    start = ranges(lo, n)
    one = np.repeat(runs, n)
    return np.where(one, hashes[np.minimum(start, len(hashes) - 1)], np.repeat(gram, n)), start, np.where(one, start, np.repeat(hi, n)), np.repeat(doc, n)


def anchored(offsets: np.ndarray, data: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For slices of documents: (first document, base, gram hash, first window, last window, document) of each anchor's run of windows.

    Windows are places in data from base on; the arrays are aligned, one element a run.
    """
    for i, j in slices(offsets, SLICE):
        for base in range(int(offsets[i]), max(int(offsets[j]), int(offsets[i]) + 1), PIECE):
            end = min(int(offsets[j]), base + PIECE + LENGTH - 1)
            part = data[base:end]
            if len(part) < LENGTH:
                continue
            h, anchor = window_anchors(part)
            doc = np.searchsorted(offsets[i + 1 : j + 1] - base, np.arange(len(anchor)), "right")
            inside = np.arange(len(anchor)) + LENGTH <= (offsets[i + 1 : j + 1] - base)[np.minimum(doc, j - i - 1)]
            run = np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (doc[1:] != doc[:-1])])
            own = np.flatnonzero(inside)
            if not len(own):
                continue
            number = np.cumsum(run)[own]
            first = np.flatnonzero(np.concatenate([[True], number[1:] != number[:-1]]))
            last = np.append(first[1:], len(own)) - 1
            lo, hi = own[first], own[last]
            yield i, base, h[anchor[lo]].view(np.int64), lo, hi, doc[lo] + i


def _pack(x: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(x).tobytes())


def _unpack(raw: bytes, kind) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), kind)


def packed_texts(docs: DataFrame) -> DataFrame:
    """The text column as a zstandard frame of its bytes: less to shuffle."""
    schema = docs.withColumn("text", F.col("text").cast("binary")).schema
    where = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=3).compress
        for batch in batches:
            columns = list(batch.columns)
            columns[where] = pa.array([pack((t or "").encode()) for t in columns[where].to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return docs.mapInArrow(run, schema)


def unpacked(batches: Iterator[pa.RecordBatch], where: int) -> Iterator[pa.RecordBatch]:
    """Batches with the packed texts as bytes, in slices of bounded size."""
    unpack = zstandard.ZstdDecompressor().decompress
    for batch in batches:
        size = [zstandard.frame_content_size(t) for t in batch.column(where).to_pylist()]
        for i, j in slices(np.concatenate([[0], np.cumsum(size, dtype=np.int64)]), SLICE):
            part = batch.slice(i, j - i)
            columns = list(part.columns)
            columns[where] = pa.array([unpack(t) for t in columns[where].to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)


def _grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(row_key, gram) of every document's anchors."""
    for batch in batches:
        offsets, data = utf8(batch.column(1))
        key = batch.column(0).to_numpy()
        for _, _, gram, _, _, doc in anchored(offsets, data):
            yield pa.RecordBatch.from_arrays([pa.array(key[doc]), pa.array(gram)], names=["row_key", "gram"])


PACKED = "part int, grams binary, sizes binary, bytes binary, block binary, owner binary, place binary"


def _blocks(parts: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Blocks of repeated anchors, equal ones of a slice once, in one row for each destination."""
        for batch in unpacked(batches, 1):
            offsets, data = utf8(batch.column(1))
            key = batch.column(0).to_numpy()
            listed = [(lists.offsets.to_numpy(), lists.values.to_numpy()) for lists in (batch.column(2), batch.column(3))]
            for i, base, gram, lo, hi, doc in anchored(offsets, data):
                # a run belongs to a repeated anchor if its document lists the gram
                repeated, hot = (np.isin(gram, flat[at[doc.min()] : at[doc.max() + 1]]) for at, flat in listed)
                gram, lo, hi, doc, hot = gram[repeated], lo[repeated], hi[repeated], doc[repeated], hot[repeated]
                if not len(gram):
                    continue
                if hot.any():
                    own_hashes = window_hashes(gram_hashes(data[base : base + int(hi.max()) + LENGTH]))
                    gram, lo, hi, doc = single_windows(hot, gram, lo, hi, doc, own_hashes)
                raw = data[base : base + int(hi.max()) + LENGTH].tobytes()
                seen: dict[tuple[int, bytes], int] = {}
                texts = [raw[a:b] for a, b in zip(lo.tolist(), (hi + LENGTH).tolist())]
                block = np.array([seen.setdefault(x, len(seen)) for x in zip(gram.tolist(), texts)], np.int32)
                grams = np.array([g for g, _ in seen], np.int64)
                own = [t for _, t in seen]
                part = (grams.view(np.uint64) % np.uint64(parts)).astype(np.int32)
                place = base + lo - offsets[doc]
                for p in np.unique(part).tolist():
                    mine = np.flatnonzero(part == p)
                    number = np.full(len(own), -1, np.int32)
                    number[mine] = np.arange(len(mine))
                    use = number[block] >= 0
                    row = [grams[mine], np.array([len(own[k]) for k in mine], np.int32), np.frombuffer(b"".join(own[k] for k in mine), np.uint8), number[block[use]], key[doc[use]], place[use].astype(np.int64)]
                    yield pa.RecordBatch.from_arrays([pa.array([p], pa.int32()), *(pa.array([_pack(x)], pa.binary()) for x in row)], names=["part", "grams", "sizes", "bytes", "block", "owner", "place"])

    return run


def repeated_windows(texts: list[bytes], grams: np.ndarray, weight: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """For distinct blocks: first and last window of each run of windows that occur twice or more. weight: occurrences of a block."""
    size = np.array([len(t) for t in texts], np.int64)
    data = np.frombuffer(b"".join(texts) + bytes(LENGTH + 16), np.uint8)
    windows = size - LENGTH + 1
    starts = ranges(np.cumsum(size) - size, windows)
    block = np.repeat(np.arange(len(texts)), windows)
    order, lcp = suffix_order(data, starts, LENGTH)
    kind = np.cumsum(lcp < LENGTH)  # equal windows share a number
    total = np.bincount(kind, weight[block[order]])
    again = np.zeros(len(starts), bool)
    again[order] = total[kind] >= 2
    out = []
    edge = np.cumsum(windows)
    place = np.arange(len(starts)) - np.repeat(edge - windows, windows)
    head = again & ~np.concatenate([[False], again[:-1] & (block[1:] == block[:-1])])
    tail = again & ~np.concatenate([again[1:] & (block[1:] == block[:-1]), [False]])
    heads, tails = np.flatnonzero(head), np.flatnonzero(tail)
    cut = np.searchsorted(block[heads], np.arange(len(texts) + 1))
    for k in range(len(texts)):
        own = slice(cut[k], cut[k + 1])
        out.append((place[heads[own]], place[tails[own]]))
    return out


def _sorted_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by part; each part's distinct blocks are sorted together. (row_key, start, stop) of bytes to remove."""

    def solve(rows):
        seen: dict[tuple[int, bytes], int] = {}
        block, owner, place = [], [], []
        for grams, sizes, raw, number, who, at in rows:
            sizes, raw = _unpack(sizes, np.int32), _unpack(raw, np.uint8).tobytes()
            ends = np.cumsum(sizes).tolist()
            local = np.array([seen.setdefault((g, raw[b - n : b]), len(seen)) for g, b, n in zip(_unpack(grams, np.int64).tolist(), ends, sizes.tolist())], np.int64)
            block.append(local[_unpack(number, np.int32)])
            owner.append(_unpack(who, np.int64))
            place.append(_unpack(at, np.int64))
        block, owner, place = np.concatenate(block), np.concatenate(owner), np.concatenate(place)
        texts = [t for _, t in seen]
        found = repeated_windows(texts, None, np.bincount(block, minlength=len(texts)))
        runs = np.array([len(a) for a, _ in found], np.int64)
        first = np.concatenate([a for a, _ in found]) if found else np.zeros(0, np.int64)
        last = np.concatenate([b for _, b in found]) if found else np.zeros(0, np.int64)
        at = ranges((np.cumsum(runs) - runs)[block], runs[block])
        n = runs[block]
        start, stop = np.repeat(place, n) + first[at], np.repeat(place, n) + last[at] + LENGTH
        who = np.repeat(owner, n)
        # spans of one document that touch become one
        by = np.lexsort((start, who))
        who, start, stop = who[by], start[by], stop[by]
        if len(who):
            new = np.concatenate([[True], (who[1:] != who[:-1]) | (start[1:] > stop[:-1])])
            head = np.flatnonzero(new)
            yield pa.RecordBatch.from_arrays([pa.array(who[head]), pa.array(start[head]), pa.array(np.maximum.reduceat(stop, head))], names=["row_key", "start", "stop"])

    held, part = [], None
    for batch in batches:
        for k, *row in zip(*(c.to_pylist() for c in batch.columns)):
            if k != part and held:
                yield from solve(held)
                held = []
            part = k
            held.append(row)
    if held:
        yield from solve(held)


def repeated_spans(docs: DataFrame) -> DataFrame:
    """docs (row_key long, text): (row_key, spans array<struct<start, stop>>), the byte ranges that repeated windows cover."""
    spark = docs.sparkSession
    grams = stored(docs.select("row_key", "text").mapInArrow(_grams, "row_key long, gram long"))
    # stored, so that Spark can split a gram with very many rows in the join
    often = stored(grams.groupBy("gram").agg(F.count("*").alias("n")).where("n > 1").withColumnRenamed("gram", "often"))
    blocks = often.agg(F.sum(F.when(F.col("n") > HOT, F.col("n") * (LENGTH - GRAM + 1)).otherwise(F.col("n")))).first()[0] or 0
    parts = max(4 * int(spark.conf.get("spark.sql.shuffle.partitions")), -(-blocks // PART_BLOCKS))
    hot = F.collect_set(F.when(F.col("n") > HOT, F.col("gram")))
    lists = grams.join(often, F.col("gram") == F.col("often")).groupBy("row_key").agg(F.collect_set("gram").alias("grams"), hot.alias("hot")).withColumnRenamed("row_key", "list_key")
    rows = packed_texts(docs.select("row_key", "text")).join(lists, F.col("row_key") == F.col("list_key")).select("row_key", "text", "grams", "hot")
    packed = rows.mapInArrow(_blocks(parts), PACKED)
    spans = packed.repartition("part").sortWithinPartitions("part").mapInArrow(_sorted_parts, "row_key long, start long, stop long")
    return spans.groupBy("row_key").agg(F.collect_list(F.struct("start", "stop")).alias("spans"))


def dedup(df: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, n_bytes, kept (binary), n_removed, n_spans: each document without the bytes of repeated windows."""
    docs = df.select("doc_id", F.col(text).alias("text"), F.xxhash64("doc_id", text).alias("row_key"))
    spans = repeated_spans(docs.select("row_key", "text")).withColumnRenamed("row_key", "of_key")
    rows = packed_texts(docs).join(spans, F.col("row_key") == F.col("of_key"), "left").select("doc_id", "text", "spans")
    schema = rows.select("doc_id").withColumns({"n_bytes": F.lit(0).cast("long"), "kept": F.lit(None).cast("binary"), "n_removed": F.lit(0).cast("long"), "n_spans": F.lit(0).cast("long")}).schema

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in unpacked(batches, 1):
            for i, j in slices(utf8(batch.column(1))[0]):
                part = batch.slice(i, j - i)
                offsets, data = utf8(part.column(1))
                keep, spans_ = np.ones(len(data), bool), np.zeros(j - i, np.int64)
                for k, s in enumerate(part.column(2).to_pylist()):
                    last = -1
                    for a, b in sorted((x["start"], x["stop"]) for x in s or ()):
                        keep[offsets[k] + a : offsets[k] + b] = False
                        spans_[k] += a > last
                        last = max(last, b)
                left = np.concatenate([[0], np.cumsum(keep)])[offsets]
                removed = np.diff(offsets) - np.diff(left)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(np.diff(offsets)), binaries(data[keep], left), pa.array(removed), pa.array(spans_)], names=schema.names)

    return rows.mapInArrow(cut, schema)


def op1_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    out = dedup(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def brute_force(texts: list[bytes]) -> list[tuple[int, int, str]]:
    """(n_removed, n_spans, kept_sha256) of each text, window by window; for tests."""
    seen: dict[bytes, int] = {}
    for t in texts:
        for k in range(len(t) - LENGTH + 1):
            seen[t[k : k + LENGTH]] = seen.get(t[k : k + LENGTH], 0) + 1
    out = []
    for t in texts:
        gone = bytearray(len(t))
        for k in range(len(t) - LENGTH + 1):
            if seen[t[k : k + LENGTH]] > 1:
                gone[k : k + LENGTH] = b"\1" * LENGTH
        out.append((sum(gone), len([x for x in bytes(gone).split(b"\0") if x]), sha256(bytes(b for b, g in zip(t, gone) if not g)).hexdigest()))
    return out
