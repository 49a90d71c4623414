"""Line dedup by content-defined chunks.

A document's lines are hashed, and a rolling hash over WINDOW line hashes chooses the boundaries: behind lines where its
low bits are zero, so that chunks are the same wherever a passage lies and an inserted line changes only the chunks around
it. Chunks that occur more than once anywhere are removed but for their first occurrence (least document, then place),
after their bytes have been compared with that occurrence's.

What a repeated passage has before its first and behind its last boundary is found by extension line by line: every
WINDOW lines are a chunk too. Those within a repeated chunk are not compared again; they are only where a chunk's hash agrees and its
bytes do not. So a repeated passage of two lines is found wherever it lies, and a long one costs a comparison for each of its chunks.

A line goes if a removed chunk holds it; where a chunk overlaps its own first occurrence (equal lines in a row), the
line that they share stays. Each line that goes equals one at an earlier place, so one of each stays.

Lines are never removed singly: one that repeats goes only with a neighbour that repeats beside it. Null texts have
no chunks and stay null; empty texts stay empty; removing all lines leaves ''. Rows with one id and text are one document,
with one result; rows of one id with different texts are documents of their own, known by hashes of their text. Rows without
id are never removed from. Columns of the input are kept; n_lines and n_removed_lines replace columns of their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import keep_columns, mapped, ranges, slices, stored, table, utf8

WINDOW = 2
LINES = re.compile(b"[^\n]*\n|[^\n]+")
PRIME = np.uint64(0x9E3779B185EBCA87)
#: A boundary stands where these bits of the rolling hash are zero: behind one line in four.
BOUNDARY = np.uint64(3)


def lines_of(text: bytes) -> list[bytes]:
    """Lines without their ends: the last line counts as ended, so that it can equal one within a text."""
    return [x.removesuffix(b"\n") for x in LINES.findall(text)]


def rolled(lines: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Line hashes, and the rolling hash of WINDOW of them at each line; the last lines have none."""
    hashes = np.array([xxhash.xxh64_intdigest(x, 7) for x in lines], np.uint64)
    n = max(len(lines) - WINDOW + 1, 0)
    out = np.zeros(n, np.uint64)
    for d in range(WINDOW):
        out = out * PRIME + hashes[d : d + n]
    return hashes, out ^ out >> np.uint64(32)


def chunk_places(lines: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place, lines, hash) of a text's chunks: WINDOW lines from each line, and those between boundaries that are longer."""
    hashes, windows = rolled(lines)
    ends = np.flatnonzero((windows & BOUNDARY) == 0) + WINDOW
    edges = np.unique(np.concatenate([[0], ends, [len(lines)]])).astype(np.int64)
    start, size = edges[:-1], np.diff(edges)
    start, size = start[size > WINDOW], size[size > WINDOW]
    whole = np.array([xxhash.xxh64_intdigest(hashes[p : p + n].tobytes(), n) for p, n in zip(start.tolist(), size.tolist())], np.uint64)
    places = np.concatenate([np.arange(len(windows)), start])
    return places, np.concatenate([np.full(len(windows), WINDOW), size]), np.concatenate([windows, whole])


def chunks(text: bytes) -> list[tuple[int, bytes]]:
    """(lines, bytes) of all chunks."""
    lines = lines_of(text)
    place, size, _ = chunk_places(lines)
    return [(n, b"\n".join(lines[p : p + n])) for p, n in zip(place.tolist(), size.tolist())]


def _chunk_rows(batches: Iterator[pa.RecordBatch], bits: int) -> Iterator[pa.RecordBatch]:
    """(doc_id, k, place, lines, chunk) of every chunk."""
    mask = np.uint64((1 << bits) - 1)
    for batch in batches:
        for i, j in slices(utf8(batch.column(2))[0]):
            part = batch.slice(i, j - i)
            at, data = utf8(part.column(2))
            raw = data.tobytes()
            own = [chunk_places(lines_of(raw[a:b])) for a, b in zip(at[:-1].tolist(), at[1:].tolist())]
            who = pa.array(np.repeat(np.arange(j - i), [len(x[0]) for x in own]))
            place, size, chunk = (np.concatenate([x[c] for x in own]) for c in range(3))
            yield pa.RecordBatch.from_arrays([part.column(0).take(who), part.column(1).take(who), pa.array(place.astype(np.int32)), pa.array(size.astype(np.int32)), pa.array((chunk & mask).view(np.int64))], names=["doc_id", "k", "place", "lines", "chunk"])


def _bodies(batches: Iterator[pa.RecordBatch], bits: int, all_windows: bool) -> Iterator[pa.RecordBatch]:
    """Of the chunks asked for, those that a row's text holds, with body: the chunk as a zstandard frame, less to
    shuffle, and two frames of one compressor are equal exactly if their bytes are. Unless all_windows, those windows are
    left out that lie within a longer chunk that is asked for as a repetition."""
    pack = zstandard.ZstdCompressor(level=3, write_content_size=False, write_checksum=False).compress
    mask = (1 << bits) - 1
    for batch in batches:
        for i, j in slices(utf8(batch.column(2))[0]):
            part = batch.slice(i, j - i)
            who, second, place, size, chunk, keep, body = [], [], [], [], [], [], []
            for row, (text, asked) in enumerate(zip(part.column(2).to_pylist(), part.column(3).to_pylist())):
                lines = lines_of(text.encode())
                known = {(p, n): h & mask for p, n, h in zip(*(x.tolist() for x in chunk_places(lines)))}
                own = [x for x in asked if known.get((x["place"], x["lines"])) == x["chunk"] & mask]
                covered = np.zeros(len(lines) + 1, np.int64)  # the end of the repeated chunk that holds a line
                for x in own:
                    if x["lines"] > WINDOW and x["keep_place"] != -1:
                        covered[x["place"] : x["place"] + x["lines"]] = x["place"] + x["lines"]
                mark = xxhash.xxh64_intdigest(text, 17) - (1 << 63)
                for x in own:
                    p, n = x["place"], x["lines"]
                    if not all_windows and n == WINDOW and covered[p] >= p + WINDOW:
                        continue
                    for to, value in zip((who, second, place, size, chunk, keep, body), (row, mark, p, n, x["chunk"], x["keep_place"], pack(b"\n".join(lines[p : p + n])))):
                        to.append(value)
            of = pa.array(who, pa.int64())
            columns = [part.column(0).take(of), part.column(1).take(of), pa.array(second, pa.int64()), pa.array(place, pa.int32()), pa.array(size, pa.int32()), pa.array(chunk, pa.int64()), pa.array(keep, pa.int32()), pa.array(body, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "k", "k2", "place", "lines", "chunk", "keep_place", "body"])


def named(docs: DataFrame, text: str) -> DataFrame:
    """docs with k, a hash of the text: rows of one id with different texts are told apart. A second hash is checked with the bytes."""
    return docs.withColumn("__k", F.xxhash64(text))


def repeated_chunks(docs: DataFrame, bits: int = 64) -> DataFrame:
    """docs (doc_id, __k, text): (doc_id, k, k2, places array<int>), the lines to remove. bits: of the chunk hashes."""
    kind = dict(docs.dtypes)["doc_id"]
    docs = docs.where("doc_id IS NOT NULL AND text IS NOT NULL").select("doc_id", F.col("__k").alias("k"), "text")
    rows = stored(mapped(docs, partial(_chunk_rows, bits=bits), f"doc_id {kind}, k long, place int, lines int, chunk long"))
    spot = F.struct("doc_id", "k", "place")
    first = rows.groupBy("chunk", "lines").agg(F.min(spot).alias("keep"), F.max(spot).alias("last")).where("keep <> last").select(F.col("chunk").alias("of_chunk"), F.col("lines").alias("of_lines"), "keep")
    first = stored(first)  # both sides of the join are shuffled for it, so a chunk of very many rows can be split
    # keep_place: -1 at the first occurrence, its place where it lies in the same document, -2 elsewhere
    elsewhere = (F.col("doc_id") != F.col("keep.doc_id")) | (F.col("k") != F.col("keep.k"))
    place = F.when(elsewhere, -2).when(F.col("place") == F.col("keep.place"), -1).otherwise(F.col("keep.place"))
    found = rows.join(first, (F.col("chunk") == F.col("of_chunk")) & (F.col("lines") == F.col("of_lines"))).select("doc_id", "k", F.struct("place", "lines", "chunk", place.alias("keep_place")).alias("one"))
    asked = found.groupBy(F.col("doc_id").alias("of_doc"), F.col("k").alias("of_k")).agg(F.collect_set("one").alias("asked"))
    texts = docs.join(asked, (F.col("doc_id") == F.col("of_doc")) & (F.col("k") == F.col("of_k"))).select("doc_id", "k", "text", "asked")

    def compared(all_windows: bool) -> DataFrame:
        bodies = stored(mapped(texts, partial(_bodies, bits=bits, all_windows=all_windows), f"doc_id {kind}, k long, k2 long, place int, lines int, chunk long, keep_place int, body binary"))
        keepers = bodies.where("keep_place = -1").groupBy("chunk", "lines").agg(F.min("body").alias("kept_body")).select(F.col("chunk").alias("kept_chunk"), F.col("lines").alias("kept_lines"), "kept_body")
        keepers = stored(keepers)
        both = bodies.where("keep_place <> -1").join(keepers, (F.col("chunk") == F.col("kept_chunk")) & (F.col("lines") == F.col("kept_lines")))
        return stored(both.select("doc_id", "k", "k2", "place", "lines", "keep_place", (F.col("body") == F.col("kept_body")).alias("same")))

    same = compared(False)
    if same.where(f"NOT same AND lines > {WINDOW}").limit(1).count():  # a shared hash: the windows decide everywhere
        same = compared(True)
    same = same.where("same")
    # of a chunk that overlaps its first occurrence, only the lines behind that go
    begin = F.when(F.col("keep_place") >= 0, F.greatest("place", F.col("keep_place") + F.col("lines"))).otherwise(F.col("place"))
    lines = F.filter(F.sequence(F.col("place"), F.col("place") + F.col("lines") - 1), lambda p: p >= begin)
    return same.select("doc_id", "k", "k2", lines.alias("lines")).groupBy("doc_id", "k", "k2").agg(F.array_distinct(F.flatten(F.collect_set("lines"))).alias("places"))


def dedup(df: DataFrame, text: str = "text", bits: int = 64) -> DataFrame:
    """The input with the lines of repeated chunks cut from its text, n_lines (long, before) and n_removed_lines (long)."""
    kept = keep_columns(df, "n_lines", "n_removed_lines")
    own = named(df.select("doc_id", F.col(text).alias("text")), "text")
    gone = repeated_chunks(own, bits).select(F.col("doc_id").alias("__of_doc"), F.col("k").alias("__of_k"), F.struct("k2", "places").alias("__places"))
    rows = named(df.select(kept), text).join(gone, (F.col("doc_id") == F.col("__of_doc")) & (F.col("__k") == F.col("__of_k")), "left").select(*kept, "__places")
    schema = df.select(kept).withColumns({"n_lines": F.lit(0).cast("long"), "n_removed_lines": F.lit(0).cast("long")}).schema
    where = kept.index(text)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j in slices(utf8(batch.column(where))[0]):
                part = batch.slice(i, j - i)
                texts, places = part.column(where).to_pylist(), part.column(len(kept)).to_pylist()
                out, total, removed = [], [], []
                for t, gone in zip(texts, places):
                    if not gone or t is None or gone["k2"] != xxhash.xxh64_intdigest(t, 17) - (1 << 63):
                        total.append(0 if not t else t.count("\n") + (not t.endswith("\n")))
                        removed.append(0)
                        out.append(t)
                        continue
                    own, gone = LINES.findall(t.encode()), set(gone["places"])
                    left = [x for p, x in enumerate(own) if p not in gone]
                    total.append(len(own))
                    removed.append(len(own) - len(left))
                    out.append(b"".join(left).decode())
                columns = list(part.columns[: len(kept)])
                columns[where] = pa.array(out, pa.string())
                yield pa.RecordBatch.from_arrays([*columns, pa.array(total, pa.int64()), pa.array(removed, pa.int64())], names=schema.names)

    return mapped(rows, cut, schema)


def op4_line_chunks(spark, sf_dir: str) -> DataFrame:
    """(doc_id, n_lines, n_removed_lines, text_sha256, text) of every document."""
    out = dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_removed_lines", F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"), "text")


def brute_force(docs: list[tuple[int, str | None]]) -> dict[int, tuple[str | None, int]]:
    """{doc_id: (text, removed lines)}, for tests; ids are distinct. By windows alone: whole chunks must not change it."""
    seen, out = {}, {}
    for d, t in sorted(docs, key=lambda x: x[0]):
        if t is None:
            out[d] = (None, 0)
            continue
        own = t.split("\n")
        ended = [x + "\n" for x in own[:-1]] + own[-1:] * bool(own[-1])
        own, gone = own[: len(ended)], set()
        for k in range(len(own) - 1):
            before = seen.setdefault((own[k], own[k + 1]), (d, k))
            if before != (d, k):
                gone |= {k + 1} if before == (d, k - 1) else {k, k + 1}
        out[d] = ("".join(x for k, x in enumerate(ended) if k not in gone), len(gone))
    return out
