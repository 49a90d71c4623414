"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from molloom.operators.store import kept as stored  # noqa: F401
from molloom.operators.store import shared_dir  # noqa: F401

#: Bytes of text that a task works on at once; longer single texts are worked on alone.
SLICE_BYTES = 3 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def mapped(df: DataFrame, run, schema) -> DataFrame:
    """mapInArrow after which a worker gives its memory back: workers outlive the stages of a job."""

    def tidy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        release()

    return df.mapInArrow(tidy, schema)


def reuse_memory() -> None:
    """Let a worker's large arrays reuse freed memory instead of asking the system for each; release() still gives it back."""
    try:
        libc = ctypes.CDLL("libc.so.6")
        libc.mallopt(-3, 1 << 23)  # M_MMAP_THRESHOLD: larger arrays still go back at once
        libc.mallopt(-1, 1 << 26)  # M_TRIM_THRESHOLD
    except (OSError, AttributeError):  # another C library
        pass


def release() -> None:
    """Return freed memory to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def fold(column: str, n: int) -> Column:
    """crc32 of the id as text, mod n: the split into training and held-out rows. A null id counts as ''."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % n


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Offsets (n + 1) and all bytes of a string or binary column without copying; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    if len(column) == 0:
        return np.zeros(1, np.int64), np.zeros(0, np.uint8)
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    flat = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return ends - ends[0], flat[ends[0] : ends[-1]]


def slices(offsets: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most limit bytes, or one row."""
    n, i = len(offsets) - 1, 0
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + limit, side="right")) - 1
        j = min(max(j, i + 1), n)
        yield i, j
        i = j


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """starts[0], starts[0] + 1, ... for each start, one after the other."""
    lengths = np.asarray(lengths, np.int64)
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(lengths)
    return np.arange(total, dtype=np.int64) + np.repeat(np.asarray(starts, np.int64) - (ends - lengths), lengths)


def binaries(data: np.ndarray, offsets: np.ndarray, kind: pa.DataType = pa.binary()) -> pa.Array:
    """A binary (or string) array over flat bytes."""
    return pa.Array.from_buffers(kind, len(offsets) - 1, [None, pa.py_buffer(np.ascontiguousarray(offsets, np.int32)), pa.py_buffer(np.ascontiguousarray(data, np.uint8))])


def compact(column: pa.Array) -> pa.Array:
    """A string column without offset and nulls (null is empty); pyarrow's if_else() goes wrong on slices."""
    offsets, data = utf8(column)
    return binaries(data, offsets, pa.string())


def keep_columns(df: DataFrame, *used: str) -> list[str]:
    """The input's columns that do not clash with columns that an operator adds."""
    taken = {u.lower() for u in used}
    return [c for c in df.columns if c.lower() not in taken]


def word_index(texts: pa.Array, odd: np.ndarray, odd_words) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Distinct words, each word's number in them, and words of each text.

    Texts are split at single spaces, each part keeping a space in front of it, the first too; those marked odd get
    the words that odd_words(text) returns, as they are.
    """
    texts = compact(texts)
    parts = pc.split_pattern(pc.if_else(pa.array(odd), pa.scalar(None, texts.type), texts), " ")
    counts = pc.fill_null(pc.list_value_length(parts), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    coded = pc.dictionary_encode(parts.flatten())
    words = [" " + w for w in coded.dictionary.to_pylist()]
    number = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    if odd.any():
        seen = {w: k for k, w in enumerate(words)}
        starts, out, last = np.concatenate([[0], np.cumsum(counts)]), [], 0
        for i in np.flatnonzero(odd).tolist():
            own = odd_words(texts[i].as_py() or "")
            out.append(number[last : starts[i]])
            out.append(np.array([seen.setdefault(w, len(seen)) for w in own], np.int64))
            last, counts[i] = starts[i], len(own)
        words, number = list(seen), np.concatenate([*out, number[last:]])
    return words, number, counts


class WordIds:
    """Remembers the ids of words between the slices of a task; starts afresh beyond CACHE_WORDS."""

    CACHE_WORDS = 150_000

    def __init__(self, encode_words):
        self.encode_words = encode_words  # list of words to flat ids and offsets
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.ids, self.at = np.zeros(0, np.int32), np.zeros(1, np.int64)

    def __call__(self, words: list[str], number: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids of texts given by word_index(), and offsets of each text."""
        if len(self.known) > self.CACHE_WORDS:
            self.forget()
        known = self.known
        if fresh := [w for w in words if w not in known]:
            flat, at = self.encode_words(fresh)
            known.update(zip(fresh, range(len(known), len(known) + len(fresh))))
            self.ids, self.at = np.concatenate([self.ids, flat.astype(np.int32)]), np.concatenate([self.at, self.at[-1] + at[1:]])
        which = np.fromiter(map(known.__getitem__, words), np.int64, len(words))[number] if len(words) else number
        sizes = self.at[which + 1] - self.at[which]
        ends = np.concatenate([[0], np.cumsum(sizes)])[np.concatenate([[0], np.cumsum(counts)])]
        return self.ids[ranges(self.at[which], sizes)], ends
