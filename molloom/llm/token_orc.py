"""Token ids in ORC files.

Documents are dealt to files by ranges of their id and sorted, so that the files in name order hold ascending ids.
ORC keeps the ids with integer run-length encoding; row indexes and Bloom filters on the document id let a reader
skip stripes and row groups from metadata alone, and stripes are read in parallel. Each row also holds its start
within its file; a reader adds the sizes of the files before.

Ids are those of the tokenizers library as it loads, so the special token's own string in a text is one id. Texts go
to a faster encoder of the same vocabulary (its ranks file); those with the special string or a very long run of
white space, which that encoder does not take, go to the library.

Null and empty texts hold the end id alone. Rows without id come first; rows with one id stand in the order of their
texts' hash (equal texts have equal ids, so every order of these is the same). Tables without rows give no rows.
"""

from __future__ import annotations

import base64
import json
import os
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import mapped, shared_dir, slices, stored, table, utf8

#: A run of white space that the faster encoder may not be able to split.
LONG_SPACE = r"[\s\x0B\x{85}\p{Z}]{1000}"
#: Files whose starts are broadcast at most; more are joined by shuffling.
BROADCAST_FILES = 100_000
ORC = {"orc.bloom.filter.columns": "doc_id", "orc.bloom.filter.fpp": "0.01", "orc.row.index.stride": "2000", "orc.stripe.size": str(16 << 20), "orc.compress": "ZSTD"}


def special_tokens(json_path: str) -> list[str]:
    """The vocabulary's added tokens, which the library takes out of texts as they are."""
    with open(json_path, encoding="utf-8") as f:
        return [t["content"] for t in json.load(f).get("added_tokens") or []]


class Encoder:
    """The tokenizers library beside, with a ranks file of the same vocabulary, a faster encoder for plain texts. The library is
    loaded when a text needs it, so that most workers hold one vocabulary."""

    def __init__(self, json_path: str, ranks_path: str | None, special: tuple[str, ...] | None = None):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.json_path, self.loaded, self.fast = json_path, None, None
        self.odd = "|".join([*(r"\Q" + t + r"\E" for t in (special_tokens(json_path) if special is None else special)), LONG_SPACE])
        if ranks_path:
            import public_tokenizers
            import tiktoken

            with open(ranks_path, "rb") as f:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            self.fast = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    @property
    def whole(self):
        if self.loaded is None:
            from tokenizers import Tokenizer

            self.loaded = Tokenizer.from_file(self.json_path)
        return self.loaded

    def library(self, text: str) -> list[int]:
        return self.whole.encode_batch_fast([text], add_special_tokens=False)[0].ids

    def __call__(self, texts: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids, each text's followed by the end id, and offsets."""
        texts = pc.fill_null(texts, "")
        odd = pc.match_substring_regex(texts, self.odd).to_pylist() if self.fast else [True] * len(texts)
        lists = []
        for text, o in zip(texts, odd):  # one text as Python numbers at a time
            ids = (self.library if o else self.fast)(text.as_py())
            ids.append(end_id)
            lists.append(np.array(ids, np.int32))
        at = np.concatenate([[0], np.cumsum([len(x) for x in lists])]).astype(np.int64)
        return np.concatenate([np.zeros(0, np.int32), *lists]), at


@lru_cache(maxsize=2)
def encoder(json_path: str, ranks_path: str | None, special: tuple[str, ...] | None = None) -> Encoder:
    return Encoder(json_path, ranks_path, special)


def write(df: DataFrame, path: str, json_path: str, ranks_path: str | None = None, text: str = "text", end_id: int = 0) -> None:
    """Write (doc_id, start_in_file, n_tokens, ids) as ORC files in ascending doc_id order."""
    tie = F.xxhash64(F.coalesce(F.col(text), F.lit("")))
    rows = df.select("doc_id", F.col(text).alias("text"), tie.alias("tie")).repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie").drop("tie")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, start = encoder(json_path, ranks_path, special), 0
        for batch in batches:
            for i, j in slices(utf8(batch.column(1))[0]):
                ids, at = encode(batch.column(1).slice(i, j - i), end_id)
                lists = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(ids))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(start + at[:-1]), pa.array(np.diff(at)), lists], names=["doc_id", "start_in_file", "n_tokens", "ids"])
                start += int(at[-1])

    special = tuple(special_tokens(json_path))
    kind = dict(df.dtypes)["doc_id"]
    out = mapped(rows, run, f"doc_id {kind}, start_in_file long, n_tokens long, ids array<int>")
    out.write.options(**ORC).orc(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids) of files that write() made; start counts the ids of all rows before."""
    rows = spark.read.orc(path).withColumn("file", F.col("_metadata.file_name"))
    # one row a file; ranges ascend by the number of the task that wrote them
    number = F.regexp_extract("file", r"part-([0-9]+)", 1).cast("long")
    files = rows.groupBy("file").agg(F.sum("n_tokens").alias("size"))
    before = stored(files.select(F.col("file").alias("of_file"), (F.sum("size").over(Window.orderBy(number, "file")) - F.col("size")).alias("before")))
    if before.count() <= BROADCAST_FILES:
        before = F.broadcast(before)
    return rows.join(before, F.col("file") == F.col("of_file")).select("doc_id", (F.col("before") + F.col("start_in_file")).alias("start"), "n_tokens", "ids")


def lookup(spark: SparkSession, path: str, ids: list[int]) -> DataFrame:
    """Rows of some documents; row groups whose Bloom filter or range excludes the ids are not read."""
    return spark.read.orc(path).where(F.col("doc_id").isin(ids))


def crc32_of_ids(df: DataFrame, ids: str = "ids") -> DataFrame:
    """Replaces the ids by ids_crc32 (long): crc32 of the ids as little-endian unsigned 32-bit integers."""
    kept = [c for c in df.columns if c != ids]
    schema = df.select(kept).withColumn("ids_crc32", F.lit(0).cast("long")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(len(kept))
            at, raw = lists.offsets.to_numpy(), lists.values.to_numpy(zero_copy_only=False).astype("<u4").tobytes()
            sums = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist())]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], pa.array(sums, pa.int64())], names=schema.names)

    return mapped(df.select(*kept, ids), run, schema)


def op7_token_orc(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = shared_dir(spark)
    write(table(spark, sf_dir, "documents"), path, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"))
    return crc32_of_ids(read(spark, path))
