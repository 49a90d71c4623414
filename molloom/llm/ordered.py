"""Running values along a total order of all rows, range by range.

Ranges are sorted apart and sum up their own rows; what lies before a range is one row a range, which the driver adds
up. So no key, however many rows it has, comes to one task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mapped, stored


def running(df: DataFrame, order: list[str], values: list[str], segment: str | None = None, xor: bool = False) -> DataFrame:
    """df with the long columns in values replaced by their sums (or exclusive ors) from the first row of the order, or
    of the row's segment, up to the row itself. order begins with segment and tells rows apart, or ties may come either way."""
    kinds = dict(df.dtypes)
    add = np.bitwise_xor if xor else np.add
    schema = df.withColumns({"__part": F.lit(0), "__at": F.lit(0).cast("long"), "__open": F.lit(True), "__key": F.col(segment) if segment else F.lit(0)}).schema
    where = [df.columns.index(v) for v in values]
    key_at = df.columns.index(segment) if segment else None

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, at, last, opened = TaskContext.get().partitionId(), 0, None, True
        state = [np.int64(0)] * len(values)
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            starts = np.zeros(n, bool)
            if key_at is not None:
                keys = batch.column(key_at)
                coded = keys.dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
                starts[1:] = coded[1:] != coded[:-1]
                starts[0] = at > 0 and keys[0].as_py() != last
                last = keys[n - 1].as_py()
            heads = np.flatnonzero(starts)
            columns = list(batch.columns)
            for j, w in enumerate(where):
                x = batch.column(w).to_numpy(zero_copy_only=False).astype(np.int64)
                x[0] = add(x[0], np.int64(0) if starts[0] else state[j])
                run = add.accumulate(x)
                if len(heads):
                    before = np.concatenate([[0], run[heads - 1]]) if heads[0] else np.concatenate([[0], [0], run[heads[1:] - 1]])
                    run = (np.bitwise_xor if xor else np.subtract)(run, before[np.cumsum(starts)])
                state[j] = run[-1]
                columns[w] = pa.array(run)
            # rows before the first change of key may belong to a segment that began in an earlier range
            open_ = np.cumsum(starts) == 0 if opened else np.zeros(n, bool)
            opened = bool(open_[-1])
            columns += [pa.array(np.full(n, part, np.int32)), pa.array(np.arange(at, at + n)), pa.array(open_), batch.column(key_at) if key_at is not None else pa.array(np.zeros(n, np.int32))]
            at += n
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    dealt = stored(mapped(df.repartitionByRange(*order).sortWithinPartitions(*order), local, schema))
    ends = dealt.groupBy("__part").agg(F.min_by(F.struct("__key"), "__at").alias("first"), F.max_by(F.struct("__key", "__open", *values), "__at").alias("last")).orderBy("__part").collect()  # a row a range
    rows, carry, before = [], [0] * len(values), None
    for r in ends:
        goes_on = before is not None and r.first["__key"] == before
        carry = carry if goes_on else [0] * len(values)
        rows.append((r["__part"], *carry))
        own = [r.last[v] for v in values]
        carry = [a ^ b if xor else a + b for a, b in zip(carry, own)] if r.last["__open"] else own
        before = r.last["__key"]
    offsets = df.sparkSession.createDataFrame(rows, ", ".join(["__of int", *(f"__before{j} long" for j in range(len(values)))]))
    both = dealt.join(F.broadcast(offsets), F.col("__part") == F.col("__of"))
    total = lambda v, j: F.when(F.col("__open"), F.col(v).bitwiseXOR(F.col(f"__before{j}")) if xor else F.col(v) + F.col(f"__before{j}")).otherwise(F.col(v)).cast(kinds[v])
    return both.select(*(total(c, values.index(c)).alias(c) if c in values else c for c in df.columns))


def numbered(df: DataFrame, order: list[str], name: str, segment: str | None = None) -> DataFrame:
    """Adds name (long): the place of each row in the order, from 1, or in its segment."""
    return running(df.withColumn(name, F.lit(1).cast("long")), order, [name], segment)
