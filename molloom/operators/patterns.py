"""Texts against a table of very many patterns.

Every match of a pattern holds the pattern's longest literal part, so a text that lacks its first bytes (a gram) needs no test. The grams
of all patterns are an index; the grams of a text are read off its bytes, each once, and only the pairs that meet in the index are
verified with the whole expression. Patterns without so long a literal are tested on all texts, in blocks. The plan
does not grow with the number of patterns.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from molloom.operators.store import kept

GRAM = 3
#: Bytes of a gram, by the bytes of its literal; bytes of texts that a task takes at once; bits of a table of grams.
WIDTHS, SLICE, BITS = (8, 5, 3), 1 << 20, 22
#: Rows of the index that are broadcast at most, and short patterns that are tested on a text at once.
BROADCAST_ROWS, BLOCK = 1_000_000, 500
_SPECIAL = set("\\^$.|?*+()[]{}")


def literal(pattern: str) -> str:
    """The longest text that every match of a regular expression holds, '' if there is none that is plain to see.

    Alternatives, groups, classes, escapes but for signs, and inline flags end a literal; a letter that may be missing is none.
    """
    best, now, depth, i = "", "", 0, 0
    if re.search(r"\(\?[a-zA-Z-]", pattern):
        return ""
    while i < len(pattern):
        c = pattern[i]
        step, letter = 1, c
        if c == "\\":
            step, letter = 2, pattern[i + 1 : i + 2]
            if letter in ("Q", "E") or not letter:
                return ""
            letter = letter if not letter.isalnum() else None
        elif c == "[":
            depth_, j = 1, i + 1
            while j < len(pattern) and depth_:  # nested classes as well
                depth_ += {"[": 1, "]": -1 if j > i + 1 and pattern[i + 1 : j] != "^" else 0}.get(pattern[j], 0)
                j += 2 if pattern[j] == "\\" else 1
            step, letter = j - i, None
        elif c == "|" and depth == 0:
            return ""
        elif c in "()":
            depth += 1 if c == "(" else -1
            letter = None
        elif c in _SPECIAL:
            letter = None
        after = pattern[i + step : i + step + 1]
        if after in ("?", "*", "{"):  # may be missing, or come so many times: no literal goes over it
            letter = None
            step += pattern[i + step :].find("}") + 1 if after == "{" else 1
        if letter is None or depth:
            now = ""
        else:
            now += letter
            best = max(best, now, key=len)
            if after == "+":
                now = ""
        i += step
    return best


def width_of(size: int) -> int:
    """Letters (bytes of UTF-8) of the gram of a literal of so many."""
    return next(w for w in WIDTHS if size >= w)


def indexed(patterns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """patterns (number, pattern): (gram, width, number, pattern, plain) of those with a literal of GRAM letters, and the other rows.
    plain: the pattern is its literal."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            f["literal"] = [literal(p) for p in f["pattern"]]
            raw = [x.encode() if len(x) >= GRAM else b"" for x in f["literal"]]
            f["width"] = [width_of(len(x)) if x else 0 for x in raw]
            f["gram"] = [int.from_bytes(x[:w], "little", signed=w == 8) for x, w in zip(raw, f["width"])]
            f["plain"] = f["literal"] == f["pattern"]
            yield f

    kind = dict(patterns.dtypes)["number"]
    rows = kept(patterns.where("pattern IS NOT NULL").select("number", "pattern").mapInPandas(run, f"number {kind}, pattern string, literal string, width int, gram long, plain boolean"))
    return rows.where("width > 0").select("gram", "width", "number", "pattern", "plain"), rows.where("width = 0").select("number", "pattern")


def _grams(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """Of a few texts (second column) at a time: the number of the first, each text's start and end, and all 8-byte grams."""
    column = batch.column(1)
    _, ends, data = column.buffers()
    ends = np.frombuffer(ends, np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)
    flat = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    i = 0
    while i < len(column):
        j = max(i + 1, int(np.searchsorted(ends, ends[i] + SLICE, "right")) - 1)
        some = np.concatenate([flat[ends[i] : ends[j]], np.zeros(8, np.uint8)])
        n = len(some) - 8
        grams = np.zeros(n, np.uint64)
        for k in range(8):
            grams |= some[k : k + n].astype(np.uint64) << np.uint64(8 * k)
        yield i, ends[i:j] - ends[i], ends[i + 1 : j + 1] - ends[i], grams
        i = j


def _narrow(grams: np.ndarray, width: int) -> np.ndarray:
    return grams & np.uint64((1 << 8 * width) - 1)


def _within(spots: np.ndarray, starts: np.ndarray, ends: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Places at which a whole gram lies in one text, and that text."""
    text = np.searchsorted(starts, spots, "right") - 1
    use = spots + width <= ends[text]
    return spots[use], text[use]


class _Index:
    """The grams of an index by width, behind a table of bits that most grams of a text fail at."""

    def __init__(self, table: pa.Table):
        self.number, self.pattern, self.plain = (table.column(c).to_pylist() for c in ("number", "pattern", "plain"))
        self.raw = [p.encode() if q else b"" for p, q in zip(self.pattern, self.plain)]
        gram, width = table.column("gram").to_numpy().astype(np.int64).view(np.uint64), table.column("width").to_numpy()
        self.by_width = {}
        for w in np.unique(width).tolist():
            rows = np.flatnonzero(width == w)
            rows = rows[np.argsort(gram[rows], kind="stable")]
            keys, first = np.unique(gram[rows], return_index=True)
            seen = np.zeros(1 << BITS, bool)
            seen[self.spot(keys)] = True
            self.by_width[w] = keys, np.append(first, len(rows)), rows.tolist(), seen

    @staticmethod
    def spot(keys: np.ndarray) -> np.ndarray:
        return keys * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - BITS)

    def met(self, batch: pa.RecordBatch) -> Iterator[tuple[int, int]]:
        """(text of the batch, row of the index) whose gram the text holds."""
        for first_text, starts, ends, grams in _grams(batch):
            for w, (keys, first, rows, seen) in self.by_width.items():
                own = _narrow(grams, w)
                spots, text = _within(np.flatnonzero(seen[self.spot(own)]), starts, ends, w)
                at = np.minimum(np.searchsorted(keys, own[spots]), len(keys) - 1)
                hit = keys[at] == own[spots]
                for pair in np.unique(text[hit] * len(keys) + at[hit]).tolist():
                    t, g = divmod(pair, len(keys))
                    for k in range(first[g], first[g + 1]):
                        yield first_text + t, rows[k]


def _found(rows: DataFrame, index: DataFrame, kind: str) -> DataFrame:
    """(key, number) by an index that every task holds. A plain pattern is decided by its bytes, others by RLIKE."""
    every = index.toArrow()  # BROADCAST_ROWS rows at most
    schema = pa.schema([pa.field("text", pa.string()), pa.field("sure", pa.list_(every.schema.field("number").type)), pa.field("numbers", pa.list_(every.schema.field("number").type)), pa.field("patterns", pa.list_(pa.string()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _Index(every)
        for batch in batches:
            sure: dict[int, list] = {}
            maybe: dict[int, list] = {}
            raw: dict[int, bytes] = {}
            for t, k in own.met(batch):
                if not own.plain[k]:
                    maybe.setdefault(t, []).append(k)
                elif len(own.raw[k]) in WIDTHS or own.raw[k] in (raw.get(t) or raw.setdefault(t, batch.column(1)[t].as_py().encode())):
                    sure.setdefault(t, []).append(own.number[k])
            texts = sorted({*sure, *maybe})
            columns = [[batch.column(1)[t].as_py() if t in maybe else None for t in texts], [sure.get(t, []) for t in texts], [[own.number[k] for k in maybe.get(t, [])] for t in texts], [[own.pattern[k] for k in maybe.get(t, [])] for t in texts]]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(texts, pa.int64())), *(pa.array(c, f.type) for c, f in zip(columns, schema))], names=["key", *schema.names])

    out = rows.mapInArrow(run, f"key {dict(rows.dtypes)['key']}, text string, sure array<{kind}>, numbers array<{kind}>, patterns array<string>")
    told = F.filter(F.arrays_zip("numbers", "patterns"), lambda p: F.call_function("rlike", F.col("text"), p["patterns"]))
    return out.select("key", F.explode(F.concat("sure", F.transform(told, lambda p: p["numbers"]))).alias("number"))


def _dealt(rows: DataFrame, index: DataFrame) -> DataFrame:
    """(key, number) by an index of any size: keys and grams alone are dealt; texts come back for the pairs."""
    kind, widths = dict(rows.dtypes)["key"], [r[0] for r in index.select("width").distinct().collect()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, starts, ends, grams in _grams(batch):
                for w in widths:
                    own = _narrow(grams, w)
                    spots, text = _within(np.arange(len(own)), starts, ends, w)
                    order = np.lexsort((own[spots], text))
                    text, gram = text[order], own[spots][order]
                    new = np.ones(len(text), bool)
                    new[1:] = (text[1:] != text[:-1]) | (gram[1:] != gram[:-1])
                    text, gram = text[new], gram[new]
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(i + text)), pa.array(gram.view(np.int64)), pa.array(np.full(len(gram), w, np.int32))], names=["of_key", "of_gram", "of_width"])

    each = rows.mapInArrow(run, f"of_key {kind}, of_gram long, of_width int")
    slim = each.join(index, (F.col("of_gram") == F.col("gram")) & (F.col("of_width") == F.col("width"))).select("of_key", "number", "pattern")
    met = rows.join(kept(slim), F.col("key").eqNullSafe(F.col("of_key"))).select("key", "text", "number", "pattern")
    return met.where(F.expr("text RLIKE pattern")).select("key", "number")


def matches(texts: DataFrame, patterns: DataFrame, key: str = "key", text: str = "text") -> DataFrame:
    """texts (key, text), patterns (number, pattern): (key, number) of every text, by its key, and every pattern that is found in it.

    Null texts and patterns match nothing. Rows with one key count together.
    """
    index, short = indexed(patterns)
    rows = texts.where(F.col(text).isNotNull()).select(F.col(key).alias("key"), F.col(text).alias("text"))
    out = _found(rows, index, dict(patterns.dtypes)["number"]) if index.count() <= BROADCAST_ROWS else _dealt(rows, index)
    n = short.count()
    blocks = -(-n // BLOCK)
    for b in range(blocks):
        part = short.where(F.pmod(F.xxhash64("number", "pattern"), F.lit(blocks)) == b).agg(F.collect_list(F.struct("number", "pattern")).alias("block"))
        found = rows.join(F.broadcast(part)).select("key", F.explode(F.filter("block", lambda p: F.call_function("rlike", F.col("text"), p["pattern"]))).alias("p"))
        out = out.unionByName(found.select("key", "p.number"))
    return out.distinct()


def first_matches(texts: DataFrame, patterns: DataFrame, key: str = "key", text: str = "text") -> DataFrame:
    """(key, number): of each text the least number of a pattern that is found in it; texts without one have null."""
    found = matches(texts, patterns, key, text).groupBy(F.col("key").alias("of_key")).agg(F.min("number").alias("number"))
    return texts.select(F.col(key).alias("key")).join(found, F.col("key").eqNullSafe(F.col("of_key")), "left").select("key", "number")
