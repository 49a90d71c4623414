"""Quality classifier by compression.

Two zstandard dictionaries are built, one from good and one from bad labelled texts. A text is compressed with each,
in blocks so that the dictionary counts in all of a long text; the difference of the two sizes over their sum, with
its lower quantile over the blocks, becomes a probability by logistic regression fitted on other labelled texts.

The fit uses a bounded sample: the SAMPLE rows of each label with the smallest hash of their id make dictionaries,
the next SAMPLE rows calibrate. Scores cover every whole text. Empty and null texts get the share of label 1 among
the training labels (0.5 without labels). Ties in the sample go by id, repeated rows get equal scores, added columns
replace columns of their names. With one label missing every text gets that share.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fold, keep_columns, slices, table, utf8

#: Labelled rows of each label that make a dictionary, and as many more that calibrate.
SAMPLE = 1500
#: Bytes of text of each label that make a dictionary, and of a dictionary.
DICTIONARY_TEXT, DICTIONARY_BYTES = 3_000_000, 65_536
BLOCK, LEVEL = 512, 3
#: Blocks of fewer bytes say nothing about repetition; texts that have no other count as usual.
LEAST, USUAL = 128, -0.9
#: Quantile of the blocks that stands for a text's worst part; the least block would single out long texts.
TAIL = 0.2


def blocks(data: bytes) -> list[bytes]:
    return [data[i : i + BLOCK] for i in range(0, len(data), BLOCK)]


def dictionary(texts: list[str]) -> bytes:
    """A dictionary from blocks of the texts; few or small texts are the dictionary themselves."""
    parts, total = [], 0
    for t in texts:
        if total >= DICTIONARY_TEXT:
            break
        parts += blocks(t.encode())
        total += len(t)
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, parts).as_bytes()
    except zstandard.ZstdError:
        return b"".join(parts)[-DICTIONARY_BYTES:]


class Sizes:
    """Compressed sizes with each dictionary."""

    def __init__(self, good: bytes, bad: bytes):
        self.packers = []
        for raw in (good, bad):
            d = zstandard.ZstdCompressionDict(raw)
            d.precompute_compress(level=LEVEL)
            self.packers.append(zstandard.ZstdCompressor(dict_data=d, write_checksum=False, write_content_size=False, write_dict_id=False))

    def features(self, data: bytes) -> tuple[float, float, float, float]:
        """Normalised difference, its lower TAIL over the blocks, the smaller size a byte, and its logarithm's lower TAIL."""
        parts = blocks(data)
        good, bad = (np.array([len(p.compress(b)) for b in parts], float) for p in self.packers)
        each = (bad - good) / (bad + good)
        g, b = good.sum(), bad.sum()
        dense = np.log(np.minimum(good, bad) / np.array([max(len(x), LEAST) for x in parts]))
        low = float(np.quantile(dense[[len(x) >= LEAST for x in parts]], TAIL)) if len(data) >= LEAST else USUAL
        return (b - g) / (b + g), float(np.quantile(each, TAIL)), min(g, b) / len(data), low


def logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Weights, the constant last, by Newton steps with a small ridge."""
    x = np.column_stack([x, np.ones(len(x))])
    w, ridge = np.zeros(x.shape[1]), np.eye(x.shape[1]) * 1e-2
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge, x.T @ (y - p) - ridge @ w)
        w += step
        if np.abs(step).max() < 1e-9:
            break
    return w


def train(df: DataFrame, text: str = "text", label: str = "quality", order: str = "doc_id") -> dict:
    """df: labelled rows. A model of bounded size; the sample is collected, 4 * SAMPLE rows at most."""
    rows = df.where(F.col(label).isin(0, 1)).select(F.col(order).alias("id"), F.col(text).alias("text"), F.col(label).cast("int").alias("y"))
    share = rows.agg(F.avg("y")).first()[0]
    model = {"share": 0.5 if share is None else float(share), "good": None}
    picked = {}
    for y in (0, 1):
        full = rows.where((F.col("y") == y) & (F.length("text") > 0))
        ids = full.select("id", F.xxhash64("id").alias("h")).dropDuplicates().orderBy("h", "id").limit(2 * SAMPLE).withColumnRenamed("id", "pick")
        got = full.join(F.broadcast(ids), F.col("id").eqNullSafe(F.col("pick")), "left_semi").withColumn("h", F.xxhash64("id")).orderBy("h", "id").limit(2 * SAMPLE)
        picked[y] = [r[0] for r in got.select("text").collect()]
    if min(map(len, picked.values())) < 2:
        return model
    half = {y: max(1, min(SAMPLE, len(t) // 2)) for y, t in picked.items()}
    good, bad = (dictionary(picked[y][: half[y]]) for y in (1, 0))
    sizes = Sizes(good, bad)
    pairs = [(sizes.features(t.encode()), y) for y in (0, 1) for t in picked[y][half[y] :]]
    x, y = np.array([p[0] for p in pairs]), np.array([p[1] for p in pairs], float)
    centre, spread = x.mean(0), x.std(0) + 1e-9
    w = logistic((x - centre) / spread, y)
    # the sample holds both labels alike: put the share of all training labels back
    prior = np.log(np.clip(model["share"], 1e-6, 1 - 1e-6) / np.clip(1 - model["share"], 1e-6, 1)) - np.log(y.mean() / (1 - y.mean()))
    w[-1] += prior
    return model | {"good": good, "bad": bad, "centre": centre, "spread": spread, "w": w}


def score(df: DataFrame, model: dict, text: str = "text") -> DataFrame:
    """Adds score (double)."""
    kept = keep_columns(df, "score")
    schema = df.select(kept).withColumn("score", F.lit(None).cast("double")).schema
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        sizes = Sizes(m["good"], m["bad"]) if m["good"] is not None else None
        for batch in batches:
            texts = batch.column(kept.index(text))
            for i, j in slices(utf8(texts)[0]):
                offsets, data = utf8(texts.slice(i, j - i))
                raw, out = data.tobytes(), np.full(j - i, m["share"])
                if sizes:
                    full = np.flatnonzero(np.diff(offsets))
                    x = np.array([sizes.features(raw[offsets[k] : offsets[k + 1]]) for k in full]).reshape(-1, 4)
                    z = (x - m["centre"]) / m["spread"] @ m["w"][:-1] + m["w"][-1]
                    out[full] = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
                yield pa.RecordBatch.from_arrays([*batch.slice(i, j - i).columns, pa.array(out)], names=schema.names)

    return df.select(kept).mapInArrow(run, schema)


def op10_quality_compression(spark, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels").select("doc_id", "quality")
    teach = labels.where(fold("doc_id", 4) != 2)
    model = train(docs.join(teach, "doc_id"))
    out = score(docs, model)
    return out.select("doc_id", (fold("doc_id", 4) == 2).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))
