"""Language identification by multilingual mixture inference.

Training counts hashed byte trigrams by language over all labelled rows of the training fold: tasks count into
fixed arrays, Spark sums them by (language, bucket). A document is a mixture of languages. Its proportions come from
expectation-maximisation over the trigram likelihoods; the language set is the one with the best likelihood less a
penalty for each language. A mixture of all languages bounds the likelihood of each smaller set, so only documents
whose bound beats the best single language by more than the penalty compare sets; the others have one language.

lang_pred is the language of the largest proportion in the chosen set, `und` for texts that are null or have no
letter, and where nothing was learned. score is its proportion times the trigrams' mean posterior for the set.
Repeated rows get equal results, ties go to the first language by name, added columns replace columns of their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fold, keep_columns, mapped, slices, table, utf8

BITS = 16
#: Languages that a model holds at most; its table has MAX_LANGUAGES * 2 ** BITS cells at most.
MAX_LANGUAGES = 400
#: Penalty for each language of the set, times the logarithm of the number of trigrams.
PENALTY = 2.0
ROUNDS = 12


def _classes() -> np.ndarray:
    """Each byte's class: capital letters as small ones, white space, digits and signs as one space."""
    c = np.arange(256, dtype=np.uint8)
    low = c.copy()
    low[65:91] += 32
    letter = (low >= 97) & (low <= 122) | (c >= 128)
    return np.where(letter, low, 32).astype(np.uint8)


CLASS = _classes()


def trigrams(data: np.ndarray) -> np.ndarray:
    """Bucket of the trigram at each byte; the last two are no trigrams."""
    b = CLASS[data].astype(np.uint32)
    code = b.copy()
    code[:-1] |= b[1:] << 8
    code[:-2] |= b[2:] << 16
    return (code * np.uint32(2654435761)) >> np.uint32(32 - BITS)


def bags(offsets: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, bucket, count) of the distinct trigrams of each document, in document order."""
    doc = np.repeat(np.arange(len(offsets) - 1, dtype=np.int64), np.diff(offsets))
    inside = np.ones(len(data), bool)
    ends = offsets[1:][np.diff(offsets) > 0]
    inside[ends - 1] = False
    inside[np.maximum(ends - 2, 0)] = False
    key = np.sort((doc << BITS | trigrams(data))[inside])
    new = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    count = np.diff(np.append(new, len(key)))
    key = key[new]
    return key >> BITS, key & (1 << BITS) - 1, count


def train(df: DataFrame, text: str = "text", lang: str = "lang") -> tuple[list[str], np.ndarray]:
    """Languages by name and log probabilities [language, bucket]. Rows without text or language teach nothing."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pd.DataFrame]:
        seen: dict[str, np.ndarray] = {}
        for batch in batches:
            langs = batch.column(1).to_pylist()
            for i, j in slices(utf8(batch.column(0))[0]):
                offsets, data = utf8(batch.column(0).slice(i, j - i))
                for name in set(langs[i:j]):
                    rows = np.array([x == name for x in langs[i:j]])
                    own = np.repeat(rows, np.diff(offsets))
                    code = trigrams(data)[own]
                    seen[name] = seen.get(name, 0) + np.bincount(code, minlength=1 << BITS)
        for name, c in seen.items():
            b = np.flatnonzero(c)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(b), pa.string()), pa.array(b), pa.array(c[b].astype(np.int64))], names=["lang", "bucket", "n"])

    rows = df.select(F.col(text).alias("text"), F.col(lang).alias("lang")).where("text is not null and lang is not null")
    counts = mapped(rows, count, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    names = [r[0] for r in counts.select("lang").distinct().orderBy("lang").limit(MAX_LANGUAGES + 1).collect()]
    if len(names) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    total = np.zeros((len(names), 1 << BITS))
    if names:
        got = counts.toPandas()  # bounded by MAX_LANGUAGES * 2 ** BITS
        total[pd.Categorical(got["lang"], names).codes, got["bucket"]] = got["n"]
    return names, np.log((total + 0.5) / (total.sum(1, keepdims=True) + 0.5 * (1 << BITS)))


def mixtures(doc: np.ndarray, prob: np.ndarray, count: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Proportions [document, language] and log-likelihoods by expectation-maximisation. prob: of each (document, trigram)."""
    languages = prob.shape[1]
    starts = np.searchsorted(doc, np.arange(n))
    full = np.flatnonzero(np.diff(np.append(starts, len(doc))))
    share = np.full((n, languages), 1.0 / languages)
    size = np.bincount(doc, count, n)[:, None]
    like = np.zeros(n)
    for _ in range(ROUNDS if len(doc) else 0):
        joint = prob * share[doc]
        of_all = joint.sum(1)
        like = np.bincount(doc, count * np.log(of_all), n)
        share[full] = np.add.reduceat(joint * (count / of_all)[:, None], starts[full], axis=0) / size[full]
    return share, like


def infer(offsets: np.ndarray, data: np.ndarray, logs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Best language and score of each document; -1 and 0 for empty ones."""
    n, languages = len(offsets) - 1, logs.shape[0]
    doc, bucket, count = bags(offsets, data)
    each = logs.T[bucket]
    starts = np.searchsorted(doc, np.arange(n))
    full = np.flatnonzero(np.diff(np.append(starts, len(doc))))
    single = np.zeros((n, languages))
    if len(full):
        single[full] = np.add.reduceat(each * count[:, None], starts[full], axis=0)
    best = single.argmax(1)
    top = np.zeros((n, languages))
    top[np.arange(n), best] = 1.0
    size = np.bincount(doc, count, n)
    cost = PENALTY * np.log(np.maximum(size, 2))
    # posterior of the single language among all, by trigram and not by document, so that it does not saturate
    score = np.zeros(n)
    if len(doc):
        peak = each.max(1, keepdims=True)
        prob = np.exp(each - peak)
        # the mixture of all languages can't beat the sum of each trigram's best language: documents within the penalty are settled
        limit = np.bincount(doc, count * peak[:, 0], n)
        open_ = np.flatnonzero(limit - single[np.arange(n), best] > cost)
        if len(open_):
            number = np.full(n, -1)
            number[open_] = np.arange(len(open_))
            mine = number[doc] >= 0
            d, p, c = number[doc[mine]], prob[mine], count[mine]
            base = np.bincount(d, c * peak[mine, 0], len(open_))
            share, like = mixtures(d, p, c, len(open_))
            gain = like + base - single[open_, best[open_]]
            mixed = np.flatnonzero(gain > cost[open_])
            if len(mixed):
                at = np.full(len(open_), -1)
                at[mixed] = np.arange(len(mixed))
                more = at[d] >= 0
                _choose(at[d[more]], p[more], c[more], base[mixed], single[open_[mixed]], cost[open_[mixed]], share[mixed], top, open_[mixed])
    pred = np.where(size > 0, top.argmax(1), -1)
    if len(doc):
        joint = prob * top[doc]
        tempered = joint.sum(1) / prob.sum(1)
        score = np.where(size > 0, top.max(1) * np.clip(np.bincount(doc, count * tempered, n) / np.maximum(size, 1) * 0.5 + 0.5, 0, 1), 0.0)
    for k in np.flatnonzero((size == 0) & (np.diff(offsets) > 0)).tolist():  # texts of one or two bytes: padded to one trigram
        short = np.concatenate([data[offsets[k] : offsets[k + 1]], np.full(2, 32, np.uint8)])[:3]
        like_ = np.exp(logs[:, trigrams(short)[0]])
        pred[k], score[k] = like_.argmax(), like_.max() / like_.sum()
    return pred, score


def _choose(d, p, c, base, single, cost, share, top, rows) -> None:
    """For documents that may be mixed: nested sets of the largest proportions, each fitted again; the best penalised one stays."""
    m, languages = share.shape
    order = np.argsort(-share, axis=1, kind="stable")
    value = single.max(1) - cost
    for k in range(2, languages + 1):
        allowed = np.zeros((m, languages))
        np.put_along_axis(allowed, order[:, :k], 1.0, axis=1)
        fitted, like = mixtures(d, p * allowed[d] + 1e-300, c, m)
        now = like + base - k * cost
        better = now > value
        top[rows[better]] = fitted[better]
        value = np.maximum(value, now)


def predict(df: DataFrame, model: tuple[list[str], np.ndarray], text: str = "text") -> DataFrame:
    """Adds lang_pred (string) and score (double)."""
    names, logs = model
    kept = keep_columns(df, "lang_pred", "score")
    schema = df.select(kept).withColumns({"lang_pred": F.lit(None).cast("string"), "score": F.lit(None).cast("double")}).schema
    shared = df.sparkSession.sparkContext.broadcast(logs.astype(np.float32))
    letters = "__has_letter"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        logs = shared.value.astype(np.float64)
        for batch in batches:
            texts, lettered = batch.column(kept.index(text)), batch.column(len(kept))
            for i, j in slices(utf8(texts)[0], 1 << 20):
                offsets, data = utf8(texts.slice(i, j - i))
                if names:
                    pred, score = infer(offsets, data, logs)
                else:
                    pred, score = np.full(j - i, -1), np.zeros(j - i)
                pred = np.where(lettered.slice(i, j - i).to_numpy(zero_copy_only=False), pred, -1)
                langs = [names[k] if k >= 0 else "und" for k in pred]
                part = batch.slice(i, j - i)
                yield pa.RecordBatch.from_arrays([*part.columns[: len(kept)], pa.array(langs, pa.string()), pa.array(np.where(pred >= 0, score, 0.0))], names=schema.names)

    rows = df.select(kept).withColumn(letters, F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False)))
    return mapped(rows, run, schema)


def op3_language_id(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = train(docs.where(fold("doc_id", 3) != 1))
    found = predict(docs.select("doc_id", "text"), model)
    return found.select("doc_id", (fold("doc_id", 3) == 1).alias("held_out"), "lang_pred", "score")
