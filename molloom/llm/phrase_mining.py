"""Phrase collocations by marginalising the longest windows.

Every word starts one window: itself and the words that follow it in its piece, in lead columns, LONGEST at most and padded
at the piece's end. Only these windows are counted, in slices first; a ROLLUP over the lead columns sums the counts
of all shorter phrases, of single words and of each language. There is no n-gram explosion of its own for any length.

Windows end before a word that occurs less than `least` times, as no candidate can hold it. Such words are known by a filter of
BITS bits, the same size for any corpus, set from the counts of single words: where two words share a bit a window
stays longer than it must, which changes no count.

Slices' windows are dealt by all their words but the last, so that windows and prefixes are counted after one shuffle and rare
prefixes end there. A prefix has no more windows than its rarest word occurrences; only where all its words are hot
it is dealt over SALTS groups, whose sums the ROLLUP adds up.

Candidates and their parts have counts of `least` or more, so all that follows works on frequent phrases alone: joins of a
candidate's parts, the lowest-scoring cut, candidates inside longer ones, ranks. Scores are exact: decimals of 38 digits hold
a million times the square of a count up to 10**15. Frequent words meet no group of all their phrases: counts are
summed with partial aggregation, joins read stored tables, and ranks are limited before rows are dealt.

Null and empty texts have no words; a null language is `und`; equal rows count each; a table without rows gives none; columns
besides text and lang are ignored.
"""

from __future__ import annotations

from collections import namedtuple
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import mapped, ranges, slices, stored, table, utf8

LONGEST, LEAST, COVER, TOP = 3, 10, 50, 2000
#: Bytes of text whose windows are counted at once; bits of the filter of frequent words.
SLICE, BITS = 6 << 20, 1 << 26
#: Words with more than one in HOT occurrences are hot, fewer than HOT; windows whose prefix is of hot words are dealt by SALTS.
HOT, SALTS = 1000, 32
Words = namedtuple("Words", "bits hot")
_BREAK, _SPACE = (np.isin(np.arange(256), list(x)) for x in (b".,;:!?\n\x0b\x0c\r", b" \t"))


def words_of(offsets: np.ndarray, data: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The words of texts in lower case (A-Z), each word's text, and whether the next word follows in its piece."""
    size = np.diff(offsets)
    flat = np.full(len(data) + len(size), 10, np.uint8)
    flat[ranges(offsets[:-1] + np.arange(len(size)), size)] = data
    flat[(flat >= 65) & (flat <= 90)] += 32
    breaks = _BREAK[flat]
    within = ~(breaks | _SPACE[flat])
    edge = np.flatnonzero(within[1:] != within[:-1]) + 1
    if len(flat) and within[0]:
        edge = np.concatenate([[0], edge])
    starts, ends = edge[::2], edge[1::2]  # each text ends with a break, so every word has an end
    at = np.concatenate([[0], np.cumsum(ends - starts)]).astype(np.int32)
    words = pa.Array.from_buffers(pa.string(), len(starts), [None, pa.py_buffer(at), pa.py_buffer(flat[within])])
    piece = np.cumsum(breaks, dtype=np.int32)[starts]
    follows = np.append(piece[1:] == piece[:-1], False) if len(starts) else np.zeros(0, bool)
    return words, np.searchsorted(offsets + np.arange(len(offsets)), starts, "right") - 1, follows


def _counted(texts: pa.Array, langs: pa.Array, longest: int, words: Words | None) -> pa.RecordBatch:
    """(key, n): windows of a slice, in order. A key is the salt, the words (empty where padded) and the language, joined by tabs."""
    spans, text, follows = words_of(*utf8(texts))
    coded = spans.dictionary_encode()
    code, v = coded.indices.to_numpy(), len(coded.dictionary) + 1
    tongues = langs.fill_null("und").dictionary_encode()
    tongue = tongues.indices.to_numpy()[text].astype(np.int64)
    of, pair = pd.factorize(tongue * v + code)  # a word in a language
    spell = lambda c: coded.dictionary.take(pa.array(c, mask=c >= v - 1))
    name = lambda c: tongues.dictionary.take(pa.array(c))
    known, hot, h = np.ones(len(pair), bool), np.zeros(len(pair), bool), np.zeros(len(pair), np.int64)
    if words is not None:
        own = _joined(spell(pair % v), name(pair // v)).to_pylist()
        h = np.fromiter(map(hash_of, own), np.int64, len(own))
        bit = h % (64 * len(words.bits))
        known = (words.bits[bit >> 6] >> (bit & 63).astype(np.uint64) & np.uint64(1)) > 0
        hot = np.fromiter((w in words.hot for w in own), bool, len(own))
    lead, open_, crowded = [], np.ones(len(code), bool), np.ones(len(code), bool)
    good, common = known[of], hot[of]
    for d in range(longest):
        here = np.full(len(code), v - 1, np.int64)  # v - 1: none
        stays = open_[: len(code) - d] & good[d:]
        if d:
            stays &= follows[d - 1 : len(code) - 1]
        open_ = np.append(stays, np.zeros(min(d, len(code)), bool))
        here[: len(stays)][stays] = code[d:][stays]
        lead.append(here)
        if d < longest - 1:
            crowded &= open_ & np.append(common[d:], np.zeros(min(d, len(code)), bool))
    key = tongue
    for here in lead[:-1]:  # numbers of distinct prefixes, so that no product overflows
        key = pd.factorize(key * v + here)[0].astype(np.int64)
    number = pd.factorize(key * v + lead[-1])[0]
    n = np.bincount(number)
    first = np.zeros(len(n), np.int64)
    first[number] = np.arange(len(number))  # any of a window's places
    # rows that are sent to one place lie in order, so that a compressed block repeats what neighbours share
    order = np.zeros(v, np.int64)
    order[pc.sort_indices(coded.dictionary).to_numpy()] = np.arange(1, v)
    sort = np.argsort(order[lead[0][first]] * v + order[lead[min(1, longest - 1)][first]])
    first, n = first[sort], n[sort]
    behind = of[np.minimum(first + longest - 1, len(of) - 1)]
    salt = np.where(crowded[first] & (longest > 1), 1 + np.where(open_[first], h[behind] % SALTS, 0), 0)
    salt = pa.array(["", *map(str, range(1, SALTS + 1))]).take(pa.array(salt))
    return pa.RecordBatch.from_arrays([_joined(salt, *(spell(x[first]) for x in lead), name(tongue[first])), pa.array(n.astype(np.int64))], names=["key", "n"])


def _joined(*words: pa.Array) -> pa.Array:
    return pc.binary_join_element_wise(*words, "\t", null_handling="replace", null_replacement="")


def hash_of(key: str) -> int:
    return xxhash.xxh64_intdigest(key, 12) >> 1


def windows(docs: DataFrame, longest: int, words=None) -> DataFrame:
    """docs (text, lang): (key, n) of slices of the documents. words: broadcast Words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            at = utf8(batch.column(0))[0]
            for i, j in slices(at, SLICE):
                held.append(batch.slice(i, j - i))
                size += int(at[j] - at[i])
                if size >= SLICE:
                    yield counted(held)
                    held, size = [], 0
        if held:
            yield counted(held)

    def counted(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        full = pa.Table.from_batches(held).combine_chunks()
        return _counted(full.column(0).chunk(0), full.column(1).chunk(0), longest, words and words.value)

    return mapped(docs.select("text", "lang"), run, "key string, n long")


def frequent_words(docs: DataFrame, least: int, n_bits: int = BITS):
    """Broadcast Words of the words, each in its language, with so many occurrences."""

    def bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h = np.array([hash_of(k) for k in batch.column(0).to_pylist()], np.int64) % n_bits
            yield pa.RecordBatch.from_arrays([pa.array(h >> 6), pa.array((np.uint64(1) << (h & 63).astype(np.uint64)).view(np.int64))], names=["cell", "bit"])

    counts = windows(docs, 1).groupBy("key").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
    counts = stored(counts.select(F.substr("key", F.lit(2)).alias("word"), "n"))
    # at most n_bits / 64 rows, and HOT words, reach the driver
    cells = mapped(counts.select("word"), bits, "cell long, bit long").groupBy("cell").agg(F.bit_or("bit").alias("bits")).toPandas()
    out = np.zeros(n_bits // 64, np.uint64)
    out[cells["cell"].to_numpy(np.int64)] = cells["bits"].to_numpy(np.int64).view(np.uint64)
    total = counts.agg(F.sum("n")).first()[0] or 0
    hot = frozenset(r.word for r in counts.where(F.col("n") * HOT > total).select("word").collect())
    return docs.sparkSession.sparkContext.broadcast(Words(out, hot))


def phrases(docs: DataFrame, longest: int = LONGEST, least: int = LEAST, n_bits: int = BITS) -> DataFrame:
    """docs (text, lang): (lang, phrase, size, f) of all phrases of up to longest words that occur least times or more, and
    of each language the number of its words under size 0."""
    prefix = F.substring_index("key", "\t", longest)  # salt and all words but the last
    # dealt by prefix: counts of windows and of prefixes need no other shuffle
    rows = windows(docs, longest, frequent_words(docs, least, n_bits)).repartition(prefix).select(prefix.alias("prefix"), F.substr("key", F.length(prefix) + 2).alias("rest"), "n")
    counts = rows.groupBy("prefix", "rest").agg(F.sum("n").alias("n"))
    last = F.substring_index("rest", "\t", 1)
    lang = F.substr("rest", F.length(last) + 2)
    parts = F.split("prefix", "\t")
    lead = [f"w{d}" for d in range(1, longest)]
    words = [F.element_at(parts, d).alias(w) for d, w in enumerate(lead, 2)]
    # one condition on count and words: a part of it alone would be pushed below the count, which both sides share
    often = F.when(F.col("n") >= least, last != "").otherwise(F.lit(False))
    full = counts.where(often).select(lang.alias("lang"), *words, last.alias("last"), "n").select("lang", F.concat_ws(" ", *lead, "last").alias("phrase"), F.lit(longest).alias("size"), F.col("n").alias("f"))
    prefixes = counts.groupBy("prefix", lang.alias("lang")).agg(F.sum("n").alias("f")).select("lang", F.element_at(parts, 1).alias("salt"), *words, "f")
    # a prefix that is too rare is known here, as all its windows are, and only its first word matters
    rare = (F.col("salt") == "") & (F.col("f") < least) & F.lit(longest == 3)
    prefixes = prefixes.select("lang", *lead[:1], *(F.when(rare, F.lit("")).otherwise(F.col(w)).alias(w) for w in lead[1:]), "f")
    columns = ", ".join(lead)
    up = docs.sparkSession.sql(f"SELECT lang, {columns}, sum(f) f, grouping_id() level FROM {{p}} GROUP BY lang, ROLLUP({columns})", p=prefixes)
    size = sum(F.when(F.col("level").bitwiseAND(F.lit(1 << longest - 1 - d)) == 0, 1).otherwise(0) for d in range(1, longest))
    up = up.withColumn("size", size)
    end = F.element_at(F.array(*lead), F.greatest("size", F.lit(1)))
    up = up.where((F.col("size") == 0) | (F.col("f") >= least) & (end != ""))
    named = F.concat_ws(" ", *(F.when(F.col("size") >= d, F.col(w)) for d, w in enumerate(lead, 1)))
    return full.unionByName(up.select("lang", named.alias("phrase"), "size", "f"))


def collocations(docs: DataFrame, longest: int = LONGEST, least: int = LEAST, cover: int = COVER, top: int = TOP, n_bits: int = BITS) -> DataFrame:
    """docs (text, lang): (lang, rank, phrase, a, l, r, n, score), the top phrases of each language.

    A phrase of two words or more scores floor(10**6 * a * a / (l * r)) at its lowest-scoring cut, l and r being the counts of
    the cut's sides. It goes if a longer candidate that holds it has cover percent of its count or more.
    """
    grams = stored(phrases(docs, longest, least, n_bits))
    counts = stored(grams.where("size > 0").select(F.col("lang").alias("of_lang"), F.col("phrase").alias("part"), F.col("f").alias("of_part")))
    candidates = grams.where("size > 1").select("lang", "phrase", "size", F.col("f").alias("a"), F.split("phrase", " ").alias("w"))
    some = lambda i, n: F.array_join(F.slice("w", i, n), " ")
    cuts = stored(candidates.select("lang", "phrase", "size", "a", "w", F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k")))
    cuts = cuts.select("lang", "phrase", "a", "k", some(1, F.col("k")).alias("left"), some(F.col("k") + 1, F.col("size") - F.col("k")).alias("right"))
    for side, name in (("left", "l"), ("right", "r")):
        own = counts.select("of_lang", "part", F.col("of_part").alias(name))
        cuts = stored(cuts.join(own, (F.col("lang") == F.col("of_lang")) & (F.col(side) == F.col("part"))).drop("of_lang", "part"))
    exact = "CAST(a AS DECIMAL(15,0)) * CAST(a AS DECIMAL(15,0)) * CAST(1000000 AS DECIMAL(7,0)) div (CAST(l AS DECIMAL(18,0)) * CAST(r AS DECIMAL(18,0)))"
    best = cuts.withColumn("score", F.expr(exact)).groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))

    inner = F.explode(F.flatten(F.transform(F.sequence(F.lit(2), F.col("size") - 1), lambda n: F.transform(F.sequence(F.lit(1), F.col("size") - n + 1), lambda i: F.array_join(F.slice("w", i, n), " ")))))
    longer = candidates.where("size > 2").select("lang", "a", inner.alias("part")).groupBy(F.col("lang").alias("of_lang"), "part").agg(F.max("a").alias("longer"))
    kept = best.join(longer, (F.col("lang") == F.col("of_lang")) & (F.col("phrase") == F.col("part")), "left").where(f"longer IS NULL OR 100 * longer < {cover} * a")
    w = Window.partitionBy("lang").orderBy(F.col("cut.score").desc(), F.col("a").desc(), "phrase")
    ranked = kept.select("lang", "phrase", "a", "cut", F.row_number().over(w).cast("long").alias("rank")).where(F.col("rank") <= top)
    totals = grams.where("size = 0").select(F.col("lang").alias("of_lang"), F.col("f").alias("n"))
    out = ranked.join(totals, F.col("lang") == F.col("of_lang"))
    return out.select("lang", "rank", "phrase", "a", F.col("cut.l").alias("l"), F.col("cut.r").alias("r"), "n", F.col("cut.score").cast("long").alias("score"))


def op12_phrase_mining(spark, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents").select("text", "lang"))


# each length has an n-gram explosion of its own
OP12_SQL = r"""
WITH p AS (SELECT coalesce(lang, 'und') lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) p FROM documents),
w AS MATERIALIZED (SELECT lang, list_filter(string_split_regex(p, '[\x20\x09]+'), lambda x: x <> '') w FROM p),
g AS (SELECT lang, z, g, count(*) f FROM (SELECT lang, z, array_to_string(list_slice(w, i, i + z - 1), ' ') g FROM (SELECT lang, w, z, unnest(range(1, len(w) - z + 2)) i FROM w, range(1, 4) s(z) WHERE len(w) >= z)) GROUP BY ALL),
n AS (SELECT lang, sum(f)::BIGINT n FROM g WHERE z = 1 GROUP BY lang),
c AS (SELECT *, string_split(g, ' ') w FROM g WHERE z > 1 AND f >= 10),
k AS (SELECT lang, g, z, f, k, array_to_string(list_slice(w, 1, k), ' ') x, array_to_string(list_slice(w, k + 1, z), ' ') y FROM (SELECT *, unnest(range(1, z)) k FROM c)),
s AS (SELECT k.lang, k.g, k.f a, k, x.f l, y.f r, (1000000::HUGEINT * k.f * k.f // (x.f::HUGEINT * y.f))::BIGINT score FROM k JOIN g x ON x.lang = k.lang AND x.g = k.x JOIN g y ON y.lang = k.lang AND y.g = k.y),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, k) = 1),
i AS (SELECT lang, unnest([array_to_string(list_slice(w, 1, 2), ' '), array_to_string(list_slice(w, 2, 3), ' ')]) g, f FROM c WHERE z = 3),
o AS (SELECT b.* FROM b LEFT JOIN (SELECT lang, g, max(f) m FROM i GROUP BY ALL) USING (lang, g) WHERE m IS NULL OR 100 * m < 50 * a)
SELECT lang, rank, phrase, a, l, r, n, score FROM (SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, g) rank, g phrase, a, l, r, score FROM o) JOIN n USING (lang) WHERE rank <= 2000
"""
