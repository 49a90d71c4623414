"""Benchmark decontamination by winnowing, in DataFrame functions only.

A window is 13 consecutive words of an item (an item of fewer words is one window). Of the K-gram hashes in a window the
least one is its fingerprint, so a document that holds the window selects the same K-gram at the same offset: every
shared window is found. Document fingerprints are joined to those of the benchmark's distinct windows; each match is
extended to the whole window and compared word by word. The benchmark's fingerprints are broadcast where their number
is counted to be at most BROADCAST_ROWS, else both sides are shuffled.

Null texts and texts without words have no words and no hits. Items without words have no window. Every row is a document of
its own, also where its id is null or repeated: rows are told apart by 128-bit hashes of id and text, so only equal rows
share a result. Tables without rows give no rows; without benchmark rows nothing is hit; items without id count under ''.
Extra columns of either table are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored, table

WINDOW, K = 13, 5
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Rows (of some 24 bytes) of benchmark fingerprints, or ids of documents with matches, that are broadcast at most.
BROADCAST_ROWS = 1_000_000
PLACE = (1 << 24) - 1
#: Words of a document whose places are told by a fingerprint's low bits; longer documents go in overlapping blocks with a start each.
BLOCK = PLACE - 64


def words(text: Column) -> Column:
    """Words of a text in lower case (A-Z)."""
    return F.array_remove(F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), SEPARATORS), "")


def fingerprints(hashes: Column, length: int) -> Column:
    """Of word hashes: for each window of so many words the least K-gram hash, its last 24 bits replaced by its place; distinct."""
    k = min(K, length)
    grams = lambda h: F.transform(
        F.sequence(F.lit(1), F.size(h) - k + 1),
        lambda i: F.shiftleft(F.shiftright(F.xxhash64(*[F.element_at(h, i + d) for d in range(k)]), 24), 24).bitwiseOR((i - 1).cast("long").bitwiseAND(F.lit(PLACE))),
    )
    least = lambda g: F.transform(F.sequence(F.lit(1), F.size(g) - (length - k)), lambda i: F.array_min(F.slice(g, i, length - k + 1)))
    empty = F.array().cast("array<long>")
    # a one-element array bound by transform() computes the K-grams once
    bound = lambda c, f: F.element_at(F.transform(F.array(c), f), 1)
    return bound(hashes, lambda h: F.when(F.size(h) < length, empty).otherwise(bound(grams(h), lambda g: F.array_distinct(least(g)))))


def windows(benchmark: DataFrame, text: str = "text") -> DataFrame:
    """Windows of each item: (item_id, length, window), window an array of words."""
    w = benchmark.select("item_id", words(F.col(text)).alias("w")).where("size(w) > 0")
    length = F.least(F.size("w"), F.lit(WINDOW))
    return w.select("item_id", length.alias("length"), F.explode(F.transform(F.sequence(F.lit(1), F.size("w") - length + 1), lambda i: F.slice("w", i, length))).alias("window")).distinct()


#: A row's key: hashes of its id and text, never null.
KEY = ["k1", "k2"]


def keyed(docs: DataFrame, text: str) -> DataFrame:
    """(k1, k2, doc_id, text)."""
    of = [F.col("doc_id").isNull(), F.col("doc_id").cast("string"), F.col(text).isNull(), F.col(text)]
    return docs.select(F.xxhash64(F.lit(1), *of).alias("k1"), F.xxhash64(F.lit(2), *of).alias("k2"), "doc_id", F.col(text).alias("text"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, text: str = "text") -> DataFrame:
    """(doc_id, n_words, n_hit, items): hit words and the sorted ids of the items with occurring windows."""
    of_items = stored(windows(benchmark))
    lengths = sorted(r[0] for r in of_items.select("length").distinct().collect())  # WINDOW values at most
    distinct = of_items.select("length", "window").distinct()
    hashed = distinct.withColumn("hashes", F.transform("window", lambda w: F.xxhash64(w)))
    prints = [hashed.where(F.col("length") == n).select("length", "window", F.element_at(fingerprints(F.col("hashes"), n), 1).alias("f")) for n in lengths]
    if prints:
        index = reduce(DataFrame.unionByName, prints)
        index = stored(index.select("length", "window", F.shiftright("f", 24).alias("gram"), F.col("f").bitwiseAND(F.lit(PLACE)).cast("int").alias("offset")))
    else:
        index = docs.sparkSession.createDataFrame([], "length int, window array<string>, gram long, offset int")
    keys = index.select(F.col("length").alias("of_length"), F.col("gram").alias("of_gram")).distinct()
    if index.count() <= BROADCAST_ROWS:
        keys = F.broadcast(keys)

    # one row a document with its word count, and one a fingerprint that the benchmark has too
    cut = keyed(docs, text).select(*KEY, "doc_id", words(F.col("text")).alias("w"))
    hashes = cut.select(*KEY, "doc_id", F.transform("w", lambda w: F.xxhash64(w)).alias("all"))
    later = lambda b: F.struct((b * BLOCK).cast("long").alias("base"), F.slice("all", b * BLOCK + 1, BLOCK + WINDOW - 1).alias("h"))
    parts = F.when(F.size("all") <= BLOCK, F.array(F.struct(F.lit(0).cast("long").alias("base"), F.col("all").alias("h")))).otherwise(F.transform(F.sequence(F.lit(0), F.floor((F.size("all") - 1) / BLOCK).cast("int")), later))
    hashes = hashes.select(*KEY, "doc_id", F.size("all").cast("long").alias("n_all"), F.explode(parts).alias("part")).select(*KEY, "doc_id", "n_all", "part.base", "part.h")
    mark = F.when(F.col("base") == 0, F.array(F.struct(F.lit(0).alias("length"), F.col("n_all").alias("f")))).otherwise(F.array().cast("array<struct<length:int,f:bigint>>"))
    tagged = lambda n: lambda f: F.struct(F.lit(n).alias("length"), f.alias("f"))
    each = [F.transform(fingerprints(F.col("h"), n), tagged(n)) for n in lengths]
    rows = hashes.select(*KEY, "doc_id", "base", F.explode(F.concat(mark, *each)).alias("x")).select(*KEY, "doc_id", "base", "x.length", "x.f")
    rows = rows.select(*KEY, "doc_id", "base", "length", "f", F.when(F.col("length") > 0, F.shiftright("f", 24)).alias("gram"))
    met = rows.join(keys, (F.col("length") == F.col("of_length")) & (F.col("gram") == F.col("of_gram")), "left").where("length = 0 OR of_gram IS NOT NULL")
    met = stored(met.select(*KEY, "doc_id", "base", "length", "f", "gram"))
    sizes = met.where("length = 0").select(*KEY, "doc_id", F.col("f").alias("n_words"))

    # matches are extended to whole windows in the documents that have any
    matches = met.where("length > 0").select(*KEY, "length", "gram", (F.col("base") + F.col("f").bitwiseAND(F.lit(PLACE))).cast("int").alias("place"))
    pairs = matches.join(index, ["length", "gram"]).select(*KEY, "length", "window", (F.col("place") - F.col("offset")).alias("start"))
    hit_docs = stored(matches.select(*KEY).distinct())
    if hit_docs.count() <= BROADCAST_ROWS:
        hit_docs = F.broadcast(hit_docs)  # else the texts are shuffled
    full = keyed(docs, text).join(hit_docs, KEY, "left_semi").select(*KEY, "text").distinct().select(*KEY, words(F.col("text")).alias("w"))
    checked = pairs.where("start >= 0").join(full, KEY).where(F.slice("w", F.col("start") + 1, F.col("length")) == F.col("window"))
    checked = stored(checked.select(*KEY, "length", "window", "start").distinct())
    places = checked.groupBy(*KEY, "start").agg(F.max(F.col("start") + F.col("length")).alias("end"))
    # a word counts once: each stretch counts beyond the furthest end before it
    before = F.max("end").over(Window.partitionBy(*KEY).orderBy("start").rowsBetween(Window.unboundedPreceding, -1))
    stretch = places.select(*KEY, F.greatest(F.lit(0), F.col("end") - F.greatest("start", F.coalesce(before, F.lit(0)))).alias("n"))
    hit = stretch.groupBy(*KEY).agg(F.sum("n").alias("n_hit"))
    items = checked.select(*KEY, "length", "window").distinct().join(of_items, ["length", "window"]).select(*KEY, F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item")).distinct()
    items = items.groupBy(*KEY).agg(F.array_sort(F.collect_list("item")).alias("items"))
    out = sizes.join(hit, KEY, "left").join(items, KEY, "left")
    return out.select("doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"))


def is_contaminated() -> Column:
    return (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))


def op6_winnow_decontamination(spark, sf_dir: str) -> DataFrame:
    found = decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), is_contaminated().alias("contaminated"))


# every 13-word window is looked up whole: no winnowing
OP6_SQL = r"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') w FROM documents),
b AS (SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') w FROM benchmark),
bw AS (SELECT DISTINCT item_id, n, array_to_string(list_slice(w, i, i + n - 1), ' ') g FROM (SELECT item_id, w, least(len(w), 13) n, unnest(range(1, len(w) - least(len(w), 13) + 2)) i FROM b WHERE len(w) > 0)),
dw AS (SELECT doc_id, n, i, array_to_string(list_slice(w, i, i + n - 1), ' ') g FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) i FROM d, (SELECT DISTINCT n FROM bw) WHERE len(w) >= n)),
m AS (SELECT DISTINCT doc_id, i, dw.n, item_id FROM dw JOIN bw ON dw.g = bw.g AND dw.n = bw.n),
h AS (SELECT doc_id, count(DISTINCT p) n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) p FROM m) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) n_items, string_agg(item_id, ',' ORDER BY item_id) s FROM (SELECT DISTINCT doc_id, item_id::VARCHAR item_id FROM m) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT n_words, coalesce(n_hit, 0)::BIGINT n_hit, coalesce(n_items, 0)::BIGINT n_items, sha256(coalesce(s, '')) items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN t USING (doc_id)
"""
