"""Fingerprint algebra as Catalyst expressions.

A bit fingerprint is a sorted ARRAY<INT> of its on-bits, or ARRAY<BIGINT> of 64-bit words; a count fingerprint is the
set of (bucket, 1st), (bucket, 2nd), ... occurrences, so that its Tanimoto is the sum of minima over the sum of maxima.
"""

from __future__ import annotations

from fractions import Fraction
from math import floor

from pyspark.sql import Column
from pyspark.sql import functions as F


def sign_bits(vector: Column) -> Column:
    """On-bits of a vector: the places of its positive values."""
    return F.filter(F.transform(vector, lambda x, i: F.when(x > 0, i).otherwise(F.lit(-1))), lambda b: b >= 0)


def sign_word(vector: Column) -> Column:
    """The signs of up to 64 values as one word."""
    bits = F.transform(vector, lambda x, i: F.when(x > 0, F.call_function("shiftleft", F.lit(1).cast("long"), i)).otherwise(F.lit(0).cast("long")))
    return F.aggregate(bits, F.lit(0).cast("long"), lambda a, b: a.bitwiseOR(b))


def largest_places(vector: Column, k: int) -> Column:
    """The places of the k largest values, ascending: a sparse fingerprint of exactly k bits; of equal values the first."""
    ranked = F.array_sort(F.transform(vector, lambda x, i: F.struct((-x).alias("v"), i.alias("i"))))
    return F.array_sort(F.transform(F.slice(ranked, 1, k), lambda s: s["i"]))


def tanimoto(common: Column, a: Column, b: Column) -> Column:
    """common / (a + b - common); two empty fingerprints have none."""
    return F.try_divide(common, a + b - common)


def tanimoto_bits(x: Column, y: Column) -> Column:
    return tanimoto(F.size(F.array_intersect(x, y)), F.size(x), F.size(y))


def tanimoto_words(x: Column, y: Column) -> Column:
    """Of fingerprints in one word, by population counts."""
    return tanimoto(F.bit_count(x.bitwiseAND(y)), F.bit_count(x), F.bit_count(y))


def count_bits(words: Column) -> Column:
    """On-bits of a fingerprint of several words."""
    return F.aggregate(words, F.lit(0), lambda a, w: a + F.bit_count(w))


def tanimoto_word_arrays(x: Column, y: Column) -> Column:
    """Of fingerprints of several words."""
    common = count_bits(F.zip_with(x, y, lambda a, b: a.bitwiseAND(b)))
    return tanimoto(common, count_bits(x), count_bits(y))


def tversky(common: Column, a: Column, b: Column, alpha: float = 0.0, beta: float = 1.0) -> Column:
    """common / (alpha * only a + beta * only b + common)."""
    return F.try_divide(common.cast("double"), alpha * (a - common) + beta * (b - common) + common)


#: Cutoffs of candidate filters are rounded down to this fraction, so that no product of floats loses an exact tie.
STEPS = 1_000_000


def lower_cutoff(cutoff: float) -> int:
    """The cutoff in units of 1 / STEPS, rounded down."""
    return floor(Fraction(repr(float(cutoff))) * STEPS)


def size_bound(a: Column, b: Column, cutoff: float) -> Column:
    """What the sizes alone must fulfil for a Tanimoto of cutoff or more (or a little less)."""
    c = F.lit(lower_cutoff(cutoff)).cast("long")
    a, b = a.cast("long"), b.cast("long")
    return (a * STEPS >= b * c) & (b * STEPS >= a * c)


def prefix_length(n: Column, cutoff: float) -> Column:
    """How many elements of n two sets must be compared on: similar enough sets share one of their rarest so many."""
    c = F.lit(lower_cutoff(cutoff)).cast("long")
    return n - F.floor((n.cast("long") * c + (STEPS - 1)) / F.lit(STEPS)) + 1


def occurrences(token: Column, count: Column) -> Column:
    """The elements of a token with so many occurrences: token#1, token#2, ..."""
    return F.transform(F.sequence(F.lit(1).cast("long"), count), lambda k: F.concat_ws("#", token, k.cast("string")))
