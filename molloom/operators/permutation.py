"""A keyed permutation of 0 .. size - 1, computed row by row in integer expressions that any SQL engine has.

A number is two limbs, hi * base + lo, with about as many values each, so sizes go far beyond 64 bits. Rounds add a keyed
function of one limb to the other, modulo its range (a Feistel network over mixed radices). Some few numbers of the square lie
beyond size; they are permuted again until they lie within (cycle walking), which keeps the whole a permutation.
"""

from __future__ import annotations

from math import isqrt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PRIME = (1 << 31) - 1
LARGEST = 1 << 122
ROUNDS = 6


def halves(size: int) -> tuple[int, int]:
    """Values of hi and of lo; their product is size or a little more."""
    if size > LARGEST:
        raise ValueError(f"more than {LARGEST} numbers")
    low = max(isqrt(max(size, 1) - 1) + 1, 1)
    return max(-(-size // low), 1), low


def keys(seed: int) -> list[tuple[int, int, int, int]]:
    """Four numbers below PRIME for each round."""
    out, x = [], seed % PRIME + 1
    for _ in range(4 * ROUNDS):
        x = (x * 48_271 + 11) % PRIME
        out.append(1 + x % (PRIME - 1))
    return [tuple(out[4 * j : 4 * j + 4]) for j in range(ROUNDS)]


def _round(x: Column, key: tuple[int, int, int, int]) -> Column:
    """A keyed number below PRIME ** 2 of a non-negative one; all products stay below 2 ** 63."""
    a, b, c, d = (F.lit(k).cast("long") for k in key)
    p = F.lit(PRIME).cast("long")
    once = lambda y, f: F.element_at(F.transform(F.array(y), f), 1)  # noqa: E731  names a value, so that it is computed once
    folded = ((x % p) * a % p + F.call_function("div", x, p) % p * b + c) % p
    mixed = lambda y, k: ((y * y % p) * k + y + c) % p
    return once(folded, lambda y: once(mixed(y, d), lambda z: mixed(z, b) * p + mixed(z, a)))


def permuted(df: DataFrame, number: str, size: int, seed: int = 0) -> DataFrame:
    """df with hi and lo: the permutation's value at the column number (0 <= number < size)."""
    high, low = halves(size)
    rounds = keys(seed)

    def turned(j: int):
        return lambda s: F.struct(*(
            (s["hi"].alias("hi"), ((s["lo"] + _round(s["hi"], rounds[j]) % low) % low).alias("lo")) if j % 2
            else (((s["hi"] + _round(s["lo"], rounds[j]) % high) % high).alias("hi"), s["lo"].alias("lo"))
        ))

    def once(at: Column) -> Column:
        state = F.struct(at["hi"].alias("hi"), at["lo"].alias("lo"))
        for j in range(ROUNDS):
            state = F.element_at(F.transform(F.array(state), turned(j)), 1)
        return state

    out_of = lambda s: (s["hi"] > (size - 1) // low) | (s["hi"] == (size - 1) // low) & (s["lo"] > (size - 1) % low)
    # a walk meets each number beyond size once at most; the more numbers, the rarer those are
    walks = min(high * low - size + 1, 48)
    start = F.struct(F.call_function("div", F.col(number), F.lit(low)).cast("long").alias("hi"), (F.col(number) % F.lit(low)).cast("long").alias("lo"))
    walked = F.aggregate(F.sequence(F.lit(1), F.lit(walks)), once(start), lambda s, _: F.when(out_of(s), once(s)).otherwise(s))
    rows = df.withColumn("__at", walked)
    rows = rows.withColumn("__at", F.when(out_of(F.col("__at")), F.raise_error(F.lit("no number in range")).cast(rows.schema["__at"].dataType)).otherwise(F.col("__at")))
    return rows.withColumn("hi", F.col("__at.hi")).withColumn("lo", F.col("__at.lo")).drop("__at")
