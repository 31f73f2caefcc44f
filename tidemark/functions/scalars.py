"""Expressions of single rows, among them random columns that don't depend on partitioning."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..series import ColumnLike, as_column, present


def fillna(x: ColumnLike, nan: float = 0.0, posinf: float = math.inf, neginf: float = -math.inf) -> Column:
    """Replaces missing values; and infinities, where asked."""
    v = present(x)
    return F.when(v.isNull(), F.lit(float(nan))).when(v == math.inf, F.lit(float(posinf))).when(v == -math.inf, F.lit(float(neginf))).otherwise(v)


def nanones(x: ColumnLike) -> Column:
    """1 where the value is present."""
    return F.when(present(x).isNotNull(), F.lit(1.0))


def signif(x: ColumnLike, decimals: int = 6) -> Column:
    """Rounds to significant digits, halves to even; zero and infinities stay."""
    v = present(x)
    scale = F.pow(F.lit(10.0), F.lit(decimals) - F.ceil(F.log10(F.abs(v))))
    scale = F.coalesce(F.when((scale < math.inf) & (scale > 0), scale), F.lit(1.0))
    return F.when(F.abs(v) == math.inf, v).otherwise(F.rint(v * scale) / scale)


#: Rounds of the hash behind random columns: bits to flip, a multiplier below 2**30, and a prime just below 2**31.
#: Flipping bits and multiplying modulo a prime are each linear; together they are not.
ROUNDS = ((1779033703, 1032193391, 2147483629), (1013904242, 784588716, 2147483587), (1359893119, 630360016, 2147483563), (528734635, 950706376, 2147483647))
PRIME = ROUNDS[-1][2]


def start_of(seed: int, stream: int) -> int:
    """Where the hash of a stream begins."""
    return (seed * 69621 + stream * 40692 + 12345) % PRIME


def _hash31(seed: int, stream: int, ids: tuple[ColumnLike, ...]) -> Column:
    """From 0 to 2**31 - 2, in bigint arithmetic that can't overflow, so that any engine gives the same."""
    made = F.lit(start_of(seed, stream)).cast("bigint")
    for column in ids:
        number = as_column(column).cast("bigint")
        low = F.pmod(number, F.lit(PRIME))
        high = F.pmod(F.floor(F.shiftright(number, 31)), F.lit(PRIME))
        for part in (low, high):
            made = made + part
            for flipped, times, prime in ROUNDS:
                made = F.pmod(made.bitwiseXOR(F.lit(flipped).cast("bigint")) * F.lit(times) + F.lit(1), F.lit(prime))
    return made


def hash62(*ids: ColumnLike, seed: int = 42, stream: int = 0) -> Column:
    """A bigint from 0 to below 2**62, a function of the seed and the row's ids alone."""
    return _hash31(seed, 2 * stream, ids) * F.lit(1 << 31) + _hash31(seed, 2 * stream + 1, ids)


def rand(*ids: ColumnLike, seed: int = 42, stream: int = 0) -> Column:
    """Uniform in [0, 1), a function of the seed and the row's ids alone.

    Ids are whole numbers; an id of another type goes in as a hash of it, such as
    ``F.xxhash64("name")``.  NULL where an id is.
    """
    fine = F.floor(_hash31(seed, 2 * stream + 1, ids) / F.lit(512.0)).cast("double") / F.lit(float(1 << 22))
    return (_hash31(seed, 2 * stream, ids).cast("double") + fine) / F.lit(float(PRIME))


def randn(*ids: ColumnLike, seed: int = 42) -> Column:
    """Standard normal, by Box and Muller from two uniform columns."""
    radius = F.sqrt(F.lit(-2.0) * F.log(F.lit(1.0) - rand(*ids, seed=seed, stream=1)))
    return radius * F.cos(F.lit(2 * math.pi) * rand(*ids, seed=seed, stream=2))


def randint(low: int, high: int, *ids: ColumnLike, seed: int = 42) -> Column:
    """Integers from low to high - 1."""
    if high <= low:
        raise ValueError("high must be above low")
    return F.lit(low) + F.pmod(hash62(*ids, seed=seed, stream=3), F.lit(high - low))


#: Steps of the network behind permuted().
PERMUTING = 6


def hashed_half(half: Column, key: int) -> Column:
    """A hash of a bigint below 2**31."""
    made = half + F.lit(key).cast("bigint")
    for flipped, times, prime in ROUNDS:
        made = (made.bitwiseXOR(F.lit(flipped).cast("bigint")) * F.lit(times) + F.lit(1)) % F.lit(prime)
    return made


def _hashed_numbers(half, key: int):
    """The same of a numpy array."""
    made = half + key
    for flipped, times, prime in ROUNDS:
        made = ((made ^ flipped) * times + 1) % prime
    return made


def permuting_plan(n: int, seed: int) -> tuple[int, int, list[int], int]:
    """``(a, b, keys, again)``: a grid of a by b places for n ids, the network's keys, and how many more passes some ids need.

    The grid has fewer than a places too many.  An id that lands on one of them
    passes once more, as often as it takes; the longest way is found by walking
    from each of those places.
    """
    import numpy as np

    a = math.isqrt(max(n - 1, 0)) + 1
    b = -(-n // a) if n else 1
    keys = [start_of(seed, 1000 + k) for k in range(PERMUTING)]
    left = np.arange(n, a * b, dtype=np.int64) if n else np.zeros(0, np.int64)
    again = 0
    while len(left):
        high, low = left // b, left % b
        for k, key in enumerate(keys):
            if k % 2:
                low = (low + _hashed_numbers(high, key)) % b
            else:
                high = (high + _hashed_numbers(low, key)) % a
        left = high * b + low
        left, again = left[left >= n], again + 1
    return a, b, keys, again
