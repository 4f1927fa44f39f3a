"""Repeatable pseudo-random numbers derived from row keys.

A draw depends only on the row's key and the seed, so a retried task gives the
same numbers and no shuffle or ordering is needed.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def uniform(seed: int, *keys: Column) -> Column:
    """A number in [0, 1) from the first 52 bits of an MD5 of seed and keys."""
    text = F.concat_ws("-", F.lit(str(seed)), *[k.cast("string") for k in keys])
    bits = F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("bigint")
    return bits / F.lit(4503599627370496.0)


def _cumulative_poisson() -> tuple[float, ...]:
    """Chances of at most 0, 1, 2, ... copies at a mean of 1, until a double can't tell them from 1."""
    term, total, out = math.exp(-1.0), 0.0, []
    while total + term < 1.0 and total + term > total:
        total += term
        out.append(total)
        term /= len(out)
    return tuple(out)


POISSON_ONE = _cumulative_poisson()


def copies(draw: Column) -> Column:
    """How often a row enters a bootstrap replicate, from a uniform draw."""
    count = F.lit(len(POISSON_ONE))
    for k in range(len(POISSON_ONE) - 1, -1, -1):
        count = F.when(draw < POISSON_ONE[k], F.lit(k)).otherwise(count)
    return count


def drawn_copies(seed: int, keys: Sequence[Column], replicates: Column) -> Column:
    """:func:`copies` of :func:`uniform` for every element of ``replicates``, as an array.

    A number is below a chance exactly when the hash is below the chance's hexadecimal digits, so
    each hash is computed once and compared as text.
    """
    # Above the last hash of 13 digits every hash is below.
    limits = [format(n, "013x") if n < 16**13 else "g" for n in (math.ceil(p * 4503599627370496) for p in POISSON_ONE)]

    def count(text: Column) -> Column:
        found = F.lit(len(limits))
        for k in range(len(limits) - 1, -1, -1):
            found = F.when(text < limits[k], F.lit(k)).otherwise(found)
        return found

    start = F.concat_ws("-", F.lit(str(seed)), *[k.cast("string") for k in keys])
    return F.transform(F.transform(replicates, lambda r: F.md5(F.concat_ws("-", start, r.cast("string")))), count)
