"""Similarity of two values of one trait, and what a missing value does.

Each trait gives a pair of Columns: the similarity in [0, 1] and whether the
trait takes part.  A distance is the weighted mean of ``1 - similarity`` over
the traits that take part.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace
from enum import Enum
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F


class Kind(Enum):
    QUANTITATIVE = "quantitative"
    NOMINAL = "nominal"
    ORDINAL = "ordinal"
    BINARY = "binary"


class Direction(Enum):
    SYMMETRIC = "symmetric"
    HIGHER = "higher_more_similar"
    LOWER = "lower_more_similar"


class Missing(Enum):
    EXCLUDE = "exclude"
    ZERO = "zero_similarity"


@dataclass(frozen=True)
class Trait:
    """How one column is compared.

    ``scale`` is the frozen (low, high) range of a quantitative trait, ``levels``
    the ordered values of an ordinal one, ``present`` the value that counts as
    present in a binary one.
    """

    name: str
    kind: Kind = Kind.QUANTITATIVE
    weight: float = 1.0
    scale: tuple[float, float] | None = None
    levels: Sequence[Any] | None = None
    present: Any = 1
    asymmetric: bool = False
    direction: Direction = Direction.SYMMETRIC
    missing: Missing = Missing.EXCLUDE
    reference: Any = None

    def with_scale(self, low: float, high: float) -> Trait:
        return replace(self, scale=(float(low), float(high)))


def _width(low: float, high: float) -> float:
    """Range width; a constant column compares as equal instead of dividing by 0."""
    return high - low if high != low else 1.0


def _clipped(gap: Column) -> Column:
    """``1 - gap`` within [0, 1]; NULL stays NULL (``least`` alone would skip it)."""
    return F.when(gap.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1.0 - gap)))


def quantitative(a: Column, b: Column, width: float) -> Column:
    return _clipped(F.abs(a - b) / F.lit(float(width)))


def one_sided(reference: Column, candidate: Column, width: float, direction: Direction) -> Column:
    """Only falling short of the reference lowers the similarity."""
    gap = reference - candidate if direction is Direction.HIGHER else candidate - reference
    return _clipped(gap / F.lit(float(width)))


def same(a: Column, b: Column) -> Column:
    return (a == b).cast("double")


def level(column: Column, levels: Sequence[Any]) -> Column:
    """Position of a value in its ordered levels; NULL when it is none of them."""
    place = F.array_position(F.array(*[F.lit(v) for v in levels]), column)
    return F.when(place > 0, (place - 1).cast("double"))


def compare_trait(trait: Trait, a: Column, b: Column) -> tuple[Column, Column]:
    """(similarity, takes part) of reference ``a`` and candidate ``b``."""
    if trait.kind is Kind.BINARY:
        a, b = (a == F.lit(trait.present)).cast("double"), (b == F.lit(trait.present)).cast("double")
    elif trait.kind is Kind.ORDINAL:
        a, b = level(a, trait.levels), level(b, trait.levels)
    elif trait.kind is Kind.QUANTITATIVE:
        a = F.when(~F.isnan(a.cast("double")), a.cast("double"))
        b = F.when(~F.isnan(b.cast("double")), b.cast("double"))
    part = a.isNotNull() & b.isNotNull()

    if trait.kind in (Kind.NOMINAL, Kind.BINARY):
        similarity = same(a, b)
        if trait.asymmetric and trait.kind is Kind.BINARY:
            part = part & ~((a == 0.0) & (b == 0.0))
    else:
        if trait.kind is Kind.ORDINAL:
            width = _width(0.0, float(len(trait.levels) - 1))
        elif trait.scale is None:
            raise ValueError(f"quantitative trait {trait.name!r} needs a frozen scale")
        else:
            width = _width(*trait.scale)
        if trait.direction is Direction.SYMMETRIC:
            similarity = quantitative(a, b, width)
        else:
            similarity = one_sided(a, b, width, trait.direction)

    part = F.coalesce(part, F.lit(False))
    if trait.missing is Missing.ZERO:
        gone = a.isNull() | b.isNull()
        similarity = F.when(gone, F.lit(0.0)).otherwise(similarity)
        part = part | gone
    return similarity, part


def distance(parts: Sequence[tuple[float, Column, Column]]) -> Column:
    """Weighted mean of dissimilarity; NULL when no trait takes part."""
    top, weight = F.lit(0.0), F.lit(0.0)
    for w, similarity, part in parts:
        top = top + F.when(part, F.lit(float(w)) * (1.0 - similarity)).otherwise(0.0)
        weight = weight + F.when(part, F.lit(float(w))).otherwise(0.0)
    return top / F.when(weight > 0, weight)


def contribution(weight: float, similarity: Column, part: Column) -> Column:
    """Signed pull of a trait: ``w(2s - 1)``, 0 when it takes no part."""
    return F.when(part, F.lit(float(weight)) * (2.0 * similarity - 1.0)).otherwise(F.lit(0.0))
