"""Allen relations between two intervals; an instant has equal ends."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

RELATIONS = ("before", "meets", "overlaps", "starts", "during", "finishes")


def relation(a_start: Column, a_end: Column, b_start: Column, b_end: Column) -> Column:
    """Name of the relation of A to B, or NULL when none of the six holds."""
    return (
        F.when(a_end < b_start, "before")
        .when((a_end == b_start) & (a_start < b_start), "meets")
        .when((a_start < b_start) & (b_start < a_end) & (a_end < b_end), "overlaps")
        .when((a_start == b_start) & (a_end < b_end), "starts")
        .when((b_start < a_start) & (a_end < b_end), "during")
        .when((a_end == b_end) & (a_start > b_start), "finishes")
    )
