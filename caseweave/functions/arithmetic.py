"""Derived clinical indices: an arithmetic expression over named operands."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F


def _nonzero(c: Column) -> Column:
    return F.when(c != 0, c)


def _positive(c: Column) -> Column:
    return F.when(c > 0, c)


N_ARY = {
    "+": lambda cs: reduce(lambda a, b: a + b, cs),
    "*": lambda cs: reduce(lambda a, b: a * b, cs),
    "min": lambda cs: F.least(*cs),
    "max": lambda cs: F.greatest(*cs),
}
BINARY = {
    "-": lambda a, b: a - b,
    "/": lambda a, b: a / _nonzero(b),
}


def index_column(node: Any, operands: Mapping[str, Column]) -> Column:
    """Column for ``node``: an operand name, a number, or ``{"op", "args"}``.

    Division by zero and the logarithm of a non-positive value give NULL, so a
    threshold on the result drops the row.
    """
    if isinstance(node, bool):
        raise ValueError("a boolean is not an operand")
    if isinstance(node, (int, float)):
        return F.lit(float(node))
    if isinstance(node, str):
        return operands[node].cast("double")
    op, args = node["op"], [index_column(a, operands) for a in node["args"]]
    if op == "ln" and len(args) == 1:
        return F.ln(_positive(args[0]))
    if op in BINARY and len(args) == 2:
        return BINARY[op](*args)
    if op in N_ARY and len(args) >= 2:
        return N_ARY[op](args)
    raise ValueError(f"operator {op!r} does not take {len(args)} arguments")


COMPARE = {
    ">": lambda a, b: a > b,
    "<": lambda a, b: a < b,
    ">=": lambda a, b: a >= b,
    "<=": lambda a, b: a <= b,
    "=": lambda a, b: a == b,
}


def compare(column: Column, operator: str, value: Any) -> Column:
    return COMPARE[operator](column, F.lit(value))
