"""Three-valued truth with reasons and flags, as three columns of one row.

``v`` is 0 false, 1 unknown, 2 true; ``r`` a bit set of reasons, only where unknown;
``m`` a bit set of flags of what decided the answer. Operands of a combinator stand on
one row, so no combinator shuffles.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

FALSE, UNKNOWN, TRUE = 0, 1, 2

#: Reasons in their bit order; the last two only exclude from analyses.
REASONS = ("NOT_ASSESSED", "NOT_COVERED", "NO_INFORMATION", "NO_PARENT", "OUT_OF_SCOPE", "NO_ROWS", "NOT_APPLICABLE", "INVALID_VALUE")
BIT = {name: 1 << i for i, name in enumerate(REASONS)}


@dataclass
class Truth:
    v: Column
    r: Column
    m: Column

    def named(self, prefix: str) -> list[Column]:
        return [self.v.cast("int").alias(f"{prefix}v"), self.r.cast("int").alias(f"{prefix}r"), self.m.cast("long").alias(f"{prefix}m")]

    @classmethod
    def at(cls, prefix: str) -> Truth:
        return cls(F.col(f"{prefix}v"), F.col(f"{prefix}r"), F.col(f"{prefix}m"))


def constant(v: int, r: int = 0, m: int = 0) -> Truth:
    return Truth(F.lit(v), F.lit(r), F.lit(m).cast("long"))


def _union(columns: list[Column]) -> Column:
    return reduce(lambda a, b: a.bitwiseOR(b), columns)


def _combined(operands: list[Truth], v: Column) -> Truth:
    """The rule of both combinators: reasons of unknown operands, flags of those with the result's value."""
    r = _union([F.when(x.v == UNKNOWN, x.r).otherwise(0) for x in operands])
    m = _union([F.when(x.v == v, x.m).otherwise(F.lit(0).cast("long")) for x in operands])
    return Truth(v, F.when(v == UNKNOWN, r).otherwise(0), m)


def all_of(operands: list[Truth]) -> Truth:
    if len(operands) < 2:
        return operands[0] if operands else constant(TRUE)
    return _combined(operands, F.least(*[x.v for x in operands]))


def any_of(operands: list[Truth]) -> Truth:
    if len(operands) < 2:
        return operands[0] if operands else constant(FALSE)
    return _combined(operands, F.greatest(*[x.v for x in operands]))


def not_(x: Truth) -> Truth:
    return Truth(2 - x.v, x.r, x.m)


def known(x: Truth) -> Truth:
    return Truth(F.when(x.v == UNKNOWN, FALSE).otherwise(TRUE), F.lit(0), x.m)


def unknown(x: Truth) -> Truth:
    return Truth(F.when(x.v == UNKNOWN, TRUE).otherwise(FALSE), F.lit(0), x.m)
