"""Associative operations with an identity, as aggregates, windows and column expressions."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec


@dataclass(frozen=True)
class Monoid:
    """A built-in aggregate and the operation on two values it stands for.

    Nulls stand for "nothing yet" while partial results are put together.
    """

    name: str
    agg: Callable[[Column], Column]
    both: Callable[[Column, Column], Column]
    identity: object = None

    def over(self, value: Column, window: WindowSpec) -> Column:
        return self.agg(value).over(window)

    def join(self, *parts: Column | None) -> Column:
        """The parts combined from left to right, leaving out those that are null."""
        out: Column | None = None
        for p in parts:
            if p is None:
                continue
            out = p if out is None else F.when(out.isNull(), p).when(p.isNull(), out).otherwise(self.both(out, p))
        return out if self.identity is None else F.coalesce(out, F.lit(self.identity))


add = Monoid("add", F.sum, lambda a, b: a + b, 0)
multiply = Monoid("multiply", F.product, lambda a, b: a * b, 1)
minimum = Monoid("minimum", F.min, lambda a, b: F.least(a, b))
maximum = Monoid("maximum", F.max, lambda a, b: F.greatest(a, b))
bit_and = Monoid("bit_and", F.bit_and, lambda a, b: a.bitwiseAND(b))
bit_or = Monoid("bit_or", F.bit_or, lambda a, b: a.bitwiseOR(b), 0)
bit_xor = Monoid("bit_xor", F.bit_xor, lambda a, b: a.bitwiseXOR(b), 0)
all_true = Monoid("all_true", F.bool_and, lambda a, b: a & b, True)
any_true = Monoid("any_true", F.bool_or, lambda a, b: a | b, False)


def total_order(column: str, kind: str) -> list[Column]:
    """Sort keys that order floats totally: -0.0 before 0.0, NaN last.  Other types sort as they are."""
    c = F.col(column)
    if kind in ("float", "double"):
        return [c.asc(), F.when(c.cast("string") == "-0.0", 0).otherwise(1).asc()]
    return [c.asc()]
