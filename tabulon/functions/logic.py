"""Comparison, null tests, logic and control flow.

Three-valued logic throughout. The *_two forms are the compatible two-valued ones: a null operand counts as false.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def truth(x: Column) -> Column:
    """A condition of a number or boolean: true iff it is not 0."""
    return x.cast("boolean")


def null_safe_equal(a: Column, b: Column) -> Column:
    return a.eqNullSafe(b)


def between(x: Column, low: Column, high: Column) -> Column:
    return (x >= low) & (x <= high)


def in_list(x: Column, *items: Column) -> Column:
    return reduce(lambda a, b: a | b, ((x == i) for i in items))


def and_two(a: Column, b: Column) -> Column:
    return F.coalesce(truth(a), F.lit(False)) & F.coalesce(truth(b), F.lit(False))


def or_two(a: Column, b: Column) -> Column:
    return F.coalesce(truth(a), F.lit(False)) | F.coalesce(truth(b), F.lit(False))


def in_two(x: Column, *items: Column) -> Column:
    return F.coalesce(in_list(x, *items), F.lit(False))


def xor(a: Column, b: Column) -> Column:
    return truth(a) != truth(b)


def is_true(x: Column) -> Column:
    return F.coalesce(truth(x), F.lit(False))


def is_false(x: Column) -> Column:
    return F.coalesce(~truth(x), F.lit(False))


def if_(c: Column, a: Column, b: Column) -> Column:
    return F.when(truth(c), a).otherwise(b)


def interval(x: Column, *bounds: Column) -> Column:
    """How many of the ascending bounds are at most x; -1 for null."""
    return F.when(x.isNull(), -1).otherwise(sum((F.when(b <= x, 1).otherwise(0) for b in bounds), F.lit(0)))


def case(operand: Column | None, whens: list[tuple[Column, Column]], otherwise: Column | None) -> Column:
    out = None
    for c, v in whens:
        test = (operand == c) if operand is not None else truth(c)
        out = F.when(test, v) if out is None else out.when(test, v)
    return out.otherwise(otherwise) if otherwise is not None else out
