"""Aggregation: ANSI forms, typed compatibility forms, hidden aggregates, first-value columns.

Decisions where implementations of the dialect differ: COUNT(expr), MIN and MAX skip nulls; SUM of no rows is null (sum_or_zero gives the
compatible 0); columns that are not grouped take their first non-null value, which is defined only where the group determines it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def aggregate(data: DataFrame, keys: Sequence[str | Column], aggregates: dict[str, Column], having: Column | str | None = None, order: Sequence[Column] = (), limit: int | None = None, hidden: dict[str, Column] | None = None) -> DataFrame:
    """GROUP BY keys with named aggregates. `hidden` ones can be used by having and order and do not come out."""
    out = data.groupBy(*keys).agg(*(c.alias(k) for k, c in {**aggregates, **(hidden or {})}.items()))
    if having is not None:
        out = out.where(having)
    if order:
        out = out.orderBy(*order)
    if limit is not None:
        out = out.limit(limit)
    return out.drop(*(hidden or {}))


def first_value(column: str | Column) -> Column:
    """The implicit aggregate of a column that is not grouped."""
    return F.first(column, ignorenulls=True)


def sum_or_zero(column: str | Column) -> Column:
    """SUM that is 0 for no rows."""
    return F.coalesce(F.sum(column), F.lit(0))


def avg_exact(column: str | Column, scale: int = 4) -> Column:
    """AVG of integers as a decimal with four more digits, half even: sum and count are partial aggregates, the quotient final."""
    wide = (F.col(column) if isinstance(column, str) else column).cast("decimal(28,0)")
    return F.bround((F.sum(wide).cast("decimal(32,6)") / F.count(wide)).cast("decimal(38,12)"), scale).cast(f"decimal(38,{scale})")


def group_concat(column: str | Column, separator: str = ",", distinct: bool = False) -> Column:
    """GROUP_CONCAT in ascending order of the values, so that the result does not depend on the partitions. A group's text is one value."""
    values = F.collect_set(column) if distinct else F.collect_list(column)
    return F.when(F.size(values) > 0, F.array_join(F.transform(F.array_sort(values), lambda x: x.cast("string")), separator))


def unique_key_groups(data: DataFrame, key: Sequence[str], keys: Sequence[str], aggregates: dict[str, Column]) -> DataFrame | None:
    """GROUP BY over a superset of a unique key without a shuffle: every row is a group. aggregates: the one-row forms. None if it does not apply."""
    if not set(key) <= set(keys):
        return None
    return data.select(*keys, *(c.alias(k) for k, c in aggregates.items()))


def one_row_count(column: Column) -> Column:
    return column.isNotNull().cast("long")
