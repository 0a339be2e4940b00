"""Projection, selection, ordering, limits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def project(data: DataFrame, **columns: Column | str) -> DataFrame:
    """Named expressions: a Column or SQL text."""
    return data.select(*((F.expr(c) if isinstance(c, str) else c).alias(k) for k, c in columns.items()))


def select(data: DataFrame, condition: Column | str) -> DataFrame:
    """Rows for which the condition is true, by three-valued logic: null drops the row."""
    return data.where(condition)


def select_two_valued(data: DataFrame, condition: Column) -> DataFrame:
    """As select, with a null condition as false before any NOT above it: the compatibility form of AND, OR and IN."""
    return data.where(F.coalesce(condition, F.lit(False)))


def order(data: DataFrame, *keys: tuple[str | Column, bool] | str) -> DataFrame:
    """Sorted by (key, descending): nulls are the least value, so first when ascending, last when descending."""
    out = []
    for k in keys:
        key, down = k if isinstance(k, tuple) else (k, False)
        c = F.col(key) if isinstance(key, str) else key
        out.append(c.desc_nulls_last() if down else c.asc_nulls_first())
    return data.orderBy(*out)


def limit(data: DataFrame, count: int, offset: int = 0) -> DataFrame:
    """`LIMIT offset, count`. A count of 0 is the empty relation; counts beyond the engine's integer are no limit."""
    if offset:
        data = data.offset(min(offset, 2**31 - 1))
    return data.limit(count) if count < 2**31 - 1 else data


def top_n(data: DataFrame, keys: Sequence[tuple[str | Column, bool] | str], count: int, offset: int = 0) -> DataFrame:
    """Order and limit in one operator: each task keeps offset + count rows at most."""
    return limit(order(data, *keys), count, offset)


def distinct(data: DataFrame, *columns: str) -> DataFrame:
    """Distinct values of the columns (of all without any)."""
    return (data.select(*columns) if columns else data).distinct()
