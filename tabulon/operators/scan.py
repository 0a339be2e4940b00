"""Scans: full, key range, point and multi-point get, covering index, index lookup, samples, constant relations."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def full_scan(table: DataFrame, columns: Sequence[str] = ()) -> DataFrame:
    """All rows; only the columns asked for are read."""
    return table.select(*columns) if columns else table


def range_scan(table: DataFrame, key: str, low=None, high=None, low_open: bool = False, high_open: bool = True, columns: Sequence[str] = ()) -> DataFrame:
    """Rows whose key lies in the range; the bounds reach the Parquet scan as pushed filters."""
    k, cond = F.col(key), F.lit(True)
    if low is not None:
        cond = cond & (k > low if low_open else k >= low)
    if high is not None:
        cond = cond & (k < high if high_open else k <= high)
    return full_scan(table.where(cond), columns)


def point_get(table: DataFrame, keys: Sequence[str], values: Sequence[Sequence], columns: Sequence[str] = ()) -> DataFrame:
    """Rows of fully given key values, e.g. keys ("a", "b"), values [(1, 2), (3, 4)]. Few values become a pushed filter; many a join."""
    if len(values) > 1000:
        spark = table.sparkSession
        wanted = spark.createDataFrame([tuple(v) for v in values], table.select(*keys).schema).distinct()
        return full_scan(table.join(wanted, list(keys), "left_semi").select(*table.columns), columns)
    if len(keys) == 1:
        return full_scan(table.where(F.col(keys[0]).isin([v[0] for v in values])), columns)
    terms = [reduce(lambda a, b: a & b, (F.col(k) == x for k, x in zip(keys, v, strict=True))) for v in values]
    return full_scan(table.where(reduce(lambda a, b: a | b, terms) if terms else F.lit(False)), columns)


def index_scan(table: DataFrame, columns: Sequence[str], condition: Column | None = None) -> DataFrame:
    """Covering index: only the indexed columns are read."""
    out = table.where(condition) if condition is not None else table
    return out.select(*columns)


def index_lookup(index: DataFrame, table: DataFrame, keys: Sequence[str], condition: Column) -> DataFrame:
    """Index rows by the condition, then the table's rows of their keys. An empty index side ends in an empty relation under adaptive execution."""
    found = index.where(condition).select(*keys).distinct()
    return table.join(found, list(keys), "left_semi").select(*table.columns)


def reservoir(table: DataFrame, k: int, seed: int = 0) -> DataFrame:
    """Exactly k rows (all if fewer), each set of k as likely as any other: the k least random numbers, kept per partition first."""
    return table.withColumn("_r", F.rand(seed)).orderBy("_r").limit(k).drop("_r")


def sample(table: DataFrame, ratio: float, seed: int = 0) -> DataFrame:
    """Each row with the chance ratio."""
    return table.sample(fraction=ratio, seed=seed)


def dual(spark: SparkSession, rows: int = 1, **values: Column) -> DataFrame:
    """Constant relation."""
    return spark.range(rows).select(*(v.alias(k) for k, v in values.items()))


def key_scan(table: DataFrame, key: str, start=None, end=None, limit: int | None = None) -> DataFrame:
    """Rows of [start, end) in key order, `limit` at most."""
    out = range_scan(table, key, start, end).orderBy(key)
    return out.limit(limit) if limit is not None else out
