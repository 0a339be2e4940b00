"""Changes as DataFrame rewrites: each returns the table's new rows."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def insert(table: DataFrame, rows: DataFrame, defaults: Mapping[str, Column] | None = None, auto: str | None = None) -> DataFrame:
    """Rows added; missing columns take their default or null. Null or missing values of `auto` are numbered on from the greatest one."""
    for name, kind in table.dtypes:
        if name not in rows.columns:
            rows = rows.withColumn(name, (defaults or {}).get(name, F.lit(None)).cast(kind))
    rows = rows.select(*(F.col(n).cast(k).alias(n) for n, k in table.dtypes))
    if auto:
        last = table.agg(F.max(auto).alias("m")).union(rows.agg(F.max(auto))).agg(F.coalesce(F.max("m"), F.lit(0)).alias("last"))
        nth = F.row_number().over(Window.partitionBy(F.col(auto).isNull()).orderBy(F.monotonically_increasing_id()))  # rows of one statement
        rows = rows.withColumn("_n", F.when(F.col(auto).isNull(), nth)).join(F.broadcast(last))
        rows = rows.withColumn(auto, F.coalesce(F.col(auto), F.col("last") + F.col("_n")).cast(dict(table.dtypes)[auto])).select(*table.columns)
    return table.unionByName(rows)


def upsert(table: DataFrame, rows: DataFrame, key: Sequence[str], updates: Mapping[str, Callable[[Callable[[str], Column], Callable[[str], Column]], Column]]) -> DataFrame:
    """INSERT ... ON DUPLICATE KEY UPDATE: rows of a known key change the columns of `updates` (functions of old and new column getters); others are added.

    rows must have different keys: a statement's rows that share one are folded first, see `fold`."""
    old = table.select(F.struct(*table.columns).alias("o"), *(F.col(k).alias(f"_k{i}") for i, k in enumerate(key)))
    new = rows.select(F.struct(*table.columns).alias("n"), *(F.col(k).alias(f"_k{i}") for i, k in enumerate(key)))
    both = old.join(new, [f"_k{i}" for i in range(len(key))], "full_outer")
    was, is_ = (lambda c: F.col("o")[c]), (lambda c: F.col("n")[c])

    def value(c: str, kind: str) -> Column:
        changed = updates[c](was, is_).cast(kind) if c in updates else was(c)
        return F.when(F.col("o").isNull(), is_(c)).when(F.col("n").isNull(), was(c)).otherwise(changed).alias(c)

    return both.select(*(value(c, k) for c, k in table.dtypes))


def _first(table: DataFrame, condition: Column, key: Sequence[str], order: Sequence[Column], limit: int) -> DataFrame:
    """Keys of the first `limit` rows that meet the condition."""
    return table.where(condition).orderBy(*order, *key).limit(limit).select(*key)


def update(table: DataFrame, values: Mapping[str, Column], condition: Column, key: Sequence[str] = (), order: Sequence[Column] = (), limit: int | None = None) -> DataFrame:
    """UPDATE ... SET ... WHERE; with a limit, of the first rows by order (then key)."""
    hit = F.coalesce(condition, F.lit(False))
    if limit is not None:
        chosen = _first(table, condition, key, order, limit).withColumn("_hit", F.lit(True))
        table, hit = table.join(chosen, list(key), "left"), F.col("_hit").isNotNull()
    kinds = dict(table.dtypes)
    return table.select(*(F.when(hit, values[c]).otherwise(F.col(c)).cast(kinds[c]).alias(c) if c in values else F.col(c) for c in kinds if c != "_hit"))


def delete(table: DataFrame, condition: Column, key: Sequence[str] = (), order: Sequence[Column] = (), limit: int | None = None) -> DataFrame:
    """DELETE ... WHERE; rows for which the condition is null stay."""
    if limit is not None:
        return table.join(_first(table, condition, key, order, limit), list(key), "left_anti").select(*table.columns)
    return table.where(~F.coalesce(condition, F.lit(False)))


def tagged(table: DataFrame, keys: Sequence[Sequence[str]], given: DataFrame) -> DataFrame:
    """table with `_hit`: whether a row has a value of one of the unique keys that a row of `given` (the rows of one statement) has, too."""
    names = table.columns
    for i, key in enumerate(keys):
        known = given.select(*key).na.drop().distinct().withColumn(f"_m{i}", F.lit(True))
        table = table.join(F.broadcast(known), list(key), "left")
    hit = reduce(lambda a, b: a | b, (F.coalesce(F.col(f"_m{i}"), F.lit(False)) for i in range(len(keys))), F.lit(False))
    return table.select(*names, hit.alias("_hit"))


def places(rows: Sequence[Sequence], names: Sequence[str], keys: Sequence[Sequence[str]]) -> list[dict[tuple, int]]:
    """By unique key: the index of the row of each value. Keys with a null bind nothing."""
    at = [[names.index(c) for c in key] for key in keys]
    found: list[dict[tuple, int]] = [{} for _ in keys]
    for i, row in enumerate(rows):
        for where, key in zip(found, at, strict=True):
            value = tuple(row[c] for c in key)
            if None not in value:
                where.setdefault(value, i)
    return found


def repeated(rows: Sequence[Sequence], names: Sequence[str], keys: Sequence[Sequence[str]]) -> Sequence[str] | None:
    """A unique key of which two rows have one value."""
    for key, found in zip(keys, places(rows, names, keys), strict=True):
        at = [names.index(c) for c in key]
        if len(found) < sum(None not in [r[c] for c in at] for r in rows):
            return key
    return None


def fold(current: list[tuple], rows: Sequence[tuple], names: Sequence[str], keys: Sequence[Sequence[str]], update: Callable[[list[tuple[tuple, tuple]]], list[tuple]]) -> list[tuple]:
    """INSERT ... ON DUPLICATE KEY UPDATE of a statement's rows, one after the other: a row that has a value of a unique key (the first key
    first) of a row there changes that row, else it is added, where the next ones meet it. `update` changes pairs (old, new) of different old rows."""
    at, waiting = 0, {}
    while at < len(rows):
        found = places(current, names, keys)
        while at < len(rows):
            row = rows[at]
            values = [tuple(row[names.index(c)] for c in key) for key in keys]
            hit = next((where[v] for where, v in zip(found, values, strict=True) if None not in v and v in where), None)
            if hit in waiting:
                break
            if hit is None:
                for where, v in zip(found, values, strict=True):
                    where.setdefault(v, len(current))
                current.append(row)
            else:
                waiting[hit] = row
            at += 1
        for i, changed in zip(waiting, update([(current[i], new) for i, new in waiting.items()]) if waiting else (), strict=True):
            current[i] = changed
        waiting = {}
    return current
