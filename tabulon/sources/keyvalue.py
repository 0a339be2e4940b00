"""Key-value access over a two-column table: gets are pushed filters, writes are one new version for a batch of changes."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import scan


class KeyValue:
    """put, get and delete of bytes by key; hashes are kept as fields of a key. Changes are collected until flush()."""

    SCHEMA = "key binary, field string, value binary"

    def __init__(self, spark: SparkSession, data: DataFrame | None = None):
        self.spark = spark
        self.data = data if data is not None else spark.createDataFrame([], self.SCHEMA)
        self._changes: dict[tuple[bytes, str | None], bytes | None] = {}

    def set(self, values: Mapping[bytes, bytes]) -> None:
        self._changes |= {(k, None): v for k, v in values.items()}

    def hset(self, key: bytes, fields: Mapping[str, bytes]) -> None:
        self._changes |= {(key, f): v for f, v in fields.items()}

    def delete(self, keys: Iterable[bytes]) -> None:
        """Removes the keys with all their fields."""
        self.flush()
        keys = list(keys)
        self.data = self.data.where(~F.col("key").isin(keys)) if keys else self.data

    def flush(self) -> DataFrame:
        """The table with the changes so far."""
        if self._changes:
            new = self.spark.createDataFrame([(k, f, v) for (k, f), v in self._changes.items()], self.SCHEMA)
            same = (F.col("o.key") == F.col("n.key")) & F.col("o.field").eqNullSafe(F.col("n.field"))
            self.data = self.data.alias("o").join(new.alias("n"), same, "left_anti").unionByName(new)
            self._changes = {}
        return self.data

    def get(self, keys: Iterable[bytes]) -> dict[bytes, bytes]:
        rows = scan.point_get(self.flush().where(F.col("field").isNull()), ("key",), [(k,) for k in keys]).collect()
        return {bytes(r.key): bytes(r.value) for r in rows}

    def hget(self, key: bytes, fields: Iterable[str] | None = None) -> dict[str, bytes]:
        """The fields asked for, or all."""
        rows = self.flush().where((F.col("key") == F.lit(key)) & F.col("field").isNotNull())
        rows = rows if fields is None else rows.where(F.col("field").isin(list(fields)))
        return {r.field: bytes(r.value) for r in rows.collect()}
