"""Change data capture (extension): a log of row changes applied to a table, in batch or by foreachBatch.

Delivery is at least once: applying a change twice, or an older one after a newer, leaves the same table.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def latest(log: DataFrame, key: Sequence[str], order: Sequence[str], op: str = "op") -> DataFrame:
    """Each key's newest change by order, deletions left out. A partial aggregate per task, so a hot key costs one row a task."""
    last = log.groupBy(*key).agg(F.max_by(F.struct(*log.columns), F.struct(*order)).alias("_r"))
    return last.select("_r.*").where(F.col(op) != "delete")


def apply(table: DataFrame, log: DataFrame, key: Sequence[str], order: Sequence[str], op: str = "op") -> DataFrame:
    """table (with the order columns) after the log: newer changes replace rows, deletions remove them."""
    columns = table.columns
    both = table.withColumn(op, F.lit("upsert")).select(*columns, op).unionByName(log.select(*columns, op))
    return latest(both, key, order, op).select(*columns)


def sink(read: Callable[[], DataFrame], write: Callable[[DataFrame], None], key: Sequence[str], order: Sequence[str], op: str = "op") -> Callable[[DataFrame, int], None]:
    """A foreachBatch function: reads the table, applies the batch, writes the new version."""

    def step(batch: DataFrame, epoch: int) -> None:
        write(apply(read(), batch, key, order, op))

    return step
