"""Time windows over batch or streaming frames (extension). With a watermark late rows are dropped and state stays bounded."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _watermarked(data: DataFrame, time: str, late: str | None) -> DataFrame:
    return data.withWatermark(time, late) if late else data


def tumbling(data: DataFrame, time: str, size: str, keys: Sequence[str], aggregates: Mapping[str, Column], late: str | None = None, slide: str | None = None) -> DataFrame:
    """Aggregates by window start and keys; with slide, overlapping windows."""
    w = F.window(time, size, slide) if slide else F.window(time, size)
    out = _watermarked(data, time, late).groupBy(w.alias("_w"), *keys).agg(*(c.alias(k) for k, c in aggregates.items()))
    return out.select(F.col("_w.start").cast(data.schema[time].dataType).alias("start"), *keys, *aggregates)


def sessions(data: DataFrame, time: str, gap: str, keys: Sequence[str], aggregates: Mapping[str, Column], late: str | None = None) -> DataFrame:
    """Aggregates by session: rows of a key less than gap apart."""
    out = _watermarked(data, time, late).groupBy(F.session_window(time, gap).alias("_w"), *keys).agg(*(c.alias(k) for k, c in aggregates.items()))
    return out.select(F.col("_w.start").cast(data.schema[time].dataType).alias("start"), *keys, *aggregates)


def deduplicated(data: DataFrame, time: str, keys: Sequence[str], late: str) -> DataFrame:
    """First row of each key within the watermark."""
    return data.withWatermark(time, late).dropDuplicatesWithinWatermark(list(keys))


def run_available(stream: DataFrame, folder: str) -> DataFrame:
    """Runs a streaming frame over all that its source has now, appends its rows under `folder` (with its checkpoint) and reads them. A window's
    row comes once the watermark has passed its end; a later run with the same folder goes on where this one ended."""
    query = stream.writeStream.format("parquet").outputMode("append").option("path", f"{folder}/rows").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{folder}/rows")
