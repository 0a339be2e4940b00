"""The cast matrix over integers, doubles, strings, decimals, dates with time, and times. What cannot be converted is null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import temporal as t

KINDS = ("int", "real", "string", "decimal", "date", "time")
_SPARK = {"int": "long", "real": "double", "decimal": "decimal(38,10)", "string": "string"}


def prefix_number(x: Column) -> Column:
    """The number that a text begins with, 0 if none: the dialect's implicit conversion."""
    found = F.regexp_extract(F.trim(x), r"^[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?", 0)
    return F.when(x.isNull(), F.lit(None).cast("double")).when(found == "", F.lit(0.0)).otherwise(found.try_cast("double"))


def cast(x: Column, source: str, target: str) -> Column:
    """x of one of KINDS as another. Dates and times stand for packed numbers (YYYYMMDDhhmmss, hhmmss) among numbers."""
    if source == target:
        return x
    if target in ("int", "real", "decimal"):
        number = t.pack(x) if source == "date" else t.pack_time(x) if source == "time" else x
        if target == "int" and source in ("real", "decimal"):
            return F.round(number, 0).try_cast("long")
        if target == "int" and source == "string":
            return F.coalesce(number.try_cast("long"), F.round(number.try_cast("double"), 0).try_cast("long"))
        return number.try_cast(_SPARK[target])
    if target == "string":
        if source == "date":
            return F.date_format(x.cast("timestamp_ntz"), "yyyy-MM-dd HH:mm:ss")
        return t.time_text(t.interval_seconds(x)) if source == "time" else x.cast("string")
    if target == "date":
        if source == "string":
            return F.coalesce(F.call_function("try_to_timestamp", x).cast("timestamp_ntz"), t.unpack(x.try_cast("long")))
        if source == "time":
            return F.date_trunc("day", F.localtimestamp()).cast("timestamp_ntz") + x
        return t.unpack(x.try_cast("long"))
    if source == "string":
        return F.coalesce(t.parse_time(x), t.unpack_time(x.try_cast("long")))
    return t.time_part(x) if source == "date" else t.unpack_time(x.try_cast("long"))
