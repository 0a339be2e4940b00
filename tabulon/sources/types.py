"""SQL column types and the Spark types that hold them."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The Spark type of each SQL type; unsigned integers take the next wider one.
SPARK_TYPES = {
    "bool": T.ByteType(), "boolean": T.ByteType(), "tinyint": T.ByteType(), "smallint": T.ShortType(), "mediumint": T.IntegerType(),
    "int": T.IntegerType(), "integer": T.IntegerType(), "bigint": T.LongType(), "bit": T.LongType(),
    "float": T.FloatType(), "double": T.DoubleType(), "real": T.DoubleType(),
    "date": T.DateType(), "timestamp": T.TimestampType(), "datetime": T.TimestampNTZType(), "time": T.DayTimeIntervalType(0, 3), "year": T.ShortType(),
    "char": T.StringType(), "nchar": T.StringType(), "varchar": T.StringType(), "tinytext": T.StringType(), "text": T.StringType(), "mediumtext": T.StringType(), "longtext": T.StringType(),
    "json": T.StringType(), "enum": T.StringType(), "set": T.StringType(),
    "binary": T.BinaryType(), "varbinary": T.BinaryType(), "bytea": T.BinaryType(), "tinyblob": T.BinaryType(), "blob": T.BinaryType(), "mediumblob": T.BinaryType(), "longblob": T.BinaryType(),
}
UNSIGNED = {"tinyint": T.ShortType(), "smallint": T.IntegerType(), "mediumint": T.IntegerType(), "int": T.LongType(), "integer": T.LongType(), "bigint": T.DecimalType(20, 0)}
#: Bits of the integer types.
BITS = {"tinyint": 8, "smallint": 16, "mediumint": 24, "int": 32, "integer": 32, "bigint": 64}


def spark_type(sql: str) -> T.DataType:
    """Spark type of a declared type such as `varchar(255)`, `decimal(10,2)` or `bigint unsigned`. Decimals are cut to 38 digits."""
    m = re.fullmatch(r"\s*(\w+)\s*(?:\(([^)]*)\))?\s*(unsigned)?.*", sql.lower(), re.S)
    name, args, unsigned = m[1], m[2], m[3]
    if name in ("decimal", "numeric", "number", "dec"):
        p, _, s = (args or "10,0").partition(",")
        return T.DecimalType(min(38, int(p)), min(int(s or 0), 30, int(p)))
    if unsigned and name in UNSIGNED:
        return UNSIGNED[name]
    if name not in SPARK_TYPES:
        raise ValueError(f"unknown type {sql}")
    return SPARK_TYPES[name]


def limits(sql: str) -> tuple[int, int] | None:
    """Least and greatest value of an integer type."""
    m = re.match(r"\s*(\w+).*?(unsigned)?\s*$", sql.lower(), re.S)
    if m[1] not in BITS:
        return None
    n = BITS[m[1]]
    return (0, 2**n - 1) if "unsigned" in sql.lower() else (-(2 ** (n - 1)), 2 ** (n - 1) - 1)


def checked(value: Column, sql: str) -> Column:
    """value as the type; out of its range raises."""
    if (ends := limits(sql)) is None:
        m = re.match(r"\s*(?:var|n)?char\s*\((\d+)\)", sql.lower())
        text = value.cast(spark_type(sql))
        return F.when(F.char_length(text) > int(m[1]), F.raise_error(F.lit("data too long")).cast("string")).otherwise(text) if m else text
    wide = value.cast("decimal(30,0)")
    return F.when(wide.between(F.lit(str(ends[0])).cast("decimal(30,0)"), F.lit(str(ends[1])).cast("decimal(30,0)")) | wide.isNull(), wide).otherwise(F.raise_error(F.lit(f"out of range for {sql}")).cast("decimal(30,0)")).cast(spark_type(sql))
