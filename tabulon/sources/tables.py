"""Tables: names, declared columns, keys and indices over DataFrames; written versions where they change."""

from __future__ import annotations

import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

#: The star schema's primary keys.
KEYS = {
    "region": ("r_regionkey",), "nation": ("n_nationkey",), "customer": ("c_custkey",), "supplier": ("s_suppkey",), "part": ("p_partkey",),
    "orders": ("o_orderkey",), "lineitem": ("l_orderkey", "l_linenumber"), "events": ("event_id",),
}


class UnknownName(KeyError, ValueError):
    """No such table or column."""


@dataclass
class ColumnInfo:
    name: str
    type: str
    nullable: bool = True
    default: str | None = None
    auto_increment: bool = False
    on_update: str | None = None
    comment: str = ""


@dataclass
class Index:
    name: str
    columns: tuple[str, ...]
    unique: bool = False
    primary: bool = False


@dataclass
class Table:
    """A relation with metadata. `data` is the current version; keys and indices guide point gets and checks, not storage."""

    name: str
    columns: list[ColumnInfo]
    data: DataFrame
    indices: list[Index] = field(default_factory=list)
    comment: str = ""

    @property
    def primary(self) -> tuple[str, ...]:
        return next((i.columns for i in self.indices if i.primary), ())

    def unique_keys(self) -> list[tuple[str, ...]]:
        return [i.columns for i in self.indices if i.primary or i.unique]

    def column(self, name: str) -> ColumnInfo:
        found = next((c for c in self.columns if c.name.lower() == name.lower()), None)
        if found is None:
            raise UnknownName(f"no column {name} in {self.name}")
        return found


def type_name(kind: T.DataType) -> str:
    names = {"ByteType": "tinyint", "ShortType": "smallint", "IntegerType": "int", "LongType": "bigint", "FloatType": "float", "DoubleType": "double", "StringType": "varchar(255)", "BinaryType": "blob", "DateType": "date", "TimestampType": "timestamp", "TimestampNTZType": "datetime", "BooleanType": "tinyint", "DayTimeIntervalType": "time"}
    return kind.simpleString() if isinstance(kind, T.DecimalType) else names.get(type(kind).__name__, "text")


class Catalog:
    """Databases of tables. Changed tables are written as new Parquet versions under `root`: by default in the folder of spark.checkpoint.dir, or else in the warehouse."""

    def __init__(self, spark: SparkSession, root: str | None = None, database: str = "test"):
        self.spark, self.root = spark, root
        self.databases: dict[str, dict[str, Table]] = {database: {}}
        self.current = database

    def table(self, name: str) -> Table:
        db, _, bare = name.replace("`", "").rpartition(".")
        try:
            return self.databases[db or self.current][bare.lower()]
        except KeyError:
            raise UnknownName(f"no table {name}") from None

    def add(self, table: Table, database: str | None = None) -> Table:
        self.databases[database or self.current][table.name.lower()] = table
        table.data.createOrReplaceTempView(self.view(table.name, database))
        return table

    def view(self, name: str, database: str | None = None) -> str:
        """Name of the temporary view of a table."""
        db, _, bare = name.replace("`", "").rpartition(".")
        return f"{(db or database or self.current).lower()}__{bare.lower()}"

    def register(self, name: str, data: DataFrame, primary: tuple[str, ...] = (), unique: tuple[tuple[str, ...], ...] = ()) -> Table:
        """A DataFrame as a table."""
        columns = [ColumnInfo(f.name, type_name(f.dataType), f.nullable and f.name not in primary) for f in data.schema.fields]
        indices = ([Index("PRIMARY", primary, True, True)] if primary else []) + [Index("uk_" + "_".join(u), u, True) for u in unique]
        return self.add(Table(name, columns, data, indices))

    def load(self, folder: str, names: tuple[str, ...] = tuple(KEYS), form: str = "parquet") -> Catalog:
        """Tables `folder/name.form`, read lazily."""
        for name in names:
            self.register(name, read(self.spark, f"{folder}/{name}.{form}", form), KEYS.get(name, ()))
        return self

    def versions(self) -> str:
        """Folder of written versions, which all executors share."""
        if not self.root:
            conf = self.spark.sparkContext.getConf()
            base = conf.get("spark.checkpoint.dir") or self.spark.sparkContext.getCheckpointDir() or self.spark.conf.get("spark.sql.warehouse.dir")
            self.root = f"{base.rstrip('/')}/tabulon-versions-{uuid.uuid4().hex}"
        return self.root.rstrip("/")

    def written(self, table: Table, data: DataFrame) -> DataFrame:
        """The rows of a new version, written: plans stay short, readers of the old version are not disturbed, and each read finds the same."""
        path = f"{self.versions()}/{self.current}/{table.name}/{uuid.uuid4().hex}"
        data = data.select(*(c.name for c in table.columns))
        data.write.parquet(path)
        return self.spark.read.schema(data.schema).parquet(path)

    def replace(self, table: Table, data: DataFrame) -> Table:
        """A version that is written becomes the table's."""
        table.data = data
        data.createOrReplaceTempView(self.view(table.name))
        return table


def read(spark: SparkSession, path: str, form: str = "parquet", schema: T.StructType | str | None = None, **options: str) -> DataFrame:
    """A file source. CSV and JSON need a schema: inference would read all the data once more."""
    if form in ("csv", "json") and schema is None:
        raise ValueError(f"{form} needs a schema")
    reader = spark.read.format(form).options(**({"header": "true"} | options if form == "csv" else options))
    return (reader.schema(schema) if schema is not None else reader).load(path)


def write(data: DataFrame, path: str, form: str = "parquet", partition_by: tuple[str, ...] = (), sort_by: tuple[str, ...] = (), mode: str = "errorifexists") -> None:
    """A file sink. sort_by clusters rows by range before writing, so that row-group statistics prune range scans: the counterpart of an index."""
    if sort_by:
        data = data.repartitionByRange(*sort_by).sortWithinPartitions(*sort_by)
    data.write.format(form).mode(mode).partitionBy(*partition_by).save(path)
