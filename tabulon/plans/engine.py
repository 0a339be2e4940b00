"""Statements to results: the entry point for SQL text."""

from __future__ import annotations

import re
import time
from dataclasses import dataclass
from datetime import UTC, date, datetime
from decimal import Decimal
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import dml, scan, statistics
from ..sources.tables import Catalog, ColumnInfo, Index, Table, UnknownName
from ..sources.types import checked, spark_type
from . import compiler
from .parser import Node, Parser, SqlError, split_statements


@dataclass
class Prepared:
    """A statement with `?` places, parsed once; execute() binds them. The catalog's current version of the table is used each time."""

    engine: Engine
    word: str
    tree: dict | None
    places: int
    sql: str

    def execute(self, *params) -> DataFrame:
        if self.tree is None:
            return self.engine.execute(self.sql, params)
        return self.engine.run(self.word, self.tree, self.places, params)


@dataclass
class Kept:
    """A table's statistics: when they were taken, their rows, the table's number of rows, histograms by column."""

    at: str
    table: DataFrame
    rows: int
    histograms: dict[str, DataFrame]


#: Statements with a tree of their own.
STATEMENTS = ("select", "insert", "update", "delete")


def _end(p: Parser) -> None:
    if not p.done():
        raise SqlError(f"not understood: {p.near()!r}")


class Engine:
    """One session: a catalog, variables, and statements in the MySQL dialect over single tables.

    A transaction is one session's: its changes can be rolled back, and other sessions' catalogs do not see them. Index hints are accepted without effect. Not supported, with an error: joins, UNION,
    subqueries, window functions, INSERT ... SELECT, UPDATE and DELETE without WHERE.
    """

    def __init__(self, spark: SparkSession, catalog: Catalog | None = None):
        self.spark, self.catalog = spark, catalog or Catalog(spark)
        self.variables: dict[str, object] = {"@@autocommit": 1, "@@version_comment": "tabulon", "@@sql_mode": "ANSI", "@@time_zone": "UTC", "@@max_allowed_packet": 1 << 26}
        self.statistics: dict[str, Kept] = {}
        self.grants: dict[str, dict[str, set[str]]] = {"'root'@'%'": {"*.*": {"ALL"}}}
        self.questions = 0
        self._before: dict[tuple[str, str], DataFrame] | None = None  # versions at the start of a transaction

    # Entry points

    def execute(self, sql: str, params: tuple = ()) -> DataFrame:
        """One statement's result, lazily where it is a query. Of several statements (changes only) the last one's."""
        self.questions += 1
        many = split_statements(sql)
        if len(many) > 1:
            if not all(re.match(r"\s*(insert|update|delete)\b", s, re.I) for s in many):
                raise SqlError("only changes can be sent together")
            return [self.execute(s) for s in many][-1]
        p = Parser(many[0] if many else "")
        word = p.tokens[0].text.lower() if p.tokens else ""
        if word in STATEMENTS:
            q = getattr(p, word)()
            _end(p)
            return self.run(word, q, p.params, tuple(params))
        if word in ("commit", "rollback", "begin", "start"):
            p.i += 1
            p.take("transaction") or p.take("work")
            _end(p)
            return self._transaction(word)
        if handler := getattr(self, f"_{'describe' if word == 'desc' else word}", None):
            try:
                out = handler(p)
            except UnknownName as e:
                raise SqlError(str(e.args[0])) from None
            _end(p)
            return out
        raise SqlError(f"not supported: {sql[:60]!r}")

    def run(self, word: str, tree: dict, places: int, params: tuple) -> DataFrame:
        """A parsed statement. Its time is one moment, however often its result is read."""
        if places != len(params):
            raise SqlError(f"{places} parameters are expected, not {len(params)}")
        self.now = datetime.now(UTC).replace(tzinfo=None)
        try:
            return getattr(self, f"_{word}")(tree, params)
        except UnknownName as e:
            raise SqlError(str(e.args[0])) from None

    def prepare(self, sql: str) -> Prepared:
        p = Parser(sql)
        word = p.tokens[0].text.lower() if p.tokens else ""
        if word not in STATEMENTS:
            return Prepared(self, word, None, 0, sql)
        tree = getattr(p, word)()
        _end(p)
        return Prepared(self, word, tree, p.params, sql)

    def _moment(self):
        """The statement's time."""
        return F.lit(self.now.isoformat(" ")).cast("timestamp_ntz")

    def _done(self, affected: int = 0) -> DataFrame:
        return self.spark.createDataFrame([(affected,)], "affected_rows long")

    def _rows(self, rows: list[tuple], *names: str) -> DataFrame:
        """A statement's own few rows, in one partition: a LIMIT on several takes whichever is read first."""
        return self.spark.createDataFrame([tuple(None if v is None else str(v) for v in r) for r in rows], T.StructType([T.StructField(n, T.StringType()) for n in names])).coalesce(1)

    def _transaction(self, word: str) -> DataFrame:
        """Versions are immutable, so a rollback puts back those of the start. With autocommit off a transaction begins at each end of one."""
        if word == "rollback" and self._before is not None:
            for (db, name), data in self._before.items():
                if name in self.catalog.databases.get(db, {}):
                    table = self.catalog.databases[db][name]
                    table.data = data
                    data.createOrReplaceTempView(self.catalog.view(name, db))
        if word in ("begin", "start") or not self.variables["@@autocommit"]:
            self._before = {(db, n): t.data for db, tables in self.catalog.databases.items() for n, t in tables.items()}
        else:
            self._before = None
        return self._done()

    # Queries

    def _select(self, q: dict, params: tuple = ()) -> DataFrame:
        data = self.catalog.table(q["table"]).data if q["table"] else None
        if data is not None and (got := self._point(q, params)) is not None:
            data = got
        return compiler.select(self.spark, q, data, self.catalog.current, params, self.variables)

    def _point(self, q: dict, params: tuple) -> DataFrame | None:
        """A WHERE that is a tree of AND and OR over equalities that bind a whole unique key: the rows of those keys. The WHERE is still applied."""
        table = self.catalog.table(q["table"])
        found = _bindings(q["where"], params) if q["where"] is not None else None
        texts = {c.name.lower() for c in table.columns if isinstance(table.data.schema[c.name].dataType, (T.StringType, T.DatetimeType))}
        if found and any(isinstance(v, str) and k.lower() not in texts for b in found for k, v in b.items()):
            return None  # texts beside numbers: the WHERE reads them
        for key in table.unique_keys():
            if found and all({k.lower() for k in b} == {k.lower() for k in key} for b in found):
                return scan.point_get(table.data, key, [[{k.lower(): v for k, v in b.items()}[k.lower()] for k in key] for b in found])
        return None

    # Changes

    def _compiler(self, table: Table, alias: str | None, params: tuple, **more) -> compiler.Compiler:
        return compiler.Compiler(self.spark, table.data, alias or table.name, self.catalog.current, params, self.variables, **more)

    def _default(self, info: ColumnInfo):
        if info.default is None:
            return F.lit(None)
        if info.default.lower().startswith(("current_timestamp", "now")):
            return self._moment()
        return F.lit(info.default.strip("'\""))

    def _insert(self, q: dict, params: tuple) -> DataFrame:
        table = self.catalog.table(q["table"])
        names = [table.column(c).name for c in q["columns"]] if q["columns"] is not None else [c.name for c in table.columns]
        one = self.spark.range(1).select(F.lit(0).alias("_dual"))
        c = compiler.Compiler(self.spark, one, None, self.catalog.current, params, self.variables)
        rows = None
        if any(len(values) != len(names) for values in q["rows"]):
            raise SqlError("as many values as columns are expected")
        if len(q["rows"]) > 1 and all(v.kind in ("lit", "number") for values in q["rows"] for v in values):  # one local relation, however many rows
            plain = [tuple(None if v.value is None else str(int(v.value) if isinstance(v.value, bool) else v.value) for v in values) for values in q["rows"]]
            texts = self._rows(plain, *names)
            rows = texts.select(*(checked(F.col(f"`{n}`"), _declared(table, n)).alias(n) for n in names))
        for values in q["rows"] if rows is None else ():
            cells = [checked(self._default(table.column(n)) if v.kind == "default" else c.column(v), _declared(table, n)).alias(n) for n, v in zip(names, values, strict=True)]
            row = one.select(*cells)
            rows = row if rows is None else rows.unionAll(row)
        columns = [c.name for c in table.columns]
        given = {c.name: self._default(c) for c in table.columns if c.default is not None}
        schema = table.data.select(*columns).schema
        # The rows that a statement spells out: they are numbered and checked here, and meet the table by their keys alone.
        added = [tuple(r) for r in dml.insert(table.data.select(*columns).limit(0), rows, given).collect()]
        added = self._numbered(table, added)
        self._not_null(table, added)
        keys = table.unique_keys()
        local = self.spark.createDataFrame(added, schema)
        met = dml.tagged(table.data, keys, local)
        if not q["update"]:
            if (key := dml.repeated(added, columns, keys)) or (keys and met.where("_hit").limit(1).count()):
                raise SqlError(f"duplicate key {', '.join(key or keys[0])}")
            self.catalog.replace(table, self.catalog.written(table, table.data.unionByName(local)))
            return self._done(len(added))
        updates = {table.column(k).name: self._on_duplicate(table, table.column(k), v, params) for k, v in q["update"]}
        for info in table.columns:
            if info.on_update and info.name not in updates:
                updates[info.name] = lambda was, is_: self._moment()

        def changed(pairs: list[tuple[tuple, tuple]]) -> list[tuple]:
            both = T.StructType([T.StructField("i", T.IntegerType()), T.StructField("o", schema), T.StructField("n", schema)])
            df = self.spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], both)
            was, is_ = (lambda c: F.col("o")[c]), (lambda c: F.col("n")[c])
            out = df.orderBy("i").select(*((updates[f.name](was, is_).cast(f.dataType) if f.name in updates else was(f.name)).alias(f.name) for f in schema.fields))
            return [tuple(r) for r in out.collect()]

        before = [tuple(r) for r in met.where("_hit").select(*columns).collect()]  # as many as the statement's rows have keys
        after = dml.fold(before, added, columns, keys, changed)
        self._not_null(table, after)
        rest, now = met.where(~F.col("_hit")).select(*columns), self.spark.createDataFrame(after, schema)
        moved = [key for key in keys if set(key) & updates.keys()]
        if (key := dml.repeated(after, columns, keys)) or (moved and dml.tagged(rest, moved, now).where("_hit").limit(1).count()):
            raise SqlError(f"duplicate key {', '.join(key or moved[0])}")
        self.catalog.replace(table, self.catalog.written(table, rest.unionByName(now)))
        return self._done(len(added))

    def _numbered(self, table: Table, rows: list[tuple]) -> list[tuple]:
        """The statement's rows with numbers for null values of the column that is numbered: on from the table's greatest and those before."""
        at = next((i for i, c in enumerate(table.columns) if c.auto_increment), None)
        if at is None or all(r[at] is not None for r in rows):
            return rows
        name, out = table.columns[at].name, []
        last = table.data.agg(F.max(name)).first()[0] or 0
        for r in rows:
            value = last + 1 if r[at] is None else r[at]
            last = max(last, value)
            out.append((*r[:at], Decimal(value) if isinstance(table.data.schema[name].dataType, T.DecimalType) else value, *r[at + 1 :]))
        return out

    def _not_null(self, table: Table, rows: list[tuple]) -> None:
        for at, info in enumerate(table.columns):
            if not info.nullable and any(r[at] is None for r in rows):
                raise SqlError(f"column {info.name} cannot be null")

    def _on_duplicate(self, table: Table, info: ColumnInfo, n: Node, params: tuple):
        row = table.data.select(*(c.name for c in table.columns)).schema
        pairs = self.spark.createDataFrame([], T.StructType([T.StructField("o", row), T.StructField("n", row)]))

        def value(was, is_):
            c = compiler.Compiler(self.spark, pairs, table.name, self.catalog.current, params, self.variables, lookup=lambda k: was(table.column(k).name), values=lambda k: is_(table.column(k).name))
            return checked(self._default(info) if n.kind == "default" else c.column(n), info.type)

        return value

    def _update(self, q: dict, params: tuple) -> DataFrame:
        table = self.catalog.table(q["table"])
        c = self._compiler(table, q["alias"], params)
        values = {table.column(k).name: checked(self._default(table.column(k)) if v.kind == "default" else c.column(v), _declared(table, k)) for k, v in q["set"]}
        for info in table.columns:
            if info.on_update and info.name not in values:
                values[info.name] = self._moment()
        condition, order = c.condition(q["where"]), self._order(c, q)
        limit = q["limit"][1] if q["limit"] else None
        n = table.data.where(condition).count()
        new = self.catalog.written(table, dml.update(table.data, values, condition, table.primary, order, limit))
        # Checked on the outcome, so keys may be moved along (id = id + 1).
        for info in table.columns:
            if not info.nullable and info.name in values and new.where(F.col(info.name).isNull()).limit(1).count():
                raise SqlError(f"column {info.name} cannot be null")
        for key in table.unique_keys():
            if set(key) & values.keys() and new.select(*key).na.drop().groupBy(*key).count().where("count > 1").limit(1).count():
                raise SqlError(f"duplicate key {', '.join(key)}")
        self.catalog.replace(table, new)
        return self._done(n if limit is None else min(n, limit))

    def _delete(self, q: dict, params: tuple) -> DataFrame:
        table = self.catalog.table(q["table"])
        c = self._compiler(table, q["alias"], params)
        condition, limit = c.condition(q["where"]), q["limit"][1] if q["limit"] else None
        n = table.data.where(condition).count()
        self.catalog.replace(table, self.catalog.written(table, dml.delete(table.data, condition, table.primary, self._order(c, q), limit)))
        return self._done(n if limit is None else min(n, limit))

    def _order(self, c: compiler.Compiler, q: dict) -> list:
        return [c.column(n).desc_nulls_last() if down else c.column(n).asc_nulls_first() for n, down in q["order"]]

    # Definitions

    def _create(self, p: Parser) -> DataFrame:
        p.need("create")
        unique = p.take("unique")
        if p.take("database") or p.take("schema"):
            p.take("if", "not", "exists")
            self.catalog.databases.setdefault(p.name(), {})
            return self._done()
        if p.take("user"):
            p.take("if", "not", "exists")
            while True:
                self.grants.setdefault(self._user(p), {"*.*": {"USAGE"}})
                if p.take("identified", "by"):
                    p.i += 1
                if not p.take(","):
                    return self._done()
        if p.take("index"):
            name = p.name()
            p.need("on")
            table, names = self.catalog.table(p.table_name()), self._names(p)
            _end(p)
            table.indices.append(Index(name, tuple(table.column(c).name for c in names), unique))
            return self._done()
        p.need("table")
        p.take("if", "not", "exists")
        name = p.table_name().rpartition(".")[2]
        columns, indices, comment = [], [], ""
        p.need("(")
        while True:
            self._definition(p, columns, indices)
            if not p.take(","):
                break
        p.need(")")
        while p.take(",") or not p.done():  # storage words, and the comment
            word = p.name().lower()
            p.take("=")
            if not p.done() and not p.peek(","):
                text, p.i = p.tokens[p.i].text, p.i + 1
                comment = text[1:-1] if word == "comment" else comment
        schema = T.StructType([T.StructField(c.name, spark_type(c.type)) for c in columns])
        self.catalog.add(Table(name, columns, self.spark.createDataFrame([], schema), indices, comment))
        return self._done()

    def _names(self, p: Parser) -> tuple[str, ...]:
        p.need("(")
        out = p.list_of(p.name)
        p.need(")")
        return tuple(out)

    def _definition(self, p: Parser, columns: list[ColumnInfo], indices: list[Index]) -> None:
        if p.take("constraint"):
            p.name()
        if p.take("primary", "key"):
            indices.append(Index("PRIMARY", self._names(p), True, True))
        elif p.peek("unique") or p.peek("index") or p.peek("key"):
            unique = p.take("unique")
            p.take("index") or p.take("key")
            name = None if p.peek("(") else p.name()
            names = self._names(p)
            indices.append(Index(name or "_".join(names), names, unique))
        else:
            columns.append(self._column(p, indices))

    def _column(self, p: Parser, indices: list[Index]) -> ColumnInfo:
        info = ColumnInfo(p.name(), p._type())
        while not p.done() and not p.peek(",") and not p.peek(")"):
            if p.take("not", "null"):
                info.nullable = False
            elif p.take("null"):
                pass
            elif p.take("auto_increment"):
                info.auto_increment = True
            elif p.take("default"):
                start = p.i
                p.expression()
                info.default = p._text(start)
                info.default = None if info.default.lower() == "null" else info.default
            elif p.take("on", "update"):
                start = p.i
                p.expression()
                info.on_update = p._text(start)
            elif p.take("primary", "key"):
                info.nullable = False
                indices.append(Index("PRIMARY", (info.name,), True, True))
            elif p.take("unique"):
                p.take("key")
                indices.append(Index(info.name, (info.name,), True))
            elif p.take("comment"):
                p.i += 1
                info.comment = p.tokens[p.i - 1].text[1:-1]
            else:
                p.i += 1  # character sets, collations and storage words
        return info

    def _drop(self, p: Parser) -> DataFrame:
        p.need("drop")
        if p.take("database") or p.take("schema"):
            lenient = p.take("if", "exists")
            name = p.name()
            _end(p)
            if self.catalog.databases.pop(name, None) is None and not lenient:
                raise SqlError(f"no database {name}")
        elif p.take("index"):
            name = p.name()
            p.need("on")
            table = self.catalog.table(p.table_name())
            _end(p)
            table.indices = [i for i in table.indices if i.name != name]
        elif p.take("table"):
            lenient = p.take("if", "exists")
            names = p.list_of(p.table_name)
            _end(p)
            for name in names:
                if not lenient:
                    self.catalog.table(name)
                self.catalog.databases[self.catalog.current].pop(name.lower().rpartition(".")[2], None)
        elif p.take("stats"):
            names = p.list_of(p.table_name)
            _end(p)
            for name in names:
                self.statistics.pop(self.catalog.table(name).name, None)
        elif p.take("user"):
            lenient = p.take("if", "exists")
            names = p.list_of(lambda: self._user(p))
            _end(p)
            for name in names:
                if self.grants.pop(name, None) is None and not lenient:
                    raise SqlError(f"no user {name}")
        else:
            raise SqlError(f"not supported: DROP {p.near()}")
        return self._done()

    # Users: kept and shown; statements run with every right, as a session is one user's.

    def _user(self, p: Parser) -> str:
        """'name'@'host', or either without quotes; any host by default."""
        text = lambda: p.tokens[p.i - 1].text.strip("'\"`")
        p.i += 1
        if p.i > len(p.tokens):
            raise SqlError("a user is expected")
        name, host = text(), "%"
        if not p.done() and p.tokens[p.i].kind == "var":
            p.i += 1
            host = text().lstrip("@")
        elif not p.done() and p.tokens[p.i].text == "@":
            p.i += 2
            host = text()
        return f"'{name}'@'{host}'"

    def _rights(self, p: Parser) -> tuple[set[str], str]:
        """Rights and what they are on."""
        rights = set()
        while True:
            words = []
            while not p.done() and not p.peek(",") and not p.peek("on"):
                words.append(p.name().upper())
            rights.add(" ".join(w for w in words if w != "PRIVILEGES" or len(words) == 1))
            if not p.take(","):
                break
        p.need("on")
        start = p.i
        while not p.done() and not p.peek("to") and not p.peek("from"):
            p.i += 1
        return rights, p._text(start).replace(" ", "")

    def _grant(self, p: Parser) -> DataFrame:
        p.need("grant")
        rights, on = self._rights(p)
        p.need("to")
        names = p.list_of(lambda: self._user(p))
        p.take("with", "grant", "option")
        _end(p)
        for name in names:
            if name not in self.grants:
                raise SqlError(f"no user {name}")
            self.grants[name].setdefault(on, set()).update(rights)
        return self._done()

    def _revoke(self, p: Parser) -> DataFrame:
        p.need("revoke")
        rights, on = self._rights(p)
        p.need("from")
        names = p.list_of(lambda: self._user(p))
        _end(p)
        for name in names:
            held = self.grants.get(name, {}).get(on, set())
            held.clear() if "ALL" in rights else held.difference_update(rights)
        return self._done()

    def _flush(self, p: Parser) -> DataFrame:
        p.need("flush", "privileges")
        return self._done()

    def _rename(self, p: Parser) -> DataFrame:
        p.need("rename", "table")
        old = self.catalog.table(p.table_name())
        p.need("to")
        name = p.table_name()
        _end(p)
        self._move(old, name)
        return self._done()

    def _move(self, table: Table, name: str) -> None:
        self.catalog.databases[self.catalog.current].pop(table.name.lower())
        table.name = name
        self.catalog.add(table)

    def _alter(self, p: Parser) -> DataFrame:
        p.need("alter", "table")
        table = self.catalog.table(p.table_name())
        while True:
            if p.take("add"):
                if any(p.peek(w) for w in ("index", "key", "unique", "primary", "constraint")):
                    self._definition(p, [], table.indices)
                else:
                    p.take("column")
                    info = self._column(p, table.indices)
                    table.columns.append(info)
                    table.data = table.data.withColumn(info.name, self._default(info).cast(spark_type(info.type)))
            elif p.take("drop"):
                if p.take("index") or p.take("key"):
                    name = p.name()
                    table.indices = [i for i in table.indices if i.name != name]
                else:
                    p.take("column")
                    name = table.column(p.name()).name
                    if name in table.primary:
                        raise SqlError("a key column cannot be dropped")
                    table.columns = [c for c in table.columns if c.name != name]
                    table.data = table.data.drop(name)
            elif p.take("rename"):
                if p.take("index") or p.take("key"):
                    name = p.name()
                    p.need("to")
                    new = p.name()
                    for i in table.indices:
                        i.name = new if i.name == name else i.name
                else:
                    p.take("to") or p.take("as")
                    self._move(table, p.name())
            elif p.take("comment"):
                p.take("=")
                p.i += 1
                table.comment = p.tokens[p.i - 1].text[1:-1]
            else:
                raise SqlError(f"not supported: ALTER TABLE ... {p.near()}")
            if not p.take(","):
                break
        self.catalog.add(table)
        return self._done()

    # Information

    def _describe(self, p: Parser) -> DataFrame:
        p.i += 1
        if p.peek("select"):
            q, p.i = Parser("explain " + p.sql[p.tokens[p.i].at :]), len(p.tokens)
            return self._explain(q)
        return self._columns(self.catalog.table(p.table_name()), False)

    def _columns(self, table: Table, full: bool) -> DataFrame:
        rows = []
        for c in table.columns:
            key = "PRI" if c.name in table.primary else next(("UNI" if i.unique and len(i.columns) == 1 else "MUL" for i in table.indices if i.columns[0] == c.name), "")
            extra = "auto_increment" if c.auto_increment else f"on update {c.on_update}" if c.on_update else ""
            row = (c.name, c.type, "YES" if c.nullable else "NO", key, c.default, extra)
            rows.append((*row[:2], "utf8_bin" if spark_type(c.type) == T.StringType() else None, *row[2:], "", c.comment) if full else row)
        names = ("Field", "Type", "Collation", "Null", "Key", "Default", "Extra", "Privileges", "Comment") if full else ("Field", "Type", "Null", "Key", "Default", "Extra")
        return self._rows(rows, *names)

    def _show(self, p: Parser) -> DataFrame:
        p.need("show")
        full = p.take("full")
        p.take("global") or p.take("session")
        if p.take("databases", "info"):
            return self._filtered(p, self._rows(list(enumerate(self.catalog.databases, 1)), "DB_ID", "DB_NAME"))
        if p.take("tables", "info"):
            db = p.name() if p.take("from") or p.take("in") else self.catalog.current
            return self._rows([(list(self.catalog.databases).index(db) + 1, i, t.name) for i, t in enumerate(self.catalog.databases[db].values(), 1)], "DB_ID", "TABLE_ID", f"Tables_in_{db}")
        if p.take("databases") or p.take("schemas"):
            return self._filtered(p, self._rows([(d,) for d in sorted(self.catalog.databases)], "Database"))
        if p.take("tables"):
            db = p.name() if p.take("from") or p.take("in") else self.catalog.current
            if db not in self.catalog.databases:
                raise SqlError(f"no database {db}")
            return self._filtered(p, self._rows([(t.name,) for t in self.catalog.databases[db].values()], f"Tables_in_{db}"))
        if p.take("columns") or p.take("fields"):
            p.take("from") or p.need("in")
            return self._filtered(p, self._columns(self.catalog.table(p.table_name()), full))
        if p.take("index") or p.take("indexes") or p.take("keys"):
            p.take("from") or p.need("in")
            t = self.catalog.table(p.table_name())
            return self._rows([(t.name, 0 if i.unique else 1, i.name, k, c, "BTREE") for i in t.indices for k, c in enumerate(i.columns, 1)], "Table", "Non_unique", "Key_name", "Seq_in_index", "Column_name", "Index_type")
        if p.take("create", "table"):
            t = self.catalog.table(p.table_name())
            return self._rows([(t.name, create_table(t))], "Table", "Create Table")
        if p.take("variables"):
            return self._filtered(p, self._rows(sorted((k.lstrip("@"), v) for k, v in self.variables.items() if k.startswith("@@")), "Variable_name", "Value"))
        if p.take("status"):
            rows = [("Questions", self.questions), ("Open_tables", sum(map(len, self.catalog.databases.values()))), ("Threads_connected", 1)]
            return self._filtered(p, self._rows(sorted(rows), "Variable_name", "Value"))
        if p.take("warnings") or p.take("errors"):
            return self._rows([], "Level", "Code", "Message")
        if p.take("grants"):
            user = self._user(p) if p.take("for") else "'root'@'%'"
            if user not in self.grants:
                raise SqlError(f"no user {user}")
            texts = [f"GRANT {'ALL PRIVILEGES' if 'ALL' in r else ', '.join(sorted(r))} ON {on} TO {user}" for on, r in sorted(self.grants[user].items()) if r]
            return self._rows([(t,) for t in texts], f"Grants for {user}")
        if p.take("collation"):
            return self._filtered(p, self._rows([("utf8_bin", "utf8", 83, "Yes", "Yes", 1)], "Collation", "Charset", "Id", "Default", "Compiled", "Sortlen"))
        if p.take("character", "set") or p.take("charset"):
            return self._filtered(p, self._rows([("utf8", "UTF-8 Unicode", "utf8_bin", 4)], "Charset", "Description", "Default collation", "Maxlen"))
        for word, make in (("stats_meta", self._stats_meta), ("stats_histograms", self._stats_histograms), ("stats_buckets", self._stats_buckets)):
            if p.take(word):
                only = None if p.done() or p.peek("where") or p.peek("like") else self.catalog.table(p.table_name()).name
                return self._filtered(p, make([(t, s) for t, s in self.statistics.items() if only in (None, t)]))
        raise SqlError(f"not supported: SHOW {p.near()}")

    def _filtered(self, p: Parser, data: DataFrame) -> DataFrame:
        """LIKE on the first column, or WHERE."""
        if p.take("like"):
            p.i += 1
            return data.where(F.col(f"`{data.columns[0]}`").like(p.tokens[p.i - 1].text[1:-1]))
        if p.take("where"):
            return data.where(compiler.Compiler(self.spark, data).condition(p.expression()))
        return data

    def _stats_meta(self, kept: list) -> DataFrame:
        return self._rows([(self.catalog.current, t, s.at, 0, s.rows) for t, s in kept], "db_name", "table_name", "update_time", "modify_count", "row_count")

    def _stats_histograms(self, kept: list) -> DataFrame:
        rows = [(self.catalog.current, t, r["name"], r["isIndex"], s.at, r["hNdv"], r["hNullCount"]) for t, s in kept for r in s.table.collect()]  # a row for each column and index
        return self._rows(rows, "db_name", "table_name", "column_name", "is_index", "update_time", "distinct_count", "null_count")

    def _stats_buckets(self, kept: list) -> DataFrame:
        text = lambda c: F.col(c).cast("string").alias(c)
        parts = [h.select(F.lit(self.catalog.current).alias("db_name"), F.lit(t).alias("table_name"), F.lit(c).alias("column_name"), F.col("bucket").alias("bucket_id"), F.col("cumulative").alias("count"), "repeats", text("lower"), text("upper")) for t, s in kept for c, h in s.histograms.items()]
        names = ("db_name", "table_name", "column_name", "bucket_id", "count", "repeats", "lower", "upper")
        return reduce(DataFrame.union, parts) if parts else self._rows([], *names)

    def _explain(self, p: Parser) -> DataFrame:
        """A row for each operator of the plan, from the result down: op (indented by two spaces a level), count (rows estimated, or N/A), task
        (`proxy` for the session, `db` from the scan's exchange down), operator_info. EXPLAIN FORMAT = 'formatted' gives Spark's text, one line
        a row; EXPLAIN ANALYZE runs the statement and gives rows and milliseconds as they were."""
        p.i += 1
        analyze, form = p.take("analyze"), ""
        if p.take("format"):
            p.need("=")
            form, p.i = p.tokens[p.i].text.strip("'\"").lower(), p.i + 1
        q = p.select()
        _end(p)
        self.now = datetime.now(UTC).replace(tzinfo=None)
        result = self._select(q)
        execution = result._jdf.queryExecution()
        if form == "formatted":
            plan = execution.explainString(self.spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
            return self._rows([(line,) for line in plan.splitlines()], "plan")
        began, found = time.perf_counter(), 0
        if analyze:
            found = result.count()
        took = (time.perf_counter() - began) * 1000
        rows: list[tuple] = []
        table = self.catalog.table(q["table"]).name if q["table"] else None
        known = self.statistics[table].rows if table in self.statistics else None

        def walk(node, depth: int) -> None:
            name = node.nodeName()
            size = node.stats().rowCount()
            count = str(size.get()) if size.isDefined() else str(known) if known is not None and node.children().isEmpty() else "N/A"
            rows.append(("  " * depth + name, count, "db" if name in ("Filter", "Relation", "LocalRelation", "LogicalRDD") or node.children().isEmpty() else "proxy", node.simpleString(200)))
            for i in range(node.children().size()):
                walk(node.children().apply(i), depth + 1)

        walk(execution.optimizedPlan(), 0)
        if analyze:
            rows[0] = (rows[0][0], str(found), "proxy", f"{took:.0f} ms")
        return self._rows(rows, "op", "count", "task", "operator_info")

    def _analyze(self, p: Parser) -> DataFrame:
        """ANALYZE TABLE t [, ...]: statistics are kept for SHOW STATS_* and EXPLAIN; the result has a row for each column and index."""
        p.need("analyze", "table")
        tables = [self.catalog.table(n) for n in p.list_of(p.table_name)]
        _end(p)
        for table in tables:
            at = datetime.now(UTC).replace(tzinfo=None, microsecond=0).isoformat(" ")
            kept = statistics.table_statistics(table.data, [(i.name, i.columns) for i in table.indices])
            self.statistics[table.name] = Kept(at, kept["table"], kept["rows"], kept["histograms"])
        return reduce(DataFrame.union, (self.statistics[t.name].table for t in tables))

    def _use(self, p: Parser) -> DataFrame:
        p.need("use")
        name = p.name()
        if name not in self.catalog.databases:
            raise SqlError(f"no database {name}")
        self.catalog.current = name
        return self._done()

    def _set(self, p: Parser) -> DataFrame:
        p.need("set")
        if p.take("names") or p.take("character", "set") or p.peek("transaction") or p.peek("session", "transaction") or p.peek("global", "transaction"):
            return self._done()
        while True:
            scope = p.take("session") or p.take("global")
            t = p.tokens[p.i]
            p.i += 1
            name = t.text.lower().replace("@@session.", "@@").replace("@@global.", "@@")
            name = name if name.startswith("@") and not scope else "@@" + name.lstrip("@")
            p.take(":=") or p.need("=")
            word = p.peek("on") or p.peek("off") or p.peek("default")
            if word:
                value: object = {"on": 1, "off": 0, "default": None}[p.tokens[p.i].text.lower()]
                p.i += 1
            else:
                n = p.expression()
                value = n.value[-1] if n.kind == "col" else self.spark.range(1).select(compiler.Compiler(self.spark, self.spark.range(1), variables=self.variables).column(n)).first()[0]
            self.variables[name] = value
            if name == "@@autocommit" and not value:
                self._transaction("begin")
            if not p.take(","):
                return self._done()


def _declared(table: Table, column: str) -> str:
    return table.column(column).type


def create_table(t: Table) -> str:
    lines = []
    for c in t.columns:
        words = [f"`{c.name}`", c.type, "" if c.nullable else "NOT NULL", "AUTO_INCREMENT" if c.auto_increment else "", f"DEFAULT {c.default}" if c.default is not None else "", f"ON UPDATE {c.on_update}" if c.on_update else "", f"COMMENT '{c.comment}'" if c.comment else ""]
        lines.append(" ".join(w for w in words if w))
    for i in t.indices:
        names = ", ".join(f"`{c}`" for c in i.columns)
        lines.append(f"PRIMARY KEY ({names})" if i.primary else f"{'UNIQUE ' if i.unique else ''}KEY `{i.name}` ({names})")
    return f"CREATE TABLE `{t.name}` (\n  " + ",\n  ".join(lines) + "\n)"


def _bindings(n: Node, params: tuple) -> list[dict] | None:
    """Alternatives of column equalities that a tree of AND and OR stands for; None if it is anything else."""
    if n.kind == "op" and n.value == "=":
        a, b = n.args
        if a.kind != "col":
            a, b = b, a
        if a.kind == "col" and b.kind == "lit" and b.value is not None:
            return [{a.value[-1]: b.value}]
        if a.kind == "col" and b.kind == "param" and isinstance(params[b.value], (int, str, float, Decimal, date, datetime)):
            return [{a.value[-1]: params[b.value]}]
        return None
    if n.kind == "in" and n.args[0].kind == "col" and all(x.kind == "lit" and x.value is not None for x in n.args[1:]):
        return [{n.args[0].value[-1]: x.value} for x in n.args[1:]]
    if n.kind == "op" and n.value in ("and", "or"):
        left, right = (_bindings(x, params) for x in n.args)
        if left is None or right is None:
            return None
        if n.value == "or":
            return left + right
        out = [a | b for a in left for b in right if all(a[k] == b[k] for k in a.keys() & b.keys())]
        return out if len(out) <= 1000 else None
    return None
