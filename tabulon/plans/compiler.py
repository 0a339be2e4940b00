"""Expression trees to Spark columns, and SELECT to a DataFrame."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import casts, crypto, logic, numeric, temporal, text
from ..operators import aggregate as agg
from ..operators import relational
from ..sources.types import spark_type
from .parser import Node, SqlError

AGGREGATES = frozenset("count sum avg max min bit_and bit_or bit_xor group_concat std stddev stddev_pop any_value".split())


def _literal(n: Node):
    if n.kind == "op" and n.value == "neg":
        return -_literal(n.args[0])
    if n.kind not in ("lit", "number"):
        raise SqlError(f"a constant is expected in place of {n.text}")
    return float(n.value) if n.kind == "number" else n.value


def _unary(name: str, f=None):
    return lambda c, x: (f or (lambda v: F.call_function(name, v)))(x)


def _spark(name: str, *kinds: str):
    """A function that Spark has under the name; kinds: casts of its arguments."""
    return lambda c, *xs: F.call_function(name, *(x.cast(k) if k else x for x, k in zip(xs, (*kinds, *[""] * len(xs)), strict=False)))


def _is_time(c: Compiler, x: Column) -> bool:
    return isinstance(c.kind(x), T.DayTimeIntervalType)


def _clock(name: str, unit: int, most: int):
    """Hours, minutes or seconds of a moment or of a time."""
    return lambda c, x: (F.floor(temporal.interval_seconds(x) / unit) % most).cast("int") if _is_time(c, x) else F.call_function(name, x.cast("timestamp_ntz"))


#: Scalar functions by name: (compiler, *argument columns) to a column.
FUNCTIONS: dict[str, Callable[..., Column]] = {
    # comparison and control
    "coalesce": lambda c, *x: F.coalesce(*x), "ifnull": lambda c, a, b: F.coalesce(a, b), "nullif": lambda c, a, b: F.nullif(a, b), "if": lambda c, *x: logic.if_(*x),
    "isnull": lambda c, x: x.isNull(), "greatest": lambda c, *x: F.when(_any_null(x), None).otherwise(F.greatest(*x)), "least": lambda c, *x: F.when(_any_null(x), None).otherwise(F.least(*x)),
    "strcmp": lambda c, a, b: text.strcmp(a, b), "interval": lambda c, *x: logic.interval(*x), "field": lambda c, *x: text.field(*x), "elt": lambda c, *x: text.elt(*x),
    # mathematics
    "abs": _spark("abs"), "ceil": lambda c, x: F.ceil(x).cast("long"), "ceiling": lambda c, x: F.ceil(x).cast("long"), "floor": lambda c, x: F.floor(x).cast("long"), "round": lambda c, *x: numeric.round_(*x), "truncate": lambda c, *x: numeric.truncate(*x),
    "rand": lambda c, seed=None: F.rand() if seed is None else F.rand(0), "conv": lambda c, *x: numeric.conv(*x), "crc32": lambda c, x: F.crc32(x.cast("binary")), "degrees": _spark("degrees"), "radians": _spark("radians"),
    "exp": _spark("exp"), "acos": lambda c, x: numeric.acos(x), "asin": lambda c, x: numeric.asin(x), "atan": lambda c, *x: numeric.atan(*x), "atan2": _spark("atan2"), "cos": _spark("cos"), "cot": lambda c, x: numeric.cot(x), "sin": _spark("sin"), "tan": _spark("tan"),
    "ln": lambda c, x: numeric.ln(x), "log": lambda c, *x: numeric.log(*x), "log10": lambda c, x: numeric.log10(x), "log2": lambda c, x: numeric.log2(x), "pi": lambda c: F.lit(3.141592653589793), "pow": _spark("pow"), "power": _spark("pow"), "sign": lambda c, x: F.signum(x.cast("double")).cast("int"), "sqrt": lambda c, x: numeric.sqrt(x), "mod": lambda c, a, b: numeric.mod(a, b),
    # digests
    "md5": lambda c, x: F.md5(x.cast("binary")), "sha1": lambda c, x: F.sha1(x.cast("binary")), "sha": lambda c, x: F.sha1(x.cast("binary")), "password": lambda c, x: crypto.password(x), "compress": lambda c, x: numeric.compress(x), "uncompress": lambda c, x: numeric.uncompress(x),
    # strings
    "ascii": lambda c, x: F.when(x.cast("string") == "", 0).otherwise(F.conv(F.hex(F.substring(F.encode(x.cast("string"), "utf-8"), 1, 1)), 16, 10).cast("int")), "ord": lambda c, x: text.ord_(x), "bin": lambda c, x: text.bin_(x), "oct": lambda c, x: text.oct_(x), "hex": lambda c, x: text.hex_(x), "unhex": lambda c, x: F.unhex(x), "bit_length": _spark("bit_length", "string"), "char": lambda c, *x: text.char_(*x),
    "char_length": _spark("char_length", "string"), "character_length": _spark("char_length", "string"), "length": lambda c, x: text.length(x), "octet_length": lambda c, x: text.length(x), "concat": lambda c, *x: text.concat(*x), "concat_ws": lambda c, *x: text.concat_ws(*x), "export_set": lambda c, *x: text.export_set(*x), "make_set": lambda c, *x: text.make_set(*x), "find_in_set": lambda c, *x: text.find_in_set(*x),
    "format": lambda c, *x: text.format_(*x), "from_base64": _spark("unbase64"), "to_base64": lambda c, x: F.base64(x.cast("binary")), "insert": lambda c, *x: text.insert(*x), "instr": lambda c, *x: text.instr(*x), "locate": lambda c, *x: text.locate(*x), "position": lambda c, a, b: text.locate(a, b), "lcase": _spark("lower", "string"), "lower": _spark("lower", "string"), "ucase": _spark("upper", "string"), "upper": _spark("upper", "string"),
    "left": lambda c, *x: text.left(*x), "right": lambda c, *x: text.right(*x), "lpad": lambda c, *x: text.pad(*x, at_left=True), "rpad": lambda c, *x: text.pad(*x, at_left=False), "ltrim": _spark("ltrim", "string"), "rtrim": _spark("rtrim", "string"), "substring": lambda c, *x: text.substring(*x), "substr": lambda c, *x: text.substring(*x), "mid": lambda c, *x: text.substring(*x), "substring_index": lambda c, *x: text.substring_index(*x),
    "quote": lambda c, x: text.quote(x), "repeat": lambda c, *x: text.repeat(*x), "replace": _spark("replace", "string", "string", "string"), "reverse": _spark("reverse", "string"), "soundex": _spark("soundex", "string"), "space": lambda c, x: text.space(x),
    # dates and times
    "date": lambda c, x: x.cast("date"), "timestamp": lambda c, x: x.cast("timestamp_ntz"), "time": lambda c, x: temporal.time_part(x), "day": _spark("day", "date"), "dayofmonth": _spark("day", "date"), "dayofweek": _spark("dayofweek", "date"), "dayofyear": _spark("dayofyear", "date"), "weekday": _spark("weekday", "date"), "weekofyear": _spark("weekofyear", "date"), "month": _spark("month", "date"), "quarter": _spark("quarter", "date"), "year": _spark("year", "date"), "last_day": _spark("last_day", "date"),
    "dayname": lambda c, x: F.date_format(x.cast("date"), "EEEE"), "monthname": lambda c, x: F.date_format(x.cast("date"), "MMMM"), "hour": _clock("hour", 3600, 1 << 20), "minute": _clock("minute", 60, 60), "second": _clock("second", 1, 60), "microsecond": lambda c, x: (F.extract(F.lit("SECOND"), x.cast("timestamp_ntz")) % 1 * 1000000).cast("int"),
    "datediff": lambda c, a, b: temporal.datediff(a, b), "timediff": lambda c, a, b: temporal.timediff(a, b), "to_days": lambda c, x: temporal.to_days(x), "from_days": lambda c, x: temporal.from_days(x), "to_seconds": lambda c, x: temporal.to_seconds(x), "makedate": lambda c, *x: temporal.makedate(*x), "maketime": lambda c, *x: temporal.maketime(*x), "period_add": lambda c, *x: temporal.period_add(*x), "period_diff": lambda c, *x: temporal.period_diff(*x),
    "sec_to_time": lambda c, x: temporal.sec_to_time(x), "time_to_sec": lambda c, x: temporal.interval_seconds(x).cast("long") if _is_time(c, x) else temporal.time_to_sec(x), "yearweek": lambda c, x: temporal.yearweek(x), "addtime": lambda c, a, b: a.cast("timestamp_ntz") + temporal.parse_time(b), "subtime": lambda c, a, b: a.cast("timestamp_ntz") - temporal.parse_time(b),
    "from_unixtime": lambda c, x: F.timestamp_seconds(x).cast("timestamp_ntz"), "unix_timestamp": lambda c, x=None: F.unix_timestamp() if x is None else F.unix_timestamp(x.cast("timestamp")), "convert_tz": lambda c, x, a, b: F.convert_timezone(a, b, x.cast("timestamp_ntz")),
    "curdate": lambda c: F.current_date(), "current_date": lambda c: F.current_date(), "utc_date": lambda c: F.current_date(), "curtime": lambda c: temporal.time_part(temporal.now()), "current_time": lambda c: temporal.time_part(temporal.now()), "utc_time": lambda c: temporal.time_part(temporal.now()),
}


def _any_null(xs) -> Column:
    out = xs[0].isNull()
    for x in xs[1:]:
        out = out | x.isNull()
    return out


def _with_constants(c: Compiler, name: str, args: list[Node]) -> Column | None:
    """Functions whose formats, modes, units or keys are constants of the statement."""
    col = c.column
    if name in ("date_format", "time_format"):
        return temporal.date_format(col(args[0]), _literal(args[1]))
    if name == "str_to_date":
        return temporal.str_to_date(col(args[0]), _literal(args[1]))
    if name == "from_unixtime" and len(args) == 2:
        return temporal.date_format(F.timestamp_seconds(col(args[0])).cast("timestamp_ntz"), _literal(args[1]))
    if name in ("now", "sysdate", "current_timestamp", "localtime", "localtimestamp", "utc_timestamp"):
        return temporal.now(_literal(args[0]) if args else 0)
    if name in ("date_add", "adddate", "date_sub", "subdate"):
        sign = 1 if "add" in name else -1
        if args[1].kind == "interval":
            return c.shifted(args[0], col(args[1].args[0]), args[1].value, sign)
        return c.shifted(args[0], col(args[1]), "DAY", sign)
    if name == "timestampadd":
        return c.shifted(args[2], col(args[1]), _literal(args[0]))
    if name == "timestampdiff":
        return temporal.timestampdiff(_literal(args[0]), col(args[1]), col(args[2]))
    if name == "extract":
        return F.extract(F.lit(_literal(args[0])), c.moment(args[1])).cast("int")
    if name == "week":
        return temporal.week(col(args[0]), _literal(args[1]) if len(args) > 1 else 0)
    if name == "get_format":
        return F.lit(temporal.FORMATS[_literal(args[0]).upper(), _literal(args[1]).upper()])
    if name == "sha2":
        return crypto.sha2(col(args[0]), _literal(args[1]))
    if name in ("aes_encrypt", "aes_decrypt"):
        return getattr(crypto, name)(col(args[0]), _literal(args[1]))
    if name == "trim" and len(args) == 3:
        side, cut, x = _literal(args[0]), args[1], col(args[2]).cast("string")
        what = col(cut) if cut is not None else F.lit(" ")
        quoted = F.concat(F.lit("(?:\\Q"), what, F.lit("\\E)+"))
        out = x if side == "trailing" else F.regexp_replace(x, F.concat(F.lit("^"), quoted), F.lit(""))
        return out if side == "leading" else F.regexp_replace(out, F.concat(quoted, F.lit("$")), F.lit(""))
    if name == "trim":
        return F.trim(col(args[0]).cast("string"))
    if name in ("database", "schema"):
        return F.lit(c.database)
    if name == "rand" and args:
        return F.rand(_literal(args[0]))
    return None


@dataclass
class Compiler:
    """Trees to columns over one relation."""

    spark: SparkSession
    data: DataFrame
    alias: str | None = None
    database: str = ""
    params: tuple = ()
    variables: dict[str, object] = field(default_factory=dict)
    #: Trees that stand for a column, such as aggregates once they are computed.
    known: dict[Node, str] = field(default_factory=dict)
    #: Getter of VALUES(column), in ON DUPLICATE KEY UPDATE.
    values: Callable[[str], Column] | None = None
    #: Getter of a plain column, if not of the relation.
    lookup: Callable[[str], Column] | None = None

    def name(self, n: Node) -> str:
        """The relation's column that a tree names."""
        if len(n.value) > 1 and self.alias and n.value[-2].lower() not in (self.alias.lower(), self.alias.lower().rpartition(".")[2]):
            raise SqlError(f"unknown table in {n.text}")
        for c in self.data.columns:
            if c.lower() == n.value[-1].lower():
                return c
        raise SqlError(f"unknown column {n.text}")

    def kind(self, x: Column) -> T.DataType:
        """Type of a column over the relation; nothing is run."""
        return self.data.select(x.alias("x")).schema[0].dataType

    def moment(self, n: Node) -> Column:
        """A date or timestamp; texts are read as the latter if they hold a time."""
        x = self.column(n)
        if n.kind == "lit" and isinstance(n.value, str):
            return x.cast("timestamp_ntz" if ":" in n.value else "date")
        return x

    def shifted(self, n: Node, amount: Column, unit: str, sign: int = 1) -> Column:
        """A moment plus or minus an amount of units."""
        x = self.moment(n)
        return temporal.add_interval(x, amount, unit, sign, isinstance(self.kind(x), T.DateType))

    def column(self, n: Node) -> Column:
        if n in self.known:
            return F.col(self.known[n])
        k = n.kind
        if k == "lit":
            return F.lit(n.value) if n.value is None or not isinstance(n.value, int) or abs(n.value) < 2**63 else F.lit(str(n.value)).cast("decimal(20,0)")
        if k == "number":
            return F.lit(float(n.value)) if "e" in n.value.lower() else F.expr(n.value if not n.value.startswith(".") else "0" + n.value)
        if k == "col":
            return self.lookup(n.value[-1]) if self.lookup else F.col(f"`{self.name(n)}`")
        if k == "param":
            return F.lit(self.params[n.value])
        if k == "var":
            return F.lit(self.variables.get(n.value.replace("@@session.", "@@").replace("@@global.", "@@")))
        if k == "op":
            return self._operator(n)
        if k == "null":
            return self.column(n.args[0]).isNull()
        if k == "truth":
            return (logic.is_true if n.value == "true" else logic.is_false)(self.column(n.args[0]))
        if k == "in":
            x, *items = self.alike(n.args, [*map(self.column, n.args)])
            return x.isin(*items)
        if k == "between":
            return logic.between(*self.alike(n.args, [*map(self.column, n.args)]))
        if k == "like":
            return text.like(*map(self.column, n.args), n.value)
        if k == "regexp":
            return text.regexp(*map(self.column, n.args))
        if k == "case":
            operand, whens, otherwise = n.args
            return logic.case(self.column(operand) if operand else None, [(self.column(a), self.column(b)) for a, b in whens], self.column(otherwise) if otherwise else None)
        if k == "cast":
            return self._cast(n)
        if k == "call":
            return self._call(n)
        raise SqlError(f"cannot evaluate {n.text or k}")

    def number(self, n: Node, x: Column) -> Column:
        """x where a number is needed: of a text the number that it begins with. A literal's is found here, so filters on columns are still pushed down."""
        if not isinstance(self.kind(x), T.StringType):
            return x
        if n.kind == "lit" and isinstance(n.value, str):
            found = re.match(r"\s*([+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)", n.value)
            value = float(found[1]) if found else 0.0
            return F.lit(int(value)) if value == int(value) and abs(value) < 2**53 else F.lit(value)
        return casts.prefix_number(x)

    def alike(self, nodes, args: list[Column]) -> list[Column]:
        """Sides of a comparison: texts beside numbers are read as numbers."""
        kinds = [self.kind(x) for x in args]
        if any(isinstance(k, T.NumericType) for k in kinds) and any(isinstance(k, T.StringType) for k in kinds):
            return [self.number(n, x) for n, x in zip(nodes, args, strict=True)]
        return args

    def condition(self, n: Node) -> Column:
        """A WHERE or HAVING tree: numbers are true unless 0."""
        return logic.truth(self.number(n, self.column(n)))

    def _cast(self, n: Node) -> Column:
        name = str(n.value).lower()
        target = T.LongType() if name.startswith("signed") else T.DecimalType(20, 0) if name.startswith("unsigned") else spark_type(name)
        x = self.column(n.args[0])
        if isinstance(target, T.DayTimeIntervalType):
            return temporal.parse_time(x.cast("string"))
        return F.round(x.cast("double")).cast(target) if isinstance(target, numeric.INTEGERS) and isinstance(self.kind(x), (T.DoubleType, T.FloatType, T.DecimalType)) else x.cast(target)

    def _operator(self, n: Node) -> Column:
        op = n.value
        if op in ("+", "-") and n.args[-1].kind == "interval":
            return self.shifted(n.args[0], self.column(n.args[1].args[0]), n.args[1].value, 1 if op == "+" else -1)
        args = [self.column(a) for a in n.args]
        if op in ("+", "-", "*", "/", "div", "%", "neg"):
            args = [self.number(a, x) for a, x in zip(n.args, args, strict=True)]
        elif op in ("=", "<=>", "!=", ">", ">=", "<", "<="):
            args = self.alike(n.args, args)
        if op in ("and", "or", "xor", "not"):
            args = [logic.truth(self.number(a, x)) for a, x in zip(n.args, args, strict=True)]
        if op == "not":
            return ~args[0]
        if op == "neg":
            return numeric.minus(args[0])
        if op == "~":
            return F.bitwise_not(args[0].cast("long"))
        a, b = args
        if op == "/":
            kinds = self.kind(a), self.kind(b)
            return numeric.divide(a, b, kinds[0] if all(isinstance(k, (*numeric.INTEGERS, T.DecimalType)) for k in kinds) else None)
        if op == "div":
            return numeric.div(a, b, any(isinstance(self.kind(x), (T.DoubleType, T.FloatType)) for x in args))
        return {
            "and": lambda: a & b, "or": lambda: a | b, "xor": lambda: logic.xor(a, b), "=": lambda: a == b, "<=>": lambda: logic.null_safe_equal(a, b), "!=": lambda: a != b,
            ">": lambda: a > b, ">=": lambda: a >= b, "<": lambda: a < b, "<=": lambda: a <= b, "|": lambda: numeric.or_bits(a, b), "&": lambda: numeric.and_bits(a, b), "^": lambda: numeric.xor_bits(a, b),
            "<<": lambda: numeric.shift_left(a, b), ">>": lambda: numeric.shift_right(a, b), "+": lambda: a + b, "-": lambda: a - b, "*": lambda: a * b, "%": lambda: numeric.mod(a, b),
        }[op]()

    def _call(self, n: Node) -> Column:
        name, (distinct, extra, *args) = n.value, n.args if n.args else (None, None)
        if name in AGGREGATES:
            return self._aggregate(name, bool(distinct), extra, args)
        if name == "values":
            if not self.values:
                raise SqlError("VALUES() stands in ON DUPLICATE KEY UPDATE only")
            return self.values(args[0].value[-1])
        if (out := _with_constants(self, name, args)) is not None:
            return out
        if name not in FUNCTIONS:
            raise SqlError(f"function {name.upper()} is not supported")
        return FUNCTIONS[name](self, *map(self.column, args))

    def _aggregate(self, name: str, distinct: bool, extra: str | None, args: list[Node]) -> Column:
        if name == "count" and args[0].kind == "star":
            return F.count("*")
        x = self.column(args[0])
        if name == "count":
            return F.count_distinct(x, *map(self.column, args[1:])) if distinct else F.count(x)
        if name in ("sum", "avg"):
            kind = self.kind(x)
            if isinstance(kind, (T.StringType, T.BooleanType)):
                x = casts.prefix_number(x) if isinstance(kind, T.StringType) else x.cast("long")
            return (F.sum_distinct(x) if distinct else F.sum(x)) if name == "sum" else (F.sum_distinct(x) / F.count_distinct(x) if distinct else F.avg(x))
        if name == "group_concat":
            return agg.group_concat(text.concat(*map(self.column, args)), extra if extra is not None else ",", distinct)
        return {"max": F.max, "min": F.min, "bit_and": F.bit_and, "bit_or": F.bit_or, "bit_xor": F.bit_xor, "std": F.stddev_pop, "stddev": F.stddev_pop, "stddev_pop": F.stddev_pop, "any_value": agg.first_value}[name](x)


def calls(n, found: list[Node]) -> list[Node]:
    """Aggregate calls in a tree, outermost only."""
    if isinstance(n, Node):
        if n.kind == "call" and n.value in AGGREGATES:
            if n not in found:
                found.append(n)
        else:
            for a in n.args:
                calls(a, found)
    elif isinstance(n, (tuple, list)):
        for a in n:
            calls(a, found)
    return found


def plain_columns(n, known: dict[Node, str], found: list[Node]) -> list[Node]:
    """Column trees outside of known ones."""
    if isinstance(n, Node):
        if n in known:
            return found
        if n.kind == "col":
            found.append(n)
        for a in n.args:
            plain_columns(a, known, found)
    elif isinstance(n, (tuple, list)):
        for a in n:
            plain_columns(a, known, found)
    return found


def select(spark: SparkSession, q: dict, table: DataFrame | None, database: str = "", params: tuple = (), variables: dict | None = None) -> DataFrame:
    """Clauses in order: where, group, having, select list, distinct, order, limit. Hidden columns are dropped at the end."""
    data = table if table is not None else spark.range(1).select(F.lit(0).alias("_dual"))
    c = Compiler(spark, data, q["alias"] or q["table"], database, params, variables or {})
    items: list[tuple[Node, str]] = []
    for n, alias in q["items"]:
        if n.kind == "star":
            if table is None:
                raise SqlError("* needs a table")
            if n.value and c.alias and n.value.lower().rpartition(".")[2] != c.alias.lower().rpartition(".")[2]:
                raise SqlError(f"unknown table {n.value}")
            items += [(Node("col", (x,)), x) for x in data.columns]
        else:
            items.append((n, alias or (n.value[-1] if n.kind == "col" else n.text)))
    named = {}
    for n, name in items:
        named.setdefault(name.lower(), n)

    def meant(n: Node, prefer_alias: bool = True) -> Node:
        """Ordinals and aliases as what they stand for."""
        if n.kind == "lit" and isinstance(n.value, int) and not isinstance(n.value, bool):
            if not 1 <= n.value <= len(items):
                raise SqlError(f"position {n.value} is not in the select list")
            return items[n.value - 1][0]
        if n.kind == "col" and len(n.value) == 1 and n.value[0].lower() in named and (prefer_alias or n.value[0].lower() not in (x.lower() for x in data.columns)):
            return named[n.value[0].lower()]
        return n

    def resolved(n):
        """Aliases inside a HAVING or ORDER BY tree, but not inside aggregates."""
        if not isinstance(n, Node) or n.kind == "call" and n.value in AGGREGATES:
            return n
        if n.kind == "col":
            return meant(n)
        return Node(n.kind, n.value, tuple(resolved(a) if isinstance(a, Node) else tuple(resolved(b) if not isinstance(b, tuple) else tuple(map(resolved, b)) for b in a) if isinstance(a, tuple) else a for a in n.args), n.text)

    group = [meant(g, prefer_alias=False) for g in q["group"]]
    having = resolved(q["having"]) if q["having"] is not None else None
    order = [(meant(n) if n.kind == "lit" else resolved(n), down) for n, down in q["order"]]
    if q["where"] is not None:
        data = data.where(c.condition(q["where"]))
    found = calls([n for n, _ in items] + ([having] if having else []) + [n for n, _ in order], [])
    if group or found:
        known = {g: f"_g{i}" for i, g in enumerate(group)}
        computed = {f"_a{i}": c.column(a) for i, a in enumerate(found)}
        known |= {a: f"_a{i}" for i, a in enumerate(found)}
        for n in plain_columns([n for n, _ in items] + ([having] if having else []) + [n for n, _ in order], known, []):
            known[n] = f"_f{c.name(n)}"
            computed[known[n]] = agg.first_value(f"`{c.name(n)}`")
        data = data.groupBy(*(c.column(g).alias(known[g]) for g in group)).agg(*(v.alias(k) for k, v in computed.items())) if computed else data.select(*(c.column(g).alias(known[g]) for g in group)).distinct()
        c = Compiler(spark, data, c.alias, database, params, variables or {}, known)
    if having is not None:
        data = data.where(c.condition(having))
    shown = [c.column(n).alias(name) for n, name in items]
    if q["distinct"]:
        data = data.select(*shown).distinct()
        keys = [(F.col(f"`{next((name for m, name in items if m == n), None)}`"), down) for n, down in order]
        if any("None" in str(k) for k, _ in keys):
            raise SqlError("ORDER BY of SELECT DISTINCT must name a selected column")
        hidden: list[str] = []
    else:
        hidden = [f"_o{i}" for i in range(len(order))]
        data = data.select(*shown, *(c.column(n).alias(h) for (n, _), h in zip(order, hidden, strict=True)))
        keys = [(F.col(h), down) for h, (_, down) in zip(hidden, order, strict=True)]
    if keys:
        data = relational.order(data, *keys)
    if q["limit"] is not None:
        offset, count = (params[x.value] if isinstance(x, Node) else x for x in q["limit"])
        data = relational.limit(data, count, offset)
    return data.drop(*hidden) if hidden else data
