"""Arithmetic, bit operations and mathematics with the dialect's rules.

Division by zero gives null; integers overflow with an error (ANSI); `/` of exact numbers is a decimal of the dividend's scale plus four
digits, half even; DIV truncates exact numbers toward zero and floors floating ones; the remainder has the dividend's sign.
"""

import zlib

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

INTEGERS = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)


def add(a: Column, b: Column) -> Column:
    return a + b


def subtract(a: Column, b: Column) -> Column:
    return a - b


def multiply(a: Column, b: Column) -> Column:
    return a * b


def divide(a: Column, b: Column, kind: T.DataType | None = None) -> Column:
    """kind: the dividend's type where both sides are exact numbers; otherwise the quotient is a double."""
    if kind is None:
        return F.try_divide(a.cast("double"), b.cast("double"))
    scale = (kind.scale if isinstance(kind, T.DecimalType) else 0) + 4
    wide = min(scale + 12, 30)
    exact = F.try_divide(a.cast(f"decimal(38,{min(scale, 18)})"), b.cast("decimal(20,6)"))
    return F.bround(exact.cast(f"decimal(38,{min(wide, 18)})"), scale).cast(f"decimal(38,{scale})")


def div(a: Column, b: Column, floating: bool = False) -> Column:
    if floating:
        return F.floor(F.try_divide(a, b))
    return F.try_divide(a.cast("decimal(28,8)"), b.cast("decimal(28,8)")).cast("long")


def mod(a: Column, b: Column) -> Column:
    return F.try_mod(a, b)


def xor_bits(a: Column, b: Column) -> Column:
    return a.cast("long").bitwiseXOR(b.cast("long"))


def and_bits(a: Column, b: Column) -> Column:
    return a.cast("long").bitwiseAND(b.cast("long"))


def or_bits(a: Column, b: Column) -> Column:
    return a.cast("long").bitwiseOR(b.cast("long"))


def shift_left(a: Column, n: Column) -> Column:
    return F.when(n < 64, F.call_function("shiftleft", a.cast("long"), n.cast("int"))).otherwise(F.when(n.isNotNull(), F.lit(0).cast("long")))


def shift_right(a: Column, n: Column) -> Column:
    return F.when(n < 64, F.call_function("shiftrightunsigned", a.cast("long"), n.cast("int"))).otherwise(F.when(n.isNotNull(), F.lit(0).cast("long")))


def minus(a: Column) -> Column:
    return -a


def truncate(x: Column, digits: Column) -> Column:
    """Toward zero, to so many decimal places (negative: to tens, hundreds, ...). Decimal steps keep 2.3 from turning into 2.2."""
    power = F.pow(F.lit(10.0), digits.cast("double"))
    scaled = F.round(F.abs(x.cast("double")) * power, 9)
    return F.signum(x.cast("double")) * F.floor(scaled) / power


def round_(x: Column, digits: Column | None = None) -> Column:
    return F.round(x) if digits is None else F.round(x, digits)


def log(x: Column, y: Column | None = None) -> Column:
    """LOG(x), or LOG(base, x); null for what has no logarithm."""
    positive = lambda v: F.when(v > 0, F.ln(v))
    return positive(x) if y is None else F.try_divide(positive(y), F.when(x != 1, positive(x)))


def _safe(f, ok):
    return lambda x: F.when(ok(x), f(x))


ln = _safe(F.ln, lambda x: x > 0)
log10 = _safe(F.log10, lambda x: x > 0)
log2 = _safe(F.log2, lambda x: x > 0)
sqrt = _safe(F.sqrt, lambda x: x >= 0)
acos = _safe(F.acos, lambda x: F.abs(x) <= 1)
asin = _safe(F.asin, lambda x: F.abs(x) <= 1)
cot = _safe(F.cot, lambda x: x != 0)


def atan(x: Column, y: Column | None = None) -> Column:
    return F.atan(x) if y is None else F.atan2(x, y)


def conv(x: Column, a: Column, b: Column) -> Column:
    return F.call_function("conv", x.cast("string"), a.cast("int"), b.cast("int"))


def _packed(data):
    if data is None:
        return None
    raw = bytes(data)
    return len(raw).to_bytes(4, "little") + zlib.compress(raw) if raw else b""


def _unpacked(data):
    if data is None or len(data) in (1, 2, 3, 4):
        return None
    try:
        return zlib.decompress(bytes(data)[4:]) if data else b""
    except zlib.error:
        return None


def _by_batch(f, x: Column) -> Column:
    import pandas as pd

    def run(values: pd.Series) -> pd.Series:
        return values.map(f, na_action="ignore").astype(object).where(values.notna(), None)

    return F.pandas_udf(run, T.BinaryType())(x.cast("binary"))


def compress(x: Column) -> Column:
    """Length in four bytes, then the zlib stream. This pair has no Spark expression; it runs on Arrow batches."""
    return _by_batch(_packed, x)


def uncompress(x: Column) -> Column:
    """Null for what is no such stream."""
    return _by_batch(_unpacked, x)
