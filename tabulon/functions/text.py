"""String functions. Positions count characters from 1; LENGTH counts bytes; comparison is by code point."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _s(x: Column) -> Column:
    return x.cast("string")


def length(x: Column) -> Column:
    return F.octet_length(_s(x))


def left(x: Column, n: Column) -> Column:
    return F.substring(_s(x), F.lit(1), F.greatest(n, F.lit(0)))


def right(x: Column, n: Column) -> Column:
    return F.when(n > 0, F.substring(_s(x), F.greatest(F.char_length(_s(x)) - n + 1, F.lit(1)), n)).otherwise(F.when(x.isNotNull() & n.isNotNull(), F.lit("")))


def substring(x: Column, at: Column, n: Column | None = None) -> Column:
    """From position `at` (from the end if negative); position 0 gives an empty string."""
    s = _s(x)
    size = F.char_length(s)
    start = F.when(at < 0, size + at + 1).otherwise(at)
    count = size if n is None else n
    return F.when(s.isNull() | at.isNull(), F.lit(None).cast("string")).when((start < 1) | (count < 1), F.lit("")).otherwise(F.substring(s, start.cast("int"), count.cast("int")))


def insert(x: Column, at: Column, n: Column, new: Column) -> Column:
    """x with n characters from position `at` replaced; unchanged if the position is outside."""
    s = _s(x)
    size = F.char_length(s)
    tail = F.when((n < 0) | (at + n > size), F.lit("")).otherwise(F.substring(s, (at + n).cast("int"), size))
    return F.when((at < 1) | (at > size), s).otherwise(F.concat(F.substring(s, F.lit(1), (at - 1).cast("int")), _s(new), tail))


def concat(*xs: Column) -> Column:
    return F.concat(*map(_s, xs))


def concat_ws(sep: Column, *xs: Column) -> Column:
    """Nulls are skipped; a null separator gives null."""
    return F.call_function("concat_ws", sep, *map(_s, xs))


def field(x: Column, *xs: Column) -> Column:
    """Place of x among the others; 0 if it is not there or null."""
    out = F.lit(0)
    for i, y in reversed(list(enumerate(xs, 1))):
        out = F.when(x == y, i).otherwise(out)
    return out


def elt(n: Column, *xs: Column) -> Column:
    out = F.lit(None).cast("string")
    for i, y in enumerate(xs, 1):
        out = F.when(n == i, _s(y)).otherwise(out)
    return out


def find_in_set(x: Column, xs: Column) -> Column:
    return F.find_in_set(_s(x), _s(xs))


def make_set(bits: Column, *xs: Column) -> Column:
    """Comma-joined strings of the bits that are set."""
    on = F.array(*(F.when(bits.cast("long").bitwiseAND(F.lit(1 << i)) != 0, _s(x)) for i, x in enumerate(xs)))
    return F.when(bits.isNotNull(), F.array_join(F.filter(on, lambda x: x.isNotNull()), ","))


def export_set(bits: Column, on: Column, off: Column, sep: Column | None = None, n: Column | None = None) -> Column:
    """on or off for each bit from the lowest, joined; 64 of them unless n says fewer."""
    count = F.lit(64) if n is None else F.when((n < 0) | (n > 64), 64).otherwise(n)
    value = bits.cast("long")
    each = F.transform(F.sequence(F.lit(0), count.cast("int") - 1), lambda i: F.when(F.call_function("shiftrightunsigned", value, i).bitwiseAND(F.lit(1)) == 1, _s(on)).otherwise(_s(off)))
    joined = F.aggregate(F.slice(each, F.lit(2), F.lit(64)), F.element_at(each, 1), lambda a, x: F.concat(a, F.lit(",") if sep is None else _s(sep), x))
    return F.when(count < 1, F.lit("")).otherwise(joined)


def quote(x: Column) -> Column:
    """An SQL literal; NULL for null."""
    s = F.regexp_replace(_s(x), r"([\\'])", r"\\$1")
    return F.coalesce(F.concat(F.lit("'"), F.replace(F.replace(s, F.lit("\x00"), F.lit("\\0")), F.lit("\x1a"), F.lit("\\Z")), F.lit("'")), F.lit("NULL"))


def strcmp(a: Column, b: Column) -> Column:
    return F.when(a == b, 0).when(a < b, -1).when(a > b, 1)


def ord_(x: Column) -> Column:
    """Number of the first character's bytes."""
    return F.when(_s(x) == "", 0).otherwise(F.conv(F.hex(F.encode(F.substring(_s(x), 1, 1), "utf-8")), 16, 10).cast("long"))


def locate(needle: Column, x: Column, at: Column | None = None) -> Column:
    return F.call_function("locate", _s(needle), _s(x), *(() if at is None else (at.cast("int"),)))


def instr(x: Column, needle: Column) -> Column:
    return F.call_function("instr", _s(x), _s(needle))


def format_(x: Column, digits: Column) -> Column:
    return F.call_function("format_number", x.cast("decimal(30,10)"), digits.cast("int"))


def oct_(x: Column) -> Column:
    return F.conv(x.cast("string"), 10, 8)


def bin_(x: Column) -> Column:
    return F.bin(x.cast("long"))


def hex_(x: Column) -> Column:
    return F.hex(x)


def repeat(x: Column, n: Column) -> Column:
    return F.call_function("repeat", _s(x), F.greatest(n.cast("int"), F.lit(0)))


def space(n: Column) -> Column:
    return repeat(F.lit(" "), n)


def pad(x: Column, n: Column, p: Column, at_left: bool) -> Column:
    return F.when(n >= 0, F.call_function("lpad" if at_left else "rpad", _s(x), n.cast("int"), _s(p)))


def like(x: Column, p: Column, escape: str = "\\") -> Column:
    return F.like(_s(x), _s(p), F.lit(escape))


def regexp(x: Column, p: Column) -> Column:
    return F.rlike(_s(x), _s(p))


def sounds_like(a: Column, b: Column) -> Column:
    return F.soundex(_s(a)) == F.soundex(_s(b))


def substring_index(x: Column, sep: Column, n: Column) -> Column:
    return F.call_function("substring_index", _s(x), _s(sep), n.cast("int"))


def char_(*codes: Column) -> Column:
    """Characters of the codes, one byte each; nulls are skipped."""
    return F.call_function("concat_ws", F.lit(""), *(F.char(c.cast("long")) for c in codes))
