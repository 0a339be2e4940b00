"""Date and time functions. DATETIME is a timestamp without zone, TIME a day-time interval, packed numbers are YYYYMMDDhhmmss."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A format's specifiers as patterns of Spark's formatter.
SPECIFIERS = {
    "a": "EEE", "b": "MMM", "c": "M", "d": "dd", "e": "d", "f": "SSSSSS", "H": "HH", "h": "hh", "I": "hh", "i": "mm", "j": "DDD", "k": "H", "l": "h",
    "M": "MMMM", "m": "MM", "p": "a", "r": "hh:mm:ss a", "S": "ss", "s": "ss", "T": "HH:mm:ss", "W": "EEEE", "Y": "yyyy", "y": "yy",
}
#: GET_FORMAT's formats.
FORMATS = {
    ("DATE", "USA"): "%m.%d.%Y", ("DATE", "JIS"): "%Y-%m-%d", ("DATE", "ISO"): "%Y-%m-%d", ("DATE", "EUR"): "%d.%m.%Y", ("DATE", "INTERNAL"): "%Y%m%d",
    ("DATETIME", "USA"): "%Y-%m-%d %H.%i.%s", ("DATETIME", "JIS"): "%Y-%m-%d %H:%i:%s", ("DATETIME", "ISO"): "%Y-%m-%d %H:%i:%s", ("DATETIME", "EUR"): "%Y-%m-%d %H.%i.%s", ("DATETIME", "INTERNAL"): "%Y%m%d%H%i%s",
    ("TIME", "USA"): "%h:%i:%s %p", ("TIME", "JIS"): "%H:%i:%s", ("TIME", "ISO"): "%H:%i:%s", ("TIME", "EUR"): "%H.%i.%s", ("TIME", "INTERNAL"): "%H%i%s",
}
#: Fixed value: days from year 0 to 1970-01-01.
EPOCH_DAYS = 719528
UNITS = ("MICROSECOND", "SECOND", "MINUTE", "HOUR", "DAY", "WEEK", "MONTH", "QUARTER", "YEAR")


def pattern(fmt: str) -> str:
    """A `%Y-%m-%d` format as a pattern."""
    out, i = "", 0
    while i < len(fmt):
        if fmt[i] == "%" and i + 1 < len(fmt):
            out += SPECIFIERS.get(fmt[i + 1], "'" + fmt[i + 1] + "'")
            i += 2
        else:
            out += "''" if fmt[i] == "'" else f"'{fmt[i]}'" if fmt[i].isalpha() else fmt[i]
            i += 1
    return out


def date_format(x: Column, fmt: str) -> Column:
    return F.date_format(x.cast("timestamp_ntz"), pattern(fmt))


def str_to_date(x: Column, fmt: str) -> Column:
    """Null if the text does not follow the format."""
    return F.call_function("try_to_timestamp", x.cast("string"), F.lit(pattern(fmt))).cast("timestamp_ntz")


def add_interval(x: Column, n: Column, unit: str, sign: int = 1, date: bool = False) -> Column:
    """x plus n units; months and years end on the last day of a shorter month. A date (then say so) stays one for units of a day or more."""
    u = unit.upper()
    if u not in UNITS:
        raise ValueError(f"unknown unit {unit}")
    n = n.cast("long") * sign
    if u in ("MONTH", "QUARTER", "YEAR"):
        months = n * {"MONTH": 1, "QUARTER": 3, "YEAR": 12}[u]
        return x + F.make_ym_interval(F.lit(0), months.cast("int"))
    per = {"MICROSECOND": 1e-6, "SECOND": 1, "MINUTE": 60, "HOUR": 3600, "DAY": 86400, "WEEK": 604800}[u]
    if u in ("DAY", "WEEK") and date:
        return F.date_add(x, (n * (7 if u == "WEEK" else 1)).cast("int"))
    if u in ("DAY", "WEEK"):
        return x + F.make_dt_interval((n * (7 if u == "WEEK" else 1)).cast("int"))
    if u == "MICROSECOND":
        return x.cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), (n / F.lit(1_000_000)).cast("decimal(18,6)"))
    return x.cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), (n * int(per)).cast("decimal(18,6)"))


def time_to_sec(x: Column) -> Column:
    """Seconds since midnight of a timestamp."""
    return (F.hour(x) * 3600 + F.minute(x) * 60 + F.second(x)).cast("long")


def sec_to_time(n: Column) -> Column:
    return F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), n.cast("decimal(18,6)"))


def time_text(n: Column) -> Column:
    """Seconds as [-]hh:mm:ss."""
    s = F.abs(n.cast("long"))
    return F.concat(F.when(n < 0, "-").otherwise(""), F.lpad((s / 3600).cast("long").cast("string"), 2, "0"), F.lit(":"), F.lpad(((s / 60).cast("long") % 60).cast("string"), 2, "0"), F.lit(":"), F.lpad((s % 60).cast("string"), 2, "0"))


def maketime(h: Column, m: Column, s: Column) -> Column:
    return F.when(m.between(0, 59) & (s >= 0) & (s < 60), F.make_dt_interval(F.lit(0), h.cast("int"), m.cast("int"), s.cast("decimal(18,6)")))


def makedate(year: Column, day: Column) -> Column:
    return F.when(day > 0, F.date_add(F.make_date(year.cast("int"), F.lit(1), F.lit(1)), (day - 1).cast("int")))


def to_days(x: Column) -> Column:
    return F.datediff(x.cast("date"), F.lit("1970-01-01").cast("date")) + EPOCH_DAYS


def from_days(n: Column) -> Column:
    return F.date_add(F.lit("1970-01-01").cast("date"), (n - EPOCH_DAYS).cast("int"))


def to_seconds(x: Column) -> Column:
    t = x.cast("timestamp_ntz")
    return to_days(x).cast("long") * 86400 + time_to_sec(t)


def period_add(p: Column, n: Column) -> Column:
    """YYYYMM plus n months."""
    m = F.floor(p / 100) * 12 + p % 100 - 1 + n
    return (F.floor(m / 12) * 100 + m % 12 + 1).cast("long")


def period_diff(a: Column, b: Column) -> Column:
    return (F.floor(a / 100) * 12 + a % 100 - F.floor(b / 100) * 12 - b % 100).cast("long")


def week(x: Column, mode: int = 0) -> Column:
    """Week number by mode: 0 and 2 start on Sunday, 1 and 3 on Monday; 3 is ISO, 2 the Sunday week of 1 to 53."""
    d = x.cast("date")
    if mode == 3:
        return F.weekofyear(d)
    if mode not in (0, 1, 2):
        raise ValueError("week modes 0 to 3 are known")
    if mode == 1:
        first = (F.weekday(F.trunc(d, "year")) + 7) % 7  # Monday 0
        return F.floor((F.dayofyear(d) - 1 + first) / 7).cast("int") + F.when(first <= 3, 1).otherwise(0)
    first = (F.dayofweek(F.trunc(d, "year")) - 1) % 7  # Sunday 0
    plain = F.floor((F.dayofyear(d) - 1 + first) / 7).cast("int") + F.when(first == 0, 1).otherwise(0)
    if mode == 0:
        return plain
    last_year = F.date_sub(F.trunc(d, "year"), 1)
    return F.when(plain > 0, plain).otherwise(week(last_year, 0))


def yearweek(x: Column) -> Column:
    """Year and Sunday week of mode 2."""
    d = x.cast("date")
    return ((F.year(d) - F.when(week(d, 0) == 0, 1).otherwise(0)) * 100 + week(d, 2)).cast("int")


def datediff(a: Column, b: Column) -> Column:
    return F.datediff(a.cast("date"), b.cast("date"))


def timestampdiff(unit: str, a: Column, b: Column) -> Column:
    return F.timestamp_diff(unit.upper(), a.cast("timestamp_ntz"), b.cast("timestamp_ntz")) if unit.upper() != "MICROSECOND" else F.timestamp_diff("MICROSECOND", a.cast("timestamp_ntz"), b.cast("timestamp_ntz"))


def timediff(a: Column, b: Column) -> Column:
    return a.cast("timestamp_ntz") - b.cast("timestamp_ntz")


def time_part(x: Column) -> Column:
    return x.cast("timestamp_ntz") - F.date_trunc("day", x.cast("timestamp_ntz")).cast("timestamp_ntz")


def now(fsp: int = 0) -> Column:
    """The statement's time, cut to fsp digits of a second."""
    t = F.localtimestamp()
    whole = F.date_trunc("second", t).cast("timestamp_ntz")
    if fsp == 0:
        return whole
    micro = (F.floor((F.extract(F.lit("SECOND"), t) % 1) * 10**fsp) / 10**fsp).cast("decimal(18,6)")
    return whole + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), micro)


def pack(x: Column) -> Column:
    """A timestamp as the number YYYYMMDDhhmmss."""
    return F.date_format(x.cast("timestamp_ntz"), "yyyyMMddHHmmss").cast("long")


def unpack(n: Column) -> Column:
    """The number YYYYMMDDhhmmss, or YYYYMMDD, as a timestamp; null if it is none."""
    s = n.cast("long").cast("string")
    whole = F.when(F.char_length(s) <= 8, F.concat(s, F.lit("000000"))).otherwise(s)
    return F.call_function("try_to_timestamp", F.lpad(whole, 14, "0"), F.lit("yyyyMMddHHmmss")).cast("timestamp_ntz")


def pack_time(x: Column) -> Column:
    """A day-time interval as the number [-]hhmmss."""
    s = interval_seconds(x)
    a = F.abs(s)
    return F.when(s < 0, -1).otherwise(1) * (F.floor(a / 3600) * 10000 + F.floor(a / 60) % 60 * 100 + a % 60).cast("long")


def unpack_time(n: Column) -> Column:
    """[-]hhmmss as a day-time interval; null beyond 838:59:59 or if minutes or seconds exceed 59."""
    a = F.abs(n.cast("long"))
    sign = F.when(n < 0, -1).otherwise(1)
    total = sign * (F.floor(a / 10000) * 3600 + F.floor(a / 100) % 100 * 60 + a % 100)
    return F.when((a < 8_390_000) & (F.floor(a / 100) % 100 < 60) & (a % 100 < 60), F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), total.try_cast("decimal(18,6)")))


def interval_seconds(x: Column) -> Column:
    """Whole seconds of a day-time interval."""
    return (F.extract(F.lit("DAY"), x) * 86400 + F.extract(F.lit("HOUR"), x) * 3600 + F.extract(F.lit("MINUTE"), x) * 60 + F.extract(F.lit("SECOND"), x)).cast("long")


def parse_time(x: Column) -> Column:
    """[-]hhh:mm:ss as a day-time interval; null if it is none."""
    m = lambda k: F.regexp_extract(x, r"^(-?)(\d{1,3}):([0-5]?\d):([0-5]?\d(?:\.\d{1,6})?)$", k)
    part = lambda k, kind: F.when(m(2) != "", m(k)).cast(kind)
    total = part(2, "decimal(18,6)") * 3600 + part(3, "decimal(18,6)") * 60 + part(4, "decimal(18,6)")
    return F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), (F.when(m(1) == "-", -1).otherwise(1) * total).cast("decimal(18,6)"))
