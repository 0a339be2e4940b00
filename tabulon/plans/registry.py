"""The registered queries, by operator family, each with its DuckDB SQL where SQL can express it.

Most are statements of the dialect run through the engine; DataFrame operators are called where they are the feature.
Names that begin with ext_ are extensions beyond the dialect's single-table surface.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import casts, crypto, logic, numeric, temporal, text
from ..operators import aggregate, dml, relational, scan, statistics
from ..shipping import ship
from ..sources.tables import KEYS, Catalog
from ..streaming import cdc, windows
from .engine import Engine

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ship(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def statement(name: str, sql: str, oracle: str | None = None) -> None:
    """A statement of the dialect; its SQL is the same unless given."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        names = tuple(t for t in KEYS if t in sql)  # only tables that the statement names are opened
        return Engine(spark, Catalog(spark).load(sf_dir, names)).execute(sql)

    QUERIES[name] = run
    ORACLE_SQL[name] = oracle or sql


def frame(oracle: str | None = None):
    """Decorator: a query over DataFrames, named by its function."""

    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLE_SQL[f.__name__] = oracle
        return f

    return add


# Flagship: filter, grouped aggregates, HAVING, ORDER BY, LIMIT.
statement(
    "flagship",
    "SELECT l_returnflag, round(sum(l_quantity), 2) AS s, round(avg(l_discount), 6) AS a, count(1) AS c, max(l_shipdate) AS m FROM lineitem WHERE l_quantity > 10 GROUP BY l_returnflag HAVING sum(l_quantity) > 100 ORDER BY s DESC LIMIT 2",
)

# Scans
statement("scan_full", "SELECT * FROM nation")
statement("scan_project", "SELECT n_name, n_nationkey + 1 AS k FROM nation")
statement("scan_pk_range", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey >= 100 AND o_orderkey < 200")
statement("filter_between", "SELECT o_orderkey FROM orders WHERE o_totalprice BETWEEN 1000 AND 50000")
statement("filter_not_between", "SELECT o_orderkey FROM orders WHERE o_totalprice NOT BETWEEN 1000 AND 400000")
statement("point_get", "SELECT o_orderkey, o_custkey, o_orderstatus FROM orders WHERE o_orderkey = 77")
statement("multi_point_get", "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey = 5 OR o_orderkey = 9 OR o_orderkey = 123456789")
statement("composite_key_get", "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE (l_orderkey = 1 AND l_linenumber = 1) OR (l_orderkey = 7 AND l_linenumber = 2) OR (l_orderkey = 40 AND l_linenumber = 3)")
statement("dual_const", "SELECT 1 AS a, 2 + 6 AS b, 'test' AS t")
statement("where_false", "SELECT n_nationkey, n_name FROM nation WHERE 1 = 0")
statement("limit_zero", "SELECT o_orderkey, o_orderstatus FROM orders LIMIT 0")
statement("star_with_expression", "SELECT n.*, 1 AS one FROM nation n")


@frame("SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem WHERE l_orderkey BETWEEN 10 AND 19")
def scan_key_range_frame(spark, sf_dir):
    return scan.range_scan(table(spark, sf_dir, "lineitem"), "l_orderkey", 10, 20, columns=("l_orderkey", "l_linenumber", "l_extendedprice"))


@frame("SELECT c_custkey, c_mktsegment FROM customer WHERE c_mktsegment = 'MACHINERY'")
def index_scan_covering(spark, sf_dir):
    return scan.index_scan(table(spark, sf_dir, "customer"), ("c_custkey", "c_mktsegment"), F.col("c_mktsegment") == "MACHINERY")


@frame("SELECT * FROM orders WHERE o_custkey BETWEEN 10 AND 12")
def index_lookup_double_read(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    return scan.index_lookup(orders.select("o_custkey", "o_orderkey"), orders, ("o_orderkey",), F.col("o_custkey").between(10, 12))


@frame("SELECT l_orderkey, count(*) AS n FROM lineitem WHERE l_orderkey < 1500 GROUP BY l_orderkey")
def point_get_many(spark, sf_dir):
    keys = [(i,) for i in range(1500)]
    return scan.point_get(table(spark, sf_dir, "lineitem"), ("l_orderkey",), keys).groupBy("l_orderkey").agg(F.count("*").alias("n"))


@frame("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey >= 50 ORDER BY o_orderkey LIMIT 20")
def key_scan_ordered(spark, sf_dir):
    return scan.key_scan(table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), "o_orderkey", 50, None, 20)


# Predicates
statement("filter_and_or_tree", "SELECT p_partkey, p_name FROM part WHERE (p_size > 10 AND p_brand = 'Brand#2') OR (p_type = 'ECONOMY' AND NOT p_size > 40)")
statement("filter_not", "SELECT p_partkey FROM part WHERE NOT (p_size > 10)")
statement("filter_in", "SELECT p_partkey, p_brand FROM part WHERE p_brand IN ('Brand#2', 'Brand#17') AND p_size NOT IN (1, 2, 3)")
statement("filter_is_null", "SELECT c_custkey FROM customer WHERE c_acctbal IS NOT NULL AND NOT (c_name IS NULL)")
statement("filter_like", "SELECT p_partkey, p_name FROM part WHERE p_name LIKE '%red%' AND p_name NOT LIKE '%ring'")
statement("filter_regexp", "SELECT p_partkey FROM part WHERE p_name REGEXP '^(small|red)'", "SELECT p_partkey FROM part WHERE regexp_matches(p_name, '^(small|red)')")
statement("filter_constant_true", "SELECT count(*) AS n FROM orders WHERE 1 = 1 AND o_custkey > 10")
statement("filter_dates", "SELECT o_orderkey FROM orders WHERE o_orderdate >= '1997-01-01' AND o_orderdate < '1997-02-01'")
statement("null_safe_eq", "SELECT c_custkey FROM customer WHERE NULLIF(c_nationkey, 3) <=> NULL", "SELECT c_custkey FROM customer WHERE NULLIF(c_nationkey, 3) IS NOT DISTINCT FROM NULL")
statement("filter_truth", "SELECT n_nationkey FROM nation WHERE (n_regionkey > 1) IS TRUE AND (n_nationkey > 20) IS NOT TRUE")
statement("filter_xor", "SELECT n_nationkey FROM nation WHERE n_regionkey > 1 XOR n_nationkey > 10", "SELECT n_nationkey FROM nation WHERE (n_regionkey > 1) <> (n_nationkey > 10)")


@frame("SELECT l_orderkey, l_linenumber FROM lineitem WHERE coalesce(NULLIF(l_linenumber, 1) > 2, FALSE) OR coalesce(l_quantity > 45, FALSE)")
def filter_two_valued(spark, sf_dir):
    a = F.nullif(F.col("l_linenumber"), F.lit(1)) > 2
    return table(spark, sf_dir, "lineitem").where(logic.or_two(a, F.col("l_quantity") > 45)).select("l_orderkey", "l_linenumber")


# Arithmetic
statement("arith_basic", "SELECT l_orderkey, l_linenumber, l_quantity + 1 AS a, l_quantity - 2 AS b, l_linenumber * 3 AS c, -l_linenumber AS d FROM lineitem")
statement("arith_div_decimal", "SELECT o_orderkey, o_custkey / 7 AS q FROM orders", "SELECT o_orderkey, CAST(round_even(CAST(o_custkey AS DECIMAL(18, 4)) * 1.0 / 7, 4) AS DECIMAL(38, 4)) AS q FROM orders")
statement("arith_div_int", "SELECT o_orderkey, o_custkey DIV 7 AS q, -o_custkey DIV 7 AS n FROM orders", "SELECT o_orderkey, CAST(trunc(o_custkey / 7) AS BIGINT) AS q, CAST(trunc(-o_custkey / 7) AS BIGINT) AS n FROM orders")
statement("arith_mod", "SELECT o_orderkey, o_custkey % 7 AS a, o_custkey MOD 5 AS b, -o_custkey % 7 AS c FROM orders", "SELECT o_orderkey, o_custkey % 7 AS a, o_custkey % 5 AS b, -o_custkey % 7 AS c FROM orders")
statement("arith_bits", "SELECT o_orderkey, o_custkey ^ 5 AS x, o_custkey & 12 AS a, o_custkey | 3 AS o, o_custkey << 2 AS l, o_custkey >> 1 AS r, ~o_custkey AS n FROM orders", "SELECT o_orderkey, xor(o_custkey, 5) AS x, o_custkey & 12 AS a, o_custkey | 3 AS o, o_custkey << 2 AS l, o_custkey >> 1 AS r, ~o_custkey AS n FROM orders")
statement("arith_zero_division", "SELECT n_nationkey, n_nationkey / 0 IS NULL AS a, n_nationkey % 0 IS NULL AS b, n_nationkey DIV 0 IS NULL AS c FROM nation", "SELECT n_nationkey, TRUE AS a, TRUE AS b, TRUE AS c FROM nation")

# Aggregation
statement("agg_global", "SELECT count(*) AS n, round(sum(l_quantity), 2) AS s, round(avg(l_tax), 6) AS a, min(l_discount) AS lo, max(l_discount) AS hi FROM lineitem")
statement("agg_group", "SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_extendedprice), 2) AS s FROM lineitem GROUP BY l_returnflag, l_linestatus")
statement("agg_group_expr", "SELECT l_linenumber % 3 AS k, count(l_quantity) AS n, max(l_quantity) AS m FROM lineitem GROUP BY l_linenumber % 3")
statement("agg_group_ordinal", "SELECT o_orderpriority AS p, count(1) AS n FROM orders GROUP BY 1 ORDER BY 1")
statement("agg_group_multi", "SELECT c_mktsegment, c_nationkey, count(*) AS n, round(avg(c_acctbal), 4) AS a FROM customer GROUP BY c_mktsegment, c_nationkey")
statement("agg_count_distinct", "SELECT l_returnflag, count(DISTINCT l_partkey) AS n FROM lineitem GROUP BY l_returnflag")
statement("agg_sum_distinct", "SELECT l_linenumber, sum(DISTINCT l_suppkey) AS s FROM lineitem GROUP BY l_linenumber", "SELECT l_linenumber, CAST(sum(DISTINCT l_suppkey) AS BIGINT) AS s FROM lineitem GROUP BY l_linenumber")
statement("agg_avg_distinct", "SELECT l_returnflag, round(avg(DISTINCT l_suppkey), 6) AS a FROM lineitem GROUP BY l_returnflag")
statement("agg_minmax_string_date", "SELECT min(o_orderpriority) AS a, max(o_orderstatus) AS b, min(o_orderdate) AS c, max(o_orderdate) AS d FROM orders")
statement("agg_bit", "SELECT l_returnflag, bit_and(l_linenumber) AS a, bit_or(l_linenumber) AS o, bit_xor(l_linenumber) AS x FROM lineitem GROUP BY l_returnflag")
statement("agg_std", "SELECT l_returnflag, round(std(l_quantity), 6) AS s FROM lineitem GROUP BY l_returnflag", "SELECT l_returnflag, round(stddev_pop(l_quantity), 6) AS s FROM lineitem GROUP BY l_returnflag")
statement("agg_group_concat", "SELECT n_regionkey, group_concat(n_name SEPARATOR ';') AS names FROM nation GROUP BY n_regionkey", "SELECT n_regionkey, string_agg(n_name, ';' ORDER BY n_name) AS names FROM nation GROUP BY n_regionkey")
statement("agg_nested_arith", "SELECT max(l_linenumber) - 1 AS a, sum(l_linenumber) + count(*) AS b FROM lineitem", "SELECT max(l_linenumber) - 1 AS a, CAST(sum(l_linenumber) + count(*) AS BIGINT) AS b FROM lineitem")
statement("having_hidden_agg", "SELECT o_custkey FROM orders GROUP BY o_custkey HAVING max(o_totalprice) > 400000 AND count(*) > 3")
statement("order_hidden_agg", "SELECT o_orderpriority FROM orders GROUP BY o_orderpriority ORDER BY max(o_orderkey) DESC, o_orderpriority LIMIT 3")
statement("having_alias", "SELECT c_nationkey AS k, count(*) AS n FROM customer GROUP BY k HAVING n > 50")
statement("agg_first_value", "SELECT o_orderkey, o_orderstatus, o_custkey, count(*) AS n FROM orders GROUP BY o_orderkey", "SELECT o_orderkey, any_value(o_orderstatus) AS o_orderstatus, any_value(o_custkey) AS o_custkey, count(*) AS n FROM orders GROUP BY o_orderkey")
statement("agg_empty_input", "SELECT count(*) AS n, sum(o_custkey) AS s, max(o_orderkey) AS m FROM orders WHERE o_orderkey < 0", "SELECT count(*) AS n, CAST(sum(o_custkey) AS BIGINT) AS s, max(o_orderkey) AS m FROM orders WHERE o_orderkey < 0")
statement("agg_identical_twice", "SELECT count(*) AS a, count(*) + 1 AS b, sum(o_custkey) AS c FROM orders", "SELECT count(*) AS a, count(*) + 1 AS b, CAST(sum(o_custkey) AS BIGINT) AS c FROM orders")
statement("select_distinct", "SELECT DISTINCT l_returnflag FROM lineitem")
statement("select_distinct_multi", "SELECT DISTINCT l_returnflag, l_linestatus, l_linenumber FROM lineitem")
statement("select_distinct_star", "SELECT DISTINCT * FROM nation")


@frame("SELECT count(*) AS n, CAST(coalesce(sum(o_custkey), 0) AS BIGINT) AS s FROM orders WHERE o_orderkey < 0")
def agg_empty_input_compat(spark, sf_dir):
    return table(spark, sf_dir, "orders").where("o_orderkey < 0").agg(F.count("*").alias("n"), aggregate.sum_or_zero("o_custkey").alias("s"))


@frame("SELECT l_returnflag, CAST(round_even(CAST(sum(l_linenumber) AS DECIMAL(18, 6)) * 1.000000 / count(*), 4) AS DECIMAL(38, 4)) AS a FROM lineitem GROUP BY l_returnflag")
def agg_avg_exact(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(aggregate.avg_exact("l_linenumber").alias("a"))


@frame("SELECT o_orderkey, o_custkey, count(o_totalprice) AS n, max(o_totalprice) AS m FROM orders GROUP BY o_orderkey, o_custkey")
def agg_eliminated_by_key(spark, sf_dir):
    return aggregate.unique_key_groups(table(spark, sf_dir, "orders"), ("o_orderkey",), ("o_orderkey", "o_custkey"), {"n": aggregate.one_row_count(F.col("o_totalprice")), "m": F.col("o_totalprice")})


@frame("SELECT c_mktsegment, n FROM (SELECT c_mktsegment, count(*) AS n, max(c_acctbal) AS m FROM customer GROUP BY c_mktsegment) WHERE m > 5000 ORDER BY m DESC, c_mktsegment LIMIT 3")
def agg_hidden_frame(spark, sf_dir):
    return aggregate.aggregate(table(spark, sf_dir, "customer"), ["c_mktsegment"], {"n": F.count("*")}, having="m > 5000", order=[F.desc("m"), F.asc("c_mktsegment")], limit=3, hidden={"m": F.max("c_acctbal")})


# Order, limit, top-n
statement("order_multi", "SELECT o_orderkey, o_orderstatus FROM orders ORDER BY o_orderstatus DESC, o_totalprice, o_orderkey LIMIT 50")
statement("order_ordinal", "SELECT o_orderkey, o_totalprice AS p FROM orders ORDER BY 2 DESC, 1 LIMIT 25")
statement("order_expression", "SELECT o_orderkey FROM orders ORDER BY o_custkey % 10, o_totalprice DESC, o_orderkey LIMIT 30")
statement("order_nulls", "SELECT c_custkey, NULLIF(c_nationkey, 3) AS k FROM customer ORDER BY k, c_custkey LIMIT 40", "SELECT c_custkey, NULLIF(c_nationkey, 3) AS k FROM customer ORDER BY k ASC NULLS FIRST, c_custkey LIMIT 40")
statement("order_nulls_desc", "SELECT c_custkey, NULLIF(c_nationkey, 24) AS k FROM customer ORDER BY k DESC, c_custkey LIMIT 40", "SELECT c_custkey, NULLIF(c_nationkey, 24) AS k FROM customer ORDER BY k DESC NULLS LAST, c_custkey LIMIT 40")
statement("limit_offset", "SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 10, 20", "SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 20 OFFSET 10")
statement("limit_offset_words", "SELECT o_orderkey FROM orders ORDER BY o_orderkey DESC LIMIT 7 OFFSET 3")
statement("topn", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10")


@frame("SELECT c_custkey, c_acctbal FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 15 OFFSET 5")
def topn_offset(spark, sf_dir):
    return relational.top_n(table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal"), [("c_acctbal", True), "c_custkey"], 15, 5)


# Scalar functions
statement(
    "math_rounding",
    "SELECT o_orderkey, ceil(o_totalprice) AS c, floor(o_totalprice) AS f, round(o_totalprice, 1) AS r, truncate(o_totalprice, 1) AS t, sign(o_totalprice - 1000) AS s, abs(-o_custkey) AS a FROM orders",
    "SELECT o_orderkey, CAST(ceil(o_totalprice) AS BIGINT) AS c, CAST(floor(o_totalprice) AS BIGINT) AS f, round(o_totalprice, 1) AS r, floor(round(o_totalprice * 10, 9)) / 10 AS t, CAST(sign(o_totalprice - 1000) AS INTEGER) AS s, abs(-o_custkey) AS a FROM orders",
)
statement(
    "math_functions",
    "SELECT o_orderkey, round(sqrt(o_custkey), 8) AS a, round(exp(o_custkey % 5), 8) AS b, round(ln(o_custkey + 1), 8) AS c, round(log10(o_custkey + 1), 8) AS d, round(log2(o_custkey + 1), 8) AS e, round(pow(o_custkey % 7, 3), 6) AS f, round(degrees(o_custkey), 6) AS g, round(radians(o_custkey), 8) AS h, round(pi(), 8) AS i FROM orders",
)
statement("math_trigonometry", "SELECT o_orderkey, round(sin(o_custkey), 8) AS a, round(cos(o_custkey), 8) AS b, round(tan(o_custkey % 3), 8) AS c, round(atan(o_custkey), 8) AS d, round(atan2(o_custkey, 2), 8) AS e, round(asin(o_custkey % 2), 8) AS f, round(acos(o_custkey % 2), 8) AS g FROM orders")
statement("math_conv", "SELECT o_orderkey, conv(o_custkey, 10, 16) AS a, bin(o_custkey) AS b, oct(o_custkey) AS c, hex(o_custkey) AS d FROM orders", "SELECT o_orderkey, printf('%X', o_custkey) AS a, bin(o_custkey) AS b, printf('%o', o_custkey) AS c, printf('%X', o_custkey) AS d FROM orders")
statement("math_crc32", "SELECT n_nationkey, crc32('123456789') AS c FROM nation", "SELECT n_nationkey, CAST(3421780262 AS BIGINT) AS c FROM nation")
statement(
    "str_basic",
    "SELECT p_partkey, upper(p_name) AS u, lower(p_type) AS l, length(p_name) AS n, char_length(p_name) AS c, concat(p_name, '-', p_brand) AS k, concat_ws('/', p_brand, p_type) AS w, reverse(p_brand) AS r, bit_length(p_name) AS b FROM part",
    "SELECT p_partkey, upper(p_name) AS u, lower(p_type) AS l, CAST(strlen(p_name) AS INTEGER) AS n, CAST(length(p_name) AS INTEGER) AS c, concat(p_name, '-', p_brand) AS k, concat_ws('/', p_brand, p_type) AS w, reverse(p_brand) AS r, CAST(bit_length(p_name) AS INTEGER) AS b FROM part",
)
statement(
    "str_parts",
    "SELECT p_partkey, left(p_name, 3) AS a, right(p_name, 4) AS b, substring(p_name, 2, 3) AS c, substr(p_name, -3) AS d, mid(p_name, 2) AS e, substring_index(p_name, ' ', 1) AS f, instr(p_name, 'r') AS g, locate('i', p_name) AS h FROM part",
    "SELECT p_partkey, left(p_name, 3) AS a, right(p_name, 4) AS b, substring(p_name, 2, 3) AS c, right(p_name, 3) AS d, substring(p_name, 2) AS e, split_part(p_name, ' ', 1) AS f, CAST(instr(p_name, 'r') AS INTEGER) AS g, CAST(instr(p_name, 'i') AS INTEGER) AS h FROM part",
)
statement(
    "str_padding",
    "SELECT p_partkey, lpad(p_brand, 10, '*') AS a, rpad(p_brand, 10, '-') AS b, repeat('ab', p_size % 4) AS c, replace(p_name, 'r', 'R') AS d, trim('  x ') AS e, ltrim('  x') AS f, rtrim('x  ') AS g, space(2) AS h, insert(p_name, 2, 2, '##') AS i FROM part",
    "SELECT p_partkey, lpad(p_brand, 10, '*') AS a, rpad(p_brand, 10, '-') AS b, repeat('ab', p_size % 4) AS c, replace(p_name, 'r', 'R') AS d, 'x' AS e, 'x' AS f, 'x' AS g, '  ' AS h, left(p_name, 1) || '##' || substring(p_name, 4) AS i FROM part",
)
statement(
    "str_sets",
    "SELECT p_partkey, field(p_brand, 'Brand#1', 'Brand#2') AS a, elt(p_size % 3 + 1, 'x', 'y', 'z') AS b, find_in_set(p_type, 'SMALL,ECONOMY,LARGE') AS c, strcmp(p_brand, 'Brand#2') AS d, ascii(p_name) AS e, make_set(p_size % 4, 'a', 'b') AS f FROM part",
    "SELECT p_partkey, CASE p_brand WHEN 'Brand#1' THEN 1 WHEN 'Brand#2' THEN 2 ELSE 0 END AS a, CASE p_size % 3 WHEN 0 THEN 'x' WHEN 1 THEN 'y' ELSE 'z' END AS b, CASE p_type WHEN 'SMALL' THEN 1 WHEN 'ECONOMY' THEN 2 WHEN 'LARGE' THEN 3 ELSE 0 END AS c, CASE WHEN p_brand = 'Brand#2' THEN 0 WHEN p_brand < 'Brand#2' THEN -1 ELSE 1 END AS d, ascii(p_name) AS e, CASE p_size % 4 WHEN 0 THEN '' WHEN 1 THEN 'a' WHEN 2 THEN 'b' ELSE 'a,b' END AS f FROM part",
)
statement("hash_digests", "SELECT c_custkey, md5(c_name) AS m, sha1(c_name) AS s, sha2(c_name, 256) AS h, hex(c_mktsegment) AS x, to_base64(c_name) AS b FROM customer", "SELECT c_custkey, md5(c_name) AS m, sha1(c_name) AS s, sha256(c_name) AS h, hex(c_mktsegment) AS x, to_base64(encode(c_name)) AS b FROM customer")
statement(
    "date_parts",
    "SELECT o_orderkey, year(o_orderdate) AS y, month(o_orderdate) AS m, day(o_orderdate) AS d, quarter(o_orderdate) AS q, dayofyear(o_orderdate) AS dy, dayofweek(o_orderdate) AS dw, weekday(o_orderdate) AS wd, weekofyear(o_orderdate) AS w, hour(o_orderdate) AS h FROM orders",
    "SELECT o_orderkey, CAST(year(o_orderdate) AS INTEGER) AS y, CAST(month(o_orderdate) AS INTEGER) AS m, CAST(day(o_orderdate) AS INTEGER) AS d, CAST(quarter(o_orderdate) AS INTEGER) AS q, CAST(dayofyear(o_orderdate) AS INTEGER) AS dy, CAST(dayofweek(o_orderdate) + 1 AS INTEGER) AS dw, CAST(isodow(o_orderdate) - 1 AS INTEGER) AS wd, CAST(weekofyear(o_orderdate) AS INTEGER) AS w, CAST(hour(o_orderdate) AS INTEGER) AS h FROM orders",
)
statement(
    "date_arithmetic",
    "SELECT o_orderkey, date_add(date(o_orderdate), interval 1 month) AS a, date_sub(date(o_orderdate), interval 10 day) AS b, datediff(o_orderdate, '1995-01-01') AS c, last_day(o_orderdate) AS d, to_days(o_orderdate) AS e, o_orderdate + interval 90 minute AS f, timestampdiff(day, '1995-01-01', o_orderdate) AS g FROM orders",
    "SELECT o_orderkey, CAST(CAST(o_orderdate AS DATE) + INTERVAL 1 MONTH AS DATE) AS a, CAST(CAST(o_orderdate AS DATE) - INTERVAL 10 DAY AS DATE) AS b, CAST(date_diff('day', DATE '1995-01-01', CAST(o_orderdate AS DATE)) AS INTEGER) AS c, last_day(o_orderdate) AS d, CAST(date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) + 719528 AS INTEGER) AS e, o_orderdate + INTERVAL 90 MINUTE AS f, date_sub('day', TIMESTAMP '1995-01-01', o_orderdate) AS g FROM orders",
)
statement("date_formats", "SELECT event_id, date_format(ts, '%Y-%m-%d %H:%i:%s') AS a, date_format(ts, '%d/%m/%y') AS b, dayname(ts) AS c, monthname(ts) AS d FROM events", "SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS a, strftime(ts, '%d/%m/%y') AS b, dayname(ts) AS c, monthname(ts) AS d FROM events")
statement("date_periods", "SELECT o_orderkey, period_add(199801, o_custkey % 30) AS a, period_diff(199801, 199611) AS b, makedate(1998, 60) AS c, time_to_sec(o_orderdate) AS d FROM orders", "SELECT o_orderkey, CAST(((1998 * 12 + o_custkey % 30) // 12) * 100 + (1998 * 12 + o_custkey % 30) % 12 + 1 AS BIGINT) AS a, CAST(14 AS BIGINT) AS b, DATE '1998-03-01' AS c, CAST(hour(o_orderdate) * 3600 + minute(o_orderdate) * 60 + second(o_orderdate) AS BIGINT) AS d FROM orders")
statement("ctl_flow", "SELECT p_partkey, CASE WHEN p_size < 10 THEN 'small' WHEN p_size < 30 THEN 'mid' ELSE 'big' END AS a, if(p_size > 25, 1, 0) AS b, ifnull(nullif(p_size, 5), -1) AS c, coalesce(NULL, p_brand) AS d, CASE p_type WHEN 'ECONOMY' THEN 1 END AS e, greatest(p_size, 20) AS f, least(p_size, 20) AS g, isnull(nullif(p_size, 5)) AS h FROM part", "SELECT p_partkey, CASE WHEN p_size < 10 THEN 'small' WHEN p_size < 30 THEN 'mid' ELSE 'big' END AS a, CASE WHEN p_size > 25 THEN 1 ELSE 0 END AS b, ifnull(nullif(p_size, 5), -1) AS c, p_brand AS d, CASE p_type WHEN 'ECONOMY' THEN 1 END AS e, greatest(p_size, 20) AS f, least(p_size, 20) AS g, p_size = 5 AS h FROM part")
statement("cast_numbers", "SELECT o_orderkey, cast(o_totalprice AS signed) AS a, cast(o_custkey AS char(20)) AS b, cast('12' AS signed) AS c, cast(o_totalprice AS decimal(12, 1)) AS d, cast(o_custkey AS double) AS e FROM orders", "SELECT o_orderkey, CAST(round(o_totalprice) AS BIGINT) AS a, CAST(o_custkey AS VARCHAR) AS b, CAST(12 AS BIGINT) AS c, CAST(o_totalprice AS DECIMAL(12, 1)) AS d, CAST(o_custkey AS DOUBLE) AS e FROM orders")


@frame(
    "SELECT o_orderkey, CAST(strftime(o_orderdate, '%Y%m%d%H%M%S') AS BIGINT) AS packed, o_orderdate AS back, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS txt, o_orderdate AS parsed, CAST(o_totalprice AS DECIMAL(12, 2)) AS dec, CAST(round(o_totalprice) AS BIGINT) AS whole FROM orders"
)
def cast_matrix(spark, sf_dir):
    d, p = F.col("o_orderdate"), F.col("o_totalprice")
    packed, txt = casts.cast(d, "date", "int"), casts.cast(d, "date", "string")
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", packed.alias("packed"), casts.cast(packed, "int", "date").alias("back"), txt.alias("txt"),
        casts.cast(txt, "string", "date").alias("parsed"), casts.cast(p, "real", "decimal").cast("decimal(12,2)").alias("dec"), casts.cast(p, "real", "int").alias("whole"),
    )


@frame(
    "SELECT event_id, CASE WHEN regexp_full_match(props, '.*') THEN CAST(regexp_extract(props, '\"k\": *([0-9]+)', 1) AS BIGINT) END AS k, CAST(hour(ts) * 10000 + minute(ts) * 100 + CAST(floor(second(ts)) AS BIGINT) AS BIGINT) AS packed_time FROM events"
)
def cast_time_and_json(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    part = temporal.time_part(F.date_trunc("second", F.col("ts")))
    return events.select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"), casts.cast(part, "time", "int").alias("packed_time"))


@frame("SELECT c_custkey, '*' || upper(sha1(unhex(sha1(c_name)))) AS p, TRUE AS aes, TRUE AS zip FROM customer")
def crypto_round_trips(spark, sf_dir):
    n = F.col("c_name")
    return table(spark, sf_dir, "customer").select(
        "c_custkey", crypto.password(n).alias("p"), (crypto.aes_decrypt(crypto.aes_encrypt(n, "key"), "key").cast("string") == n).alias("aes"),
        (numeric.uncompress(numeric.compress(n)).cast("string") == n).alias("zip"),
    )


@frame(
    "SELECT n_nationkey, '''' || n_name || '''' AS q, CASE WHEN n_nationkey % 4 = 0 THEN 'N,N,N' WHEN n_nationkey % 4 = 1 THEN 'Y,N,N' WHEN n_nationkey % 4 = 2 THEN 'N,Y,N' ELSE 'Y,Y,N' END AS e, '01:02:03' AS t FROM nation"
)
def str_quote_export(spark, sf_dir):
    k = F.col("n_nationkey")
    return table(spark, sf_dir, "nation").select(
        "n_nationkey", text.quote(F.col("n_name")).alias("q"), text.export_set(k % 4, F.lit("Y"), F.lit("N"), F.lit(","), F.lit(3)).alias("e"), temporal.time_text(F.lit(3723)).alias("t")
    )


# Statistics
@frame(
    " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, count(*) AS row_count, count(*) FILTER ({c} IS NULL) AS null_count, count(DISTINCT {c}) AS distinct_count, CAST(min({c}) AS VARCHAR) AS min_value, CAST(max({c}) AS VARCHAR) AS max_value FROM lineitem"
        for c in ("l_orderkey", "l_linenumber", "l_returnflag")
    )
)
def stats_column_profile(spark, sf_dir):
    return statistics.profile(table(spark, sf_dir, "lineitem"), ("l_orderkey", "l_linenumber", "l_returnflag"), exact=True).drop("total_size")


@frame(
    """WITH c AS (SELECT o_custkey AS v, count(*) AS c FROM orders GROUP BY 1), r AS (SELECT v, c, sum(c) OVER (ORDER BY v) AS upto, sum(c) OVER () AS t FROM c)
SELECT CAST(floor((upto - c) * 32 / t) AS INTEGER) AS bucket, min(v) AS lower, max(v) AS upper, CAST(max(upto) AS BIGINT) AS cumulative, arg_max(c, v) AS repeats FROM r GROUP BY 1"""
)
def stats_histogram_equidepth(spark, sf_dir):
    return statistics.histogram(table(spark, sf_dir, "orders"), "o_custkey", 32)


@frame("SELECT o_custkey AS value, count(*) AS count FROM orders GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20")
def stats_topn_values(spark, sf_dir):
    return statistics.top_values(table(spark, sf_dir, "orders"), "o_custkey", 20)


@frame("SELECT TRUE AS close")
def stats_ndv_approx(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    both = orders.agg(F.count_distinct("o_custkey").alias("n"), F.hll_sketch_estimate(statistics.distinct_sketch("o_custkey")).alias("hll"), F.approx_count_distinct("o_custkey").alias("hpp"))
    return both.select(((F.abs(F.col("hll") / F.col("n") - 1) < 0.1) & (F.abs(F.col("hpp") / F.col("n") - 1) < 0.15)).alias("close"))


@frame("SELECT c_mktsegment, min(c_custkey) AS sample_key, TRUE AS inside FROM customer GROUP BY c_mktsegment")
def stats_sample_collector(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    every = statistics.analyze(c, ("c_custkey", "c_mktsegment"), sample_rows=1_000_000)["sample"]
    return every.groupBy("c_mktsegment").agg(F.min("c_custkey").alias("sample_key"), (F.count("*") > 0).alias("inside"))


# Changes
@frame("SELECT n_nationkey, n_name, n_regionkey FROM nation UNION ALL SELECT 100, 'ATLANTIS', 0 UNION ALL SELECT 101, 'MU', NULL")
def dml_insert(spark, sf_dir):
    rows = spark.createDataFrame([(100, "ATLANTIS", 0), (101, "MU", None)], "n_nationkey int, n_name string, n_regionkey int")
    return dml.insert(table(spark, sf_dir, "nation"), rows)


@frame("SELECT n_nationkey, CASE WHEN n_nationkey IN (3, 4) THEN 'NEW_' || n_nationkey ELSE n_name END AS n_name, CASE WHEN n_nationkey IN (3, 4) THEN n_regionkey + 10 ELSE n_regionkey END AS n_regionkey FROM nation UNION ALL SELECT 200, 'NEW_200', 10")
def dml_upsert(spark, sf_dir):
    nation = table(spark, sf_dir, "nation")
    rows = spark.createDataFrame([(k, f"NEW_{k}", 10) for k in (3, 4, 200)], "n_nationkey int, n_name string, n_regionkey int")
    return dml.upsert(nation, rows, ("n_nationkey",), {"n_name": lambda was, new: new("n_name"), "n_regionkey": lambda was, new: was("n_regionkey") + new("n_regionkey")})


@frame("SELECT s_suppkey, s_name, s_nationkey, CASE WHEN s_acctbal < 1000 THEN s_acctbal + 500 ELSE s_acctbal END AS s_acctbal FROM supplier")
def dml_update(spark, sf_dir):
    return dml.update(table(spark, sf_dir, "supplier"), {"s_acctbal": F.col("s_acctbal") + 500}, F.col("s_acctbal") < 1000)


@frame("SELECT * FROM supplier WHERE NOT coalesce(s_acctbal < 1000, FALSE)")
def dml_delete(spark, sf_dir):
    return dml.delete(table(spark, sf_dir, "supplier"), F.col("s_acctbal") < 1000)


@frame("SELECT * FROM supplier WHERE s_suppkey NOT IN (SELECT s_suppkey FROM supplier WHERE s_nationkey > 5 ORDER BY s_acctbal, s_suppkey LIMIT 7)")
def dml_delete_limit(spark, sf_dir):
    return dml.delete(table(spark, sf_dir, "supplier"), F.col("s_nationkey") > 5, ("s_suppkey",), [F.col("s_acctbal").asc()], 7)


@frame("SELECT s_suppkey, s_name, CASE WHEN s_suppkey IN (SELECT s_suppkey FROM supplier WHERE s_nationkey > 5 ORDER BY s_acctbal DESC, s_suppkey LIMIT 4) THEN 0 ELSE s_nationkey END AS s_nationkey, s_acctbal FROM supplier")
def dml_update_limit(spark, sf_dir):
    return dml.update(table(spark, sf_dir, "supplier"), {"s_nationkey": F.lit(0)}, F.col("s_nationkey") > 5, ("s_suppkey",), [F.col("s_acctbal").desc()], 4)


@frame("SELECT r_regionkey, CASE r_regionkey WHEN 1 THEN 'x' WHEN 2 THEN 'y' ELSE r_name END AS r_name FROM region WHERE r_regionkey <> 4 UNION ALL SELECT 9, 'nine'")
def dml_batch(spark, sf_dir):
    engine = Engine(spark, Catalog(spark).load(sf_dir, ("region",)))
    engine.execute("update region set r_name = 'x' where r_regionkey = 1; update region set r_name = 'y' where r_regionkey = 2; delete from region where r_regionkey = 4; insert into region values (9, 'nine')")
    return engine.execute("select * from region")


# Statements about tables
@frame("SELECT * FROM (VALUES ('r_regionkey', 'int', 'NO', 'PRI'), ('r_name', 'varchar(255)', 'YES', '')) AS t(Field, Type, \"Null\", Key)")
def meta_describe(spark, sf_dir):
    return Engine(spark, Catalog(spark).load(sf_dir, ("region",))).execute("desc region").select("Field", "Type", "Null", "Key")


@frame("SELECT * FROM (VALUES ('nation'), ('region')) AS t(Tables_in_test)")
def meta_show_tables(spark, sf_dir):
    return Engine(spark, Catalog(spark).load(sf_dir, ("region", "nation"))).execute("show tables")


@frame("SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderkey IN (3, 11)")
def meta_prepared(spark, sf_dir):
    return Engine(spark, Catalog(spark).load(sf_dir, ("orders",))).prepare("select o_orderkey, o_orderstatus from orders where o_orderkey = ? or o_orderkey = ?").execute(3, 11)


@frame("SELECT 7 AS v, 'test' AS d")
def meta_variables(spark, sf_dir):
    engine = Engine(spark)
    engine.execute("set @x = 3 + 4")
    return engine.execute("select @x as v, database() as d")


# Extensions
@frame("SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_mktsegment = 'MACHINERY'")
def ext_join_inner(spark, sf_dir):
    c = table(spark, sf_dir, "customer").where("c_mktsegment = 'MACHINERY'")
    return table(spark, sf_dir, "orders").join(c, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "c_name")


@frame("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def ext_join_anti(spark, sf_dir):
    return table(spark, sf_dir, "customer").join(table(spark, sf_dir, "orders"), F.col("o_custkey") == F.col("c_custkey"), "left_anti").select("c_custkey")


@frame("SELECT c_custkey, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey")
def ext_join_left(spark, sf_dir):
    n = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count("o_orderkey").alias("n"))
    return table(spark, sf_dir, "customer").join(n, F.col("o_custkey") == F.col("c_custkey"), "left").select("c_custkey", F.coalesce("n", F.lit(0)).alias("n"))


@frame("SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier EXCEPT SELECT 3")
def ext_setops(spark, sf_dir):
    a = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("k"))
    return a.intersect(table(spark, sf_dir, "supplier").select("s_nationkey")).exceptAll(spark.range(3, 4).select(F.col("id").cast("int")))


@frame("SELECT o_orderkey, o_custkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rn FROM orders) WHERE rn <= 2")
def ext_window_topk(spark, sf_dir):
    w = Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")
    return table(spark, sf_dir, "orders").withColumn("rn", F.row_number().over(w)).where("rn <= 2").select("o_orderkey", "o_custkey")


@frame("SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)")
def ext_rollup(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").rollup("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"))


@frame("SELECT time_bucket(INTERVAL '1 hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 2) AS s FROM events GROUP BY 1, 2")
def ext_events_tumbling(spark, sf_dir):
    return windows.tumbling(table(spark, sf_dir, "events"), "ts", "1 hour", ["event_type"], {"n": F.count("*"), "s": F.round(F.sum("value"), 2)})


@frame(
    """WITH d AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS b, event_id FROM events),
s AS (SELECT user_id, ts, sum(b) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM d)
SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, k"""
)
def ext_events_sessions(spark, sf_dir):
    return windows.sessions(table(spark, sf_dir, "events"), "ts", "30 minutes", ["user_id"], {"n": F.count("*")})


@frame("SELECT user_id, event_id AS last_event, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1")
def ext_cdc_latest(spark, sf_dir):
    log = table(spark, sf_dir, "events").select("user_id", F.col("event_id").alias("last_event"), "event_type", "ts", F.lit("upsert").alias("op"))
    return cdc.latest(log, ("user_id",), ("ts", "last_event")).select("user_id", "last_event", "event_type")


from . import registry_more  # noqa: E402, F401  (registers more queries)
