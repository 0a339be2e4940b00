"""Golden queries over the people table, and the statements around them."""

import time
from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from tabulon.plans.engine import Engine
from tabulon.plans.parser import SqlError
from tabulon.sources.tables import Catalog

ROWS = [
    (1, "Tom", 28, "one", 85, date(2017, 12, 31), datetime(2017, 12, 31, 1, 0, 15)),
    (2, "Jack", 32, "two", 91, date(2018, 1, 1), datetime(2018, 1, 1, 2, 0, 15)),
    (3, "Mary", 27, "one", 89, date(2019, 2, 20), datetime(2019, 2, 20, 12, 0, 15)),
    (4, "Suzy", 31, "three", 92, date(1997, 12, 11), datetime(1997, 12, 11, 15, 0, 15)),
    (5, "Kate", 28, "two", 99, date(1990, 1, 31), datetime(1990, 1, 31, 23, 0, 15)),
    (6, "Luke", 31, "one", 94, date(2050, 12, 31), datetime(2050, 12, 31, 23, 59, 59)),
]


@pytest.fixture
def engine(spark):
    catalog = Catalog(spark)
    df = spark.createDataFrame(ROWS, "id long, name string, age int, class string, score int, t_date date, t_datetime timestamp_ntz")
    catalog.register("t", df, ("id",))
    return Engine(spark, catalog)


def rows(engine, sql, *params):
    return [tuple(r) for r in engine.execute(sql, params).collect()]


@pytest.mark.parametrize(
    ("sql", "want"),
    [
        ("select 1 as a,2+6 as b,'test' as t", [(1, 8, "test")]),
        ("select name from t order by id limit 2", [("Tom",), ("Jack",)]),
        ("select age from t limit 2,0", []),
        ("select name,age from t order by 2,1", [("Mary", 27), ("Kate", 28), ("Tom", 28), ("Luke", 31), ("Suzy", 31), ("Jack", 32)]),
        ("select name,age,score from t order by age, score desc limit 1,2", [("Kate", 28, 99), ("Tom", 28, 85)]),
        ("select name,age from t where id between 2 and 4 order by id", [("Jack", 32), ("Mary", 27), ("Suzy", 31)]),
        ("select count(1),name,sum(age) from t where id=123", [(0, None, None)]),
        ("select count(1+1) from t", [(6,)]),
        ("select 15%7", [(1,)]),
        ("select name from test.t x where x.age > 30 && x.class = 'one'", [("Luke",)]),
        ("select name from t where age = 27 || score = 99 order by id", [("Mary",), ("Kate",)]),
        ("select class c, count(*) n from t group by c having n > 1 order by n desc, c", [("one", 3), ("two", 2)]),
        ("select age + 1 from t where name = 'Tom'", [(29,)]),
        ("select max(score)-1, min(name), avg(score) from t", [(98, "Jack", 550 / 6)]),
        ("select count(distinct class), sum(distinct age), count(distinct age) from t", [(3, 118, 4)]),
        ("select distinct class from t order by class desc limit 2", [("two",), ("three",)]),
        ("select class from t group by class order by max(score) desc", [("two",), ("one",), ("three",)]),
        ("select name from t where score in (91, 99) order by id", [("Jack",), ("Kate",)]),
        ("select name from t where score not in (91, 99) and not age between 28 and 40", [("Mary",)]),
        ("select name from t where t_date >= '2018-01-01' and t_datetime < '2020-01-01 00:00:00' order by id", [("Jack",), ("Mary",)]),
        ("select 7 DIV 2, -7 % 3, 5 ^ 1, 1 <=> null, null is null, 3 <> 4", [(3, -1, 4, False, True, True)]),
        ("select name from t where id = 3 or id = 5 order by id", [("Mary",), ("Kate",)]),
        ("select t.*, 1 from t where id = 1", [(*ROWS[0], 1)]),
        ("select name, case when age > 30 then 'old' else 'young' end g from t where id in (1,2) order by id", [("Tom", "young"), ("Jack", "old")]),
        ("select database(), if(1 > 2, 'a', 'b'), ifnull(null, 3), coalesce(null, null, 4)", [("test", "b", 3, 4)]),
        ("select name from t use index (a) where 0", []),
        ("select name from t where name like 'K%' or name regexp '^L.k' order by name", [("Kate",), ("Luke",)]),
        ("select group_concat(distinct class) from t", [("one,three,two",)]),
        ("select date_format(t_datetime, '%Y/%m/%d %H:%i') from t where id = 6", [("2050/12/31 23:59",)]),
        ("select date_add('2020-01-31', interval 1 month), '2020-03-01' - interval 1 day", [(date(2020, 2, 29), date(2020, 2, 29))]),
    ],
)
def test_golden(engine, sql, want):
    assert rows(engine, sql) == want


def test_first_value_of_columns_that_are_not_grouped(engine):
    got = engine.execute("select sum(age),id,name from t group by name having min(score)>=20")
    assert got.columns == ["sum(age)", "id", "name"]
    assert sorted(map(tuple, got.collect())) == sorted((r[2], r[0], r[1]) for r in ROWS)


def test_division_is_a_decimal_of_four_more_digits(engine):
    assert str(rows(engine, "select 6/3")[0][0]) == "2.0000"
    assert str(rows(engine, "select 2/3")[0][0]) == "0.6667"
    assert rows(engine, "select 1/0, 1 % 0, 1.5e0/0") == [(None, None, None)]


def test_prepared_statements_and_variables(engine):
    p = engine.prepare("select name from t where id = ? or age = ? order by id limit ?")
    assert [r.name for r in p.execute(1, 31, 2).collect()] == ["Tom", "Suzy"]
    assert [r.name for r in p.execute(2, 0, 5).collect()] == ["Jack"]
    engine.execute("set @x = 2 + 3, session sql_mode = 'STRICT'")
    assert rows(engine, "select @x, @@sql_mode, @nothing") == [(5, "STRICT", None)]


@pytest.mark.parametrize(
    "sql",
    [
        "select * from t a join t b on a.id = b.id", "select * from t, u", "select 1 union select 2", "select * from (select 1) x", "select id from t where id in (select 1)",
        "update t set age = 1", "delete from t", "select nothing from t", "select row_number() over () from t", "select 1 limit -1", "select a from missing", "insert into t select 1", "select id from t order by 9", "selec 1",
    ],
)
def test_rejected(engine, sql):
    with pytest.raises((SqlError, KeyError)):
        engine.execute(sql).collect()


def test_point_get_is_a_pushed_filter(engine, spark, tmp_path):
    engine.catalog.table("t").data.write.parquet(str(tmp_path / "t"))
    engine.catalog.register("t", spark.read.parquet(str(tmp_path / "t")), ("id",))
    plan = "\n".join(r.plan for r in engine.execute("explain format = 'formatted' select name from t where id = 3 or id = 5").collect())
    assert "In(id, [3,5])" in plan and "ReadSchema: struct<id:bigint,name:string>" in plan


def test_changes(engine):
    run = lambda s: engine.execute(s).first().affected_rows
    assert run("insert into t(id, name, age) values (7, 'Ann', 20 + 1), (8, 'Bob', default)") == 2
    assert rows(engine, "select name, age, class from t where id > 6 order by id") == [("Ann", 21, None), ("Bob", None, None)]
    with pytest.raises(SqlError):
        engine.execute("insert into t(id, name) values (7, 'again')")
    assert run("insert into t(id, name, age) values (7, 'x', 5), (9, 'Cid', 1) on duplicate key update age = age + values(age)") == 2
    assert rows(engine, "select name, age from t where id in (7, 9) order by id") == [("Ann", 26), ("Cid", 1)]
    assert run("update t set age = age * 2, class = 'new' where id >= 8 order by id desc limit 1") == 1
    assert rows(engine, "select id, age, class from t where id >= 8 order by id") == [(8, None, None), (9, 2, "new")]
    assert run("delete from t where age < 27") == 2
    assert run("delete from t where age is null or age > 0 order by age desc, id limit 2") == 2
    assert rows(engine, "select id from t order by id") == [(1,), (3,), (5,), (6,), (8,)]
    engine.execute("update t set age = 1 where id = 1; update t set age = 2 where id = 3")
    assert rows(engine, "select sum(age) from t where id < 5") == [(3,)]


def test_definitions_and_checks(engine, spark, tmp_path):
    engine.catalog.root = str(tmp_path)
    e = engine.execute
    e("create table u (id bigint unsigned not null auto_increment, name varchar(5) default 'no', k tinyint, d decimal(10,2), at timestamp null on update current_timestamp, primary key (id), unique key uk (k))")
    e("insert into u(k, d) values (1, 1.005), (2, 7)")
    e("insert into u(id, name, k) values (10, 'x', 3)")
    e("insert into u(k) values (4)")
    assert rows(engine, "select id, name, k from u order by id") == [(1, "no", 1), (2, "no", 2), (10, "x", 3), (11, "no", 4)]
    for bad in ("insert into u(k) values (4)", "insert into u(k) values (128)", "insert into u(id, name) values (50, 'toolong')", "insert into u(id) values (-1)"):
        with pytest.raises(Exception):  # noqa: B017
            e(bad)
    e("update u set name = 'up' where id = 1")
    assert rows(engine, "select count(at) from u") == [(1,)]
    e("alter table u add column extra int default 5, drop column d, add index ix (name)")
    e("create unique index ux on u (name, k)")
    assert [r.Field for r in e("desc u").collect()] == ["id", "name", "k", "at", "extra"]
    assert {r.Key_name for r in e("show index from u").collect()} == {"PRIMARY", "uk", "ix", "ux"}
    assert rows(engine, "select extra from u where id = 1") == [(5,)]
    assert "AUTO_INCREMENT" in e("show create table u").first()[1]
    e("rename table u to v")
    assert {r[0] for r in e("show tables").collect()} == {"t", "v"}
    e("drop table v")
    e("create database other")
    e("use other")
    assert rows(engine, "select database()") == [("other",)]
    assert {r[0] for r in e("show databases like 'o%'").collect()} == {"other"}
    assert e("show variables where Variable_name = 'autocommit'").first().Value == "1"
    assert e("commit").first()[0] == 0


def test_insert_of_many_rows(engine):
    values = ", ".join(f"({i}, 'n{i}', {i % 90}, NULL, true, '2020-01-02', '2020-01-02 03:04:05.5')" for i in range(100, 1100))
    engine.execute(f"insert into t values {values}")
    assert rows(engine, "select count(*), sum(score), max(t_datetime) from t where id >= 100") == [(1000, 1000, datetime(2020, 1, 2, 3, 4, 5, 500000))]


def test_transactions(engine):
    e = engine.execute
    e("begin")
    e("update t set age = 0 where id = 1")
    assert rows(engine, "select age from t where id = 1") == [(0,)]
    e("rollback")
    assert rows(engine, "select age from t where id = 1") == [(28,)]
    e("start transaction")
    e("delete from t where id = 2")
    e("commit")
    e("rollback")
    assert rows(engine, "select count(*) from t") == [(5,)]
    e("set autocommit = 0")
    e("delete from t where id = 3")
    e("rollback")
    assert rows(engine, "select count(*) from t") == [(5,)]


def test_analyze(engine):
    got = {r.name: r for r in engine.execute("analyze table t").collect()}
    assert (got["age"].rowCount, got["age"].hNdv, got["age"].hNullCount, got["age"].isIndex) == (6, 4, 0, 0)
    assert got["PRIMARY"].isIndex == 1 and got["PRIMARY"].hNdv == 6
    assert len(got["age"]) == 15  # the name, and the fourteen figures
    assert engine.execute("show stats_buckets where column_name = 'age'").count() == 4
    assert engine.execute("show stats_buckets t").count() > 4
    assert engine.execute("show stats_meta").first().row_count == "6"
    assert engine.execute("show stats_histograms where column_name = 'age'").first().distinct_count == "4"
    engine.execute("drop stats t")
    assert engine.execute("show stats_meta").collect() == []


@pytest.fixture
def stamped(spark):
    e = Engine(spark)
    e.execute("create table s (id bigint unsigned primary key, name varchar(20), at timestamp null on update current_timestamp, made timestamp default current_timestamp, k int not null default 0, unique index ux (name)) auto_increment=0")
    return e


def test_rows_of_one_statement_are_folded_by_key(stamped):
    e = stamped.execute
    e("insert into s(id, name, k) values (1, 'a', 1), (1, 'b', 2), (2, 'c', 5), (1, 'd', 4) on duplicate key update k = k + values(k)")
    assert rows(stamped, "select id, name, k from s order by id") == [(1, "a", 7), (2, "c", 5)]


def test_every_unique_key_counts(stamped):
    e = stamped.execute
    e("insert into s(id, name, k) values (1, 'a', 1), (2, 'b', 2)")
    e("insert into s(id, name, k) values (9, 'a', 5), (2, 'zz', 7), (3, null, 1), (4, null, 1) on duplicate key update k = values(k) * 10")
    assert rows(stamped, "select id, name, k from s order by id") == [(1, "a", 50), (2, "b", 70), (3, None, 1), (4, None, 1)]
    for bad in ("insert into s(id, name) values (9, 'a')", "insert into s(id, name) values (5, 'q'), (6, 'q')", "insert into s(id, name) values (1, 'n') on duplicate key update name = 'b'"):
        with pytest.raises(SqlError):
            e(bad)
    # A row added by a statement is met by its later rows, by either key.
    e("insert into s(id, name, k) values (7, 'x', 1), (8, 'x', 2), (7, 'y', 3) on duplicate key update k = k * 10 + values(k)")
    assert rows(stamped, "select id, name, k from s where id > 4") == [(7, "x", 123)]


def test_updates_are_checked(stamped):
    e = stamped.execute
    e("insert into s(id, name) values (1, 'a'), (2, 'b')")
    for bad in ("update s set id = 5 where id > 0", "update s set name = 'b' where id = 1", "update s set k = null where id = 1", "update s set id = null where id = 1"):
        with pytest.raises(SqlError):
            e(bad)
    assert rows(stamped, "select id, name, k from s order by id") == [(1, "a", 0), (2, "b", 0)]
    e("update s set id = id + 1 where id > 0")
    assert rows(stamped, "select id from s order by id") == [(2,), (3,)]


def test_a_statement_has_one_time(stamped):
    e = stamped.execute
    e("insert into s(id) values (1), (2)")
    first = rows(stamped, "select id, at, made from s order by id")
    assert first[0][1] is None and first[0][2] == first[1][2] is not None
    e("update s set name = 'a' where id = 1")
    once = rows(stamped, "select at from s where id = 1")
    time.sleep(1.1)
    assert rows(stamped, "select at from s where id = 1") == once != [(None,)]
    assert rows(stamped, "select id, made from s order by id") == [(i, m) for i, _, m in first]
    e("insert into s(id) values (2) on duplicate key update name = 'z'")
    twice = rows(stamped, "select at from s where id = 2")
    assert twice != [(None,)] and twice == rows(stamped, "select at from s where id = 2")


def test_numbers_go_on_within_a_statement(spark):
    engine = Engine(spark)
    engine.execute("create table a (id bigint not null auto_increment primary key, v int)")
    engine.execute("insert into a(id, v) values (null, 1), (10, 2), (null, 3)")
    for v in (4, 5):
        engine.execute(f"insert into a(v) values ({v})")
    assert rows(engine, "select id, v from a order by id") == [(1, 1), (10, 2), (11, 3), (12, 4), (13, 5)]
    assert "Join" not in engine.catalog.table("a").data._jdf.queryExecution().toString()


@pytest.mark.parametrize(
    ("sql", "want"),
    [
        ("select '5abc' + 1, '1.5e1x' * 2, 'abc' - 1, -'7up'", [(6.0, 30.0, -1.0, -7)]),
        ("select '5abc' = 5, 3 < '20', 'x' = 0, null = '1'", [(True, True, True, None)]),
        ("select id from t where id = '3'", [(3,)]),
        ("select id from t where id in ('1', '2x') order by id", [(1,), (2,)]),
        ("select count(*) from t where name", [(0,)]),
        ("select sum(concat(age, 'y')) from t where id < 3", [(60.0,)]),
        ("select id from t where id between '2' and '3z' order by id", [(2,), (3,)]),
    ],
)
def test_texts_among_numbers(engine, sql, want):
    assert rows(engine, sql) == want


@pytest.mark.parametrize("sql", ["show tables garbage trailing", "show databases x", "desc t t t", "use test now", "drop table t u", "analyze table t t", "select id from t;;x", "rename table t to u v", "commit it", "update t set nothing = 1 where id = 1", "insert into t(nothing) values (1)", "drop user nobody"])
def test_words_left_over_and_unknown_names_are_errors(engine, sql):
    with pytest.raises(SqlError):
        engine.execute(sql)
    assert rows(engine, "select count(*) from t") == [(6,)]


def test_explain_rows(engine):
    got = engine.execute("explain select class, count(*) from t where age > 27 group by class").collect()
    assert list(got[0].asDict()) == ["op", "count", "task", "operator_info"]
    assert got[0].op == "Aggregate" and got[-1].task == "db"
    assert engine.execute("explain analyze select id from t where age > 27").first()["count"] == "5"
    assert engine.execute("desc select 1").count() >= 1


def test_information(engine):
    e = engine.execute
    assert [tuple(r) for r in e("show tables info").collect()] == [("1", "1", "t")]
    assert [tuple(r) for r in e("show databases info").collect()] == [("1", "test")]
    assert e("show status like 'Quest%'").first().Value == "3"
    e("create user 'ann'@'%' identified by 'x'")
    e("grant select, insert on test.* to 'ann'@'%'")
    assert [r[0] for r in e("show grants for 'ann'").collect()] == ["GRANT USAGE ON *.* TO 'ann'@'%'", "GRANT INSERT, SELECT ON test.* TO 'ann'@'%'"]
    e("revoke insert on test.* from 'ann'@'%'")
    assert "GRANT SELECT ON test.*" in e("show grants for 'ann'").collect()[1][0]
    e("drop user 'ann'")
    assert e("show grants").first()[0] == "GRANT ALL PRIVILEGES ON *.* TO 'root'@'%'"


def test_prepared_statements_are_parsed_once(engine, monkeypatch):
    p = engine.prepare("select name from t where id = ?")
    monkeypatch.setattr("tabulon.plans.engine.Parser", None)
    assert [p.execute(i).first().name for i in (1, 2)] == ["Tom", "Jack"]


def test_explain_rows_keep_their_order(engine):
    got = engine.execute("explain analyze select id from t where age > 27")
    assert got.count() > 1 and got.select(F.spark_partition_id()).distinct().count() == 1
    assert "Exchange" not in got.limit(1).where("count = '5'")._jdf.queryExecution().executedPlan().toString()
