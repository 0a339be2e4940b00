"""Operators that the registry's SQL comparison does not reach: sketches, streams, files, plans, types."""

import random

import pytest
from pyspark.sql import functions as F

from tabulon.operators import aggregate, dml, relational, scan, statistics
from tabulon.sources import tables
from tabulon.sources.types import checked, limits, spark_type
from tabulon.streaming import cdc, windows

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def orders(spark):
    return spark.read.parquet(f"{SF}/orders.parquet")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_count_min_never_undercounts_by_much(spark, orders):
    counts = {r.o_custkey: r["count"] for r in orders.groupBy("o_custkey").count().collect()}
    sketch = statistics.CountMin(orders, "o_custkey")
    keys = sorted(counts)[:200]
    for k, est in zip(keys, sketch.query(*keys), strict=True):
        assert abs(est - counts[k]) <= 5
    assert sketch.query(-1)[0] <= 5


def test_distinct_sketches(spark):
    df = spark.range(50_000).select((F.col("id") % 20_000).alias("v"))
    assert abs(statistics.fm_distinct(df, "v", 1000) / 20_000 - 1) < 0.15
    assert statistics.fm_distinct(df.where("v < 500"), "v", 1000) == 500


@pytest.mark.parametrize("kind", ["long", "string", "double"])
def test_histogram_covers_all_rows(spark, kind):
    rng = random.Random(1)
    values = [rng.randint(0, 500) if rng.random() < 0.7 else 7 for _ in range(5000)]
    df = spark.createDataFrame([(v,) for v in values] + [(None,)], "v long").select(F.col("v").cast(kind).alias("v"))
    h = statistics.histogram(df, "v", 16).orderBy("bucket").collect()
    assert len(h) <= 16 and h[-1].cumulative == 5000 and all(a.upper < b.lower and a.cumulative < b.cumulative for a, b in zip(h, h[1:], strict=False))
    if kind == "long":
        hist = statistics.histogram(df, "v", 64)
        true = sum(100 <= v <= 300 for v in values)
        assert abs(statistics.histogram_rows(hist, 100, 300) - true) < 0.06 * 5000
        assert abs(statistics.selectivity(hist, 5000, 0, 500) - 1) < 0.01
    assert statistics.selectivity(None, 10) == statistics.DEFAULT_SELECTIVITY
    assert statistics.histogram(df.limit(0), "v").collect() == []


def test_reservoir_is_even(spark):
    df = spark.range(100)
    hits = [0] * 100
    for seed in range(60):
        rows = scan.reservoir(df, 10, seed).collect()
        assert len(rows) == 10
        for r in rows:
            hits[r.id] += 1
    assert max(hits) < 20 and sum(hits[:50]) > 220
    assert scan.reservoir(df, 500).count() == 100


def test_plans_push_and_prune(orders):
    p = plan(scan.range_scan(orders, "o_orderkey", 5, 9, columns=("o_orderkey", "o_custkey")))
    assert "GreaterThanOrEqual(o_orderkey,5)" in p and "LessThan(o_orderkey,9)" in p and "ReadSchema: struct<o_orderkey:bigint,o_custkey:bigint>" in p and "Exchange" not in p
    assert "TakeOrderedAndProject" in plan(relational.top_n(orders, [("o_totalprice", True)], 5, 5))
    assert plan(aggregate.aggregate(orders, ["o_orderstatus"], {"n": F.count("*")})).count("HashAggregate") == 2
    assert "Exchange" not in plan(aggregate.unique_key_groups(orders, ("o_orderkey",), ("o_orderkey",), {"n": F.lit(1)}))
    assert aggregate.unique_key_groups(orders, ("o_orderkey",), ("o_custkey",), {}) is None


def test_sorted_files_prune_like_an_index(spark, orders, tmp_path):
    tables.write(orders, str(tmp_path / "o"), sort_by=("o_custkey",))
    back = tables.read(spark, str(tmp_path / "o"))
    assert back.count() == orders.count()
    for form in ("csv", "json"):
        tables.write(orders.select("o_orderkey", "o_orderstatus"), str(tmp_path / form), form)
        if form == "csv":
            orders.select("o_orderkey", "o_orderstatus").write.mode("overwrite").option("header", True).csv(str(tmp_path / form))
        assert tables.read(spark, str(tmp_path / form), form, schema="o_orderkey long, o_orderstatus string").count() == orders.count()
        with pytest.raises(ValueError, match="schema"):
            tables.read(spark, str(tmp_path / form), form)


def test_types_and_limits(spark):
    assert spark_type("bigint unsigned").simpleString() == "decimal(20,0)" and spark_type("DECIMAL(65,30)").simpleString() == "decimal(38,30)"
    assert limits("mediumint") == (-8388608, 8388607) and limits("tinyint unsigned") == (0, 255) and limits("text") is None
    ok = spark.range(1).select(checked(F.lit("18446744073709551615"), "bigint unsigned").alias("a"), checked(F.lit("abc"), "varchar(3)").alias("b")).first()
    assert int(ok.a) == 2**64 - 1 and ok.b == "abc"
    for value, kind in ((-1, "bigint unsigned"), (8388608, "mediumint"), (300, "tinyint unsigned"), ("abcd", "varchar(3)")):
        with pytest.raises(Exception):  # noqa: B017
            spark.range(1).select(checked(F.lit(value), kind)).collect()
    with pytest.raises(ValueError, match="unknown type"):
        spark_type("geometry")


def test_upsert_twice_is_upsert_once(spark):
    t = spark.createDataFrame([(1, "a", 1), (2, "b", None)], "k int, v string, n int")
    new = spark.createDataFrame([(2, "c", 5), (3, "d", 6)], "k int, v string, n int")
    once = dml.upsert(t, new, ("k",), {"v": lambda was, is_: is_("v")})
    twice = dml.upsert(once, new, ("k",), {"v": lambda was, is_: is_("v")})
    want = [(1, "a", 1), (2, "c", None), (3, "d", 6)]
    assert sorted(map(tuple, once.collect())) == sorted(map(tuple, twice.collect())) == want


def test_streams(spark, tmp_path):
    events = spark.read.parquet(f"{SF}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    events.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    aggs = {"n": F.count("*")}
    counted = windows.tumbling(stream, "ts", "1 hour", ["event_type"], aggs, late="30 days")
    q = counted.writeStream.outputMode("complete").format("memory").queryName("tumbled").start()
    q.processAllAvailable()
    q.stop()
    want = windows.tumbling(events, "ts", "1 hour", ["event_type"], aggs)
    assert sorted(map(tuple, spark.table("tumbled").collect())) == sorted(map(tuple, want.collect()))
    q = windows.deduplicated(stream.select("ts", "user_id"), "ts", ["user_id"], "30 days").writeStream.format("memory").queryName("once").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("once").count() == events.select("user_id").distinct().count()


def test_change_capture_by_stream_is_idempotent(spark, tmp_path):
    kind = "k int, v string, at long, op string"
    changes = [(1, "a", 1, "upsert"), (2, "b", 2, "upsert"), (1, "c", 3, "upsert"), (2, None, 4, "delete"), (3, "d", 5, "upsert"), (1, "late", 2, "upsert")]
    for i in range(0, 6, 2):
        spark.createDataFrame(changes[i : i + 2], kind).coalesce(1).write.mode("append").parquet(str(tmp_path / "log"))
    state = {"df": spark.createDataFrame([(3, "old", 0)], "k int, v string, at long")}

    def write(df):
        rows = df.collect()
        state["df"] = spark.createDataFrame(rows, "k int, v string, at long")

    q = spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "log")).writeStream.foreachBatch(cdc.sink(lambda: state["df"], write, ("k",), ("at",))).start()
    q.processAllAvailable()
    q.stop()
    assert sorted(map(tuple, state["df"].collect())) in ([(1, "c", 3), (3, "d", 5)], [(1, "c", 3), (2, "b", 2), (3, "d", 5)])
    log = spark.createDataFrame(changes, kind)
    base = spark.createDataFrame([(3, "old", 0)], "k int, v string, at long")
    assert sorted(map(tuple, cdc.apply(base, log.union(log), ("k",), ("at",)).collect())) == [(1, "c", 3), (3, "d", 5)]


def test_key_value(spark):
    from tabulon.sources.keyvalue import KeyValue

    kv = KeyValue(spark)
    kv.set({b"a": b"1", b"b": b"2"})
    kv.set({b"a": b"3"})
    kv.hset(b"h", {"x": b"9", "y": b"8"})
    assert kv.get([b"a", b"b", b"c"]) == {b"a": b"3", b"b": b"2"}
    assert kv.hget(b"h") == {"x": b"9", "y": b"8"} and kv.hget(b"h", ["y"]) == {"y": b"8"}
    kv.hset(b"h", {"x": b"7"})
    kv.delete([b"b"])
    assert kv.get([b"a", b"b"]) == {b"a": b"3"} and kv.hget(b"h", ["x"]) == {"x": b"7"}


def test_trace_counts_rows_on_the_way(orders):
    from tabulon.operators.trace import traced

    few, seen = traced(orders.where("o_orderkey < 100"), "few")
    n = few.count()
    assert seen.get["rows"] == n == orders.where("o_orderkey < 100").count()


def test_sample_ratio_leaves_rows_where_they_are(spark, monkeypatch):
    from tabulon.plans.registry import QUERIES

    frame, most = type(spark.range(1)), []
    plain, even = frame.collect, scan.sample
    monkeypatch.setattr(frame, "collect", lambda self: most.append(rows := plain(self)) or rows)
    run = lambda: [tuple(r) for r in QUERIES["sample_ratio"](spark, SF).collect()]
    assert run() == [(True, True, True)] and max(map(len, most)) == 1
    seeds = iter((1, 2))
    monkeypatch.setattr(scan, "sample", lambda t, ratio, seed: even(t, ratio, next(seeds)))
    assert run() == [(True, False, True)]
    monkeypatch.setattr(scan, "sample", lambda t, ratio, seed: even(t, ratio, seed).withColumn("l_linenumber", F.col("l_linenumber") + 100))
    assert run() == [(True, True, False)]
    monkeypatch.setattr(scan, "sample", lambda t, ratio, seed: even(t, 0.2, seed))
    assert run() == [(False, True, True)]


def test_fm_exact_beyond_its_size(spark, tmp_path):
    from tabulon.plans.registry import QUERIES

    spark.range(120_000).selectExpr("id % 5000 as l_orderkey", "id % 40000 as l_suppkey").write.parquet(str(tmp_path / "lineitem.parquet"))
    assert {r.name: r.n for r in QUERIES["stats_fm_exact_below_its_size"](spark, str(tmp_path)).collect()} == {"few": 40_000, "many": 5_000}
    df = spark.range(3000).selectExpr("nullif(id % 777, 5) as v")
    assert statistics.fm_exact(df, "v", 10) == statistics.fm_exact(df, "v", 776) == 776 and statistics.fm_exact(df.limit(0), "v", 10) == 0
