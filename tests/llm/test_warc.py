import gzip
import random

import pytest
from pyspark.sql import functions as F

from oracle import compare
from tabulon.llm import warc

SCHEMA = "record_id long, url string, ts long, kind string, etag string, last_modified string, digest string, headers map<string,string>, canonical_url string"


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_oracle(spark, sf):
    compare(spark, "op8_warc", f"/root/testdata/{sf}")


def test_canonical_urls(spark):
    pairs = [
        ("http://WWW.Example.com/a/?b=2&a=1#x", "example.com/a?a=1&b=2"),
        ("https://user@example.com:443/", "example.com"),
        ("http://example.com:8080/A?utm_source=q", "example.com:8080/A"),
        ("m.example.com./x", "m.example.com/x"),
        ("http:///path", None),
        ("", None),
        (None, None),
    ]
    got = spark.createDataFrame(pairs, "u string, want string").select(warc.canonical_url(F.col("u")), "want").collect()
    assert all(a == b for a, b in got), got


def test_as_of_join_matches_brute_force(spark):
    rng = random.Random(9)
    rows = []
    for i in range(1500):
        url = None if rng.random() < 0.03 else "http://hot.example/" if rng.random() < 0.4 else f"http://h{rng.randint(0, 60)}.example/{rng.randint(0, 2)}/"
        kind = rng.choice(["response", "revisit"])
        rows.append((i, url, rng.randint(0, 900), kind, rng.choice([None, '"a"', 'W/"a"', '"b"']), rng.choice([None, "t1", "t2"]), rng.choice([None, "d"]), rng.choice([None, {"Date": str(i), "X": "1", "ETag": "e"}]), "clash"))
    got = {r.record_id: r for r in warc.resolve(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert len(got) == sum(r[3] == "revisit" for r in rows)
    strip = lambda t: t and t.removeprefix("W/")
    for r in rows:
        if r[3] == "revisit":
            earlier = [x for x in rows if r[1] and x[1] == r[1] and x[3] == "response" and (x[2], x[0]) < (r[2], r[0])]
            best = max(earlier, key=lambda x: (x[2], x[0]), default=None)
            g = got[r[0]]
            if best is None:
                assert (g.resolution, g.refers_to) == ("orphan", None)
                continue
            both = [(a, b) for a, b in ((strip(r[4]), strip(best[4])), (r[5], best[5]), (r[6], best[6])) if a and b]
            want = "unvalidated" if not both else "resolved" if both[0][0] == both[0][1] else "mismatch"
            assert (g.resolution, g.refers_to) == (want, best[0])
            if want == "resolved":
                low = lambda h: {k.lower(): v for k, v in (h or {}).items()}
                assert g.headers == low(best[7]) | {k: v for k, v in low(r[7]).items() if k in warc.PERMITTED}


def test_empty(spark):
    assert warc.resolve(spark.createDataFrame([], SCHEMA)).collect() == []


def record(kind, uri, url, date, http, payload=b"", extra=""):
    block = http.replace("\n", "\r\n").encode() + b"\r\n\r\n" + payload
    head = f"WARC/1.1\r\nWARC-Type: {kind}\r\nWARC-Record-ID: {uri}\r\nWARC-Target-URI: {url}\r\nWARC-Date: {date}\r\n{extra}Content-Length: {len(block)}\r\n\r\n"
    return head.encode() + block + b"\r\n\r\n"


def test_files_are_read_and_resolved(spark, tmp_path):
    big = b"x\r\n\r\n" * 500_000
    parts = [
        record("warcinfo", "<i>", "", "2024-01-01T00:00:00Z", "software: x"),
        record("response", "<a>", "http://a.b/c", "2024-01-01T00:00:00Z", 'HTTP/1.1 200 OK\nETag: "1"\nContent-Type: text/html', big),
        record("revisit", "<b>", "https://www.a.b/c/#x", "2024-01-02T00:00:00Z", 'HTTP/1.1 304 Not Modified\nETag: "1"\nDate: d\nX-Cache: HIT'),
        record("response", "<c>", "http://a.b/c", "2024-01-03T00:00:00Z", "HTTP/1.1 200 OK", b"", "WARC-Payload-Digest: sha1:Z\r\n"),
    ]
    (tmp_path / "one.warc.gz").write_bytes(b"".join(map(gzip.compress, parts)))
    (tmp_path / "two.warc").write_bytes(b"".join(parts[:1]) + parts[1][:-900])  # ends inside a record
    rows = warc.read_records(spark, str(tmp_path))
    got = {r.uri: r for r in rows.collect()}
    assert got.keys() == {"<a>", "<b>", "<c>"} and bytes(got["<a>"].payload) == big and got["<b>"].payload is None
    assert (got["<b>"].status, got["<c>"].digest, got["<a>"].ts) == (304, "sha1:Z", 1704067200.0)
    out = warc.resolve(rows).collect()
    assert [(r.resolution, r.refers_to) for r in out] == [("resolved", got["<a>"].record_id)]
    assert out[0].headers == {"etag": '"1"', "date": "d", "content-type": "text/html"}


@pytest.mark.parametrize("status", [404, 301, 206, 304])
def test_other_responses_in_between_are_passed_over(spark, status):
    rows = [(1, "http://a.b/c", 1.0, "response", 200, '"x"'), (2, "http://a.b/c", 2.0, "response", status, '"y"'), (3, "http://a.b/c", 3.0, "revisit", 304, '"x"'), (4, "http://a.b/d", 1.0, "response", None, '"x"'), (5, "http://a.b/d", 2.0, "revisit", None, '"x"'), (6, "http://a.b/e", 1.0, "response", status, '"x"'), (7, "http://a.b/e", 2.0, "revisit", 304, '"x"')]
    df = spark.createDataFrame([(*r, None, None, None) for r in rows], "record_id long, url string, ts double, kind string, status int, etag string, last_modified string, digest string, headers map<string,string>")
    got = {r.record_id: (r.resolution, r.refers_to) for r in warc.resolve(df).collect()}
    assert got == {3: ("resolved", 1), 5: ("resolved", 4), 7: ("orphan", None)}


COLUMNS = "record_id long, url string, ts double, kind string, etag string, last_modified string, digest string, headers map<string,string>"


def test_field_names_that_differ_in_case_only(spark):
    rows = [(1, "http://a.b", 1.0, "response", '"x"', None, None, ["ETag", "etag", "X"], ["old", "new", "1"]), (2, "http://a.b", 2.0, "revisit", '"x"', None, None, ["Date", "date", "DATE"], ["a", "b", "c"])]
    df = spark.createDataFrame(rows, COLUMNS.replace("headers map<string,string>", "k array<string>, v array<string>")).withColumn("headers", F.map_from_arrays("k", "v"))
    (got,) = warc.resolve(df).collect()
    assert got.resolution == "resolved" and got.headers == {"etag": "new", "x": "1", "date": "c"}


def test_records_without_a_time(spark):
    nan = float("nan")
    rows = [(1, "http://a.b", None, "response", '"x"'), (2, "http://a.b", 2.0, "revisit", '"x"'), (3, "http://a.b", None, "revisit", '"x"'), (4, "http://a.b", 3.0, "response", '"x"'), (5, "http://a.b", 4.0, "revisit", '"x"'), (6, "http://a.b", nan, "revisit", '"x"'), (7, "http://a.b", nan, "response", '"x"')]
    got = {r.record_id: (r.resolution, r.refers_to, r.canonical_url) for r in warc.resolve(spark.createDataFrame([(*r, None, None, None) for r in rows], COLUMNS)).collect()}
    assert got == {2: ("orphan", None, "a.b"), 3: ("orphan", None, "a.b"), 5: ("resolved", 4, "a.b"), 6: ("orphan", None, "a.b")}


def test_one_wrong_time_and_a_burst_leave_buckets_even(spark):
    rows = [(i, "http://hot.example/", 1e9 + i / 1000, "response" if i % 3 else "revisit", '"x"', None, None, None) for i in range(3000)] + [(9999, "http://other.example/", 0.0, "response", None, None, None, None), (9998, "http://other.example/", 4e18, "response", None, None, None, None)]
    df = spark.createDataFrame(rows, COLUMNS)
    cuts = sorted(set(df.agg(F.percentile_approx("ts", [i / warc.BUCKETS for i in range(1, warc.BUCKETS)], 10 * warc.BUCKETS)).first()[0]))
    sizes = [r["count"] for r in df.groupBy(warc._bucket(F.col("ts"), cuts)).count().collect()]
    assert len(sizes) > 100 and max(sizes) < 60
    got = {r.record_id: r.refers_to for r in warc.resolve(df).collect()}
    assert got == {i: i - 1 if i else None for i in range(0, 3000, 3)}


def test_damaged_files_do_not_end_the_job(spark, tmp_path):
    good = [record("response", f"<{i}>", "http://a.b/c", "2024-01-01T00:00:00", "HTTP/1.1 200 OK\nETag: q\netag: r", b"pay") for i in range(3)]
    wrong = record("response", "<w>", "http://a.b/w", "yesterday", "HTTP/1.1 200 OK").replace(b"Content-Length: ", b"Content-Length: x")
    (tmp_path / "a.warc").write_bytes(good[0] + wrong + good[1])
    (tmp_path / "b.warc.gz").write_bytes(gzip.compress(good[2]) + gzip.compress(good[2].replace(b"<2>", b"<3>")) + b"\0" * 512)
    (tmp_path / "c.warc").write_bytes(b"")
    rows = warc.read_records(spark, str(tmp_path))
    assert {r.uri: bytes(r.payload) for r in rows.collect()} == {f"<{i}>": b"pay" for i in range(3)}
    assert {r.headers["etag"] for r in rows.collect()} == {"r"} and {r.ts for r in rows.collect()} == {1704067200.0}
    every = warc.read_records(spark, str(tmp_path), bad=True)
    assert [r.uri for r in every.where(F.col("kind") == warc.BAD).collect()] == ["<w>"]


def test_a_large_file_is_read_by_records(spark, tmp_path):
    payload = bytes(range(256)) * 40  # not UTF-8
    (tmp_path / "big.warc").write_bytes(b"".join(record("response", f"<{i}>", "http://a.b/c", "2024-01-01T00:00:00Z", "HTTP/1.1 200 OK", payload) for i in range(2000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", 1 << 20)
    try:
        rows = warc.read_records(spark, str(tmp_path))
        assert rows.rdd.getNumPartitions() > 8
        assert rows.select(F.count("*"), F.count_distinct("uri"), F.min(F.length("payload")), F.count_distinct("payload")).first() == (2000, 2000, len(payload), 1)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
