"""Resolution of WARC not-modified revisits.

A revisit record holds no payload: the server said that what was fetched before still holds. It is resolved to the latest earlier full
response of the same canonical URL (an as-of join), if their validators agree; the stored headers are then updated by those of the
revisit that a 304 may update.

The as-of join runs on two levels, so that one URL that holds a third of all records is not one task: within (URL, time bucket) a
window carries the last response forward; over the buckets of a URL, at most BUCKETS rows, a second window carries each bucket's last
response on. Buckets are cut at quantiles of all times, so neither a burst nor a wrong time fills one. Payloads take no part; only ids,
validators and headers are shuffled.

Defined results: a response is full if its status is null or 200, and others (errors, redirects, parts, stored 304s) are passed over, as
if absent; a null or empty URL, or no earlier response, gives `orphan`; validators that both sides have and that differ give
`mismatch`; no validator on both sides gives `unvalidated`; ties in time go by record id; of header fields whose names differ in case
only, the last counts; repeated records resolve alike; payload
columns and other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from datetime import UTC, datetime

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Time buckets that a URL's records are dealt over at most.
BUCKETS = 256
#: Fixed value: status of a response that holds its whole payload.
FULL = 200
#: Header fields that a 304 response may update (RFC 9110, 15.4.5, and Last-Modified).
PERMITTED = ("cache-control", "content-location", "date", "etag", "expires", "last-modified", "vary")
#: Query parameters that only track visits.
TRACKING = r"^(utm_[a-z]+|gclid|fbclid|sessionid|phpsessid)="


def canonical_url(url: Column) -> Column:
    """Host and path by which captures are matched: no scheme, fragment, user, default port, `www.`, trailing slashes or tracking parameters; host in lower case, parameters sorted."""
    bare = F.regexp_replace(F.regexp_replace(F.trim(url), "#.*$", ""), "^[A-Za-z][A-Za-z0-9+.-]*://", "")
    host = F.lower(F.regexp_extract(bare, "^([^/?]*)", 1))
    host = F.regexp_replace(F.regexp_replace(F.regexp_replace(host, "^.*@", ""), "[.]?(:80|:443)?$", ""), "^www[0-9]*[.]", "")
    path = F.regexp_replace(F.regexp_extract(bare, "^[^/?]*([^?]*)", 1), "/+$", "")
    given = F.filter(F.split(F.regexp_extract(bare, "^[^?]*[?]?(.*)$", 1), "&"), lambda p: (p != "") & ~F.lower(p).rlike(TRACKING))
    query = F.array_join(F.array_sort(given), "&")
    out = F.concat(host, path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise(F.lit("")))
    return F.when(host != "", out)


def _agrees(a: Column, b: Column, weak: bool = False) -> Column:
    """True, false, or null if one side lacks the validator."""
    if weak:
        a, b = F.regexp_replace(a, "^W/", ""), F.regexp_replace(b, "^W/", "")
    return a == b


def _bucket(x: Column, cuts: list[float]) -> Column:
    """How many of the sorted cuts are below x, by halving."""
    if not cuts:
        return F.lit(0)
    half = len(cuts) // 2
    return F.when(x > F.lit(cuts[half]), F.lit(half + 1) + _bucket(x, cuts[half + 1 :])).otherwise(_bucket(x, cuts[:half]))


def lowered(headers: Column) -> Column:
    """A map of header fields by names in lower case; of names that differ in case only, the last entry's value."""
    entries = F.map_entries(headers)
    names = F.array_distinct(F.transform(entries, lambda e: F.lower(e["key"])))
    return F.map_from_arrays(names, F.transform(names, lambda k: F.element_at(F.filter(entries, lambda e: F.lower(e["key"]) == k), -1)["value"]))


def resolve(records: DataFrame) -> DataFrame:
    """Revisits among records (record_id, url, ts, kind `response` or `revisit`, etag, last_modified, digest, headers map; status if they have it) with what they stand for.

    Gives record_id, canonical_url, refers_to (record_id of the response, also on a mismatch), resolution, headers (merged if resolved).
    ts: any ordered number.
    """
    info = F.struct("record_id", "etag", "last_modified", "digest", "headers")
    ts = F.col("ts").cast("double")
    ts = F.when(~F.isnan(ts), ts)
    whole = (F.col("kind") == "response") & ts.isNotNull()
    if "status" in records.columns:
        whole = whole & (F.col("status").isNull() | (F.col("status") == FULL))
    rows = records.select(
        "record_id", canonical_url(F.col("url")).alias("canonical_url"), ts.alias("ts"),
        F.when(whole, info).alias("full"), F.when(F.col("kind") == "revisit", info).alias("own"),
    )
    cuts = rows.agg(F.percentile_approx("ts", [i / BUCKETS for i in range(1, BUCKETS)], 10 * BUCKETS)).first()[0] or []
    dated = F.col("canonical_url").isNotNull() & F.col("ts").isNotNull()
    keyed = rows.where(dated).withColumn("bucket", _bucket(F.col("ts"), sorted(set(cuts))))
    near = Window.partitionBy("canonical_url", "bucket").orderBy("ts", "record_id").rowsBetween(Window.unboundedPreceding, -1)
    local = keyed.withColumn("local", F.last("full", ignorenulls=True).over(near)).where(F.col("own").isNotNull())
    ends = keyed.where(F.col("full").isNotNull()).groupBy("canonical_url", "bucket").agg(F.max_by("full", F.struct("ts", "record_id")).alias("full"))
    asked = local.where(F.col("local").isNull()).select("canonical_url", "bucket").distinct()
    steps = ends.select("canonical_url", "bucket", "full").unionByName(asked.withColumn("full", F.lit(None).cast(ends.schema["full"].dataType)))
    steps = steps.groupBy("canonical_url", "bucket").agg(F.first("full", ignorenulls=True).alias("full"))
    before = Window.partitionBy("canonical_url").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    carried = steps.withColumn("carried", F.last("full", ignorenulls=True).over(before)).where(F.col("carried").isNotNull()).select("canonical_url", "bucket", "carried")
    found = local.join(carried, ["canonical_url", "bucket"], "left").withColumn("full", F.coalesce("local", "carried"))
    found = found.select("record_id", "canonical_url", "own", "full")
    lost = rows.where(~dated & F.col("own").isNotNull()).select("record_id", "canonical_url", "own", F.lit(None).cast(found.schema["full"].dataType).alias("full"))
    every = found.union(lost)
    a, b = F.col("own"), F.col("full")
    valid = F.coalesce(_agrees(a["etag"], b["etag"], weak=True), _agrees(a["last_modified"], b["last_modified"]), _agrees(a["digest"], b["digest"]))
    resolution = F.when(b.isNull(), "orphan").when(valid.isNull(), "unvalidated").when(valid, "resolved").otherwise("mismatch")
    stored, update = lowered(b["headers"]), F.map_filter(lowered(a["headers"]), lambda k, _: k.isin(*PERMITTED))
    kept = F.map_filter(stored, lambda k, _: ~F.coalesce(F.map_contains_key(update, k), F.lit(False)))
    merged = F.map_concat(F.coalesce(kept, F.create_map().cast("map<string,string>")), F.coalesce(update, F.create_map().cast("map<string,string>")))
    return every.select("record_id", "canonical_url", b["record_id"].alias("refers_to"), resolution.alias("resolution"), F.when(resolution == "resolved", merged).alias("headers"))


def records_of_pages(pages: DataFrame, lag: int = 1000) -> DataFrame:
    """Crawl records of a table of pages: a full response at second page_id, and a conditional fetch `lag` seconds later that the server answers with 304 and the page's own validators."""
    html, at = F.coalesce(F.col("html"), F.lit("")), F.col("page_id")
    tag = F.concat(F.lit('"'), F.md5(html), F.lit('"'))
    none = F.lit(None).cast("string")
    text = lambda c: c.cast("string")
    full = F.create_map(
        F.lit("Content-Type"), F.lit("text/html; charset=utf-8"), F.lit("Content-Length"), text(F.octet_length(html)), F.lit("ETag"), tag,
        F.lit("Last-Modified"), text(at), F.lit("Date"), text(at), F.lit("X-Cache"), F.lit("MISS"),
    )
    again = F.create_map(F.lit("Date"), text(at + lag), F.lit("ETag"), tag, F.lit("Cache-Control"), F.lit("max-age=60"), F.lit("Content-Length"), F.lit("0"), F.lit("X-Cache"), F.lit("HIT"))
    response = pages.select((2 * at).alias("record_id"), "url", at.alias("ts"), F.lit("response").alias("kind"), tag.alias("etag"), text(at).alias("last_modified"), none.alias("digest"), full.alias("headers"))
    revisit = pages.select((2 * at + 1).alias("record_id"), "url", (at + lag).alias("ts"), F.lit("revisit").alias("kind"), tag.alias("etag"), none.alias("last_modified"), none.alias("digest"), again.alias("headers"))
    return response.union(revisit)


RECORD = "uri string, url string, ts double, kind string, status int, etag string, last_modified string, digest string, headers map<string,string>, payload binary"
#: Fixed value: what stands between two records of a file.
BETWEEN = "\r\n\r\nWARC/1."
#: Kind of the rows that stand for records that cannot be read.
BAD = "bad"


def _head(block: bytes) -> tuple[str, dict[str, str]]:
    """First line and fields, by names in lower case; of a repeated field the last value."""
    first, *lines = block.decode("utf-8", "replace").split("\r\n")
    return first, {k.strip().lower(): v.strip() for k, sep, v in (x.partition(":") for x in lines) if sep}


def parse(record: bytes) -> tuple | None:
    """A record's bytes as a row of RECORD; None if it is neither a response nor a revisit. A record without a length that is a number, or with
    fewer bytes than that, gives a row of kind BAD."""
    record = record.lstrip(b"\r\n")
    if not record:
        return None
    head, _, block = record.partition(b"\r\n\r\n")
    _, warc = _head(head)
    bad = (warc.get("warc-record-id"), warc.get("warc-target-uri"), None, BAD, None, None, None, None, None, None)
    kind, size = warc.get("warc-type"), warc.get("content-length", "")
    if not (size.isascii() and size.isdigit()) or len(block) < int(size):
        return bad
    if kind not in ("response", "revisit"):
        return None if kind else bad
    http, _, payload = block[: int(size)].partition(b"\r\n\r\n")
    line, headers = _head(http)
    status = int(line.split(" ")[1]) if line.startswith("HTTP/") and line.split(" ")[1:2] and line.split(" ")[1].isdigit() else None
    try:
        ts = datetime.fromisoformat(warc["warc-date"])
        ts = (ts if ts.tzinfo else ts.replace(tzinfo=UTC)).timestamp()
    except (KeyError, ValueError):
        ts = None
    return (*bad[:2], ts, kind, status, headers.get("etag"), headers.get("last-modified"), warc.get("warc-payload-digest"), list(headers.items()), payload if kind == "response" else None)


def read_records(spark: SparkSession, path: str, bad: bool = False) -> DataFrame:
    """Records of WARC files (plain or gzip) as resolve() takes them, with uri, status and payload besides; record_id is a hash of the record's URI.

    Spark's reader cuts files at BETWEEN and hands over a record at a time: no file is held whole, and a plain file is several tasks' work.
    Records that cannot be read are left out, or with `bad` rows of kind BAD, so that they can be counted; a payload that holds BETWEEN
    is one. A gzip file that is damaged, or padded behind its last member, ends there: the records before are read, but for the one that
    stands next to it, whose end is not seen.
    """

    def run(batches):
        kinds = [pa.string(), pa.string(), pa.float64(), pa.string(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.map_(pa.string(), pa.string()), pa.binary()]
        for batch in batches:
            rows, size = [], 0
            for record in batch.column(0):
                if (row := parse(record.as_py())) is not None:
                    rows.append(row)
                    size += len(row[-1] or b"")
                if rows and (size > 16 << 20 or len(rows) == 1024):
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], [f"c{i}" for i in range(len(kinds))])
                    rows, size = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], [f"c{i}" for i in range(len(kinds))])

    files = spark.read.option("lineSep", BETWEEN).option("ignoreCorruptFiles", "true").text(path).select(F.col("value").cast("binary").alias("record"))
    found = files.mapInArrow(run, RECORD)
    return (found if bad else found.where(F.col("kind") != BAD)).withColumn("record_id", F.xxhash64("uri"))


def headers_text(headers: Column) -> Column:
    """`name: value` lines by name."""
    return F.array_join(F.transform(F.array_sort(F.map_entries(headers)), lambda e: F.concat(e["key"], F.lit(": "), e["value"])), "\n")


#: DuckDB SQL of the registered query.
ORACLE = r"""
WITH p AS (
  SELECT page_id, coalesce(html, '') AS html, regexp_replace(regexp_replace(trim(url), '#.*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*://', '') AS u FROM pages
), h AS (
  SELECT *, regexp_replace(regexp_replace(regexp_replace(lower(regexp_extract(u, '^([^/?]*)', 1)), '^.*@', ''), '[.]?(:80|:443)?$', ''), '^www[0-9]*[.]', '') AS host,
    regexp_replace(regexp_extract(u, '^[^/?]*([^?]*)', 1), '/+$', '') AS path,
    array_to_string(list_sort(list_filter(string_split(regexp_extract(u, '^[^?]*[?]?(.*)$', 1), '&'),
      lambda x: x <> '' AND NOT regexp_matches(lower(x), '^(utm_[a-z]+|gclid|fbclid|sessionid|phpsessid)='))), '&') AS q FROM p
), c AS (SELECT page_id, html, md5(html) AS tag, CASE WHEN host <> '' THEN host || path || CASE WHEN q <> '' THEN '?' || q ELSE '' END END AS c FROM h),
r AS (
  SELECT a.page_id, a.c, a.tag, b.page_id AS b, b.tag AS btag, strlen(b.html) AS size
  FROM c AS a ASOF LEFT JOIN c AS b ON a.c = b.c AND 2 * CAST(a.page_id + 1000 AS HUGEINT) * 1000000000000 + 2 * a.page_id + 1 > 2 * CAST(b.page_id AS HUGEINT) * 1000000000000 + 2 * b.page_id
)
SELECT 2 * page_id + 1 AS record_id, c AS canonical_url, 2 * b AS refers_to,
  CASE WHEN b IS NULL THEN 'orphan' WHEN tag = btag THEN 'resolved' ELSE 'mismatch' END AS resolution,
  CASE WHEN tag = btag THEN 'cache-control: max-age=60' || chr(10) || 'content-length: ' || size || chr(10) || 'content-type: text/html; charset=utf-8' || chr(10)
    || 'date: ' || (page_id + 1000) || chr(10) || 'etag: "' || tag || '"' || chr(10) || 'last-modified: ' || b || chr(10) || 'x-cache: MISS' END AS headers
FROM r
"""
