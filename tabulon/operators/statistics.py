"""Table statistics: profiles, equi-depth histograms, count-min sketches, distinct sketches, top values, samples, selectivity."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Share of rows that a predicate without statistics is taken to keep.
DEFAULT_SELECTIVITY = 0.8
#: Values by which texts are cut into ranges.
SAMPLED = 2048
#: Most buckets of a histogram.
MAX_BUCKETS = 1024


def profile(table: DataFrame, columns: Sequence[str] = (), exact: bool = False) -> DataFrame:
    """One row for each column: rows, nulls, distinct values, least, greatest, bytes as text; one pass over the table for all columns."""
    names = list(columns or table.columns)
    ndv = (lambda c: F.count_distinct(c)) if exact else (lambda c: F.approx_count_distinct(c))
    parts = [F.struct(F.lit(c).alias("column_name"), F.count("*").alias("row_count"), F.count_if(F.col(c).isNull()).alias("null_count"), ndv(F.col(c)).alias("distinct_count"), F.min(c).cast("string").alias("min_value"), F.max(c).cast("string").alias("max_value"), F.coalesce(F.sum(F.octet_length(F.col(c).cast("string"))), F.lit(0)).alias("total_size")) for c in names]
    return table.agg(F.array(*parts).alias("x")).select(F.explode("x").alias("x")).select("x.*")


def histogram(table: DataFrame, column: str, buckets: int = 256) -> DataFrame:
    """Equi-depth histogram: bucket, lower, upper, rows (cumulative), repeats of the upper bound.

    Values are counted first, so the sort that deals them to buckets is of distinct values, and equal values share a bucket.
    Each value's rank is its partition's offset plus its sum within: no single task sees all values.
    """
    n = min(buckets, MAX_BUCKETS)
    counts = table.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("v")).agg(F.count("*").alias("c"))
    ranked = running_sum(counts, "v", "c").withColumn("bucket", F.floor((F.col("upto") - F.col("c")) * n / F.col("all_")).cast("int"))
    rows = ranked.groupBy("bucket").agg(F.min("v").alias("lower"), F.max("v").alias("upper"), F.max("upto").alias("cumulative"), F.max_by("c", "v").alias("repeats"))
    return rows.select("bucket", "lower", "upper", "cumulative", "repeats")


def running_sum(data: DataFrame, key: str, amount: str) -> DataFrame:
    """data with `upto`, the sum of amount over rows of key up to this row's, and `all_`, the sum over all. Keys must be distinct.

    Rows are cut into ranges of the key by approximate quantiles; sums run within a range, and the ranges' totals are added on.
    """
    if dict(data.dtypes)[key] in ("string", "binary", "boolean"):
        # Whole values of least hash, whatever they begin with: as even as a sample of SAMPLED can be.
        held = sorted(r[0] for r in data.select(key).orderBy(F.xxhash64(key)).limit(SAMPLED).collect())
        cuts = held[len(held) // 64 :: max(1, len(held) // 64)][:63]
    else:
        cuts = data.agg(F.percentile_approx(key, [i / 64 for i in range(1, 64)], 1000)).first()[0] or []
    cuts = sorted(set(cuts))
    part = reduce(lambda a, c: a + (F.col(key) > F.lit(c)).cast("int"), cuts, F.lit(0)) if cuts else F.lit(0)
    ranged = data.withColumn("_part", part)
    totals = ranged.groupBy("_part").agg(F.sum(amount).alias("_t"))
    before = F.coalesce(F.sum("_t").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # 65 rows at most
    offsets = totals.select("_part", before.alias("_before"), F.sum("_t").over(Window.partitionBy()).alias("all_"))
    own = F.sum(amount).over(Window.partitionBy("_part").orderBy(key).rowsBetween(Window.unboundedPreceding, 0))
    return ranged.withColumn("_own", own).join(F.broadcast(offsets), "_part").withColumn("upto", F.col("_before") + F.col("_own")).drop("_part", "_own", "_before")


def histogram_rows(hist: DataFrame, low=None, high=None) -> float:
    """Rows estimated between low and high (both included), by even spread within buckets of numbers."""
    out, before = 0.0, 0
    for r in hist.orderBy("bucket").collect():  # MAX_BUCKETS rows at most
        rows, width = r.cumulative - before, float(r.upper) - float(r.lower)
        before = r.cumulative
        a, b = max(float(r.lower), float(low) if low is not None else -1e308), min(float(r.upper), float(high) if high is not None else 1e308)
        if a <= b:
            out += rows if width == 0 else (rows - r.repeats) * (b - a) / width + (r.repeats if b == float(r.upper) else 0)
    return out


def top_values(table: DataFrame, column: str, n: int = 20) -> DataFrame:
    """The n most frequent values: (value, count), ties to the least value."""
    return table.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(F.count("*").alias("count")).orderBy(F.desc("count"), "value").limit(n)


def count_min(column: str | Column, eps: float = 0.001, confidence: float = 0.99, seed: int = 42) -> Column:
    """Aggregate: a mergeable count-min sketch (binary)."""
    return F.count_min_sketch(column, F.lit(eps), F.lit(confidence), F.lit(seed))


class CountMin:
    """A count-min table of its own: depth rows of width counts, summed where the data is; queries take the noise-corrected median."""

    def __init__(self, table: DataFrame, column: str, depth: int = 5, width: int = 2048):
        self.depth, self.width = depth, width
        each = F.explode(F.array(*(F.struct(F.lit(d).alias("d"), F.pmod(F.xxhash64(F.col(column).cast("string"), F.lit(d)), F.lit(width)).alias("w")) for d in range(depth)))).alias("x")
        cells = table.where(F.col(column).isNotNull()).select(each).groupBy("x.d", "x.w").agg(F.count("*").alias("n")).collect()  # depth * width rows at most
        self.cells = {(r.d, r.w): r.n for r in cells}
        self.rows = sum(n for (d, _), n in self.cells.items() if d == 0)
        self.spark = table.sparkSession

    def query(self, *values, clean: bool = True) -> list[int]:
        """Estimated counts: least over rows, which is never below the true one; with `clean` the median without the noise of other values if that is less."""
        df = self.spark.createDataFrame([(i, str(v)) for i, v in enumerate(values)], "i int, v string")
        places = df.select("i", *(F.pmod(F.xxhash64("v", F.lit(d)), F.lit(self.width)).alias(f"w{d}") for d in range(self.depth))).orderBy("i").collect()
        out = []
        for r in places:
            found = [self.cells.get((d, r[f"w{d}"]), 0) for d in range(self.depth)]
            if not clean:
                out.append(min(found))
                continue
            medians = sorted(n - (self.rows - n) // (self.width - 1) for n in found)
            out.append(max(0, min(min(found), medians[self.depth // 2])))
        return out


def distinct_sketch(column: str | Column) -> Column:
    """Aggregate: mergeable distinct-count sketch (binary); estimate with hll_sketch_estimate."""
    return F.hll_sketch_agg(column)


def _least_hashes(column: str, size: int):
    """Batches of hashes to the mask (bits that are zero) and the different hashes that are under it: `size` of them at most."""

    def run(batches):
        bits, held = 0, np.zeros(0, np.int64)
        for batch in batches:
            new = batch.column(0).to_numpy(zero_copy_only=False)
            held = np.unique(np.concatenate([held, new[(new & ((1 << bits) - 1)) == 0]]))
            while len(held) > size:
                bits += 1
                held = held[(held & ((1 << bits) - 1)) == 0]
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(held), bits, np.int32)), pa.array(held)], ["bits", "h"])

    return run


def _hashes(table: DataFrame, column: str) -> DataFrame:
    return table.where(F.col(column).isNotNull()).select(F.xxhash64(column).alias("h"))


def _masked(hashes: DataFrame, max_size: int) -> tuple[int, int]:
    """Bits of the least mask under which max_size different hashes are at most, and their number.

    Each task keeps max_size different hashes at most, under a mask of its own; those under the widest mask, or a wider one that all of them
    need, are counted. What is shuffled grows with the tasks, not with the values.
    """
    kept = hashes.mapInArrow(_least_hashes("h", max_size), "bits int, h long")
    zeros = F.when(F.col("h") == 0, 64).otherwise(F.bit_count(F.col("h").bitwiseAND(-F.col("h")) - 1))
    rows = kept.groupBy("h").agg(F.max("bits").alias("bits")).groupBy(zeros.alias("z")).agg(F.count("*").alias("n"), F.max("bits").alias("bits")).collect()  # 65 rows at most
    bits = max((r.bits for r in rows), default=0)
    count = lambda: sum(r.n for r in rows if r.z >= bits)
    while count() > max_size:
        bits += 1
    return bits, count()


def fm_distinct(table: DataFrame, column: str, max_size: int = 10_000) -> float:
    """Flajolet-Martin estimate with a doubling mask: hashes whose low bits are zero are kept; 2^bits times their number."""
    bits, n = _masked(_hashes(table, column), max_size)
    return float((1 << bits) * n)


def fm_exact(table: DataFrame, column: str, max_size: int = 10_000) -> float:
    """The estimate as long as all hashes fit; where they do not, the hashes of every residue of the mask are counted, not those of one times
    2^bits: dealt by their value, so what is shuffled then grows with the values. Whole numbers have a hash each (xxhash64 of one number is
    one to one), so that of them this is the true count."""
    hashes = _hashes(table, column)
    bits, n = _masked(hashes, max_size)
    return float(hashes.distinct().count() if bits else n)


def analyze(table: DataFrame, columns: Sequence[str] = (), buckets: int = 256, top: int = 20, sample_rows: int = 10_000, seed: int = 0) -> dict[str, DataFrame]:
    """ANALYZE TABLE: the profile, and by column the histogram and the top values, and one reservoir sample."""
    names = list(columns or [c for c, k in table.dtypes if not k.startswith(("array", "map", "struct"))])
    out = {"profile": profile(table, names), "sample": table.select(*names).withColumn("_r", F.rand(seed)).orderBy("_r").limit(sample_rows).drop("_r")}
    for c in names:
        out[f"histogram:{c}"], out[f"top:{c}"] = histogram(table, c, buckets), top_values(table, c, top)
    return out


#: Columns of the statistics table, one row for each column or index.
STATS_SCHEMA = "name string, id int, isIndex int, rowCount long, hId long, hNdv long, hNullCount long, hTotalCount double, hBuckets long, cRowCount int, cColumnCount int, cHashTables int, cDefaultValue long, cNdv long, cTotalCount long"


def table_statistics(table: DataFrame, indices: Sequence[tuple[str, Sequence[str]]] = (), buckets: int = 256, depth: int = 5, width: int = 2048) -> dict:
    """ANALYZE TABLE: `table` (STATS_SCHEMA; of an index, of its columns' values together), `rows`, and `histograms` by column.

    One pass gives the figures of all columns and indices; each histogram is a plan that runs when it is read. Of the count-min sketch:
    depth rows of width counters, the values it holds, and the count that a value without a counter of its own is taken to have.
    """
    names = [c for c, k in table.dtypes if not k.startswith(("array", "map", "struct"))]
    items = [(c, (c,), 0) for c in names] + [(i, tuple(cs), 1) for i, cs in indices]

    def whole(cs):
        return F.when(reduce(lambda a, b: a & b, (F.col(c).isNotNull() for c in cs)), F.xxhash64(*cs))

    parts = [F.struct(F.count("*").alias("n"), F.count(whole(cs)).alias("some"), F.approx_count_distinct(whole(cs), 0.02).alias("ndv")).alias(f"i{k}") for k, (_, cs, _) in enumerate(items)]
    found = table.agg(*parts).first()
    rows = []
    for k, (name, _, index) in enumerate(items):
        n, some, ndv = found[k]["n"], found[k]["some"], min(found[k]["ndv"], found[k]["some"])
        rows.append((name, k + 1, index, n, k + 1, ndv, n - some, float(some), min(buckets, ndv), depth, width, depth, some // max(ndv, 1), ndv, some))
    return {"table": table.sparkSession.createDataFrame(rows, STATS_SCHEMA), "rows": found[0]["n"] if items else table.count(), "histograms": {c: histogram(table, c, buckets) for c in names}}


def selectivity(hist: DataFrame | None, rows: int, low=None, high=None) -> float:
    """Share of rows kept by a range predicate; DEFAULT_SELECTIVITY without a histogram."""
    return DEFAULT_SELECTIVITY if hist is None or not rows else min(1.0, histogram_rows(hist, low, high) / rows)
