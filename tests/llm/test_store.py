import numpy as np
from pyspark.sql import functions as F

from tabulon.llm import _store


def test_numbers_are_dealt_one_to_one(spark):
    for n in (1, 6, 51, 211):
        keys = _store.one_to_one(n)
        rows = spark.createDataFrame([(int(k),) for k in keys], "k int").select(F.hash("k").alias("h"), F.pmod(F.hash("k"), F.lit(n)).alias("p")).collect()
        assert [r.p for r in rows] == list(range(n))
        assert [r.h for r in rows] == _store.partition_hash(keys).tolist()


def test_packed_arrays_come_back():
    rng = np.random.default_rng(0)
    for arrays in ([np.zeros(0, np.int64)], [rng.integers(-9, 9, 1000), rng.random(7).astype(np.float32), np.zeros(0, np.uint8), np.arange(5, dtype=np.uint32)]):
        back = _store.unpacked(_store.packed(*arrays))
        assert len(back) == len(arrays)
        for a, b in zip(arrays, back, strict=True):
            assert a.dtype == b.dtype and (a == b).all()
