"""Tables kept between steps in the folder that all executors share."""

from __future__ import annotations

import struct
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; a temporary one only where the setting is unset and all runs on this machine (tests)."""
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not found:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="tabulon-"))
        found = sc.getCheckpointDir()
    return found.rstrip("/")


class Scratch:
    """Written tables of one operator call. They cut lineage: a lost executor costs a reread, no recomputation."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.base = spark, f"{shared_dir(spark)}/tabulon-{name}-{uuid.uuid4().hex}"

    def save(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.base}/{name}"
        df.write.option("compression", "zstd").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, name: str) -> None:
        """Removes a table that no later step reads."""
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.base}/{name}")
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)

    def forget(self) -> None:
        """Lets the cleaner remove the shuffle files of steps that are done: they go when the driver's collector finds them unused."""
        self.spark.sparkContext._jvm.System.gc()


_CODEC = pa.Codec("zstd", 1)


def packed(*arrays: np.ndarray) -> bytes:
    """Number arrays as one compressed value; bytes of one rank stand together, as high ones repeat."""
    head = struct.pack("<I", len(arrays)) + b"".join(a.dtype.str.encode().ljust(4) + struct.pack("<q", len(a)) for a in arrays)
    planes = (np.ascontiguousarray(a).view(np.uint8).reshape(-1, a.dtype.itemsize).T for a in arrays)
    raw = b"".join((head, *(np.ascontiguousarray(x).tobytes() for x in planes)))  # tobytes() alone would copy a transposed array byte by byte
    return struct.pack("<q", len(raw)) + _CODEC.compress(raw, asbytes=True)


def unpacked(value: bytes) -> list[np.ndarray]:
    raw = _CODEC.decompress(value[8:], struct.unpack("<q", value[:8])[0], asbytes=True)
    n = struct.unpack("<I", raw[:4])[0]
    out, at = [], 4 + 12 * n
    for i in range(n):
        kind, size = np.dtype(raw[4 + 12 * i : 8 + 12 * i].decode().strip()), struct.unpack("<q", raw[8 + 12 * i : 16 + 12 * i])[0]
        planes = np.frombuffer(raw, np.uint8, size * kind.itemsize, at).reshape(kind.itemsize, size)
        out.append(np.ascontiguousarray(planes.T).view(kind).ravel() if size else np.zeros(0, kind))
        at += size * kind.itemsize
    return out


def partition_hash(k: np.ndarray) -> np.ndarray:
    """Spark's hash of an integer column (32-bit Murmur3, seed 42), by whose remainder rows are dealt to partitions."""
    turn = lambda x, r: (x << np.uint32(r)) | (x >> np.uint32(32 - r))
    x = turn(k.astype(np.int32).view(np.uint32) * np.uint32(0xCC9E2D51), 15) * np.uint32(0x1B873593)
    h = (turn(np.uint32(42) ^ x, 13) * np.uint32(5) + np.uint32(0xE6546B64)) ^ np.uint32(4)
    h = (h ^ (h >> np.uint32(16))) * np.uint32(0x85EBCA6B)
    h = (h ^ (h >> np.uint32(13))) * np.uint32(0xC2B2AE35)
    return (h ^ (h >> np.uint32(16))).view(np.int32)


def one_to_one(n: int) -> np.ndarray:
    """n numbers of which repartition(n, number) deals one to each partition."""
    out, missing, at = np.zeros(n, np.int32), np.ones(n, bool), 0
    while missing.any():
        k = np.arange(at, at + 8 * n + 64, dtype=np.int32)
        part = partition_hash(k) % n
        part, first = np.unique(part, return_index=True)
        new = missing[part]
        out[part[new]], missing[part] = k[first[new]], False
        at += len(k)
    return out
