"""Corpus pipeline over `documents`: quality, near-duplicates, benchmark contamination, secrets, packing.

Each stage takes (spark, docs, sf_dir) and works on all rows that its predecessor kept. All but the last return the columns of
documents: the first three drop rows, the fourth masks spans in texts, the last returns one row for each packed piece.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabulon.llm import decontam, packing, quality, secrets, simhash
from tabulon.llm._store import Scratch
from tabulon.shipping import ship


#: Rows of texts that are handed to Python at once, and back: a few megabytes, for executors with little memory.
BATCH_ROWS = "2000"
#: Words that a worker remembers while it tokenises: a third of the operator's own number, as earlier stages leave executors little memory.
CACHE_WORDS = 100_000


def ready(spark: SparkSession) -> SparkSession:
    """The session with the package on its executors, and batches of BATCH_ROWS."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    return ship(spark)


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose score is at least quality.KEEP_FROM; the rules are learned from labelled rows outside the held-out fold."""
    model = quality.fit(docs, ready(spark).read.parquet(f"{sf_dir}/labels.parquet"), held_out=quality.fold)
    return quality.scored(docs, model).where(F.col("predicted") == 1).select(*docs.columns)


def keep_one_copy(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row, of the least doc_id, of each group of documents whose five-word shingle sets are 0.8 similar or more."""
    ready(spark)
    return simhash.without_near_copies(docs, k=5, similarity=0.8)


def keep_uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that hold no 13 consecutive words of a benchmark item, however long they are; of shorter items, less than a twentieth of their words."""
    return decontam.without_contaminated(docs, ready(spark).read.parquet(f"{sf_dir}/benchmark.parquet"))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, with every secret in their texts replaced by a mask, and n_chars as it is then."""
    masked = secrets.redact(docs)
    return masked.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns) if "n_chars" in docs.columns else masked


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all rows, placed in sequences of 4,096 tokens."""
    ready(spark)
    return packing.pack(docs, cache_words=CACHE_WORDS)


STAGES = [
    ("quality", keep_quality),
    ("near_dedup", keep_one_copy),
    ("decontamination", keep_uncontaminated),
    ("secrets", mask_secrets),
    ("packing", pack_sequences),
]

#: No SQL: rules are learned, and hashes and tokenizers have no SQL form. tests/llm/test_pipeline.py compares each stage with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = scratch.save(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
