"""The registered queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shipping import ship
from . import ann, decontam, hpylm, langid, packing, quality, secrets, simhash, tokencount, warc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ship(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"), k=4, radius=4)


def op7_tokencount(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencount.token_counts(_table(spark, sf_dir, "documents"))


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = warc.resolve(warc.records_of_pages(_table(spark, sf_dir, "pages").select("page_id", "url", "html")))
    return found.withColumn("headers", warc.headers_text(F.col("headers")))


def op9_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"))


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _table(spark, sf_dir, "documents").select("doc_id", "text"), _table(spark, sf_dir, "labels")
    model = quality.fit(docs, labels, held_out=quality.fold)
    return quality.scored(docs, model).select("doc_id", quality.fold(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = langid.fit(docs, held_out=quality.fold)
    return langid.predict(docs, model).select("doc_id", quality.fold(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "ambiguous")


def op3_hpylm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hpylm.score(_table(spark, sf_dir, "documents"), lambda i: quality.fold(i, 7, 2))


def op4_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(_table(spark, sf_dir, "embeddings"), lambda i: i % 20 == 0, k=20)


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(_table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_quality": op1_quality,
    "op2_language": op2_language,
    "op3_hpylm": op3_hpylm,
    "op4_neighbours": op4_neighbours,
    "op5_secrets": op5_secrets,
    "op6_simhash": op6_simhash,
    "op7_tokencount": op7_tokencount,
    "op8_warc": op8_warc,
    "op9_winnowing": op9_winnowing,
    "op10_packing": op10_packing,
}

ORACLE_SQL: dict[str, str] = {"op5_secrets": secrets.ORACLE, "op8_warc": warc.ORACLE, "op9_winnowing": decontam.ORACLE}
