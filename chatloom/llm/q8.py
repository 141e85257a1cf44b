"""Queries p8_*: text statistics and shape."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chatloom.llm.quality import text_quality
from chatloom.session import read_table


def _quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text_quality(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "common_words"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _quality(spark, sf_dir).where("shape <> 'prose'").select("doc_id", "shape")


def p8_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = _quality(spark, sf_dir)
    return q.select(*[F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in q.dtypes])


QUERIES = {"p8_found": p8_found, "p8_statistics": p8_statistics}
ORACLES: dict[str, str] = {}
