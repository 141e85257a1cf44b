"""Queries p3_*: personal information in messages and windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chatloom.llm.names import Names, learn_names
from chatloom.llm.pii import personal_information, redacted
from chatloom.session import read_table


def names_of(spark: SparkSession, sf_dir: str) -> Names:
    messages = read_table(spark, sf_dir, "messages")
    senders = messages.select("sender").where("sender is not null").distinct()
    return learn_names(messages, read_table(spark, sf_dir, "people"), senders)


def _both(spark: SparkSession, sf_dir: str) -> list[tuple[str, DataFrame]]:
    return [(name, read_table(spark, sf_dir, name).select("id", "text")) for name in ("messages", "windows")]


def p3_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = names_of(spark, sf_dir)
    a, b = [
        personal_information(rows, names).select(F.lit(tab).alias("tab"), F.col("id").alias("row_id"), "kind", F.col("begin").alias("first_char"), F.col("end").alias("end_char"))
        for tab, rows in _both(spark, sf_dir)
    ]
    return a.unionByName(b)


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p3_spans(spark, sf_dir).select("tab", "row_id", "kind").distinct()


def p3_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = names_of(spark, sf_dir)
    a, b = [redacted(rows, names).select(F.lit(tab).alias("tab"), F.col("id").alias("row_id"), "redacted") for tab, rows in _both(spark, sf_dir)]
    return a.unionByName(b)


QUERIES = {"p3_found": p3_found, "p3_spans": p3_spans, "p3_redacted": p3_redacted}
ORACLES: dict[str, str] = {}
