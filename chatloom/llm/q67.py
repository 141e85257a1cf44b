"""Queries p6_* and p7_*: token ids and the mixture of sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chatloom.llm.bpe import count_tokens, encode_texts
from chatloom.llm.mixture import mix, mix_report, source_rates
from chatloom.session import cut_lineage, read_table


def p6_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_texts(read_table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "ids")


def sized(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, source, n_tokens), encoded once."""
    return cut_lineage(count_tokens(read_table(spark, sf_dir, "documents").select("doc_id", "source", "text")))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = count_tokens(read_table(spark, sf_dir, "documents").select("source", "text"))
    return source_rates(docs, read_table(spark, sf_dir, "mix_targets")).where("short").select("source")


def p7_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(sized(spark, sf_dir), read_table(spark, sf_dir, "mix_targets"))


def p7_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    report = mix_report(sized(spark, sf_dir), read_table(spark, sf_dir, "mix_targets"))
    return report.select(*[F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in report.dtypes])


QUERIES = {"p6_ids": p6_ids, "p7_found": p7_found, "p7_mix": p7_mix, "p7_report": p7_report}
ORACLES: dict[str, str] = {}
