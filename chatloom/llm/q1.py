"""Queries p1_*: the most similar vectors of every vector."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chatloom.llm.neighbors import measured_recall, most_similar
from chatloom.session import read_table

SIMILAR = 0.95


def p1_neighbors(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = most_similar(read_table(spark, sf_dir, "window_vecs"))
    return near.select(F.col("id").alias("window_id"), F.col("other").alias("neighbor_id"), "rank", F.round("similarity", 6).alias("similarity"))


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = most_similar(read_table(spark, sf_dir, "window_vecs")).where(F.col("similarity") >= SIMILAR)
    return near.select(F.least("id", "other").alias("window_a"), F.greatest("id", "other").alias("window_b")).distinct()


def p1_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    return measured_recall(read_table(spark, sf_dir, "window_vecs"))


QUERIES = {"p1_found": p1_found, "p1_neighbors": p1_neighbors, "p1_recall": p1_recall}
# all pairs, by brute force
ORACLES = {
    "p1_found": f"""WITH v AS (SELECT window_id, min(vec)::DOUBLE[] AS vec FROM window_vecs WHERE window_id IS NOT NULL AND len(vec) = 64
      AND len(list_filter(vec, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(vec, lambda x: x <> 0)) > 0 GROUP BY 1)
    SELECT a.window_id AS window_a, b.window_id AS window_b FROM v a JOIN v b ON a.window_id < b.window_id WHERE list_cosine_similarity(a.vec, b.vec) >= {SIMILAR}""",
}
