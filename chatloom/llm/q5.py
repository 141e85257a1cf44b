"""Queries p5_*: oversized windows in pieces."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chatloom.llm.splitting import LIMIT, OVERLAP, oversized_pieces
from chatloom.session import read_table


def p5_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return oversized_pieces(read_table(spark, sf_dir, "windows"), read_table(spark, sf_dir, "messages"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p5_pieces(spark, sf_dir).where("piece = 1").select("window_id", "cut").distinct()


def p5_pieces_hold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each oversized window, whether its pieces keep what they promise.

    in_limit: no piece is over the limit; overlapping: each begins 100 to 200
    characters before the end of the one before; whole: they are stretches of the
    text, from its first to its last character; natural: one ends within a word
    only where there is no white space to end at; placed: each has its first and last message.
    """
    windows = read_table(spark, sf_dir, "windows").select(F.col("id").alias("window_id"), F.col("text").alias("source"))
    pieces = p5_pieces(spark, sf_dir).join(windows, "window_id")
    row = F.struct("piece", "first_char", "last_char", "first_msg", "last_msg")
    named = F.forall("p", lambda x: x["first_msg"].isNotNull() & x["last_msg"].isNotNull())
    same = F.col("text") == F.substring(F.col("source"), F.col("first_char").cast("int") + 1, (F.col("last_char") - F.col("first_char") + 1).cast("int"))
    torn = (F.col("boundary") == "none") & F.substring(F.col("text"), OVERLAP[1] + 2, LIMIT).rlike("\\s.")
    by = pieces.groupBy("window_id").agg(
        F.array_sort(F.collect_list(row)).alias("p"), F.max(F.length("text")).alias("longest"), F.bool_and(same).alias("same"), F.bool_or(torn).alias("torn"),
        F.max(F.length("source")).alias("size"),
    )
    steps = F.arrays_zip(F.expr("slice(p, 1, size(p) - 1)").alias("a"), F.expr("slice(p, 2, size(p) - 1)").alias("b"))
    opens = F.col("p").getItem(0)["first_char"] == 0
    overlap = F.forall(steps, lambda s: (s["a"]["last_char"] + 1 - s["b"]["first_char"]).between(*OVERLAP))
    return by.select(
        "window_id", (F.col("longest") <= LIMIT).alias("in_limit"), overlap.alias("overlapping"),
        (opens & F.col("same") & (F.element_at("p", -1)["last_char"] == F.col("size") - 1)).alias("whole"), (~F.col("torn")).alias("natural"), named.alias("placed"),
    )


QUERIES = {"p5_found": p5_found, "p5_pieces": p5_pieces, "p5_pieces_hold": p5_pieces_hold}
ORACLES = {
    "p5_pieces_hold": f"SELECT id AS window_id, true AS in_limit, true AS overlapping, true AS whole, true AS natural, true AS placed FROM windows WHERE id IS NOT NULL AND length(text) > {LIMIT}",
}
