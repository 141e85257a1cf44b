"""Mixing sources to target weights, by sizes in tokens."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SEED = 7


def source_rates(sized: DataFrame, targets: DataFrame) -> DataFrame:
    """Per source of ``targets``: source, weight, max_repeats, docs, tokens, target_tokens, target_share, rate, short.

    ``sized`` has (source, n_tokens), a row per document. The size of the mix is
    that of all documents of all listed sources, each counted once. ``rate`` is
    how often a document of the source is taken on average, at most
    ``max_repeats``; ``short`` says that this cap keeps it from its share.
    A null, negative or undefined weight or max_repeats counts as 0. A source
    without documents has 0 docs. Should a source be listed twice, its largest
    weight and max_repeats count.
    """
    clean = (
        targets.where("source is not null")
        .withColumn("weight", F.when(F.col("weight").isNull() | F.isnan(F.col("weight").cast("double")) | (F.col("weight") < 0), 0.0).otherwise(F.col("weight").cast("double")))
        .withColumn("max_repeats", F.greatest(F.lit(0), F.coalesce("max_repeats", F.lit(0))).cast("bigint"))
        .groupBy("source").agg(F.max("weight").alias("weight"), F.max("max_repeats").alias("max_repeats"))
    )
    sizes = sized.groupBy("source").agg(F.count("*").alias("docs"), F.sum("n_tokens").alias("tokens"))
    listed = clean.join(sizes, "source", "left").withColumns({"docs": F.coalesce("docs", F.lit(0)), "tokens": F.coalesce("tokens", F.lit(0))})
    total = listed.agg(F.sum("weight").alias("all_weight"), F.sum("tokens").alias("all_tokens"))  # one row
    both = listed.join(F.broadcast(total))
    target = F.when(F.col("all_weight") > 0, F.col("weight") * F.col("all_tokens") / F.col("all_weight")).otherwise(0.0)
    # in whole products, so that an exact hit isn't lost to rounding
    short = F.col("tokens") * F.col("max_repeats") * F.col("all_weight") < F.col("weight") * F.col("all_tokens")
    rate = F.when(F.col("tokens") > 0, F.least(F.col("max_repeats").cast("double"), F.col("target_tokens") / F.col("tokens"))).otherwise(0.0)
    return (
        both.withColumn("target_tokens", target)
        .withColumn("target_share", F.when(F.col("all_weight") > 0, F.col("weight") / F.col("all_weight")).otherwise(0.0))
        .withColumn("rate", rate)
        .withColumn("short", F.coalesce(short, F.lit(False)))
        .drop("all_weight", "all_tokens")
    )


def mix(sized: DataFrame, targets: DataFrame, id_col: str = "doc_id", seed: int = SEED) -> DataFrame:
    """(source, id, n_tokens, copy): each document floor(rate) times, and once more with the rest's probability.

    The draw is a hash of the seed, the source and the id: the same input gives
    the same mix on any cluster. Documents of sources not listed, and of rate 0,
    don't come out. Rows of equal ids are drawn alike.
    """
    rates = source_rates(sized, targets).select("source", "rate")
    draw = F.pmod(F.xxhash64(F.lit(seed), "source", id_col), F.lit(1 << 52)) / float(1 << 52)
    copies = (F.floor("rate") + (draw < F.col("rate") - F.floor("rate")).cast("bigint")).alias("copies")
    # rates has a row per listed source; the planner broadcasts it only if that is small
    taken = sized.join(rates, "source").select("source", id_col, "n_tokens", copies).where("copies > 0")
    return taken.select("source", id_col, "n_tokens", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy"))


def mix_report(sized: DataFrame, targets: DataFrame, id_col: str = "doc_id", seed: int = SEED) -> DataFrame:
    """``source_rates`` with what the mix holds: mixed_rows, mixed_tokens, actual_share."""
    rates = source_rates(sized, targets)
    got = mix(sized, targets, id_col, seed).groupBy("source").agg(F.count("*").alias("mixed_rows"), F.sum("n_tokens").alias("mixed_tokens"))
    both = rates.join(got, "source", "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("mixed_rows", "mixed_tokens")})
    total = got.agg(F.sum("mixed_tokens").alias("all_mixed"))
    return (
        both.join(F.broadcast(total))
        .withColumn("actual_share", F.when(F.col("all_mixed") > 0, F.col("mixed_tokens") / F.col("all_mixed")).otherwise(0.0))
        .drop("all_mixed")
    )
