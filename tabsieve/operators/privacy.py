"""Identifiability: is a synthetic row strictly closer to a real row than that row's nearest real neighbour?"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabsieve.functions.frames import quantiles
from tabsieve.operators.neighbours import any_within, nearest


def feature_entropy(df: DataFrame, columns: list[str]) -> DataFrame:
    """(col, entropy): natural-log entropy of the rounded values, nulls left out."""
    from tabsieve.functions.frames import melt

    counts = melt(df, columns, []).where("value IS NOT NULL").groupBy("col", F.rint("value").alias("v")).agg(F.count(F.lit(1)).alias("n"))
    # -sum(p ln p) = ln N - sum(n ln n) / N
    return counts.groupBy("col").agg((F.log(F.sum("n").cast("double")) - F.sum(F.col("n") * F.log(F.col("n").cast("double"))) / F.sum("n")).alias("entropy"))


def weighted(df: DataFrame, columns: list[str], weights: dict[str, float] | None = None) -> DataFrame:
    """Columns divided by weight + 1e-16; uniform weights leave them as they are."""
    return df if not weights else df.withColumns({c: F.col(c) / F.lit(weights[c] + 1e-16) for c in columns})


def thresholds(real: DataFrame, key: str, columns: list[str], **options) -> DataFrame:
    """(key, dist): distance of each real row to its nearest other real row (null for a single row)."""
    return nearest(real, real, key, columns, others_only=True, **options)


def flags(real: DataFrame, pool: DataFrame, key: str, columns: list[str], radii: DataFrame | None = None, **options) -> DataFrame:
    """(key, flag) for each pool row; radii are thresholds(real) unless given."""
    radii = thresholds(real, key, columns, **options) if radii is None else radii
    return any_within(pool, real.join(radii.withColumnRenamed("dist", "_r"), key), key, columns, "_r", **options)


def closest(real: DataFrame, pool: DataFrame, key: str, columns: list[str], **options) -> DataFrame:
    """(key, r, d, violated): for each real row its threshold, its distance to the pool, and whether d < r."""
    r = thresholds(real, key, columns, **options).withColumnRenamed("dist", "r")
    d = nearest(real, pool, key, columns, **options).withColumnRenamed("dist", "d")
    return r.join(d, key).withColumn("violated", F.coalesce(F.col("d") < F.col("r"), F.lit(False)))


def score(real: DataFrame, pool: DataFrame, key: str, columns: list[str], **options) -> DataFrame:
    """Share of real rows with a pool row inside their threshold, and their number."""
    return closest(real, pool, key, columns, **options).agg(F.avg(F.col("violated").cast("int")).alias("score"), F.sum(F.col("violated").cast("long")).alias("n_violated"), F.count(F.lit(1)).alias("n_real"))


def privacy_metrics(flagged: DataFrame, epsilon: float = 0.05) -> DataFrame:
    """total, identifiable, ratio (0 without rows), satisfied, violation."""
    one = flagged.agg(F.count(F.lit(1)).alias("total"), F.coalesce(F.sum("flag"), F.lit(0)).cast("long").alias("identifiable"))
    ratio = F.when(F.col("total") > 0, F.col("identifiable") / F.col("total")).otherwise(0.0)
    return one.withColumn("ratio", ratio).withColumns({"satisfied": F.col("ratio") <= epsilon, "violation": F.greatest(F.lit(0.0), F.col("ratio") - epsilon)})


def kept(pool: DataFrame, flagged: DataFrame, key: str) -> DataFrame:
    """Pool rows that are not identifiable."""
    return pool.join(flagged.where("flag = 0").select(key), key, "left_semi")


def weights_by_flag(weighted_rows: DataFrame) -> DataFrame:
    """(flag, n, median, mean) of the weights on either side."""
    middle = quantiles(weighted_rows, ["flag"], "w", [0.5]).select("flag", F.get("q", F.lit(0)).alias("median"))
    whole = weighted_rows.groupBy("flag").agg(F.count(F.lit(1)).alias("n"), F.avg("w").alias("mean"))
    return whole.join(middle, whole["flag"].eqNullSafe(middle["flag"]), "left").select(whole["flag"], "n", "median", "mean")
