"""Frequencies of two tables' columns and the distances between them, all from one long frame.

Every metric starts from (col, bucket, p, q): relative frequencies on either side over the union of buckets, plus 1e-10. The frame takes one aggregate
over the melted columns; all distances are then aggregates over few rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabsieve.functions.frames import cumulative, melt

EPS = 1e-10


def _relative(counts: DataFrame) -> DataFrame:
    """(col, bucket, p, q) from (col, bucket, a, b)."""
    sizes = counts.groupBy("col").agg(F.sum("a").alias("_a"), F.sum("b").alias("_b"))
    part = lambda c, t: F.when(F.col(t) > 0, F.col(c) / F.col(t)).otherwise(0.0) + F.lit(EPS)
    return counts.join(sizes, "col").select("col", "bucket", part("a", "_a").alias("p"), part("b", "_b").alias("q"))


def frequencies(df: DataFrame, ds: str, first: str, second: str, columns: list[str]) -> DataFrame:
    """(col, bucket, p, q) of categorical columns; nulls are left out."""
    long = melt(df.where(F.col(ds).isin(first, second)), columns, [ds], "string").where("value IS NOT NULL")
    side = lambda s: F.count(F.when(F.col(ds) == s, 1))
    return _relative(long.groupBy("col", F.col("value").alias("bucket")).agg(side(first).alias("a"), side(second).alias("b")))


def frequencies_binned(df: DataFrame, ds: str, first: str, second: str, columns: list[str], bins: int = 50) -> DataFrame:
    """(col, bucket, p, q) of numeric columns in min(bins, distinct) equal-width bins over the first table's range, closed on the right.

    The lowest edge lies 0.1 % of the range below the minimum. Values outside the range make a bucket of their own (-1); empty bins are kept. A column
    with a single value on the first side is one bucket with frequency 1 on both sides.
    """
    long = melt(df.where(F.col(ds).isin(first, second)), columns, [ds]).where("value IS NOT NULL")
    own = long.where(F.col(ds) == first).groupBy("col").agg(F.min("value").alias("lo"), F.max("value").alias("hi"), F.least(F.count_distinct("value"), F.lit(bins)).cast("int").alias("k"))
    joined = long.join(F.broadcast(own), "col")  # one row for each column
    span = F.col("hi") - F.col("lo")
    inside = (F.col("value") > F.col("lo") - 0.001 * span) & (F.col("value") <= F.col("hi"))
    place = F.greatest(F.ceil((F.col("value") - F.col("lo")) / span * F.col("k")), F.lit(1))
    bucket = F.when(F.col("k") <= 1, 0).when(inside, place).otherwise(-1).cast("int")
    side = lambda s: F.count(F.when(F.col(ds) == s, 1))
    counts = joined.groupBy("col", bucket.alias("bucket")).agg(side(first).alias("a"), side(second).alias("b"))
    all_bins = own.where("k > 1").select("col", F.explode(F.sequence(F.lit(1), F.col("k"))).alias("bucket"), F.lit(0).cast("long").alias("a"), F.lit(0).cast("long").alias("b"))
    full = counts.unionByName(all_bins).groupBy("col", "bucket").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    out = _relative(full).join(own.select("col", "k"), "col")
    one = F.col("k") <= 1
    return out.select("col", "bucket", F.when(one, 1.0).otherwise(F.col("p")).alias("p"), F.when(one, 1.0).otherwise(F.col("q")).alias("q"))


def marginal_distances(freq: DataFrame) -> DataFrame:
    """(col, js, inverse_kl, tvd, hellinger, chi2, df) from frequencies; js in nats, chi2 on proportions."""
    sizes = freq.groupBy("col").agg(F.sum("p").alias("_p"), F.sum("q").alias("_q"))
    f = freq.join(sizes, "col").withColumns({"p1": F.col("p") / F.col("_p"), "q1": F.col("q") / F.col("_q")}).withColumn("m", (F.col("p1") + F.col("q1")) / 2)
    jsd = F.sum(F.col("p1") * F.log(F.col("p1") / F.col("m")) + F.col("q1") * F.log(F.col("q1") / F.col("m"))) / 2
    return f.groupBy("col").agg(
        F.sqrt(F.greatest(jsd, F.lit(0.0))).alias("js"),
        (1 / (1 + F.sum(F.col("p1") * F.log(F.col("p1") / F.col("q1"))))).alias("inverse_kl"),
        (F.sum(F.abs(F.col("p1") - F.col("q1"))) / 2).alias("tvd"),
        F.sqrt(F.greatest(1 - F.sum(F.sqrt(F.col("p1") * F.col("q1"))), F.lit(0.0))).alias("hellinger"),
        F.sum((F.col("p") - F.col("q")) * (F.col("p") - F.col("q")) / F.col("q")).alias("chi2"),
        (F.count(F.lit(1)) - 1).alias("df"),
    )


def joint_js(df: DataFrame, ds: str, first: str, second: str, columns: list[str]) -> DataFrame:
    """Jensen-Shannon distance (bits) of the joint distribution of the columns as text; null is a value."""
    side = lambda s: F.count(F.when(F.col(ds) == s, 1))
    counts = df.where(F.col(ds).isin(first, second)).groupBy(*[F.coalesce(F.col(c).cast("string"), F.lit("None")).alias(c) for c in columns]).agg(side(first).alias("a"), side(second).alias("b"))
    sizes = counts.agg(F.sum("a").alias("_a"), F.sum("b").alias("_b"))
    f = counts.join(F.broadcast(sizes)).select((F.col("a") / F.col("_a")).alias("p"), (F.col("b") / F.col("_b")).alias("q")).withColumn("m", (F.col("p") + F.col("q")) / 2)  # sizes is one row
    part = lambda c: F.when(F.col(c) > 0, F.col(c) * F.log2(F.col(c) / F.col("m"))).otherwise(0.0)
    return f.agg(F.sqrt(F.greatest(F.sum(part("p") + part("q")) / 2, F.lit(0.0))).alias("js_joint"))


def cdf_frame(df: DataFrame, ds: str, first: str, second: str, columns: list[str]) -> DataFrame:
    """(col, value, a, b, ca, cb, na, nb, _bin): counts by distinct value on either side and running counts."""
    long = melt(df.where(F.col(ds).isin(first, second)), columns, [ds]).where("value IS NOT NULL")
    side = lambda s: F.count(F.when(F.col(ds) == s, 1))
    counts = long.groupBy("col", "value").agg(side(first).alias("a"), side(second).alias("b"))
    sizes = counts.groupBy("col").agg(F.sum("a").alias("na"), F.sum("b").alias("nb"))
    return cumulative(counts, "col", "value", {"ca": "a", "cb": "b"}).join(F.broadcast(sizes), "col")  # one row for each column


def cdf_distances(cdf: DataFrame) -> DataFrame:
    """(col, ks, w1, na, nb): Kolmogorov-Smirnov statistic and first Wasserstein distance.

    The step from a value to the next one is taken inside ranges; the step across two ranges comes from the ranges' ends.
    """
    from pyspark.sql import Window

    gap = F.abs(F.col("ca") / F.col("na") - F.col("cb") / F.col("nb"))
    inside = Window.partitionBy("col", "_bin").orderBy("value")
    steps = cdf.withColumn("gap", gap).withColumn("next", F.lead("value").over(inside))
    ranges = steps.groupBy("col", "_bin").agg(
        F.max("gap").alias("ks"), F.sum(F.col("gap") * (F.col("next") - F.col("value"))).alias("w"), F.min("value").alias("lo"), F.max(F.struct("value", "gap")).alias("end"), F.max("na").alias("na"), F.max("nb").alias("nb")
    )
    across = Window.partitionBy("col").orderBy("_bin")
    ranges = ranges.withColumn("jump", F.coalesce(F.col("end.gap") * (F.lead("lo").over(across) - F.col("end.value")), F.lit(0.0)))
    return ranges.groupBy("col").agg(F.max("ks").alias("ks"), F.sum(F.coalesce("w", F.lit(0.0)) + F.col("jump")).alias("w1"), F.max("na").alias("na"), F.max("nb").alias("nb"))


def proportion_difference(df: DataFrame, ds: str, first: str, others: tuple[str, str], columns: list[str]) -> DataFrame:
    """(col, raw, refined): mean absolute difference of shares over the categories of the first two tables."""
    names = (first, *others)
    long = melt(df.where(F.col(ds).isin(*names)), columns, [ds], "string").where("value IS NOT NULL")
    counts = long.groupBy("col", "value").agg(*[F.count(F.when(F.col(ds) == s, 1)).alias(f"n{k}") for k, s in enumerate(names)])
    sizes = counts.groupBy("col").agg(*[F.sum(f"n{k}").alias(f"t{k}") for k in range(3)])
    part = [F.when(F.col(f"t{k}") > 0, F.col(f"n{k}") / F.col(f"t{k}")).otherwise(0.0) for k in range(3)]
    return counts.join(F.broadcast(sizes), "col").where("n0 + n1 > 0").groupBy("col").agg(F.avg(F.abs(part[0] - part[1])).alias("raw"), F.avg(F.abs(part[0] - part[2])).alias("refined"))
