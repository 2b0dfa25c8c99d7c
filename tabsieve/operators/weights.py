"""Density-ratio weights from probabilities, weight processing, calibration and ranking quality."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabsieve.functions.frames import cumulative, quantiles


def importance(p: Column, kappa: float, eps: float = 1e-9) -> Column:
    """kappa * p / (1 - p), with p kept inside [eps, 1 - eps]."""
    q = F.least(F.greatest(p, F.lit(eps)), F.lit(1 - eps))
    return F.lit(kappa) * q / (1 - q)


def processed(w: Column, method: str = "raw", alpha: float = 1.0, min_clip: float = 1e-9) -> Column:
    if method == "raw":
        return w
    if method == "flatten":
        return F.pow(w, F.lit(alpha))
    if method == "clipped":
        return F.greatest(w, F.lit(min_clip))
    raise ValueError(f"unknown weight processing: {method}")


def processing_effects(df: DataFrame, w: str = "w", alphas=(0.5, 0.8, 1.0, 1.2, 1.5), clips=(1e-6, 1e-4, 1e-2, 0.1)) -> DataFrame:
    """(setting, mean, std, var) of the weights under each setting: one pass, one small row per setting and task."""
    made = [("raw", processed(F.col(w)))] + [(f"flatten_{a:g}", processed(F.col(w), "flatten", a)) for a in alphas] + [(f"clipped_{c:g}", processed(F.col(w), "clipped", min_clip=c)) for c in clips]
    rows = df.select(F.explode(F.array(*[F.struct(F.lit(n).alias("setting"), e.cast("double").alias("v")) for n, e in made])).alias("r")).select("r.*")
    return rows.groupBy("setting").agg(F.avg("v").alias("mean"), F.stddev_pop("v").alias("std"), F.var_pop("v").alias("var"))


def median(df: DataFrame, w: str) -> DataFrame:
    """(median): one row."""
    return quantiles(df, [], w, [0.5]).agg(F.max(F.get("q", F.lit(0))).alias("median"))


def preservation(original: DataFrame, selected: DataFrame, w: str = "w") -> DataFrame:
    """Means and deviations of weights before and after selection, their ratio, and the share of selected above the original median."""
    a = original.agg(F.avg(w).alias("mean"), F.stddev_pop(w).alias("std")).join(F.broadcast(median(original, w)))  # one row each
    joined = selected.select(F.col(w).alias("s")).join(F.broadcast(a))  # one row
    return joined.groupBy("mean", "std").agg(F.avg("s").alias("selected_mean"), F.stddev_pop("s").alias("selected_std"), F.avg((F.col("s") > F.col("median")).cast("double")).alias("above_median")).withColumn("mean_ratio", F.when(F.col("mean") != 0, F.col("selected_mean") / F.col("mean")))


def calibration_curve(df: DataFrame, p: str, y: str, bins: int = 10) -> DataFrame:
    """(bin, n, mean_p, share): mean prediction and share of positives in each uniform bin."""
    return df.groupBy(F.least(F.floor(F.col(p) * bins), F.lit(bins - 1)).cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.avg(p).alias("mean_p"), F.avg(F.col(y).cast("double")).alias("share"))


def auc(df: DataFrame, score: str, y: str) -> DataFrame:
    """Area under the ROC curve, ties counted half, from counts by distinct score: sum over scores of pos * (neg below + neg here / 2)."""
    counts = df.groupBy(F.lit("s").alias("col"), F.col(score).alias("value")).agg(F.sum(F.col(y).cast("long")).alias("pos"), F.sum(1 - F.col(y).cast("long")).alias("neg"))
    run = cumulative(counts, "col", "value", {"upto": "neg"})
    pairs = F.sum("pos") * F.sum("neg")
    return run.agg(F.when(pairs > 0, F.sum(F.col("pos") * (F.col("upto") - F.col("neg") / 2)) / pairs).alias("auc"), F.sum("pos").alias("n_pos"), F.sum("neg").alias("n_neg"))


def confusion(df: DataFrame, label: str, predicted: str) -> DataFrame:
    return df.groupBy(F.col(label).alias("label"), F.col(predicted).alias("predicted")).agg(F.count(F.lit(1)).alias("n"))


def classification_report(df: DataFrame, label: str, predicted: str) -> DataFrame:
    """(cls, precision, recall, f1, support) for each class that occurs as label or prediction."""
    c = confusion(df, label, predicted)
    rows = c.select(F.explode(F.array(F.struct(F.col("label").alias("cls"), F.col("n").alias("a"), F.lit(0).cast("long").alias("b"), F.when(F.col("label") == F.col("predicted"), F.col("n")).otherwise(0).alias("hit")), F.struct(F.col("predicted").alias("cls"), F.lit(0).cast("long").alias("a"), F.col("n").alias("b"), F.lit(0).cast("long").alias("hit")))).alias("r")).select("r.*")
    s = rows.groupBy("cls").agg(F.sum("a").alias("support"), F.sum("b").alias("guessed"), F.sum("hit").alias("hit"))
    div = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(0.0)
    s = s.withColumns({"precision": div("hit", "guessed"), "recall": div("hit", "support")})
    f1 = F.when(F.col("support") + F.col("guessed") > 0, 2 * F.col("hit") / (F.col("support") + F.col("guessed"))).otherwise(0.0)
    return s.select("cls", "precision", "recall", f1.alias("f1"), "support")


def top_share(df: DataFrame, w: str) -> DataFrame:
    """min, max, mean, median of the weights."""
    return df.agg(F.min(w).alias("min"), F.max(w).alias("max"), F.avg(w).alias("mean")).join(F.broadcast(median(df, w)))  # one row each


def histogram(df: DataFrame, column: str, bins: int = 50, by: list[str] | None = None) -> DataFrame:
    """(by..., bin, n): equal-width bins over the column's range, the last one closed; empty bins are left out."""
    by = by or []
    span = df.agg(F.min(column).alias("_lo"), F.max(column).alias("_hi"))
    width = F.when(F.col("_hi") > F.col("_lo"), (F.col(column) - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * bins).otherwise(F.lit(bins / 2.0))
    return df.where(F.col(column).isNotNull()).join(F.broadcast(span)).groupBy(*by, F.least(F.floor(width), F.lit(bins - 1)).cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))  # span is one row


def top_categories(df: DataFrame, by: str, column: str, k: int = 10) -> DataFrame:
    """(by, value, n, share): the k most frequent values on each side, shares of the side's rows."""
    counts = df.where(F.col(column).isNotNull()).groupBy(by, F.col(column).cast("string").alias("value")).agg(F.count(F.lit(1)).alias("n"))
    sizes = df.groupBy(by).agg(F.count(F.lit(1)).alias("_size"))
    ranked = counts.withColumn("_r", F.row_number().over(Window.partitionBy(by).orderBy(F.desc("n"), "value"))).where(F.col("_r") <= k)
    return ranked.join(sizes, by).select(by, "value", "n", (F.col("n") / F.col("_size")).alias("share"))
