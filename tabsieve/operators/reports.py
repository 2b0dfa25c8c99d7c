"""Comparison tables of metrics and composed reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def metric_class(name):
    """What stands before the first dot; 'other' without a dot."""
    return F.when(F.instr(name, ".") > 0, F.substring_index(name, ".", 1)).otherwise("other")


def compare_metrics(baseline: DataFrame, refined: DataFrame) -> DataFrame:
    """(cls, better, worse, unchanged, rate): metrics in both tables (metric, mean, direction), by class; rate is the share that is better."""
    j = baseline.select("metric", "direction", F.col("mean").alias("b")).join(refined.select("metric", F.col("mean").alias("r")), "metric")
    gain = F.when(F.col("direction") == "maximize", F.col("r") - F.col("b")).otherwise(F.col("b") - F.col("r"))
    s = j.groupBy(metric_class(F.col("metric")).alias("cls")).agg(F.count(F.when(gain > 0, 1)).alias("better"), F.count(F.when(gain < 0, 1)).alias("worse"), F.count(F.when(gain == 0, 1)).alias("unchanged"), F.count(F.lit(1)).alias("n"))
    return s.select("cls", "better", "worse", "unchanged", (F.col("better") / F.col("n")).alias("rate"))


def detailed_metrics(baseline: DataFrame, refined: DataFrame) -> DataFrame:
    """(metric, baseline, refined, improvement, percent, is_better); any direction but maximize counts as minimize, percent is 0 where the baseline is 0."""
    j = baseline.select("metric", "direction", F.col("mean").alias("baseline")).join(refined.select("metric", F.col("mean").alias("refined")), "metric")
    gain = F.when(F.col("direction") == "maximize", F.col("refined") - F.col("baseline")).otherwise(F.col("baseline") - F.col("refined"))
    return j.select("metric", "baseline", "refined", gain.alias("improvement"), F.when(F.col("baseline") == 0, 0.0).otherwise(gain / F.abs("baseline") * 100).alias("percent"), F.coalesce(gain > 0, F.lit(False)).alias("is_better"))


def describe_improvement(moments: DataFrame, ds: str, real: str, raw: str, refined: str) -> DataFrame:
    """(col, stat, improvement): (|raw - real| - |refined - real|) / |raw - real| for mean, std and median; 0 where undefined. moments has sample std as std."""
    stats = ("mean", "std", "median")
    side = lambda s, k: moments.where(F.col(ds) == s).select("col", *[F.col(c).alias(f"{c}_{k}") for c in stats])
    j = side(real, 0).join(side(raw, 1), "col").join(side(refined, 2), "col")
    gap = lambda c, k: F.abs(F.col(f"{c}_{k}") - F.col(f"{c}_0"))
    rows = F.explode(F.array(*[F.struct(F.lit(c).alias("stat"), F.coalesce(F.when(gap(c, 1) != 0, (gap(c, 1) - gap(c, 2)) / gap(c, 1)), F.lit(0.0)).alias("improvement")) for c in stats]))
    return j.select("col", rows.alias("r")).select("col", "r.*")


def correlation_improvement(correlations: DataFrame, ds: str, real: str, raw: str, refined: str) -> DataFrame:
    """(x, y, improvement): |real - raw| - |real - refined|."""
    side = lambda s, k: correlations.where(F.col(ds) == s).select("x", "y", F.col("r").alias(f"r{k}"))
    j = side(real, 0).join(side(raw, 1), ["x", "y"]).join(side(refined, 2), ["x", "y"])
    return j.select("x", "y", (F.abs(F.col("r0") - F.col("r1")) - F.abs(F.col("r0") - F.col("r2"))).alias("improvement"))


def retention(df: DataFrame, ds: str, raw: str, refined: str) -> DataFrame:
    one = df.agg(F.count(F.when(F.col(ds) == raw, 1)).alias("n_raw"), F.count(F.when(F.col(ds) == refined, 1)).alias("n_refined"))
    return one.withColumn("rate", F.when(F.col("n_raw") > 0, F.col("n_refined") / F.col("n_raw")))


#: Metric, data type, distribution type, direction.
SIMILARITY = (
    ("js_marginal", "all", "marginal", "lower"),
    ("js_joint", "categorical", "joint", "lower"),
    ("ks_complement", "numerical", "marginal", "higher"),
    ("wasserstein_joint", "numerical", "joint", "lower"),
    ("mmd", "numerical", "joint", "lower"),
    ("inverse_kl", "all", "marginal", "higher"),
    ("chi2_p", "categorical", "marginal", "higher"),
    ("tvd", "categorical", "marginal", "lower"),
    ("hellinger", "categorical", "marginal", "lower"),
)


def similarity_report(df: DataFrame, ds: str, real: str, raw: str, refined: str, categorical: list[str], numeric: list[str], key: str, metrics: list[str] | None = None, most_transport: int = 5_000) -> DataFrame:
    """(metric, data_type, distribution_type, raw, refined, improved): the registry of distances for both candidates."""
    from tabsieve.functions import special
    from tabsieve.operators import divergence as D
    from tabsieve.operators import moments as M
    from tabsieve.operators.hypothesis import with_p

    known = [m[0] for m in SIMILARITY]
    wanted = known if metrics is None else [m for m in metrics if m in known]
    if not wanted:
        raise ValueError(f"no known metric among {metrics}; known: {known}")
    parts = []
    for name in (raw, refined):
        freq = D.frequencies(df, ds, real, name, categorical) if categorical else None
        binned = D.frequencies_binned(df, ds, real, name, numeric) if numeric else None
        out = {}
        if freq is not None:
            m = with_p(D.marginal_distances(freq), "p", special.chi2_sf, "chi2", "df").agg(*[F.avg(c).alias(c) for c in ("js", "inverse_kl", "tvd", "hellinger", "p")])
            out |= {"tvd": m.select("tvd"), "hellinger": m.select("hellinger"), "chi2_p": m.select("p"), "js_joint": D.joint_js(df, ds, real, name, categorical)}
        if binned is not None:
            cdf = D.cdf_distances(D.cdf_frame(df, ds, real, name, numeric))
            scaled = M.min_max(df, ds, real, numeric)
            out |= {"ks_complement": cdf.agg(F.avg(1 - F.col("ks"))), "mmd": M.mmd_rbf(scaled, ds, real, name, numeric), "wasserstein_joint": M.sinkhorn(df, ds, real, name, numeric, key, most=most_transport)}
        both = [f for f in (freq.withColumn("bucket", F.col("bucket").cast("string")) if freq is not None else None, binned.withColumn("bucket", F.col("bucket").cast("string")) if binned is not None else None) if f is not None]
        if both:
            m = D.marginal_distances(both[0] if len(both) == 1 else both[0].unionByName(both[1])).agg(F.avg("js").alias("js"), F.avg("inverse_kl").alias("kl"))
            out |= {"js_marginal": m.select("js"), "inverse_kl": m.select("kl")}
        for k in wanted:
            if k in out:
                parts.append(out[k].toDF("value").withColumns({"metric": F.lit(k), "candidate": F.lit("raw" if name == raw else "refined")}))
    long = parts[0]
    for p in parts[1:]:
        long = long.unionByName(p)
    facts = df.sparkSession.createDataFrame(SIMILARITY, "metric string, data_type string, distribution_type string, direction string")
    wide = long.where(~F.isnan("value")).groupBy("metric").agg(*[F.max(F.when(F.col("candidate") == c, F.col("value"))).alias(c) for c in ("raw", "refined")])
    better = F.when(F.col("direction") == "lower", F.col("refined") < F.col("raw")).otherwise(F.col("refined") > F.col("raw"))
    return wide.join(F.broadcast(facts), "metric").select("metric", "data_type", "distribution_type", "raw", "refined", better.alias("improved"))


def comprehensive(privacy: DataFrame, preserved: DataFrame, gap: DataFrame, marginal: DataFrame, n_selected: int, n_pool: int) -> DataFrame:
    """One row: privacy metrics, weight preservation, correlation gap, mean marginal distances, trade-off (1 - ratio) * mean_ratio, selection share."""
    m = marginal.agg(F.avg("ks").alias("ks_mean"), F.max("ks").alias("ks_max"), F.avg("w1").alias("w1_mean"), F.max("w1").alias("w1_max"))
    one = privacy.crossJoin(preserved).crossJoin(gap).crossJoin(m)  # tables of one row
    share = n_selected / n_pool if n_pool else None
    return one.withColumn("tradeoff", (1 - F.col("ratio")) * F.col("mean_ratio")).withColumn("selection_share", F.lit(share).cast("double"))
