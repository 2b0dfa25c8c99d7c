"""Long frames and cumulative sums that do not gather a column in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

def ranges(df: DataFrame) -> int:
    """Ranges into which a column is cut for cumulative sums: the session's shuffle partitions, so a range is as large as the partition of any other shuffle."""
    return min(max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), 16), 4096)


def place_of(edges: str, n: int, value):
    """How many of the n sorted edges lie below value, found in two steps of about sqrt(n) comparisons."""
    step = max(1, int(n**0.5))
    whole = F.size(F.filter(F.transform(F.sequence(F.lit(step), F.lit(max(n - n % step, step)), F.lit(step)), lambda k: F.get(edges, k - 1)), lambda e: e < value))
    return whole * step + F.size(F.filter(F.slice(edges, whole * step + 1, F.lit(step)), lambda e: e < value))


def melt(df: DataFrame, columns: list[str], keep: list[str], kind: str = "double") -> DataFrame:
    """(keep..., col, value): one row for each column, one shuffle for all of them later; values cast to kind, nulls kept."""
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("col"), F.col(c).cast(kind).alias("value")) for c in columns]))
    return df.select(*keep, pairs.alias("_p")).select(*keep, F.col("_p.col").alias("col"), F.col("_p.value").alias("value"))


def cumulative(df: DataFrame, key: str, value: str, sums: dict[str, str], few_keys: bool = True) -> DataFrame:
    """df with running sums up to and including each row, by key in the order of value; (key, value) must be unique.

    Quantiles of each key's values cut it into ranges(); totals by range (few rows) give offsets, and windows only run inside a range. With few keys (columns,
    tables) the edges, a row for each key, and the offsets, a row for each range, are broadcast, so no join gathers a key's rows.
    """
    n = ranges(df)
    held = F.broadcast if few_keys else lambda t: t
    edges = df.groupBy(key).agg(F.percentile_approx(value, F.array(*[F.lit(k / n) for k in range(1, n)]), F.lit(max(10_000, 20 * n))).alias("_edges"))
    binned = df.join(held(edges), key).withColumn("_bin", place_of("_edges", n - 1, F.col(value))).drop("_edges")
    before = Window.partitionBy(key).orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    totals = binned.groupBy(key, "_bin").agg(*[F.sum(s).alias(f"_t_{o}") for o, s in sums.items()])
    offsets = totals.select(key, "_bin", *[F.coalesce(F.sum(f"_t_{o}").over(before), F.lit(0)).alias(f"_o_{o}") for o in sums])
    inside = Window.partitionBy(key, "_bin").orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    out = binned.join(held(offsets), [key, "_bin"])
    return out.select(*df.columns, "_bin", *[(F.sum(s).over(inside) + F.col(f"_o_{o}")).alias(o) for o, s in sums.items()])


def quantiles(df: DataFrame, by: list[str], value: str, probs: list[float]) -> DataFrame:
    """(by..., q): exact quantiles of value (nulls left out), interpolated between neighbouring ranks, from counts by distinct value and their running sums."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("_n")).withColumn("_key", F.concat_ws("|", F.lit("q"), *by))
    run = cumulative(counts, "_key", value, {"_upto": "_n"})
    sizes = counts.groupBy("_key").agg(F.sum("_n").alias("_size"))
    j = run.join(F.broadcast(sizes), "_key")  # one row for each key
    at = [(F.col("_size") - 1) * F.lit(float(p)) for p in probs]
    rank = lambda r: F.min(F.when(F.col("_upto") > r, F.col(value)))
    ends = [e for k, h in enumerate(at) for e in (rank(F.floor(h)).alias(f"_lo{k}"), rank(F.ceil(h)).alias(f"_hi{k}"))]
    s = j.groupBy("_key", *by).agg(F.max("_size").alias("_size"), *ends)
    between = [F.col(f"_lo{k}") + (h - F.floor(h)) * (F.col(f"_hi{k}") - F.col(f"_lo{k}")) for k, h in enumerate(at)]
    return s.select(*by, F.array(*between).alias("q"))


def ranked(df: DataFrame, value: str, key: str, out: str = "rank") -> DataFrame:
    """df with its 1-based rank by (value, key); key is a number and unique. Neither all rows nor all rows of one value are sorted in one task."""
    n = ranges(df)
    edges = df.agg(F.percentile_approx(key, F.array(*[F.lit(k / n) for k in range(1, n)]), F.lit(max(10_000, 20 * n))).alias("_edges"))
    binned = df.join(F.broadcast(edges)).withColumn("_kbin", place_of("_edges", n - 1, F.col(key))).drop("_edges")  # one row
    cells = binned.groupBy(value, "_kbin").agg(F.count(F.lit(1)).alias("_n"))
    below = cumulative(cells.groupBy(value).agg(F.sum("_n").alias("_n")).withColumn("_all", F.lit("all")), "_all", value, {"_upto": "_n"}).select(value, (F.col("_upto") - F.col("_n")).alias("_below"))
    before = Window.partitionBy(value).orderBy("_kbin").rowsBetween(Window.unboundedPreceding, -1)
    starts = cells.withColumn("_start", F.coalesce(F.sum("_n").over(before), F.lit(0))).join(below, value).select(value, "_kbin", (F.col("_start") + F.col("_below")).alias("_start"))
    inside = Window.partitionBy(value, "_kbin").orderBy(key)
    return binned.join(starts, [value, "_kbin"]).withColumn(out, F.col("_start") + F.row_number().over(inside)).select(*df.columns, out)


def r6(c, digits: int = 6) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, digits) + F.lit(0.0)
