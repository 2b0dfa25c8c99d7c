"""Sampling-importance-resampling, plain and under an identifiability budget.

Draws are hash uniforms, so a draw is the same on every run and in every engine. Weights become integers (the largest is SCALE), and draw j takes the row
whose interval of the running sum holds floor(u_j * total). Running sums come in two levels (ranges of the key, offsets of the ranges). Intervals and
targets meet in an equi-join on buckets of about one draw each; an interval spans at most as many buckets as it is wide, pool + draws rows in all.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabsieve.functions.frames import cumulative, ranked
from tabsieve.functions.rng import md5u

SCALE = 1e9
INVERSE_EPS = 1e-10


def intervals(pool: DataFrame, key: str, w: str) -> tuple[DataFrame, int]:
    """(key, lo, hi) integer intervals of the running weight in key order, and the total."""
    top = pool.agg(F.max(w)).first()[0]
    if not top or top <= 0:
        return pool.select(key, F.lit(0).cast("long").alias("lo"), F.lit(0).cast("long").alias("hi")).limit(0), 0
    scaled = pool.select(F.col(key), F.floor(F.col(w) / F.lit(top) * F.lit(SCALE) + 0.5).cast("long").alias("_w")).where("_w > 0").withColumn("_all", F.lit("all"))
    run = cumulative(scaled, "_all", key, {"hi": "_w"})
    total = scaled.agg(F.sum("_w")).first()[0] or 0
    return run.select(key, (F.col("hi") - F.col("_w")).alias("lo"), "hi"), int(total)


def draws(pool: DataFrame, key: str, w: str, n: int, seed: int) -> DataFrame:
    """(draw, key): n rows with replacement, with probabilities in proportion to w."""
    spark = pool.sparkSession
    spans, total = intervals(pool, key, w)
    if not total or not n:
        return spark.range(0).select(F.col("id").alias("draw")).join(spans.select(key).limit(0))
    width = max(1, -(-total // max(n, 1)))
    targets = spark.range(n).select(F.col("id").alias("draw"), F.floor(md5u(seed, "id") * F.lit(float(total))).cast("long").alias("t")).withColumn("bucket", F.floor(F.col("t") / width))
    spread = spans.withColumn("bucket", F.explode(F.sequence(F.floor(F.col("lo") / width), F.floor((F.col("hi") - 1) / width))))
    return targets.join(spread, "bucket").where("t >= lo AND t < hi").select("draw", key)


def sir(pool: DataFrame, key: str, w: str, n: int, method: str = "weighted", seed: int = 42) -> DataFrame:
    """(draw, key) by importance: weighted, reverse_weighted, top_k or reverse_top_k (ties by key)."""
    if method == "weighted":
        return draws(pool, key, w, n, seed)
    if method == "reverse_weighted":
        return draws(pool.withColumn("_inv", 1.0 / (F.col(w) + INVERSE_EPS)), key, "_inv", n, seed)
    if method in ("top_k", "reverse_top_k"):
        order = -F.col(w) if method == "top_k" else F.col(w)
        return ranked(pool.select(key, order.cast("double").alias("_w")), "_w", key).where(F.col("rank") <= n).select((F.col("rank") - 1).cast("long").alias("draw"), key)
    raise ValueError(f"unknown method: {method}")


def sir_ic(pool: DataFrame, key: str, w: str, flag: str, n: int, epsilon: float = 0.05, seed: int = 42) -> DataFrame:
    """(draw, key, flag) with at most floor(epsilon * n) identifiable rows while there are others to take.

    Stream A draws from all rows, stream C from the rows that are not identifiable; A's draw holds until the budget is used up, C's from then on.
    Without rows of the second kind A's draws hold throughout.
    """
    budget = int(epsilon * n + 1e-9)
    marked = pool.select(key, F.col(flag).alias("flag"))
    a = draws(pool, key, w, n, seed).join(marked, key).withColumnRenamed(key, "_a")
    c = draws(pool.where(F.col(flag) == 0), key, w, n, seed + 1).withColumnRenamed(key, "_c")
    # running count of identifiable draws of A: two-level sums in draw order
    used = cumulative(a.withColumn("_all", F.lit("all")), "_all", "draw", {"upto": "flag"}).select("draw", "_a", "flag", (F.col("upto") - F.col("flag")).alias("before"))
    both = used.join(c, "draw", "left")
    take = (F.col("before") < budget) | F.col("_c").isNull()
    return both.select("draw", F.when(take, F.col("_a")).otherwise(F.col("_c")).alias(key), F.when(take, F.col("flag")).otherwise(F.lit(0)).alias("flag"))


def sample(pool: DataFrame, key: str, w: str, n: int, method: str = "weighted", flag: str | None = None, constrained: bool = False, epsilon: float = 0.05, seed: int = 42) -> DataFrame:
    """Dispatch: a constraint means sir_ic, whatever the method."""
    if constrained:
        if flag is None:
            raise ValueError("the constraint needs flags")
        return sir_ic(pool, key, w, flag, n, epsilon, seed)
    return sir(pool, key, w, n, method, seed)


def statistics(taken: DataFrame, pool: DataFrame, flag: str = "flag", epsilon: float = 0.05) -> DataFrame:
    """Selected rows, identifiable ones and their share (null without rows), pool sizes, whether the budget was exceeded."""
    t = taken.agg(F.count(F.lit(1)).alias("selected"), F.coalesce(F.sum(flag), F.lit(0)).cast("long").alias("identifiable"))
    p = pool.agg(F.count(F.lit(1)).alias("pool"), F.coalesce(F.sum(flag), F.lit(0)).cast("long").alias("pool_identifiable"))
    out = t.crossJoin(p)  # one row each
    return out.withColumn("share", F.when(F.col("selected") > 0, F.col("identifiable") / F.col("selected"))).withColumn("exceeded", F.col("identifiable") > F.floor(F.col("selected") * F.lit(epsilon) + 1e-9))
