"""Deterministic uniforms from md5, the same in Spark and in ANSI SQL engines, and splits built on them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabsieve.functions.frames import ranges


def md5u(seed: int, *keys) -> Column:
    """Uniform in [0, 1) with 32 bits, from seed and keys."""
    text = F.concat_ws(":", F.lit(str(seed)), *[F.col(k).cast("string") if isinstance(k, str) else k.cast("string") for k in keys])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def md5u_sql(seed: int, key: str) -> str:
    return f"(('0x'||substr(md5('{seed}:'||cast({key} as varchar)),1,8))::ubigint::double/4294967296.0::double)"


def rank_by_uniform(df: DataFrame, u: str, key: str, strata: list[str] | None = None, out: str = "rank") -> DataFrame:
    """1-based rank by (u, key) inside each stratum, without a window over a whole stratum.

    u is cut into equal ranges, as many as shuffle partitions ask for; counts by stratum and range (few rows) give each range its offset, and only the rows of a range are sorted together.
    """
    strata = strata or []
    n = 4 * ranges(df)
    binned = df.withColumn("_bin", F.floor(F.col(u) * n).cast("int"))
    before = Window.partitionBy(*(strata or [F.lit(0)])).orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    offsets = binned.groupBy(*strata, "_bin").agg(F.count(F.lit(1)).alias("_n")).withColumn("_offset", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    offsets = offsets.select(F.col("_bin").alias("_b"), "_offset", *[F.col(c).alias(f"_s{k}") for k, c in enumerate(strata)])
    match = F.col("_bin").eqNullSafe(F.col("_b"))
    for k, c in enumerate(strata):
        match = match & F.col(c).eqNullSafe(F.col(f"_s{k}"))
    joined = binned.join(offsets, match).drop("_b", *[f"_s{k}" for k in range(len(strata))])
    inside = Window.partitionBy(*strata, "_bin").orderBy(u, key)
    return joined.withColumn(out, F.row_number().over(inside) + F.col("_offset")).drop("_bin", "_offset")


def sample_n(df: DataFrame, n, key: str, seed: int) -> DataFrame:
    """n rows without replacement: those with the smallest (uniform, key)."""
    ranked = rank_by_uniform(df.withColumn("_u", md5u(seed, key)), "_u", key, out="_rank")
    return ranked.where(F.col("_rank") <= n).drop("_u", "_rank")


def smallest(df: DataFrame, columns: list[str], key: str, cuts: list[tuple[int, int]]) -> DataFrame:
    """(columns..., c0, c1, ...): for each distinct row of columns, how many of its rows are among the n with the smallest (uniform of seed, key, columns), for each (seed, n) of cuts.

    Several samples of sample_n()'s kind from two passes over df, and no row is shuffled but the few in a cut's own range of uniforms: a first pass counts rows by range,
    a second one counts equal points whose range lies below the cut's. Rows equal in key and columns count as often as they occur.
    """
    bins, seeds = 64 * ranges(df), sorted({s for s, _ in cuts})
    spark, bin_of = df.sparkSession, lambda u: F.floor(u * bins).cast("int")
    found: dict[int, tuple[int, int]] = {}
    if cuts:
        sides = F.explode(F.array(*[F.struct(F.lit(s).cast("long").alias("seed"), bin_of(md5u(s, key)).alias("bin")) for s in seeds]))
        counts = df.select(sides.alias("r")).groupBy("r.seed", "r.bin").agg(F.count(F.lit(1)).alias("n"))
        run = counts.withColumn("upto", F.sum("n").over(Window.partitionBy("seed").orderBy("bin")))  # a row for each range
        wanted = spark.createDataFrame([(i, s, n) for i, (s, n) in enumerate(cuts)], "cut int, seed long, wanted long")
        inside = run.join(F.broadcast(wanted), "seed").where("upto >= wanted AND upto - n < wanted")
        found = {r["cut"]: (r["bin"], r["wanted"] - r["upto"] + r["n"]) for r in inside.collect()}  # a row for each cut
    # (range of the cut, rows of that range to take); beyond all rows, or before the first
    at = [found.get(i, (bins, 0) if n > 0 else (-1, 0)) for i, (_, n) in enumerate(cuts)]
    u = {s: f"_u{k}" for k, s in enumerate(seeds)}
    drawn = df.select(*columns, F.coalesce(F.col(key).cast("string"), F.lit("")).alias("_k"), *[md5u(s, key).alias(c) for s, c in u.items()])
    on = [bin_of(F.col(u[s])) == b for (s, _), (b, _) in zip(cuts, at)]
    edge = F.lit(False)
    for o in on:
        edge = edge | o
    full = [F.sum((bin_of(F.col(u[s])) < b).cast("long")).alias(f"c{i}") for i, ((s, _), (b, _)) in enumerate(zip(cuts, at))]
    cells = drawn.withColumn("_e", F.when(edge, F.struct("_k", *u.values()))).groupBy(*columns, "_e").agg(F.count(F.lit(1)).alias("_n"), *full).persist()
    one = F.explode(F.array_compact(F.array(F.lit(None).cast("struct<cut:int,u:double,take:long>"), *[F.when(o, F.struct(F.lit(i).alias("cut"), F.col(u[s]).alias("u"), F.lit(t).cast("long").alias("take"))) for i, (o, (s, _), (_, t)) in enumerate(zip(on, cuts, at))])))
    rows = cells.where("_e IS NOT NULL").select(*columns, "_e.*", "_n").select(*columns, "_k", "_n", one.alias("_r"))
    before = Window.partitionBy("_r.cut").orderBy("_r.u", "_k", *columns).rowsBetween(Window.unboundedPreceding, -1)
    take = F.greatest(F.least(F.col("_n"), F.col("_r.take") - F.coalesce(F.sum("_n").over(before), F.lit(0))), F.lit(0))
    taken = rows.withColumn("_t", take).select(*columns, *[F.when(F.col("_r.cut") == i, F.col("_t")).otherwise(0).alias(f"c{i}") for i in range(len(cuts))])
    out = cells.select(*columns, *[f"c{i}" for i in range(len(cuts))]).unionByName(taken).groupBy(*columns).agg(*[F.sum(f"c{i}").alias(f"c{i}") for i in range(len(cuts))])
    # so few points that models go over them again and again in few tasks
    out = out.coalesce(max(1, -(-cells.count() // 50_000))).sortWithinPartitions(*columns).persist()
    out.count()
    cells.unpersist()
    return out


def stratified_split(df: DataFrame, label: str, key: str, share: float, seed: int) -> DataFrame:
    """df with `split`: 'test' for round(share * size) rows of each class, else 'train'."""
    ranked = rank_by_uniform(df.withColumn("_u", md5u(seed, key)), "_u", key, [label], "_rank")
    sizes = df.groupBy(F.col(label).alias("_label")).agg(F.count(F.lit(1)).alias("_size"))
    out = ranked.join(sizes, F.col(label).eqNullSafe(F.col("_label"))).drop("_label")
    return out.withColumn("split", F.when(F.col("_rank") <= F.floor(F.col("_size") * F.lit(share) + 0.5), "test").otherwise("train")).drop("_u", "_rank", "_size")


def kfold(df: DataFrame, label: str, key: str, folds: int, seed: int) -> DataFrame:
    """df with `fold`: 0..folds-1, balanced inside each class."""
    ranked = rank_by_uniform(df.withColumn("_u", md5u(seed, key)), "_u", key, [label], "_rank")
    return ranked.withColumn("fold", F.pmod(F.col("_rank") - 1, F.lit(folds)).cast("int")).drop("_u", "_rank")
