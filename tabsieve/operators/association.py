"""Association between columns: Cramer's V, correlation ratio, Pearson, Spearman, Kendall, mutual information, and mixed matrices as long frames."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabsieve.functions.frames import cumulative, melt

#: Ranks in a block that one window may take, in kendall().
SMALL_BLOCK = 4096


def pair_counts(df: DataFrame, columns: list[str], by: str) -> DataFrame:
    """(by, x, y, vx, vy, n) of all pairs x before y: one aggregate over exploded pairs; rows with a null in the pair are left out."""
    pairs = [(a, b) for i, b in enumerate(columns) for a in columns[:i]]
    rows = F.explode(F.array(*[F.struct(F.lit(a).alias("x"), F.lit(b).alias("y"), F.col(a).cast("string").alias("vx"), F.col(b).cast("string").alias("vy")) for a, b in pairs]))
    return df.select(by, rows.alias("r")).select(by, "r.*").where("vx IS NOT NULL AND vy IS NOT NULL").groupBy(by, "x", "y", "vx", "vy").agg(F.count(F.lit(1)).alias("n"))


def _with_margins(counts: DataFrame, by: list[str]) -> DataFrame:
    rows, cols = counts.groupBy(*by, "vx").agg(F.sum("n").alias("nr")), counts.groupBy(*by, "vy").agg(F.sum("n").alias("nc"))
    total = counts.groupBy(*by).agg(F.sum("n").alias("nn"), F.count_distinct("vx").alias("r"), F.count_distinct("vy").alias("c"))
    return counts.join(rows, [*by, "vx"]).join(cols, [*by, "vy"]).join(total, by)


def contingency(counts: DataFrame, by: list[str]) -> DataFrame:
    """(by..., chi2, df, n, r, c): independence statistic, with Yates's correction for 2 x 2 tables.

    Without correction chi2 = n (sum O^2 / (R C) - 1), so empty cells need no rows; a 2 x 2 table is sum (|O - E| - min(0.5, |O - E|))^2 / E over four
    cells with one |O - E|, which any one cell gives.
    """
    m = _with_margins(counts, by)
    e = F.col("nr") * F.col("nc") / F.col("nn")
    s = m.groupBy(*by).agg(
        F.sum(F.col("n") * F.col("n") / (F.col("nr") * F.col("nc"))).alias("s"),
        F.max("nn").alias("n"),
        F.max("r").alias("r"),
        F.max("c").alias("c"),
        F.max(F.abs(F.col("n") - e)).alias("gap"),
        F.min(F.struct("vx", "vy", "nr", "nc")).alias("one"),
    )
    two = (F.col("r") == 2) & (F.col("c") == 2)
    corrected = F.col("gap") - F.least(F.lit(0.5), F.col("gap"))
    a, b, t = F.col("one.nr"), F.col("one.nc"), F.col("n")
    inverse = t / (a * b) + t / (a * (t - b)) + t / ((t - a) * b) + t / ((t - a) * (t - b))
    chi2 = F.when(two, corrected * corrected * inverse).otherwise(F.greatest(t * (F.col("s") - 1), F.lit(0.0)))
    return s.select(*by, chi2.alias("chi2"), ((F.col("r") - 1) * (F.col("c") - 1)).alias("df"), "n", "r", "c")


def cramers_v(df: DataFrame, columns: list[str], by: str) -> DataFrame:
    """(by, x, y, v) for each pair of categorical columns."""
    t = contingency(pair_counts(df, columns, by), [by, "x", "y"])
    return t.select(by, "x", "y", F.sqrt(F.col("chi2") / (F.col("n") * (F.least("r", "c") - 1) + F.lit(1e-16))).alias("v"))


def eta_squared(df: DataFrame, categorical: list[str], numeric: list[str], by: str) -> DataFrame:
    """(by, cat, num, eta2): between-group share of the sum of squares; null categories count in the total only, 0 if a part is 0."""
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("cat"), F.lit(m).alias("num"), F.col(c).cast("string").alias("g"), F.col(m).cast("double").alias("v")) for c in categorical for m in numeric]))
    long = df.select(by, pairs.alias("r")).select(by, "r.*")
    groups = long.groupBy(by, "cat", "num", "g").agg(F.count("v").alias("n"), F.avg("v").alias("m"), F.var_pop("v").alias("s2"))
    whole = groups.groupBy(by, "cat", "num").agg((F.sum(F.col("n") * F.col("m")) / F.sum("n")).alias("mean"))
    j = groups.join(whole, [by, "cat", "num"])
    d = F.col("m") - F.col("mean")
    s = j.groupBy(by, "cat", "num").agg(F.sum(F.when(F.col("g").isNotNull(), F.col("n") * d * d)).alias("between"), F.sum(F.col("n") * (F.col("s2") + d * d)).alias("total"))
    return s.select(by, "cat", "num", F.when((F.col("between") > 0) & (F.col("total") > 0), F.col("between") / F.col("total")).otherwise(0.0).alias("eta2"))


def _number_pairs(df: DataFrame, columns: list[str], by: str) -> DataFrame:
    pairs = [(a, b) for i, b in enumerate(columns) for a in columns[:i]]
    rows = F.explode(F.array(*[F.struct(F.lit(a).alias("x"), F.lit(b).alias("y"), F.col(a).cast("double").alias("vx"), F.col(b).cast("double").alias("vy")) for a, b in pairs]))
    return df.select(by, rows.alias("r")).select(by, "r.*").where("vx IS NOT NULL AND vy IS NOT NULL")


def _correlations(df: DataFrame, columns: list[str], by: str, most: int = 200) -> DataFrame:
    """(by, x, y, r): one aggregate of all pairs (most at a time), without a row for each pair of values."""
    pairs = [(a, b) for i, b in enumerate(columns) for a in columns[:i]]
    out = None
    for at in range(0, len(pairs), most):
        part = pairs[at : at + most]
        one = df.groupBy(by).agg(*[F.corr(F.col(a).cast("double"), F.col(b).cast("double")).alias(f"r{k}") for k, (a, b) in enumerate(part)])
        rows = F.explode(F.array(*[F.struct(F.lit(a).alias("x"), F.lit(b).alias("y"), F.col(f"r{k}").alias("r")) for k, (a, b) in enumerate(part)]))
        t = one.select(by, rows.alias("p")).select(by, "p.*")
        out = t if out is None else out.unionByName(t)
    return out


def pearson(df: DataFrame, columns: list[str], by: str) -> DataFrame:
    """(by, x, y, r), pairwise complete; null where undefined."""
    return _correlations(df, columns, by).withColumn("r", F.nanvl("r", F.lit(None).cast("double")))


def spearman(df: DataFrame, columns: list[str], by: str) -> DataFrame:
    """(by, x, y, r) on average ranks of each column's values.

    Ranks are found once for each column from counts by distinct value and put back on the rows (rows times columns in all), then correlated in one aggregate.
    """
    long = melt(df.select(by, *columns).withColumn("_row", F.monotonically_increasing_id()), columns, ["_row", by]).where("value IS NOT NULL")
    counts = melt(df, columns, [by]).where("value IS NOT NULL").withColumn("key", F.concat_ws("|", by, "col")).groupBy("key", by, "col", "value").agg(F.count(F.lit(1)).alias("n"))
    ranks = cumulative(counts, "key", "value", {"upto": "n"}).select(by, "col", "value", (F.col("upto") - (F.col("n") - 1) / 2).alias("rank"))
    wide = long.join(ranks, [by, "col", "value"]).groupBy("_row", by).agg(*[F.max(F.when(F.col("col") == c, F.col("rank"))).alias(c) for c in columns])
    return pearson(wide, columns, by)


def kendall(df: DataFrame, columns: list[str], by: str) -> DataFrame:
    """(by, x, y, tau) tau-b, exact, without gathering a pair of columns in one task.

    Distinct points get the dense rank of their x. Two points of different x differ first in one bit of their ranks; at that bit's level they lie in the same
    block, one in its left and one in its right half. So each level counts, by running sums over y inside its blocks, the left points below and above each
    right point: ranks' bits times distinct points rows in all. Blocks of at most SMALL_BLOCK ranks take one window each, larger ones two-level sums.
    """
    joint = _number_pairs(df, columns, by).groupBy(by, "x", "y", "vx", "vy").agg(F.count(F.lit(1)).alias("n")).withColumn("key", F.concat_ws("|", by, "x", "y"))
    xs = joint.select("key", "vx").distinct().withColumn("one", F.lit(1).cast("long"))
    rank = cumulative(xs, "key", "vx", {"rank": "one"}).select("key", "vx", (F.col("rank") - 1).alias("rank"))
    levels = int(rank.agg(F.max("rank")).first()[0] or 0).bit_length()
    split = min(levels, SMALL_BLOCK.bit_length() - 1)
    points = joint.join(rank, ["key", "vx"]).select("key", by, "x", "y", "vy", "rank", "n")

    def halves(first: int, end: int) -> DataFrame:
        level = F.explode(F.sequence(F.lit(first), F.lit(end - 1)))
        rows = points.withColumn("level", level).withColumn("block", F.concat_ws("|", "key", "level", F.expr("shiftright(rank, level + 1)")))
        right = F.expr("shiftright(rank, level) % 2 = 1")
        return rows.groupBy("key", "block", "vy").agg(F.sum(F.when(~right, F.col("n")).otherwise(0)).alias("l"), F.sum(F.when(right, F.col("n")).otherwise(0)).alias("r"))

    def counted(c: DataFrame) -> DataFrame:
        """Pairs (concordant, discordant) by key from rows with the running sum of the left half."""
        totals = c.groupBy("block").agg(F.sum("l").alias("left"))
        return c.join(totals, "block").groupBy("key").agg(F.sum(F.col("r") * (F.col("upto") - F.col("l"))).alias("con"), F.sum(F.col("r") * (F.col("left") - F.col("upto"))).alias("dis"))

    parts = []
    if split:
        w = Window.partitionBy("block").orderBy("vy").rowsBetween(Window.unboundedPreceding, 0)
        parts.append(counted(halves(0, split).withColumn("upto", F.sum("l").over(w))))
    if levels > split:
        parts.append(counted(cumulative(halves(split, levels), "block", "vy", {"upto": "l"}, few_keys=False)))
    empty = points.select("key").limit(0).select("key", F.lit(0).cast("long").alias("con"), F.lit(0).cast("long").alias("dis"))
    for p in parts:
        empty = empty.unionByName(p)
    pairs = empty.groupBy("key").agg(F.sum("con").alias("con"), F.sum("dis").alias("dis"))
    c2 = lambda c: F.sum(F.col(c) * (F.col(c) - 1) / 2)
    whole = joint.groupBy("key", by, "x", "y").agg(F.sum("n").alias("n"))
    tx = joint.groupBy("key", "vx").agg(F.sum("n").alias("n")).groupBy("key").agg(c2("n").alias("tx"))
    ty = joint.groupBy("key", "vy").agg(F.sum("n").alias("n")).groupBy("key").agg(c2("n").alias("ty"))
    all_ = F.col("n") * (F.col("n") - 1) / 2
    out = whole.join(tx, "key").join(ty, "key").join(pairs, "key", "left")
    den = F.sqrt((all_ - F.col("tx")) * (all_ - F.col("ty")))
    return out.select(by, "x", "y", F.when(den > 0, (F.coalesce("con", F.lit(0)) - F.coalesce("dis", F.lit(0))) / den).alias("tau"))


def mutual_information(df: DataFrame, columns: list[str], by: str) -> DataFrame:
    """(by, x, y, mi) of discrete columns, in nats."""
    m = _with_margins(pair_counts(df, columns, by), [by, "x", "y"])
    p = F.col("n") / F.col("nn")
    return m.groupBy(by, "x", "y").agg(F.sum(p * F.log(F.col("n") * F.col("nn") / (F.col("nr") * F.col("nc")))).alias("mi"))


#: Rows of a table up to which the neighbour estimates of mutual information use every row; more are sampled down to it.
KNN_ROWS = 200_000


def _digamma(v):
    """Of numbers above 0, by recurrence and series."""
    v = np.asarray(v, float)
    out = np.zeros_like(v)
    while (v < 6).any():
        low = v < 6
        out = np.where(low, out - 1 / np.where(low, v, 1), out)
        v = np.where(low, v + 1, v)
    return out + np.log(v) - 1 / (2 * v) - 1 / (12 * v**2) + 1 / (120 * v**4) - 1 / (252 * v**6)


def _held_rows(df: DataFrame, columns: list[str], key: str, most: int, seed: int, kinds: dict[str, str]) -> tuple:
    """The rows (nulls left out) as arrays: numbers scaled by their sample deviation, classes as codes."""
    from tabsieve.functions.rng import sample_n

    part = df.select(key, *[F.col(c).cast(kinds[c]).alias(c) for c in columns]).dropna()
    if part.limit(most + 1).count() > most:
        part = sample_n(part, most, key, seed)
    t = part.select(*columns).toArrow()
    out = {}
    for c in columns:
        v = t.column(c).to_numpy()
        if kinds[c] == "string":
            out[c] = np.unique(v.astype(str), return_inverse=True)[1] if len(v) else np.zeros(0, np.int64)
        else:
            out[c] = (v - v.mean()) / (v.std(ddof=1) or 1.0) if len(v) > 1 else v * 0.0
    return part, t.num_rows, out


def _by_rows(spark, n: int, estimate) -> float:
    """Mean over rows 0..n-1 of estimate(rows), dealt to tasks in slices."""
    import pyarrow as pa

    def part(batches):
        for batch in batches:
            for at in batch.column("id").to_pylist():
                rows = np.arange(at, min(at + 256, n))
                yield pa.RecordBatch.from_arrays([pa.array([float(estimate(rows).sum())])], names=["s"])

    slices = spark.range(0, n, 256, numPartitions=max(1, min(-(-n // 256), 4 * spark.sparkContext.defaultParallelism)))
    return (slices.mapInArrow(part, "s double").agg(F.sum("s")).first()[0] or 0.0) / n


def _kraskov(spark, a: np.ndarray, b: np.ndarray, k: int) -> float:
    """Two numbers: Kraskov's first estimator."""
    n = len(a)
    if n <= k:
        return 0.0

    def own(rows):
        da, db = np.abs(a[rows, None] - a[None, :]), np.abs(b[rows, None] - b[None, :])
        d = np.maximum(da, db)
        d[np.arange(len(rows)), rows] = np.inf
        eps = np.partition(d, k - 1, 1)[:, k - 1 : k]
        return _digamma(np.maximum((da < eps).sum(1) - 1, 0) + 1) + _digamma(np.maximum((db < eps).sum(1) - 1, 0) + 1)

    return max(0.0, float(_digamma([k])[0] + _digamma([n])[0] - _by_rows(spark, n, own)))


def _ross(spark, a: np.ndarray, cls: np.ndarray, k: int) -> float:
    """A number and a class: Ross's estimator; classes of one row are left out."""
    sizes = np.bincount(cls)
    many = sizes[cls] > 1
    a, cls = a[many], cls[many]
    n = len(a)
    if not n:
        return 0.0
    size = np.bincount(cls)[cls]
    near = np.minimum(k, size - 1)

    def own(rows):
        d = np.abs(a[rows, None] - a[None, :])
        inside = np.where(cls[rows, None] == cls[None, :], d, np.inf)
        inside[np.arange(len(rows)), rows] = np.inf
        reach = np.sort(np.partition(inside, min(k, n - 1) - 1, 1)[:, : min(k, n - 1)], 1)[np.arange(len(rows)), near[rows] - 1]
        # all rows that are nearer, the row itself included
        return _digamma(np.maximum((d < reach[:, None]).sum(1), 1)) + _digamma(size[rows]) - _digamma(near[rows])

    return max(0.0, float(_digamma([n])[0] - _by_rows(spark, n, own)))


def mutual_information_knn(df: DataFrame, key: str, x: str, y: str, most: int = KNN_ROWS, k: int = 3, seed: int = 42) -> DataFrame:
    """(mi) of two numeric columns by nearest neighbours, over all rows up to `most`."""
    _, n, v = _held_rows(df, [x, y], key, most, seed, {x: "double", y: "double"})
    return df.sparkSession.createDataFrame([(_kraskov(df.sparkSession, v[x], v[y], k),)], "mi double")


def mutual_information_matrix(df: DataFrame, key: str, numeric: list[str], categorical: list[str], most: int = KNN_ROWS, k: int = 3, seed: int = 42) -> DataFrame:
    """(row_var, col_var, mi, normalised) for all ordered pairs: 1 on the diagonal; normalised is mi over the row's largest.

    Numbers with numbers by Kraskov's estimator, numbers with classes by Ross's, classes with classes by their contingency table, in nats.
    """
    columns, spark = [c for c in df.columns if c in numeric or c in categorical], df.sparkSession
    _, n, v = _held_rows(df, columns, key, most, seed, {c: "double" if c in numeric else "string" for c in columns})
    rows = [(c, c, 1.0) for c in columns]
    for i, a in enumerate(columns):
        for b in columns[:i]:
            if a in numeric and b in numeric:
                mi = _kraskov(spark, v[a], v[b], k)
            elif a in categorical and b in categorical:
                joint = np.unique(np.stack([v[a], v[b]]), axis=1, return_counts=True)
                pa_, pb = np.bincount(v[a]) / max(n, 1), np.bincount(v[b]) / max(n, 1)
                p = joint[1] / max(n, 1)
                mi = max(0.0, float((p * np.log(p / (pa_[joint[0][0]] * pb[joint[0][1]]))).sum()))
            else:
                number, cls = (a, b) if a in numeric else (b, a)
                mi = _ross(spark, v[number], v[cls], k)
            rows += [(a, b, mi), (b, a, mi)]
    largest = {c: max(m for r, _, m in rows if r == c) for c in columns}
    return spark.createDataFrame([(a, b, float(m), float(m / largest[a]) if largest[a] > 0 else 0.0) for a, b, m in rows], "row_var string, col_var string, mi double, normalised double")


def mixed_matrix(df: DataFrame, categorical: list[str], numeric: list[str], by: str, method: str = "spearman") -> DataFrame:
    """(by, row_var, col_var, kind, value): the lower triangle, diagonal left out; V for cat_cat, eta2 for num_cat, a correlation for num_num."""
    v = cramers_v(df, categorical, by).select(by, F.col("y").alias("row_var"), F.col("x").alias("col_var"), F.lit("cat_cat").alias("kind"), F.col("v").alias("value"))
    e = eta_squared(df, categorical, numeric, by).select(by, F.col("num").alias("row_var"), F.col("cat").alias("col_var"), F.lit("num_cat").alias("kind"), F.col("eta2").alias("value"))
    f, name = {"spearman": (spearman, "r"), "pearson": (pearson, "r"), "kendall": (kendall, "tau")}[method]
    c = f(df, numeric, by).select(by, F.col("y").alias("row_var"), F.col("x").alias("col_var"), F.lit("num_num").alias("kind"), F.col(name).alias("value"))
    return v.unionByName(e).unionByName(c)


def block_statistics(matrix: DataFrame, by: str) -> DataFrame:
    return matrix.groupBy(by, "kind").agg(F.count("value").alias("n"), F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"), F.min("value").alias("min"), F.max("value").alias("max"), F.avg(F.abs("value")).alias("abs_mean"))


def matrix_similarity(matrix: DataFrame, by: str, first: str, others: tuple[str, ...]) -> DataFrame:
    """(candidate, frobenius, normalised, mae, mse, block_mae): differences of the candidates' matrices from the first table's.

    block_mae is the plain mean of the blocks' mean absolute errors.
    """
    base = matrix.where(F.col(by) == first).select("row_var", "col_var", "kind", F.col("value").alias("base"))
    d = matrix.where(F.col(by).isin(*others)).join(base, ["row_var", "col_var", "kind"]).select(F.col(by).alias("candidate"), "kind", (F.col("base") - F.col("value")).alias("d"))
    blocks = d.groupBy("candidate", "kind").agg(F.count(F.lit(1)).alias("n"), F.sum(F.abs("d")).alias("a"), F.sum(F.col("d") * F.col("d")).alias("s"))
    t = blocks.groupBy("candidate").agg(F.sum("n").alias("n"), F.sum("a").alias("a"), F.sum("s").alias("s"), F.avg(F.col("a") / F.col("n")).alias("block_mae"))
    return t.select("candidate", F.sqrt("s").alias("frobenius"), (F.sqrt("s") / F.sqrt("n")).alias("normalised"), (F.col("a") / F.col("n")).alias("mae"), (F.col("s") / F.col("n")).alias("mse"), "block_mae")


def improvement(scores: DataFrame, metrics: list[str], raw: str, refined: str) -> DataFrame:
    """(metric, raw, refined, percent): (raw - refined) / raw * 100, 0 where raw is not above 0."""
    one = scores.agg(F.array(*[F.struct(F.lit(m).alias("metric"), F.max(F.when(F.col("candidate") == raw, F.col(m))).alias("raw"), F.max(F.when(F.col("candidate") == refined, F.col(m))).alias("refined")) for m in metrics]).alias("rows"))
    return one.select(F.explode("rows").alias("r")).select("r.*").withColumn("percent", F.when(F.col("raw") > 0, (F.col("raw") - F.col("refined")) / F.col("raw") * 100).otherwise(0.0))


def consensus(matrix: DataFrame, by: str) -> DataFrame:
    """(row_var, col_var, kind, mean, std): mean and population deviation of each entry over the tables' matrices."""
    return matrix.groupBy("row_var", "col_var", "kind").agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"))
