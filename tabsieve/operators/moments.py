"""Moments, kernel mean discrepancies and correlation differences."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabsieve.functions.frames import melt, quantiles

#: Beyond this many columns, pairwise products are summed by an array kernel, not by expressions.
MOST_EXPRESSIONS = 60
TILE = 1 << 22


def moments(df: DataFrame, ds: str, columns: list[str]) -> DataFrame:
    """(ds, col, mean, std, skew, kurt, min, max, q25, median, q75): population moments, excess kurtosis, interpolated quartiles."""
    long = melt(df, columns, [ds]).where("value IS NOT NULL")
    out = long.groupBy(ds, "col").agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"), F.skewness("value").alias("skew"), F.kurtosis("value").alias("kurt"), F.min("value").alias("min"), F.max("value").alias("max"))
    return out.join(quantiles(long, [ds, "col"], "value", [0.25, 0.5, 0.75]), [ds, "col"]).select(ds, "col", "mean", "std", "skew", "kurt", "min", "max", F.get("q", F.lit(0)).alias("q25"), F.get("q", F.lit(1)).alias("median"), F.get("q", F.lit(2)).alias("q75"))


def moments_compare(m: DataFrame, ds: str, first: str, second: str) -> DataFrame:
    """(moment, mae, max, mse) over the columns, between two tables' rows of moments()."""
    names = ("mean", "std", "skew", "kurt")
    a, b = (m.where(F.col(ds) == s).select("col", *[F.col(n).alias(f"{n}_{k}") for n in names]) for k, s in enumerate((first, second)))
    rows = a.join(b, "col").select(F.explode(F.array(*[F.struct(F.lit(n).alias("moment"), F.abs(F.col(f"{n}_0") - F.col(f"{n}_1")).alias("d")) for n in names])).alias("r")).select("r.*")
    return rows.groupBy("moment").agg(F.avg("d").alias("mae"), F.max("d").alias("max"), F.avg(F.col("d") * F.col("d")).alias("mse"))


def min_max(df: DataFrame, ds: str, first: str, columns: list[str], keep: list[str] = ()) -> DataFrame:
    """Columns with null as 0, scaled by the first table's range."""
    filled = df.select(ds, *keep, *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in columns])
    span = filled.where(F.col(ds) == first).agg(*[f(c).alias(f"_{n}_{c}") for c in columns for n, f in (("lo", F.min), ("hi", F.max))])
    scaled = [F.when(F.col(f"_hi_{c}") > F.col(f"_lo_{c}"), (F.col(c) - F.col(f"_lo_{c}")) / (F.col(f"_hi_{c}") - F.col(f"_lo_{c}"))).otherwise(F.col(c) - F.col(f"_lo_{c}")).alias(c) for c in columns]
    return filled.join(F.broadcast(span)).select(ds, *keep, *scaled)  # span is one row


def mmd_linear(df: DataFrame, ds: str, first: str, second: str, columns: list[str]) -> DataFrame:
    """Squared discrepancy under the linear kernel: squared distance of the means, one pass."""
    side = lambda c, s: F.avg(F.when(F.col(ds) == s, F.col(c)))
    means = df.agg(*[(side(c, first) - side(c, second)).alias(f"d{k}") for k, c in enumerate(columns)])
    return means.select(sum((F.col(f"d{k}") * F.col(f"d{k}") for k in range(len(columns))), F.lit(0.0)).alias("mmd"))


def mmd_poly2(df: DataFrame, ds: str, first: str, second: str, columns: list[str]) -> DataFrame:
    """Squared discrepancy under (x.y)**2: squared Frobenius distance of the second-moment matrices, one pass, no pairs of rows."""
    d = len(columns)
    if d > MOST_EXPRESSIONS:
        return _poly2_kernel(df, ds, first, second, columns)
    pairs = [(i, j) for i in range(d) for j in range(i, d)]
    side = lambda e, s: F.avg(F.when(F.col(ds) == s, e))
    means = df.agg(*[(side(F.col(columns[i]) * F.col(columns[j]), first) - side(F.col(columns[i]) * F.col(columns[j]), second)).alias(f"m{i}_{j}") for i, j in pairs])
    return means.select(sum((F.lit(1.0 if i == j else 2.0) * F.col(f"m{i}_{j}") * F.col(f"m{i}_{j}") for i, j in pairs), F.lit(0.0)).alias("mmd"))


def _poly2_kernel(df: DataFrame, ds: str, first: str, second: str, columns: list[str]) -> DataFrame:
    d = len(columns)

    def partial(batches):
        s, n = np.zeros((2, d, d)), np.zeros(2)
        for batch in batches:
            side = np.array(batch.column(ds).to_pylist())
            x = np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in columns], 1)
            for k, name in enumerate((first, second)):
                part = x[side == name]
                s[k] += part.T @ part
                n[k] += len(part)
        i, j = np.indices((d, d))
        yield pa.RecordBatch.from_arrays([pa.array(i.ravel()), pa.array(j.ravel()), pa.array(s[0].ravel()), pa.array(s[1].ravel()), pa.array(np.full(d * d, n[0])), pa.array(np.full(d * d, n[1]))], names=["i", "j", "a", "b", "na", "nb"])

    rows = df.select(ds, *[F.col(c).cast("double") for c in columns]).mapInArrow(partial, "i long, j long, a double, b double, na double, nb double")
    cell = rows.groupBy("i", "j").agg(*[F.sum(c).alias(c) for c in ("a", "b", "na", "nb")]).select((F.col("a") / F.col("na") - F.col("b") / F.col("nb")).alias("m"))
    return cell.agg(F.sum(F.col("m") * F.col("m")).alias("mmd"))


def mmd_rbf(df: DataFrame, ds: str, first: str, second: str, columns: list[str], gamma: float = 1.0, most_held: int = 200_000) -> DataFrame:
    """Squared discrepancy under the Gaussian kernel, all pairs (biased form).

    Rows are gathered by equal points first. If the distinct points fit in most_held, they go to the executors as one array and every block of points
    streams past it; otherwise points are dealt to blocks and each two blocks meet in one task, so no task holds more than two blocks.
    """
    points = df.where(F.col(ds).isin(first, second)).groupBy(*columns).agg(F.count(F.when(F.col(ds) == first, 1)).alias("_a"), F.count(F.when(F.col(ds) == second, 1)).alias("_b"))
    points = points.select(F.array(*[F.col(c).cast("double") for c in columns]).alias("x"), F.col("_a").alias("a"), F.col("_b").alias("b"))
    sizes = points.agg(F.sum("a").alias("na"), F.sum("b").alias("nb"))
    d = len(columns)
    n = points.limit(most_held + 1).count()
    if n <= most_held:
        t = points.toArrow()
        y = np.array(t.column("x").to_pylist(), float).reshape(-1, d)
        b = np.stack([t.column("a").to_numpy(), t.column("b").to_numpy()]).astype(float)

        def against(batches):
            total = np.zeros(3)
            for batch in batches:
                x = np.array(batch.column("x").to_pylist(), float).reshape(-1, d)
                w = np.stack([batch.column("a").to_numpy(), batch.column("b").to_numpy()]).astype(float)
                total += _kernel_sums(x, w, y, b, gamma)
            yield pa.RecordBatch.from_arrays([pa.array([v]) for v in total], names=["aa", "ab", "bb"])

        sums = points.repartition(max(1, min(64, n // 500))).mapInArrow(against, "aa double, ab double, bb double")
    else:
        blocks = -(-points.count() // (most_held // 4))
        own = points.withColumn("own", F.pmod(F.xxhash64("x"), F.lit(blocks)).cast("int"))
        other = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
        dealt = own.withColumn("other", other).select(F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "x", "a", "b")

        def pair(pdf):
            i, j = int(pdf["i"].iloc[0]), int(pdf["j"].iloc[0])
            get = lambda k: (np.array(pdf.loc[pdf["own"] == k, "x"].tolist(), float).reshape(-1, d), pdf.loc[pdf["own"] == k, ["a", "b"]].to_numpy(float).T)
            (x, w), (y2, b2) = get(i), get(j)
            s = _kernel_sums(x, w, y2, b2, gamma)
            if i != j:
                s = s + _kernel_sums(y2, b2, x, w, gamma)
            import pandas as pd

            return pd.DataFrame([s], columns=["aa", "ab", "bb"])

        sums = dealt.groupBy("i", "j").applyInPandas(pair, "aa double, ab double, bb double")
    one = sums.agg(*[F.coalesce(F.sum(c), F.lit(0.0)).alias(c) for c in ("aa", "ab", "bb")]).join(F.broadcast(sizes))  # one row each
    return one.select((F.col("aa") / (F.col("na") * F.col("na")) + F.col("bb") / (F.col("nb") * F.col("nb")) - 2 * F.col("ab") / (F.col("na") * F.col("nb"))).alias("mmd"))


def _kernel_sums(x, w, y, b, gamma) -> np.ndarray:
    total = np.zeros(3)
    step = max(1, TILE // max(len(y), 1))
    for at in range(0, len(x), step):
        part = x[at : at + step]
        sq = np.zeros((len(part), len(y)))
        for k in range(x.shape[1]):
            diff = part[:, k, None] - y[None, :, k]
            sq += diff * diff
        kern = np.exp(-gamma * sq)
        a = w[:, at : at + step]
        total += [a[0] @ kern @ b[0], a[0] @ kern @ b[1], a[1] @ kern @ b[1]]
    return total


def sinkhorn(df: DataFrame, ds: str, first: str, second: str, columns: list[str], key: str, most: int = 5000, blur: float = 0.05, seed: int = 42) -> DataFrame:
    """Debiased entropic transport cost (half squared distances, regularisation blur**2) between samples of at most `most` rows a side."""
    from tabsieve.functions.rng import sample_n

    scaled = min_max(df, ds, first, columns, [key])
    sides = [sample_n(scaled.where(F.col(ds) == s), most, key, seed) for s in (first, second)]
    both = sides[0].withColumn("side", F.lit(0)).unionByName(sides[1].withColumn("side", F.lit(1))).withColumn("all", F.lit(0))

    def solve(pdf):
        import pandas as pd

        x, y = (pdf.loc[pdf["side"] == k, columns].to_numpy(float) for k in (0, 1))
        return pd.DataFrame({"sinkhorn": [_transport(x, y, blur) - (_transport(x, x, blur) + _transport(y, y, blur)) / 2 if len(x) and len(y) else float("nan")]})

    return both.groupBy("all").applyInPandas(solve, "sinkhorn double")  # at most 2 * most rows


def _transport(x: np.ndarray, y: np.ndarray, blur: float) -> float:
    c = np.zeros((len(x), len(y)))
    for k in range(x.shape[1]):
        c += (x[:, k, None] - y[None, :, k]) ** 2 / 2
    la, lb = -np.log(len(x)), -np.log(len(y))
    f, g = np.zeros(len(x)), np.zeros(len(y))
    soft = lambda m, axis: (mx := m.max(axis, keepdims=True)).squeeze(axis) + np.log(np.exp(m - mx).sum(axis))
    eps = max(float(c.max()), 1e-9)
    while True:
        eps = max(eps / 4, blur * blur)
        for _ in range(3 if eps > blur * blur else 20):
            f = -eps * soft((g[None, :] - c) / eps + lb, 1)
            g = -eps * soft((f[:, None] - c) / eps + la, 0)
        if eps <= blur * blur:
            return float(f.mean() + g.mean())


def correlation_gap(df: DataFrame, ds: str, first: str, second: str, columns: list[str]) -> DataFrame:
    """mse, mae, max and Frobenius norm of the difference of two Pearson matrices (undefined entries count as 0), diagonal included."""
    pairs = [(i, j) for i in range(len(columns)) for j in range(i + 1, len(columns))]
    side = lambda i, j, s: F.coalesce(F.nanvl(F.corr(F.when(F.col(ds) == s, F.col(columns[i])), F.when(F.col(ds) == s, F.col(columns[j]))), F.lit(0.0)), F.lit(0.0))
    one = df.agg(*[(side(i, j, first) - side(i, j, second)).alias(f"d{i}_{j}") for i, j in pairs])
    n = float(len(columns) ** 2)
    sq = 2 * sum((F.col(f"d{i}_{j}") * F.col(f"d{i}_{j}") for i, j in pairs), F.lit(0.0))
    ab = 2 * sum((F.abs(F.col(f"d{i}_{j}")) for i, j in pairs), F.lit(0.0))
    return one.select((sq / n).alias("mse"), (ab / n).alias("mae"), F.greatest(F.lit(0.0), *[F.abs(F.col(f"d{i}_{j}")) for i, j in pairs]).alias("max_diff"), F.sqrt(sq).alias("frobenius"))
