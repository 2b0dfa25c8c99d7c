"""Two-sample tests by column: Welch, Kolmogorov-Smirnov, Anderson-Darling, chi-square; p-values of the few result rows in Arrow batches."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabsieve.functions import special
from tabsieve.functions.frames import cumulative, melt
from tabsieve.operators.association import contingency
from tabsieve.operators.columns import is_numeric, types_of
from tabsieve.operators.divergence import cdf_distances, cdf_frame


def with_p(df: DataFrame, out: str, f, *inputs: str) -> DataFrame:
    """df with out = f(*inputs), for results of a few rows."""
    schema = T.StructType([*df.schema.fields, T.StructField(out, T.DoubleType())])

    def add(batches):
        for pdf in batches:
            pdf = pdf.copy()
            pdf[out] = [f(*(None if v is None or v != v else v for v in row)) for row in zip(*(pdf[c] for c in inputs))]
            pdf[out] = pdf[out].astype("float64")
            yield pdf

    return df.mapInPandas(add, schema)


def welch(df: DataFrame, ds: str, first: str, others: tuple[str, ...], columns: list[str]) -> DataFrame:
    """(col, candidate, t, df): unequal-variance t statistic and its degrees of freedom."""
    s = melt(df, columns, [ds]).where("value IS NOT NULL").groupBy(ds, "col").agg(F.avg("value").alias("m"), (F.var_samp("value") / F.count("value")).alias("v"), F.count("value").alias("n"))
    a = s.where(F.col(ds) == first).select("col", F.col("m").alias("m1"), F.col("v").alias("v1"), F.col("n").alias("n1"))
    j = s.where(F.col(ds).isin(*others)).join(a, "col")
    t = (F.col("m1") - F.col("m")) / F.sqrt(F.col("v1") + F.col("v"))
    d = (F.col("v1") + F.col("v")) * (F.col("v1") + F.col("v")) / (F.col("v1") * F.col("v1") / (F.col("n1") - 1) + F.col("v") * F.col("v") / (F.col("n") - 1))
    return j.select("col", F.col(ds).alias("candidate"), t.alias("t"), d.alias("df"))


def welch_test(*args) -> DataFrame:
    return with_p(welch(*args), "p", special.t_sf2, "t", "df")


def ks_test(df: DataFrame, ds: str, first: str, second: str, columns: list[str]) -> DataFrame:
    """(col, ks, na, nb, p), p exact for samples of up to special.EXACT_KS rows, by the asymptotic series beyond."""
    d = cdf_distances(cdf_frame(df, ds, first, second, columns)).select("col", "ks", "na", "nb")
    return with_p(d, "p", lambda x, n, m: special.ks_sf_exact(x, int(n), int(m)), "ks", "na", "nb")


def anderson_ksamp(df: DataFrame, ds: str, first: str, second: str, columns: list[str]) -> DataFrame:
    """(col, a2, na, nb): midrank k-sample Anderson-Darling statistic for two samples."""
    cdf = cdf_frame(df, ds, first, second, columns)
    n = F.col("na") + F.col("nb")
    h = F.col("a") + F.col("b")
    below = F.col("ca") + F.col("cb") - h
    b = below + h / 2
    one = lambda c, upto, size: (h / n) * ((n * (F.col(upto) - F.col(c) / 2) - b * F.col(size)) * (n * (F.col(upto) - F.col(c) / 2) - b * F.col(size))) / (b * (n - b) - n * h / 4)
    s = cdf.groupBy("col").agg(F.sum(one("a", "ca", "na")).alias("sa"), F.sum(one("b", "cb", "nb")).alias("sb"), F.max("na").alias("na"), F.max("nb").alias("nb"))
    total = F.col("na") + F.col("nb")
    return s.select("col", ((total - 1) / total * (F.col("sa") / F.col("na") + F.col("sb") / F.col("nb"))).alias("a2"), "na", "nb")


def anderson_test(df: DataFrame, ds: str, first: str, second: str, columns: list[str]) -> DataFrame:
    """(col, a2, statistic, p); p is interpolated in the published table for two samples and kept inside [0.001, 0.25]."""
    s = anderson_ksamp(df, ds, first, second, columns)
    s = with_p(s, "statistic", _standardised, "a2", "na", "nb")
    return with_p(s, "p", _anderson_p, "statistic")


def _standardised(a2, na, nb):
    """Scholz and Stephens (1987): (A2 - (k - 1)) / sd for k = 2. From 4,000 rows on, the double sum g is taken at its limit, pi**2 / 6 (off by under 0.003)."""
    if a2 is None:
        return None
    n, k = int(na + nb), 2
    big_h = 1 / na + 1 / nb
    h = sum(1 / i for i in range(1, n)) if n < 1_000_000 else math.log(n - 1) + 0.5772156649015329
    if n <= 4000:
        inv = [0.0] * (n + 1)
        run = 0.0
        for i in range(n - 1, 0, -1):  # run = sum of 1/j for j from i+1 to n-1
            inv[i] = run
            run += 1 / i
        g = sum(inv[i] / (n - i) for i in range(1, n - 1))
    else:
        g = math.pi**2 / 6
    a = (4 * g - 6) * (k - 1) + (10 - 6 * g) * big_h
    b = (2 * g - 4) * k**2 + 8 * h * k + (2 * g - 14 * h - 4) * big_h - 8 * h + 4 * g - 6
    c = (6 * h + 2 * g - 2) * k**2 + (4 * h - 4 * g + 6) * k + (2 * h - 6) * big_h + 4 * h
    d = (2 * h + 6) * k**2 - 4 * h * k
    var = (a * n**3 + b * n**2 + c * n + d) / ((n - 1.0) * (n - 2.0) * (n - 3.0))
    return (a2 - (k - 1)) / math.sqrt(var) if var > 0 else None


def _anderson_p(x):
    if x is None:
        return None
    #: Critical values for two samples at these levels (fixed values).
    levels = (0.25, 0.1, 0.05, 0.025, 0.01, 0.005, 0.001)
    critical = (0.325, 1.226, 1.961, 2.718, 3.752, 4.592, 6.546)
    if x <= critical[0]:
        return 0.25
    if x >= critical[-1]:
        return 0.001
    k = next(i for i in range(len(critical) - 1) if critical[i] <= x <= critical[i + 1])
    t = (x - critical[k]) / (critical[k + 1] - critical[k])
    return math.exp(math.log(levels[k]) + t * (math.log(levels[k + 1]) - math.log(levels[k])))


def chi2_homogeneity(df: DataFrame, ds: str, first: str, second: str, columns: list[str]) -> DataFrame:
    """(col, chi2, df): table x value independence, for each column."""
    long = melt(df.where(F.col(ds).isin(first, second)), columns, [ds], "string").where("value IS NOT NULL")
    counts = long.groupBy("col", F.col(ds).alias("vx"), F.col("value").alias("vy")).agg(F.count(F.lit(1)).alias("n"))
    return contingency(counts, ["col"]).select("col", "chi2", "df")


def chi2_pairs(a: DataFrame, b: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """(col, chi2, df): independence of two tables' columns paired by position (rank of key); the longer table's rest is left out."""
    sides = [_positions(t, key).select("_pos", *columns) for t in (a, b)]
    j = sides[0].select("_pos", *[F.col(c).cast("string").alias(f"x_{c}") for c in columns]).join(sides[1].select("_pos", *[F.col(c).cast("string").alias(f"y_{c}") for c in columns]), "_pos")
    rows = F.explode(F.array(*[F.struct(F.lit(c).alias("col"), F.col(f"x_{c}").alias("vx"), F.col(f"y_{c}").alias("vy")) for c in columns]))
    counts = j.select(rows.alias("r")).select("r.*").where("vx IS NOT NULL AND vy IS NOT NULL").groupBy("col", "vx", "vy").agg(F.count(F.lit(1)).alias("n"))
    return contingency(counts, ["col"]).select("col", "chi2", "df")


def _positions(df: DataFrame, key: str) -> DataFrame:
    """Rows with _pos, their rank by key (unique)."""
    run = cumulative(df.select(F.lit("all").alias("_all"), key, F.lit(1).cast("long").alias("_one")), "_all", key, {"_pos": "_one"})
    return df.join(run.select(key, "_pos"), key)


def descriptive(df: DataFrame, ds: str, numeric: list[str], categorical: list[str]) -> DataFrame:
    """(ds, col, mean, std, mode, mode_share): sample deviation for numbers; the most frequent value (ties: the smallest) for others."""
    n = melt(df, numeric, [ds]).where("value IS NOT NULL").groupBy(ds, "col").agg(F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"))
    c = melt(df, categorical, [ds], "string").where("value IS NOT NULL").groupBy(ds, "col", "value").agg(F.count(F.lit(1)).alias("k"))
    top = c.groupBy(ds, "col").agg(F.sum("k").alias("t"), F.min(F.struct((-F.col("k")).alias("m"), "value")).alias("top")).select(ds, "col", F.col("top.value").alias("value"), (-F.col("top.m")).alias("k"), "t")
    a = n.select(ds, "col", "mean", "std", F.lit(None).cast("string").alias("mode"), F.lit(None).cast("double").alias("mode_share"))
    b = top.select(ds, "col", F.lit(None).cast("double").alias("mean"), F.lit(None).cast("double").alias("std"), F.col("value").alias("mode"), (F.col("k") / F.col("t")).alias("mode_share"))
    return a.unionByName(b)


def similar(tests: DataFrame, alpha: float = 0.05) -> DataFrame:
    """Whether the test does not reject: p > alpha."""
    return tests.withColumn("similar", F.col("p") > alpha)


def compare_distributions(real: DataFrame, raw: DataFrame, refined: DataFrame, key: str, alpha: float = 0.05, numerical_test: str = "ttest") -> DataFrame:
    """(col, kind, real_class, real, real_std, raw, raw_std, raw_p, raw_match, refined, refined_std, refined_p, refined_match): one row for each column but key.

    Numbers (over ten distinct values): mean, sample deviation and a Welch (ttest), Kolmogorov-Smirnov (ks) or Anderson-Darling (ad) test. Binary columns: share of
    the literal class 1. Others: share of the real table's most frequent class (ties: the smallest). Both with a chi-square test of rows paired by rank of key.
    match is Similar where p > alpha, else Different. The tables must have the same columns in the same order.
    """
    if numerical_test not in ("ttest", "ks", "ad"):
        raise ValueError("numerical_test must be ttest, ks or ad")
    if not real.columns == raw.columns == refined.columns:
        raise ValueError("the tables must have the same columns")
    columns = [c for c in real.columns if c != key]
    kinds = {r["col"]: r["kind"] for r in types_of(real.select(*columns), "test3").collect()}  # a row for each column
    numbers, others = [c for c in columns if kinds[c] == "numerical"], [c for c in columns if kinds[c] != "numerical"]
    sides = (("real", real), ("raw", raw), ("refined", refined))
    spark, out = real.sparkSession, None
    facts = spark.createDataFrame([(c, kinds[c], k) for k, c in enumerate(columns)], "col string, kind string, _place int")

    def wide(long: DataFrame, tests: dict[str, DataFrame]) -> DataFrame:
        pick = lambda s, c: F.max(F.when(F.col("ds") == s, F.col(c)))
        t = long.groupBy("col").agg(F.max("cls").alias("real_class"), *[pick(s, c).alias(s + tail) for s, _ in sides for c, tail in (("stat", ""), ("std", "_std"))])
        for s, p in tests.items():
            t = t.join(p.select("col", F.col("p").alias(f"{s}_p")), "col", "left")
        return t

    if numbers:
        both = None
        for s, t in sides:
            part = t.select(F.lit(s).alias("ds"), *[F.col(c).cast("double").alias(c) for c in numbers])
            both = part if both is None else both.unionByName(part)
        long = melt(both, numbers, ["ds"]).where("value IS NOT NULL").groupBy("ds", "col").agg(F.avg("value").alias("stat"), F.stddev_samp("value").alias("std")).withColumn("cls", F.lit(None).cast("string"))
        if numerical_test == "ttest":
            w = welch_test(both, "ds", "real", ("raw", "refined"), numbers)
            tests = {s: w.where(F.col("candidate") == s) for s in ("raw", "refined")}
        else:
            f = ks_test if numerical_test == "ks" else anderson_test
            tests = {s: f(both, "ds", "real", s, numbers) for s in ("raw", "refined")}
        out = wide(long, tests)
    if others:
        counts = None
        for s, t in sides:
            part = melt(t, others, [], "string").where("value IS NOT NULL").groupBy("col", "value").agg(F.count(F.lit(1)).alias("n")).withColumn("ds", F.lit(s))
            counts = part if counts is None else counts.unionByName(part)
        counts = counts.join(F.broadcast(facts), "col")  # a row for each column
        size = counts.groupBy("ds", "col").agg(F.sum("n").alias("_size"))
        numeric = {f.name for f in real.schema.fields if is_numeric(f.dataType)}
        mode = counts.where("ds = 'real' AND kind = 'multiclass'").groupBy("col").agg(F.min_by("value", F.struct(-F.col("n"), F.when(F.col("col").isin(*numeric), F.col("value").cast("double")), "value")).alias("cls"))
        cls = mode.unionByName(facts.where("kind = 'binary'").select("col", F.lit("1").alias("cls")))
        same = (F.col("value") == F.col("cls")) | (F.col("col").isin(*numeric) & (F.col("value").cast("double") == F.col("cls").cast("double")))
        long = counts.join(cls, "col").join(size, ["ds", "col"]).groupBy("ds", "col").agg((F.sum(F.when(same, F.col("n")).otherwise(0)) / F.max("_size")).alias("stat"), F.max("cls").alias("cls")).withColumn("std", F.lit(None).cast("double"))
        tests = {s: with_p(chi2_pairs(real, t, key, others), "p", lambda x, d: 1.0 if not d else special.chi2_sf(x, d), "chi2", "df") for s, t in sides[1:]}
        t = wide(long, tests)
        out = t if out is None else out.unionByName(t)
    match = lambda p: F.when(F.col(p) > alpha, "Similar").otherwise("Different").alias(p.replace("_p", "_match"))
    named = [x for s, _ in sides for x in ([s, f"{s}_std"] + ([f"{s}_p", match(f"{s}_p")] if s != "real" else []))]
    return out.join(F.broadcast(facts), "col").select("col", "kind", "real_class", *named)
