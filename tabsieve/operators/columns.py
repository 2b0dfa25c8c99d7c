"""Column types under the named policies, data summaries, validation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def is_numeric(kind: T.DataType) -> bool:
    """Booleans count as numbers here."""
    return isinstance(kind, (T.NumericType, T.BooleanType))


def profile(df: DataFrame, columns: list[str] | None = None, tag: str | None = None) -> DataFrame:
    """(col, numeric, n, distinct, nulls): exact, in one pass of count_distinct over all columns."""
    columns = columns or df.columns
    kinds = {f.name: f.dataType for f in df.schema.fields}
    one = df.agg(F.count(F.lit(1)).alias("n"), *[F.count_distinct(c).alias(f"d{k}") for k, c in enumerate(columns)], *[F.count(c).alias(f"c{k}") for k, c in enumerate(columns)])
    rows = F.explode(F.array(*[F.struct(F.lit(c).alias("col"), F.lit(is_numeric(kinds[c])).alias("numeric"), F.col("n"), F.col(f"d{k}").alias("distinct"), (F.col("n") - F.col(f"c{k}")).alias("nulls")) for k, c in enumerate(columns)]))
    return one.select(rows.alias("r")).select("r.*")


def types_of_pair(real: DataFrame, synthetic: DataFrame, columns: list[str]) -> DataFrame:
    """Policy pair3: binary, categorical or numerical, from both tables."""
    a, b = profile(real, columns), profile(synthetic, columns)
    j = a.join(b.select("col", F.col("numeric").alias("numeric2"), F.col("n").alias("n2"), F.col("distinct").alias("distinct2")), "col")
    low = lambda d, n: F.when(F.col(n) == 0, F.lit(False)).otherwise(F.col(d) / F.col(n) < 0.05)
    two = (F.col("distinct") <= 2) & (F.col("distinct2") <= 2)
    few = low("distinct", "n") & low("distinct2", "n2") & (F.col("distinct") < 20)
    kind = F.when(two, "binary").when(~(F.col("numeric") & F.col("numeric2")) | few, "categorical").otherwise("numerical")
    return j.select("col", kind.alias("kind"))


def types_of(df: DataFrame, policy: str, columns: list[str] | None = None) -> DataFrame:
    """(col, kind) under one of the policies on a single table."""
    p = profile(df, columns)
    d, n = F.col("distinct"), F.col("n")
    ratio = F.when(n == 0, F.lit(0.0)).otherwise(d / n)
    if policy == "corr2":
        kind = F.when(F.col("numeric") & ~((ratio < 0.05) & (d < 20)), "numerical").otherwise("categorical")
    elif policy == "dist2":
        kind = F.when(F.col("numeric") & ~((ratio < 0.05) & (d <= 50)), "numerical").otherwise("categorical")
    elif policy == "test3":
        kind = F.when(F.col("numeric") & (d > 10), "numerical").when(d == 2, "binary").otherwise("multiclass")
    elif policy == "summary5":
        kind = (
            F.when(F.col("numeric") & (d <= 2), "binary")
            .when(F.col("numeric") & (d < 20) & (ratio < 0.05), "categorical_numeric")
            .when(F.col("numeric"), "continuous")
            .when(d <= 2, "binary_categorical")
            .otherwise("categorical")
        )
    elif policy == "plot3":
        kind = F.when(d > 10, "continuous").when(d <= 2, "binary").otherwise("categorical")
    elif policy == "number2":
        kind = F.when(F.col("numeric"), "number").otherwise("other")
    else:
        raise ValueError(f"unknown policy {policy}")
    return p.select("col", kind.alias("kind"))


def summary(df: DataFrame) -> DataFrame:
    """rows, columns, nulls, null_share, duplicate_rows, and the number of columns of each summary5 kind."""
    p = profile(df)
    totals = p.agg(F.max("n").alias("rows"), F.count(F.lit(1)).alias("columns"), F.sum("nulls").alias("nulls"))
    kinds = types_of(df, "summary5").groupBy().pivot("kind", ["binary", "categorical_numeric", "continuous", "binary_categorical", "categorical"]).count()
    unique = df.distinct().agg(F.count(F.lit(1)).alias("unique_rows"))
    out = totals.crossJoin(unique).crossJoin(kinds)  # three tables of one row
    share = F.when(F.col("rows") > 0, F.col("nulls") / (F.col("rows") * F.col("columns"))).otherwise(0.0)
    return out.select("rows", "columns", "nulls", share.alias("null_share"), (F.col("rows") - F.col("unique_rows")).alias("duplicate_rows"), *[F.coalesce(F.col(k), F.lit(0)).alias(f"n_{k}") for k in kinds.columns])


def validate(real: DataFrame, synthetic: DataFrame, least_rows: int = 10) -> tuple[bool, str]:
    """Whether two tables can be compared, and why not."""
    n, m = real.limit(least_rows).count(), synthetic.limit(least_rows).count()
    if not n or not m:
        return False, "a table is empty"
    if set(real.columns) != set(synthetic.columns):
        return False, f"columns differ: {sorted(set(real.columns) ^ set(synthetic.columns))}"
    if n < least_rows or m < least_rows:
        return False, f"fewer than {least_rows} rows"
    a, b = ({f.name: is_numeric(f.dataType) for f in t.schema.fields} for t in (real, synthetic))
    odd = [c for c in real.columns if a[c] != b[c]]
    return (False, f"types differ: {odd}") if odd else (True, "ok")


def memory_estimate(n_real: int, n_synthetic: int, n_columns: int) -> dict[str, float]:
    """MB that dense tables and the distance matrix would take (8 and 4 bytes a value)."""
    mb = 2.0**20
    a, b, d = n_real * n_columns * 8 / mb, n_synthetic * n_columns * 8 / mb, n_synthetic * n_real * 4 / mb
    return {"real_mb": a, "synthetic_mb": b, "distance_mb": d, "total_mb": a + b + d}
