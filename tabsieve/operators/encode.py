"""Encoders whose statistics are small DataFrames: min-max, one-hot, label codes, imputation."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabsieve.functions.frames import melt, quantiles
from tabsieve.operators.columns import is_numeric

#: One-hot columns and label codes are refused beyond this many categories of a column.
MOST_CATEGORIES = 100_000
MISSING = "__MISSING__"
#: Up to so many categories are compared one by one; more come by a broadcast table of codes, of at most MOST_CATEGORIES rows.
FEW_CATEGORIES = 64


def medians(df: DataFrame, columns: list[str]) -> dict[str, float]:
    """Exact medians; None for a column without values."""
    if not columns:
        return {}
    found = {r["col"]: r["q"][0] for r in quantiles(melt(df, columns, []), ["col"], "value", [0.5]).collect()}  # one row for each column
    return {c: found.get(c) for c in columns}


def categories(df: DataFrame, column: str, nulls: str | None = None) -> list[str]:
    """Distinct values as text, in text order; at most MOST_CATEGORIES."""
    c = F.col(column).cast("string")
    c = F.coalesce(c, F.lit(nulls)) if nulls is not None else c
    rows = df.select(c.alias("v")).where("v IS NOT NULL").distinct().limit(MOST_CATEGORIES + 1).collect()
    if len(rows) > MOST_CATEGORIES:
        raise ValueError(f"{column} has more than {MOST_CATEGORIES} categories")
    return sorted((r["v"] for r in rows), key=lambda s: s.encode())


def with_code(df: DataFrame, column: Column, values: list[str], out: str) -> DataFrame:
    """df with out: the place of column (text) among values, from 0; values not among them get 0."""
    if len(values) <= FEW_CATEGORIES:
        place = F.array_position(F.lit(list(values)) if values else F.array().cast("array<string>"), column)
        return df.withColumn(out, F.greatest(F.coalesce(place, F.lit(0)) - 1, F.lit(0)).cast("double"))
    codes = df.sparkSession.createDataFrame([(v, float(k)) for k, v in enumerate(values)], "_v string, _code double")
    return df.join(F.broadcast(codes), column == F.col("_v"), "left").withColumn(out, F.coalesce("_code", F.lit(0.0))).drop("_v", "_code")


@dataclass(frozen=True)
class FeatureEncoder:
    """Numbers scaled by the real table's range, binaries to 0/1, other columns one-hot over both tables' categories.

    Numbers are imputed with the real table's median; constant columns become 0; synthetic values are not clipped; a binary column with more than
    two values over both tables is left out; values not seen in fitting give zeros.
    """

    numeric: dict[str, tuple[float, float, float]]
    binary: dict[str, tuple[str, ...]]
    one_hot: dict[str, tuple[str, ...]]

    @classmethod
    def fit(cls, real: DataFrame, synthetic: DataFrame, kinds: dict[str, str]) -> FeatureEncoder:
        numeric = [c for c, k in kinds.items() if k == "numerical"]
        stats = real.agg(*[f(c).alias(f"{n}_{i}") for i, c in enumerate(numeric) for n, f in (("lo", F.min), ("hi", F.max))]).first().asDict() if numeric else {}
        stats |= {f"median_{numeric.index(c)}": v for c, v in medians(real, numeric).items()}
        both = real.select(*kinds).unionByName(synthetic.select(*kinds))
        values = {c: tuple(categories(both, c)) for c, k in kinds.items() if k != "numerical"}
        return cls(
            {c: tuple(float(stats[f"{n}_{i}"] or 0.0) for n in ("median", "lo", "hi")) for i, c in enumerate(numeric)},
            {c: values[c] for c, k in kinds.items() if k == "binary" and len(values[c]) <= 2},
            {c: values[c] for c, k in kinds.items() if k == "categorical"},
        )

    def columns(self) -> list[tuple[str, Column]]:
        out = []
        for c, (median, lo, hi) in self.numeric.items():
            v = F.coalesce(F.col(c).cast("double"), F.lit(median))
            out.append((c, (v - lo) / (hi - lo) if hi > lo else v - lo))
        for c, values in self.binary.items():
            out.append((c, F.when(F.col(c).cast("string") == values[-1], 1.0).otherwise(0.0) if len(values) == 2 else F.lit(0.0)))
        for c, values in self.one_hot.items():
            out += [(f"{c}_{v}", F.when(F.col(c).cast("string") == v, 1.0).otherwise(0.0)) for v in values]
        return out

    def transform(self, df: DataFrame, keep: list[str] = ()) -> DataFrame:
        return df.select(*keep, *[e.alias(n) for n, e in self.columns()])


@dataclass(frozen=True)
class CodeEncoder:
    """For distances: numbers imputed with the median over both tables and cast to the real table's type, other columns as codes in text order."""

    numeric: dict[str, tuple[float, str]]
    codes: dict[str, tuple[str, ...]]

    @classmethod
    def fit(cls, real: DataFrame, synthetic: DataFrame, columns: list[str]) -> CodeEncoder:
        kinds = {f.name: f.dataType for f in real.schema.fields}
        both = real.select(*[F.col(c).cast("double" if is_numeric(kinds[c]) else "string").alias(c) for c in columns])
        both = both.unionByName(synthetic.select(*[F.col(c).cast("double" if is_numeric(kinds[c]) else "string").alias(c) for c in columns]))
        numeric = [c for c in columns if is_numeric(kinds[c])]
        middle = medians(both, numeric)
        return cls({c: (float(middle[c] or 0.0), kinds[c].simpleString()) for c in numeric}, {c: tuple(categories(both, c, MISSING)) for c in columns if c not in numeric})

    def transform(self, df: DataFrame, keep: list[str] = ()) -> DataFrame:
        """Encoded columns as doubles; unknown categories become code 0."""
        inf = float("inf")
        out, coded = [], df
        for c, (middle, kind) in self.numeric.items():
            v = F.coalesce(F.col(c).cast("double"), F.lit(middle))
            v = F.when(v.isin(inf, -inf), 0.0).otherwise(v)
            out.append(v.cast(kind).cast("double").alias(c) if kind in ("int", "bigint", "smallint", "tinyint") else v.alias(c))
        for k, (c, values) in enumerate(self.codes.items()):
            coded = with_code(coded, F.coalesce(F.col(c).cast("string"), F.lit(MISSING)), values, f"_c{k}")
            out.append(F.col(f"_c{k}").alias(c))
        return coded.select(*keep, *out)


def prepare_target(df: DataFrame, target: str, reference: DataFrame | None = None) -> DataFrame:
    """Features coded, numbers with null as 0, text with null as 'missing', and the target as `label` (codes in text order of reference)."""
    reference = df if reference is None else reference
    out, coded = [], df
    for k, f in enumerate(df.schema.fields):
        if f.name == target:
            continue
        if isinstance(f.dataType, T.StringType):
            coded = with_code(coded, F.coalesce(F.col(f.name), F.lit("missing")), categories(reference, f.name, "missing"), f"_c{k}")
            out.append(F.col(f"_c{k}").alias(f.name))
        elif is_numeric(f.dataType):
            out.append(F.coalesce(F.col(f.name).cast("double"), F.lit(0.0)).alias(f.name))
    coded = with_code(coded, F.coalesce(F.col(target).cast("string"), F.lit("missing")), categories(reference, target, "missing"), "_label")
    return coded.select(*out, F.col("_label").alias("label"))
