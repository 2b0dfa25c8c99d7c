"""Reading inputs, deriving the real / raw / refined roles, and writing results."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabsieve.functions.rng import md5u, md5u_sql


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def clean_numbers(df: DataFrame) -> DataFrame:
    """NaN becomes null, infinities become 0, in all floating-point columns."""
    inf = float("inf")
    kinds = dict(df.dtypes)
    return df.select(*[F.when(F.isnan(c), None).when(F.col(c).isin(inf, -inf), 0.0).otherwise(F.col(c)).alias(c) if kinds[c] in ("double", "float") else F.col(c) for c in df.columns])


def common_columns(first: DataFrame, *others: DataFrame) -> list[str]:
    """Columns that all tables have, in the first one's order."""
    return [c for c in first.columns if all(c in o.columns for o in others)]


def lineitem_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem with ds: real, raw (biased towards high discounts) or refined."""
    k = F.col("l_orderkey") % 5
    u = md5u(42, F.col("l_orderkey") * 8 + F.col("l_linenumber"))
    ds = F.when(k == 0, "real").when(k.isin(1, 2) & ((F.col("l_discount") > 0.03) | (u < 0.4)), "raw").when(k.isin(3, 4), "refined")
    return table(spark, sf_dir, "lineitem").withColumn("ds", ds).where("ds IS NOT NULL")


ROLES_SQL = (
    "roles AS (SELECT * FROM (SELECT *, CASE WHEN l_orderkey % 5 = 0 THEN 'real' WHEN l_orderkey % 5 IN (1,2) AND (l_discount > 0.03::double OR "
    + md5u_sql(42, "(l_orderkey*8+l_linenumber)")
    + " < 0.4::double) THEN 'raw' WHEN l_orderkey % 5 IN (3,4) THEN 'refined' END AS ds FROM lineitem) WHERE ds IS NOT NULL)"
)


def customer_sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(real, pool): every fifth customer against the rest."""
    c = table(spark, sf_dir, "customer").withColumnRenamed("c_custkey", "row_id")
    return c.where("row_id % 5 = 0"), c.where("row_id % 5 <> 0")


def save(df: DataFrame, path: str, kind: str = "parquet") -> None:
    """Write a result as parquet, json or csv."""
    df.write.mode("overwrite").format(kind).save(path)


def load(spark: SparkSession, path: str, kind: str = "parquet") -> DataFrame:
    return spark.read.format(kind).load(path)


def to_json(df: DataFrame, most_rows: int = 10_000) -> str:
    """A small result as a JSON list; refuses tables of more than most_rows rows."""
    rows = df.limit(most_rows + 1).collect()
    if len(rows) > most_rows:
        raise ValueError("too many rows for JSON text; use save()")
    return json.dumps([r.asDict(recursive=True) for r in rows], default=str)
