"""Column types, encoders, splits, summaries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabsieve.functions.frames import r6
from tabsieve.functions.rng import kfold, md5u_sql, sample_n, stratified_split
from tabsieve.operators import columns as X
from tabsieve.operators import encode as E
from tabsieve.operators import weights as W
from tabsieve.plans.sql import CUSTOMER, ROLES, r, with_
from tabsieve.sources.tables import customer_sides, lineitem_roles, table

PART = ["p_name", "p_brand", "p_type", "p_size", "p_retailprice"]
NUMERIC = {"p_size", "p_retailprice"}


def _types(policy):
    return lambda spark, sf: X.types_of(table(spark, sf, "part"), policy, PART)


def pair3(spark, sf):
    p = table(spark, sf, "part")
    return X.types_of_pair(p.where("p_partkey % 5 = 0"), p.where("p_partkey % 5 <> 0"), PART)


def _profile_sql(where: str = "") -> str:
    return " UNION ALL ".join(f"SELECT '{c}' AS col, {str(c in NUMERIC).lower()} AS num, count(*) AS n, count(DISTINCT {c}) AS d FROM part {where}" for c in PART)


def _types_sql(case: str) -> str:
    return f"SELECT col, CASE {case} END AS kind FROM ({_profile_sql()})"


def minmax_onehot(spark, sf):
    real, pool = customer_sides(spark, sf)
    enc = E.FeatureEncoder.fit(real, pool, {"c_acctbal": "numerical", "c_mktsegment": "categorical"})
    out = enc.transform(pool, ["row_id"])
    return out.select("row_id", r6("c_acctbal").alias("c_acctbal"), *[F.col(c) for c in out.columns[2:]])


def label_codes(spark, sf):
    real, pool = customer_sides(spark, sf)
    return E.CodeEncoder.fit(real, pool, ["c_acctbal", "c_mktsegment"]).transform(pool, ["row_id"])


def impute_median(spark, sf):
    e = table(spark, sf, "events").select("event_id", F.when(F.col("event_id") % 7 != 0, F.col("value")).alias("value"))
    m = E.medians(e.where("event_id % 5 = 0"), ["value"])["value"]
    return e.where("event_id % 5 <> 0").select("event_id", r6(F.coalesce("value", F.lit(m))).alias("value"))


def target_codes(spark, sf):
    o = table(spark, sf, "orders").select("o_orderpriority", "o_totalprice", "o_orderstatus", "o_orderkey")
    out = E.prepare_target(o, "o_orderstatus")
    return out.select(F.col("o_orderkey").cast("long").alias("o_orderkey"), "o_orderpriority", r6("o_totalprice", 2).alias("o_totalprice"), "label")


def stratified(spark, sf):
    out = stratified_split(table(spark, sf, "orders").select("o_orderkey", "o_orderstatus"), "o_orderstatus", "o_orderkey", 0.2, 42)
    return out.select("o_orderkey", "o_orderstatus", "split")


def folds(spark, sf):
    return kfold(table(spark, sf, "orders").select("o_orderkey", "o_orderstatus"), "o_orderstatus", "o_orderkey", 5, 42).select("o_orderkey", "fold")


def sampled(spark, sf):
    return sample_n(table(spark, sf, "orders").select("o_orderkey"), 1000, "o_orderkey", 42)


def complement(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey")
    return o.join(sample_n(o, 1000, "o_orderkey", 42), "o_orderkey", "left_anti")


def replicated(spark, sf):
    c = table(spark, sf, "customer").select("c_custkey", "c_nationkey")
    return c.where("c_custkey % 5 = 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(4))))


def data_summary(spark, sf):
    out = X.summary(table(spark, sf, "orders").drop("o_orderdate"))
    return out.withColumn("null_share", r6("null_share"))


def validation(spark, sf):
    c = table(spark, sf, "customer")
    cases = [("same", c, c), ("empty", c, c.limit(0)), ("columns", c, c.drop("c_name")), ("few", c, c.limit(3)), ("types", c, c.withColumn("c_acctbal", F.col("c_acctbal").cast("string")))]
    return spark.createDataFrame([(n, X.validate(a, b)[0]) for n, a, b in cases], "name string, ok boolean")


def memory(spark, sf):
    real, pool = customer_sides(spark, sf)
    e = X.memory_estimate(real.count(), pool.count(), len(real.columns))
    return spark.createDataFrame([tuple(float(v) for v in e.values())], ", ".join(f"{k} double" for k in e)).select(*[r6(k).alias(k) for k in e])


def histogram(spark, sf):
    return W.histogram(lineitem_roles(spark, sf), "l_extendedprice", 50, ["ds"])


def topk(spark, sf):
    return W.top_categories(table(spark, sf, "orders").withColumn("ds", F.when(F.col("o_orderkey") % 2 == 0, "a").otherwise("b")), "ds", "o_orderpriority", 3).withColumn("share", r6("share"))


QUERIES = {
    "column_types_pair3": pair3,
    **{f"column_types_{p}": _types(p) for p in ("corr2", "dist2", "test3", "summary5", "plot3", "number2")},
    "encode_minmax_onehot": minmax_onehot,
    "encode_label_codes": label_codes,
    "impute_median": impute_median,
    "encode_target": target_codes,
    "stratified_split": stratified,
    "kfold_assign": folds,
    "sample_without_replacement": sampled,
    "sample_complement": complement,
    "replicate_rows": replicated,
    "data_summary": data_summary,
    "schema_validation": validation,
    "memory_estimate": memory,
    "histogram_50": histogram,
    "topk_categories": topk,
}

_SEGMENTS = ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")
_RANKED = "SELECT o_orderkey, o_orderstatus, row_number() OVER (PARTITION BY o_orderstatus ORDER BY " + md5u_sql(42, "o_orderkey") + ", o_orderkey) AS rk, count(*) OVER (PARTITION BY o_orderstatus) AS sz FROM orders"
_SAMPLE = "SELECT o_orderkey FROM (SELECT o_orderkey, row_number() OVER (ORDER BY " + md5u_sql(42, "o_orderkey") + ", o_orderkey) AS rk FROM orders) WHERE rk <= 1000"
_O = "o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority"

SQL = {
    "column_types_pair3": f"SELECT col, CASE WHEN a.d <= 2 AND b.d <= 2 THEN 'binary' WHEN NOT a.num OR (a.d/a.n < 0.05 AND b.d/b.n < 0.05 AND a.d < 20) THEN 'categorical' ELSE 'numerical' END AS kind FROM ({_profile_sql('WHERE p_partkey % 5 = 0')}) a JOIN ({_profile_sql('WHERE p_partkey % 5 <> 0')}) b USING (col)",
    "column_types_corr2": _types_sql("WHEN num AND NOT (d/n < 0.05 AND d < 20) THEN 'numerical' ELSE 'categorical'"),
    "column_types_dist2": _types_sql("WHEN num AND NOT (d/n < 0.05 AND d <= 50) THEN 'numerical' ELSE 'categorical'"),
    "column_types_test3": _types_sql("WHEN num AND d > 10 THEN 'numerical' WHEN d = 2 THEN 'binary' ELSE 'multiclass'"),
    "column_types_summary5": _types_sql("WHEN num AND d <= 2 THEN 'binary' WHEN num AND d < 20 AND d/n < 0.05 THEN 'categorical_numeric' WHEN num THEN 'continuous' WHEN d <= 2 THEN 'binary_categorical' ELSE 'categorical'"),
    "column_types_plot3": _types_sql("WHEN d > 10 THEN 'continuous' WHEN d <= 2 THEN 'binary' ELSE 'categorical'"),
    "column_types_number2": _types_sql("WHEN num THEN 'number' ELSE 'other'"),
    "encode_minmax_onehot": "SELECT c_custkey AS row_id, " + r("(c_acctbal-lo)/(hi-lo)") + " AS c_acctbal, " + ", ".join(f"(CASE WHEN c_mktsegment='{s}' THEN 1.0 ELSE 0.0 END)::double AS \"c_mktsegment_{s}\"" for s in _SEGMENTS) + " FROM customer CROSS JOIN (SELECT min(c_acctbal) AS lo, max(c_acctbal) AS hi FROM customer WHERE c_custkey % 5 = 0) WHERE c_custkey % 5 <> 0",
    "encode_label_codes": with_(CUSTOMER) + "SELECT row_id, a AS c_acctbal, b AS c_mktsegment FROM po",
    "impute_median": "WITH e AS (SELECT event_id, CASE WHEN event_id % 7 <> 0 THEN value END AS value FROM events) SELECT event_id, " + r("coalesce(value, (SELECT median(value) FROM e WHERE event_id % 5 = 0))") + " AS value FROM e WHERE event_id % 5 <> 0",
    "encode_target": "SELECT o_orderkey, (SELECT count(DISTINCT x.o_orderpriority) FROM orders x WHERE x.o_orderpriority < o.o_orderpriority)::double AS o_orderpriority, " + r("o_totalprice", 2) + " AS o_totalprice, (SELECT count(DISTINCT x.o_orderstatus) FROM orders x WHERE x.o_orderstatus < o.o_orderstatus)::double AS label FROM orders o",
    "stratified_split": f"SELECT o_orderkey, o_orderstatus, CASE WHEN rk <= floor(sz*0.2::double+0.5::double) THEN 'test' ELSE 'train' END AS split FROM ({_RANKED})",
    "kfold_assign": f"SELECT o_orderkey, ((rk-1) % 5)::int AS fold FROM ({_RANKED})",
    "sample_without_replacement": _SAMPLE,
    "sample_complement": f"SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN ({_SAMPLE})",
    "replicate_rows": "SELECT c_custkey, c_nationkey, copy::int AS copy FROM customer CROSS JOIN (SELECT unnest([1,2,3,4]) AS copy) WHERE c_custkey % 5 = 0",
    "data_summary": "WITH p AS (" + " UNION ALL ".join(f"SELECT {str(c in ('o_orderkey', 'o_custkey', 'o_totalprice')).lower()} AS num, count(*) AS n, count(DISTINCT {c}) AS d, count(*)-count({c}) AS z FROM orders" for c in _O) + ") SELECT max(n) AS rows, count(*) AS columns, sum(z)::bigint AS nulls, " + r("sum(z)/(max(n)*count(*))") + f" AS null_share, max(n) - (SELECT count(*) FROM (SELECT DISTINCT {', '.join(_O)} FROM orders)) AS duplicate_rows, count(*) FILTER (num AND d<=2) AS n_binary, count(*) FILTER (num AND d>2 AND d<20 AND d/n<0.05) AS n_categorical_numeric, count(*) FILTER (num AND d>2 AND NOT (d<20 AND d/n<0.05)) AS n_continuous, count(*) FILTER (NOT num AND d<=2) AS n_binary_categorical, count(*) FILTER (NOT num AND d>2) AS n_categorical FROM p",
    "schema_validation": "SELECT * FROM (VALUES ('same', true), ('empty', false), ('columns', false), ('few', false), ('types', false)) t(name, ok)",
    "memory_estimate": "WITH n AS (SELECT count(*) FILTER (c_custkey % 5 = 0)::double AS a, count(*) FILTER (c_custkey % 5 <> 0)::double AS b FROM customer) SELECT " + r("a*5*8/1048576") + " AS real_mb, " + r("b*5*8/1048576") + " AS synthetic_mb, " + r("a*b*4/1048576") + " AS distance_mb, " + r("a*5*8/1048576 + b*5*8/1048576 + a*b*4/1048576") + " AS total_mb FROM n",
    "histogram_50": with_(ROLES, "s AS (SELECT min(l_extendedprice) AS lo, max(l_extendedprice) AS hi FROM roles)") + "SELECT ds, least(floor((l_extendedprice-lo)/(hi-lo)*50), 49)::int AS bin, count(*) AS n FROM roles CROSS JOIN s GROUP BY 1,2",
    "topk_categories": "WITH c AS (SELECT CASE WHEN o_orderkey % 2 = 0 THEN 'a' ELSE 'b' END AS ds, o_orderpriority AS value FROM orders), k AS (SELECT ds, value, count(*) AS n, sum(count(*)) OVER (PARTITION BY ds) AS t, row_number() OVER (PARTITION BY ds ORDER BY count(*) DESC, value) AS rk FROM c GROUP BY 1,2) SELECT ds, value, n, " + r("n/t") + " AS share FROM k WHERE rk <= 3",
}
