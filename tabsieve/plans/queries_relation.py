"""Associations, hypothesis tests, comparison tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabsieve.functions.frames import r6
from tabsieve.operators import association as A
from tabsieve.operators import hypothesis as H
from tabsieve.operators import moments as M
from tabsieve.operators import reports as R
from tabsieve.plans.sql import CDF, ETA, GRID, MARGINS, MIXED, MOMENTS, NPAIRS, NUMS, ROLES, SPEAR, r, with_
from tabsieve.sources.tables import lineitem_roles, table

CATS = ["l_returnflag", "l_linestatus", "l_linenumber"]
TWO = ["l_returnflag", "l_linestatus"]
N = list(NUMS)


def cramers(spark, sf):
    return A.cramers_v(lineitem_roles(spark, sf), CATS, "ds").withColumn("v", r6("v"))


def eta(spark, sf):
    return A.eta_squared(lineitem_roles(spark, sf), TWO, N, "ds").withColumn("eta2", r6("eta2"))


def eta_documents(spark, sf):
    d = table(spark, sf, "documents").withColumn("ds", F.lit("all"))
    return A.eta_squared(d, ["lang", "source"], ["n_chars"], "ds").withColumn("eta2", r6("eta2"))


def cramers_labels(spark, sf):
    t = table(spark, sf, "labels").withColumn("ds", F.lit("all"))
    return A.cramers_v(t, ["quality", "toxic"], "ds").withColumn("v", r6("v"))


def pearson(spark, sf):
    return A.pearson(lineitem_roles(spark, sf), N, "ds").withColumn("r", r6("r"))


def spearman(spark, sf):
    return A.spearman(lineitem_roles(spark, sf), N, "ds").withColumn("r", r6("r"))


def kendall(spark, sf):
    p = table(spark, sf, "part").withColumn("ds", F.lit("all"))
    return A.kendall(p, ["p_size", "p_retailprice"], "ds").withColumn("tau", r6("tau"))


def matrix(spark, sf):
    return A.mixed_matrix(lineitem_roles(spark, sf), TWO, N, "ds")


def mixed(spark, sf):
    return matrix(spark, sf).withColumn("value", r6("value"))


def blocks(spark, sf):
    b = A.block_statistics(matrix(spark, sf), "ds")
    return b.select("ds", "kind", "n", *[r6(c).alias(c) for c in ("mean", "std", "min", "max", "abs_mean")])


def similarity(spark, sf):
    s = A.matrix_similarity(matrix(spark, sf), "ds", "real", ("raw", "refined"))
    return s.select("candidate", *[r6(c).alias(c) for c in s.columns[1:]])


def improvement(spark, sf):
    s = A.matrix_similarity(matrix(spark, sf), "ds", "real", ("raw", "refined"))
    return A.improvement(s, ["frobenius", "mae", "mse"], "raw", "refined").select("metric", r6("raw").alias("raw"), r6("refined").alias("refined"), r6("percent", 3).alias("percent"))


def mi(spark, sf):
    return A.mutual_information(lineitem_roles(spark, sf), CATS, "ds").withColumn("mi", r6("mi"))


def mi_knn(spark, sf):
    return A.mutual_information_knn(table(spark, sf, "part"), "p_partkey", "p_size", "p_retailprice")


def mi_matrix(spark, sf):
    return A.mutual_information_matrix(table(spark, sf, "part").select("p_partkey", "p_type", "p_brand", "p_size", "p_retailprice"), "p_partkey", ["p_size", "p_retailprice"], ["p_type", "p_brand"])


def consensus(spark, sf):
    return A.consensus(matrix(spark, sf), "ds").select("row_var", "col_var", "kind", r6("mean").alias("mean"), r6("std").alias("std"))


def _comparison(test):
    def query(spark, sf):
        o = table(spark, sf, "orders").select("o_orderkey", "o_totalprice", F.length("o_orderpriority").alias("width"), (F.col("o_custkey") % 2).cast("int").alias("odd"), "o_orderstatus")
        side = lambda *k: o.where((F.col("o_orderkey") % 5).isin(*k))
        return H.compare_distributions(side(0), side(1, 2).where("o_totalprice > 30000"), side(3, 4), "o_orderkey", numerical_test=test)

    return query


def welch(spark, sf):
    return H.welch(lineitem_roles(spark, sf), "ds", "real", ("raw", "refined"), N).select("col", "candidate", r6("t").alias("t"), r6("df", 2).alias("df"))


def welch_p(spark, sf):
    return H.similar(H.welch_test(lineitem_roles(spark, sf), "ds", "real", ("raw", "refined"), N))


def anderson(spark, sf):
    return H.anderson_ksamp(lineitem_roles(spark, sf), "ds", "real", "raw", ["l_quantity", "l_extendedprice", "l_discount"]).select("col", r6("a2", 4).alias("a2"))


def anderson_p(spark, sf):
    return H.anderson_test(lineitem_roles(spark, sf), "ds", "real", "raw", ["l_quantity", "l_extendedprice", "l_discount"])


def homogeneity(spark, sf):
    return H.chi2_homogeneity(lineitem_roles(spark, sf), "ds", "real", "raw", CATS).select("col", r6("chi2").alias("chi2"), F.col("df").cast("long").alias("df"))


def chi2_pairs(spark, sf):
    o = table(spark, sf, "orders")
    a, b = o.where("o_orderkey % 5 = 0"), o.where("o_orderkey % 5 IN (1, 2)")
    return H.chi2_pairs(a, b, "o_orderkey", ["o_orderstatus", "o_orderpriority"]).select("col", r6("chi2").alias("chi2"), F.col("df").cast("long").alias("df"))


def descriptive(spark, sf):
    d = H.descriptive(lineitem_roles(spark, sf), "ds", N, CATS)
    return d.select("ds", "col", r6("mean", 4).alias("mean"), r6("std", 4).alias("std"), "mode", r6("mode_share").alias("mode_share"))


BASE = [("stats.ks", 0.5, "maximize"), ("stats.w1", 2.0, "minimize"), ("privacy.k", 3.0, "maximize"), ("runtime", 4.0, "minimize"), ("stats.zero", 0.0, "maximize"), ("only.base", 1.0, "maximize"), ("odd.dir", 1.0, "sideways")]
REFINED = [("stats.ks", 0.6), ("stats.w1", 1.0), ("privacy.k", 3.0), ("runtime", 5.0), ("stats.zero", 0.25), ("odd.dir", 0.5)]


def _tables(spark):
    return spark.createDataFrame(BASE, "metric string, mean double, direction string"), spark.createDataFrame(REFINED, "metric string, mean double")


def compare(spark, sf):
    return R.compare_metrics(*_tables(spark)).withColumn("rate", r6("rate"))


def detailed(spark, sf):
    d = R.detailed_metrics(*_tables(spark))
    return d.select("metric", *[r6(c).alias(c) for c in ("baseline", "refined", "improvement", "percent")], "is_better")


def describe(spark, sf):
    from tabsieve.functions.frames import melt, quantiles

    long = melt(lineitem_roles(spark, sf), N, ["ds"])
    middle = quantiles(long, ["ds", "col"], "value", [0.5]).select("ds", "col", F.get("q", F.lit(0)).alias("median"))
    m = long.groupBy("ds", "col").agg(F.avg("value").alias("mean"), F.stddev_samp("value").alias("std")).join(middle, ["ds", "col"])
    return R.describe_improvement(m, "ds", "real", "raw", "refined").withColumn("improvement", r6("improvement", 4))


def corr_improvement(spark, sf):
    c = A.pearson(lineitem_roles(spark, sf), N, "ds")
    return R.correlation_improvement(c, "ds", "real", "raw", "refined").withColumn("improvement", r6("improvement"))


def retention(spark, sf):
    return R.retention(lineitem_roles(spark, sf), "ds", "raw", "refined").withColumn("rate", r6("rate"))


QUERIES = {
    "cramers_v": cramers,
    "cramers_v_yates": cramers_labels,
    "eta_squared": eta,
    "eta_squared_documents": eta_documents,
    "corr_pearson": pearson,
    "corr_spearman": spearman,
    "corr_kendall": kendall,
    "mixed_corr_lower": mixed,
    "corr_block_stats": blocks,
    "corr_similarity": similarity,
    "corr_analysis_improvement": improvement,
    "mutual_info_discrete": mi,
    "mutual_info_knn": mi_knn,
    "mutual_info_matrix": mi_matrix,
    "corr_consensus": consensus,
    **{f"compare_distributions_{t}": _comparison(t) for t in ("ttest", "ks", "ad")},
    "welch_t": welch,
    "welch_test": welch_p,
    "anderson_ksamp": anderson,
    "anderson_test": anderson_p,
    "chi2_homogeneity": homogeneity,
    "chi2_pairs": chi2_pairs,
    "descriptive_statistics": descriptive,
    "compare_metric_tables": compare,
    "detailed_metric_table": detailed,
    "describe_improvement": describe,
    "corr_improvement": corr_improvement,
    "retention": retention,
}

_COUNT = "SELECT ds, x, y, vx, vy, count(*)::double AS n FROM pairs GROUP BY ALL"
_ALLPAIRS = (
    "c AS (" + _COUNT + "), m AS (SELECT *, sum(n) OVER (PARTITION BY ds,x,y,vx) AS nr, sum(n) OVER (PARTITION BY ds,x,y,vy) AS nc, sum(n) OVER (PARTITION BY ds,x,y) AS nn FROM c), " + GRID
)
_HOM = "pairs AS (" + " UNION ALL ".join(f"SELECT 'all' AS ds, '{c}' AS x, '' AS y, ds AS vx, {c}::varchar AS vy FROM roles WHERE ds IN ('real','raw')" for c in CATS) + "), " + _ALLPAIRS
_POS = (
    "pa AS (SELECT row_number() OVER (ORDER BY o_orderkey) AS pos, * FROM orders WHERE o_orderkey % 5 = 0), pb AS (SELECT row_number() OVER (ORDER BY o_orderkey) AS pos, * FROM orders WHERE o_orderkey % 5 IN (1,2)), pairs AS ("
    + " UNION ALL ".join(f"SELECT 'all' AS ds, '{c}' AS x, '' AS y, pa.{c} AS vx, pb.{c} AS vy FROM pa JOIN pb USING (pos)" for c in ("o_orderstatus", "o_orderpriority"))
    + "), "
    + _ALLPAIRS
)
_SIM = (
    MIXED + ", dd AS (SELECT q.ds AS candidate, kind, p.value - q.value AS d FROM mat q JOIN mat p USING (row_var, col_var, kind) WHERE p.ds='real' AND q.ds <> 'real'), bl AS (SELECT candidate, kind, avg(abs(d)) AS a FROM dd GROUP BY ALL), "
    "sim AS (SELECT candidate, sqrt(sum(d*d)) AS frobenius, sqrt(sum(d*d))/sqrt(count(*)) AS normalised, avg(abs(d)) AS mae, avg(d*d) AS mse, (SELECT avg(a) FROM bl WHERE bl.candidate = dd.candidate) AS block_mae FROM dd GROUP BY candidate)"
)
_VAL = "v(metric, mean, direction) AS (VALUES " + ", ".join(f"('{m}', {x}::double, '{d}')" for m, x, d in BASE) + "), w(metric, mean) AS (VALUES " + ", ".join(f"('{m}', {x}::double)" for m, x in REFINED) + "), j AS (SELECT v.metric, v.mean AS b, w.mean AS r, CASE WHEN direction='maximize' THEN w.mean - v.mean ELSE v.mean - w.mean END AS gain FROM v JOIN w USING (metric))"
_ETA_DOC = "el AS (" + " UNION ALL ".join(f"SELECT 'all' AS ds, '{c}' AS cat, 'n_chars' AS num, {c} AS g, n_chars::double AS v FROM documents" for c in ("lang", "source")) + "), " + ETA.partition("), ew AS")[1].removeprefix("), ") + ETA.partition("), ew AS")[2]
_N = "na+nb"
_B = "(ca+cb-(a+b)+(a+b)/2.0::double)"
_AD = lambda c, u, n: f"sum((a+b)/({_N})*pow(({_N})*({u}-{c}/2.0::double)-{_B}*{n}, 2)/({_B}*({_N}-{_B})-({_N})*(a+b)/4.0::double))"

SQL = {
    "cramers_v": with_(ROLES, MARGINS, GRID) + "SELECT ds, x, y, " + r("v") + " AS v FROM cv",
    "cramers_v_yates": with_("pairs AS (SELECT 'all' AS ds, 'quality' AS x, 'toxic' AS y, quality::varchar AS vx, toxic::varchar AS vy FROM labels)", _ALLPAIRS) + "SELECT ds, x, y, " + r("v") + " AS v FROM cv",
    "eta_squared": with_(ROLES, ETA) + "SELECT ds, cat, num, " + r("eta2") + " AS eta2 FROM eta",
    "eta_squared_documents": with_(_ETA_DOC) + "SELECT ds, cat, num, " + r("eta2") + " AS eta2 FROM eta",
    "corr_pearson": with_(ROLES, f"np AS ({NPAIRS})") + "SELECT ds, x, y, " + r("corr(vx, vy)") + " AS r FROM np GROUP BY ALL",
    "corr_spearman": with_(ROLES, SPEAR) + "SELECT ds, x, y, " + r("r") + " AS r FROM sp",
    "corr_kendall": "WITH p AS (SELECT p_size::double AS a, p_retailprice AS b, row_number() OVER (ORDER BY p_partkey) AS i FROM part) SELECT 'all' AS ds, 'p_size' AS x, 'p_retailprice' AS y, " + r("sum(sign(p.a-q.a)*sign(p.b-q.b))/sqrt(sum(abs(sign(p.a-q.a)))::double*sum(abs(sign(p.b-q.b)))::double)") + " AS tau FROM p JOIN p q ON p.i < q.i",
    "mixed_corr_lower": with_(ROLES, MIXED) + "SELECT ds, row_var, col_var, kind, " + r("value") + " AS value FROM mat",
    "corr_block_stats": with_(ROLES, MIXED) + "SELECT ds, kind, count(value) AS n, " + r("avg(value)") + " AS mean, " + r("stddev_pop(value)") + " AS std, " + r("min(value)") + ' AS "min", ' + r("max(value)") + ' AS "max", ' + r("avg(abs(value))") + " AS abs_mean FROM mat GROUP BY ds, kind",
    "corr_similarity": with_(ROLES, _SIM) + "SELECT candidate, " + ", ".join(f"{r(c)} AS {c}" for c in ("frobenius", "normalised", "mae", "mse", "block_mae")) + " FROM sim",
    "corr_analysis_improvement": with_(ROLES, _SIM, "im AS (" + " UNION ALL ".join(f"SELECT '{m}' AS metric, max({m}) FILTER (candidate='raw') AS a, max({m}) FILTER (candidate='refined') AS b FROM sim" for m in ("frobenius", "mae", "mse")) + ")") + "SELECT metric, " + r("a") + " AS raw, " + r("b") + " AS refined, " + r("CASE WHEN a > 0 THEN (a-b)/a*100 ELSE 0 END", 3) + " AS percent FROM im",
    "corr_consensus": with_(ROLES, MIXED) + "SELECT row_var, col_var, kind, " + r("avg(value)") + " AS mean, " + r("stddev_pop(value)") + " AS std FROM mat GROUP BY 1,2,3",
    "mutual_info_discrete": with_(ROLES, MARGINS) + "SELECT ds, x, y, " + r("sum(n/nn*ln(n*nn/(nr*nc)))") + " AS mi FROM m GROUP BY ds, x, y",
    "welch_t": with_(ROLES, "long AS (" + " UNION ALL ".join(f"SELECT ds, '{c}' AS col, {c}::double AS value FROM roles" for c in N) + ")", "s AS (SELECT ds, col, avg(value) AS m, var_samp(value)/count(*) AS v, count(*) AS n FROM long GROUP BY 1,2)") + "SELECT b.col, b.ds AS candidate, " + r("(a.m-b.m)/sqrt(a.v+b.v)") + " AS t, " + r("pow(a.v+b.v,2)/(a.v*a.v/(a.n-1)+b.v*b.v/(b.n-1))", 2) + " AS df FROM s b JOIN s a ON a.col=b.col AND a.ds='real' WHERE b.ds <> 'real'",
    "anderson_ksamp": with_(ROLES, CDF) + f"SELECT col, {r(f'(any_value({_N})-1)/any_value({_N})*(' + _AD('a', 'ca', 'na') + '/any_value(na)+' + _AD('b', 'cb', 'nb') + '/any_value(nb))', 4)} AS a2 FROM cdf GROUP BY col",
    "chi2_homogeneity": with_(ROLES, _HOM) + "SELECT x AS col, " + r("chi2") + " AS chi2, (r-1)*(k-1) AS df FROM chi",
    "chi2_pairs": with_(_POS) + "SELECT x AS col, " + r("chi2") + " AS chi2, (r-1)*(k-1) AS df FROM chi",
    "descriptive_statistics": with_(ROLES, "long AS (" + " UNION ALL ".join(f"SELECT ds, '{c}' AS col, {c}::double AS value FROM roles" for c in N) + ")", "cl AS (" + " UNION ALL ".join(f"SELECT ds, '{c}' AS col, {c}::varchar AS value FROM roles" for c in CATS) + ")", "ct AS (SELECT ds, col, value, count(*) AS k, sum(count(*)) OVER (PARTITION BY ds, col) AS t, row_number() OVER (PARTITION BY ds, col ORDER BY count(*) DESC, value) AS rk FROM cl GROUP BY 1,2,3)") + "SELECT ds, col, " + r("avg(value)", 4) + " AS mean, " + r("stddev_samp(value)", 4) + " AS std, NULL::varchar AS mode, NULL::double AS mode_share FROM long GROUP BY 1,2 UNION ALL SELECT ds, col, NULL, NULL, value, " + r("k/t") + " FROM ct WHERE rk = 1",
    "compare_metric_tables": with_(_VAL) + "SELECT CASE WHEN contains(metric, '.') THEN split_part(metric, '.', 1) ELSE 'other' END AS cls, count(*) FILTER (gain>0) AS better, count(*) FILTER (gain<0) AS worse, count(*) FILTER (gain=0) AS unchanged, " + r("(count(*) FILTER (gain>0))/count(*)") + " AS rate FROM j GROUP BY 1",
    "detailed_metric_table": with_(_VAL) + "SELECT metric, " + r("b") + " AS baseline, " + r("r") + " AS refined, " + r("gain") + " AS improvement, " + r("CASE WHEN b=0 THEN 0 ELSE gain/abs(b)*100 END") + " AS percent, gain > 0 AS is_better FROM j",
    "describe_improvement": with_(ROLES, MOMENTS, "st AS (" + " UNION ALL ".join(f"SELECT ds, col, '{s}' AS stat, {c} AS v FROM mom" for s, c in (("mean", "mean"), ("std", "sd"), ("median", "median"))) + ")") + "SELECT a.col, a.stat, " + r("coalesce(CASE WHEN abs(b.v-a.v) <> 0 THEN (abs(b.v-a.v)-abs(c.v-a.v))/abs(b.v-a.v) END, 0)", 4) + " AS improvement FROM st a JOIN st b ON a.col=b.col AND a.stat=b.stat AND b.ds='raw' JOIN st c ON a.col=c.col AND a.stat=c.stat AND c.ds='refined' WHERE a.ds='real'",
    "corr_improvement": with_(ROLES, f"np AS ({NPAIRS})", "co AS (SELECT ds, x, y, corr(vx, vy) AS r FROM np GROUP BY ALL)") + "SELECT a.x, a.y, " + r("abs(a.r-b.r)-abs(a.r-c.r)") + " AS improvement FROM co a JOIN co b ON a.x=b.x AND a.y=b.y AND b.ds='raw' JOIN co c ON a.x=c.x AND a.y=c.y AND c.ds='refined' WHERE a.ds='real'",
    "retention": with_(ROLES) + "SELECT count(*) FILTER (ds='raw') AS n_raw, count(*) FILTER (ds='refined') AS n_refined, " + r("(count(*) FILTER (ds='refined'))/(count(*) FILTER (ds='raw'))") + " AS rate FROM roles",
}
