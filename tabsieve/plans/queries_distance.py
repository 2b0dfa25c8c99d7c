"""Frequencies, divergences, distribution distances, moments, discrepancies."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabsieve.functions import special
from tabsieve.functions.frames import r6
from tabsieve.operators import divergence as D
from tabsieve.operators import moments as M
from tabsieve.operators import reports as R
from tabsieve.operators.hypothesis import with_p
from tabsieve.plans.sql import BINNED, CDF, FREQ, MOMENTS, NORMAL, NUMS, ROLES, SCALED, r, with_
from tabsieve.sources.tables import lineitem_roles, table

CATS = ["l_returnflag", "l_linestatus", "l_linenumber"]
CONT = ["l_quantity", "l_extendedprice", "l_discount"]


def freq(spark, sf):
    return D.frequencies(lineitem_roles(spark, sf), "ds", "real", "raw", CATS)


def binned(spark, sf):
    return D.frequencies_binned(lineitem_roles(spark, sf), "ds", "real", "raw", CONT)


def _rounded(f, *cols):
    return lambda spark, sf: (lambda d: d.select(*[r6(c).alias(c) if c in cols else F.col(c) for c in d.columns]))(f(spark, sf))


def _marginal(column, source=freq):
    return lambda spark, sf: D.marginal_distances(source(spark, sf)).select("col", r6(column).alias(column))


def chi2(spark, sf):
    return D.marginal_distances(freq(spark, sf)).select("col", r6("chi2").alias("chi2"), F.col("df").cast("long").alias("df"))


def chi2_p(spark, sf):
    return with_p(D.marginal_distances(freq(spark, sf)), "p", special.chi2_sf, "chi2", "df").select("col", r6("p").alias("p"))


def js_joint(spark, sf):
    return D.joint_js(lineitem_roles(spark, sf), "ds", "real", "raw", CATS).select(r6("js_joint").alias("js_joint"))


def distances(spark, sf):
    return D.cdf_distances(D.cdf_frame(lineitem_roles(spark, sf), "ds", "real", "raw", CONT))


def ks(spark, sf):
    return distances(spark, sf).select("col", r6("ks").alias("ks"))


def ks_p(spark, sf):
    return with_p(distances(spark, sf), "p", lambda d, n, m: special.ks_sf(d, int(n), int(m)), "ks", "na", "nb").select("col", r6("p").alias("p"))


def w1(spark, sf):
    return distances(spark, sf).select("col", r6("w1", 4).alias("w1"))


def marginal(spark, sf):
    return distances(spark, sf).agg(*[r6(f(c), 4).alias(f"{c}_{n}") for c in ("ks", "w1") for n, f in (("mean", F.avg), ("max", F.max))])


def prop_diff(spark, sf):
    return D.proportion_difference(lineitem_roles(spark, sf), "ds", "real", ("raw", "refined"), CATS).select("col", r6("raw").alias("raw"), r6("refined").alias("refined"))


def distribution_metrics(spark, sf):
    """W1 for numbers, mean share difference for the others, for both candidates."""
    df = lineitem_roles(spark, sf)
    side = lambda s: D.cdf_distances(D.cdf_frame(df, "ds", "real", s, ["l_quantity", "l_discount"])).select("col", F.col("w1").alias(s))
    numbers = side("raw").join(side("refined"), "col").withColumn("metric", F.lit("w1"))
    others = D.proportion_difference(df, "ds", "real", ("raw", "refined"), CATS).withColumn("metric", F.lit("prop_diff"))
    both = numbers.unionByName(others)
    return both.select("col", "metric", r6("raw").alias("raw"), r6("refined").alias("refined"), (F.col("refined") < F.col("raw")).alias("improved"))


def scaled(spark, sf):
    return M.min_max(lineitem_roles(spark, sf), "ds", "real", list(NUMS))


def linear(spark, sf):
    return M.mmd_linear(scaled(spark, sf), "ds", "real", "raw", list(NUMS)).select(r6("mmd", 9).alias("mmd"))


def poly2(spark, sf):
    return M.mmd_poly2(scaled(spark, sf), "ds", "real", "raw", list(NUMS)).select(r6("mmd", 9).alias("mmd"))


def part_scaled(spark, sf):
    p = table(spark, sf, "part").withColumn("ds", F.when(F.col("p_partkey") % 2 == 0, "real").otherwise("raw"))
    return M.min_max(p, "ds", "real", ["p_size", "p_retailprice"], ["p_partkey"])


def rbf(spark, sf):
    return M.mmd_rbf(part_scaled(spark, sf), "ds", "real", "raw", ["p_size", "p_retailprice"]).select(r6("mmd", 9).alias("mmd"))


def rbf_root(spark, sf):
    return M.mmd_rbf(part_scaled(spark, sf), "ds", "real", "raw", ["p_size", "p_retailprice"]).select(r6(F.sqrt(F.greatest("mmd", F.lit(0.0))), 6).alias("mmd"))


def sinkhorn(spark, sf):
    return M.sinkhorn(part_scaled(spark, sf), "ds", "real", "raw", ["p_size", "p_retailprice"], "p_partkey")


def moments(spark, sf):
    m = M.moments(lineitem_roles(spark, sf), "ds", list(NUMS))
    return m.select("ds", "col", *[r6(c, 4).alias(c) for c in m.columns[2:]])


def moments_compare(spark, sf):
    m = M.moments_compare(M.moments(lineitem_roles(spark, sf), "ds", list(NUMS)), "ds", "real", "raw")
    return m.select("moment", *[r6(c, 3).alias(c) for c in ("mae", "max", "mse")])


def corr_gap(spark, sf):
    g = M.correlation_gap(lineitem_roles(spark, sf), "ds", "real", "raw", list(NUMS))
    return g.select(*[r6(c).alias(c) for c in g.columns])


def similarity(spark, sf):
    df = lineitem_roles(spark, sf).withColumn("row", F.xxhash64("l_orderkey", "l_linenumber", "l_extendedprice")).withColumn("q", F.round(F.col("l_quantity") / 5)).select("ds", "row", "l_returnflag", "l_linestatus", "q", "l_discount")
    return R.similarity_report(df, "ds", "real", "raw", "refined", ["l_returnflag", "l_linestatus"], ["q", "l_discount"], "row")


QUERIES = {
    "freq_categorical": _rounded(freq, "p", "q"),
    "freq_discretized": _rounded(binned, "p", "q"),
    "js_marginal": _marginal("js"),
    "js_marginal_discretized": _marginal("js", binned),
    "inverse_kl": _marginal("inverse_kl"),
    "inverse_kl_discretized": _marginal("inverse_kl", binned),
    "tvd": _marginal("tvd"),
    "hellinger": _marginal("hellinger"),
    "chi2_statistic": chi2,
    "chi2_pvalue": chi2_p,
    "js_joint": js_joint,
    "ks_statistic": ks,
    "ks_pvalue": ks_p,
    "wasserstein_1d": w1,
    "marginal_metrics": marginal,
    "prop_diff": prop_diff,
    "distribution_metrics": distribution_metrics,
    "mmd_linear": linear,
    "mmd_poly2": poly2,
    "mmd_rbf": rbf,
    "mmd_rbf_sqrt": rbf_root,
    "sinkhorn_divergence": sinkhorn,
    "moments": moments,
    "moments_compare": moments_compare,
    "corr_metrics": corr_gap,
    "distribution_similarity_report": similarity,
}

_DIST = {
    "js": "sqrt(greatest(sum(p1*ln(p1/m)+q1*ln(q1/m))/2, 0))",
    "inverse_kl": "1/(1+sum(p1*ln(p1/q1)))",
    "tvd": "sum(abs(p1-q1))/2",
    "hellinger": "sqrt(greatest(1-sum(sqrt(p1*q1)), 0))",
}


def _dist(name: str, source: str = FREQ) -> str:
    return with_(ROLES, source, NORMAL) + f"SELECT col, {r(_DIST[name])} AS {name} FROM f GROUP BY col"


_S = [f"s{k}" for k in range(len(NUMS))]
_PART = "sp AS (SELECT min(p_size) AS a0, max(p_size) AS a1, min(p_retailprice) AS b0, max(p_retailprice) AS b1 FROM part WHERE p_partkey % 2 = 0), x AS (SELECT p_partkey % 2 AS ds, (p_size-a0)::double/(a1-a0) AS a, (p_retailprice-b0)/(b1-b0) AS b, count(*)::double AS n FROM part CROSS JOIN sp GROUP BY ALL), k AS (SELECT x.ds AS d1, y.ds AS d2, sum(x.n*y.n*exp(-((x.a-y.a)*(x.a-y.a)+(x.b-y.b)*(x.b-y.b))))/(sum(x.n*y.n)) AS v FROM x CROSS JOIN x y GROUP BY 1,2)"
_MMD = "sum(CASE WHEN d1=d2 THEN v ELSE -v END)"
_MCOMP = MOMENTS + ", d AS (" + " UNION ALL ".join(f"SELECT '{c}' AS moment, abs(a.{c}-b.{c}) AS d FROM mom a JOIN mom b USING (col) WHERE a.ds='real' AND b.ds='raw'" for c in ("mean", "std", "skew", "kurt")) + ")"
_CP = [(i, j) for i in range(len(NUMS)) for j in range(i + 1, len(NUMS))]
_CORR = "cg AS (SELECT " + ", ".join(f"coalesce(corr({NUMS[i]},{NUMS[j]}) FILTER (ds='real'),0) - coalesce(corr({NUMS[i]},{NUMS[j]}) FILTER (ds='raw'),0) AS d{i}{j}" for i, j in _CP) + " FROM roles)"
_SQ = "2*(" + "+".join(f"d{i}{j}*d{i}{j}" for i, j in _CP) + ")"
_AB = "2*(" + "+".join(f"abs(d{i}{j})" for i, j in _CP) + ")"

_SHARES = "pl AS (" + " UNION ALL ".join(f"SELECT ds, '{c}' AS col, {c}::varchar AS value FROM roles" for c in CATS) + "), pc AS (SELECT col, value, " + ", ".join(f"(count(*) FILTER (ds='{s}'))::double AS n{k}" for k, s in enumerate(("real", "raw", "refined"))) + " FROM pl GROUP BY 1,2), pp AS (SELECT *, " + ", ".join(f"sum(n{k}) OVER (PARTITION BY col) AS t{k}" for k in range(3)) + " FROM pc), pd AS (SELECT col, avg(abs(n0/t0-n1/t1)) AS raw, avg(abs(n0/t0-n2/t2)) AS refined FROM pp WHERE n0+n1 > 0 GROUP BY col)"
_W1 = "wl AS (" + " UNION ALL ".join(f"SELECT ds, '{c}' AS col, {c}::double AS value FROM roles" for c in ("l_quantity", "l_discount")) + "), wc AS (SELECT c.cand, l.col, l.value, count(*) FILTER (ds='real') AS a, count(*) FILTER (ds=c.cand) AS b FROM wl l JOIN (SELECT unnest(['raw','refined']) AS cand) c ON l.ds='real' OR l.ds=c.cand GROUP BY 1,2,3), wf AS (SELECT *, sum(a) OVER w/sum(a) OVER (PARTITION BY cand,col) AS fa, sum(b) OVER w/sum(b) OVER (PARTITION BY cand,col) AS fb, lead(value) OVER w AS nxt FROM wc WINDOW w AS (PARTITION BY cand,col ORDER BY value)), wd AS (SELECT cand, col, sum(abs(fa-fb)*coalesce(nxt-value,0)) AS w1 FROM wf GROUP BY 1,2), ww AS (SELECT col, max(w1) FILTER (cand='raw') AS raw, max(w1) FILTER (cand='refined') AS refined FROM wd GROUP BY col)"

SQL = {
    "distribution_metrics": with_(ROLES, _SHARES, _W1) + "SELECT col, metric, " + r("raw") + " AS raw, " + r("refined") + " AS refined, refined < raw AS improved FROM (SELECT col, 'w1' AS metric, raw, refined FROM ww UNION ALL SELECT col, 'prop_diff', raw, refined FROM pd)",
    "freq_categorical": with_(ROLES, FREQ) + "SELECT col, bucket, " + r("p") + " AS p, " + r("q") + " AS q FROM freq",
    "freq_discretized": with_(ROLES, BINNED) + "SELECT col, bucket, " + r("p") + " AS p, " + r("q") + " AS q FROM freq",
    "js_marginal": _dist("js"),
    "js_marginal_discretized": _dist("js", BINNED),
    "inverse_kl": _dist("inverse_kl"),
    "inverse_kl_discretized": _dist("inverse_kl", BINNED),
    "tvd": _dist("tvd"),
    "hellinger": _dist("hellinger"),
    "chi2_statistic": with_(ROLES, FREQ) + "SELECT col, " + r("sum((p-q)*(p-q)/q)") + " AS chi2, count(*) - 1 AS df FROM freq GROUP BY col",
    "chi2_pvalue": with_(ROLES, FREQ, "s AS (SELECT col, sum((p-q)*(p-q)/q)/2 AS x, (count(*)-1)/2.0::double AS a FROM freq GROUP BY col)") + "SELECT col, " + r("1 - sum(exp(-x + (a+n)*ln(x) - lgamma(a+n+1)))") + " AS p FROM s CROSS JOIN (SELECT unnest(generate_series(0, 200)) AS n) GROUP BY col",
    "js_joint": with_(ROLES, "c AS (SELECT l_returnflag, l_linestatus, l_linenumber, (count(*) FILTER (ds='real'))::double AS a, (count(*) FILTER (ds='raw'))::double AS b FROM roles WHERE ds IN ('real','raw') GROUP BY 1,2,3)", "f AS (SELECT a/sum(a) OVER () AS p, b/sum(b) OVER () AS q FROM c)") + "SELECT " + r("sqrt(greatest(sum(CASE WHEN p>0 THEN p*log2(p/((p+q)/2)) ELSE 0 END + CASE WHEN q>0 THEN q*log2(q/((p+q)/2)) ELSE 0 END)/2, 0))") + " AS js_joint FROM f",
    "ks_statistic": with_(ROLES, CDF) + "SELECT col, " + r("ks") + " AS ks FROM dist",
    "ks_pvalue": with_(ROLES, CDF) + "SELECT col, " + r("CASE WHEN any_value(ks*sqrt(na*nb/(na+nb))) < 0.2 THEN 1 ELSE least(1, greatest(0, 2*sum(pow(-1, k-1)*exp(-2*k*k*ks*ks*na*nb/(na+nb))))) END") + " AS p FROM dist CROSS JOIN (SELECT unnest(generate_series(1, 100)) AS k) GROUP BY col",
    "wasserstein_1d": with_(ROLES, CDF) + "SELECT col, " + r("w1", 4) + " AS w1 FROM dist",
    "marginal_metrics": with_(ROLES, CDF) + "SELECT " + ", ".join(f"{r(f'{f}({c})', 4)} AS {c}_{n}" for c in ("ks", "w1") for n, f in (("mean", "avg"), ("max", "max"))) + " FROM dist",
    "prop_diff": with_(ROLES, "long AS (" + " UNION ALL ".join(f"SELECT ds, '{c}' AS col, {c}::varchar AS value FROM roles" for c in CATS) + ")", "c AS (SELECT col, value, " + ", ".join(f"(count(*) FILTER (ds='{s}'))::double AS n{k}" for k, s in enumerate(("real", "raw", "refined"))) + " FROM long GROUP BY 1,2)", "p AS (SELECT *, " + ", ".join(f"sum(n{k}) OVER (PARTITION BY col) AS t{k}" for k in range(3)) + " FROM c)") + "SELECT col, " + r("avg(abs(n0/t0-n1/t1))") + " AS raw, " + r("avg(abs(n0/t0-n2/t2))") + " AS refined FROM p WHERE n0+n1 > 0 GROUP BY col",
    "mmd_linear": with_(ROLES, SCALED) + "SELECT " + r("+".join(f"pow(avg({c}) FILTER (ds='real') - avg({c}) FILTER (ds='raw'), 2)" for c in _S), 9) + " AS mmd FROM sc",
    "mmd_poly2": with_(ROLES, SCALED) + "SELECT " + r("+".join(f"pow(avg({a}*{b}) FILTER (ds='real') - avg({a}*{b}) FILTER (ds='raw'), 2)" for a in _S for b in _S), 9) + " AS mmd FROM sc",
    "mmd_rbf": with_(_PART) + "SELECT " + r(_MMD, 9) + " AS mmd FROM k",
    "mmd_rbf_sqrt": with_(_PART) + "SELECT " + r(f"sqrt(greatest({_MMD}, 0))") + " AS mmd FROM k",
    "moments": with_(ROLES, MOMENTS) + "SELECT ds, col, " + ", ".join(f'{r(c, 4)} AS "{c}"' for c in ("mean", "std", "skew", "kurt", "min", "max", "q25", "median", "q75")) + " FROM mom",
    "moments_compare": with_(ROLES, _MCOMP) + "SELECT moment, " + r("avg(d)", 3) + " AS mae, " + r("max(d)", 3) + ' AS "max", ' + r("avg(d*d)", 3) + " AS mse FROM d GROUP BY moment",
    "corr_metrics": with_(ROLES, _CORR) + "SELECT " + r(f"({_SQ})/16") + " AS mse, " + r(f"({_AB})/16") + " AS mae, " + r("greatest(0, " + ", ".join(f"abs(d{i}{j})" for i, j in _CP) + ")") + " AS max_diff, " + r(f"sqrt({_SQ})") + " AS frobenius FROM cg",
}
