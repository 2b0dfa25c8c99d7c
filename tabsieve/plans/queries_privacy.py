"""Identifiability, weights, resampling."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabsieve.functions.frames import r6
from tabsieve.functions.rng import md5u, md5u_sql
from tabsieve.operators import encode as E
from tabsieve.operators import privacy as P
from tabsieve.operators import resample as S
from tabsieve.operators import weights as W
from tabsieve.operators.neighbours import nearest
from tabsieve.plans.sql import CDFW, CUSTOMER, ROLES, WEIGHTED, draws, melt, r, with_
from tabsieve.sources.tables import customer_sides, lineitem_roles, table

COLUMNS = ["c_acctbal", "c_mktsegment"]
N = 500


def encoded(spark, sf):
    real, pool = customer_sides(spark, sf)
    enc = E.CodeEncoder.fit(real, pool, COLUMNS)
    return enc.transform(real, ["row_id"]), enc.transform(pool, ["row_id"])


def flags(spark, sf):
    return P.flags(*encoded(spark, sf), "row_id", COLUMNS)


def thresholds(spark, sf):
    return P.thresholds(encoded(spark, sf)[0], "row_id", COLUMNS).withColumn("dist", r6("dist"))


def violations(spark, sf):
    return P.closest(*encoded(spark, sf), "row_id", COLUMNS).select("row_id", r6("r").alias("r"), r6("d").alias("d"), "violated")


def score(spark, sf):
    return P.score(*encoded(spark, sf), "row_id", COLUMNS).withColumn("score", r6("score"))


def metrics(spark, sf):
    m = P.privacy_metrics(flags(spark, sf))
    return m.select("total", "identifiable", r6("ratio").alias("ratio"), "satisfied", r6("violation").alias("violation"))


def kept(spark, sf):
    _, pool = encoded(spark, sf)
    return P.kept(pool, flags(spark, sf), "row_id")


def flag_counts(spark, sf):
    return flags(spark, sf).groupBy("flag").agg(F.count(F.lit(1)).alias("n"))


def entropy(spark, sf):
    return P.feature_entropy(lineitem_roles(spark, sf), ["l_quantity", "l_extendedprice", "l_linenumber"]).withColumn("entropy", r6("entropy"))


def embedding_thresholds(spark, sf):
    e = table(spark, sf, "embeddings")
    cols = [f"x{k}" for k in range(64)]
    wide = e.select("vec_id", *[F.get("embedding", F.lit(k)).cast("double").alias(c) for k, c in enumerate(cols)])
    return nearest(wide, wide, "vec_id", cols, others_only=True).withColumn("dist", r6("dist"))


def weighted_pool(spark, sf):
    """Pool rows with a pseudo-probability, its weight and a pseudo-flag."""
    _, pool = customer_sides(spark, sf)
    p = pool.select("row_id", "c_nationkey", (F.lit(0.05) + F.lit(0.9) * md5u(7, "row_id")).alias("p"), (md5u(11, "row_id") < 0.3).cast("int").alias("flag"))
    return p.withColumn("w", W.importance(F.col("p"), 4.0))


def importance(spark, sf):
    return weighted_pool(spark, sf).select("row_id", r6("w").alias("w"))


def _processed(method, **options):
    return lambda spark, sf: weighted_pool(spark, sf).select("row_id", r6(W.processed(F.col("w"), method, **options)).alias("w"))


def effects(spark, sf):
    return W.processing_effects(weighted_pool(spark, sf)).select("setting", *[r6(c).alias(c) for c in ("mean", "std", "var")])


def preservation(spark, sf):
    pool = weighted_pool(spark, sf)
    out = W.preservation(pool, pool.where("flag = 0"))
    return out.select(*[r6(c).alias(c) for c in out.columns])


def by_flag(spark, sf):
    return P.weights_by_flag(weighted_pool(spark, sf)).select("flag", "n", r6("median").alias("median"), r6("mean").alias("mean"))


def weights_histogram(spark, sf):
    return W.histogram(weighted_pool(spark, sf), "w", 50, ["flag"])


def weight_stats(spark, sf):
    out = W.top_share(weighted_pool(spark, sf), "w")
    return out.select(*[r6(c).alias(c) for c in out.columns])


def labelled(spark, sf):
    return weighted_pool(spark, sf).withColumn("y", (md5u(13, "row_id") < F.col("p")).cast("int")).withColumn("score", F.round("p", 2))


def calibration(spark, sf):
    return W.calibration_curve(labelled(spark, sf), "p", "y").select("bin", "n", r6("mean_p").alias("mean_p"), r6("share").alias("share"))


def auc(spark, sf):
    return W.auc(labelled(spark, sf), "score", "y").withColumn("auc", r6("auc"))


def guessed(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", F.col("o_orderstatus").alias("label"))
    other = F.when(F.col("label") == "F", "O").when(F.col("label") == "O", "P").otherwise("F")
    return o.withColumn("predicted", F.when(md5u(9, "o_orderkey") < 0.6, F.col("label")).otherwise(other))


def confusion(spark, sf):
    return W.confusion(guessed(spark, sf), "label", "predicted")


def report(spark, sf):
    return W.classification_report(guessed(spark, sf), "label", "predicted").select("cls", *[r6(c).alias(c) for c in ("precision", "recall", "f1")], "support")


def macro_f1(spark, sf):
    return W.classification_report(guessed(spark, sf), "label", "predicted").agg(r6(F.avg("f1")).alias("macro_f1"))


def accuracy(spark, sf):
    return guessed(spark, sf).agg(r6(F.avg((F.col("label") == F.col("predicted")).cast("double"))).alias("accuracy"))


def _sir(method):
    return lambda spark, sf: S.sir(weighted_pool(spark, sf), "row_id", "w", N, method).select("draw", "row_id")


def sir_ic(spark, sf):
    return S.sir_ic(weighted_pool(spark, sf), "row_id", "w", "flag", N).select("draw", "row_id", "flag")


def sampling_stats(spark, sf):
    out = S.statistics(sir_ic(spark, sf), weighted_pool(spark, sf))
    return out.withColumn("share", r6("share"))


def random_baseline(spark, sf):
    from tabsieve.functions.rng import sample_n

    return sample_n(weighted_pool(spark, sf).select("row_id"), 300, "row_id", 42)


def gathered(spark, sf):
    """Draws joined back to the pool's columns, with repetition."""
    pool = weighted_pool(spark, sf)
    return S.sir(pool, "row_id", "w", N).join(pool.select("row_id", "c_nationkey"), "row_id").select("draw", "row_id", "c_nationkey")


def refine_draws(spark, sf):
    """Flags, weights of a pseudo-probability, and a resample under the identifiability budget, as one table of draws."""
    f = flags(spark, sf)
    pool = weighted_pool(spark, sf).drop("flag").join(f, "row_id")
    return S.sir_ic(pool, "row_id", "w", "flag", 300).join(pool.select("row_id", "w"), "row_id").select("draw", "row_id", "flag", r6("w").alias("w"))


QUERIES = {
    "feature_entropy": entropy,
    "nn_thresholds": thresholds,
    "identifiability_flags": flags,
    "identifiability_score": score,
    "real_violations": violations,
    "privacy_metrics": metrics,
    "non_identifiable_pool": kept,
    "flag_counts": flag_counts,
    "embedding_nn_thresholds": embedding_thresholds,
    "importance_weights": importance,
    "process_weights_raw": _processed("raw"),
    "process_weights_flatten": _processed("flatten", alpha=0.5),
    "process_weights_clipped": _processed("clipped", min_clip=0.5),
    "weight_processing_effects": effects,
    "weight_statistics": weight_stats,
    "utility_preservation": preservation,
    "weights_by_flag": by_flag,
    "weights_histogram_by_flag": weights_histogram,
    "calibration_curve": calibration,
    "roc_auc_rank": auc,
    "accuracy": accuracy,
    "accuracy_confusion": confusion,
    "classification_report": report,
    "macro_f1": macro_f1,
    "sir_weighted": _sir("weighted"),
    "sir_reverse_weighted": _sir("reverse_weighted"),
    "sir_top_k": _sir("top_k"),
    "sir_reverse_top_k": _sir("reverse_top_k"),
    "sir_ic": sir_ic,
    "sampling_statistics": sampling_stats,
    "random_baseline": random_baseline,
    "gather_draws": gathered,
    "refine_draws": refine_draws,
}

_SETTINGS = [("raw", "w")] + [(f"flatten_{a:g}", f"pow(w, {a}::double)") for a in (0.5, 0.8, 1.0, 1.2, 1.5)] + [(f"clipped_{c:g}", f"greatest(w, {c!r}::double)") for c in (1e-6, 1e-4, 1e-2, 0.1)]
_LAB = WEIGHTED + ", lab AS (SELECT *, CASE WHEN " + md5u_sql(13, "row_id") + " < p THEN 1 ELSE 0 END AS y, round(p, 2) AS score FROM wp)"
_GUESS = "g AS (SELECT o_orderstatus AS label, CASE WHEN " + md5u_sql(9, "o_orderkey") + " < 0.6::double THEN o_orderstatus WHEN o_orderstatus='F' THEN 'O' WHEN o_orderstatus='O' THEN 'P' ELSE 'F' END AS predicted FROM orders)"
_REPORT = _GUESS + ", cl AS (SELECT label AS cls FROM g UNION SELECT predicted FROM g), rep AS (SELECT cls, count(*) FILTER (label=cls AND predicted=cls) AS hit, count(*) FILTER (label=cls) AS support, count(*) FILTER (predicted=cls) AS guessed FROM g CROSS JOIN cl GROUP BY cls)"
_F1 = "CASE WHEN support+guessed > 0 THEN 2*hit/(support+guessed) ELSE 0 END"
_INV = CDFW.replace("FROM wp", "FROM wi0").replace("w9", "w9i").replace("iv AS", "ivi AS")
#: Intervals over the rows that are not identifiable.
_SAFE = "wc0 AS (SELECT * FROM wp WHERE flag = 0), " + CDFW.replace("FROM wp", "FROM wc0").replace("w9", "w9c").replace("iv AS", "ivc AS")
_IC = (
    WEIGHTED + ", " + CDFW + ", " + _SAFE
    + ", a AS (SELECT draw, row_id AS ra, flag FROM (" + draws("iv", 42, N) + ") JOIN wp USING (row_id)), c AS (SELECT draw, row_id AS rc FROM (" + draws("ivc", 43, N) + ")), "
    "u AS (SELECT *, sum(flag) OVER (ORDER BY draw) - flag AS before FROM a), "
    f"ic AS (SELECT draw, CASE WHEN before < {int(0.05 * N)} OR rc IS NULL THEN ra ELSE rc END AS row_id, (CASE WHEN before < {int(0.05 * N)} OR rc IS NULL THEN flag ELSE 0 END)::int AS flag FROM u LEFT JOIN c USING (draw))"
)
_REFINE = (
    CUSTOMER + ", pool AS (SELECT row_id, 0.05::double+0.9::double*" + md5u_sql(7, "row_id") + " AS p FROM po), wp AS (SELECT pool.row_id, flag, 4.0::double*least(greatest(p,1e-9::double),(1-1e-9)::double)/(1-least(greatest(p,1e-9::double),(1-1e-9)::double)) AS w FROM pool JOIN flags USING (row_id)), "
    + CDFW + ", " + _SAFE
    + ", a AS (SELECT draw, row_id AS ra, flag FROM (" + draws("iv", 42, 300) + ") JOIN wp USING (row_id)), c AS (SELECT draw, row_id AS rc FROM (" + draws("ivc", 43, 300) + ")), "
    "u AS (SELECT *, sum(flag) OVER (ORDER BY draw) - flag AS before FROM a), "
    "ic AS (SELECT draw, CASE WHEN before < 15 OR rc IS NULL THEN ra ELSE rc END AS row_id, (CASE WHEN before < 15 OR rc IS NULL THEN flag ELSE 0 END)::int AS flag FROM u LEFT JOIN c USING (draw))"
)

SQL = {
    "feature_entropy": with_(ROLES, "long AS (" + melt("roles", ["l_quantity", "l_extendedprice", "l_linenumber"], "") + ")", "c AS (SELECT col, round_even(value, 0) AS v, count(*) AS n FROM long WHERE value IS NOT NULL GROUP BY 1,2)") + "SELECT col, " + r("ln(sum(n)::double) - sum(n*ln(n::double))/sum(n)") + " AS entropy FROM c GROUP BY col",
    "nn_thresholds": with_(CUSTOMER) + "SELECT row_id, " + r("dist") + " AS dist FROM thr",
    "identifiability_flags": with_(CUSTOMER) + "SELECT row_id, flag FROM flags",
    "identifiability_score": with_(CUSTOMER, "cl AS (SELECT q.row_id, q.dist AS r, min(sqrt((p.a-q.a)*(p.a-q.a)+(p.b-q.b)*(p.b-q.b))) AS d FROM rr q CROSS JOIN po p GROUP BY ALL)") + "SELECT " + r("avg(CASE WHEN d < r THEN 1.0 ELSE 0.0 END)") + " AS score, count(*) FILTER (d < r) AS n_violated, count(*) AS n_real FROM cl",
    "real_violations": with_(CUSTOMER, "cl AS (SELECT q.row_id, q.dist AS r, min(sqrt((p.a-q.a)*(p.a-q.a)+(p.b-q.b)*(p.b-q.b))) AS d FROM rr q CROSS JOIN po p GROUP BY ALL)") + "SELECT row_id, " + r("r") + " AS r, " + r("d") + " AS d, d < r AS violated FROM cl",
    "privacy_metrics": with_(CUSTOMER) + "SELECT count(*) AS total, sum(flag)::bigint AS identifiable, " + r("avg(flag)") + " AS ratio, avg(flag) <= 0.05 AS satisfied, " + r("greatest(0, avg(flag)-0.05::double)") + " AS violation FROM flags",
    "non_identifiable_pool": with_(CUSTOMER) + "SELECT row_id, a AS c_acctbal, b AS c_mktsegment FROM po JOIN flags USING (row_id) WHERE flag = 0",
    "flag_counts": with_(CUSTOMER) + "SELECT flag, count(*) AS n FROM flags GROUP BY flag",
    "embedding_nn_thresholds": "WITH e AS (SELECT vec_id, embedding::double[] AS x FROM embeddings) SELECT a.vec_id, " + r("min(list_distance(a.x, b.x))") + " AS dist FROM e a JOIN e b ON a.vec_id <> b.vec_id GROUP BY a.vec_id",
    "importance_weights": with_(WEIGHTED) + "SELECT row_id, " + r("w") + " AS w FROM wp",
    "process_weights_raw": with_(WEIGHTED) + "SELECT row_id, " + r("w") + " AS w FROM wp",
    "process_weights_flatten": with_(WEIGHTED) + "SELECT row_id, " + r("pow(w, 0.5::double)") + " AS w FROM wp",
    "process_weights_clipped": with_(WEIGHTED) + "SELECT row_id, " + r("greatest(w, 0.5::double)") + " AS w FROM wp",
    "weight_processing_effects": with_(WEIGHTED, "s AS (" + " UNION ALL ".join(f"SELECT '{n}' AS setting, {e} AS v FROM wp" for n, e in _SETTINGS) + ")") + "SELECT setting, " + r("avg(v)") + " AS mean, " + r("stddev_pop(v)") + " AS std, " + r("var_pop(v)") + " AS var FROM s GROUP BY setting",
    "weight_statistics": with_(WEIGHTED) + "SELECT " + ", ".join(f"{r(f'{f}(w)')} AS {f if f != 'avg' else 'mean'}" for f in ("min", "max", "avg", "median")) + " FROM wp",
    "utility_preservation": with_(WEIGHTED) + "SELECT " + r("a.mean") + " AS mean, " + r("a.std") + " AS std, " + r("avg(w)") + " AS selected_mean, " + r("stddev_pop(w)") + " AS selected_std, " + r("avg(CASE WHEN w > a.med THEN 1.0 ELSE 0.0 END)") + " AS above_median, " + r("avg(w)/a.mean") + " AS mean_ratio FROM wp CROSS JOIN (SELECT avg(w) AS mean, stddev_pop(w) AS std, median(w) AS med FROM wp) a WHERE flag = 0 GROUP BY a.mean, a.std",
    "weights_by_flag": with_(WEIGHTED) + "SELECT flag::int AS flag, count(*) AS n, " + r("median(w)") + " AS median, " + r("avg(w)") + " AS mean FROM wp GROUP BY flag",
    "weights_histogram_by_flag": with_(WEIGHTED, "s AS (SELECT min(w) AS lo, max(w) AS hi FROM wp)") + "SELECT flag::int AS flag, least(floor((w-lo)/(hi-lo)*50), 49)::int AS bin, count(*) AS n FROM wp CROSS JOIN s GROUP BY 1,2",
    "calibration_curve": with_(_LAB) + "SELECT least(floor(p*10), 9)::int AS bin, count(*) AS n, " + r("avg(p)") + " AS mean_p, " + r("avg(y)") + " AS share FROM lab GROUP BY 1",
    "roc_auc_rank": with_(_LAB, "rk AS (SELECT y, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score)-1)/2.0::double AS r FROM lab)") + "SELECT " + r("(sum(r) FILTER (y=1) - (count(*) FILTER (y=1))*(count(*) FILTER (y=1)+1)/2.0::double)/((count(*) FILTER (y=1))*(count(*) FILTER (y=0)))") + " AS auc, count(*) FILTER (y=1) AS n_pos, count(*) FILTER (y=0) AS n_neg FROM rk",
    "accuracy": with_(_GUESS) + "SELECT " + r("avg(CASE WHEN label=predicted THEN 1.0 ELSE 0.0 END)") + " AS accuracy FROM g",
    "accuracy_confusion": with_(_GUESS) + "SELECT label, predicted, count(*) AS n FROM g GROUP BY ALL",
    "classification_report": with_(_REPORT) + "SELECT cls, " + r("CASE WHEN guessed>0 THEN hit/guessed ELSE 0 END") + " AS precision, " + r("CASE WHEN support>0 THEN hit/support ELSE 0 END") + " AS recall, " + r(_F1) + " AS f1, support FROM rep",
    "macro_f1": with_(_REPORT) + "SELECT " + r(f"avg({_F1})") + " AS macro_f1 FROM rep",
    "sir_weighted": with_(WEIGHTED, CDFW) + draws("iv", 42, N),
    "sir_reverse_weighted": with_(WEIGHTED, "wi0 AS (SELECT row_id, 1.0::double/(w+1e-10::double) AS w FROM wp)", _INV) + draws("ivi", 42, N),
    "sir_top_k": with_(WEIGHTED) + f"SELECT row_number() OVER (ORDER BY w DESC, row_id) - 1 AS draw, row_id FROM wp ORDER BY w DESC, row_id LIMIT {N}",
    "sir_reverse_top_k": with_(WEIGHTED) + f"SELECT row_number() OVER (ORDER BY w, row_id) - 1 AS draw, row_id FROM wp ORDER BY w, row_id LIMIT {N}",
    "sir_ic": with_(_IC) + "SELECT draw, row_id, flag FROM ic",
    "sampling_statistics": with_(_IC) + "SELECT count(*) AS selected, sum(flag)::bigint AS identifiable, (SELECT count(*) FROM wp) AS pool, (SELECT sum(flag)::bigint FROM wp) AS pool_identifiable, " + r("avg(flag)") + " AS share, sum(flag) > floor(count(*)*0.05::double+1e-9::double) AS exceeded FROM ic",
    "random_baseline": "SELECT row_id FROM (SELECT c_custkey AS row_id, row_number() OVER (ORDER BY " + md5u_sql(42, "c_custkey") + ", c_custkey) AS rk FROM customer WHERE c_custkey % 5 <> 0) WHERE rk <= 300",
    "gather_draws": with_(WEIGHTED, CDFW) + "SELECT draw, row_id, c_nationkey FROM (" + draws("iv", 42, N) + ") JOIN wp USING (row_id)",
    "refine_draws": with_(_REFINE) + "SELECT draw, row_id, ic.flag, " + r("w") + " AS w FROM ic JOIN wp USING (row_id)",
}
