"""Models, clustering, projections, composed evaluations."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector
from pyspark.sql import Window
from pyspark.sql import functions as F

from tabsieve.functions.frames import r6
from tabsieve.functions.rng import md5u, md5u_sql
from tabsieve.operators import divergence as D
from tabsieve.operators import learning as L
from tabsieve.operators import moments as M
from tabsieve.operators import reports as R
from tabsieve.operators import weights as W
from tabsieve.operators.refine import refine
from tabsieve.plans import queries_privacy as Q
from tabsieve.plans.sql import r, with_
from tabsieve.sources.tables import customer_sides, lineitem_roles, table

COLS = ["l_quantity", "l_discount", "l_tax"]


def _sides(spark, sf):
    df = lineitem_roles(spark, sf).select("ds", F.xxhash64("l_orderkey", "l_linenumber", "l_extendedprice", "l_quantity").alias("row"), *COLS)
    return df.where("ds = 'real'").drop("ds"), df.where("ds = 'raw'").drop("ds")


def _fidelity(kind, method):
    return lambda spark, sf: L.fidelity(*_sides(spark, sf), "row", COLS, kind, method)[0]


def fidelity_weights(spark, sf):
    return L.fidelity(*_sides(spark, sf), "row", COLS)[1].agg(F.count(F.lit(1)).alias("n"), F.min("w").alias("min"), F.avg("w").alias("mean"), F.max("w").alias("max"))


def _orders(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", "o_totalprice", "o_orderpriority", "o_orderstatus", (F.col("o_orderkey") % 5).alias("part"))


def tstr(spark, sf):
    o = _orders(spark, sf)
    return L.utility_scenarios(o.where("part = 0").drop("part"), o.where("part IN (1, 2) AND o_totalprice > 50000").drop("part"), o.where("part IN (3, 4)").drop("part"), "o_orderstatus", "o_orderkey")


def importance(spark, sf):
    from tabsieve.operators.encode import prepare_target

    t = prepare_target(_orders(spark, sf).where("part = 0").drop("part", "o_orderkey"), "o_orderstatus")
    return L.forest_importance(t, [c for c in t.columns if c != "label"])


def _vectors(spark, sf):
    return table(spark, sf, "embeddings").select("vec_id", "label", array_to_vector(F.col("embedding").cast("array<double>")).alias("features"))


def kmeans(spark, sf):
    return L.kmeans_sweep(_vectors(spark, sf), "features")


def pca(spark, sf):
    return L.pca_projection(_vectors(spark, sf), "vec_id", "features")


def _three(spark, sf):
    """lineitem's roles, every row with a key of its own: equal rows are numbered."""
    df = lineitem_roles(spark, sf)
    same = Window.partitionBy("l_orderkey", "l_linenumber").orderBy(*[c for c in df.columns if c not in ("l_orderkey", "l_linenumber")])
    df = df.withColumn("_n", F.row_number().over(same)).select("ds", F.concat_ws(":", "l_orderkey", "l_linenumber", "_n").alias("row"), *COLS)
    return {s: df.where(F.col("ds") == s).drop("ds") for s in ("real", "raw", "refined")}


def cluster_folds(spark, sf):
    # rows equal in key and features are interchangeable, and counted as often as they occur
    key = F.concat_ws(":", "l_orderkey", "l_linenumber", F.xxhash64("l_partkey", "l_suppkey", "l_extendedprice", *COLS))
    df = lineitem_roles(spark, sf).select("ds", key.alias("row"), *COLS)
    t = {s: df.where(F.col("ds") == s).drop("ds") for s in ("real", "raw", "refined")}
    return L.fold_summary(L.cluster_folds(t["real"], {k: t[k] for k in ("raw", "refined")}, "row", COLS), "raw", "refined")


def cluster_folds_labels(spark, sf):
    """Agreement with true labels: vectors of every second id against models of the others."""
    e = table(spark, sf, "embeddings")
    cols = [f"x{k}" for k in range(64)]
    wide = e.select("vec_id", "label", *[F.get("embedding", F.lit(k)).cast("double").alias(c) for k, c in enumerate(cols)])
    return L.cluster_folds(wide.where("vec_id % 2 = 0"), {"others": wide.where("vec_id % 2 = 1")}, "vec_id", cols, k=10, labels="label")


def utility_summary(spark, sf):
    return L.utility_summary(tstr(spark, sf))


def importance_comparison(spark, sf):
    o = _orders(spark, sf)
    found = L.utility_evaluation(o.where("part = 0").drop("part"), o.where("part IN (1, 2) AND o_totalprice > 50000").drop("part"), o.where("part IN (3, 4)").drop("part"), "o_orderstatus", "o_orderkey")
    return L.importance_comparison(found[2], "real")


def refined(spark, sf):
    """The whole refinement of the customer pool, the classifier included."""
    real, pool = customer_sides(spark, sf)
    return refine(real, pool, "row_id", Q.COLUMNS)[0]


def projection(spark, sf):
    return L.projection(_three(spark, sf), "row", COLS)


def autoencoder(spark, sf):
    e = table(spark, sf, "embeddings")
    cols = [f"x{k}" for k in range(64)]
    wide = e.select("vec_id", *[F.get("embedding", F.lit(k)).cast("double").alias(c) for k, c in enumerate(cols)])
    return L.embed(wide, "vec_id", cols)


def _labels(spark, sf):
    e = table(spark, sf, "embeddings").select("vec_id", "label", "embedding")
    return e.withColumn("guess", F.when(md5u(5, "vec_id") < 0.7, F.col("label")).otherwise((F.col("vec_id") % 10).cast("int")))


def ari(spark, sf):
    return L.ari(_labels(spark, sf), "label", "guess").withColumn("ari", r6("ari"))


def ami(spark, sf):
    return L.ami(_labels(spark, sf), "label", "guess")


def silhouette(spark, sf):
    return L.silhouette(_labels(spark, sf), "vec_id", "embedding", "label").withColumn("silhouette", r6("silhouette"))


def paired(spark, sf):
    e = table(spark, sf, "events").select("event_id", "value").withColumn("other", F.col("value") + md5u(3, "event_id") - 0.4)
    return L.paired_t(e, "other", "value").select(r6("t", 4).alias("t"), "df", r6("cohens_d").alias("cohens_d"))


def comprehensive(spark, sf):
    pool = Q.weighted_pool(spark, sf)
    roles = lineitem_roles(spark, sf)
    from tabsieve.operators.privacy import privacy_metrics

    n = pool.count()
    return R.comprehensive(
        privacy_metrics(pool.select("row_id", "flag")),
        W.preservation(pool, pool.where("flag = 0")),
        M.correlation_gap(roles, "ds", "real", "raw", COLS),
        D.cdf_distances(D.cdf_frame(roles, "ds", "real", "raw", COLS)),
        pool.where("flag = 0").count(),
        n,
    )


QUERIES = {
    "fidelity_lr_sigmoid": _fidelity("lr", "sigmoid"),
    "fidelity_gbt_isotonic": _fidelity("gbt", "isotonic"),
    "fidelity_mlp_sigmoid": _fidelity("mlp", "sigmoid"),
    "fidelity_weights": fidelity_weights,
    "tstr_report": tstr,
    "feature_importance": importance,
    "kmeans_sweep": kmeans,
    "utility_summary": utility_summary,
    "importance_comparison": importance_comparison,
    "refine_pipeline": refined,
    "cluster_folds_labels": cluster_folds_labels,
    "pca_projection": pca,
    "union_projection": projection,
    "cluster_folds": cluster_folds,
    "autoencoder_embed": autoencoder,
    "ari": ari,
    "ami": ami,
    "silhouette_euclid": silhouette,
    "paired_t": paired,
    "comprehensive_evaluation": comprehensive,
}

_LAB = "e AS (SELECT vec_id, label, CASE WHEN " + md5u_sql(5, "vec_id") + " < 0.7::double THEN label ELSE (vec_id % 10)::int END AS guess FROM embeddings), ce AS (SELECT label, guess, count(*)::double AS n FROM e GROUP BY ALL)"

SQL = {
    "ari": with_(_LAB, "q AS (SELECT (SELECT sum(n*(n-1)/2) FROM ce) AS c, (SELECT sum(n*(n-1)/2) FROM (SELECT sum(n) AS n FROM ce GROUP BY label)) AS a, (SELECT sum(n*(n-1)/2) FROM (SELECT sum(n) AS n FROM ce GROUP BY guess)) AS b, (SELECT sum(n) FROM ce) AS n)") + "SELECT " + r("(c-a*b/(n*(n-1)/2))/((a+b)/2-a*b/(n*(n-1)/2))") + " AS ari FROM q",
    "silhouette_euclid": "WITH e AS (SELECT vec_id, label, embedding::double[] AS x FROM embeddings), d AS (SELECT a.vec_id, a.label AS own, b.label AS other, sum(list_distance(a.x, b.x)) AS s, count(*)::double AS n FROM e a CROSS JOIN e b GROUP BY ALL), t AS (SELECT vec_id, any_value(own) AS own, max(CASE WHEN own=other THEN n END) AS n, max(CASE WHEN own=other THEN s/greatest(n-1, 1) END) AS a, min(CASE WHEN own<>other THEN s/n END) AS b FROM d GROUP BY vec_id) SELECT own::varchar AS cluster, count(*) AS n, " + r("avg(CASE WHEN n > 1 THEN (b-a)/greatest(a,b) ELSE 0 END)") + " AS silhouette FROM t GROUP BY 1",
    "paired_t": "WITH d AS (SELECT (value + " + md5u_sql(3, "event_id") + " - 0.4::double) - value AS d FROM events) SELECT " + r("avg(d)/(stddev_samp(d)/sqrt(count(*)))", 4) + " AS t, count(*) - 1 AS df, " + r("avg(d)/stddev_samp(d)") + " AS cohens_d FROM d",
}
