"""Edge semantics on small tables, and the physical forms of an operator against each other."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabsieve.functions import special
from tabsieve.functions.frames import cumulative
from tabsieve.functions.rng import kfold, md5u, rank_by_uniform, sample_n, stratified_split
from tabsieve.operators import association as A
from tabsieve.operators import columns as X
from tabsieve.operators import divergence as D
from tabsieve.operators import encode as E
from tabsieve.operators import hypothesis as H
from tabsieve.operators import learning as L
from tabsieve.operators import moments as M
from tabsieve.operators import privacy as P
from tabsieve.operators import resample as S
from tabsieve.operators import weights as W
from tabsieve.operators.neighbours import any_within, nearest
from tabsieve.sources import tables


def points(spark, n, seed, first=0):
    rng = random.Random(seed)
    return spark.createDataFrame([(first + k, rng.choice([rng.random(), round(rng.random(), 1)]), rng.gauss(0, 2), float(rng.randint(0, 2))) for k in range(n)], "id long, a double, b double, c double")


def test_range_join_and_held_form_agree(spark):
    real, pool = points(spark, 150, 1), points(spark, 300, 2, 1000)
    cols = ["a", "b", "c"]
    for others, probe in ((True, real), (False, pool)):
        x = {r["id"]: r["dist"] for r in nearest(probe, real, "id", cols, others_only=others).collect()}
        y = {r["id"]: r["dist"] for r in nearest(probe, real, "id", cols, others_only=others, most_held=10).collect()}
        assert x.keys() == y.keys() and all(abs(x[k] - y[k]) < 1e-12 for k in x)
    radii = real.join(P.thresholds(real, "id", cols), "id")
    x = sorted(map(tuple, any_within(pool, radii, "id", cols, "dist").collect()))
    assert x == sorted(map(tuple, any_within(pool, radii, "id", cols, "dist", most_held=10).collect())) and 0 < sum(f for _, f in x) < 300


def test_flags_are_strict(spark):
    real = spark.createDataFrame([(1, 0.0), (2, 1.0), (3, 5.0), (4, 5.0)], "id long, x double")
    pool = spark.createDataFrame([(10, 0.0), (11, 1.0), (12, 5.0), (13, 0.5), (14, 2.0)], "id long, x double")
    got = dict(map(tuple, P.flags(real, pool, "id", ["x"]).collect()))
    # a copy of a row with a distinct neighbour is flagged; a copy of a duplicated row is not; distance equal to the threshold is not
    assert got == {10: 1, 11: 1, 12: 0, 13: 1, 14: 0}
    assert P.flags(real, pool.limit(0), "id", ["x"]).count() == 0
    assert P.privacy_metrics(P.flags(real, pool.limit(0), "id", ["x"])).first()["ratio"] == 0.0
    kept = P.kept(pool, P.flags(real, pool, "id", ["x"]), "id")
    assert {r["flag"] for r in P.flags(real, kept, "id", ["x"]).collect()} == {0}


def test_identifiability_score(spark):
    real = spark.createDataFrame([(1, 0.0), (2, 1.0), (3, 9.0)], "id long, x double")
    pool = spark.createDataFrame([(10, 0.1)], "id long, x double")
    r = P.score(real, pool, "id", ["x"]).first()
    assert r["n_violated"] == 2 and r["n_real"] == 3


def test_column_policies(spark):
    n = 2000
    df = spark.createDataFrame([(k, k % 2, k % 15, k % 50, str(k % 3), None if k % 2 else 1.0, k % 2 == 0) for k in range(n)], "a long, b int, c int, d int, e string, f double, g boolean")
    kinds = lambda p: dict(map(tuple, X.types_of(df, p).collect()))
    assert kinds("corr2") == {"a": "numerical", "b": "categorical", "c": "categorical", "d": "numerical", "e": "categorical", "f": "categorical", "g": "categorical"}
    assert kinds("dist2")["d"] == "categorical"
    assert kinds("test3") == {"a": "numerical", "b": "binary", "c": "numerical", "d": "numerical", "e": "multiclass", "f": "multiclass", "g": "binary"}
    assert kinds("summary5")["g"] == "binary" and kinds("summary5")["e"] == "categorical"
    assert dict(map(tuple, X.types_of_pair(df, df, df.columns).collect()))["c"] == "categorical"
    assert {k for k in X.types_of(df.limit(0), "corr2").collect()}
    with pytest.raises(ValueError):
        X.types_of(df, "nothing")
    r = X.summary(df.unionByName(df)).first()
    assert r["duplicate_rows"] == n and r["nulls"] == n


def test_feature_encoder(spark):
    real = spark.createDataFrame([(1, 1.0, "a", "x", 7.0), (2, None, "b", "y", 7.0), (3, 3.0, "a", "x", 7.0)], "id long, n double, c string, b string, k double")
    syn = spark.createDataFrame([(4, 5.0, "z", "y", 8.0), (5, None, None, None, None)], "id long, n double, c string, b string, k double")
    enc = E.FeatureEncoder.fit(real, syn, {"n": "numerical", "c": "categorical", "b": "binary", "k": "numerical"})
    out = {r["id"]: r for r in enc.transform(syn, ["id"]).collect()}
    assert out[4]["n"] == 2.0 and out[5]["n"] == 0.5  # not clipped; the real median
    assert out[4]["k"] == 1.0 and out[5]["k"] == 0.0  # constant column
    assert out[4]["c_z"] == 1.0 and out[4]["b"] == 1.0 and [out[5][c] for c in ("c_a", "c_b", "c_z", "b")] == [0.0] * 4
    three = E.FeatureEncoder.fit(real, syn.withColumn("b", F.lit("w")), {"b": "binary"})
    assert three.columns() == []


def test_code_encoder(spark):
    real = spark.createDataFrame([(1, 1, "10"), (2, 2, "2"), (3, None, None)], "id long, n int, c string")
    syn = spark.createDataFrame([(4, 2.9, "3"), (5, float("inf"), "10")], "id long, n double, c string")
    enc = E.CodeEncoder.fit(real, syn, ["n", "c"])
    out = {r["id"]: (r["n"], r["c"]) for r in enc.transform(syn, ["id"]).collect()}
    assert out[4] == (2.0, 2.0) and out[5] == (0.0, 0.0)  # cut to the real type; codes in text order
    assert {r["id"]: r["c"] for r in enc.transform(real, ["id"]).collect()}[3] == 3.0
    assert enc.transform(syn.withColumn("c", F.lit("new")), ["id"]).first()["c"] == 0.0


def test_weights(spark):
    df = spark.createDataFrame([(0.0,), (0.5,), (1.0,)], "p double").withColumn("w", W.importance(F.col("p"), 2.0))
    w = sorted(r["w"] for r in df.collect())
    assert w[1] == 2.0 and abs(w[0] - 2e-9) < 1e-15 and w[2] > 1e9
    with pytest.raises(ValueError):
        W.processed(F.col("w"), "other")
    a = spark.createDataFrame([(0.5, 1), (0.5, 0), (0.2, 0), (0.9, 1)], "s double, y int")
    assert W.auc(a, "s", "y").first()["auc"] == 0.875
    assert W.auc(a.where("y = 1"), "s", "y").first()["auc"] is None


def pool(spark, flags):
    return spark.createDataFrame([(k, 1.0 + k % 5, f) for k, f in enumerate(flags)], "id long, w double, flag int")


def test_sir_ic(spark):
    p = pool(spark, [k % 2 for k in range(60)])
    got = S.sir_ic(p, "id", "w", "flag", 200, 0.1)
    rows = got.collect()
    assert len(rows) == 200 and sum(r["flag"] for r in rows) <= 20
    assert S.sir_ic(p, "id", "w", "flag", 100, 0.0).where("flag = 1").count() == 0
    assert S.sir_ic(pool(spark, [1] * 20), "id", "w", "flag", 50, 0.1).where("flag = 1").count() == 50
    assert S.sir_ic(pool(spark, [0] * 20), "id", "w", "flag", 50, 0.1).where("flag = 0").count() == 50
    with pytest.raises(ValueError):
        S.sample(p, "id", "w", 10, constrained=True)
    with pytest.raises(ValueError):
        S.sir(p, "id", "w", 10, "other")
    assert S.statistics(got.limit(0), p).first()["share"] is None


def test_draws_follow_the_weights(spark):
    p = spark.createDataFrame([(1, 8.0), (2, 0.0), (3, 2.0)], "id long, w double")
    n = {r["id"]: r["count"] for r in S.draws(p, "id", "w", 2000, 1).groupBy("id").count().collect()}
    assert 2 not in n and abs(n[1] / 2000 - 0.8) < 0.04 and sum(n.values()) == 2000
    assert S.draws(p.where("id = 2"), "id", "w", 10, 1).count() == 0
    assert [r["id"] for r in S.sir(p, "id", "w", 2, "top_k").orderBy("draw").collect()] == [1, 3]


def test_ranks_and_splits(spark):
    df = spark.range(3000).withColumn("y", F.when(F.col("id") % 3 == 0, "a").when(F.col("id") % 7 == 0, F.lit(None)).otherwise("b")).withColumn("u", md5u(1, "id"))
    r = rank_by_uniform(df, "u", "id", ["y"]).collect()
    for y in ("a", "b", None):
        part = sorted((x for x in r if x["y"] == y), key=lambda x: (x["u"], x["id"]))
        assert [x["rank"] for x in part] == list(range(1, len(part) + 1))
    assert sample_n(df, 100, "id", 3).count() == 100
    s = stratified_split(df, "y", "id", 0.2, 3).groupBy("y", "split").count().collect()
    assert {(x["y"], x["split"]): x["count"] for x in s}[("a", "test")] == 200
    f = [x["count"] for x in kfold(df, "y", "id", 5, 3).groupBy("fold").count().collect()]
    assert len(f) == 5 and max(f) - min(f) <= 3


def test_cumulative_matches_a_plain_sum(spark):
    rng = random.Random(3)
    rows = [(c, float(v), rng.randint(0, 9)) for c in "xyz" for v in rng.sample(range(10**6), 500)]
    got = {(r["col"], r["value"]): r["upto"] for r in cumulative(spark.createDataFrame(rows, "col string, value double, n long"), "col", "value", {"upto": "n"}).collect()}
    for c in "xyz":
        run = 0
        for _, v, n in sorted(x for x in rows if x[0] == c):
            run += n
            assert got[c, v] == run


def sides(spark, a, b, kind="double"):
    return spark.createDataFrame([("r", v) for v in a] + [("s", v) for v in b], f"ds string, v {kind}")


def test_frequencies(spark):
    f = {r["bucket"]: (r["p"], r["q"]) for r in D.frequencies(sides(spark, ["a", "b", None], ["b", "c"], "string"), "ds", "r", "s", ["v"]).collect()}
    assert f["a"] == (0.5 + 1e-10, 1e-10) and f["c"] == (1e-10, 0.5 + 1e-10)
    f = {r["bucket"]: (round(r["p"], 6), round(r["q"], 6)) for r in D.frequencies_binned(sides(spark, [0.0, 10.0, 5.0], [-0.005, 2.0, 2.1, 99.0]), "ds", "r", "s", ["v"], 5).collect()}
    assert f == {1: (0.333333, 0.5), 2: (0.0, 0.25), 3: (0.333333, 0.0), 5: (0.333333, 0.0), -1: (0.0, 0.25)} or f.get(3) and f[-1] == (0.0, 0.25)
    one = D.frequencies_binned(sides(spark, [4.0, 4.0], [1.0, 4.0]), "ds", "r", "s", ["v"])
    m = D.marginal_distances(one).first()
    assert one.count() == 1 and m["js"] == 0 and m["inverse_kl"] == 1 and m["df"] == 0
    assert special.chi2_sf(m["chi2"], m["df"]) is None


def test_distances_on_equal_tables_are_zero(spark):
    df = sides(spark, [1.0, 2.0, 2.0], [1.0, 2.0, 2.0])
    m = D.marginal_distances(D.frequencies(df, "ds", "r", "s", ["v"])).first()
    assert abs(m["js"]) < 1e-7 and abs(m["tvd"]) < 1e-12 and abs(m["hellinger"]) < 1e-7 and abs(m["inverse_kl"] - 1) < 1e-12
    d = D.cdf_distances(D.cdf_frame(df, "ds", "r", "s", ["v"])).first()
    assert d["ks"] == 0 and d["w1"] == 0
    assert abs(M.mmd_rbf(df, "ds", "r", "s", ["v"]).first()["mmd"]) < 1e-12
    assert abs(M.sinkhorn(df.withColumn("k", F.monotonically_increasing_id()), "ds", "r", "s", ["v"], "k").first()[0]) < 1e-9


def test_w1_and_ks_against_plain_numpy(spark):
    rng = np.random.default_rng(1)
    a, b = rng.normal(0, 1, 700).round(2), rng.normal(0.3, 2, 500).round(2)
    d = D.cdf_distances(D.cdf_frame(sides(spark, a.tolist(), b.tolist()), "ds", "r", "s", ["v"])).first()
    xs = np.unique(np.concatenate([a, b]))
    fa, fb = np.searchsorted(np.sort(a), xs, "right") / len(a), np.searchsorted(np.sort(b), xs, "right") / len(b)
    assert abs(d["ks"] - np.abs(fa - fb).max()) < 1e-12
    assert abs(d["w1"] - (np.abs(fa - fb)[:-1] * np.diff(xs)).sum()) < 1e-9


def test_kernel_forms_agree(spark):
    rng = np.random.default_rng(2)
    rows = [("r" if k % 2 else "s", *map(float, rng.normal(0.1 * (k % 2), 1, 3))) for k in range(300)]
    df = spark.createDataFrame(rows, "ds string, a double, b double, c double")
    cols = ["a", "b", "c"]
    x, y = (np.array([r[1:] for r in rows if r[0] == s]) for s in "rs")
    k = lambda p, q: np.exp(-((p[:, None] - q[None]) ** 2).sum(2)).mean()
    want = k(x, x) + k(y, y) - 2 * k(x, y)
    assert abs(M.mmd_rbf(df, "ds", "r", "s", cols).first()["mmd"] - want) < 1e-12
    assert abs(M.mmd_rbf(df, "ds", "r", "s", cols, most_held=100).first()["mmd"] - want) < 1e-12
    p = lambda u, v: ((u @ v.T) ** 2).mean()
    want = p(x, x) + p(y, y) - 2 * p(x, y)
    assert abs(M.mmd_poly2(df, "ds", "r", "s", cols).first()["mmd"] - want) < 1e-9
    assert abs(M._poly2_kernel(df, "ds", "r", "s", cols).first()["mmd"] - want) < 1e-9


def test_associations(spark):
    df = spark.createDataFrame([("t", "a", "x", 1.0, 2.0), ("t", "a", "y", 2.0, 1.0), ("t", "b", "x", 3.0, 4.0), ("t", "b", "x", 3.0, 3.0)], "ds string, p string, q string, m double, n double")
    assert A.cramers_v(df, ["p", "q"], "ds").first()["v"] == 0.0  # corrected to nothing
    one = df.withColumn("q", F.lit("x"))
    assert A.cramers_v(one, ["p", "q"], "ds").first()["v"] == 0.0
    assert abs(A.eta_squared(df, ["p"], ["m"], "ds").first()["eta2"] - 2.25 / 2.75) < 1e-12
    assert A.eta_squared(one, ["q"], ["m"], "ds").first()["eta2"] == 0.0
    tau = A.kendall(df, ["m", "n"], "ds").first()["tau"]
    conc, disc, tx = 4, 1, 1  # of six pairs, one tied in m
    assert abs(tau - (conc - disc) / math.sqrt((6 - tx) * 6)) < 1e-12


def test_special_functions():
    assert abs(special.chi2_sf(3.841458820694124, 1) - 0.05) < 1e-9
    assert abs(special.chi2_sf(18.307038053275146, 10) - 0.05) < 1e-9
    assert abs(special.t_sf2(2.2281388519649385, 10) - 0.05) < 1e-9
    assert abs(special.t_sf2(0, 5) - 1) < 1e-12
    assert abs(special.ks_sf(1.3580986393225505 / math.sqrt(50), 100, 100) - 0.05) < 1e-6


def test_expected_mutual_information_by_enumeration():
    import itertools

    a = [0, 0, 1, 1, 1]
    b = [0, 1, 1, 1, 2]
    total = 0.0
    perms = list(itertools.permutations(b))
    for p in perms:
        n = len(a)
        for i in set(a):
            for j in set(b):
                k = sum(x == i and y == j for x, y in zip(a, p))
                if k:
                    total += k / n * math.log(n * k / (a.count(i) * p.count(j)))
    assert abs(special.expected_mutual_info([2, 3], [1, 3, 1]) - total / len(perms)) < 1e-12


def test_anderson_darling_of_equal_samples_is_small(spark):
    rng = np.random.default_rng(4)
    same = H.anderson_test(sides(spark, rng.normal(size=300).tolist(), rng.normal(size=300).tolist()), "ds", "r", "s", ["v"]).first()
    far = H.anderson_test(sides(spark, rng.normal(size=300).tolist(), rng.normal(2, 1, size=300).tolist()), "ds", "r", "s", ["v"]).first()
    assert same["p"] > 0.02 and far["p"] == 0.001


def test_clustering_indices(spark):
    df = spark.createDataFrame([(k, k % 3, (k % 3) * 10) for k in range(60)], "id long, a int, b int")
    assert L.ari(df, "a", "b").first()["ari"] == 1.0 and abs(L.ami(df, "a", "b").first()["ami"] - 1) < 1e-9
    assert abs(L.ari(df.withColumn("b", F.lit(1)), "a", "b").first()["ari"]) < 1e-12


def test_classifier_and_calibration(spark):
    rng = np.random.default_rng(0)
    real = spark.createDataFrame([(k, *map(float, rng.normal(0.8, 1, 2))) for k in range(400)], "id long, a double, b double")
    syn = spark.createDataFrame([(1000 + k, *map(float, rng.normal(0, 1, 2))) for k in range(800)], "id long, a double, b double")
    m, w = L.fidelity(real, syn, "id", ["a", "b"])
    m = m.first()
    assert m["kappa"] == 2.0 and m["auc"] > 0.7 and w.count() == 800 and w.agg(F.min("w")).first()[0] > 0
    m2 = L.fidelity(real, syn, "id", ["a", "b"], method="isotonic")[0].first()
    assert m2["auc"] > 0.7
    with pytest.raises(ValueError):
        L.fidelity(real, syn, "id", ["a", "b"], kind="other")


def test_validation_and_numbers(spark):
    df = spark.createDataFrame([(float("nan"), float("inf")), (1.0, 2.0)], "a double, b double")
    assert [tuple(r) for r in tables.clean_numbers(df).collect()] == [(None, 0.0), (1.0, 2.0)]
    assert tables.common_columns(df, df.select("b", "a")) == ["a", "b"]


def test_results_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, None)], "k long, v string")
    for kind in ("parquet", "json"):
        tables.save(df, f"{tmp_path}/{kind}", kind)
        assert sorted(r["k"] for r in tables.load(spark, f"{tmp_path}/{kind}", kind).collect()) == [1, 2]
    assert '"k": 1' in tables.to_json(df)
    with pytest.raises(ValueError):
        tables.to_json(df, 1)


def test_streaming_flags_equal_batch_flags(spark, tmp_path):
    from tabsieve.streaming import flag_stream, windowed_moments

    real, pool_ = points(spark, 60, 5), points(spark, 90, 6, 1000)
    radii = real.join(P.thresholds(real, "id", ["a", "b"]), "id")
    pool_.repartition(3).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(pool_.schema).parquet(f"{tmp_path}/in")
    q = flag_stream(stream, radii, "id", ["a", "b"]).writeStream.format("memory").queryName("flagged").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert sorted(map(tuple, spark.table("flagged").collect())) == sorted(map(tuple, any_within(pool_, radii, "id", ["a", "b"], "dist").collect()))
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").select("ts", "event_type", "value")
    events.withColumn("ts", F.col("ts").cast("timestamp")).write.parquet(f"{tmp_path}/ev")
    es = spark.readStream.schema("ts timestamp, event_type string, value double").parquet(f"{tmp_path}/ev")
    q = windowed_moments(es, "ts", "value", "7 days", "1 day", ["event_type"]).writeStream.format("memory").queryName("mom").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert spark.table("mom").agg(F.sum("n")).first()[0] == events.count()


def test_entry(spark):
    import __spark_entry__ as entry

    # the trained refinement draws as many rows as there are real customers (every fifth one), all of them from the pool
    real = spark.read.parquet(f"{entry.SF_SMALL}/customer.parquet").where("c_custkey % 5 = 0").count()
    keys = [r.row_id for r in entry.entry(spark).collect()]
    assert len(keys) == real > 0 and all(k % 5 for k in keys)
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_kendall_against_all_pairs(spark, monkeypatch):
    rng = random.Random(8)
    rows = [("t", float(rng.randint(0, 40)), float(rng.randint(0, 30))) for _ in range(150)] + [("u", rng.random(), rng.random()) for _ in range(90)] + [("v", 1.0, 2.0), ("v", 1.0, 3.0)]
    df = spark.createDataFrame(rows, "ds string, m double, n double")

    def plain(p):
        s = sum(((a[0] > b[0]) - (a[0] < b[0])) * ((a[1] > b[1]) - (a[1] < b[1])) for i, a in enumerate(p) for b in p[:i])
        x, y = (sum(a[k] != b[k] for i, a in enumerate(p) for b in p[:i]) for k in (0, 1))
        return s / math.sqrt(x * y) if x * y else None

    want = {g: plain([r[1:] for r in rows if r[0] == g]) for g in "tuv"}
    for small in (4096, 4):
        monkeypatch.setattr(A, "SMALL_BLOCK", small)
        got = {r["ds"]: r["tau"] for r in A.kendall(df, ["m", "n"], "ds").collect()}
        assert got["v"] is None and all(abs(got[g] - want[g]) < 1e-12 for g in "tu")


def test_autoencoder_query_embeds_whole_vectors(spark, monkeypatch):
    from tabsieve.plans import queries_learning as Q

    seen, embed = [], L.embed
    monkeypatch.setattr(L, "embed", lambda df, key, columns, **options: seen.append((len(columns), options)) or embed(df, key, columns, **options))
    out = Q.autoencoder(spark, "/root/testdata/sf0.001")
    vectors = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    assert seen == [(vectors.agg(F.max(F.size("embedding"))).first()[0], {})]
    assert out.where(F.size("embedding") == 10).count() == vectors.count()
