import hashlib
import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabsieve.functions import frames, special
from tabsieve.operators import association as A
from tabsieve.operators import hypothesis as H
from tabsieve.operators import learning as L
from tabsieve.operators import refine as R


def sides(spark, n=400, seed=1):
    """Real rows around 0, synthetic ones half like them and half far off."""
    rng = np.random.default_rng(seed)
    rows = [(k, float(x), float(y), "a" if x > 0 else "b") for k, (x, y) in enumerate(rng.normal(size=(n, 2)))]
    far = rng.normal(size=(3 * n, 2)) + np.where(np.arange(3 * n) % 2, 0.0, 4.0)[:, None]
    syn = [(10_000 + k, float(x), float(y), "a" if x > 0 else "b") for k, (x, y) in enumerate(far)]
    schema = "id long, x double, y double, c string"
    return spark.createDataFrame(rows, schema), spark.createDataFrame(syn, schema)


KINDS = {"x": "numerical", "y": "numerical", "c": "categorical"}


def test_networks_of_all_folds_by_one_job_are_as_good_as_sparks(spark):
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.ml.linalg import Vectors

    rng = np.random.default_rng(5)
    x, y = rng.normal(size=(90, 3)), rng.integers(0, 2, 90)
    v = rng.normal(size=3 * 4 + 4 + 4 * 2 + 2)
    f, g = L._network_cost(v, x, y, [3, 4, 2])
    for k in range(len(v)):  # the gradient is that of the loss
        e = np.zeros(len(v))
        e[k] = 1e-6
        assert abs((L._network_cost(v + e, x, y, [3, 4, 2])[0] - L._network_cost(v - e, x, y, [3, 4, 2])[0]) / 2e-6 - g[k]) < 1e-7
    rows = [(k, float(a), float(b), float((a * a + b * b < 1.4) != (rng.random() < 0.05)), k % 2) for k, (a, b) in enumerate(rng.normal(size=(600, 2)))]
    parts = spark.createDataFrame(rows, "id long, a double, b double, label double, fold int").select("id", "label", "fold", array_to_vector(F.array("a", "b")).alias("features")).persist()
    before = len(spark.sparkContext.statusTracker().getJobIdsForGroup())
    own = L.networks(parts, 2, 2, iterations=60)
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup()) - before < 10  # not a job for each step

    def loss(model, f):
        p = model.transform(parts.where(F.col("fold") != f)).select("label", vector_to_array("probability").alias("p")).collect()
        return -np.mean([math.log(r.p[int(r.label)]) for r in p])

    for f in range(2):
        rest = parts.where(F.col("fold") != f)
        theirs = L._base("mlp", 2, iterations=60).setInitialWeights(Vectors.dense(L._network_start([2, 8, 8, 2], 42))).fit(rest)
        assert loss(own[f], f) < 1.1 * loss(theirs, f) + 0.01
        # Spark's layout of the weights
        held = rest.select("label", vector_to_array("features").alias("x")).collect()
        got = L._network_cost(np.array(own[f].weights.toArray()), np.array([r.x for r in held]), np.array([int(r.label) for r in held]), [2, 8, 8, 2])[0]
        assert abs(got - loss(own[f], f)) < 1e-9


@pytest.mark.parametrize("options", [{"kind": "mlp", "folds": 2, "iterations": 30}, {"kind": "gbt", "folds": 2, "rounds": 3, "method": "isotonic"}, {"kind": "lr", "folds": 2, "embedding": 8, "epochs": 5}])
def test_a_fitted_model_weighs_rows_it_has_not_seen(spark, options):
    real, syn = sides(spark)
    m = L.FidelityModel.fit(real, syn.where("id % 3 = 0"), "id", KINDS, pool=syn, **options)
    assert m.metrics["kappa"] == 1.0 and m.metrics["auc"] > 0.6
    w = {r.id: r for r in m.weights(syn.where("id % 3 <> 0")).collect()}
    assert len(w) == 800 and all(0 <= r.p <= 1 and math.isclose(r.w, min(max(r.p, 1e-9), 1 - 1e-9) / (1 - min(max(r.p, 1e-9), 1 - 1e-9)), rel_tol=1e-6) for r in w.values())
    near, far = ([r.w for k, r in w.items() if k % 2 == side] for side in (1, 0))
    assert np.median(near) > 3 * np.median(far)


def test_refinement_draws_rows_that_no_step_before_used(spark):
    real, syn = sides(spark, 120)
    draws, model = R.refine(real, syn, "id", ["x", "y", "c"], kind="lr", folds=2)
    from tabsieve.operators import privacy
    from tabsieve.operators.encode import CodeEncoder

    enc = CodeEncoder.fit(real, syn, ["x", "y", "c"])
    flags = {r.id: r.flag for r in privacy.flags(enc.transform(real, ["id"]), enc.transform(syn, ["id"]), "id", ["x", "y", "c"]).collect()}
    safe = syn.join(spark.createDataFrame([(k,) for k, f in flags.items() if not f], "id long"), "id")
    training, rest = R.split_for_training(safe, "id", 4 * 120)
    trained, left = {r.id for r in training.collect()}, {r.id for r in rest.collect()}
    rows = draws.collect()
    assert len(rows) == 120 and sorted(r.draw for r in rows) == list(range(120))
    assert not trained & left and len(trained) + len(left) == sum(1 - f for f in flags.values()) and {r.id for r in rows} <= left
    assert sum(r.id % 2 for r in rows) > 80  # the half that is like the real rows


def test_fold_scores_by_hand(spark):
    rng = np.random.default_rng(3)
    rows = []
    for k in range(300):
        p = rng.dirichlet([1, 1, 1]).round(2)
        rows.append((int(k % 3), float(rng.integers(0, 3)), float(p.argmax()), [float(v) for v in p]))
    got = {r.fold: r for r in L.fold_scores(spark.createDataFrame(rows, "fold int, label double, prediction double, prob array<double>")).collect()}
    for f in range(3):
        part = [r for r in rows if r[0] == f]
        f1 = []
        for c in range(3):
            tp, sup, gue = sum(r[1] == c == r[2] for r in part), sum(r[1] == c for r in part), sum(r[2] == c for r in part)
            f1.append(2 * tp / (sup + gue))
        areas = []
        for c in range(3):
            pos, neg = [r[3][c] for r in part if r[1] == c], [r[3][c] for r in part if r[1] != c]
            areas.append(sum((x > y) + (x == y) / 2 for x in pos for y in neg) / len(pos) / len(neg))
        assert np.allclose([got[f].accuracy, got[f].macro_f1, got[f].auc], [sum(r[1] == r[2] for r in part) / len(part), np.mean(f1), np.mean(areas)])


def test_utility_evaluation_and_summary(spark):
    rng = np.random.default_rng(5)
    make = lambda at, n, noise: spark.createDataFrame([(at + k, float(x), float(rng.normal()), "hi" if x + noise * rng.normal() > 0 else "lo") for k, x in enumerate(rng.normal(size=n))], "id long, x double, z double, t string")
    scores, report, imp = L.utility_evaluation(make(0, 300, 0.1), make(1000, 400, 30.0), make(2000, 400, 0.3), "t", "id", trees=5, folds=2)
    s = {r.scenario: r for r in scores.collect()}
    assert set(s) == {"raw", "refined", "real"} and s["refined"].auc > s["raw"].auc and all(r.cv_accuracy_std >= 0 and 0 <= r.cv_auc <= 1 for r in s.values())
    t = {r.metric: r for r in L.utility_summary(scores).collect()}
    a, b, c = (s[k].accuracy for k in ("real", "raw", "refined"))
    assert np.allclose([t["accuracy"].improvement, t["accuracy"].raw_gap, t["accuracy"].refined_gap, t["accuracy"].gap_reduction], [(c - b) / b * 100, (a - b) / a * 100, (a - c) / a * 100, (a - b) / a * 100 - (a - c) / a * 100])
    assert {r.cls for r in report.where("scenario = 'raw'").collect()} == {0.0, 1.0}
    top = L.importance_comparison(imp, "real", 1).collect()
    assert {r.feature for r in top} == {"x"} and {r.place for r in top} == {1} and abs(next(r.r for r in top if r.scenario == "real") - 1) < 1e-9


def test_autoencoder_gradients_by_differences():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(9, 4))
    net = L.Autoencoder([4, 6, 5, 3], 1)

    def loss():
        a = x
        for k, w in enumerate(net.w):
            z = a @ w["w"] + w["b"]
            if k not in net.plain:
                y = (z - z.mean(0)) / np.sqrt(z.var(0) + net.EPS) * w["g"] + w["h"]
                z = np.where(y > 0, y, net.SLOPE * y)
            a = z
        return ((a - x) ** 2).mean()

    for k, grads in enumerate(net._gradients(x)):
        for name, g in grads.items():
            p = net.w[k][name]
            for at in list(np.ndindex(p.shape))[:7]:
                old = p[at]
                p[at] = old + 1e-6
                up = loss()
                p[at] = old - 1e-6
                down = loss()
                p[at] = old
                assert abs((up - down) / 2e-6 - g[at]) < 1e-5, (k, name, at)


def test_autoencoder_learns_and_repeats_real_rows():
    x = np.random.default_rng(1).normal(size=(200, 3)) @ np.random.default_rng(2).normal(size=(3, 9))
    first, last = L.Autoencoder.fit(x, 8, epochs=1), L.Autoencoder.fit(x, 8, epochs=40)
    assert last.decode_error(x) < 0.5 * first.decode_error(x) and last.encode(x).shape == (200, 8)
    assert L.Autoencoder.fit(x[:50], 8, epochs=1, synthetic=x).encode(x).shape == (200, 8)


def test_silhouette_in_blocks_equals_held(spark):
    rng = np.random.default_rng(4)
    rows = [(k, [float(v) for v in rng.normal(size=3) + 3 * (k % 3)], int(k % 3) if k else 9) for k in range(150)]
    df = spark.createDataFrame(rows, "id long, x array<double>, c int")
    x, c = np.array([r[1] for r in rows]), np.array([r[2] for r in rows])
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    s = []
    for k in range(150):
        same = (c == c[k]) & (np.arange(150) != k)
        if not same.any():
            s.append(0.0)
            continue
        a, b = d[k][same].mean(), min(d[k][c == o].mean() for o in set(c.tolist()) - {c[k]})
        s.append((b - a) / max(a, b))
    want = {str(o): np.mean([v for v, j in zip(s, c) if j == o]) for o in set(c.tolist())}
    for most in (20_000, 40):
        got = {r.cluster: r.silhouette for r in L.silhouette(df, "id", "x", "c", most_held=most).collect()}
        assert set(got) == set(want) and all(abs(got[o] - want[o]) < 1e-9 for o in want)


def test_silhouette_of_near_points_far_off_and_of_many_rows(spark):
    import time

    rng = np.random.default_rng(14)
    x = np.repeat(rng.normal(size=(30, 4)), 2, 0) * 1e-3 + 1e6 + 50.0 * (np.arange(60) % 3 == 0)[:, None]
    d = np.zeros((60, 60))
    for k in range(4):
        d += (x[:, None, k] - x[None, :, k]) ** 2
    d, c, want = np.sqrt(d), np.arange(60) % 3, []
    for k in range(60):
        a, b = d[k][c == c[k]].sum() / 19, min(d[k][c == o].mean() for o in range(3) if o != c[k])
        want.append((b - a) / max(a, b))
    df = spark.createDataFrame([(k, x[k].tolist(), k % 3) for k in range(60)], "id long, x array<double>, c int")
    for most in (20_000, 40):
        got = {int(r.cluster): r.silhouette for r in L.silhouette(df, "id", "x", "c", most_held=most).collect()}
        assert all(abs(got[o] - np.mean([v for v, j in zip(want, c) if j == o])) < 1e-7 for o in range(3))
    y, own = rng.normal(size=(3000, 64)), (np.arange(3000) % 5).astype(np.int32)
    began = time.process_time()
    to_x, to_y = L._distance_sums(y, own, y, own, 5, True)
    assert time.process_time() - began < 1.3  # 9,000,000 pairs; from the differences of each column 2.5 s
    assert np.allclose(to_x, to_y)


def test_kmeans_sweep_takes_the_best_start(spark):
    from pyspark.ml.functions import array_to_vector

    rng = np.random.default_rng(6)
    df = spark.createDataFrame([([float(v) for v in rng.normal(size=2) + 9 * (k % 3)],) for k in range(90)], "x array<double>").select(array_to_vector("x").alias("features"))
    rows = {r.k: r for r in L.kmeans_sweep(df, "features", range(2, 4), 2).collect()}
    assert rows[3].inertia < 0.2 * rows[2].inertia and abs(rows[3].bic - 3 * math.log(90) - rows[3].inertia) < 1e-9
    assert L.kmeans_sweep(df.limit(0), "features", range(2, 4), 2).count() == 0
    same = spark.createDataFrame([([1.0, 2.0],)] * 40, "x array<double>").select(array_to_vector("x").alias("features"))
    assert [abs(r.inertia) < 1e-9 for r in L.kmeans_sweep(same, "features", range(2, 4), 2).collect()] == [True, True]


def test_kmeans_sweep_equals_lloyds_rounds_by_brute_force(spark):
    from pyspark.ml.functions import array_to_vector

    rng = np.random.default_rng(8)
    x = np.array(sorted(rng.normal(size=(300, 3)).tolist()))
    df = spark.createDataFrame([(r,) for r in x.tolist()], "x array<double>").select(array_to_vector("x").alias("features")).repartition(5)
    got = {r.k: r.inertia for r in L.kmeans_sweep(df, "features", (2, 5), 3, rounds=6).collect()}
    for k in (2, 5):
        costs = []
        for s in range(3):
            c = L._seeded(x, k, np.random.default_rng([42, k, s]))
            for _ in range(6):
                own = ((x[:, None] - c) ** 2).sum(2).argmin(1)
                c = np.array([x[own == j].mean(0) if (own == j).any() else c[j] for j in range(k)])
            costs.append(((x[:, None] - c) ** 2).sum(2).min(1).sum())
        assert abs(got[k] / min(costs) - 1) < 1e-9


def test_cluster_folds_against_labels(spark):
    rng = np.random.default_rng(7)
    make = lambda at: spark.createDataFrame([(at + k, *map(float, rng.normal(size=2) + 9 * (k % 3)), k % 3) for k in range(120)], "id long, x double, y double, own int")
    out = L.cluster_folds(make(0), {"o": make(1000)}, "id", ["x", "y"], k=3, folds=2, labels="own").collect()
    assert len(out) == 2 and all(r.ari > 0.5 and r.ami > 0.5 for r in out)


def test_smallest_counts_the_first_rows_by_uniform_and_key(spark):
    from collections import Counter

    from tabsieve.functions.rng import smallest

    # keys occur up to three times, with equal and with different points; one key fills a third of the table
    rows = [(7 if k % 3 == 0 else k % 500, float(k % 4), float(k % 3 == 0)) for k in range(2400)]
    df = spark.createDataFrame(rows, "id long, x double, y double").repartition(5)
    cuts = [(1, 0), (1, 37), (1, 900), (2, 2000), (2, 2400), (3, 9999), (3, 1)]
    got = {(r.x, r.y): [r[f"c{i}"] for i in range(len(cuts))] for r in smallest(df, ["x", "y"], "id", cuts).collect()}
    for i, (seed, n) in enumerate(cuts):
        u = lambda k: int(hashlib.md5(f"{seed}:{k}".encode()).hexdigest()[:8], 16)  # noqa: B023, E731
        want = Counter(r[1:] for r in sorted(rows, key=lambda r: (u(r[0]), str(r[0]), *r[1:]))[:n])
        assert {p: c[i] for p, c in got.items() if c[i]} == dict(want), (seed, n)


def test_cluster_folds_shuffle_points_and_not_rows(spark):
    make = lambda at, n: spark.range(0, n, 1, 4).select((F.col("id") + at).alias("id"), (F.col("id") % 3 * 9 + F.col("id") % 2).cast("double").alias("x"), (F.col("id") % 3).cast("double").alias("y"))

    def written():
        sc = spark.sparkContext._jsc.sc()
        sc.listenerBus().waitUntilEmpty()
        found = sc.statusStore().executorList(False)
        return sum(found.apply(k).totalShuffleWrite() for k in range(found.size()))

    before = written()
    out = L.cluster_folds(make(0, 60_000), {"o": make(100_000, 90_000)}, "id", ["x", "y"], k=3, folds=2).collect()
    assert sorted(r.fold for r in out) == [0, 1] and all(abs(r.ari - 1) < 1e-9 for r in out)
    assert written() - before < 1_000_000  # a shuffle of the rows writes several MB


def test_expected_mutual_information_of_large_classes():
    def plain(a, b):
        n, lf, total = sum(a), math.lgamma, 0.0
        for x, y in itertools.product(a, b):
            for k in range(max(1, x + y - n), min(x, y) + 1):
                total += k / n * math.log(n * k / (x * y)) * math.exp(lf(x + 1) + lf(y + 1) + lf(n - x + 1) + lf(n - y + 1) - lf(n + 1) - lf(k + 1) - lf(x - k + 1) - lf(y - k + 1) - lf(n - x - y + k + 1))
        return total

    for a, b in (([5, 5, 2], [4, 8]), ([300, 300, 300, 100], [900, 50, 50]), ([2000, 40], [1000, 1000, 40])):
        assert abs(special.expected_mutual_info(a, b) - plain(a, b)) < 1e-9
    assert 0 < special.expected_mutual_info([10**9] * 3, [10**9] * 3) < 1e-6


def test_exact_ks_tail_by_enumeration():
    for n, m in ((3, 4), (4, 4), (5, 3)):
        stats = []
        for pick in itertools.combinations(range(n + m), n):
            i = j = 0
            gap = 0.0
            for k in range(n + m):
                i, j = (i + 1, j) if k in pick else (i, j + 1)
                gap = max(gap, abs(i / n - j / m))
            stats.append(gap)
        for d in sorted(set(round(s, 12) for s in stats)):
            assert abs(special.ks_sf_exact(d, n, m) - np.mean([s >= d - 1e-9 for s in stats])) < 1e-9
    assert abs(special.ks_sf_exact(0.03, 4000, 5000) - special.ks_sf(0.03, 4000, 5000)) < 0.02


def test_quantiles_and_ranks_by_numpy(spark):
    rng = np.random.default_rng(8)
    rows = [(k, "a" if k % 3 else "b", float(np.round(rng.normal(), 1)) if k % 7 else None) for k in range(2000)]
    df = spark.createDataFrame(rows, "id long, g string, v double")
    for r in frames.quantiles(df, ["g"], "v", [0, 0.1, 0.5, 0.75, 1]).collect():
        assert np.allclose(r.q, np.quantile([v for _, g, v in rows if g == r.g and v is not None], [0, 0.1, 0.5, 0.75, 1]))
    full = sorted((v, k) for k, _, v in rows if v is not None)
    assert [(r.v, r.id) for r in frames.ranked(df.where("v IS NOT NULL"), "v", "id").orderBy("rank").collect()] == full


def test_plans_hold_no_window_over_a_column_and_no_percentile(spark):
    from tabsieve.plans import registry

    q = registry.queries()
    for name in ("moments", "weight_statistics", "weights_by_flag", "describe_improvement", "sir_top_k", "ks_statistic", "corr_spearman", "utility_preservation"):
        plan = q[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
        assert " percentile(" not in plan and "median(" not in plan, name
        for line in plan.splitlines():
            if "Window [" in line:
                assert line.count("[") >= 3 or "_bin#" in line, (name, line)  # partitioned, or over a row for each range


def test_comparison_of_three_tables(spark):
    rng = np.random.default_rng(9)
    make = lambda shift: spark.createDataFrame([(k, float(rng.normal() + shift), int(rng.random() < 0.3), int(rng.integers(1, 4)), rng.choice(["x", "y", "z"], p=[0.2, 0.5, 0.3]).item()) for k in range(200)], "id long, v double, b int, m int, s string")
    real, raw, refined = make(0), make(2), make(0)
    for test in ("ttest", "ks", "ad"):
        out = {r.col: r for r in H.compare_distributions(real, raw, refined, "id", numerical_test=test).collect()}
        assert {c: r.kind for c, r in out.items()} == {"v": "numerical", "b": "binary", "m": "multiclass", "s": "multiclass"}
        assert out["v"].raw_match == "Different" and out["v"].refined_match == "Similar" and out["v"].raw_p < 0.01
    data = {k: t.toPandas().sort_values("id").reset_index(drop=True) for k, t in (("real", real), ("raw", raw), ("refined", refined))}
    assert out["b"].real == (data["real"].b == 1).mean() and out["s"].real_class == "y" and out["s"].raw == (data["raw"].s == "y").mean()
    mode = data["real"].m.mode()[0]
    assert out["m"].real_class == str(mode) and out["m"].refined == (data["refined"].m == mode).mean()
    import pandas as pd

    o = pd.crosstab(data["real"].s, data["raw"].s).to_numpy().astype(float)
    e = o.sum(1, keepdims=True) * o.sum(0, keepdims=True) / o.sum()
    assert abs(out["s"].raw_p - special.chi2_sf(((o - e) ** 2 / e).sum(), 4)) < 1e-9
    with pytest.raises(ValueError):
        H.compare_distributions(real, raw.select("id", "b", "v", "m", "s"), refined, "id")
    with pytest.raises(ValueError):
        H.compare_distributions(real, raw, refined, "id", numerical_test="other")


def test_mutual_information_matrix(spark):
    rng = np.random.default_rng(10)
    n, rows = 600, []
    for k in range(n):
        x = float(rng.normal())
        rows.append((k, x, float(0.8 * x + 0.6 * rng.normal()), "p" if x > 0 else "q", "r" if rng.random() < 0.5 else "t"))
    m = {(r.row_var, r.col_var): r for r in A.mutual_information_matrix(spark.createDataFrame(rows, "id long, x double, y double, c string, e string"), "id", ["x", "y"], ["c", "e"]).collect()}
    assert len(m) == 16 and all(m[c, c].mi == 1.0 for c in "xyce") and all(m[a, b].mi == m[b, a].mi for a, b in m)
    assert abs(m["x", "y"].mi + 0.5 * math.log(1 - 0.64)) < 0.12 and abs(m["x", "c"].mi - math.log(2)) < 0.1 and m["x", "e"].mi < 0.06
    assert all(max(m[a, b].normalised for b in "xyce") == 1.0 for a in "xyce")
