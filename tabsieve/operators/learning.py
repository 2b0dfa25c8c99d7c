"""Real-versus-synthetic classifiers with calibration, train-on-synthetic test-on-real, clustering, projections and embeddings."""

from __future__ import annotations

import math
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier, LogisticRegression, MultilayerPerceptronClassificationModel, MultilayerPerceptronClassifier, RandomForestClassifier
from pyspark.ml.clustering import KMeans
from pyspark.ml.common import _py2java
from pyspark.ml.feature import PCA, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabsieve.functions import special
from tabsieve.functions.frames import cumulative
from tabsieve.functions.rng import kfold, sample_n, smallest, stratified_split
from tabsieve.operators.encode import FeatureEncoder, prepare_target
from tabsieve.operators.weights import auc, importance


class Scale:
    """Mean and population deviation of columns; a constant column is centred only."""

    def __init__(self, fit_on: DataFrame, columns: list[str]):
        row = fit_on.agg(*[f(c).alias(f"{n}{k}") for k, c in enumerate(columns) for n, f in (("m", F.avg), ("s", F.stddev_pop))]).first()
        self.columns = columns
        self.facts = [(float(row[f"m{k}"] or 0.0), float(row[f"s{k}"] or 0.0) or 1.0) for k in range(len(columns))]

    def transform(self, df: DataFrame, keep: list[str]) -> DataFrame:
        scaled = [(F.col(c) - F.lit(m)) / F.lit(s) for c, (m, s) in zip(self.columns, self.facts)]
        return df.select(*keep, array_to_vector(F.array(*scaled)).alias("features"))


def standardised(df: DataFrame, fit_on: DataFrame, columns: list[str], keep: list[str]) -> DataFrame:
    """keep + `features`: columns scaled by fit_on's mean and population deviation."""
    return Scale(fit_on, columns).transform(df, keep)


def _base(kind: str, n_features: int, layers: tuple[int, ...] = (100, 50), rounds: int = 20, iterations: int = 100):
    """The base model: lr, gbt (rounds trees) or mlp (layers, none wider than four times the features; at most iterations steps)."""
    if kind == "lr":
        return LogisticRegression(labelCol="label", maxIter=100, regParam=1e-4)
    if kind == "gbt":
        return GBTClassifier(labelCol="label", maxIter=rounds, maxDepth=5, stepSize=0.1, seed=42)
    if kind == "mlp":
        return MultilayerPerceptronClassifier(labelCol="label", layers=[n_features, *[min(x, 4 * n_features) for x in layers], 2], maxIter=iterations, seed=42)
    raise ValueError(f"unknown model: {kind}")


#: Training rows of up to so many bytes are fitted by networks(), a task for each fold; more by Spark's own network, a job for each step and fold.
HELD_BYTES = 1 << 26


def _unpacked(v: np.ndarray, sizes: list[int]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Weights (in, out) and biases of each layer, as views of a vector in the order that Spark's network has."""
    out, at = [], 0
    for a, b in zip(sizes, sizes[1:]):
        out.append((v[at : at + a * b].reshape(a, b), v[at + a * b : at + a * b + b]))
        at += a * b + b
    return out


def _network_start(sizes: list[int], seed: int) -> np.ndarray:
    rng = np.random.default_rng(seed)
    return np.concatenate([(rng.random(a * b + b) * 4.8 - 2.4) / a for a, b in zip(sizes, sizes[1:])])


def _network_cost(v: np.ndarray, x: np.ndarray, y: np.ndarray, sizes: list[int]) -> tuple[float, np.ndarray]:
    """Mean cross-entropy of the rows, and its gradient: sigmoid hidden layers, softmax at the end."""
    layers, grad, loss = _unpacked(v, sizes), np.zeros_like(v), 0.0
    sums = _unpacked(grad, sizes)
    for at in range(0, len(x), 2048):
        a, label = [x[at : at + 2048]], y[at : at + 2048]
        for k, (w, b) in enumerate(layers):
            z = a[-1] @ w + b
            a.append(1 / (1 + np.exp(-np.clip(z, -500, 500))) if k < len(layers) - 1 else z)
        z = a.pop()
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        own = np.arange(len(label)), label
        loss -= np.log(np.maximum(p[own], 1e-300)).sum()
        p[own] -= 1
        for k in range(len(layers) - 1, -1, -1):
            sums[k][0][...] += a[k].T @ p
            sums[k][1][...] += p.sum(0)
            if k:
                p = (p @ layers[k][0].T) * a[k] * (1 - a[k])
    return loss / len(x), grad / len(x)


def _lbfgs(cost, v: np.ndarray, steps: int, pairs: int = 10, tol: float = 1e-6, memory: int = 20) -> np.ndarray:
    """Up to `steps` steps of L-BFGS; over when the value fell by less than tol of itself in the last `memory` steps, or no step lowers it."""
    f, g = cost(v)
    held, values = [], [f]
    for _ in range(steps):
        q, alphas = g.copy(), []
        for s, y, r in reversed(held):
            alphas.append(r * (s @ q))
            q -= alphas[-1] * y
        q *= (held[-1][0] @ held[-1][1]) / (held[-1][1] @ held[-1][1]) if held else 1 / max(np.linalg.norm(g), 1e-12)
        for (s, y, r), alpha in zip(held, reversed(alphas)):
            q += (alpha - r * (y @ q)) * s
        slope, step, low, high = -(g @ q), 1.0, 0.0, math.inf
        for _ in range(30):  # a step that lowers the value and flattens the slope enough (weak Wolfe)
            new = v - step * q
            f1, g1 = cost(new)
            if not f1 <= f + 1e-4 * step * slope:
                high = step
            elif -(g1 @ q) < 0.9 * slope:
                low = step
            else:
                break
            step = (low + high) / 2 if high < math.inf else 2 * low
        if not f1 < f:
            break
        s, y = new - v, g1 - g
        if s @ y > 1e-12:
            held = [*held, (s, y, 1 / (s @ y))][-pairs:]
        v, f, g = new, f1, g1
        values = [*values, f][-memory - 1 :]
        if len(values) > memory and values[0] - f <= tol * max(abs(f), 1e-12):
            break
    return v


def networks(parts: DataFrame, n_features: int, folds: int, seed: int = 42, layers: tuple[int, ...] = (100, 50), iterations: int = 100, **_) -> list[MultilayerPerceptronClassificationModel]:
    """A network for each fold of parts (features, label, fold), fitted on all rows of the other folds; the same loss, sizes and steps as _base("mlp")."""
    sizes = [n_features, *[min(x, 4 * n_features) for x in layers], 2]

    def fitted(table):
        x = table.column("x").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, n_features)
        y = table.column("label").to_numpy().astype(np.int64)
        order = np.lexsort((*x.T, y))  # whatever order the rows came in
        x, y = x[order], y[order]
        v = _lbfgs(lambda w: _network_cost(w, x, y, sizes), _network_start(sizes, seed), iterations)
        return pa.table({"f": table.column("f")[:1], "v": pa.array([v.tolist()], pa.list_(pa.float64()))})

    f = F.explode(F.filter(F.lit(list(range(folds))), lambda e: e != F.col("fold"))).alias("f")
    dealt = parts.select("label", vector_to_array("features").alias("x"), f).repartitionByRange(folds, "f")
    found = {r["f"]: r["v"] for r in dealt.groupBy("f").applyInArrow(fitted, "f int, v array<double>").collect()}  # a row for each fold
    sc, out = parts.sparkSession.sparkContext, []
    for k in range(folds):
        model = sc._jvm.org.apache.spark.ml.classification.MultilayerPerceptronClassificationModel(f"mlp_{k}", _py2java(sc, Vectors.dense(found[k])))
        array = sc._gateway.new_array(sc._jvm.int, len(sizes))
        for i, x in enumerate(sizes):
            array[i] = x
        model.set(model.layers(), array)
        out.append(MultilayerPerceptronClassificationModel(model))
    return out


class Calibrated:
    """Mean of `folds` models, each trained on the other folds and calibrated on its own."""

    def __init__(self, members, method: str):
        self.members, self.method = members, method

    @classmethod
    def fit(cls, train: DataFrame, key: str, n_features: int, kind: str = "lr", method: str = "sigmoid", folds: int = 5, seed: int = 42, **base) -> Calibrated:
        parts = kfold(train, "label", key, folds, seed).persist()

        def member(f: int):
            model = held[f] if held else _base(kind, n_features, **base).fit(parts.where(F.col("fold") != f))
            own = model.transform(parts.where(F.col("fold") == f)).select("label", vector_to_array("probability")[1].alias("p"))
            margin = own.select(F.col("label"), cls._margin().alias("z")).withColumn("one", array_to_vector(F.array("z")))
            if method == "isotonic":
                c = IsotonicRegression(featuresCol="one", labelCol="label").fit(margin)
                return model, (np.array(c.boundaries), np.array(c.predictions))
            # Platt's targets: slightly inside 0 and 1, as weighted rows of both labels
            n = {r["label"]: r["n"] for r in margin.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
            hi, lo = (n.get(1.0, 0) + 1) / (n.get(1.0, 0) + 2), 1 / (n.get(0.0, 0) + 2)
            target = F.when(F.col("label") == 1, hi).otherwise(lo)
            soft = margin.withColumn("t", target).select("one", F.explode(F.array(F.struct(F.lit(1.0).alias("label"), F.col("t").alias("w")), F.struct(F.lit(0.0).alias("label"), (1 - F.col("t")).alias("w")))).alias("r")).select("one", "r.*")
            c = LogisticRegression(featuresCol="one", labelCol="label", weightCol="w").fit(soft)
            return model, (float(c.coefficients[0]), float(c.intercept))

        if method not in ("sigmoid", "isotonic"):
            raise ValueError(f"unknown calibration: {method}")
        _base(kind, n_features, **base)  # an unknown kind fails here
        small = parts.count() * n_features * 8 <= HELD_BYTES
        held = networks(parts, n_features, folds, seed, **base) if kind == "mlp" and small else None
        with ThreadPoolExecutor(folds) as pool:  # the folds' jobs run side by side
            members = list(pool.map(member, range(folds)))
        parts.unpersist()
        return cls(members, method)

    @staticmethod
    def _margin():
        p = F.least(F.greatest(F.col("p"), F.lit(1e-12)), F.lit(1 - 1e-12))
        return F.log(p / (1 - p))

    def transform(self, df: DataFrame, keep: list[str], out: str = "p") -> DataFrame:
        scored = df
        for k, (model, c) in enumerate(self.members):
            scored = model.transform(scored).withColumn("p", vector_to_array("probability")[1]).withColumn("z", self._margin())
            if self.method == "sigmoid":
                value = 1 / (1 + F.exp(-(F.lit(c[0]) * F.col("z") + F.lit(c[1]))))
            else:
                x, y = ([float(v) for v in a] for a in c)
                n = F.size(F.filter(F.lit(x), lambda e: e < F.col("z")))  # linear between the boundaries, flat outside
                lo, hi = F.greatest(n - 1, F.lit(0)), F.least(n, F.lit(len(x) - 1))
                x0, x1, y0, y1 = F.get(F.lit(x), lo), F.get(F.lit(x), hi), F.get(F.lit(y), lo), F.get(F.lit(y), hi)
                value = F.when(x1 > x0, y0 + (y1 - y0) * F.least(F.greatest((F.col("z") - x0) / (x1 - x0), F.lit(0.0)), F.lit(1.0))).otherwise(y1)
            scored = scored.withColumn(f"_p{k}", value).drop("rawPrediction", "probability", "prediction", "p", "z")
        mean = sum((F.col(f"_p{k}") for k in range(len(self.members))), F.lit(0.0)) / len(self.members)
        return scored.select(*keep, mean.alias(out))


class FidelityModel:
    """A calibrated real-versus-synthetic classifier, to be applied to synthetic rows that it was not trained on.

    Rows are encoded by an encoder fitted on the real table and the whole pool, then, if wanted, embedded by an autoencoder fitted on real rows, then scaled by the
    training part. (key, label) order the splits, so the same input gives the same model.
    """

    def __init__(self, key, encoder, net, scale, model, kappa, metrics):
        self.key, self.encoder, self.net, self.scale, self.model, self.kappa, self.metrics = key, encoder, net, scale, model, kappa, metrics

    @staticmethod
    def _encoded(df: DataFrame, key: str, encoder, net, keep: list[str]) -> DataFrame:
        """keep + the numbered columns x0, x1, ... that the classifier sees."""
        columns = encoder.columns()
        wide = df.select(*keep, *[e.alias(f"x{k}") for k, (_, e) in enumerate(columns)])
        return wide if net is None else net.embedded(wide, keep, [f"x{k}" for k in range(len(columns))])

    @classmethod
    def fit(cls, real: DataFrame, synthetic: DataFrame, key: str, kinds: dict[str, str], pool: DataFrame | None = None, kind: str = "mlp", method: str = "sigmoid", embedding: int | None = None, test_share: float = 0.2, folds: int = 5, seed: int = 42, epochs: int = 100, most_rows: int = 5_000, **base) -> FidelityModel:
        encoder = FeatureEncoder.fit(real, synthetic if pool is None else pool, kinds)
        net = None
        if embedding:
            wide = cls._encoded(real, key, encoder, None, [key])
            net = Autoencoder.on_sample(wide, key, wide.columns[1:], embedding, most_rows, epochs, seed)
        both = real.select(*real.columns, F.lit(1.0).alias("label")).unionByName(synthetic.select(*real.columns, F.lit(0.0).alias("label")))
        coded = cls._encoded(both, key, encoder, net, [key, "label"])
        columns = coded.columns[2:]
        coded = stratified_split(coded, "label", key, test_share, seed).persist()
        split = coded
        train = split.where("split = 'train'")
        scale = Scale(train, columns)
        model = Calibrated.fit(scale.transform(train, [key, "label"]), key, len(columns), kind, method, folds, seed, **base)
        n = {r["label"]: r["n"] for r in coded.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
        kappa = n.get(0.0, 0) / max(n.get(1.0, 0), 1)
        test = model.transform(scale.transform(split.where("split = 'test'"), [key, "label"]), [key, "label"])
        quality = test.agg(F.avg(((F.col("p") >= 0.5).cast("double") == F.col("label")).cast("double")).alias("accuracy")).crossJoin(auc(test, "p", "label").select("auc")).first()  # one row each
        coded.unpersist()
        return cls(key, encoder, net, scale, model, kappa, {"accuracy": quality["accuracy"], "auc": quality["auc"], "kappa": float(kappa)})

    def probabilities(self, df: DataFrame) -> DataFrame:
        """(key, p): calibrated probability of being real."""
        return self.model.transform(self.scale.transform(self._encoded(df, self.key, self.encoder, self.net, [self.key]), [self.key]), [self.key])

    def weights(self, df: DataFrame, eps: float = 1e-9) -> DataFrame:
        """(key, p, w): density-ratio weights of synthetic rows; give others than those the model was trained on."""
        return self.probabilities(df).withColumn("w", importance(F.col("p"), self.kappa, eps))


def fidelity(real: DataFrame, synthetic: DataFrame, key: str, columns: list[str], kind: str = "lr", method: str = "sigmoid", seed: int = 42, scored: DataFrame | None = None, **options) -> tuple[DataFrame, DataFrame]:
    """(metrics, weighted): accuracy, auc and kappa on the held-out part; (key, p, w) for each row of scored (the training rows unless given). Columns are numbers."""
    m = FidelityModel.fit(real.select(key, *columns), synthetic.select(key, *columns), key, dict.fromkeys(columns, "numerical"), kind=kind, method=method, seed=seed, **options)
    metrics = real.sparkSession.createDataFrame([tuple(m.metrics[k] for k in ("accuracy", "auc", "kappa"))], "accuracy double, auc double, kappa double")
    return metrics, m.weights(synthetic if scored is None else scored)


def fold_scores(scored: DataFrame) -> DataFrame:
    """(fold, accuracy, macro_f1, auc) from (fold, label, prediction, prob): auc is the mean over classes of one against the rest, where defined.

    One aggregate of the confusion counts and one running sum over the distinct scores, for all folds and classes at once.
    """
    cells = scored.groupBy("fold", "label", "prediction").agg(F.count(F.lit(1)).alias("n"))
    hit = F.when(F.col("label") == F.col("prediction"), F.col("n")).otherwise(0)
    accuracy = cells.groupBy("fold").agg((F.sum(hit) / F.sum("n")).alias("accuracy"))
    sides = F.explode(F.array(F.struct(F.col("label").alias("cls"), F.col("n").alias("size"), hit.alias("hit")), F.struct(F.col("prediction").alias("cls"), F.col("n").alias("size"), F.lit(0).cast("long").alias("hit"))))
    f1 = cells.select("fold", sides.alias("s")).select("fold", "s.*").groupBy("fold", "cls").agg((2 * F.sum("hit") / F.sum("size")).alias("f1")).groupBy("fold").agg(F.avg("f1").alias("macro_f1"))
    one = scored.select("fold", "label", F.posexplode("prob").alias("cls", "value"))
    key = F.concat_ws("|", "fold", "cls")
    counts = one.groupBy("fold", "cls", "value").agg(F.sum((F.col("label") == F.col("cls")).cast("long")).alias("pos"), F.sum((F.col("label") != F.col("cls")).cast("long")).alias("neg")).withColumn("key", key)
    run = cumulative(counts, "key", "value", {"upto": "neg"})
    pairs = F.sum("pos") * F.sum("neg")
    area = run.groupBy("fold", "cls").agg(F.when(pairs > 0, F.sum(F.col("pos") * (F.col("upto") - F.col("neg") / 2)) / pairs).alias("auc")).groupBy("fold").agg(F.avg("auc").alias("auc"))
    return accuracy.join(f1, "fold").join(area, "fold")


def _forest(train: DataFrame, columns: list[str], trees: int, seed: int):
    return RandomForestClassifier(labelCol="label", numTrees=trees, seed=seed).fit(VectorAssembler(inputCols=columns, outputCol="features").transform(train))


def _scored(model, df: DataFrame, columns: list[str]) -> DataFrame:
    ready = VectorAssembler(inputCols=columns, outputCol="features").transform(df)
    return model.transform(ready).select("fold", "label", "prediction", vector_to_array("probability").alias("prob"))


def tstr(train: DataFrame, test: DataFrame, columns: list[str], key: str, trees: int = 100, folds: int = 5, seed: int = 42) -> DataFrame:
    """(fold, accuracy, macro_f1, auc): one forest fitted on train, scored on stratified folds of test."""
    return fold_scores(_scored(_forest(train, columns, trees, seed), kfold(test, "label", key, folds, seed), columns))


def forest_importance(train: DataFrame, columns: list[str], trees: int = 100, seed: int = 42) -> DataFrame:
    """(feature, importance)."""
    model = _forest(train, columns, trees, seed)
    return train.sparkSession.createDataFrame([(c, float(v)) for c, v in zip(columns, model.featureImportances.toArray())], "feature string, importance double")


METRICS = ("accuracy", "macro_f1", "auc")


def evaluate_model(name: str, train: DataFrame, test: DataFrame, columns: list[str], key: str, validate: DataFrame | None = None, trees: int = 100, folds: int = 5, seed: int = 42) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(scores, report, importances) of a forest fitted on train and tested on test, all with `scenario`.

    Cross-validation: on folds of validate, if given, by the forest fitted on train; otherwise each fold of train by a forest of the others. Scores has one row: the
    test's metrics, and mean (cv_...) and population deviation (cv_..._std) over the folds, undefined areas left out.
    """
    from tabsieve.operators.weights import classification_report

    spark, train = train.sparkSession, train.persist()
    model = _forest(train, columns, trees, seed)
    if validate is not None:
        cv = [_scored(model, kfold(validate, "label", key, folds, seed), columns)]
    else:
        parts = kfold(train, "label", key, folds, seed).persist()
        parts.count()
        with ThreadPoolExecutor(folds) as pool:
            models = list(pool.map(lambda f: _forest(parts.where(F.col("fold") != f), columns, trees, seed), range(folds)))
        cv = [_scored(m, parts.where(F.col("fold") == f), columns) for f, m in enumerate(models)]
    tested = _scored(model, test.withColumn("fold", F.lit(-1)), columns)
    every = tested
    for part in cv:
        every = every.unionByName(part)
    every = every.persist()
    own, inner = F.col("fold") < 0, F.col("fold") >= 0
    scores = fold_scores(every).agg(
        *[F.max(F.when(own, F.col(m))).alias(m) for m in METRICS],
        *[f(F.when(inner, F.col(m))).alias(f"cv_{m}{tail}") for m in METRICS for tail, f in (("", F.avg), ("_std", F.stddev_pop))],
    )
    report = classification_report(every.where(own), "label", "prediction")
    facts = spark.createDataFrame([(c, float(v)) for c, v in zip(columns, model.featureImportances.toArray())], "feature string, importance double")
    # few rows each: they come to the driver, so that the cached scores can go
    out = tuple(spark.createDataFrame(t.collect(), t.schema).select(F.lit(name).alias("scenario"), "*") for t in (scores, report)) + (facts.select(F.lit(name).alias("scenario"), "*"),)
    every.unpersist()
    train.unpersist()
    if validate is None:
        parts.unpersist()
    return out


def utility_evaluation(real: DataFrame, raw: DataFrame, refined: DataFrame, target: str, key: str, test_share: float = 0.2, cv_share: float = 0.2, trees: int = 100, folds: int = 5, seed: int = 42) -> tuple[DataFrame, DataFrame, DataFrame]:
    """evaluate_model() for forests trained on raw, refined and real rows, tested on held-out real rows.

    Real rows are split into test, validation (cv_share of the rest) and training; synthetic tables are sampled down to the training part's size and cross-validated on
    the validation part, the real model on its own folds. Codes come from the real test rows.
    """
    split = stratified_split(real, target, key, test_share, seed)
    test, rest = split.where("split = 'test'").drop("split"), split.where("split = 'train'").drop("split")
    second = stratified_split(rest, target, key, cv_share, seed + 1)
    validate, train = second.where("split = 'test'").drop("split"), second.where("split = 'train'").drop("split")
    n = train.count()
    ready = lambda t: prepare_target(t, target, test)
    columns = [c for c in ready(test).columns if c not in ("label", key)]
    tested, validated = ready(test).persist(), ready(validate).persist()
    jobs = (("raw", sample_n(raw, n, key, seed)), ("refined", sample_n(refined, n, key, seed)), ("real", train))
    one = lambda job: evaluate_model(job[0], ready(job[1]), tested, columns, key, validated if job[0] != "real" else None, trees, folds, seed)
    with ThreadPoolExecutor(3) as pool:
        parts = list(pool.map(one, jobs))
    tested.unpersist()
    validated.unpersist()
    return tuple(a.unionByName(b).unionByName(c) for a, b, c in zip(*parts))


def utility_scenarios(*args, **options) -> DataFrame:
    """The scores of utility_evaluation(): one row for each scenario."""
    return utility_evaluation(*args, **options)[0]


def utility_summary(scores: DataFrame, baseline: str = "real", raw: str = "raw", refined: str = "refined") -> DataFrame:
    """(metric, baseline, raw, refined, improvement, raw_gap, refined_gap, gap_reduction) in percent, for the test's and the folds' metrics.

    improvement = (refined - raw) / raw, gap = (baseline - x) / baseline; 0 where the denominator is not above 0.
    """
    names = [*METRICS, *[f"cv_{m}" for m in METRICS]]
    long = scores.select("scenario", F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("v")) for m in names])).alias("r")).select("scenario", "r.*")
    side = lambda s, n: F.max(F.when(F.col("scenario") == s, F.col("v"))).alias(n)
    t = long.groupBy("metric").agg(side(baseline, "baseline"), side(raw, "raw"), side(refined, "refined"))
    share = lambda a, b, of: F.when(F.col(of) > 0, (F.col(a) - F.col(b)) / F.col(of) * 100).otherwise(0.0)
    t = t.withColumns({"improvement": share("refined", "raw", "raw"), "raw_gap": share("baseline", "raw", "baseline"), "refined_gap": share("baseline", "refined", "baseline")})
    return t.withColumn("gap_reduction", F.col("raw_gap") - F.col("refined_gap"))


def importance_comparison(importances: DataFrame, first: str, top: int = 10) -> DataFrame:
    """(scenario, feature, importance, mean, place, r): the top features by mean importance, and each scenario's correlation with the first one's importances."""
    means = importances.groupBy("feature").agg(F.avg("importance").alias("mean"))
    base = importances.where(F.col("scenario") == first).select("feature", F.col("importance").alias("_b"))
    r = importances.join(base, "feature").groupBy("scenario").agg(F.corr("importance", "_b").alias("r"))
    from pyspark.sql import Window

    places = means.orderBy(F.desc("mean"), "feature").limit(top)
    place = F.row_number().over(Window.partitionBy("scenario").orderBy(F.desc("mean"), "feature"))
    return importances.join(places, "feature").join(r, "scenario").select("scenario", "feature", "importance", "mean", place.alias("place"), "r")


def _seeded(rows: np.ndarray, k: int, rng) -> np.ndarray:
    """k rows, each drawn with a weight of its squared distance to those before."""
    out = [rows[rng.integers(len(rows))]]
    far = ((rows - out[0]) ** 2).sum(1)
    while len(out) < k:
        total = far.sum()
        out.append(rows[rng.choice(len(rows), p=far / total) if total > 0 else rng.integers(len(rows))])
        far = np.minimum(far, ((rows - out[-1]) ** 2).sum(1))
    return np.array(out)


def _assigned(batches, centres: np.ndarray, cuts: list[int], dim: int):
    """Rows, sums and squared distances for each centre over a task's rows; centres[cuts[j]:cuts[j + 1]] are those of fit j."""
    n, cost, sums = np.zeros(len(centres), np.int64), np.zeros(len(centres)), np.zeros((len(centres), dim))
    square = (centres**2).sum(1)
    for batch in (b.slice(at, 1024) for b in batches for at in range(0, b.num_rows, 1024)):
        x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, dim)
        d = (x**2).sum(1)[:, None] - 2 * x @ centres.T + square
        own = np.zeros(d.shape)
        for lo, hi in zip(cuts, cuts[1:]):
            own[np.arange(len(x)), lo + d[:, lo:hi].argmin(1)] = 1
        n += own.sum(0).astype(np.int64)
        cost += (np.maximum(d, 0) * own).sum(0)
        sums += own.T @ x
    yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(centres))), pa.array(n), pa.array(cost), pa.FixedSizeListArray.from_arrays(sums.ravel(), dim).cast(pa.list_(pa.float64()))], names=["centre", "n", "cost", "sums"])


def _merged(batches):
    held: dict[int, list] = {}
    for batch in batches:
        for c, n, cost, s in zip(*(batch.column(x).to_pylist() for x in ("centre", "n", "cost", "sums"))):
            old = held.setdefault(c, [0, 0.0, 0.0])
            old[0], old[1], old[2] = old[0] + n, old[1] + cost, old[2] + np.array(s)
    if held:
        n, cost, sums = zip(*held.values())
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int64()), pa.array(n, pa.int64()), pa.array(cost, pa.float64()), pa.array([x.tolist() for x in sums], pa.list_(pa.float64()))], names=["centre", "n", "cost", "sums"])


def kmeans_sweep(df: DataFrame, features: str, ks=range(2, 16), starts: int = 10, seed: int = 42, rounds: int = 20, most_seeds: int = 4_096) -> DataFrame:
    """(k, inertia, bic, aic): best inertia over the starts; bic = k ln n + inertia, aic = 2 k + inertia. Without rows: no rows.

    All fits go on together: a round is one pass over the cached rows that finds the next centres of every k and start, so the number of passes is
    `rounds` at most. Starting centres are drawn apart from each other among about `most_seeds` sampled rows. What meets on the driver are the centres.
    """
    spark = df.sparkSession
    schema = "k int, inertia double, bic double, aic double"
    x = df.where(F.col(features).isNotNull()).select(vector_to_array(features).alias("x")).persist()
    try:
        total = x.count()
        if not total:
            return spark.createDataFrame([], schema)
        share = most_seeds / total
        seeds = np.array(sorted(r["x"] for r in (x.where(F.rand(seed) < share) if share < 1 else x).collect()) or [x.first()["x"]])
        dim = seeds.shape[1]
        jobs = [(k, s) for k in ks for s in range(starts)]
        cuts = np.cumsum([0, *(k for k, _ in jobs)]).tolist()
        centres = np.concatenate([_seeded(seeds, k, np.random.default_rng([seed, k, s])) for k, s in jobs])
        shape = "centre long, n long, cost double, sums array<double>"
        for turn in range(rounds + 1):
            part = x.mapInArrow(lambda it, c=centres: _assigned(it, c, cuts, dim), shape)
            got = part.repartition("centre").mapInArrow(_merged, shape).toArrow().sort_by("centre")
            n, cost = got.column("n").to_numpy(), got.column("cost").to_numpy()
            sums = np.array(got.column("sums").to_pylist())
            new = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centres)
            if turn == rounds or np.abs(new - centres).max() < 1e-9:
                break
            centres = new
        inertia = {}
        for (k, _), lo, hi in zip(jobs, cuts, cuts[1:]):
            inertia[k] = min(inertia.get(k, math.inf), float(cost[lo:hi].sum()))
    finally:
        x.unpersist()
    return spark.createDataFrame([(k, v, k * math.log(total) + v, 2.0 * k + v) for k, v in inertia.items()], schema)


def ari(df: DataFrame, a: str, b: str, n: str | None = None) -> DataFrame:
    """Adjusted Rand index of two labellings, from the contingency counts; a row of df stands for n rows (a column), if given."""
    c2 = lambda x: F.col(x) * (F.col(x) - 1) / 2
    cells = df.groupBy(a, b).agg(F.sum(n).alias("n") if n else F.count(F.lit(1)).alias("n"))
    s = cells.agg(F.sum(c2("n")).alias("cells"), F.sum("n").alias("n"))
    r = cells.groupBy(a).agg(F.sum("n").alias("n")).agg(F.sum(c2("n")).alias("rows"))
    c = cells.groupBy(b).agg(F.sum("n").alias("n")).agg(F.sum(c2("n")).alias("cols"))
    one = s.crossJoin(r).crossJoin(c)  # one row each
    expected = F.col("rows") * F.col("cols") / c2("n")
    top = (F.col("rows") + F.col("cols")) / 2
    return one.select(F.when(top == expected, 1.0).otherwise((F.col("cells") - expected) / (top - expected)).alias("ari"))


def ami(df: DataFrame, a: str, b: str, n: str | None = None) -> DataFrame:
    """Adjusted mutual information (arithmetic mean of the entropies); the expected part is computed from the class sizes."""
    cells = df.groupBy(F.col(a).cast("string").alias("x"), F.col(b).cast("string").alias("y")).agg(F.sum(n).alias("n") if n else F.count(F.lit(1)).alias("n")).withColumn("all", F.lit(0))

    def finish(pdf):
        import pandas as pd

        n = pdf["n"].sum()
        x, y = pdf.groupby("x")["n"].sum(), pdf.groupby("y")["n"].sum()
        h = lambda s: -sum(v / n * math.log(v / n) for v in s)
        mi = sum(v / n * math.log(v * n / (x[i] * y[j])) for i, j, v in zip(pdf["x"], pdf["y"], pdf["n"]))
        e = special.expected_mutual_info([int(v) for v in x], [int(v) for v in y])
        top = (h(x) + h(y)) / 2 - e
        return pd.DataFrame({"ami": [(mi - e) / top if abs(top) > 1e-15 else 1.0]})

    return cells.groupBy("all").applyInPandas(finish, "ami double")  # one row for each pair of classes


#: Rows of a block of silhouette() take at most so many bytes; a task holds two blocks.
BLOCK_BYTES = 1 << 25


def _distance_sums(x: np.ndarray, cx: np.ndarray, y: np.ndarray, cy: np.ndarray, k: int, both: bool) -> tuple[np.ndarray, np.ndarray]:
    """Sums of Euclidean distances: of each row of y to the rows of x in each of k clusters, and, if both, of each row of x to those of y.

    Squares come from one matrix product of the centred rows; where they are so small beside the rows' lengths that digits cancel, from the differences themselves.
    """
    to_x, to_y = np.zeros((len(y), k)), np.zeros((len(x), k))
    middle = x.mean(0)
    u, v = x - middle, y - middle
    uu, vv = (u * u).sum(1), (v * v).sum(1)
    floor = 1e-14 * (middle @ middle)
    member, other = np.eye(k)[cx], np.eye(k)[cy]
    for at in range(0, len(y), 256):
        q, part = v[at : at + 256], slice(at, at + 256)
        for lo in range(0, len(x), 2048):
            rows = slice(lo, lo + 2048)
            d = q @ u[rows].T
            d *= -2
            d += uu[rows]
            d += vv[part, None]
            if not d.min() > 1e-6 * (uu[rows].max() + vv[part].max()) + floor:
                i, j = np.nonzero(d < 1e-6 * (uu[rows] + vv[part, None]) + floor)
                for few in range(0, len(i), 16384):
                    g, h = i[few : few + 16384], j[few : few + 16384]
                    d[g, h] = ((y[at + g] - x[lo + h]) ** 2).sum(1)
            np.sqrt(d, out=d)
            to_x[part] += d @ member[rows]
            if both:
                to_y[rows] += (other[part].T @ d).T
    return to_x, to_y


def silhouette(df: DataFrame, key: str, features: str, cluster: str, most_held: int = 20_000) -> DataFrame:
    """(cluster, n, silhouette): mean Euclidean silhouette by cluster, exact over all rows.

    Every row's distances to all rows are summed by cluster. Up to most_held rows go to the executors as one array; beyond that rows are dealt to blocks (BLOCK_BYTES),
    every two blocks meet in one task, once for both directions, and the sums of a row come together afterwards. The work is quadratic either way.
    """
    kind = "array<float>" if df.schema[features].dataType.simpleString() == "array<float>" else "array<double>"
    part = df.select(F.col(key).alias("id"), F.col(features).cast(kind).alias("x"), F.col(cluster).cast("string").alias("c"))
    sizes = sorted(part.groupBy("c").agg(F.count(F.lit(1)).alias("size")).collect(), key=lambda r: r["c"])  # a row for each cluster
    spark, code, n = df.sparkSession, {r["c"]: k for k, r in enumerate(sizes)}, sum(r["size"] for r in sizes)
    shape = f"id {part.schema['id'].dataType.simpleString()}, own int, other int, s double"

    def arrays(t) -> tuple[np.ndarray, np.ndarray]:
        x = np.concatenate([np.zeros(0), *(c.flatten().to_numpy(zero_copy_only=False).astype(float) for c in t.column("x").chunks)])
        return x.reshape(t.num_rows, -1), np.array([code[c] for c in t.column("c").to_pylist()], np.int32)

    def listed(ids, own, s):
        """Rows of the result; clusters that had no rows here (sums of 0 over none) do no harm."""
        k = s.shape[1]
        columns = (ids.take(pa.array(np.repeat(np.arange(len(s)), k))), pa.array(np.repeat(own, k)), pa.array(np.tile(np.arange(k, dtype=np.int32), len(s))), pa.array(s.ravel()))
        return pa.table(columns, names=["id", "own", "other", "s"])

    if n <= most_held:
        x, c = arrays(part.toArrow()) if n else (None, None)

        def rows(batches):
            for batch in batches:
                if batch.num_rows:
                    y, own = arrays(t := pa.Table.from_batches([batch]))
                    yield from listed(t.column("id").combine_chunks(), own, _distance_sums(x, c, y, own, len(code), False)[0]).to_batches()

        met = part.mapInArrow(rows, shape)
    else:
        wide = 8 * max(part.agg(F.max(F.size("x"))).first()[0] or 1, 1)
        blocks = max(5, -(-n * wide // BLOCK_BYTES))
        own = part.withColumn("b", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int"))
        dealt = own.withColumn("_o", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).withColumn("p", (F.least("b", "_o") * blocks + F.greatest("b", "_o")).cast("int")).drop("_o")

        def pair(t):
            i, j = divmod(t.column("p")[0].as_py(), blocks)
            first, second = (t.filter(pa.array(t.column("b").to_numpy() == k)) for k in (i, j))
            if not first.num_rows or not second.num_rows:
                return listed(t.column("id").combine_chunks()[:0], np.zeros(0, np.int32), np.zeros((0, len(code))))
            (x, cx), (y, cy) = arrays(first), arrays(second)
            to_x, to_y = _distance_sums(x, cx, y, cy, len(code), i < j)
            out = listed(second.column("id").combine_chunks(), cy, to_x)
            return pa.concat_tables([out, listed(first.column("id").combine_chunks(), cx, to_y)]) if i < j else out

        met = dealt.repartitionByRange(blocks * (blocks + 1) // 2, "p").groupBy("p").applyInArrow(pair, shape)
    total = met.repartition("id").groupBy("id", "own", "other").agg(F.sum("s").alias("s"))
    known = spark.createDataFrame([(k, r["c"], r["size"]) for k, r in enumerate(sizes)], "other int, c string, size long")
    j = total.join(F.broadcast(known.drop("c")), "other")
    mine = F.col("own") == F.col("other")
    per = j.groupBy("id", "own").agg(F.max(F.when(mine, F.col("size"))).alias("n"), F.max(F.when(mine, F.col("s") / F.greatest(F.col("size") - 1, F.lit(1)))).alias("a"), F.min(F.when(~mine, F.col("s") / F.col("size"))).alias("b"))
    value = F.when((F.col("n") > 1) & F.col("b").isNotNull(), (F.col("b") - F.col("a")) / F.greatest("a", "b", F.lit(1e-300))).otherwise(0.0)
    out = per.groupBy("own").agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("silhouette"))
    return out.join(F.broadcast(known.select(F.col("other").alias("own"), F.col("c").alias("cluster"))), "own").select("cluster", "n", "silhouette")


def paired_t(df: DataFrame, a: str, b: str) -> DataFrame:
    """t, df, cohens_d of paired values."""
    d = F.col(a) - F.col(b)
    s = df.agg(F.avg(d).alias("m"), F.stddev_samp(d).alias("s"), F.count(d).alias("n"))
    return s.select(F.when(F.col("s") > 0, F.col("m") / (F.col("s") / F.sqrt("n"))).alias("t"), (F.col("n") - 1).alias("df"), F.when(F.col("s") > 0, F.col("m") / F.col("s")).alias("cohens_d"))


def cluster_folds(train: DataFrame, others: dict[str, DataFrame], key: str, columns: list[str], k: int = 5, folds: int = 5, seed: int = 42, labels: str | None = None) -> DataFrame:
    """(scenario, fold, ari, ami): agreement, on each fold of train, of a k-means model of each other table with train's own labels (column `labels`) or, without
    them, with a model of train's remaining folds.

    Features are scaled by train; each other table is sampled down to the size of the remaining folds. Folds and samples are counts of the distinct points
    (smallest()), by which the models weigh them, so no table's rows are shuffled or kept. Folds are as large as each other, to a row.
    """
    total = train.count()
    ends = [total * f // folds for f in range(folds + 1)]
    scale = Scale(train, columns)
    points = smallest(train, [*columns, *([labels] if labels and labels not in columns else [])], key, [(seed, n) for n in ends[1:]])
    taken = {name: smallest(t, columns, key, [(seed + f, total - ends[f + 1] + ends[f]) for f in range(folds)]) for name, t in others.items()}

    def model(t: DataFrame, w):
        return KMeans(k=k, seed=seed, maxIter=20, weightCol="_w").fit(scale.transform(t.withColumn("_w", w).where("_w > 0"), ["_w"]))

    def one(f: int):
        size = F.col(f"c{f}") - (F.col(f"c{f - 1}") if f else 0)
        own = points.withColumn("_n", size).where("_n > 0")
        base = scale.transform(own, ["_n", F.col(labels).alias("a")]) if labels else model(points, F.col(f"c{folds - 1}") - size).transform(scale.transform(own, ["_n"])).withColumnRenamed("prediction", "a")
        out = None
        for name, t in taken.items():
            both = model(t, F.col(f"c{f}")).transform(base).select("a", F.col("prediction").alias("b"), "_n")
            cells = both.groupBy("a", "b").agg(F.sum("_n").alias("n")).collect()  # a row for each pair of clusters
            small = train.sparkSession.createDataFrame([(str(r["a"]), str(r["b"]), int(r["n"])) for r in cells], "a string, b string, n long")
            row = ari(small, "a", "b", "n").crossJoin(ami(small, "a", "b", "n")).withColumns({"scenario": F.lit(name), "fold": F.lit(f)})  # one row each
            out = row if out is None else out.unionByName(row)
        return out

    with ThreadPoolExecutor(folds) as pool:
        rows = list(pool.map(one, range(folds)))
    for t in (points, *taken.values()):
        t.unpersist()
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out


def fold_summary(scores: DataFrame, raw: str, refined: str) -> DataFrame:
    """(metric, raw_mean, raw_std, refined_mean, refined_std, t, df, p, cohens_d): sample deviations and a paired test over the folds."""
    from tabsieve.operators.hypothesis import with_p

    out = None
    for m in ("ari", "ami"):
        wide = scores.groupBy("fold").agg(F.max(F.when(F.col("scenario") == raw, F.col(m))).alias("r"), F.max(F.when(F.col("scenario") == refined, F.col(m))).alias("f"))
        s = wide.agg(F.avg("r").alias("raw_mean"), F.stddev_samp("r").alias("raw_std"), F.avg("f").alias("refined_mean"), F.stddev_samp("f").alias("refined_std"))
        row = s.crossJoin(paired_t(wide, "f", "r")).withColumn("metric", F.lit(m))  # one row each
        out = row if out is None else out.unionByName(row)
    return with_p(out, "p", special.t_sf2, "t", "df")


def projection(tables: dict[str, DataFrame], key: str, columns: list[str], most: int = 1_000, seed: int = 42) -> DataFrame:
    """(dataset, key, pc1, pc2): principal components of the standardised union of samples of at most `most` rows a table."""
    both = None
    for name, t in tables.items():
        part = sample_n(t.select(key, *columns), most, key, seed).withColumn("dataset", F.lit(name))
        both = part if both is None else both.unionByName(part)
    scaled = standardised(both, both, columns, ["dataset", key]).persist()
    out = PCA(k=2, inputCol="features", outputCol="_pc").fit(scaled).transform(scaled)
    return out.select("dataset", key, *[vector_to_array("_pc")[i].alias(f"pc{i + 1}") for i in range(2)])


def pca_projection(df: DataFrame, key: str, features: str, k: int = 2) -> DataFrame:
    """(key, pc1..pck) of a vector column."""
    out = PCA(k=k, inputCol=features, outputCol="_pc").fit(df).transform(df)
    return out.select(key, *[vector_to_array("_pc")[i].alias(f"pc{i + 1}") for i in range(k)])


class Autoencoder:
    """Dense encoder and mirrored decoder in numpy: each hidden layer is linear, batch-normalised, leaky ReLU and dropout; the last layers of both are linear.

    Adam on the squared error, weight decay added to the gradients. It is fitted on a sample of at most `most_rows` rows and applied to all rows in Arrow batches, with
    running means in place of a batch's and no dropout.
    """

    SLOPE, DROP, MOMENTUM, EPS = 0.2, 0.1, 0.1, 1e-5

    def __init__(self, sizes: list[int], seed: int):
        rng = np.random.default_rng(seed)
        self.n_encoder = len(sizes) - 1
        dims = [*zip(sizes, sizes[1:]), *zip(sizes[::-1], sizes[::-1][1:])]
        self.plain = {self.n_encoder - 1, len(dims) - 1}  # layers without normalisation
        self.w = [{"w": rng.normal(0, (2 / a) ** 0.5, (a, b)), "b": np.zeros(b), "g": np.ones(b), "h": np.zeros(b)} for a, b in dims]
        self.mean, self.var = [np.zeros(b) for _, b in dims], [np.ones(b) for _, b in dims]

    @classmethod
    def fit(cls, x: np.ndarray, embedding: int = 10, epochs: int = 100, batch: int = 64, rate: float = 1e-3, decay: float = 1e-5, seed: int = 42, synthetic: np.ndarray | None = None, hidden: list[int] | None = None) -> Autoencoder:
        """Fit on rows x; with synthetic rows too, x is repeated as often as it goes into them."""
        d = x.shape[1]
        if synthetic is not None and len(x):
            x = np.concatenate([np.tile(x, (max(1, len(synthetic) // len(x)), 1)), synthetic])
        net = cls([d, *(hidden or [min(1000, 4 * d), min(500, 2 * d), min(50, d)]), min(embedding, max(8, d // 3))], seed)
        rng = np.random.default_rng(seed + 1)
        m = [{k: np.zeros_like(p) for k, p in w.items()} for w in net.w]
        v = [{k: np.zeros_like(p) for k, p in w.items()} for w in net.w]
        step = 0
        for _ in range(epochs):
            order = rng.permutation(len(x))
            for at in range(0, len(x), batch):
                part = x[order[at : at + batch]]
                if len(part) < 2:
                    continue  # no variance to normalise by
                step += 1
                for k, grads in enumerate(net._gradients(part, rng)):
                    for name, q in grads.items():
                        p = net.w[k][name]
                        q = q + decay * p
                        m[k][name] = 0.9 * m[k][name] + 0.1 * q
                        v[k][name] = 0.999 * v[k][name] + 0.001 * q * q
                        net.w[k][name] = p - rate * (m[k][name] / (1 - 0.9**step)) / (np.sqrt(v[k][name] / (1 - 0.999**step)) + 1e-8)
        return net

    @classmethod
    def on_sample(cls, df: DataFrame, key: str, columns: list[str], embedding: int, most_rows: int, epochs: int, seed: int) -> Autoencoder:
        sample = sample_n(df, most_rows, key, seed).select(*columns).toArrow()
        return cls.fit(np.stack([sample.column(c).to_numpy() for c in columns], 1).astype(float), embedding, epochs, seed=seed)

    def _gradients(self, x: np.ndarray, rng=None) -> list[dict]:
        """Gradients of the mean squared error on a batch; with a generator, dropout is drawn and running means move."""
        kept, a = [], x
        for k, w in enumerate(self.w):
            z = a @ w["w"] + w["b"]
            if k in self.plain:
                kept.append((a, None))
                a = z
                continue
            mean, var = z.mean(0), z.var(0)
            norm = (z - mean) / np.sqrt(var + self.EPS)
            y = norm * w["g"] + w["h"]
            mask = (rng.random(y.shape) >= self.DROP) / (1 - self.DROP) if rng is not None else np.ones_like(y)
            slope = np.where(y > 0, 1.0, self.SLOPE) * mask
            kept.append((a, (norm, var, slope)))
            a = y * slope
            if rng is not None:
                n = len(z)
                self.mean[k] = (1 - self.MOMENTUM) * self.mean[k] + self.MOMENTUM * mean
                self.var[k] = (1 - self.MOMENTUM) * self.var[k] + self.MOMENTUM * var * n / (n - 1)
        g, out = 2 * (a - x) / x.size, [None] * len(self.w)
        for k in range(len(self.w) - 1, -1, -1):
            a, hidden = kept[k]
            grads = {}
            if hidden:
                norm, var, slope = hidden
                g = g * slope
                grads = {"g": (g * norm).sum(0), "h": g.sum(0)}
                t = g * self.w[k]["g"]
                g = (t - t.mean(0) - norm * (t * norm).mean(0)) / np.sqrt(var + self.EPS)
            out[k] = grads | {"w": a.T @ g, "b": g.sum(0)}
            g = g @ self.w[k]["w"].T
        return out

    def _run(self, x: np.ndarray, layers: int | None = None) -> np.ndarray:
        for k, w in enumerate(self.w[:layers]):
            x = x @ w["w"] + w["b"]
            if k not in self.plain:
                x = (x - self.mean[k]) / np.sqrt(self.var[k] + self.EPS) * w["g"] + w["h"]
                x = np.where(x > 0, x, self.SLOPE * x)
        return x

    def encode(self, x: np.ndarray) -> np.ndarray:
        return self._run(x, self.n_encoder)

    def decode_error(self, x: np.ndarray) -> float:
        return float(((self._run(x) - x) ** 2).mean())

    def embedded(self, df: DataFrame, keep: list[str], columns: list[str]) -> DataFrame:
        """keep + x0, x1, ...: the embedding of each row."""
        n = self.w[self.n_encoder - 1]["b"].shape[0]

        def rows(batches):
            for batch in batches:
                z = self.encode(np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in columns], 1).astype(float))
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), *(pa.array(z[:, k]) for k in range(n))], names=[*keep, *(f"x{k}" for k in range(n))])

        kinds = [f"{c} {df.schema[c].dataType.simpleString()}" for c in keep] + [f"x{k} double" for k in range(n)]
        return df.select(*keep, *columns).mapInArrow(rows, ", ".join(kinds))


def embed(df: DataFrame, key: str, columns: list[str], embedding: int = 10, most_rows: int = 5_000, epochs: int = 100, seed: int = 42) -> DataFrame:
    """(key, embedding array<double>) of each row; the autoencoder is fitted on a bounded sample."""
    wide = Autoencoder.on_sample(df, key, columns, embedding, most_rows, epochs, seed).embedded(df, [key], columns)
    return wide.select(key, F.array(*wide.columns[1:]).alias("embedding"))
