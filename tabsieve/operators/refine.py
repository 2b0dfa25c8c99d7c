"""The whole refinement: drop identifiable rows, learn what real rows look like, resample the others by density ratio."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabsieve.functions.rng import sample_n
from tabsieve.operators import privacy, resample
from tabsieve.operators.columns import types_of_pair
from tabsieve.operators.encode import CodeEncoder
from tabsieve.operators.learning import FidelityModel
from tabsieve.operators.weights import processed


def split_for_training(safe: DataFrame, key: str, n: int, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """(training, rest): n rows, or half of them where there are fewer than twice as many."""
    n = min(n, safe.count() // 2)
    training = sample_n(safe, n, key, seed)
    return training, safe.join(training.select(key), key, "left_anti")


def refine(real: DataFrame, pool: DataFrame, key: str, columns: list[str], n: int | None = None, ratio: int = 4, method: str = "weighted", weight_processing: str = "flatten", alpha: float = 1.0, min_clip: float = 1e-9, seed: int = 42, **model) -> tuple[DataFrame, FidelityModel]:
    """(draws, model): draws is (draw, key, p, w), n rows (as many as real ones) drawn from the pool.

    1. Pool rows closer to a real row than its nearest real neighbour go (no identifiable row is left).
    2. ratio times as many rows as there are real ones train the classifier; the others, which it has not seen, get their weights from it.
    3. Weighted draws with replacement (or top_k etc.) from these others.
    """
    coder = CodeEncoder.fit(real, pool, columns)
    flags = privacy.flags(coder.transform(real, [key]), coder.transform(pool, [key]), key, columns)
    safe = privacy.kept(pool.select(key, *columns), flags, key).persist()  # until the model is fitted
    n_real = real.count()
    training, rest = split_for_training(safe, key, ratio * n_real, seed)
    kinds = {r["col"]: r["kind"] for r in types_of_pair(real, pool, columns).collect()}  # a row for each column
    fitted = FidelityModel.fit(real.select(key, *columns), training, key, kinds, pool=pool, seed=seed, **model)
    # the weights stay cached for the draws, which read them several times; fitted.cached.unpersist() lets them go
    weighted = fitted.cached = fitted.weights(rest).withColumn("w", processed(F.col("w"), weight_processing, alpha, min_clip)).persist()
    weighted.count()
    safe.unpersist()
    draws = resample.sir(weighted, key, "w", n_real if n is None else n, method, seed)
    return draws.join(weighted, key).select("draw", key, "p", "w"), fitted
