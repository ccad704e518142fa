"""Regression as Spark aggregates: one pass for the moments of all folds, small solves, broadcast coefficients."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from multiprocessing.pool import ThreadPool
from typing import TypeVar

import numpy as np
from pyspark import inheritable_thread_target
from pyspark.ml.functions import predict_batch_udf
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from tickframe.operators.metrics import score_set
from tickframe.sources.tables import work_folder

Out = TypeVar("Out")


def fit_ridge(rows: DataFrame, fold: str | Sequence[str], features: Sequence[str], label: str, penalty: float = 1e-6) -> DataFrame:
    """(keys of `fold`, n, intercept, weights): standardised features (a constant one is left as it is), centred label.

    Rows with a NULL are left out. What comes to the driver is a table of p + p^2 sums a fold.
    """
    keys = [fold] if isinstance(fold, str) else list(fold)
    columns, p = [*features, label], len(features)
    clean = rows.dropna(subset=columns)
    # Covariances are merged about their own means: far from 0, plain cross-products would lose their digits.
    sums = [F.avg(x).alias(f"s{i}") for i, x in enumerate(columns)] + [F.covar_pop(columns[i], columns[j]).alias(f"x{i}_{j}") for i in range(p + 1) for j in range(i + 1)]
    fitted = []
    for row in clean.groupBy(*keys).agg(F.count("*").alias("n"), *sums).collect():
        n = row["n"]
        mean = np.array([row[f"s{i}"] for i in range(p + 1)])
        cross = np.array([[row[f"x{max(i, j)}_{min(i, j)}"] for j in range(p + 1)] for i in range(p + 1)]) * n
        scale = np.sqrt(np.maximum(np.diag(cross)[:p], 0) / n)
        scale[scale == 0] = 1.0
        weights = np.linalg.solve(cross[:p, :p] / np.outer(scale, scale) + penalty * np.eye(p), cross[:p, p] / scale) / scale
        fitted.append((*[row[k] for k in keys], n, float(mean[p] - weights @ mean[:p]), weights.tolist()))
    kinds = dict(rows.dtypes)
    return rows.sparkSession.createDataFrame(fitted, ", ".join(f"{k} {kinds[k]}" for k in keys) + ", n long, intercept double, weights array<double>")


def predict_ridge(rows: DataFrame, model: DataFrame, fold: str | Sequence[str], features: Sequence[str]) -> DataFrame:
    """Adds prediction; one small row a fold is broadcast."""
    keys = [fold] if isinstance(fold, str) else list(fold)
    joined = rows.join(F.broadcast(model.select(*keys, "intercept", "weights")), keys)
    value = F.col("intercept")
    for i, c in enumerate(features):
        value = value + F.col(c) * F.element_at("weights", i + 1)
    return joined.withColumn("prediction", value).drop("intercept", "weights")


def judged(predicted: DataFrame, keys: Sequence[str], label: str) -> DataFrame:
    """The score set of each cell, with its mean squared error."""
    error = F.col("prediction") - F.col(label)
    scores = score_set(predicted.withColumn("prediction", F.round("prediction", 9)), keys, "prediction", label)
    return scores.join(predicted.groupBy(*keys).agg(F.avg(error * error).alias("mse")), list(keys))


def flattened(rows: DataFrame, window: str, features: Sequence[str], length: int) -> tuple[DataFrame, list[str]]:
    """The states of a window as columns, oldest first, and their names."""
    names = [f"{f}_{k}" for k in range(length) for f in features]
    return rows.withColumns({f"{f}_{k}": F.element_at(window, k + 1)[f] for k in range(length) for f in features}), names


def ensembles(rows: DataFrame, keys: Sequence[str], identity: Sequence[str], seed: str, prediction: str, label: str) -> DataFrame:
    """Per cell the rank correlation of the seeds' mean prediction (ic_of_mean) and the mean of the seeds' own (mean_of_ic)."""
    together = rows.groupBy(*keys, *identity).agg(F.round(F.avg(prediction), 9).alias("_p"), F.first(label).alias("_a"))
    of_mean = score_set(together, keys, "_p", "_a").select(*keys, F.col("ic").alias("ic_of_mean"))
    each = score_set(rows, [*keys, seed], prediction, label).groupBy(*keys).agg(F.avg("ic").alias("mean_of_ic"))
    return of_mean.join(each, list(keys))


def score_windows(rows: DataFrame, identity: str, model: Callable[[np.ndarray], np.ndarray], length: int, width: int) -> DataFrame:
    """(identity, prediction): a model on batches of windows, each an array of `length` states of `width` numbers.

    The model takes an array (rows, length, width) and gives one number a row; batches come as Arrow.
    """
    run = predict_batch_udf(lambda: lambda flat: np.asarray(model(flat.reshape(-1, length, width)), float), return_type=DoubleType(), batch_size=4096, input_tensor_shapes=[[length * width]])
    state: Column = F.flatten(F.transform("window", lambda s: F.array(*[s[f].cast("double") for f in _fields(rows)])))
    return rows.select(identity, run(state).alias("prediction"))


#: The parts of a stored recurrent cell, each a matrix or vector by row.
CELL = ("input", "hidden", "bias", "out", "offset")


def store_cell(spark: SparkSession, weights: dict[str, np.ndarray], path: str) -> None:
    """A recurrent cell as a table (part, row, values) of a few kilobytes."""
    if set(weights) != set(CELL):
        raise ValueError(f"a cell has {', '.join(CELL)}")
    rows = [(part, i, [float(x) for x in row]) for part in CELL for i, row in enumerate(np.atleast_2d(weights[part]))]
    spark.createDataFrame(rows, "part string, row int, values array<double>").coalesce(1).write.parquet(path)


def load_cell(spark: SparkSession, path: str) -> Callable[[np.ndarray], np.ndarray]:
    """The stored cell as a model of windows: h = tanh(input x + hidden h + bias) over the states, then out h + offset."""
    found: dict[str, dict[int, list[float]]] = {}
    for part, row, values in spark.read.parquet(path).collect():
        found.setdefault(part, {})[row] = values
    if set(found) != set(CELL):
        raise ValueError("the stored model is no cell")
    w = {part: np.array([rows[i] for i in range(len(rows))]) for part, rows in found.items()}

    def model(states: np.ndarray) -> np.ndarray:
        h = np.zeros((len(states), len(w["hidden"])))
        for k in range(states.shape[1]):
            h = np.tanh(states[:, k] @ w["input"].T + h @ w["hidden"].T + w["bias"][0])
        return h @ w["out"][0] + w["offset"][0, 0]

    return model


def _fields(rows: DataFrame) -> list[str]:
    return rows.schema["window"].dataType.elementType.fieldNames()


#: Boosted trees by name: number, depth, step, least rows of a leaf, share of rows a tree sees.
TREES = {"small": (200, 3, 0.03, 25, 1.0), "standard": (50, 5, 0.1, 20, 0.8), "deep": (100, 6, 0.05, 50, 0.8)}


#: Training rows a task of a fit takes: every level of every tree is a job, so small fits should have few tasks.
TASK_ROWS = 200_000


def packed(rows: DataFrame, n: int) -> DataFrame:
    """The `n` rows in as few tasks as their number needs."""
    return rows.coalesce(max(1, -(-n // TASK_ROWS)))


def side_by_side(spark: SparkSession, fits: Sequence[Callable[[], Out]], n: int) -> list[Out]:
    """The results of the fits, in their order: as many at a time as have a core for each task of `n` rows, one at least."""
    at_once = max(1, min(len(fits), spark.sparkContext.defaultParallelism // max(1, -(-n // TASK_ROWS))))
    with ThreadPool(at_once) as pool:
        return pool.map(lambda run: run(), [inheritable_thread_target(spark)(f) for f in fits], chunksize=1)


def fit_trees(rows: DataFrame, features: Sequence[str], label: str, variant: str = "standard", seed: int = 1, count: int | None = None) -> Callable[[DataFrame], DataFrame]:
    """Fits a variant (with `count` trees in place of its own); the result adds `prediction` to rows, and has `gains` by feature."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import GBTRegressor

    trees, depth, step, leaf, share = TREES[variant]
    context = rows.sparkSession.sparkContext
    if context.getCheckpointDir() is None:  # else each tree's predictions would carry the lineage of all before
        context.setCheckpointDir(work_folder(rows.sparkSession, "fits"))
    assembler = VectorAssembler(inputCols=list(features), outputCol="_x")
    assembled = assembler.transform(rows.dropna(subset=[*features, label]).withColumn("_y", F.col(label)))
    model = GBTRegressor(featuresCol="_x", labelCol="_y", maxIter=count or trees, maxDepth=depth, stepSize=step, subsamplingRate=share, minInstancesPerNode=leaf, maxBins=256, seed=seed).fit(assembled)

    def predict(more: DataFrame) -> DataFrame:
        return model.transform(assembler.transform(more.dropna(subset=list(features)))).drop("_x")

    predict.gains = {f: float(g) for f, g in zip(features, model.featureImportances.toArray(), strict=True)}
    return predict


def boosted_trees(train: DataFrame, test: DataFrame, features: Sequence[str], label: str, keys: Sequence[str], variant: str = "standard", seed: int = 1, count: int | None = None) -> DataFrame:
    """Scores of boosted trees per cell, with each feature's share of the gain (they add up to 1, or are all 0)."""
    model = fit_trees(train, features, label, variant, seed, count)
    scored = judged(model(test.dropna(subset=[*features, label])), keys, label)
    return scored.withColumns({f"gain_{f}": F.lit(g) for f, g in model.gains.items()})
