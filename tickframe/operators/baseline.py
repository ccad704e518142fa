"""The walk-forward baseline as tables: fold log, prediction rows, scores by fold and pooled, and buckets, each beside a control.

The control learns from training labels dealt anew inside a fold; it shows what a score is worth without a relation.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import partial, reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickframe.operators import folds
from tickframe.operators.metrics import bucket_table
from tickframe.operators.models import TREES, fit_ridge, fit_trees, judged, packed, predict_ridge, side_by_side
from tickframe.operators.ranges import ranked
from tickframe.sources.tables import stored, work_folder

#: (training rows by fold and run, test rows by fold, features, label) to test rows by fold and run with `prediction`.
Fit = Callable[[DataFrame, DataFrame, Sequence[str], str], DataFrame]


@dataclass(frozen=True)
class Baseline:
    folds: DataFrame
    predictions: DataFrame
    scores: DataFrame
    buckets: DataFrame


def ridge(train: DataFrame, test: DataFrame, features: Sequence[str], label: str) -> DataFrame:
    """One pass gives the moments of all folds and both runs."""
    model = fit_ridge(train, ["fold", "run"], features, label)
    return predict_ridge(test.join(F.broadcast(model.select("fold", "run")), "fold"), model, ["fold", "run"], features)


def trees(variant: str = "small", seed: int = 1, count: int | None = None) -> Fit:
    """One fit of boosted trees a fold and run, each a Spark job over its own rows, which are written once."""
    if variant not in TREES:
        raise ValueError(f"unknown variant {variant}")

    def fit(train: DataFrame, test: DataFrame, features: Sequence[str], label: str) -> DataFrame:
        path = work_folder(train.sparkSession, "learned")
        rows = train.select("fold", "run", *features, label)
        rows.write.partitionBy("fold", "run").parquet(path)
        train, test = train.sparkSession.read.schema(rows.schema).parquet(path), stored(test, "tests")
        sizes = sorted(map(tuple, train.groupBy("fold", "run").count().collect()))

        def one(fold: int, run: str, n: int) -> DataFrame:
            model = fit_trees(packed(train.where((F.col("fold") == fold) & (F.col("run") == run)), n), features, label, variant, seed, count)
            return model(test.where(F.col("fold") == fold).withColumn("run", F.lit(run)))

        return reduce(DataFrame.unionByName, side_by_side(train.sparkSession, [partial(one, *size) for size in sizes], max(n for *_, n in sizes)))

    return fit


def run_baseline(rows: DataFrame, order: Sequence[str], identity: str, features: Sequence[str], label: str, train: int, test: int, splits: int, embargo_us: int = 0, fit: Fit = ridge, bins: int = 5, label_end: str = "future_us") -> Baseline:
    """Anchored folds with embargo and purge, fitted on training rows and on their control, as tables.

    folds: rows before and after the purge, the test's rows and time, the last training time and label ends. predictions: one row
    a fold, run and test row. scores: by fold, and pooled over folds (fold NULL). buckets: quantile bins of the pooled fitted
    predictions. A row without a feature, label or label end takes no part; without a fold with enough rows it is an error.
    """
    path = work_folder(rows.sparkSession, "walk")
    folds.walk_forward(rows.dropna(subset=[*features, label, label_end]).select(*order, label_end, *features, label), order, train, test, splits, embargo_us).write.parquet(path)
    placed = rows.sparkSession.read.parquet(path)
    kept = folds.purge(placed, label_end)
    is_train, is_test = F.col("part") == "train", F.col("part") == "test"
    before = placed.groupBy("fold").agg(F.count_if(is_train).alias("train_before"), F.max(F.when(is_train, F.col(label_end))).alias("last_label_before"), F.count_if(is_test).alias("test"), F.min(F.when(is_test, F.col("us"))).alias("test_first_us"), F.max(F.when(is_test, F.col("us"))).alias("test_last_us"))
    after = kept.where(is_train).groupBy("fold").agg(F.count("*").alias("train_after"), F.max("us").alias("last_train_us"), F.max(label_end).alias("last_label_after"))
    enough = after.where(F.col("train_after") >= max(2, len(features) + 1))
    if enough.isEmpty():
        raise ValueError("there is no fold with enough rows")
    learned = kept.where(is_train).join(F.broadcast(enough.select("fold")), "fold")
    dealt = folds.permute_labels(learned, ["fold"], [identity], label).withColumn(label, F.col("shuffled")).drop("shuffled")
    both = learned.withColumn("run", F.lit("fitted")).unionByName(dealt.withColumn("run", F.lit("shuffled")))
    tests = kept.where(is_test).join(F.broadcast(enough.select("fold")), "fold")
    predicted = fit(both, tests, features, label).select("fold", "run", *dict.fromkeys([*order, identity]), F.round("prediction", 9).alias("prediction"), F.col(label).alias("actual"))
    out = work_folder(rows.sparkSession, "predictions")
    predicted.write.parquet(out)
    predicted = rows.sparkSession.read.parquet(out)
    scores = judged(predicted, ["fold", "run"], "actual").unionByName(pooled_scores(predicted, ["run"]).withColumn("fold", F.lit(None).cast("int")))
    buckets = bucket_table(predicted.where("run = 'fitted'"), ["run"], "prediction", "actual", bins)
    return Baseline(before.join(enough, "fold"), predicted, scores, buckets)


def pooled_scores(rows: DataFrame, keys: Sequence[str], prediction: str = "prediction", actual: str = "actual") -> DataFrame:
    """The score set with ranks by ranges, for keys that hold any number of rows."""
    p, a = F.col(prediction), F.col(actual)
    both = ranked(ranked(rows.where(p.isNotNull() & a.isNotNull()), keys, prediction, "_rank_p"), keys, actual, "_rank_a")
    varied = (F.min(prediction) < F.max(prediction)) & (F.min(actual) < F.max(actual))
    return both.groupBy(*keys).agg(
        F.count("*").alias("n"), F.when(varied, F.corr("_rank_p", "_rank_a")).alias("ic"), F.avg(F.when(a != 0, (F.signum(p) == F.signum(a)).cast("double"))).alias("direction_accuracy"), F.avg((p != 0).cast("double")).alias("coverage"),
        F.avg(F.abs(a)).alias("mean_abs_actual"), F.avg(F.signum(p) * a).alias("mean_signed_net"), F.avg((p - a) * (p - a)).alias("mse"),
    )
