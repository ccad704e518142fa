"""Chronological splits, samples and label controls."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickframe.operators.resampling import numbered
from tickframe.sources.tables import stored


def day_folds(rows: DataFrame, first_test: int = 2) -> DataFrame:
    """(fold, day, part): each day from the `first_test`-th on is a test day after training on all earlier ones."""
    days = rows.select("day").distinct().withColumn("number", F.row_number().over(Window.orderBy("day")))
    tests = days.where(F.col("number") >= first_test).select(F.col("day").alias("fold"), F.col("number").alias("at"))
    return tests.join(F.broadcast(days), F.col("number") <= F.col("at")).select("fold", "day", F.when(F.col("number") < F.col("at"), "train").otherwise("test").alias("part"))


def walk_forward(rows: DataFrame, order: Sequence[str], train: int, test: int, splits: int, embargo_us: int = 0) -> DataFrame:
    """`rows` with fold and part: anchored folds by position in `order` (time `us` first, unique).

    Fold i trains on the first train + i * test rows and tests on the next `test` rows that start more than `embargo_us`
    after the last training row. Folds stop at the first one whose test set falls short. Positions come from one range sort;
    what is gathered of the rows are two lines of `splits` numbers, and a row finds its folds by its position alone.
    """
    if min(train, test, splits) <= 0:
        raise ValueError("train, test and splits must be positive")
    placed = numbered(stored(rows), order)
    stops = [train + i * test for i in range(splits)]
    ends = placed.where(F.col("place").isin([s - 1 for s in stops])).agg(F.map_from_entries(F.collect_list(F.struct("place", "us"))).alias("us")).first()["us"]
    stops = [s for s in stops if s - 1 in ends]
    later = lambda s: (F.col("place") >= s) & (F.col("us") > ends[s - 1] + embargo_us if embargo_us > 0 else F.lit(True))
    starts = placed.agg(F.count("*").alias("n"), *[F.min(F.when(later(s), F.col("place"))).alias(f"first_{i}") for i, s in enumerate(stops)]).first()
    # Later folds start later and have no more rows left, so the folds before the first short one are those that are not.
    kept = [(i, s, first) for i, s in enumerate(stops) if (first := starts[f"first_{i}"]) is not None and starts["n"] - first >= test]
    if not kept:
        return placed.withColumns({"fold": F.lit(None).cast("int"), "stop": F.lit(None).cast("long"), "first": F.lit(None).cast("long"), "part": F.lit(None).cast("string")}).where("false")
    known = F.array(*[F.struct(F.lit(i).cast("int").alias("fold"), F.lit(s).cast("long").alias("stop"), F.lit(first).cast("long").alias("first")) for i, s, first in kept])
    holds = F.filter(known, lambda f: (F.col("place") < f["stop"]) | ((F.col("place") >= f["first"]) & (F.col("place") < f["first"] + test)))
    return placed.withColumn("_f", F.explode(holds)).withColumns({"fold": F.col("_f.fold"), "stop": F.col("_f.stop"), "first": F.col("_f.first")}).drop("_f").withColumn("part", F.when(F.col("place") < F.col("stop"), "train").otherwise("test"))


def period_folds(days: DataFrame, targets: Sequence[str], least_days: int) -> DataFrame:
    """(target, fold, substituted) from (period, day): each target period, or else the next period with at least
    `least_days` earlier days; targets without one are left out."""
    distinct = days.select("period", "day").distinct()
    periods = distinct.groupBy("period").agg(F.min("day").alias("first_day"))
    earlier = periods.join(F.broadcast(distinct.select(F.col("day").alias("d"))), F.col("d") < F.col("first_day"), "left").groupBy("period").agg(F.count("d").alias("prior_days"))
    eligible = earlier.where(F.col("prior_days") >= least_days)
    wanted = days.sparkSession.createDataFrame([(t,) for t in targets], "target string")
    found = wanted.join(F.broadcast(eligible), F.col("period") >= F.col("target")).groupBy("target").agg(F.min("period").alias("fold"))
    return found.withColumn("substituted", F.col("fold") != F.col("target"))


def fixed_cutoff(rows: DataFrame, declared: DataFrame, keys: Sequence[str], cutoff: str) -> DataFrame:
    """Adds part (train before the cutoff day, test from it on); a declared partition without rows is an error."""
    missing = declared.select(*keys).distinct().join(rows.select(*keys).distinct(), list(keys), "left_anti")
    if lost := missing.limit(3).collect():
        raise ValueError(f"declared partitions have no rows: {', '.join('/'.join(map(str, r)) for r in lost)}")
    return rows.withColumn("part", F.when(F.col("day") < cutoff, "train").otherwise("test"))


def period_parts(rows: DataFrame, train: Sequence[str], dev: Sequence[str], evaluation: Sequence[str]) -> DataFrame:
    """Adds part by lists of periods; rows of other periods are left out, and a period in two lists is an error."""
    if len({*train, *dev, *evaluation}) != len(train) + len(dev) + len(evaluation):
        raise ValueError("a period is in two parts")
    part = F.when(F.col("period").isin(*train), "train").when(F.col("period").isin(*dev), "dev").when(F.col("period").isin(*evaluation), "eval")
    return rows.withColumn("part", part).where("part IS NOT NULL")


def rolling_refits(periods: DataFrame) -> DataFrame:
    """(fit_through, apply_to): each period but the first is scored by a model fitted on all before it."""
    other = periods.select(F.col("period").alias("apply_to")).distinct()
    return other.join(periods.select("period").distinct(), F.col("period") < F.col("apply_to")).groupBy("apply_to").agg(F.max("period").alias("fit_through"))


def purge(rows: DataFrame, label_end: str = "future_us") -> DataFrame:
    """Training rows whose label ends before the fold's first test row, and all test rows."""
    first = rows.where("part = 'test'").groupBy("fold").agg(F.min("us").alias("test_us"))
    return rows.join(F.broadcast(first), "fold").where((F.col("part") == "test") | (F.col(label_end) < F.col("test_us"))).drop("test_us")


def quota_sample(rows: DataFrame, keys: Sequence[str], identity: Sequence[str], quota: int, seed: int = 1) -> DataFrame:
    """At most `quota` rows a group, by a hash of seed and identity."""
    order = Window.partitionBy(*keys).orderBy(F.md5(F.concat_ws(":", F.lit(str(seed)), *identity)), *identity)
    return rows.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= quota).drop("_n")


def quota_then_cap(rows: DataFrame, group: str, day: str, identity: Sequence[str], quota: int, cap: int, seed: int = 1) -> DataFrame:
    """At most `quota` rows a (group, day), and of those at most `cap` a group, both by hashes of seed and identity."""
    daily = quota_sample(rows, [group, day], identity, quota, seed)
    return quota_sample(daily, [group], identity, cap, seed + 1)


def selected_by_all(rows: DataFrame, predictions: Sequence[str], threshold: float) -> DataFrame:
    """Rows on which every prediction is strictly beyond the threshold, in either direction."""
    for p in predictions:
        rows = rows.where(F.abs(p) > threshold)
    return rows


def chosen_context(scores: DataFrame, keys: Sequence[str], context: str, score: str, tie: float = 1e-6) -> DataFrame:
    """Per key the smallest context whose score comes within `tie` of the best one."""
    best = F.max(score).over(Window.partitionBy(*keys))
    return scores.withColumn("_best", best).where(F.col(score) >= F.col("_best") - tie).groupBy(*keys).agg(F.min(context).alias("chosen"))


def common_cohort(rows: DataFrame, longest: int, contexts: Sequence[int]) -> DataFrame:
    """Rows with `longest` valid messages behind them, whose `window` is cut to the last `context` states of each context.

    All contexts have the same rows. `window` holds the last `longest` states.
    """
    cut = F.explode(F.array(*[F.struct(F.lit(c).alias("context"), F.slice("window", longest - c + 1, c).alias("states")) for c in contexts]))
    return rows.where(F.size("window") == longest).withColumn("_c", cut).withColumns({"context": F.col("_c.context"), "states": F.col("_c.states")}).drop("_c", "window")


def permute_labels(rows: DataFrame, keys: Sequence[str], identity: Sequence[str], label: str, seed: int = 1) -> DataFrame:
    """Labels dealt anew inside each group; every group keeps its labels as a multiset.

    Rows are numbered over all groups at once, in order and in mixed order, by ranges: a group has the same stretch of numbers in
    both, so the number alone says which label a row gets, and no task holds a group.
    """
    mixed = F.md5(F.concat_ws(":", F.lit(str(seed)), *identity))
    own = numbered(rows.select(*keys, *identity, F.struct("*").alias("_row")), [*keys, *identity])
    dealt = numbered(rows.select(*keys, mixed.alias("_mixed"), *identity, F.col(label).alias("shuffled")), [*keys, "_mixed", *identity])
    return own.join(dealt.select("place", "shuffled"), "place").select("_row.*", "shuffled")
