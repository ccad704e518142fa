"""Scores, buckets, strict summaries and paired comparison."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickframe.operators.ranges import exact_quantiles
from tickframe.sources.tables import stored


def average_rank(keys: Sequence[str], value: str) -> Column:
    """Rank from 1 with ties at their mean: half-way between the first and the last of equal values, in one sort."""
    w = Window.partitionBy(*keys).orderBy(value)
    return (F.rank().over(w) + F.count("*").over(w)) / 2.0


def score_set(rows: DataFrame, keys: Sequence[str], prediction: str, actual: str, cost_bps: float = 0.0) -> DataFrame:
    """Per cell: n, rank correlation, direction accuracy over nonzero outcomes, coverage, mean outcomes.

    Rows with a NULL are left out. The correlation is NULL if either side has one value only.
    """
    ranked = rows.where(F.col(prediction).isNotNull() & F.col(actual).isNotNull()).withColumns({"rank_p": average_rank(keys, prediction), "rank_a": average_rank(keys, actual)})
    p, a = F.col(prediction), F.col(actual)
    varied = (F.min(prediction) < F.max(prediction)) & (F.min(actual) < F.max(actual))
    return ranked.groupBy(*keys).agg(
        F.count("*").alias("n"), F.when(varied, F.corr("rank_p", "rank_a")).alias("ic"), F.avg(F.when(a != 0, (F.signum(p) == F.signum(a)).cast("double"))).alias("direction_accuracy"),
        F.avg((p != 0).cast("double")).alias("coverage"), F.avg(F.abs(a)).alias("mean_abs_actual"), F.avg(F.signum(p) * a - F.when(p != 0, cost_bps).otherwise(0.0)).alias("mean_signed_net"),
    )


def quantile_bins(rows: DataFrame, keys: Sequence[str], value: str, bins: int, name: str = "bin") -> DataFrame:
    """Adds the quantile bin from 0: right-closed, the lowest value included, ties together, equal edges merged.

    Edges are exact and found by ranges, so a key may hold any number of values; they meet the rows as one line a key. The rows
    are written once, as they are read three times.
    """
    rows = stored(rows, "binned")
    edges = exact_quantiles(rows, keys, value, [i / bins for i in range(bins + 1)]).select(*keys, F.array_distinct("quantiles").alias("edges"))
    joined = rows.join(edges, list(keys))
    return joined.withColumn(name, F.greatest(F.lit(0), F.size(F.filter(F.slice("edges", F.lit(1), F.greatest(F.size("edges") - 1, F.lit(1))), lambda e: e < F.col(value))) - 1)).drop("edges")


def bucket_table(rows: DataFrame, keys: Sequence[str], prediction: str, actual: str, bins: int) -> DataFrame:
    clean = rows.where(F.col(prediction).isNotNull() & F.col(actual).isNotNull())
    return quantile_bins(clean, keys, prediction, bins).groupBy(*keys, "bin").agg(F.count("*").alias("n"), F.avg(prediction).alias("mean_prediction"), F.avg(actual).alias("mean_actual"))


def strict_mean(rows: DataFrame, grid: DataFrame, keys: Sequence[str], cell: Sequence[str], value: str) -> DataFrame:
    """Mean over all cells that `grid` expects: NULL if one is missing or NULL, an error if one is there twice."""
    seen = rows.groupBy(*keys, *cell).agg(F.count("*").alias("times"), F.max(value).alias("v"))
    checked = seen.withColumn("v", F.when(F.col("times") > 1, F.raise_error(F.lit("a cell occurs twice")).cast("double")).otherwise(F.col("v")))
    return grid.join(checked, [*keys, *cell], "left").groupBy(*keys).agg(F.count("*").alias("expected"), F.count("v").alias("defined"), F.when(F.count("v") == F.count("*"), F.avg("v")).alias("strict_mean"), F.avg("v").alias("available_mean"))


def time_summary(rows: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Valid and invalid counts, share of zeros and quantiles of a gap; NULL and negative gaps are invalid."""
    good = F.when(F.col(value) >= 0, F.col(value))
    return rows.withColumn("_g", good).groupBy(*keys).agg(F.count("_g").alias("valid"), F.count_if(F.col("_g").isNull()).alias("invalid"), F.count_if(F.col("_g") == 0).alias("zeros"), *[F.expr(f"percentile(_g, {q})").alias(f"p{round(100 * q)}") for q in (0.1, 0.5, 0.9, 0.99)])


def paired(rows: DataFrame, block: Sequence[str], arm: str, left: str, right: str, value: str) -> DataFrame:
    """delta = value of arm `left` minus arm `right`, per block that has both."""
    wide = rows.where(F.col(arm).isin(left, right)).groupBy(*block).pivot(arm, [left, right]).agg(F.first(value))
    return wide.where(F.col(left).isNotNull() & F.col(right).isNotNull()).select(*block, (F.col(left) - F.col(right)).alias("delta"))


def leave_one_out(deltas: DataFrame, member: str) -> DataFrame:
    """Mean delta without each member, by sums, not by a join of every member with all rows."""
    each = deltas.groupBy(member).agg(F.sum("delta").alias("s"), F.count("*").alias("n"))
    everything = Window.partitionBy().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return each.select(member, F.try_divide(F.sum("s").over(everything) - F.col("s"), F.sum("n").over(everything) - F.col("n")).alias("mean_without"))
