"""Summaries of predictions over days, blocks, deciles, delays and arms.

A block is one cell of the declared grid (a stock and a day, say). "Strict" means NULL unless every expected block is defined.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickframe.operators.metrics import average_rank, quantile_bins, score_set


def day_scores(rows: DataFrame, keys: Sequence[str], prediction: str, actual: str) -> DataFrame:
    """Per cell: n, ic, mse, means and population deviations of both sides, and why ic is undefined (reason), if it is."""
    clean = rows.where(F.col(prediction).isNotNull() & F.col(actual).isNotNull())
    ranked = clean.withColumns({"_rp": average_rank(keys, prediction), "_ra": average_rank(keys, actual)})
    constant = lambda c: F.min(c) == F.max(c)
    reason = F.when(F.count("*") < 3, "fewer than 3 rows").when(constant(actual), "constant label").when(constant(prediction), "constant prediction")
    error = F.col(prediction) - F.col(actual)
    return ranked.groupBy(*keys).agg(
        F.count("*").alias("n"), F.when(reason.isNull(), F.corr("_rp", "_ra")).alias("ic"), F.avg(error * error).alias("mse"), F.avg(prediction).alias("mean_prediction"), F.avg(actual).alias("mean_actual"),
        F.stddev_pop(prediction).alias("std_prediction"), F.stddev_pop(actual).alias("std_actual"), reason.alias("reason"),
    )


def daily_mean_correlation(rows: DataFrame, keys: Sequence[str], day: str, prediction: str, actual: str) -> DataFrame:
    """Rank correlation over days of the days' mean prediction and mean outcome."""
    means = rows.where(F.col(actual).isNotNull()).groupBy(*keys, day).agg(F.avg(prediction).alias("_p"), F.avg(actual).alias("_a"))
    return score_set(means, keys, "_p", "_a").select(*keys, F.col("n").alias("days"), "ic")


def grouped_scores(rows: DataFrame, keys: Sequence[str], day: str, prediction: str, actual: str) -> DataFrame:
    """Scores of all rows of a group (day "all") and of each of its days; ranks are taken anew at each level."""
    each = score_set(rows, [*keys, day], prediction, actual)
    whole = score_set(rows, keys, prediction, actual).withColumn(day, F.lit("all"))
    return each.unionByName(whole)


def fold_quantiles(rows: DataFrame, fold: str, prediction: str, actual: str, bins: int) -> tuple[DataFrame, DataFrame]:
    """Tables by (fold, bin) and pooled by bin, with bins cut inside each fold; the pooled one counts its folds."""
    placed = quantile_bins(rows.where(F.col(prediction).isNotNull() & F.col(actual).isNotNull()), [fold], prediction, bins)
    stats = [F.count("*").alias("n"), F.avg(prediction).alias("mean_prediction"), F.avg(actual).alias("mean_actual")]
    return placed.groupBy(fold, "bin").agg(*stats), placed.groupBy("bin").agg(F.countDistinct(fold).alias("fold_count"), *stats)


def side_selected(prediction: Column, long: Column, short: Column) -> Column:
    """The long outcome for a positive prediction, the short one for a negative, NULL for 0."""
    return F.when(prediction > 0, long).when(prediction < 0, short)


def execution_by_bin(rows: DataFrame, keys: Sequence[str], prediction: str, long: str, short: str, threshold: float, bins: int = 10) -> DataFrame:
    """Per cell: rows, selected rows (|prediction| above the threshold), coverage, mean selected outcome, mean outcome of
    the lowest and highest bin, and whether bin means never fall."""
    outcome = side_selected(F.col(prediction), F.col(long), F.col(short))
    placed = quantile_bins(rows.where(F.col(prediction).isNotNull() & F.col(long).isNotNull() & F.col(short).isNotNull()), keys, prediction, bins).withColumn("_o", outcome)
    chosen = F.abs(F.col(prediction)) > threshold
    per_bin = placed.groupBy(*keys, "bin").agg(F.count("*").alias("_n"), F.count_if(chosen).alias("_k"), F.sum(F.when(chosen, F.col("_o"))).alias("_s"), F.count(F.when(chosen, F.col("_o"))).alias("_m"), F.avg("_o").alias("_v"))
    stepped = per_bin.withColumn("_step", F.col("_v") - F.lag("_v").over(Window.partitionBy(*keys).orderBy("bin")))
    return stepped.groupBy(*keys).agg(F.sum("_n").alias("n"), F.sum("_k").alias("selected"), (F.sum("_k") / F.sum("_n")).alias("coverage"), F.try_divide(F.sum("_s"), F.sum("_m")).alias("selected_mean"), F.min_by("_v", "bin").alias("low_bin_mean"), F.max_by("_v", "bin").alias("high_bin_mean"), F.coalesce(F.bool_and(F.col("_step") >= 0), F.lit(True)).alias("ordered"))


def bin_steps(buckets: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Adds `step`, the difference to the bin before, and `rises` (NULL on the first bin)."""
    step = F.col(value) - F.lag(value).over(Window.partitionBy(*keys).orderBy("bin"))
    return buckets.withColumn("step", step).withColumn("rises", F.col("step") >= 0)


def period_bins_by_day(rows: DataFrame, keys: Sequence[str], period: str, day: str, prediction: str, outcome: str, bins: int) -> DataFrame:
    """Bins cut over a period, and their outcomes for the period (day NULL) and each of its days."""
    placed = quantile_bins(rows.where(F.col(prediction).isNotNull() & F.col(outcome).isNotNull()), [*keys, period], prediction, bins)
    levels = placed.groupingSets([[*keys, period, "bin"], [*keys, period, "bin", day]], *keys, period, "bin", day)
    return levels.agg(F.count("*").alias("n"), F.avg(outcome).alias("mean_outcome"))


def selected_costs(rows: DataFrame, keys: Sequence[str], prediction: str, threshold: float, common: Column | None = None) -> DataFrame:
    """Mean gross move, half-spreads and net outcome of the selected rows, signed by the prediction, with the largest
    residual of net = gross - entry - exit, and a reason where nothing is selected.

    Needs gross_bps, entry_half_bps, exit_half_bps, long_crossed_bps and short_crossed_bps.
    """
    p = F.col(prediction)
    chosen = (F.abs(p) > threshold) & F.col("gross_bps").isNotNull() & (F.lit(True) if common is None else common)
    signed = F.signum(p) * F.col("gross_bps")
    net = side_selected(p, F.col("long_crossed_bps"), F.col("short_crossed_bps"))
    picked = rows.withColumns({"_g": F.when(chosen, signed), "_i": F.when(chosen, F.col("entry_half_bps")), "_o": F.when(chosen, F.col("exit_half_bps")), "_n": F.when(chosen, net)})
    return picked.groupBy(*keys).agg(F.count("_g").alias("selected"), F.avg("_g").alias("gross_bps"), F.avg("_i").alias("entry_half_bps"), F.avg("_o").alias("exit_half_bps"), F.avg("_n").alias("net_bps"), F.max(F.abs(F.col("_n") - (F.col("_g") - F.col("_i") - F.col("_o")))).alias("max_residual"), F.when(F.count("_g") == 0, "no selected row").alias("reason"))


def gap_precision(rows: DataFrame, keys: Sequence[str], gap: str) -> DataFrame:
    """Gaps of a clock per key: their number, zero gaps, the smallest positive one, and the greatest common divisor of all.

    Each task folds its rows to one line a key, and the lines of a key are folded once more where they meet: a key costs four
    numbers at any time, however many distinct gaps it has.
    """
    kinds = dict(rows.dtypes)
    schema = ", ".join(f"{k} {kinds[k]}" for k in keys) + ", gaps long, zeros long, least_positive long, divisor long"
    names = [*keys, "gaps", "zeros", "least_positive", "divisor"]
    g = F.col(gap).cast("long")
    own = rows.where(F.col(gap).isNotNull()).select(*keys, F.lit(1).cast("long").alias("gaps"), (g == 0).cast("long").alias("zeros"), F.when(g > 0, g).alias("least_positive"), F.abs(g).alias("divisor"))
    fold = _gap_fold(list(keys), names)
    return own.mapInArrow(fold, schema).repartition(*keys).sortWithinPartitions(*keys).mapInArrow(fold, schema)


def _gap_fold(keys: list[str], names: list[str], most_keys: int = 100_000) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def fold(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[tuple, list] = {}
        types: list[pa.DataType] = []

        def out() -> pa.RecordBatch:
            columns = zip(*[(*key, *values) for key, values in found.items()], strict=True)
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, types, strict=True)], names)

        for batch in batches:
            if batch.num_rows == 0:
                continue
            types = [batch.column(n).type for n in names]
            frame = pa.Table.from_batches([batch]).to_pandas().groupby(keys, dropna=False, sort=False)
            for group, part in frame:
                key = tuple(None if k != k else k for k in group)
                one = found.setdefault(key, [0, 0, None, 0])
                least = part["least_positive"].dropna()
                one[0] += int(part["gaps"].sum())
                one[1] += int(part["zeros"].sum())
                if len(least):
                    one[2] = int(least.min()) if one[2] is None else min(one[2], int(least.min()))
                one[3] = int(np.gcd.reduce(np.append(part["divisor"].to_numpy(np.int64), one[3])))
            # rows of a key come together where keys are sorted: the last key may go on, all others are whole
            if len(found) > most_keys:
                *_, last = found
                kept = found.pop(last)
                yield out()
                found = {last: kept}
        if found:
            yield out()

    return fold


def partition_summary(rows: DataFrame, declared: DataFrame, keys: Sequence[str], good: Column, error: Column) -> DataFrame:
    """Rows, finite rows and the identity error of each declared partition; an empty one stays, with 0 rows."""
    found = rows.groupBy(*keys).agg(F.count("*").alias("rows"), F.count_if(good).alias("finite_rows"), F.max(F.when(good, error)).alias("max_error"), F.avg(F.when(good, error)).alias("mean_error"))
    joined = declared.select(*keys).distinct().join(found, list(keys), "left")
    return joined.select(*keys, F.coalesce("rows", F.lit(0)).alias("rows"), F.coalesce("finite_rows", F.lit(0)).alias("finite_rows"), "max_error", "mean_error")


def block_means(cells: DataFrame, keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Equal-weight means over blocks, with the number of blocks; a NULL key is a group of its own."""
    return cells.groupBy(*keys).agg(F.count("*").alias("blocks"), *[F.avg(v).alias(v) for v in values])


def strict_blocks(cells: DataFrame, grid: DataFrame, keys: Sequence[str], block: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Per metric the mean, median and number of positive blocks, NULL unless all blocks of the grid are defined, and the
    number of defined ones."""
    joined = grid.join(cells, [*keys, *block], "left")
    strict = lambda v, x: F.when(F.count(v) == F.count("*"), x)
    out = [f for v in values for f in (F.count(v).alias(f"{v}_defined"), strict(v, F.avg(v)).alias(f"{v}_mean"), strict(v, F.expr(f"percentile({v}, 0.5)")).alias(f"{v}_median"), strict(v, F.count_if(F.col(v) > 0)).alias(f"{v}_positive"))]
    return joined.groupBy(*keys).agg(F.count("*").alias("expected"), *out)


def change_from_base(cells: DataFrame, keys: Sequence[str], axis: str, base: object, value: str) -> DataFrame:
    """Adds `change`: the value less that of the cell where `axis` is `base`."""
    at_base = F.max(F.when(F.col(axis) == base, F.col(value))).over(Window.partitionBy(*keys))
    return cells.withColumn("change", F.col(value) - at_base)


def pooled_mean(cells: DataFrame, keys: Sequence[str], value: str, weight: str) -> DataFrame:
    """Mean of blocks with equal weight, and pooled by their rows."""
    own = F.when(F.col(value).isNotNull(), F.col(weight))
    return cells.groupBy(*keys).agg(F.avg(value).alias("equal_mean"), F.try_divide(F.sum(F.col(value) * F.col(weight)), F.sum(own)).alias("pooled_mean"), F.sum(weight).alias("rows"))


def edge_and_costs(cells: DataFrame, keys: Sequence[str], weight: str = "selected", tolerance: float = 1e-6) -> DataFrame:
    """Components of the selected rows' outcome by cell set: gross, both half-spreads and net, each as the mean of blocks with equal
    weight and weighted by selected rows, with the break-even cost (what is left of gross before costs eat it).

    Net must be gross less both half-spreads in either mean; a larger difference than `tolerance` is an error. Blocks without a
    selected row count as blocks and have no part in the means.
    """
    parts = ("gross_bps", "entry_half_bps", "exit_half_bps", "net_bps")
    own = F.when(F.col("net_bps").isNotNull(), F.col(weight))
    means = [F.avg(x).alias(f"equal_{x}") for x in parts] + [F.try_divide(F.sum(F.col(x) * F.col(weight)), F.sum(own)).alias(f"pooled_{x}") for x in parts]
    out = cells.groupBy(*keys).agg(F.count("*").alias("blocks"), F.count("net_bps").alias("defined"), F.sum(own).alias("rows"), *means)
    for kind in ("equal", "pooled"):
        gap = F.abs(F.col(f"{kind}_net_bps") - (F.col(f"{kind}_gross_bps") - F.col(f"{kind}_entry_half_bps") - F.col(f"{kind}_exit_half_bps")))
        checked = F.when(gap > tolerance, F.raise_error(F.lit("components do not add up")).cast("double")).otherwise(F.col(f"{kind}_net_bps"))
        out = out.withColumn(f"{kind}_net_bps", checked)
    return out.withColumn("pooled_cost_bps", F.col("pooled_entry_half_bps") + F.col("pooled_exit_half_bps"))


def delay_matrix(cells: DataFrame, grid: DataFrame, keys: Sequence[str], block: Sequence[str], value: str, weight: str) -> DataFrame:
    """Per arm and delay: strict equal-cell mean, pooled mean, expected and defined cells, and the undefined ones by name."""
    joined = grid.join(cells, [*keys, *block], "left")
    name = F.concat_ws("/", *block)
    own = F.when(F.col(value).isNotNull(), F.col(weight))
    return joined.groupBy(*keys).agg(F.count("*").alias("expected"), F.count(value).alias("defined"), F.when(F.count(value) == F.count("*"), F.avg(value)).alias("equal_mean"), F.try_divide(F.sum(F.col(value) * F.col(weight)), F.sum(own)).alias("pooled_mean"), F.array_join(F.sort_array(F.collect_list(F.when(F.col(value).isNull(), name))), ",").alias("undefined"))


def unequal_cells(rows: DataFrame, block: Sequence[str], arm: str) -> DataFrame:
    """Blocks whose arms do not have the same number of rows."""
    counts = rows.groupBy(*block, arm).agg(F.count("*").alias("n"))
    return counts.groupBy(*block).agg(F.min("n").alias("least"), F.max("n").alias("most"), F.count("*").alias("arms")).where("least <> most")


def spread_over_seeds(cells: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Smallest, largest and mean value over seeds, with the population deviation."""
    return cells.groupBy(*keys).agg(F.count(value).alias("seeds"), F.min(value).alias("least"), F.max(value).alias("most"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("deviation"))


def levels_summary(rows: DataFrame, first: str, second: str, value: str) -> DataFrame:
    """Count and mean overall, by `first` and by `second`."""
    return rows.groupingSets([[], [first], [second]], first, second).agg(F.count("*").alias("n"), F.avg(value).alias("mean"))
