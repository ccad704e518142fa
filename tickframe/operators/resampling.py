"""Bootstrap intervals of block tables, and contrasts.

Picks are md5 hashes of (seed, draw, place), so reruns and engines agree. A draw is the number of times that each block is
picked; blocks are numbered once and meet the picks by number.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickframe.sources.tables import work_folder


def hashed(*parts: Column | str) -> Column:
    """A number of 60 bits from the md5 of the parts."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts)), 1, 15), 16, 10).cast("long")


def numbered(rows: DataFrame, order: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """Adds `place` from 0 in the order of `order` (unique), within `keys`, without one task for all rows.

    Rows are sorted by ranges; each range counts from its own start, plus the rows of the ranges before it. Only the
    table of ranges, one row each, is summed in one place.
    """
    if keys:
        return rows.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1)
    spark, path = rows.sparkSession, work_folder(rows.sparkSession, "numbered")
    # written once: ranges that differ between two runs of the sort would shift numbers; the low bits of the id count inside a range
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_id", F.monotonically_increasing_id())
    ranged.write.parquet(path)
    own = spark.read.schema(ranged.schema).parquet(path).withColumn("_range", F.shiftright("_id", 33))
    counts = own.groupBy(F.col("_range").alias("_of")).agg(F.count("*").alias("_n"))
    before = counts.select("_of", F.coalesce(F.sum("_n").over(Window.orderBy("_of").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    return own.join(F.broadcast(before), F.col("_range") == F.col("_of")).withColumn("place", F.col("_before") + F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))).drop("_range", "_id", "_of", "_before")


def tiled(rows: DataFrame, order: Sequence[str], tiles: int, name: str) -> DataFrame:
    """Adds the tile of NTILE from 0 over all rows in the order of `order` (unique), by ranges and not by one task."""
    placed = numbered(rows, order)
    size, longer = divmod(placed.count(), tiles)
    place, long_rows = F.col("place"), longer * (size + 1)
    tile = F.when(place < long_rows, place / (size + 1)).otherwise(longer + (place - long_rows) / max(size, 1))
    return placed.withColumn(name, F.floor(tile).cast("int")).drop("place")


def interval(means: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    return means.groupBy(*keys).agg(F.expr("percentile(m, 0.025)").alias("low"), F.expr("percentile(m, 0.975)").alias("high"), F.count("*").alias("draws"))


def block_bootstrap(deltas: DataFrame, order: Sequence[str], draws: int, seed: int = 7, most_blocks: int = 1_000_000) -> DataFrame:
    """2.5 and 97.5 percentiles of the mean over draws of as many blocks, with replacement.

    A draw is a row that looks its picks up in the array of all blocks, so draws run in parallel and nothing but their means is
    shuffled. Blocks are an aggregate (a stock's month, say); the array goes to every task, and more than `most_blocks` are refused.
    """
    blocks = deltas.agg(F.transform(F.array_sort(F.collect_list(F.struct(*order, "delta"))), lambda x: x["delta"]).alias("blocks"), F.count("*").alias("n"))
    blocks = blocks.withColumn("n", F.when(F.col("n") > most_blocks, F.raise_error(F.lit("too many blocks for one array")).cast("long")).otherwise(F.col("n"))).where("n > 0")
    pick = lambda i: F.element_at("blocks", (F.pmod(hashed(F.lit(str(seed)), F.col("id"), i), F.col("n")) + 1).cast("int"))
    total = F.aggregate(F.sequence(F.lit(0).cast("long"), F.col("n") - 1), F.lit(0.0), lambda sum_, i: sum_ + pick(i))
    spread = deltas.sparkSession.range(0, draws, 1, deltas.sparkSession.sparkContext.defaultParallelism)
    return interval(spread.join(F.broadcast(blocks)).select("id", (total / F.col("n")).alias("m")))


def moving_block_bootstrap(days: DataFrame, period: str, day: str, block: int, draws: int, seed: int) -> DataFrame:
    """Interval of the mean daily difference (`delta`) over draws of runs of `block` days, taken inside each period, not
    around its end, and cut to the period's length. A period shorter than a block is an error."""
    placed = days.withColumn("place", F.row_number().over(Window.partitionBy(period).orderBy(day)) - 1)
    sizes = placed.groupBy(period).agg(F.count("*").alias("n"))
    sizes = sizes.withColumn("n", F.when(F.col("n") < block, F.raise_error(F.lit("a period is shorter than a block")).cast("long")).otherwise(F.col("n")))
    starts = sizes.join(_draws(days, draws)).withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / block))))
    start = F.pmod(hashed(F.lit(str(seed)), F.col("id"), F.col(period), F.col("k")), F.col("n") - block + 1)
    picks = starts.withColumn("start", start).withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(block - 1)))).where(F.col("k") * block + F.col("j") < F.col("n"))
    means = picks.select("id", period, (F.col("start") + F.col("j")).alias("place")).join(placed.select(period, "place", "delta"), [period, "place"]).groupBy("id").agg(F.avg("delta").alias("m"))
    return interval(means)


def _draws(rows: DataFrame, draws: int) -> DataFrame:
    return F.broadcast(rows.sparkSession.range(draws))


def contrast(deltas: DataFrame, member: str) -> DataFrame:
    """Mean delta overall, of each member and without each member, in one table (scope, member)."""
    overall = deltas.agg(F.lit("all").alias("scope"), F.lit(None).cast("string").alias("member"), F.avg("delta").alias("mean_delta"), F.count("*").alias("blocks"))
    each = deltas.groupBy(F.lit("only").alias("scope"), F.col(member).alias("member")).agg(F.avg("delta").alias("mean_delta"), F.count("*").alias("blocks"))
    sums = F.broadcast(deltas.agg(F.sum("delta").alias("_s"), F.count("*").alias("_n")))
    without = each.join(sums).select(F.lit("without").alias("scope"), "member", F.try_divide(F.col("_s") - F.col("mean_delta") * F.col("blocks"), F.col("_n") - F.col("blocks")).alias("mean_delta"), (F.col("_n") - F.col("blocks")).alias("blocks"))
    return overall.unionByName(each).unionByName(without)


def ladder(cells: DataFrame, block: Sequence[str], arm: str, order: Sequence[str], value: str) -> DataFrame:
    """Mean of each arm of a ladder less the arm before it, over blocks that have both."""
    wide = cells.where(F.col(arm).isin(*order)).groupBy(*block).pivot(arm, list(order)).agg(F.first(value))
    steps = F.explode(F.array(*[F.struct(F.lit(f"{b} - {a}").alias("step"), (F.col(b) - F.col(a)).alias("delta")) for a, b in zip(order, order[1:], strict=False)]))
    return wide.select(*block, steps.alias("s")).select(*block, "s.step", "s.delta").where("delta IS NOT NULL").groupBy("step").agg(F.count("*").alias("blocks"), F.avg("delta").alias("mean_delta"), F.count_if(F.col("delta") > 0).alias("wins"))


def strict_paired(cells: DataFrame, grid: DataFrame, block: Sequence[str], arm: str, left: str, right: str, value: str) -> DataFrame:
    """Mean and median delta of two arms, NULL unless every block of the grid has both."""
    wide = cells.where(F.col(arm).isin(left, right)).groupBy(*block).pivot(arm, [left, right]).agg(F.first(value)).withColumn("delta", F.col(left) - F.col(right)).select(*block, "delta")
    joined = grid.join(wide, list(block), "left")
    whole = F.count("delta") == F.count("*")
    return joined.agg(F.count("*").alias("expected"), F.count("delta").alias("defined"), F.when(whole, F.avg("delta")).alias("mean_delta"), F.when(whole, F.expr("percentile(delta, 0.5)")).alias("median_delta"))


def strict_without(cells: DataFrame, grid: DataFrame, block: Sequence[str], member: str, arm: str, left: str, right: str, value: str) -> DataFrame:
    """The strict mean delta without each member of the grid (a stock or a period), by sums: NULL unless all other blocks have
    both arms. Members are few; their sums meet in one small table."""
    wide = cells.where(F.col(arm).isin(left, right)).groupBy(*block).pivot(arm, [left, right]).agg(F.first(value)).withColumn("delta", F.col(left) - F.col(right)).select(*block, "delta")
    each = grid.join(wide, list(block), "left").groupBy(member).agg(F.count("*").alias("_n"), F.count("delta").alias("_d"), F.coalesce(F.sum("delta"), F.lit(0.0)).alias("_s"))
    total = F.broadcast(each.agg(F.sum("_n").alias("n"), F.sum("_d").alias("d"), F.sum("_s").alias("s")))
    rest = each.join(total).select(member, (F.col("n") - F.col("_n")).alias("expected"), (F.col("d") - F.col("_d")).alias("defined"), (F.col("s") - F.col("_s")).alias("s"))
    return rest.select(member, "expected", "defined", F.when((F.col("expected") == F.col("defined")) & (F.col("expected") > 0), F.col("s") / F.col("expected")).alias("mean_without"))


def tail_contrast(buckets: DataFrame, keys: Sequence[str], value: str, bins: int) -> DataFrame:
    """Mean of the two outer bins less that of the two central ones; NULL unless all bins exist."""
    at = lambda *b: F.avg(F.when(F.col("bin").isin(*b), F.col(value)))
    gap = at(0, bins - 1) - at(bins // 2 - 1, bins // 2)
    return buckets.groupBy(*keys).agg(F.countDistinct("bin").alias("bins"), F.when(F.countDistinct("bin") == bins, gap).alias("tail_minus_centre"))
