"""Transfer folds, states that are cut on training rows, and manifests of partitions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def transfer_folds(cells: DataFrame) -> DataFrame:
    """(held_out, fold, symbol, day, part) from distinct (symbol, day): tests on one stock-day, trains on the other stocks' earlier days."""
    tests = cells.select(F.col("symbol").alias("held_out"), F.col("day").alias("fold"))
    train = tests.join(cells, (F.col("symbol") != F.col("held_out")) & (F.col("day") < F.col("fold"))).withColumn("part", F.lit("train"))
    return train.unionByName(tests.select("held_out", "fold", F.col("held_out").alias("symbol"), F.col("fold").alias("day"), F.lit("test").alias("part")))


def tercile_grid(train: DataFrame, test: DataFrame, x: str, y: str, value: str) -> DataFrame:
    """Mean of `value` over test rows in 3 x 3 states cut at the training terciles; ties go left and empty cells stay."""
    cuts = train.agg(*[F.expr(f"percentile({c}, array(1/3D, 2/3D))").alias(f"cuts_{c}") for c in (x, y)])
    state = lambda c: F.size(F.filter(f"cuts_{c}", lambda cut: cut < F.col(c)))
    placed = test.join(F.broadcast(cuts)).groupBy(state(x).alias("state_x"), state(y).alias("state_y")).agg(F.count("*").alias("n"), F.avg(value).alias("mean"))
    three = lambda name: test.sparkSession.range(3).select(F.col("id").cast("int").alias(name))
    return three("state_x").join(three("state_y")).join(placed, ["state_x", "state_y"], "left").select("state_x", "state_y", F.coalesce("n", F.lit(0)).alias("n"), "mean")


def activity_state(train: DataFrame, rows: DataFrame, duration: str) -> DataFrame:
    """Adds `activity`: high below the training median of positive durations, low from it on, neither for the rest."""
    median = train.where(F.col(duration) > 0).agg(F.expr(f"percentile({duration}, 0.5)").alias("_median"))
    state = F.when(F.coalesce(F.col(duration) <= 0, F.lit(True)), "neither").when(F.col(duration) < F.col("_median"), "high").otherwise("low")
    return rows.join(F.broadcast(median)).withColumn("activity", state).drop("_median")


def manifest(rows: DataFrame, keys: Sequence[str], content: Sequence[str]) -> DataFrame:
    """Row count, an order-free digest of the content and the content's types, of each partition."""
    digest = F.conv(F.substring(F.md5(F.concat_ws("|", *content)), 1, 15), 16, 10).cast("long")
    kinds = F.lit(rows.select(*content).schema.simpleString())
    return rows.groupBy(*keys).agg(F.count("*").alias("rows"), F.bit_xor(digest).alias("digest")).withColumn("types", kinds)


def manifest_violations(declared: DataFrame, actual: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Partitions that are missing, unexpected, of other types or changed."""
    said = ("rows", "digest", "types")
    both = declared.select(*keys, F.struct(*said).alias("declared")).join(actual.select(*keys, F.struct(*said).alias("actual")), list(keys), "full_outer")
    problem = F.when(F.col("actual").isNull(), "missing").when(F.col("declared").isNull(), "unexpected").when(F.col("declared.types") != F.col("actual.types"), "types").when(F.col("declared") != F.col("actual"), "changed")
    return both.select(*keys, problem.alias("problem")).where("problem IS NOT NULL")


def window_funnel(runs: DataFrame, keys: Sequence[str], features: Sequence[str], label: str, length: int, stride: int) -> DataFrame:
    """Counts of states by what bars them from being scored, in this order: a run shorter than `length`, a feature in the window
    that is NULL, NaN or infinite, and, of the rows at the stride, a missing label. `runs` has run_id and run_length."""
    bad = F.lit(False)
    for f in features:
        bad = bad | F.col(f).isNull() | F.isnan(f) | (F.abs(f) == float("inf"))
    window = Window.partitionBy("symbol", "day", "segment", "run_id").orderBy("event_index").rowsBetween(-(length - 1), 0)
    marked = runs.withColumn("_bad", F.max(F.coalesce(bad, F.lit(True))).over(window))
    full = F.col("run_length") >= length
    good, due = full & ~F.col("_bad"), F.col("event_index") % stride == 0
    has = F.col(label).isNotNull()
    return marked.groupBy(*keys).agg(F.count("*").alias("states"), F.count_if(~full).alias("short_or_broken"), F.count_if(full & F.col("_bad")).alias("nonfinite_window"), F.count_if(good).alias("valid_windows"), F.count_if(good & due & ~has).alias("unscorable_label"), F.count_if(good & due & has).alias("scored"))
