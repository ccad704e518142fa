"""Order queues and book states at the end of a day, from order messages and level changes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickframe.operators.book import order_versions


def queue_entries(messages: DataFrame) -> DataFrame:
    """Order versions with `entered`: the event at which the order last joined a queue (added, or moved to another price)."""
    life = Window.partitionBy("symbol", "day", "epoch", "order_id", "life").orderBy("event_index").rowsBetween(Window.unboundedPreceding, 0)
    joined = F.when(F.col("price_before").isNull() | (F.col("price_now") != F.col("price_before")), F.col("event_index"))
    return order_versions(messages).withColumn("entered", F.last(joined, ignorenulls=True).over(life))


def final_queues(messages: DataFrame) -> DataFrame:
    """Orders that live at the end of a day: their place in the queue of their side and price, and the quantity ahead."""
    last = messages.groupBy("symbol", "day").agg(F.max("epoch").alias("epoch"))
    own = Window.partitionBy("symbol", "day", "order_id").orderBy(F.col("event_index").desc())
    newest = queue_entries(messages).join(last, ["symbol", "day", "epoch"]).withColumn("_n", F.row_number().over(own)).where("_n = 1 AND action <> 'D'")
    queue = Window.partitionBy("symbol", "day", "side", "price_now").orderBy("entered", "order_id")
    ahead = F.coalesce(F.sum("volume_now").over(queue.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return newest.select("symbol", "day", "side", F.col("price_now").alias("price"), "order_id", "entered", F.col("volume_now").alias("volume"), F.row_number().over(queue).alias("place"), ahead.alias("ahead"))


def executions(messages: DataFrame) -> DataFrame:
    """Quantity that each message takes out of the book: all of a deleted order, what a change at the same price removes."""
    gone = F.when(F.col("action") == "D", F.col("volume_before")).when(F.col("price_now") == F.col("price_before"), F.greatest(F.lit(0), F.col("volume_before") - F.col("volume_now"))).otherwise(0)
    return order_versions(messages).withColumn("executed", F.coalesce(gone, F.lit(0)))


def final_books(deltas: DataFrame) -> DataFrame:
    """Levels at the end of each day, and a digest of them that does not depend on the order of equal states."""
    newest = deltas.groupBy("symbol", "day", "side", "px").agg(F.max_by("sz", "seq").alias("sz")).where("sz > 0")
    level = F.concat_ws(":", "side", "px", "sz")
    return newest.groupBy("symbol", "day").agg(F.count("*").alias("levels"), F.sha2(F.concat_ws(",", F.array_sort(F.collect_list(level))), 256).alias("state"))


def day_counters(messages: DataFrame) -> DataFrame:
    """Messages of each kind a day, and the number of times that the book was cleared."""
    counts = [F.count_if(F.col("action") == a).alias(f"n_{a.lower()}") for a in ("A", "M", "D")]
    return messages.groupBy("symbol", "day").agg(F.count("*").alias("messages"), *counts, F.countDistinct("epoch").alias("epochs"))
