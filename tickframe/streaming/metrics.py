"""Streaming forms: feed lines as level rows, and counts in tumbling windows."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tickframe.sources import feed
from tickframe.sources.tables import work_folder


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as a stream of its files."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)


def level_stream(events: DataFrame) -> DataFrame:
    """Level rows of the feed, as they come; nothing is held back or dropped."""
    lines = feed.event_lines(events)
    return feed.level_rows(feed.parse(lines))


def minute_counts(events: DataFrame, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Messages, errors and distinct-by-id rows in tumbling windows; a window is out once the watermark has passed it."""
    timed = events.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", late).dropDuplicatesWithinWatermark(["event_id"])
    counts = timed.groupBy(F.window("at", window).alias("w")).agg(F.count("*").alias("messages"), F.count_if(F.col("event_type") == "error").alias("errors"))
    return counts.select(F.unix_micros("w.start").alias("start_us"), "messages", "errors")


#: Rows of a micro-batch, which bound what a task of a stream holds at once, whatever the length of the stream.
BATCH = 1_000_000


def stream_in_files(rows: DataFrame, part: str, parts: int) -> DataFrame:
    """`rows` as a stream of `parts` micro-batches: one file each, in the order of the column `part` (0 to parts - 1).

    The rows are computed once, by all tasks, into a folder a part; only then is each part made one file, in turn, as a stream
    takes files by their age.
    """
    spark = rows.sparkSession
    staged, folder = work_folder(spark, "parts"), work_folder(spark, "files")
    rows.write.partitionBy(part).parquet(staged)
    dealt, names = spark.read.schema(rows.schema).parquet(staged), [c for c in rows.columns if c != part]
    for i in range(parts):
        dealt.where(F.col(part) == i).select(*names).coalesce(1).write.parquet(f"{folder}/{i}")
    return spark.readStream.schema(rows.drop(part).schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/*")


def edges(rows: DataFrame, order: Column, least: int = 1) -> list:
    """Bounds that cut `rows` by ranges of `order` into at least `least` parts of about BATCH rows; equal values stay together."""
    parts = max(least, -(-rows.count() // BATCH))
    if parts == 1:
        return []
    shares = ", ".join(str(i / parts) for i in range(1, parts))
    return rows.select(order.alias("_o")).agg(F.expr(f"percentile_approx(_o, array({shares}))").alias("e")).first()["e"] or []


def part_of(order: Column, bounds: list) -> Column:
    """The part, from 0, of each row between the bounds."""
    return sum((F.when(order > bound, 1).otherwise(0) for bound in bounds), F.lit(0))


def in_batches(rows: DataFrame, order: str) -> DataFrame:
    """`rows` as a stream of micro-batches of about BATCH rows, in the order of a column."""
    bounds = edges(rows, F.col(order))
    return stream_in_files(rows.withColumn("_part", part_of(F.col(order), bounds)), "_part", len(bounds) + 1)


def _sums(window_us: int) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def of(us: np.ndarray, size: np.ndarray, at: np.ndarray, middle: int) -> tuple[np.ndarray, np.ndarray]:
        """Sum and number of sizes in (at - window, at], as what the first half ends with and what the second one begins with."""
        low, split, high = us.searchsorted(at - window_us, "right"), us.searchsorted(middle), us.searchsorted(at, "right")
        before = np.concatenate([np.cumsum(size[:split][::-1])[::-1], [0.0]])
        after = np.concatenate([[0.0], np.cumsum(size[split:])])
        return before[low] + after[high - split], high - low

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                rows = batch.column("rows").slice(i, 1).flatten()
                asked, us = (rows.field(n).to_numpy(zero_copy_only=False) for n in ("asked", "us"))
                size, buys = rows.field("size").fill_null(0.0).to_numpy(), pc.equal(rows.field("side"), "buy").fill_null(False).to_numpy(zero_copy_only=False)
                sells = pc.equal(rows.field("side"), "sell").fill_null(False).to_numpy(zero_copy_only=False)
                order = np.argsort(us, kind="stable")
                trades = order[~asked[order]]
                at, middle = us[asked], batch.column("middle")[i].as_py()
                sums = [of(us[trades], np.where(side, size, 0.0)[trades], at, middle) for side in (buys, sells)]
                ids = rows.field("event_id").filter(rows.field("asked"))
                symbol = pa.array([batch.column("symbol")[i].as_py()] * len(at), pa.string())
                yield pa.RecordBatch.from_arrays([symbol, pa.array(at), ids, *[pa.array(x) for x, _ in sums], pa.array(sums[0][1], pa.int64())], ["symbol", "us", "event_id", "buy_size", "sell_size", "n_trades"])

    return run


def recent_trades(decisions: DataFrame, trades: DataFrame, window_us: int, late: str) -> DataFrame:
    """Buy and sell size of the trades in the `window_us` up to each decision (symbol, at, event_id), from two streams.

    Both streams have watermarks and meet in sliding windows of two stretches of time: a decision in the later stretch of one, a
    trade in both. A window is given out, and its state dropped, once neither stream can add to it. Its rows are then summed in
    order of time, so the work is linear in rows, however many trades a stretch has. Trades come as symbol, at, side, size.
    """
    asked = decisions.withWatermark("at", late).select("symbol", "at", "event_id", F.lit(None).cast("string").alias("side"), F.lit(None).cast("double").alias("size"), F.lit(True).alias("asked"))
    made = trades.withWatermark("at", late).select("symbol", "at", F.lit(None).cast("long").alias("event_id"), "side", "size", F.lit(False).alias("asked"))
    middle = F.unix_micros("w.start") + window_us
    placed = asked.union(made).withColumn("w", F.window("at", f"{2 * window_us} microseconds", f"{window_us} microseconds")).where(~F.col("asked") | (F.unix_micros("at") >= middle))
    met = placed.groupBy("symbol", "w").agg(F.collect_list(F.struct("asked", F.unix_micros("at").alias("us"), "event_id", "side", "size")).alias("rows"))
    summed = met.select("symbol", middle.alias("middle"), "rows").mapInArrow(_sums(window_us), "symbol string, us long, event_id long, buy_size double, sell_size double, n_trades long")
    return summed.select("symbol", F.timestamp_micros("us").alias("at"), "event_id", "buy_size", "sell_size", "n_trades")


def run_to_table(stream: DataFrame) -> DataFrame:
    """Everything that the stream has now, written as Parquet with its own checkpoint to the shared folder, and read back.

    State is dealt over one partition a core: each costs a task, and a stateful processor's Python worker, in every micro-batch.
    """
    spark = stream.sparkSession
    folder = work_folder(spark, "stream")
    writer = stream.writeStream.format("parquet").outputMode("append").option("path", f"{folder}/rows").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True)
    former = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(spark.sparkContext.defaultParallelism))
    try:
        query = writer.start()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", former)
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/rows")
