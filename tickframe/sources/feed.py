"""Feed captures: JSON lines with level snapshots, level updates and matches, as level rows and trades.

Every function but `read_lines` works on batch and streaming DataFrames alike.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

FIELDS = "type string, product_id string, time string, sequence long, bids array<array<string>>, asks array<array<string>>, changes array<array<string>>, trade_id long, price string, size string, side string"
_NAMES = [f.strip().split(" ")[0] for f in FIELDS.split(", ")]


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(value, receive_index): non-blank lines and their 1-based position over all files in path order.

    A file block is read by one task in order, so a line's position is its distance from the block's first line plus the
    lines of the blocks before. Only the table of blocks is sorted; the lines are not shuffled.
    """
    lines = spark.read.text(path).where("trim(value) <> ''").select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("id"))
    blocks = lines.groupBy("file", "block").agg(F.min("id").alias("first"), F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("file", "block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = blocks.select("file", "block", "first", before.alias("before"))
    return lines.join(starts, ["file", "block"]).select("value", (F.col("id") - F.col("first") + F.col("before") + 1).alias("receive_index"))


def parse(lines: DataFrame) -> DataFrame:
    """Messages out of their capture envelope, which is optional; local_ts falls back to the message's time."""
    row = lines.withColumn("r", F.from_json("value", f"{FIELDS}, local_ts string, message struct<{FIELDS}>"))
    bare = F.struct(*[F.col(f"r.{n}").alias(n) for n in _NAMES])
    unwrapped = row.withColumn("m", F.coalesce("r.message", bare))
    return unwrapped.select("receive_index", F.coalesce("r.local_ts", "m.time").alias("local_ts"), "m.*")


def level_rows(messages: DataFrame) -> DataFrame:
    """One row per level of a snapshot (bids, then asks) or change of an update; change_index counts from 1."""
    of = lambda side, c: F.transform(F.coalesce(F.col(c), F.array().cast("array<array<string>>")), lambda x: F.struct(F.lit(side).alias("side"), x[0].alias("price"), x[1].alias("size")))
    changed = F.transform("changes", lambda x: F.struct(F.when(x[0] == "buy", "bid").otherwise("ask").alias("side"), x[1].alias("price"), x[2].alias("size")))
    rows = F.when(F.col("type") == "snapshot", F.concat(of("bid", "bids"), of("ask", "asks"))).when(F.col("type") == "l2update", changed)
    found = messages.where("type IN ('snapshot', 'l2update')").select("receive_index", "local_ts", "product_id", "sequence", "type", F.posexplode(rows).alias("pos", "level"))
    return found.select("receive_index", "local_ts", "product_id", "sequence", "type", (F.col("pos") + 1).alias("change_index"), "level.side", F.col("level.price").cast("double").alias("price"), F.col("level.size").cast("double").alias("size"))


def trade_rows(messages: DataFrame) -> DataFrame:
    """One row per match; the aggressor is on the other side of the maker, NULL and sign 0 for an unknown side."""
    aggressor = F.when(F.col("side") == "sell", "buy").when(F.col("side") == "buy", "sell")
    sign = F.when(F.col("side") == "sell", 1).when(F.col("side") == "buy", -1).otherwise(0)
    return messages.where("type = 'match'").select("receive_index", "local_ts", "product_id", "trade_id", F.col("price").cast("double").alias("price"), F.col("size").cast("double").alias("size"), aggressor.alias("aggressor"), sign.alias("trade_sign"))


def event_lines(events: DataFrame) -> DataFrame:
    """A feed capture derived from the events table: (value, receive_index), every second message in an envelope."""
    text = lambda e: F.expr(e).cast("string")
    kind = F.expr("CASE event_id % 5 WHEN 0 THEN 'snapshot' WHEN 3 THEN 'match' WHEN 4 THEN 'heartbeat' ELSE 'l2update' END")
    bids = F.array(F.array(text("100 - event_id % 4"), text("1 + event_id % 7")), F.array(text("95 - event_id % 4"), text("2 + event_id % 7")))
    asks = F.array(F.array(text("101 + event_id % 4"), text("1 + event_id % 3")), F.array(text("106 + event_id % 4"), text("2 + event_id % 3")))
    changes = F.array(F.array(F.lit("buy"), text("99 - event_id % 3"), text("event_id % 6")), F.array(F.lit("sell"), text("102 + event_id % 3"), text("event_id % 8")))
    message = F.struct(
        kind.alias("type"), F.concat(F.lit("S"), text("user_id % 5")).alias("product_id"), F.col("ts").cast("string").alias("time"), F.col("event_id").alias("sequence"),
        F.when(kind == "snapshot", bids).alias("bids"), F.when(kind == "snapshot", asks).alias("asks"), F.when(kind == "l2update", changes).alias("changes"),
        F.when(kind == "match", F.col("event_id")).alias("trade_id"), F.when(kind == "match", text("100 + event_id % 3")).alias("price"), F.when(kind == "match", text("1 + event_id % 9")).alias("size"),
        F.when(kind == "match", F.expr("CASE user_id % 3 WHEN 0 THEN 'buy' WHEN 1 THEN 'sell' ELSE 'none' END")).alias("side"),
    )
    wrapped = F.to_json(F.struct(F.lit("here").alias("local_ts"), message.alias("message")))
    return events.select(F.when(F.col("event_id") % 2 == 0, wrapped).otherwise(F.to_json(message)).alias("value"), F.col("event_id").alias("receive_index"))
