"""Book state from logs of level changes and order messages."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

_REPLAYED = "symbol string, day string, seq long, best_bid long, bid_size long, best_ask long, ask_size long, bid_levels long, ask_levels long"


class _Book:
    """Live levels of one stock-day with the best price of each side kept by a heap from which dead prices are dropped late."""

    def __init__(self) -> None:
        self.bids: dict[int, int] = {}
        self.asks: dict[int, int] = {}
        self.best: tuple[list[int], list[int]] = ([], [])
        self.last: int | None = None

    def top(self, side: int) -> int | None:
        heap, live, sign = self.best[side], (self.bids, self.asks)[side], (-1, 1)[side]
        while heap and sign * heap[0] not in live:
            heapq.heappop(heap)
        return sign * heap[0] if heap else None


def _replay(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    key, book = None, _Book()
    for batch in batches:
        out: list[tuple] = []
        add = out.append
        for symbol, day, seq, side, px, sz in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if (symbol, day) != key:
                key, book = (symbol, day), _Book()
                bids, asks, best, top = book.bids, book.asks, book.best, book.top
                bid = ask = None
            if book.last is not None and seq != book.last + 1:
                raise ValueError(f"{key}: sequence {seq} follows {book.last}")
            if sz < 0:
                raise ValueError(f"{key}: negative size at {seq}")
            book.last = seq
            at = side != "bid"
            live = asks if at else bids
            if sz:
                if px not in live:
                    heapq.heappush(best[at], px if at else -px)
                live[px] = sz
            else:
                live.pop(px, None)
            if at:
                ask = top(1)
            else:
                bid = top(0)
            if bid is not None and ask is not None and bid >= ask:
                raise ValueError(f"{key}: crossed book at {seq}")
            add((bid, bids.get(bid), ask, asks.get(ask), len(bids), len(asks)))
        columns = zip(*out, strict=True) if out else [()] * 6
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], *[pa.array(c, pa.int64()) for c in columns]], ["symbol", "day", "seq", "best_bid", "bid_size", "best_ask", "ask_size", "bid_levels", "ask_levels"])


def replay_levels(deltas: DataFrame) -> DataFrame:
    """symbol, day, seq with best bid and ask, their sizes and level counts after each level change (size 0 removes).

    Stocks and days replay in parallel. Inside one, rows come in sequence order from the shuffle's sort and stream through
    a fold that holds the live levels only, so a day of any length fits. The best price costs a heap step a message, however
    many levels a book has. A gap in seq or a crossed book is an error.
    """
    ordered = deltas.repartition("symbol", "day").sortWithinPartitions("symbol", "day", "seq")
    longs = [F.col(c).cast("long").alias(c) for c in ("px", "sz")]
    return ordered.select("symbol", "day", F.col("seq").cast("long").alias("seq"), "side", *longs).mapInArrow(_replay, _REPLAYED)


def order_versions(messages: DataFrame) -> DataFrame:
    """Adds the filled-in price and volume of each message's order, and those before it (NULL for a new order).

    -1 keeps the former value. An order's life ends with its deletion (action D), so a later A starts another one.
    """
    life = Window.partitionBy("symbol", "day", "epoch", "order_id").orderBy("event_index")
    lives = messages.withColumn("life", F.coalesce(F.sum((F.col("action") == "D").cast("long")).over(life.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    own = Window.partitionBy("symbol", "day", "epoch", "order_id", "life").orderBy("event_index")
    kept = lambda c: F.last(F.when(F.col(c) != -1, F.col(c)), ignorenulls=True).over(own.rowsBetween(Window.unboundedPreceding, 0))
    filled = lives.withColumns({"price_now": kept("price"), "volume_now": kept("volume")})
    return filled.withColumns({"price_before": F.lag("price_now").over(own), "volume_before": F.lag("volume_now").over(own)})


def level_quantities(messages: DataFrame) -> DataFrame:
    """symbol, day, epoch, event_index, side, price, quantity: a level's quantity after each message that touches it."""
    v = order_versions(messages)
    key = ["symbol", "day", "epoch", "event_index", "side"]
    new = v.where("action <> 'D'").select(*key, F.col("price_now").alias("price"), F.col("volume_now").alias("change"))
    old = v.where("price_before IS NOT NULL").select(*key, F.col("price_before").alias("price"), (-F.col("volume_before")).alias("change"))
    net = new.union(old).groupBy(*key, "price").agg(F.sum("change").alias("change"))
    so_far = Window.partitionBy("symbol", "day", "epoch", "side", "price").orderBy("event_index").rowsBetween(Window.unboundedPreceding, 0)
    return net.select(*key, "price", F.sum("change").over(so_far).alias("quantity"))


def live_orders(messages: DataFrame) -> DataFrame:
    """Orders in the book after each message: an A adds one, a Y where its order is not in the book, a D takes one away."""
    life = Window.partitionBy("symbol", "day", "epoch", "order_id").orderBy("event_index")
    known = F.coalesce(F.lag("action").over(life) != "D", F.lit(False))
    change = F.when((F.col("action") == "A") | ((F.col("action") == "Y") & ~known), 1).when(F.col("action") == "D", -1).otherwise(0)
    w = Window.partitionBy("symbol", "day", "epoch").orderBy("event_index").rowsBetween(Window.unboundedPreceding, 0)
    return messages.withColumn("_change", change).select("symbol", "day", "epoch", "event_index", F.sum("_change").over(w).alias("live_orders"))
