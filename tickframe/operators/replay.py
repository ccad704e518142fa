"""One streamed pass over a full order log: versions, books, queue entries, executions and segments of every message.

Stock-days run in parallel; the rows of one come in message order from the shuffle's sort and stream through a fold that holds
its live orders and levels only. A message costs what it changes: two levels at most, each found in a sorted list of prices, so the
depth of a book hardly matters.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_LEVEL = "array<struct<px:bigint,sz:bigint,orders:bigint>>"
_VERSION = ("side", "price", "volume", "priority", "priority_reset", "entered", "entered_reset")
_STATE = ("epoch", "barriers", "unpriced", "live_orders", "segment", "tick", "execution")
SCHEMA = f"symbol string, day string, event_index long, us long, action string, bids {_LEVEL}, asks {_LEVEL}, valid boolean, known boolean, " + ", ".join(f"{n} long" for n in (*_STATE, *[f"{v}_{c}" for v in ("new", "old") for c in _VERSION]))


class Depth:
    """Quantity and orders by price of one side, with the prices in order of rank (bids are kept by their negative)."""

    def __init__(self, sign: int):
        self.sign, self.cells, self.ranks = sign, {}, []

    def shift(self, price: int, quantity: int, orders: int) -> bool:
        """Adds to a level; a level without quantity is not shown. True if the visible levels may have changed."""
        key = self.sign * price
        before = self.cells.get(key, (0, 0))
        after = (before[0] + quantity, before[1] + orders)
        if after == (0, 0):
            self.cells.pop(key, None)
        else:
            self.cells[key] = after
        if not before[0] and after[0]:
            insort(self.ranks, key)
        elif before[0] and not after[0]:
            del self.ranks[bisect_left(self.ranks, key)]
        return bool(before[0] or after[0])

    def top(self, levels: int) -> list[tuple[int, int, int]]:
        cells, sign = self.cells, self.sign
        return [(sign * key, *cells[key]) for key in self.ranks[:levels]]


class _StockDay:
    def __init__(self, levels: int):
        self.levels, self.epoch, self.barriers, self.segment, self.run, self.tick = levels, 0, 0, 0, False, None
        self.clear()

    def clear(self) -> None:
        self.orders: dict[tuple, tuple] = {}
        self.sides = {1: Depth(-1), 2: Depth(1)}
        self.tops, self.stale, self.unpriced = {1: [], 2: []}, {1: False, 2: False}, 0

    def place(self, version: tuple, count: int) -> None:
        side, price, volume = version[:3]
        if side not in self.sides:
            return
        if price is None or price <= 0:
            self.unpriced += count
        elif self.sides[side].shift(price, count * (volume or 0), count):
            self.stale[side] = True

    def apply(self, index: int, us: int, action: str, key: tuple, side: int, price: int, volume: int, priority: int) -> tuple:
        """The order's version before and after the message, whether it was known, and what the message executes."""
        if action in ("F", "Y"):
            self.barriers += 1
        if action == "F":
            self.epoch += 1
            self.clear()
            return None, None, None, 0
        old = self.orders.pop(key, None)
        if old is not None:
            self.place(old, -1)
        if action == "D":
            return old, None, old is not None, old[2] if old is not None else 0
        former = old or (None,) * 7
        now = tuple(f if x == -1 else x for x, f in zip((2 if side == 5 else side, price, volume), former, strict=False))
        moved = old is None or now[:2] != old[:2]
        queued = []
        for place, again in ((0, moved), (1, moved or action == "M")):
            before, entered = former[3 + place], former[5 + place]
            rank = priority if priority != -1 else us if again else before
            joins = moved or priority != before if priority != -1 else again
            queued.append((rank, index if joins else entered))
        new = (*now, queued[0][0], queued[1][0], queued[0][1], queued[1][1])
        self.orders[key] = new
        self.place(new, 1)
        executes = action == "M" and not moved and old is not None and old[2] is not None
        return old, new, old is not None, max(0, old[2] - now[2]) if executes else 0

    def view(self) -> tuple[list, list]:
        for side, stale in self.stale.items():
            if stale:
                self.tops[side] = self.sides[side].top(self.levels)
                self.stale[side] = False
        return self.tops[1], self.tops[2]

    def valid(self, bids: list, asks: list, open_: bool) -> bool:
        """True for a whole book; also counts segments (runs of valid messages) and the smallest gap between levels so far."""
        good = open_ and not self.unpriced and len(bids) == self.levels and len(asks) == self.levels and bids[0][0] < asks[0][0]
        if good:
            self.segment += not self.run
            for top in (bids, asks):
                for a, b in zip(top, top[1:], strict=False):
                    gap = abs(a[0] - b[0])
                    if self.tick is None or gap < self.tick:
                        self.tick = gap
        self.run = good
        return good


def _nested(rows: list[list[tuple[int, int, int]]], kind: pa.DataType) -> pa.Array:
    flat = np.array([x for row in rows for level in row for x in level], np.int64).reshape(-1, 3)
    parts = pa.StructArray.from_arrays([pa.array(flat[:, i]) for i in range(3)], ["px", "sz", "orders"])
    offsets = np.concatenate([[0], np.cumsum(np.fromiter(map(len, rows), np.int64, len(rows)))]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), parts).cast(kind)


def _fold(levels: int) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    level = pa.list_(pa.struct([("px", pa.int64()), ("sz", pa.int64()), ("orders", pa.int64())]))
    empty = (None,) * len(_VERSION)

    def fold(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, book = None, None
        for batch in batches:
            bids_out, asks_out, flags, states = [], [], [], []
            names = ("symbol", "day", "event_index", "us", "action", "order_date", "order_id", "side", "price", "volume", "priority", "open")
            for symbol, day, index, us, action, date, order, side, price, volume, priority, open_ in zip(*(batch.column(n).to_pylist() for n in names), strict=True):
                if (symbol, day) != at:
                    at, book = (symbol, day), _StockDay(levels)
                old, new, known, executed = book.apply(index, us, action, (date, order), side, price, volume, priority)
                bids, asks = book.view()
                valid = book.valid(bids, asks, open_)
                bids_out.append(bids)
                asks_out.append(asks)
                flags.append((valid, known))
                states.append((book.epoch, book.barriers, book.unpriced, len(book.orders), book.segment, book.tick, executed, *(new or empty), *(old or empty)))
            if not states:
                continue
            columns = [batch.column(n) for n in names[:5]] + [_nested(x, level) for x in (bids_out, asks_out)]
            columns += [pa.array(x, pa.bool_()) for x in zip(*flags, strict=True)] + [pa.array(x, pa.int64()) for x in zip(*states, strict=True)]
            yield pa.RecordBatch.from_arrays(columns, [x.split()[0] for x in SCHEMA.split(", ")])

    return fold


def in_session(zone: str | None, opens: str = "10:00", closes: str = "16:00") -> Column:
    """Whether `us` lies in the session's local hours; without a zone, always."""
    if zone is None:
        return F.lit(True)
    clock = F.date_format(F.from_utc_timestamp(F.timestamp_micros("us"), zone), "HH:mm")
    return (clock >= opens) & (clock < closes)


def replay_orders(log: DataFrame, levels: int = 10, zone: str | None = None, opens: str = "10:00", closes: str = "16:00") -> DataFrame:
    """Every message of the log with the book and the order's versions after and before it, in one shuffle and one sort.

    bids, asks (best first, `levels` at most), epoch, barriers (messages F or Y so far), unpriced and live orders; valid: no
    unpriced order, `levels` levels a side, neither locked nor crossed, in session. segment counts the runs of valid messages, tick
    is the smallest gap of neighbouring levels that valid messages of the day showed so far. new_ and old_ hold side, price,
    volume, priority and the message at which the order joined its queue; the `_reset` forms are those where a change without a
    reported priority loses its place. execution: all of a deleted order, and what an M at one side and price removes.
    An order is one of its order_date (if the log has it) and order_id.
    """
    date = F.col("order_date").cast("string") if "order_date" in log.columns else F.lit("")
    longs = [F.col(c).cast("long").alias(c) for c in ("side", "price", "volume", "priority")]
    rows = log.select("symbol", "day", F.col("event_index").cast("long").alias("event_index"), F.col("us").cast("long").alias("us"), "action", date.alias("order_date"), F.col("order_id"), *longs, in_session(zone, opens, closes).alias("open"))
    return rows.repartition("symbol", "day").sortWithinPartitions("symbol", "day", "event_index").mapInArrow(_fold(levels), SCHEMA)


FEED = "receive_index long, epoch long, best_bid double, bid_size double, best_ask double, ask_size double, bid_levels long, ask_levels long"


class FeedBook:
    """Sizes by price of both sides of a feed, with the prices in order of rank (bids are kept by their negative)."""

    def __init__(self) -> None:
        self.epoch, self.sizes, self.ranks = 0, {"bid": {}, "ask": {}}, {"bid": [], "ask": []}

    def begin(self) -> None:
        self.epoch, self.sizes, self.ranks = self.epoch + 1, {"bid": {}, "ask": {}}, {"bid": [], "ask": []}

    def put(self, side: str, price: float, size: float) -> None:
        key, sizes, ranks = -price if side == "bid" else price, self.sizes[side], self.ranks[side]
        if size:
            if price not in sizes:
                insort(ranks, key)
            sizes[price] = size
        elif sizes.pop(price, None) is not None:
            del ranks[bisect_left(ranks, key)]

    def best(self) -> tuple[float | None, float | None]:
        bids, asks = self.ranks["bid"], self.ranks["ask"]
        return -bids[0] if bids else None, asks[0] if asks else None

    def row(self, index: int) -> tuple:
        bid, ask = (abs(self.ranks[s][0]) if self.ranks[s] else None for s in ("bid", "ask"))
        if bid is not None and ask is not None and bid >= ask:
            raise ValueError(f"crossed book at {index}")
        return index, self.epoch, bid, self.sizes["bid"].get(bid), ask, self.sizes["ask"].get(ask), len(self.ranks["bid"]), len(self.ranks["ask"])


def replay_feed(levels: DataFrame, key: str, strict: bool) -> DataFrame:
    """The book after each whole feed message, products in parallel, by a stream that holds a product's live levels only."""

    def fold(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        product, index, kind, book = None, None, None, FeedBook()
        keys, rows = [], []

        def end() -> None:
            if index is not None and book.epoch:
                keys.append(product)
                rows.append(book.row(index))

        def out() -> pa.RecordBatch:
            types = [pa.int64(), pa.int64(), *[pa.float64()] * 4, pa.int64(), pa.int64()]
            columns = [pa.array(x, t) for x, t in zip(zip(*rows, strict=True) if rows else [()] * 8, types, strict=True)]
            return pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), *columns], [key, *[x.split()[0] for x in FEED.split(", ")]])

        for batch in batches:
            for own, at, type_, side, price, size in zip(*(batch.column(n).to_pylist() for n in (key, "receive_index", "type", "side", "price", "size")), strict=True):
                if own != product or at != index:
                    end()
                    if own != product:
                        product, book = own, FeedBook()
                    index, kind = at, type_
                    if type_ == "snapshot":
                        book.begin()
                    elif not book.epoch and strict:
                        raise ValueError("update before snapshot")
                if type_ != kind:
                    raise ValueError("a message of mixed types")
                if book.epoch:
                    if size < 0:
                        raise ValueError("negative size")
                    book.put(side, price, size)
            if rows:
                yield out()
                keys, rows = [], []
        end()
        yield out()

    rows = levels.select(F.col(key).cast("string").alias(key), F.col("receive_index").cast("long").alias("receive_index"), "change_index", "type", "side", F.col("price").cast("double").alias("price"), F.col("size").cast("double").alias("size"))
    return rows.repartition(key).sortWithinPartitions(key, "receive_index", "change_index").mapInArrow(fold, f"{key} string, {FEED}")
