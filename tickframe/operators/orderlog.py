"""Books and queues from full order logs: what needs the whole book by one streamed pass (`replay`), orders' lives by windows.

A log has symbol, day, event_index (every message of the day, from 0), us, order_id, action (F empties the book, A adds, Y adds
or replaces, M changes, D deletes), side (1 bid, 2 or 5 ask), price, volume and priority; -1 keeps the former value. An order
with a price of 0 or below is unpriced. With an order_date, an order is one of its date and id.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickframe.operators.replay import in_session, replay_feed, replay_orders

DAY = ("symbol", "day")


def order_key(log: DataFrame) -> tuple[str, ...]:
    return ("order_date", "order_id") if "order_date" in log.columns else ("order_id",)


def _so_far(*keys: str):
    return Window.partitionBy(*keys).orderBy("event_index").rowsBetween(Window.unboundedPreceding, 0)


def with_epochs(log: DataFrame) -> DataFrame:
    """Adds epoch (times that the book was emptied so far that day) and barriers (messages of kind F or Y so far)."""
    w = _so_far(*DAY)
    return log.withColumns({"epoch": F.count_if(F.col("action") == "F").over(w), "barriers": F.count_if(F.col("action").isin("F", "Y")).over(w)})


def versions(log: DataFrame) -> DataFrame:
    """Every message but F with its order's side, price and volume (new_) and those before it (old_, NULL for a new order).

    An order's life ends with its deletion; a deletion has no new version. `known` tells if the order was in the book.
    """
    rows = (log if "epoch" in log.columns else with_epochs(log)).where("action <> 'F'").withColumn("side", F.when(F.col("side") == 5, 2).otherwise(F.col("side")))
    order = ("symbol", "day", "epoch", *order_key(log))
    earlier = Window.partitionBy(*order).orderBy("event_index").rowsBetween(Window.unboundedPreceding, -1)
    lives = rows.withColumn("life", F.count_if(F.col("action") == "D").over(earlier))
    life = Window.partitionBy(*order, "life").orderBy("event_index")
    kept = lambda c: F.last(F.when(F.col(c) != -1, F.col(c)), ignorenulls=True).over(life.rowsBetween(Window.unboundedPreceding, 0))
    filled = lives.withColumns({f"new_{c}": kept(c) for c in ("side", "price", "volume")}).withColumn("known", F.row_number().over(life) > 1)
    filled = filled.withColumns({f"old_{c}": F.lag(f"new_{c}").over(life) for c in ("side", "price", "volume")})
    return filled.withColumns({f"new_{c}": F.when(F.col("action") != "D", F.col(f"new_{c}")) for c in ("side", "price", "volume")})


def order_problems(log: DataFrame) -> DataFrame:
    """Violations of the log's rules: symbol, day, event_index, problem. One sort, and a pass that holds a day's live orders and
    level quantities."""
    longs = [F.col(c).cast("long").alias(c) for c in ("event_index", "us", "side", "price", "volume")]
    rows = log.select(*DAY, "action", F.concat_ws(":", *order_key(log)).alias("order"), *longs)
    return rows.repartition(*DAY).sortWithinPartitions(*DAY, "event_index").mapInArrow(_problems, "symbol string, day string, event_index long, problem string")


def _problems(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    at, names = None, ("symbol", "day", "event_index", "us", "action", "order", "side", "price", "volume")
    for batch in batches:
        found = []
        for symbol, day, index, us, action, order, *given in zip(*(batch.column(n).to_pylist() for n in names), strict=True):
            problems = []
            if (symbol, day) != at:
                at, former, orders, depth = (symbol, day), None, {}, {}
                if action not in ("F", None):
                    problems.append("day does not begin with F")
            if us is not None and former is not None and us < former:
                problems.append("time goes back")
            former = us
            if action == "F":
                orders, depth = {}, {}
            elif action is not None:
                old = orders.pop(order, None)
                given[0] = 2 if given[0] == 5 else given[0]
                new = None if action == "D" else tuple(x if x not in (-1, None) else y for x, y in zip(given, old or (None,) * 3, strict=True))
                if new is not None:
                    orders[order] = new
                problems.append(_broken(action, old is not None, new))
                touched = {}
                for version, sign in ((new, 1), (old, -1)):
                    if version is not None and version[1] is not None and version[1] > 0:
                        touched[version[:2]] = depth[version[:2]] = depth.get(version[:2], 0) + sign * (version[2] or 0)
                problems += ["negative depth" for level in touched if depth[level] < 0]
            found += [(symbol, day, index, p) for p in problems if p is not None]
        columns = list(zip(*found, strict=True)) or [()] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.string(), pa.int64(), pa.string()), strict=True)], ["symbol", "day", "event_index", "problem"])


def _broken(action: str, known: bool, new: tuple | None) -> str | None:
    if action not in ("A", "Y", "M", "D"):
        return "unknown action"
    if action == "A" and known:
        return "duplicate add"
    if action in ("M", "D") and not known:
        return "unknown order"
    return "invalid side or volume" if new is not None and (new[0] not in (1, 2) or new[2] is None or new[2] < 0) else None


def level_states(v: DataFrame) -> DataFrame:
    """Each change of a level: symbol, day, epoch, side, price, event_index, quantity and orders after it, and `until`, the index
    of the next change (NULL for none in the epoch)."""
    key = [*DAY, "epoch", "event_index"]
    part = lambda side, sign: v.where(f"{side}_price > 0").select(*key, F.col(f"{side}_side").alias("side"), F.col(f"{side}_price").alias("price"), (F.col(f"{side}_volume") * sign).alias("change"), F.lit(sign).alias("count"))
    net = part("new", 1).union(part("old", -1)).groupBy(*key, "side", "price").agg(F.sum("change").alias("change"), F.sum("count").alias("count"))
    level = Window.partitionBy(*DAY, "epoch", "side", "price").orderBy("event_index")
    w = level.rowsBetween(Window.unboundedPreceding, 0)
    return net.select(*key, "side", "price", F.sum("change").over(w).alias("quantity"), F.sum("count").over(w).alias("orders"), F.lead("event_index").over(level).alias("until"))


def books(log: DataFrame, levels: int = 10) -> DataFrame:
    """One row per message: bids and asks (best first, `levels` at most, structs of px, sz, orders), unpriced orders, epoch
    and barriers."""
    return replay_orders(log, levels).select(*DAY, "event_index", "us", "action", "epoch", "barriers", "bids", "asks", "unpriced")


def book_states(log: DataFrame, levels: int = 1 << 20) -> DataFrame:
    """A SHA-256 of the book after each message (all levels up to `levels` a side with quantity and orders, and the number of
    unpriced orders), with the levels that it covers."""
    side = lambda c: F.array_join(F.transform(c, lambda x: F.concat_ws(":", x["px"], x["sz"], x["orders"])), ",")
    rows = books(log, levels)
    return rows.withColumns({"bid_levels": F.size("bids"), "ask_levels": F.size("asks"), "state": F.sha2(F.concat_ws("|", side("bids"), side("asks"), "unpriced"), 256)})


def snapshots(log: DataFrame, levels: int = 10, zone: str | None = None, opens: str = "10:00", closes: str = "16:00") -> DataFrame:
    """Valid books of a day by segments, with the smallest gap of neighbouring levels so far (`tick`)."""
    return replay_orders(log, levels, zone, opens, closes).where("valid").select(*DAY, "event_index", "us", "barriers", "bids", "asks", "segment", "tick")


def day_audit(log: DataFrame, levels: int, zone: str, opens: str = "10:00", closes: str = "16:00") -> DataFrame:
    """Per day: messages of each kind, those outside the session, invalid books, snapshots and segments; one pass."""
    rows = replay_orders(log, levels, zone, opens, closes)
    kinds = [F.count_if(F.col("action") == a).alias(f"n_{a.lower()}") for a in "FAYMD"]
    counts = rows.groupBy(*DAY).agg(F.count("*").alias("source_rows"), *kinds, F.count_if(~in_session(zone, opens, closes)).alias("outside_window"), F.count_if("valid").alias("snapshot_rows"), F.max("segment").alias("segments"))
    return counts.withColumn("invalid_book", F.col("source_rows") - F.col("outside_window") - F.col("snapshot_rows"))


def queue_orders(log: DataFrame, reset: bool = False) -> DataFrame:
    """Versions with the order's priority and `entered`, the message at which it last joined a queue; old_ are those before.

    A reported priority counts; else the former one, or the message's time where the order is new or moved, or is changed
    without a report under `reset`. A report that differs from the former priority joins anew, too.
    """
    v = versions(log)
    life = Window.partitionBy("symbol", "day", "epoch", *order_key(log), "life").orderBy("event_index")
    so_far = life.rowsBetween(Window.unboundedPreceding, 0)
    moved = ~F.col("known") | ~F.col("new_side").eqNullSafe(F.col("old_side")) | ~F.col("new_price").eqNullSafe(F.col("old_price"))
    again = moved | ((F.col("action") == "M") & F.lit(reset))
    reported = F.col("priority") != -1
    placed = v.withColumns({"new_priority": F.last(F.when(reported, F.col("priority")).when(again, F.col("us")), ignorenulls=True).over(so_far)})
    placed = placed.withColumn("old_priority", F.lag("new_priority").over(life))
    joins = F.when(reported, moved | (F.col("priority") != F.col("old_priority"))).otherwise(again)
    entered = placed.withColumn("new_entered", F.last(F.when(F.coalesce(joins, F.lit(True)), F.col("event_index")), ignorenulls=True).over(so_far))
    return entered.withColumn("old_entered", F.lag("new_entered").over(life))


def event_rows(log: DataFrame, levels: int = 10, zone: str | None = None, opens: str = "10:00", closes: str = "16:00") -> DataFrame:
    """One row per message: best quotes with sizes and order counts, validity, segment, barriers and tick, live orders, the
    order's version before and after, and the quantity that the message executes (a Y executes nothing)."""
    rows = replay_orders(log, levels, zone, opens, closes)
    best = [F.get(f"{s}s", F.lit(0))[c].alias(f"{s}_{n}") for s in ("bid", "ask") for c, n in (("px", "px"), ("sz", "size"), ("orders", "orders"))]
    return rows.select(*DAY, "event_index", "us", "barriers", *best, "valid", "segment", "tick", "live_orders", *[f"{v}_{c}" for v in ("new", "old") for c in ("side", "price", "volume", "priority", "priority_reset", "entered", "entered_reset")], "execution")


def queue_parity(log: DataFrame) -> DataFrame:
    """Levels at the end of each day whose queues do not add up to their depth (none, if both replays are right)."""
    v = queue_orders(log)
    last = v.groupBy(*DAY).agg(F.max("epoch").alias("epoch"))
    newest = Window.partitionBy(*DAY, "epoch", *order_key(log)).orderBy(F.desc("event_index"))
    alive = v.join(last, [*DAY, "epoch"]).withColumn("_n", F.row_number().over(newest)).where("_n = 1 AND action <> 'D' AND new_price > 0")
    queued = alive.groupBy(*DAY, F.col("new_side").alias("side"), F.col("new_price").alias("price")).agg(F.sum("new_volume").alias("queued"))
    depth = level_states(v).join(last, [*DAY, "epoch"]).where("until IS NULL AND quantity <> 0").select(*DAY, "side", "price", "quantity")
    both = depth.join(queued.where("queued <> 0"), [*DAY, "side", "price"], "full_outer")
    return both.where(~F.col("quantity").eqNullSafe(F.col("queued")))


def feed_books(levels: DataFrame, key: str = "product_id", strict: bool = True) -> DataFrame:
    """Best bid and ask with sizes and level counts after each feed message, from the level rows of snapshots and updates.

    A snapshot starts the book anew; a message counts as a whole, so of several changes of a level the last one holds. An
    update before the first snapshot is an error, or with strict=False is left out.
    """
    return replay_feed(levels, key, strict)


def record_problems(records: DataFrame, codes: Sequence[str], most_scale: int = 12) -> DataFrame:
    """Records with a kind that is none, a symbol that is not listed, or a price scale out of range."""
    scale: Column = F.col("price_level")
    problem = F.when(~F.col("action").isin(*"FAYMD"), "unknown action").when(~F.col("symbol").isin(*codes), "unknown symbol").when((scale < 0) | (scale > most_scale), "price scale")
    return records.withColumn("problem", problem).where("problem IS NOT NULL")
