"""Keyed state over streams: books, orders, recent trades and pending markouts, one row out for each that comes in.

A key's rows of a micro-batch are put in order first. State is read once and written once a key and batch, whatever the number of
rows. A row that breaks the rules is given out with its problem instead of stopping the stream: a row behind the last one of an
earlier micro-batch is `late` and changes nothing, and a book that met a fault is not valid again before its next snapshot.
State ends by timers of event time (`ClockMarkouts`, `OrderVersions`) or by a time to live.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterable, Iterator
from itertools import groupby
from operator import itemgetter
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tickframe.operators.replay import FeedBook

STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


#: Rows that a processor turns into Python values, or gives out, at a time.
CHUNK = 100_000


def _in_order(rows: Iterable[pd.DataFrame], by: list[str], names: list[str]) -> Iterator[tuple]:
    """The named columns of a key's rows, in order, as tuples made a chunk at a time."""
    frame = pd.concat([r[names] for r in rows], ignore_index=True).sort_values(by, kind="stable")
    for start in range(0, len(frame), CHUNK):
        part = frame.iloc[start : start + CHUNK]
        yield from zip(*(part[n].tolist() for n in names), strict=True)


def _frame(rows: list[tuple], schema: str) -> pd.DataFrame:
    """Rows as columns that keep whole numbers whole beside NULLs."""
    kinds = {"long": "Int64", "int": "Int32", "double": "Float64", "boolean": "boolean", "string": "object"}
    columns = [x.split() for x in schema.split(", ")]
    frame = pd.DataFrame(rows, columns=[n for n, _ in columns], dtype=object)
    return frame.astype({n: kinds[k] for n, k in columns})


class Books(StatefulProcessor):
    """Level rows of feed messages to the best quotes after each message, or its problem."""

    OUT = "product_id string, receive_index long, best_bid double, bid_size double, best_ask double, ask_size double, problem string"

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.levels = handle.getMapState("levels", "side string, price double", "size double")
        self.last = handle.getValueState("last", "receive_index long, valid boolean, started boolean")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        before = {tuple(k): v[0] for k, v in self.levels.iterator()} if self.last.exists() else {}
        last, valid, started = self.last.get() if self.last.exists() else (-1, False, False)
        book, out = FeedBook(), []
        for (side, price), size in before.items():
            book.put(side, price, size)
        names = ["receive_index", "change_index", "type", "side", "price", "size"]
        for index, levels in groupby(_in_order(rows, names[:2], names), key=itemgetter(0)):
            message = list(levels)
            kinds, problem = {kind for _, _, kind, *_ in message}, None
            if index <= last:
                problem = "late"
            elif len(kinds) > 1:
                problem = "mixed types"
            elif "snapshot" in kinds:
                book, valid, started = FeedBook(), True, True
            elif not valid:
                problem = "no valid snapshot" if started else "before snapshot"
            if problem is None and any(size < 0 for *_, size in message):
                problem = "negative size"
            last = max(last, index)
            if problem is None:
                for _, _, _, side, price, size in message:
                    book.put(side, price, size)
            bid, ask = book.best()
            if problem is None and bid is not None and ask is not None and bid >= ask:
                problem = "crossed book"
            if problem is None:
                out.append((key[0], index, bid, book.sizes["bid"].get(bid), ask, book.sizes["ask"].get(ask), None))
            else:
                valid = valid and problem == "late"
                out.append((key[0], index, None, None, None, None, problem))
            if len(out) >= CHUNK:
                yield _frame(out, self.OUT)
                out = []
        after = {(side, price): size for side, sizes in book.sizes.items() for price, size in sizes.items()}
        for level in before.keys() - after.keys():
            self.levels.removeKey(level)
        for level, size in after.items():
            if before.get(level) != size:
                self.levels.updateValue(level, (size,))
        self.last.update((last, valid, started))
        yield _frame(out, self.OUT)

    def close(self) -> None:
        pass


_VERSION = ("side", "price", "volume", "priority", "entered")


class OrderVersions(StatefulProcessor):
    """Messages of a stock-day (F clears, A adds, Y adds or replaces, M changes, D deletes; -1 keeps a value) to the order's
    version before and after each, its execution, and the number of live orders. Messages of unknown orders and repeated adds
    are named as problems; they count as adds and changes, as in the batch form.

    Whole versions lie in a map by order. A day's state is dropped by a timer `linger_us` after the day's last message.
    """

    OUT = "symbol string, day string, event_index long, us long, " + ", ".join(f"{v}_{c} long" for v in ("old", "new") for c in _VERSION) + ", execution long, live_orders long, problem string"

    def __init__(self, linger_us: int):
        self.linger_us = linger_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.orders = handle.getMapState("orders", "order_date long, order_id long", ", ".join(f"{c} long" for c in _VERSION))
        self.last = handle.getValueState("last", "event_index long, us long, timer long")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        known = self.last.exists()
        before = {tuple(k): tuple(v) for k, v in self.orders.iterator()} if known else {}
        settled, newest, timer = self.last.get() if known else (-1, 0, 0)
        live, out, last = dict(before), [], settled
        names = ["event_index", "us", "order_date", "order_id", "action", "side", "price", "volume", "priority"]
        for index, us, date, order_id, action, *given, reported in _in_order(rows, ["event_index"], names):
            old = new = problem = None
            executed, order = 0, (date, order_id)
            if index <= settled:
                problem = "late"
            else:
                last, newest = index, max(newest, us)
                old = live.get(order)
                if action == "F":
                    live, old = {}, None
                elif action not in ("A", "Y", "M", "D"):
                    problem, old = "unknown action", None
                elif action == "D":
                    executed = live.pop(order)[2] if old is not None else 0
                else:
                    values = [former if x == -1 else x for x, former in zip((2 if given[0] == 5 else given[0], *given[1:]), old or (None,) * 3, strict=False)]
                    moved = old is None or tuple(values[:2]) != old[:2]
                    rank = reported if reported != -1 else us if moved else old[3]
                    joins = moved or (reported != -1 and reported != old[3])
                    new = live[order] = (*values, rank, index if joins else old[4])
                    executed = max(0, old[2] - new[2]) if action == "M" and not moved else 0
                if problem is None and action != "F":
                    problem = "unknown order" if action in ("M", "D") and old is None else "duplicate add" if action == "A" and old is not None else None
            empty = (None,) * len(_VERSION)
            out.append((*key, index, us, *(old or empty), *(new or empty), executed, None if problem == "late" else len(live), problem))
            if len(out) >= CHUNK:
                yield _frame(out, self.OUT)
                out = []
        for order in before.keys() - live.keys():
            self.orders.removeKey(order)
        for order, version in live.items():
            if before.get(order) != version:
                self.orders.updateValue(order, version)
        due = (newest + self.linger_us) // 1000 + 1
        if due != timer:
            if timer:
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(due)
        self.last.update((last, newest, due))
        yield _frame(out, self.OUT)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        self.orders.clear()
        self.last.clear()
        yield _frame([], self.OUT)

    def close(self) -> None:
        pass


class RecentTrades(StatefulProcessor):
    """Decisions and trades of a stock to the buy and sell size in the `window_us` up to each decision.

    A trade of an earlier micro-batch's time is late; a late decision is, too. With a time to live, a stock that has gone
    silent for so long leaves nothing behind.
    """

    OUT = "symbol string, event_id long, is_decision boolean, buy_size double, sell_size double, n_trades long, problem string"

    def __init__(self, window_us: int, live_ms: int | None = None):
        self.window_us, self.live_ms = window_us, live_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.recent = handle.getListState("recent", "us long, side string, size double", self.live_ms)
        self.last = handle.getValueState("last", "us long", self.live_ms)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        recent = deque(sorted(self.recent.get())) if self.recent.exists() else deque()
        settled = self.last.get()[0] if self.last.exists() else None
        total = {"buy": 0.0, "sell": 0.0}
        for _, side, size in recent:
            total[side] += size
        out, last = [], settled
        names = ["us", "is_decision", "event_id", "side", "size"]
        for us, decision, event_id, side, size in _in_order(rows, names[:3], names):
            if len(out) >= CHUNK:
                yield _frame(out, self.OUT)
                out = []
            if settled is not None and us < settled:
                out.append((key[0], event_id, bool(decision), None, None, None, "late"))
                continue
            last = us if last is None else max(last, us)
            while recent and recent[0][0] <= us - self.window_us:
                _, old, gone = recent.popleft()
                total[old] -= gone
            if decision:
                out.append((key[0], event_id, True, total["buy"], total["sell"], len(recent), None))
            else:
                recent.append((us, side, size))
                total[side] += size
        self.recent.clear()
        if recent:
            self.recent.put([(int(us), side, float(size)) for us, side, size in recent])
        if last is not None:
            self.last.update((int(last),))
        yield _frame(out, self.OUT)

    def close(self) -> None:
        pass


class ClockMarkouts(StatefulProcessor):
    """Quotes of a stock to the first quote at or after `horizon_us` from each, in order of time though they come in any.

    A timer goes off once the watermark has passed a stretch of time; what lies before the watermark is final then, and is dealt
    with at one go, however many timers go off with it. A quote whose future
    has not come `patience_us` after its horizon is given out without one. Quotes that no open question can need are dropped,
    so a stock's state spans horizon, patience and the watermark's delay. It is a list of blocks, one a micro-batch, made one by each
    timer that has work: what a block holds is read and written at one go, and dealt with by columns.
    """

    OUT = "symbol string, event_id long, us long, future_us long, markout_bps double, direction int"

    def __init__(self, horizon_us: int, patience_us: int, stretch_ms: int = 600_000):
        self.horizon_us, self.patience_us, self.stretch_ms = horizon_us, patience_us, stretch_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.quotes = handle.getListState("quotes", "us binary, event_id binary, mid binary, answered binary")
        self.done = handle.getValueState("done", "us long")

    def _timers(self, us: np.ndarray) -> set[int]:
        return set(((np.unique(us // 1000 // self.stretch_ms) + 1) * self.stretch_ms).tolist())

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        frame = pd.concat([r[["us", "event_id", "mid"]] for r in rows], ignore_index=True)
        us = frame["us"].to_numpy("int64")
        self.quotes.appendValue((us.tobytes(), frame["event_id"].to_numpy("int64").tobytes(), frame["mid"].to_numpy("float64").tobytes(), bytes(len(us))))
        due = self._timers(us) | self._timers(us + self.horizon_us + self.patience_us)
        for at in due.difference(self.handle.listTimers()):
            self.handle.registerTimer(at)
        yield _frame([], self.OUT)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        final = timerValues.getCurrentWatermarkInMs() * 1000
        if self.done.exists() and self.done.get()[0] >= final:
            return
        self.done.update((final,))
        blocks = list(self.quotes.get()) if self.quotes.exists() else []
        us, ids, mid, answered = (np.concatenate([np.frombuffer(b[i], kind) for b in blocks] or [np.empty(0, kind)]) for i, kind in enumerate(("int64", "int64", "float64", "bool")))
        order = np.lexsort((ids, us))
        us, ids, mid, answered = us[order], ids[order], mid[order], answered[order]
        settled, last = us.searchsorted(final), us + self.horizon_us + self.patience_us
        at = us.searchsorted(us + self.horizon_us)
        asked = (np.arange(len(us)) < settled) & ~answered
        future = np.append(us, 0)[np.minimum(at, len(us))]
        met = asked & (at < settled) & (future <= last)
        lost = asked & ~met & (final > last)
        given = np.flatnonzero(met | lost)
        for start in range(0, len(given), CHUNK):
            i = given[start : start + CHUNK]
            known = met[i]
            to = np.where(known, at[i], 0)
            move = np.where(known, mid[to] / mid[i] - 1, 0.0)
            frame = pd.DataFrame({"symbol": key[0], "event_id": ids[i], "us": us[i], "future_us": pd.array(us[to], dtype="Int64"), "markout_bps": pd.array(move * 1e4, dtype="Float64"), "direction": pd.array(np.sign(move).astype("int32"), dtype="Int32")})
            frame.loc[~known, ["future_us", "markout_bps", "direction"]] = pd.NA
            yield frame
        # a final quote is still wanted as the future of a quote that is open or yet to come
        still = asked & ~met & ~lost
        answered = answered | met | lost
        wanted = (us[still].min() if still.any() else final) + self.horizon_us
        kept = ~answered | (us >= wanted)
        self.quotes.clear()
        if kept.any():
            self.quotes.appendValue(tuple(x[kept].tobytes() for x in (us, ids, mid, answered)))

    def close(self) -> None:
        pass


class Markouts(StatefulProcessor):
    """Quotes of a stock to each quote's move over the next `horizon` quotes, given out when the last of them comes; late quotes
    are given out as such."""

    OUT = "symbol string, event_id long, markout_bps double, problem string"

    def __init__(self, horizon: int):
        self.horizon = horizon

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.pending = handle.getListState("pending", "place int, event_id long, mid double")
        self.last = handle.getValueState("last", "us long")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        waiting = deque((e, m) for _, e, m in sorted(self.pending.get())) if self.pending.exists() else deque()
        settled = self.last.get()[0] if self.last.exists() else None
        out, last = [], settled
        for us, event_id, mid in _in_order(rows, ["us", "event_id"], ["us", "event_id", "mid"]):
            if len(out) >= CHUNK:
                yield _frame(out, self.OUT)
                out = []
            if settled is not None and us < settled:
                out.append((key[0], event_id, None, "late"))
                continue
            last = us
            waiting.append((event_id, mid))
            if len(waiting) > self.horizon:
                earlier, base = waiting.popleft()
                out.append((key[0], earlier, (mid / base - 1) * 1e4, None))
        self.last.update((int(last),))
        self.pending.clear()
        if waiting:
            self.pending.put([(i, int(e), float(m)) for i, (e, m) in enumerate(waiting)])
        yield _frame(out, self.OUT)

    def close(self) -> None:
        pass


def keyed(stream: DataFrame, keys: list[str], processor: StatefulProcessor, event_time: bool = False) -> DataFrame:
    """The processor's rows for each key of a stream; state lies in RocksDB, so it may be larger than memory.

    With `event_time`, the stream has a watermark that drives the processor's timers; without, a processor with a time to live
    needs processing time.
    """
    stream.sparkSession.conf.set(*STORE)
    mode = "EventTime" if event_time else "ProcessingTime" if getattr(processor, "live_ms", None) else "None"
    return stream.groupBy(*keys).transformWithStateInPandas(processor, processor.OUT, "Append", mode)
