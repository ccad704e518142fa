"""What a resting order at the best price would meet next: a bounded look-ahead over event rows, not a matching engine.

A placement stands behind the whole queue at its side's best price. What is ahead changes as orders that were there change or
go. It is filled at the first message that executes an order behind it while nothing is ahead; the first message at which
the mid has moved against it by a tick is adverse. A race ends with its segment.

Stock-days stream in message order, each once: every delay and every rule of what a change does to an order's place is raced
from the same rows. A task keeps the last `horizon` messages and looks at windows of them, many placements at a time.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickframe.operators.metrics import quantile_bins

DAY = ("symbol", "day")
#: Columns of event rows that a race reads; `entered` comes in two forms.
_LONGS = ("event_index", "segment", "barriers", "tick", "execution", *[f"{s}_{c}" for s in ("bid", "ask") for c in ("px", "size", "orders")], *[f"{v}_{c}" for v in ("new", "old") for c in ("side", "price", "volume", "entered", "entered_reset")])


@dataclass(frozen=True)
class Race:
    horizon: int
    latencies: Sequence[int] = (0,)
    resets: Sequence[bool] = (False,)
    #: Messages after a fill at which the mid is read, beside the end of the decision's horizon.
    offsets: Sequence[int] = (1,)
    unit: int = 1
    #: The adverse move where event rows have no tick, as books of one level have none.
    tick: int = 1
    #: Placements that are looked at together.
    block: int = 8192

    def __post_init__(self) -> None:
        if self.horizon < 1 or min(self.latencies, default=0) < 0 or min(self.offsets, default=1) < 1:
            raise ValueError("horizon and offsets must be positive, latencies not negative")

    @property
    def reach(self) -> int:
        return self.horizon + max(self.latencies, default=0) + max(self.offsets, default=0)

    def schema(self) -> str:
        outcomes = [f"{kind}_{k}" for k in (*self.offsets, "remaining") for kind in ("markout", "spread")]
        return "symbol string, day string, event_index long, latency int, reset boolean, excluded string, prediction double, direction int, placement long, price long, queue_ahead long, orders_ahead long, entry_mid double, fill_time int, adverse_time int, " + ", ".join(f"{o} double" for o in outcomes)


def _masked(values: np.ndarray, there: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.array(values, mask=~there).cast(kind)


def _race(c: Race, e: dict[str, np.ndarray], asked: np.ndarray, latency: int, reset: bool) -> list[pa.Array]:
    """Outcomes of the signals at rows `asked`, behind which all rows that they can reach are there, or the day ends."""
    n, h = len(e["valid"]), c.horizon
    at = asked + latency
    there = at < n
    safe = np.where(there, at, 0)
    same_run = lambda i, j: e["valid"][j] & (e["segment"][j] == e["segment"][i]) & (e["barriers"][j] == e["barriers"][i])
    fits = there & e["valid"][asked] & same_run(asked, safe)
    reason = np.where(~there, "no message", np.where(~e["valid"][asked], "invalid signal", np.where(~e["valid"][safe], "invalid placement", "other segment")))
    direction = np.sign(e["prediction"][asked]).astype(np.int64)
    bid = direction >= 0
    side = np.where(bid, 1, 2)
    pick = lambda name: np.where(bid, e[f"bid_{name}"][safe], e[f"ask_{name}"][safe])
    price, queue, orders = pick("px"), pick("size"), pick("orders")
    mid = (e["bid_px"] + e["ask_px"]) / 2.0
    entry = mid[safe]
    # one row a placement, one column a later message
    grid = safe[:, None] + np.arange(1, h + 1)
    alive = np.logical_and.accumulate((grid < n) & same_run(safe[:, None], np.minimum(grid, n - 1)), axis=1)
    grid = np.minimum(grid, n - 1)
    entered = "entered_reset" if reset else "entered"
    here, before = {}, {}
    for v in ("old", "new"):
        here[v] = (e[f"{v}_side"][grid] == side[:, None]) & (e[f"{v}_price"][grid] == price[:, None])
        before[v] = here[v] & (e[f"{v}_{entered}"][grid] <= e["event_index"][safe][:, None])
    change = np.where(before["new"], e["new_volume"][grid], 0) - np.where(before["old"], e["old_volume"][grid], 0)
    ahead = queue[:, None] + np.cumsum(change, axis=1) - change
    hit = alive & here["old"] & ~before["old"] & (ahead <= 0) & (e["execution"][grid] >= c.unit)
    worse = alive & (direction[:, None] * (mid[grid] - entry[:, None]) <= -e["tick"][safe][:, None] + 1e-10)
    placed = fits & (direction != 0)
    first = lambda x: (np.argmax(x, axis=1) + 1, x.any(axis=1) & placed)
    (fill, filled), (adverse, moved) = first(hit), first(worse)
    fill_at = np.minimum(safe + fill, n - 1)
    outcomes = []
    for k in (*c.offsets, "remaining"):
        then = safe + h - latency if k == "remaining" else fill_at + k
        to = np.minimum(then, n - 1)
        known = filled & (then >= fill_at) & (then < n) & same_run(safe, to)
        outcomes += [_masked(direction * (mid[to] - mid[fill_at]) / mid[fill_at] * 1e4, known, pa.float64()), _masked(2 * direction * (mid[to] - price) / np.where(price == 0, 1, price) * 1e4, known, pa.float64())]
    size = len(asked)
    return [
        pa.array(e["event_index"][asked]), pa.array(np.full(size, latency, np.int32)), pa.array(np.full(size, reset)), _masked(reason, ~fits, pa.string()), pa.array(e["prediction"][asked]), _masked(direction, fits, pa.int32()),
        pa.array(e["event_index"][asked] + latency), _masked(price, placed, pa.int64()), _masked(queue, placed, pa.int64()), _masked(orders, placed, pa.int64()), _masked(entry, fits, pa.float64()),
        _masked(fill, filled, pa.int32()), _masked(adverse, moved, pa.int32()), *outcomes,
    ]


def _sweep(c: Race) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    names = [x.split()[0] for x in c.schema().split(", ")]

    def outcomes(key: tuple[str, str], e: dict[str, np.ndarray], until: int) -> Iterator[pa.RecordBatch]:
        """The signals before row `until`."""
        asked = np.flatnonzero(~np.isnan(e["prediction"][:until]))
        for start in range(0, len(asked), c.block):
            own = asked[start : start + c.block]
            for latency in c.latencies:
                for reset in c.resets:
                    columns = _race(c, e, own, latency, reset)
                    yield pa.RecordBatch.from_arrays([*[pa.repeat(pa.scalar(x, pa.string()), len(own)) for x in key], *columns], names)

    def sweep(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key: tuple[str, str] | None = None
        held: dict[str, np.ndarray] = {}
        for batch in batches:
            if batch.num_rows == 0:
                continue
            symbols, days = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            cuts = np.flatnonzero((symbols[1:] != symbols[:-1]) | (days[1:] != days[:-1])) + 1
            e = {n: batch.column(n).fill_null(-1).to_numpy(zero_copy_only=False) for n in _LONGS} | {"valid": batch.column("valid").fill_null(False).to_numpy(zero_copy_only=False), "prediction": batch.column("prediction").to_numpy(zero_copy_only=False).astype(float)}
            for a, b in zip(np.concatenate([[0], cuts]), np.concatenate([cuts, [batch.num_rows]]), strict=True):
                own = (symbols[a], days[a])
                if own != key:
                    if key is not None:
                        yield from outcomes(key, held, len(held["valid"]))
                    key, held = own, {n: x[a:b] for n, x in e.items()}
                else:
                    held = {n: np.concatenate([x, e[n][a:b]]) for n, x in held.items()}
                done = len(held["valid"]) - c.reach
                if done >= c.block:
                    yield from outcomes(key, held, done)
                    held = {n: x[done:] for n, x in held.items()}
        if key is not None:
            yield from outcomes(key, held, len(held["valid"]))

    return sweep


def races(events: DataFrame, signals: DataFrame, c: Race) -> DataFrame:
    """Every signal (symbol, day, event_index, prediction) at every delay and rule of place, raced or `excluded`.

    A signal is placed `latency` messages later if that message exists, is valid and lies in the same segment and between the
    same barriers as the signal's; else `excluded` names why not. A prediction of 0 keeps its row with direction 0 and is not placed.
    The tick of the placement's message is the adverse move. fill_time and adverse_time count messages after the placement;
    markout_k and spread_k are in bps, k messages after the fill and at the end of the decision's horizon (`remaining`).
    Event rows must be whole days; a signal without a message is left out.
    """
    rows = events.select(*DAY, *[F.col(x).cast("long").alias(x) for x in _LONGS], "valid")
    wanted = signals.select(*DAY, F.col("event_index").cast("long").alias("event_index"), F.col("prediction").cast("double").alias("prediction"))
    both = rows.join(wanted, [*DAY, "event_index"], "left").select(*DAY, *_LONGS, "valid", "prediction")
    return races_of(both, c)


def races_of(events: DataFrame, c: Race) -> DataFrame:
    """The same where the event rows carry their own `prediction` (NULL for no signal): one shuffle."""
    rows = events.withColumn("tick", F.coalesce("tick", F.lit(c.tick))).select(*DAY, *[F.col(x).cast("long").alias(x) for x in _LONGS], "valid", F.col("prediction").cast("double").alias("prediction"))
    return flagged(rows.repartition(*DAY).sortWithinPartitions(*DAY, "event_index").mapInArrow(_sweep(c), c.schema()))


def flagged(raced: DataFrame) -> DataFrame:
    fill, adverse = F.col("fill_time"), F.col("adverse_time")
    flag = lambda x: F.coalesce(x, F.lit(False))
    return raced.withColumns({"fill_first": flag(fill.isNotNull() & (adverse.isNull() | (fill < adverse))), "adverse_first": flag(adverse.isNotNull() & (fill.isNull() | (adverse < fill))), "simultaneous": flag(fill == adverse)})


def race_summary(raced: DataFrame, keys: list[str], outcomes: list[str]) -> DataFrame:
    """Per cell: signals that were excluded, counts, probabilities over all eligible decisions, quantiles of the queue ahead over
    placed ones, and the means of `outcomes` over fills with the number of rows that have them."""
    fits = F.col("excluded").isNull()
    placed, filled = fits & (F.col("direction") != 0), F.col("fill_time").isNotNull()
    share = lambda x: F.avg(F.when(fits, x.cast("double")))
    q = lambda p: F.expr(f"percentile(CASE WHEN direction <> 0 THEN queue_ahead END, {p})")
    out = [f for o in outcomes for f in (F.avg(F.when(filled, F.col(o))).alias(o), F.count(F.when(filled, F.col(o))).alias(f"{o}_observations"))]
    return raced.groupBy(*keys).agg(
        F.count_if(~fits).alias("excluded"), F.count_if(fits).alias("eligible"), F.count_if(placed).alias("placed"), F.count_if(fits & (F.col("direction") == 0)).alias("zero_signals"), F.count_if(filled).alias("fills"), share(filled).alias("fill_probability"), share(placed & ~filled).alias("unfilled"),
        F.avg("fill_time").alias("mean_fill_time"), F.expr("percentile(fill_time, 0.5)").alias("median_fill_time"), q(0.5).alias("median_queue_ahead"), q(0.1).alias("queue_ahead_p10"), q(0.9).alias("queue_ahead_p90"),
        share(F.col("fill_first")).alias("fill_first"), share(F.col("adverse_first")).alias("adverse_first"), share(F.col("simultaneous")).alias("simultaneous"), (1 - share(F.col("fill_first") | F.col("adverse_first") | F.col("simultaneous"))).alias("no_event"), *out,
    )


def race_deciles(raced: DataFrame, keys: list[str], column: str, outcomes: list[str], bins: int = 10) -> DataFrame:
    """The summary by quantile bins of a column, cut per cell; excluded signals have no bin."""
    return race_summary(quantile_bins(raced.where(F.col("excluded").isNull() & F.col(column).isNotNull()), keys, column, bins), [*keys, "bin"], outcomes)
