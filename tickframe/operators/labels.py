"""Forward labels and execution costs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickframe.functions.columns import mid
from tickframe.operators.features import in_segment


def at_offset(value: Column, offset: int) -> Column:
    """A value `offset` messages later in the same segment; NULL unless exactly that message is there."""
    w = in_segment()
    there = F.lead("event_index", offset).over(w) == F.col("event_index") + offset
    return F.when(there, F.lead(value, offset).over(w)) if offset else value


def offset_markouts(quotes: DataFrame, horizons: list[int]) -> DataFrame:
    """Adds markout_h in bps of the mid for each horizon in messages."""
    return quotes.withColumns({f"markout_{h}": (at_offset(mid(), h) / mid() - 1) * 1e4 for h in horizons})


def crossed_labels(quotes: DataFrame, horizon: int, latency: int = 0) -> DataFrame:
    """Outcomes in bps of entering at +latency and leaving `horizon` messages later across the spread."""
    if horizon < 1 or latency < 0:
        raise ValueError("horizon must be positive and latency not negative")
    entry, leave = (lambda c: at_offset(F.col(c), latency)), (lambda c: at_offset(F.col(c), latency + horizon))
    base = at_offset(mid(), latency)
    return quotes.withColumns({"long_bps": (leave("bid_px_1") - entry("ask_px_1")) / base * 1e4, "short_bps": (entry("bid_px_1") - leave("ask_px_1")) / base * 1e4})


def cost_components(quotes: DataFrame, horizon: int, latency: int = 0, fixed_exit: bool = False) -> DataFrame:
    """Gross move, both half-spreads and crossed outcomes, all in bps of the entry mid."""
    if fixed_exit and latency >= horizon:
        raise ValueError("a fixed exit needs a latency below the horizon")
    out = horizon if fixed_exit else horizon + latency
    base, half = at_offset(mid(), latency), (F.col("ask_px_1") - F.col("bid_px_1")) / 2.0
    parts = quotes.withColumns({"gross_bps": (at_offset(mid(), out) - base) / base * 1e4, "entry_half_bps": at_offset(half, latency) / base * 1e4, "exit_half_bps": at_offset(half, out) / base * 1e4})
    return parts.withColumns({"long_crossed_bps": F.col("gross_bps") - F.col("entry_half_bps") - F.col("exit_half_bps"), "short_crossed_bps": -F.col("gross_bps") - F.col("entry_half_bps") - F.col("exit_half_bps")})


def clock_markouts(quotes: DataFrame, horizon_us: int, stretch_us: int = 86_400_000_000) -> DataFrame:
    """Adds future_us, future_mid, markout_bps and direction: the first quote at or after us + horizon of the symbol.

    A forward as-of join as one window: probes at us + horizon sort before quotes of the same time. Windows are stretches of
    time, so a symbol's rows are spread over all tasks; at the end of each stretch stands the first quote behind it, from a
    table of one row a stretch. Rows move once.
    """
    row, start = F.struct(*quotes.columns), lambda at: F.floor(at / F.lit(stretch_us))
    quote = F.struct("us", mid().alias("mid"))
    data = quotes.select("symbol", F.col("us").alias("at"), F.lit(1).alias("kind"), "event_id", quote.alias("quote"), F.lit(None).cast(quotes.schema).alias("row"))
    probes = quotes.select("symbol", (F.col("us") + horizon_us).alias("at"), F.lit(0).alias("kind"), "event_id", F.lit(None).cast("struct<us:bigint,mid:double>").alias("quote"), row.alias("row"))
    firsts = quotes.select("symbol", "us", "event_id", quote.alias("quote")).groupBy("symbol", start(F.col("us")).alias("stretch")).agg(F.min_by("quote", F.struct("us", "event_id")).alias("first"))
    reach = F.sequence(F.lit(0), F.lit(-(-horizon_us // stretch_us)))
    asked = firsts.select("symbol", F.explode(F.transform(reach, lambda k: F.col("stretch") + k)).alias("stretch")).distinct()
    later = Window.partitionBy("symbol").orderBy(F.desc("stretch")).rowsBetween(Window.unboundedPreceding, -1)
    following = asked.join(firsts, ["symbol", "stretch"], "left").withColumn("quote", F.last("first", ignorenulls=True).over(later)).where("quote IS NOT NULL")
    behind = following.select("symbol", ((F.col("stretch") + 1) * stretch_us - 1).alias("at"), F.lit(2).alias("kind"), F.lit(0).cast(quotes.schema["event_id"].dataType).alias("event_id"), "quote", F.lit(None).cast(quotes.schema).alias("row"))
    both = data.union(probes).union(behind).withColumn("stretch", start(F.col("at")))
    # Backwards in time, so that the frame only grows; one that shrinks would be summed anew for every row.
    ahead = Window.partitionBy("symbol", "stretch").orderBy(F.desc("at"), F.desc("kind"), F.desc("event_id")).rowsBetween(Window.unboundedPreceding, 0)
    joined = both.withColumn("next", F.last("quote", ignorenulls=True).over(ahead)).where("kind = 0").select("row.*", "next")
    move = F.col("next.mid") / mid() - 1
    return joined.withColumns({"future_us": F.col("next.us"), "future_mid": F.col("next.mid"), "markout_bps": move * 1e4, "direction": F.signum(move).cast("int")}).drop("next")


def sweep_depth(books: DataFrame, size: float, fee_bps: float = 0.0, side: str = "buy", strict: bool = False) -> DataFrame:
    """Costs of crossing the visible depth: filled, average_px, and in bps of `mid` spread_bps, depth_bps (0 at least), fee_bps
    and total_bps.

    A buy walks `asks` upwards, a sell walks `bids` downwards (arrays of struct px, sz). NULL levels are skipped and levels
    are sorted; of more than 50 only the first 50 count. Where the depth is not enough, the costs are NULL, or with
    `strict` an error. The spread is that of the best_bid and best_ask columns.
    """
    if size <= 0 or side not in ("buy", "sell"):
        raise ValueError("size must be positive and side buy or sell")
    sign = 1.0 if side == "buy" else -1.0
    usable = F.filter(F.slice("asks" if side == "buy" else "bids", 1, 50), lambda x: x["px"].isNotNull() & x["sz"].isNotNull())
    levels = F.array_sort(F.transform(usable, lambda x: F.struct((x["px"] * sign).alias("key"), x["px"].alias("px"), x["sz"].alias("sz"))))
    take = lambda a, x: F.struct((a["left"] - F.least(a["left"], x["sz"])).alias("left"), (a["paid"] + F.least(a["left"], x["sz"]) * x["px"]).alias("paid"))
    walked = books.withColumn("walk", F.aggregate(levels, F.struct(F.lit(float(size)).alias("left"), F.lit(0.0).alias("paid")), take))
    lacking = F.raise_error(F.lit("insufficient visible depth")).cast("double") if strict else F.lit(None).cast("double")
    average = F.when(F.col("walk.left") <= 0, F.col("walk.paid") / size).otherwise(lacking)
    centre = (F.col("best_bid") + F.col("best_ask")) / 2.0
    total = sign * (average - centre) / centre * 1e4 + fee_bps
    spread = (F.col("best_ask") - F.col("best_bid")) / centre * 1e4 / 2.0
    return walked.withColumns({"filled": size - F.col("walk.left"), "average_px": average, "spread_bps": F.when(average.isNotNull(), spread), "depth_bps": F.when(average.isNotNull(), F.greatest(F.lit(0.0), total - spread - fee_bps)), "fee_bps": F.when(average.isNotNull(), F.lit(float(fee_bps))), "total_bps": total}).drop("walk")


def crossed_from_features(markout: Column, entry_spread: Column, exit_spread: Column, direction: Column) -> Column:
    """Crossed outcome in bps from the midpoint markout and both spreads in bps; a direction other than 1 and -1 is an error."""
    value = direction * markout - entry_spread / 2.0 - exit_spread / 2.0 * (1.0 + markout / 1e4)
    return F.when(direction.isin(1, -1), value).otherwise(F.raise_error(F.lit("direction must be 1 or -1")).cast("double"))


def passive_markout(spread_diagnostic: Column) -> Column:
    return spread_diagnostic / 2.0


def exact_clock(quotes: DataFrame, offset: int) -> DataFrame:
    """Adds clock_s, the seconds to the message `offset` later in the segment; times going back are an error.

    Nanoseconds are subtracted as integers first.
    """
    gap = at_offset(F.col("timestamp_ns"), offset) - F.col("timestamp_ns")
    return quotes.withColumn("clock_s", F.when(gap < 0, F.raise_error(F.lit("the clock goes back")).cast("double")).otherwise(gap / F.lit(1e9)))


def window_duration(quotes: DataFrame, length: int) -> DataFrame:
    """Adds duration_ns, the time that the last `length` messages of the day took (by row position)."""
    return quotes.withColumn("duration_ns", F.col("timestamp_ns") - F.lag("timestamp_ns", length - 1).over(in_segment("symbol", "day")))


def common_rows(quotes: DataFrame, horizons: list[int], latencies: list[int], predictions: list[str]) -> DataFrame:
    """Adds common: every prediction is there, and so is the message at each latency and at each horizon after it."""
    there = F.lit(True)
    for p in predictions:
        there = there & F.col(p).isNotNull()
    for k in sorted({*latencies, *(h + d for h in horizons for d in latencies)}):
        there = there & at_offset(mid(), k).isNotNull()
    return quotes.withColumn("common", there)
