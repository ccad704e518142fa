"""Per-row and windowed features of quotes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickframe.functions.columns import imbalance, microprice, mid, spread_bps

SEGMENT = ("symbol", "day", "segment")
#: Nested groups of features.
GROUPS = {"f1": ["p_top"], "f2": ["p_top", "p_depth"], "f3": ["p_top", "p_depth", "spread_bps", "exit_spread_bps"]}


def in_segment(*keys: str):
    return Window.partitionBy(*(keys or SEGMENT)).orderBy("event_index")


def quote_features(quotes: DataFrame, levels: int = 2) -> DataFrame:
    """Adds mid, spread_bps, imbalances of the top and of `levels` levels, microprice and its distance in bps."""
    depth = lambda side: sum((F.coalesce(F.col(f"{side}_sz_{i}"), F.lit(0.0)) for i in range(2, levels + 1)), F.coalesce(F.col(f"{side}_sz_1"), F.lit(0.0)))
    return quotes.withColumns({"mid": mid(), "spread_bps": spread_bps(), "top_imbalance": imbalance(F.col("bid_sz_1"), F.col("ask_sz_1")), "depth_imbalance": imbalance(depth("bid"), depth("ask")), "microprice": microprice(), "microprice_minus_mid_bps": F.try_divide(microprice() - mid(), mid()) * 1e4})


def order_flow_imbalance(quotes: DataFrame) -> DataFrame:
    """Adds ofi_l1 and ofi_l1_norm (by the current top sizes); NULL on the first row of a segment."""
    w = in_segment()
    before = lambda c: F.lag(c).over(w)
    bid = F.when(F.col("bid_px_1") > before("bid_px_1"), F.col("bid_sz_1")).when(F.col("bid_px_1") == before("bid_px_1"), F.col("bid_sz_1") - before("bid_sz_1")).when(F.col("bid_px_1") < before("bid_px_1"), -before("bid_sz_1"))
    ask = F.when(F.col("ask_px_1") < before("ask_px_1"), F.col("ask_sz_1")).when(F.col("ask_px_1") == before("ask_px_1"), F.col("ask_sz_1") - before("ask_sz_1")).when(F.col("ask_px_1") > before("ask_px_1"), -before("ask_sz_1"))
    flow = quotes.withColumn("ofi_l1", bid - ask)
    return flow.withColumn("ofi_l1_norm", F.try_divide(F.col("ofi_l1"), F.col("bid_sz_1") + F.col("ask_sz_1")))


def recent_trades(decisions: DataFrame, trades: DataFrame, window_us: int) -> DataFrame:
    """Buy and sell size and number of trades in (us - window_us, us] of each decision's symbol.

    Time is cut into stretches of the window's length, so a window is the end of one stretch and the beginning of the next. A
    decision asks both, once each, for a running sum: forward from the beginning of its own stretch, backward from the end of the
    one before. No frame slides and no pair is made: the work is linear in rows, however many trades a stretch has.
    """
    at, none = F.col("us"), {"side": F.lit(None).cast("string"), "size": F.lit(None).cast("double")}
    stretch = F.floor(at / window_us)
    asked = decisions.select("symbol", F.col("event_id").alias("decision"), at.alias("at"), F.explode(F.array(F.struct(F.lit(False).alias("back"), stretch.alias("stretch"), at.alias("us")), F.struct(F.lit(True).alias("back"), (stretch - 1).alias("stretch"), (at - window_us + 1).alias("us")))).alias("_a"))
    left = asked.select("symbol", "_a.stretch", "_a.us", "decision", "at", "_a.back", *[c.alias(n) for n, c in none.items()])
    right = trades.where(at.isNotNull()).select("symbol", stretch.alias("stretch"), "us", F.lit(None).cast("long").alias("decision"), F.lit(None).cast("long").alias("at"), F.lit(None).cast("boolean").alias("back"), "side", "size")
    part = Window.partitionBy("symbol", "stretch")
    running = [part.orderBy(o).rangeBetween(Window.unboundedPreceding, Window.currentRow) for o in (F.asc("us"), F.desc("us"))]
    of = lambda x: F.when(F.col("back"), x.over(running[1])).otherwise(x.over(running[0]))
    size = lambda side: F.coalesce(of(F.sum(F.when(F.col("side") == side, F.col("size")))), F.lit(0.0)).alias(f"{side}_size")
    halves = left.union(right).select("symbol", "decision", "at", "back", size("buy"), size("sell"), of(F.count("side")).alias("n_trades")).where("decision IS NOT NULL")
    # the two halves of a decision meet; a decision that was given several times has as many of each
    whole = lambda c: (F.max(F.when(F.col("back"), F.col(c))) + F.max(F.when(~F.col("back"), F.col(c)))).alias(c)
    met = halves.groupBy("symbol", "decision", "at").agg(whole("buy_size"), whole("sell_size"), whole("n_trades"), F.count_if("back").cast("int").alias("_times"))
    summed = met.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_times")))).select("decision", "buy_size", "sell_size", "n_trades")
    return summed.withColumn("trade_imbalance", F.coalesce(F.try_divide(F.col("buy_size") - F.col("sell_size"), F.col("buy_size") + F.col("sell_size")), F.lit(0.0)))


def rolling_activity(trades: DataFrame, window_us: int) -> DataFrame:
    """Signed size ratio and number of trades in [us - window_us, us], each with the rows of equal time before it only.

    Time is cut into stretches of the window's length, and a trade stands in its own and the next one.
    """
    stretch = F.floor(F.col("us") / window_us)
    copies = trades.withColumn("_copy", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn("_stretch", stretch + F.col("_copy"))
    w = Window.partitionBy("symbol", "_stretch").orderBy("us").rangeBetween(-window_us, 0)
    later = Window.partitionBy("symbol", "_stretch", "us").orderBy("event_id").rowsBetween(1, Window.unboundedFollowing)
    signed = F.when(F.col("side") == "buy", F.col("size")).otherwise(-F.col("size"))
    causal = lambda x: F.sum(x).over(w) - F.coalesce(F.sum(x).over(later), F.lit(0.0))
    counted = copies.withColumns({"activity": F.count("*").over(w) - F.count("*").over(later), "signed_ratio": F.try_divide(causal(signed), causal(F.col("size")))})
    return counted.where("_copy = 0").drop("_copy", "_stretch")


def valid_runs(quotes: DataFrame, condition: str = "true") -> DataFrame:
    """Adds run_id and run_length: rows in a row of one segment with consecutive indices that meet the condition."""
    w = in_segment()
    kept = quotes.where(condition).withColumn("breaks", F.when(F.col("event_index") == F.lag("event_index").over(w) + 1, 0).otherwise(1))
    runs = kept.withColumn("run_id", F.sum("breaks").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("breaks")
    return runs.withColumn("run_length", F.row_number().over(Window.partitionBy(*SEGMENT, "run_id").orderBy("event_index")))


def causal_windows(quotes: DataFrame, columns: list[str], length: int) -> DataFrame:
    """Adds `window`, the last `length` rows of `columns` in the run; only rows with a full one stay."""
    frame = Window.partitionBy(*SEGMENT, "run_id").orderBy("event_index").rowsBetween(-(length - 1), 0)
    return valid_runs(quotes).withColumn("window", F.collect_list(F.struct(*columns)).over(frame)).where(F.col("run_length") >= length)


def level_depths(books: DataFrame, levels: int) -> DataFrame:
    """Adds bid_depth, ask_depth and depth_imbalance of the first `levels` levels of `bids` and `asks` (arrays of struct px, sz).

    A missing level or size counts as 0; a side without any level is an error.
    """
    depth = lambda side: F.when(F.size(side) == 0, F.raise_error(F.lit("a book has no level")).cast("double")).otherwise(F.aggregate(F.slice(side, 1, levels), F.lit(0.0), lambda a, x: a + F.coalesce(x["sz"], F.lit(0.0))))
    return books.withColumns({"bid_depth": depth("bids"), "ask_depth": depth("asks")}).withColumn("depth_imbalance", imbalance(F.col("bid_depth"), F.col("ask_depth")))
