"""Registered queries on stateful streams; they join those of `queries`."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tickframe.operators.resampling import tiled
from tickframe.plans.log_queries import _FEED, _VERSION_STREAM_SQL
from tickframe.plans.queries import HOUR, MINUTE, register, rounded
from tickframe.streaming import metrics as streams
from tickframe.streaming import stateful
from tickframe.views import view


def _marked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events with what all of the queries below need of them."""
    return spark.read.parquet(f"{sf_dir}/events.parquet").selectExpr("*", "unix_micros(CAST(ts AS TIMESTAMP)) AS us", "concat('S', user_id % 5) AS symbol", "CAST(CAST(ts AS DATE) AS STRING) AS day")


def _levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Level rows of the feed in the order of its messages, in micro-batches of bounded size, parsed by all tasks before they are files."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "ts", "user_id")
    bounds = streams.edges(events, F.col("event_id"))
    return streams.stream_in_files(streams.level_stream(events).drop("local_ts", "sequence").withColumn("_part", streams.part_of(F.col("receive_index"), bounds)), "_part", len(bounds) + 1)


@register(_FEED.replace("epoch::BIGINT AS epoch, ", "").replace(",\n       count(price) FILTER (side = 'bid')::BIGINT AS bid_levels, count(price) FILTER (side = 'ask')::BIGINT AS ask_levels FROM live GROUP BY ALL", " FROM live GROUP BY product_id, receive_index"))
def book_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The books of `feed_books`, by state that follows the stream."""
    rows = stateful.keyed(_levels(spark, sf_dir), ["product_id"], stateful.Books())
    return streams.run_to_table(rows).where("problem IS NULL").drop("problem")


@register("""
WITH m AS (SELECT event_id, concat('S', CAST(user_id % 5 AS VARCHAR)) AS product_id, event_id % 5 = 0 AS snap, event_id % 7 = 0 AND event_id % 5 IN (1, 2) AS bad FROM events WHERE event_id % 5 IN (0, 1, 2)),
r AS (SELECT *, max(event_id) FILTER (snap) OVER w AS s, max(event_id) FILTER (bad) OVER (PARTITION BY product_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM m WINDOW w AS (PARTITION BY product_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
SELECT product_id, event_id AS receive_index, CASE WHEN s IS NULL THEN 'before snapshot' WHEN b > s THEN 'no valid snapshot' ELSE 'negative size' END AS problem FROM r WHERE s IS NULL OR coalesce(b > s, false) OR bad
""")  # fmt: skip
def stream_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that break the rules, as a stream of their own: updates before a snapshot, negative sizes, and what follows them."""
    levels = _levels(spark, sf_dir)
    bad = (F.col("receive_index") % 7 == 0) & (F.col("type") == "l2update")
    rows = stateful.keyed(levels.withColumn("size", F.when(bad, F.lit(-1.0)).otherwise(F.col("size"))), ["product_id"], stateful.Books())
    return streams.run_to_table(rows.where("problem IS NOT NULL").select("product_id", "receive_index", "problem"))


#: Files of a stream, at least: rows stand in the order of a time that is off by up to ten minutes, so that micro-batches overlap.
PARTS, JITTER = 4, 600


def _files(rows: DataFrame, flush: DataFrame, bounds: list) -> DataFrame:
    """A stream of micro-batches, one a file, cut by ranges of a time that is off; then a row far ahead, which drives the watermark
    past everything."""
    parts = rows.withColumn("part", streams.part_of(_off(), bounds)).unionByName(flush.withColumn("part", F.lit(len(bounds) + 1)))
    return streams.stream_in_files(parts, "part", len(bounds) + 2)


def _off() -> Column:
    return F.col("us") + F.col("event_id") * 7919 % JITTER * 1_000_000


def _far(rows: DataFrame, **values: object) -> DataFrame:
    """One row a year ahead of the last one, of a stock of its own."""
    last = rows.agg(F.max("us").alias("us")).withColumn("us", F.col("us") + 365 * 24 * HOUR)
    known = {"symbol": F.lit("~"), "event_id": F.lit(-1).cast("long")} | {k: F.lit(v) for k, v in values.items()}
    return last.select(*[(F.col("us") if c == "us" else F.timestamp_micros("us") if c == "at" else known.get(c, F.lit(None)).cast(t)).alias(c) for c, t in rows.dtypes])


@register(_VERSION_STREAM_SQL, "log")
def order_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order versions of the log from state, in several micro-batches of whole messages; a day's state ends by a timer."""
    hour = F.expr(f"us div {HOUR}")
    bounds = streams.edges(_marked(spark, sf_dir), hour, PARTS)
    log = view(spark, sf_dir, "log").withColumns({"at": F.timestamp_micros("us"), "part": streams.part_of(hour, bounds)})
    rows = streams.stream_in_files(log, "part", len(bounds) + 1).withWatermark("at", "0 seconds")
    return streams.run_to_table(stateful.keyed(rows, ["symbol", "day"], stateful.OrderVersions(24 * HOUR), event_time=True)).drop("us")


@register(f"""
WITH m AS (SELECT *, epoch_us(ts) AS us, concat('S', CAST(user_id % 5 AS VARCHAR)) AS symbol FROM events)
SELECT q.symbol, q.event_id, round(coalesce(sum(t.value) FILTER (t.event_id % 2 = 0), 0), 6) AS buy_size, round(coalesce(sum(t.value) FILTER (t.event_id % 2 = 1), 0), 6) AS sell_size, count(t.event_id)::BIGINT AS n_trades
FROM m q LEFT JOIN m t ON q.symbol = t.symbol AND t.event_type = 'purchase' AND t.us > q.us - {HOUR} AND t.us <= q.us WHERE q.event_type <> 'purchase' GROUP BY q.symbol, q.event_id
""")  # fmt: skip
def trade_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trades of the last hour at each decision, from two streams whose files hold their rows out of order."""
    rows = _marked(spark, sf_dir).select("symbol", "us", "event_id", "event_type", F.col("value").alias("size"), F.timestamp_micros("us").alias("at"), F.expr("IF(event_id % 2 = 0, 'buy', 'sell')").alias("side"))
    side = lambda purchase: rows.where(f"(event_type = 'purchase') = {purchase}").drop("event_type")
    bounds = streams.edges(rows, _off(), PARTS)
    decisions, trades = (_files(x, _far(x, side="buy", size=0.0), bounds) for x in (side("false"), side("true")))
    joined = streams.recent_trades(decisions.select("symbol", "at", "event_id"), trades.select("symbol", "at", "side", "size"), HOUR, f"{2 * JITTER} seconds")
    return rounded(streams.run_to_table(joined).where("event_id >= 0").drop("at"))


@register(f"""
WITH m AS (SELECT *, epoch_us(ts) AS us, concat('S', CAST(user_id % 5 AS VARCHAR)) AS symbol FROM events), p AS (SELECT *, NTILE({PARTS}) OVER (ORDER BY event_id) - 1 AS part FROM m),
x AS (SELECT part, symbol, max(us) AS newest FROM p GROUP BY part, symbol), s AS (SELECT p.*, (SELECT max(newest) FROM x WHERE x.symbol = p.symbol AND x.part < p.part) AS settled FROM p), k AS (SELECT *, coalesce(us < settled, false) AS late FROM s)
SELECT q.symbol, q.event_id, q.event_type <> 'purchase' AS is_decision, CASE WHEN NOT q.late AND q.event_type <> 'purchase' THEN round(coalesce(sum(t.value) FILTER (t.event_id % 2 = 0), 0), 6) END AS buy_size, CASE WHEN NOT q.late AND q.event_type <> 'purchase' THEN round(coalesce(sum(t.value) FILTER (t.event_id % 2 = 1), 0), 6) END AS sell_size,
  CASE WHEN NOT q.late AND q.event_type <> 'purchase' THEN count(t.event_id)::BIGINT END AS n_trades, CASE WHEN q.late THEN 'late' END AS problem
FROM k q LEFT JOIN k t ON NOT q.late AND NOT t.late AND q.symbol = t.symbol AND t.event_type = 'purchase' AND t.us > q.us - {HOUR} AND t.us <= q.us AND t.part <= q.part WHERE q.event_type <> 'purchase' OR q.late GROUP BY q.symbol, q.event_id, q.event_type, q.late
""")  # fmt: skip
def late_trade_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same windows from keyed state over files that overlap: rows behind an earlier micro-batch are given out as late."""
    rows = _marked(spark, sf_dir).selectExpr("symbol", "us", "event_id", "event_type <> 'purchase' AS is_decision", "IF(event_id % 2 = 0, 'buy', 'sell') AS side", "value AS size")
    stream = streams.stream_in_files(tiled(rows, ["event_id"], PARTS, "part"), "part", PARTS)
    return rounded(streams.run_to_table(stateful.keyed(stream, ["symbol"], stateful.RecentTrades(HOUR))))


@register("""
WITH m AS (SELECT event_id, concat('S', CAST(user_id % 5 AS VARCHAR)) AS symbol, epoch_us(ts) AS us, 100 + (event_id * 31 % 17) / 10.0 AS mid FROM events), n AS (SELECT *, lead(mid, 5) OVER (PARTITION BY symbol ORDER BY us, event_id) AS later FROM m)
SELECT symbol, event_id, round((later / mid - 1) * 1e4, 6) AS markout_bps, NULL::VARCHAR AS problem FROM n WHERE later IS NOT NULL
""")  # fmt: skip
def markout_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Moves over the next five quotes, given out when the fifth comes."""
    rows = _marked(spark, sf_dir).selectExpr("symbol", "us", "event_id", "100 + (event_id * 31 % 17) / 10D AS mid")
    return rounded(streams.run_to_table(stateful.keyed(streams.in_batches(rows, "us"), ["symbol"], stateful.Markouts(5))))


@register(f"""
WITH m AS (SELECT event_id, concat('S', CAST(user_id % 5 AS VARCHAR)) AS symbol, epoch_us(ts) AS us, 100 + (event_id * 31 % 17) / 10.0 AS mid FROM events),
n AS (SELECT a.symbol, a.event_id, a.us, a.mid, b.us AS fu, b.mid AS fm FROM m a ASOF LEFT JOIN (SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY symbol, us ORDER BY event_id) = 1) b ON a.symbol = b.symbol AND b.us >= a.us + {MINUTE}),
k AS (SELECT *, fu <= us + {MINUTE} + {6 * HOUR} AS near FROM n)
SELECT symbol, event_id, us, CASE WHEN near THEN fu END AS future_us, CASE WHEN near THEN round((fm / mid - 1) * 1e4, 6) END AS markout_bps, CASE WHEN near THEN sign(fm / mid - 1)::INT END AS direction FROM k
""")  # fmt: skip
def clock_markout_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Moves to the first quote a minute later or more, within six hours, from timers over files out of order."""
    rows = _marked(spark, sf_dir).selectExpr("symbol", "us", "event_id", "100 + (event_id * 31 % 17) / 10D AS mid", "timestamp_micros(us) AS at")
    stream = _files(rows, _far(rows, mid=1.0), streams.edges(rows, _off(), PARTS)).withWatermark("at", f"{2 * JITTER} seconds")
    return rounded(streams.run_to_table(stateful.keyed(stream, ["symbol"], stateful.ClockMarkouts(MINUTE, 6 * HOUR, HOUR // 1000), event_time=True)).where("symbol <> '~'"))
