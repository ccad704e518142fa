"""Registered queries on feeds, queues, cohorts and streams; they join those of `queries`."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickframe.operators import cohorts, features, labels, queues
from tickframe.plans.queries import _VERSIONS, HOUR, MID, lead, register, rounded
from tickframe.sources import feed
from tickframe.sources.tables import work_folder
from tickframe.streaming import metrics as streams
from tickframe.views import view

_FEED_LEVELS = """
SELECT event_id AS receive_index, concat('S', CAST(user_id % 5 AS VARCHAR)) AS product_id, change_index, side, price::DOUBLE AS price, size::DOUBLE AS size FROM (
  SELECT event_id, user_id, 1 AS change_index, 'bid' AS side, 100 - event_id % 4 AS price, 1 + event_id % 7 AS size FROM events WHERE event_id % 5 = 0
  UNION ALL SELECT event_id, user_id, 2, 'bid', 95 - event_id % 4, 2 + event_id % 7 FROM events WHERE event_id % 5 = 0
  UNION ALL SELECT event_id, user_id, 3, 'ask', 101 + event_id % 4, 1 + event_id % 3 FROM events WHERE event_id % 5 = 0
  UNION ALL SELECT event_id, user_id, 4, 'ask', 106 + event_id % 4, 2 + event_id % 3 FROM events WHERE event_id % 5 = 0
  UNION ALL SELECT event_id, user_id, 1, 'bid', 99 - event_id % 3, event_id % 6 FROM events WHERE event_id % 5 IN (1, 2)
  UNION ALL SELECT event_id, user_id, 2, 'ask', 102 + event_id % 3, event_id % 8 FROM events WHERE event_id % 5 IN (1, 2)) x
"""


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet")


@register(_FEED_LEVELS)
def feed_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = feed.level_rows(feed.parse(feed.event_lines(_events(spark, sf_dir))))
    return rows.select("receive_index", "product_id", "change_index", "side", "price", "size")


@register("""
SELECT event_id AS receive_index, concat('S', CAST(user_id % 5 AS VARCHAR)) AS product_id, (100 + event_id % 3)::DOUBLE AS price, (1 + event_id % 9)::DOUBLE AS size,
       CASE user_id % 3 WHEN 0 THEN 'sell' WHEN 1 THEN 'buy' END AS aggressor, CASE user_id % 3 WHEN 0 THEN -1 WHEN 1 THEN 1 ELSE 0 END AS trade_sign FROM events WHERE event_id % 5 = 3
""")  # fmt: skip
def feed_trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = feed.trade_rows(feed.parse(feed.event_lines(_events(spark, sf_dir))))
    return rows.select("receive_index", "product_id", "price", "size", "aggressor", "trade_sign")


@register("""
WITH n AS (SELECT event_id, user_id, row_number() OVER (ORDER BY event_id) AS receive_index FROM events)
SELECT receive_index, concat('S', CAST(user_id % 5 AS VARCHAR)) AS product_id, CASE WHEN event_id % 5 = 0 THEN 4 WHEN event_id % 5 IN (1, 2) THEN 2 ELSE 0 END::BIGINT AS levels FROM n WHERE event_id % 5 IN (0, 1, 2)
""")  # fmt: skip
def captured_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A capture written as text files and read again: every line has its place over all files, ignored ones included."""
    path = work_folder(spark, "capture")
    lines = feed.event_lines(_events(spark, sf_dir))
    lines.repartitionByRange(4, "receive_index").sortWithinPartitions("receive_index").select("value").write.text(path)
    rows = feed.level_rows(feed.parse(feed.read_lines(spark, path)))
    return rows.groupBy("receive_index", "product_id").agg(F.count("*").alias("levels"))


@register(_FEED_LEVELS)
def feed_level_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same rows by Structured Streaming."""
    rows = streams.run_to_table(streams.level_stream(streams.event_stream(spark, sf_dir)))
    return rows.select("receive_index", "product_id", "change_index", "side", "price", "size")


@register(f"""
SELECT start_us, count(*)::BIGINT AS messages, count(*) FILTER (event_type = 'error')::BIGINT AS errors FROM (SELECT *, epoch_us(ts) // {HOUR} * {HOUR} AS start_us FROM events)
WHERE start_us + {HOUR} <= (SELECT max(epoch_us(ts)) FROM events) - 600000000 GROUP BY start_us
""")  # fmt: skip
def hourly_stream_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows that the watermark has closed."""
    return streams.run_to_table(streams.minute_counts(streams.event_stream(spark, sf_dir)))


_ENTERED = _VERSIONS + """
, e AS (SELECT *, last_value(CASE WHEN price_before IS NULL OR price_now <> price_before THEN event_index END IGNORE NULLS) OVER (PARTITION BY symbol, day, epoch, order_id, life ORDER BY event_index ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS entered FROM v)
"""  # fmt: skip


@register(_ENTERED + """
, n AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY symbol, day, order_id ORDER BY event_index DESC) AS k FROM e JOIN (SELECT symbol, day, max(epoch) AS epoch FROM messages GROUP BY ALL) USING (symbol, day, epoch)) WHERE k = 1 AND action <> 'D')
SELECT symbol, day, side, price_now AS price, order_id, entered, volume_now AS volume, (row_number() OVER q)::INT AS place, coalesce(sum(volume_now) OVER (q ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS ahead
FROM n WINDOW q AS (PARTITION BY symbol, day, side, price_now ORDER BY entered, order_id)
""", "messages")  # fmt: skip
def final_queues(spark: SparkSession, sf_dir: str) -> DataFrame:
    return queues.final_queues(view(spark, sf_dir, "messages"))


@register(_VERSIONS + """
SELECT symbol, day, event_index, coalesce(CASE WHEN action = 'D' THEN volume_before WHEN price_now = price_before THEN greatest(0, volume_before - volume_now) ELSE 0 END, 0) AS executed FROM v
""", "messages")  # fmt: skip
def executions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return queues.executions(view(spark, sf_dir, "messages")).select("symbol", "day", "event_index", "executed")


@register("""
, newest AS (SELECT symbol, day, side, px, arg_max(sz, seq) AS sz FROM deltas GROUP BY ALL)
SELECT symbol, day, count(*)::BIGINT AS levels, sha256(array_to_string(list_sort(list(concat(side, ':', px, ':', sz))), ',')) AS state FROM newest WHERE sz > 0 GROUP BY symbol, day
""", "deltas")  # fmt: skip
def final_books(spark: SparkSession, sf_dir: str) -> DataFrame:
    return queues.final_books(view(spark, sf_dir, "deltas"))


@register("""
SELECT symbol, day, count(*)::BIGINT AS messages, count(*) FILTER (action = 'A')::BIGINT AS n_a, count(*) FILTER (action = 'M')::BIGINT AS n_m, count(*) FILTER (action = 'D')::BIGINT AS n_d, count(DISTINCT epoch)::BIGINT AS epochs FROM messages GROUP BY symbol, day
""", "messages")  # fmt: skip
def day_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return queues.day_counters(view(spark, sf_dir, "messages"))


@register("""
, cells AS (SELECT symbol, day, count(*) AS n FROM quotes GROUP BY ALL)
SELECT t.symbol AS held_out, t.day AS fold, 'train' AS part, sum(c.n)::BIGINT AS rows FROM cells t JOIN cells c ON c.symbol <> t.symbol AND c.day < t.day GROUP BY ALL
UNION ALL SELECT symbol, day, 'test', n::BIGINT FROM cells
""", "quotes")  # fmt: skip
def transfer_fold_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    per_day = view(spark, sf_dir, "quotes").groupBy("symbol", "day").agg(F.count("*").alias("n"))
    return cohorts.transfer_folds(per_day.select("symbol", "day")).join(per_day, ["symbol", "day"]).groupBy("held_out", "fold", "part").agg(F.sum("n").alias("rows"))


@register(f"""
, m AS (SELECT day, ask_px_1 - bid_px_1 AS spread, bid_sz_1 + ask_sz_1 AS depth, ({lead(MID, 5)} / {MID} - 1) * 1e4 AS a FROM quotes), c AS (SELECT day, round(spread, 6) AS spread, depth, a FROM m WHERE a IS NOT NULL),
cuts AS (SELECT quantile_cont(spread, [1/3, 2/3]) AS cx, quantile_cont(depth, [1/3, 2/3]) AS cy FROM c WHERE day < (SELECT max(day) FROM c)),
p AS (SELECT len(list_filter(cx, lambda x: x < spread)) AS sx, len(list_filter(cy, lambda x: x < depth)) AS sy, a FROM c, cuts WHERE day = (SELECT max(day) FROM c))
SELECT i::INT AS state_x, j::INT AS state_y, count(a)::BIGINT AS n, round(avg(a), 6) AS mean FROM range(3) r(i) CROSS JOIN range(3) s(j) LEFT JOIN p ON sx = i AND sy = j GROUP BY i, j
""", "quotes")  # fmt: skip
def tercile_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Markouts of the last day in states of spread and depth that are cut on the days before."""
    from tickframe.plans.queries import _marked

    rows = _marked(spark, sf_dir).where("markout_5 IS NOT NULL").select("day", F.round(F.col("ask_px_1") - F.col("bid_px_1"), 6).alias("spread"), (F.col("bid_sz_1") + F.col("ask_sz_1")).alias("depth"), "markout_5")
    last = F.broadcast(rows.agg(F.max("day").alias("last_day")))
    parts = rows.join(last)
    return rounded(cohorts.tercile_grid(parts.where("day < last_day"), parts.where("day = last_day"), "spread", "depth", "markout_5"))


@register("""
, g AS (SELECT *, us - lag(us) OVER (PARTITION BY symbol, day ORDER BY event_index) AS gap FROM quotes), med AS (SELECT median(gap) AS m FROM g WHERE gap > 0 AND day < (SELECT max(day) FROM quotes))
SELECT symbol, CASE WHEN gap IS NULL OR gap <= 0 THEN 'neither' WHEN gap < m THEN 'high' ELSE 'low' END AS activity, count(*)::BIGINT AS n FROM g, med GROUP BY ALL
""", "quotes")  # fmt: skip
def activity_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    quotes = view(spark, sf_dir, "quotes")
    gaps = quotes.withColumn("gap", F.col("us") - F.lag("us").over(features.in_segment("symbol", "day")))
    train = gaps.join(F.broadcast(quotes.agg(F.max("day").alias("last_day")))).where("day < last_day")
    return cohorts.activity_state(train, gaps, "gap").groupBy("symbol", "activity").agg(F.count("*").alias("n"))


_CONTENT = ["event_index", "us", "event_id"]


@register("""
SELECT symbol, day, count(*)::BIGINT AS rows, bit_xor(('0x' || substr(md5(concat_ws('|', event_index, us, event_id)), 1, 15))::BIGINT) AS digest, 'struct<event_index:int,us:bigint,event_id:bigint>' AS types FROM quotes GROUP BY symbol, day
""", "quotes")  # fmt: skip
def partition_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cohorts.manifest(view(spark, sf_dir, "quotes"), ["symbol", "day"], _CONTENT)


@register("""
, days AS (SELECT DISTINCT symbol, day FROM quotes)
SELECT symbol, day, CASE symbol WHEN 'S1' THEN 'missing' ELSE 'changed' END AS problem FROM days WHERE symbol IN ('S1', 'S2')
""", "quotes")  # fmt: skip
def manifest_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stock left out and one with changed times, against the manifest of the full view."""
    quotes = view(spark, sf_dir, "quotes")
    actual = quotes.where("symbol <> 'S1'").withColumn("us", F.when(F.col("symbol") == "S2", F.col("us") + 1).otherwise(F.col("us")))
    make = lambda rows: cohorts.manifest(rows, ["symbol", "day"], _CONTENT)
    return cohorts.manifest_violations(make(quotes), make(actual), ["symbol", "day"])


@register(f"""
, r AS (SELECT *, row_number() OVER s AS k, max((event_id % 50 = 0)::INT) OVER (PARTITION BY symbol, day, segment ORDER BY event_index ROWS BETWEEN 7 PRECEDING AND CURRENT ROW) AS bad, {lead(MID, 5)} IS NULL AS open_label FROM quotes WINDOW s AS (PARTITION BY symbol, day, segment ORDER BY event_index))
SELECT symbol, day, count(*)::BIGINT AS states, count(*) FILTER (k < 8)::BIGINT AS short_or_broken, count(*) FILTER (k >= 8 AND bad = 1)::BIGINT AS nonfinite_window, count(*) FILTER (k >= 8 AND bad = 0)::BIGINT AS valid_windows,
  count(*) FILTER (k >= 8 AND bad = 0 AND event_index % 20 = 0 AND open_label)::BIGINT AS unscorable_label, count(*) FILTER (k >= 8 AND bad = 0 AND event_index % 20 = 0 AND NOT open_label)::BIGINT AS scored FROM r GROUP BY symbol, day
""", "quotes")  # fmt: skip
def window_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What becomes of every state: too few valid messages behind it, a window with a value that is no number (one in fifty
    messages has one), a stride of 20 without a label, or scored."""
    quotes = view(spark, sf_dir, "quotes").withColumn("x", F.when(F.col("event_id") % 50 == 0, float("nan")).otherwise(F.col("bid_sz_1")))
    rows = labels.offset_markouts(quotes, [5])
    return cohorts.window_funnel(features.valid_runs(rows, "true"), ["symbol", "day"], ["x"], "markout_5", 8, 20)
