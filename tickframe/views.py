"""Market views over the `events` table: quotes, trades, book deltas and order messages.

All of them use integer arithmetic and window functions, so the same SQL text runs in Spark and in DuckDB. `{micros}` is the
one expression that differs between the two.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

MICROS = {"spark": "unix_micros(CAST(ts AS TIMESTAMP))", "duckdb": "epoch_us(ts)"}

#: Quotes: one row a message, with rows that are invalid left out, so that segments have gaps.
QUOTES = """
base AS (
  SELECT event_id, user_id, event_type, value, {micros} AS us,
         concat('S', CAST(user_id % 5 AS VARCHAR(4))) AS symbol, CAST(CAST(ts AS DATE) AS VARCHAR(10)) AS day
  FROM events
), walked AS (
  SELECT *, row_number() OVER (PARTITION BY symbol, day ORDER BY us, event_id) - 1 AS event_index,
         10000 + sum((event_id * 31) % 3 - 1) OVER (PARTITION BY symbol, day ORDER BY us, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS bid_ticks
  FROM base
), valid AS (
  SELECT event_id, symbol, day, event_index, us, us * 1000 AS timestamp_ns,
         CAST(bid_ticks AS DOUBLE) / CAST(100 AS DOUBLE) AS bid_px_1, CAST(bid_ticks + 1 + event_id % 3 AS DOUBLE) / CAST(100 AS DOUBLE) AS ask_px_1,
         CAST(1 + (event_id * 7) % 17 AS DOUBLE) AS bid_sz_1, CAST(1 + (event_id * 11) % 17 AS DOUBLE) AS ask_sz_1,
         CAST(1 + (event_id * 5) % 13 AS DOUBLE) AS bid_sz_2, CAST(1 + (event_id * 3) % 13 AS DOUBLE) AS ask_sz_2
  FROM walked WHERE event_id % 23 <> 0
), broken AS (
  SELECT *, CASE WHEN event_index = lag(event_index) OVER (PARTITION BY symbol, day ORDER BY event_index) + 1 THEN 0 ELSE 1 END AS starts FROM valid
), quotes AS (
  SELECT event_id, symbol, day, event_index, us, timestamp_ns, bid_px_1, ask_px_1, bid_sz_1, ask_sz_1, bid_sz_2, ask_sz_2,
         sum(starts) OVER (PARTITION BY symbol, day ORDER BY event_index ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS segment
  FROM broken
)"""

TRADES = """
trades AS (
  SELECT event_id, {micros} AS us, concat('S', CAST(user_id % 5 AS VARCHAR(4))) AS symbol, CAST(CAST(ts AS DATE) AS VARCHAR(10)) AS day,
         CASE WHEN event_id % 2 = 0 THEN 'buy' ELSE 'sell' END AS side, value AS size
  FROM events WHERE event_type = 'purchase'
)"""

#: Changes of book levels: bids at 92 to 100, asks at 101 to 109, a size of 0 removes the level.
DELTAS = """
deltas AS (
  SELECT symbol, day, seq, us, side, px, sz FROM (
    SELECT concat('S', CAST(user_id % 5 AS VARCHAR(4))) AS symbol, CAST(CAST(ts AS DATE) AS VARCHAR(10)) AS day, {micros} AS us,
           row_number() OVER (PARTITION BY user_id % 5, CAST(ts AS DATE) ORDER BY {micros}, event_id) AS seq,
           CASE WHEN event_id % 2 = 0 THEN 'bid' ELSE 'ask' END AS side,
           CASE WHEN event_id % 2 = 0 THEN 100 - (event_id * 7) % 9 ELSE 101 + (event_id * 5) % 9 END AS px, (event_id * 13) % 6 AS sz
    FROM events) d
)"""

#: Order messages: the first message of an order a day, or after its deletion, adds it; -1 keeps the former value.
ORDERS = """
raw AS (
  SELECT concat('S', CAST(user_id % 5 AS VARCHAR(4))) AS symbol, CAST(CAST(ts AS DATE) AS VARCHAR(10)) AS day, user_id AS order_id, event_id, {micros} AS us,
         CASE WHEN event_id % 97 = 0 THEN 'F' WHEN event_type = 'error' THEN 'D' ELSE 'M' END AS kind
  FROM events
), epochs AS (
  SELECT *, sum(CASE WHEN kind = 'F' THEN 1 ELSE 0 END) OVER (PARTITION BY symbol, day ORDER BY us, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS epoch,
         row_number() OVER (PARTITION BY symbol, day ORDER BY us, event_id) - 1 AS event_index FROM raw
), placed AS (
  SELECT *, lag(kind) OVER (PARTITION BY symbol, day, epoch, order_id ORDER BY event_index) AS before FROM epochs WHERE kind <> 'F'
), kinds AS (
  SELECT symbol, day, epoch, event_index, order_id, event_id, us,
         CASE WHEN before IS NULL OR before = 'D' THEN 'A' ELSE kind END AS action FROM placed
), messages AS (
  SELECT symbol, day, epoch, event_index, order_id, us, action,
         CASE WHEN order_id % 2 = 0 THEN 1 ELSE 2 END AS side,
         CASE WHEN action = 'A' OR event_id % 3 = 0 THEN CASE WHEN order_id % 2 = 0 THEN 100 - (event_id * 7) % 9 ELSE 101 + (event_id * 5) % 9 END ELSE -1 END AS price,
         CASE WHEN action = 'A' OR event_id % 2 = 0 THEN 1 + (event_id * 13) % 7 ELSE -1 END AS volume
  FROM kinds
)"""

#: Predictions of two models (top and depth imbalance) beside the outcome five messages later, with what costs need.
#: A period is a third of a month.
SCORED = """
scored AS (
  SELECT event_id, symbol, day, segment, event_index, us, timestamp_ns, concat('P', CAST(floor((CAST(substring(day, 9, 2) AS INT) - 1) / 10.01) AS INT)) AS period,
         mid, spread / mid * 10000 AS spread_bps, p_top, p_depth, round((mid_5 / mid - 1) * 10000, 9) AS actual, spread_5 / mid_5 * 10000 AS exit_spread_bps
  FROM (
    SELECT *, (bid_px_1 + ask_px_1) / 2 AS mid, ask_px_1 - bid_px_1 AS spread,
           round((bid_sz_1 - ask_sz_1) / (bid_sz_1 + ask_sz_1), 9) AS p_top,
           round((bid_sz_1 + bid_sz_2 - ask_sz_1 - ask_sz_2) / (bid_sz_1 + bid_sz_2 + ask_sz_1 + ask_sz_2), 9) AS p_depth,
           CASE WHEN lead(event_index, 5) OVER (PARTITION BY symbol, day, segment ORDER BY event_index) = event_index + 5
                THEN lead((bid_px_1 + ask_px_1) / 2, 5) OVER (PARTITION BY symbol, day, segment ORDER BY event_index) END AS mid_5,
           CASE WHEN lead(event_index, 5) OVER (PARTITION BY symbol, day, segment ORDER BY event_index) = event_index + 5
                THEN lead(ask_px_1 - bid_px_1, 5) OVER (PARTITION BY symbol, day, segment ORDER BY event_index) END AS spread_5
    FROM quotes) q
)"""

#: A full order log, its orders named by date (days back) and id: F empties the book (the first message of a day is one), A adds, Y adds or replaces, M changes, D deletes.
#: -1 keeps the former value, and a price of 0 leaves an order without a price.
LOG = """
steps AS (
  SELECT concat('S', CAST(user_id % 5 AS VARCHAR(4))) AS symbol, CAST(CAST(ts AS DATE) AS VARCHAR(10)) AS day, event_id, {micros} AS us, event_id % 12 AS order_id, (event_id * 7) % 5 % 2 AS order_date, event_type,
         row_number() OVER (PARTITION BY user_id % 5, CAST(ts AS DATE) ORDER BY {micros}, event_id) - 1 AS event_index
  FROM events
), cleared AS (
  SELECT *, CASE WHEN event_index = 0 OR event_id % 97 = 0 THEN 'F' WHEN event_type = 'error' THEN 'D' WHEN event_id % 41 = 0 THEN 'Y' ELSE 'M' END AS kind,
         sum(CASE WHEN event_index = 0 OR event_id % 97 = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY symbol, day ORDER BY event_index ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS epoch
  FROM steps
), followed AS (
  SELECT *, lag(kind) OVER (PARTITION BY symbol, day, epoch, order_date, order_id, CASE WHEN kind = 'F' THEN 1 ELSE 0 END ORDER BY event_index) AS before FROM cleared
), named AS (
  SELECT symbol, day, event_index, event_id, us, order_date, order_id, CASE WHEN kind IN ('M', 'D') AND (before IS NULL OR before = 'D') THEN 'A' ELSE kind END AS action FROM followed
), log AS (
  SELECT symbol, day, event_index, us, order_date, order_id, action, CASE WHEN order_id % 2 = 0 THEN 1 ELSE 2 END AS side,
         CASE WHEN action = 'F' THEN -1 WHEN action IN ('A', 'Y') OR event_id % 3 = 0 THEN CASE WHEN event_id % 211 = 0 THEN 0 WHEN order_id % 2 = 0 THEN 100 - (event_id * 7) % 4 ELSE 101 + (event_id * 5) % 4 END ELSE -1 END AS price,
         CASE WHEN action = 'F' THEN -1 WHEN action IN ('A', 'Y') OR event_id % 2 = 0 THEN 1 + (event_id * 13) % 7 ELSE -1 END AS volume,
         CASE WHEN event_id % 5 = 0 THEN event_index ELSE -1 END AS priority
  FROM named
)"""

#: The views, and what each of them needs before it.
VIEWS = {"quotes": QUOTES, "trades": TRADES, "deltas": DELTAS, "messages": ORDERS, "scored": SCORED, "log": LOG}
NEEDS = {"scored": ("quotes",)}


def with_views(*names: str, engine: str = "duckdb") -> str:
    """The WITH clause that defines the named views."""
    wanted = dict.fromkeys(x for n in names for x in (*NEEDS.get(n, ()), n))
    return "WITH " + ",".join(VIEWS[n].replace("{micros}", MICROS[engine]) for n in wanted)


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A view as a DataFrame over the events table of `sf_dir`."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    return spark.sql(f"{with_views(name, engine='spark').replace('FROM events', 'FROM {events}')} SELECT * FROM {name}", events=events)
