"""Registered queries of the market track, each with the DuckDB SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tickframe.operators import book, checks, features, folds, labels, metrics, models
from tickframe.views import view, with_views

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

MINUTE = 60_000_000
HOUR = 60 * MINUTE


def register(sql: str | None, *views: str) -> Callable[[Query], Query]:
    """Adds a query; `sql` follows the WITH clause of the named views, or stands alone without views."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = f"{with_views(*views)} {sql}" if views else sql
        return f

    return add


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


ID = ("symbol", "day", "segment", "event_index")
MID = "((bid_px_1 + ask_px_1) / 2.0)"
W_SEG = "(PARTITION BY symbol, day, segment ORDER BY event_index)"


def lead(expression: str, k: int) -> str:
    return f"(CASE WHEN lead(event_index, {k}) OVER {W_SEG} = event_index + {k} THEN lead({expression}, {k}) OVER {W_SEG} END)" if k else f"({expression})"


def _marked(spark: SparkSession, sf_dir: str, horizon: int = 5) -> DataFrame:
    return labels.offset_markouts(features.quote_features(view(spark, sf_dir, "quotes")), [horizon])


IC_SQL = f"""
, marked AS (
  SELECT *, (bid_sz_1 - ask_sz_1) / (bid_sz_1 + ask_sz_1) AS p, ({lead(MID, 5)} / {MID} - 1) * 1e4 AS a FROM quotes
), clean AS (SELECT symbol, day, round(p, 9) AS p, round(a, 9) AS a FROM marked WHERE a IS NOT NULL),
ranked AS (
  SELECT *, rank() OVER (PARTITION BY symbol, day ORDER BY p) + (count(*) OVER (PARTITION BY symbol, day, p) - 1) / 2.0 AS rp,
         rank() OVER (PARTITION BY symbol, day ORDER BY a) + (count(*) OVER (PARTITION BY symbol, day, a) - 1) / 2.0 AS ra FROM clean
)
SELECT symbol, day, count(*)::BIGINT AS n, round(CASE WHEN min(p) < max(p) AND min(a) < max(a) THEN corr(rp, ra) END, 6) AS ic,
       round(avg(CASE WHEN a <> 0 THEN (sign(p) = sign(a))::INT END), 6) AS direction_accuracy, round(avg((p <> 0)::INT), 6) AS coverage,
       round(avg(abs(a)), 6) AS mean_abs_actual, round(avg(sign(p) * a), 6) AS mean_signed_net
FROM ranked GROUP BY symbol, day
"""


@register(IC_SQL, "quotes")
def imbalance_rank_correlation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per symbol and day: rank correlation of top imbalance with the five-message markout, and its companions."""
    rows = _marked(spark, sf_dir).select("symbol", "day", F.round("top_imbalance", 9).alias("p"), F.round("markout_5", 9).alias("a"))
    return rounded(metrics.score_set(rows, ["symbol", "day"], "p", "a"))


@register(f"""
SELECT symbol, day, segment, event_index, round({MID}, 6) AS mid, round((ask_px_1 - bid_px_1) / {MID} * 1e4, 6) AS spread_bps,
       round((bid_sz_1 - ask_sz_1) / (bid_sz_1 + ask_sz_1), 6) AS top_imbalance,
       round((bid_sz_1 + bid_sz_2 - ask_sz_1 - ask_sz_2) / (bid_sz_1 + bid_sz_2 + ask_sz_1 + ask_sz_2), 6) AS depth_imbalance,
       round((ask_px_1 * bid_sz_1 + bid_px_1 * ask_sz_1) / (bid_sz_1 + ask_sz_1), 6) AS microprice FROM quotes
""", "quotes")  # fmt: skip
def quote_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(features.quote_features(view(spark, sf_dir, "quotes")).select(*ID, "mid", "spread_bps", "top_imbalance", "depth_imbalance", "microprice"))


@register(f"""
SELECT symbol, count(*)::BIGINT AS rows, round(max(abs(l - r)), 6) AS max_error FROM (
  SELECT symbol, ((ask_px_1 * bid_sz_1 + bid_px_1 * ask_sz_1) / (bid_sz_1 + ask_sz_1) - {MID}) / {MID} * 1e4 AS l,
         0.5 * ((ask_px_1 - bid_px_1) / {MID} * 1e4) * ((bid_sz_1 - ask_sz_1) / (bid_sz_1 + ask_sz_1)) AS r FROM quotes) GROUP BY symbol
""", "quotes")  # fmt: skip
def microprice_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    error = F.abs(F.col("microprice_minus_mid_bps") - 0.5 * F.col("spread_bps") * F.col("top_imbalance"))
    return rounded(features.quote_features(view(spark, sf_dir, "quotes")).groupBy("symbol").agg(F.count("*").alias("rows"), F.max(error).alias("max_error")))


_FLOW = "CASE WHEN {p} {up} lag({p}) OVER {w} THEN {s} WHEN {p} = lag({p}) OVER {w} THEN {s} - lag({s}) OVER {w} WHEN {p} {down} lag({p}) OVER {w} THEN -lag({s}) OVER {w} END"


@register(f"""
SELECT symbol, day, segment, event_index, round(f, 6) AS ofi_l1, round(f / (bid_sz_1 + ask_sz_1), 6) AS ofi_l1_norm FROM (
  SELECT *, {_FLOW.format(p="bid_px_1", s="bid_sz_1", up=">", down="<", w=W_SEG)} - {_FLOW.format(p="ask_px_1", s="ask_sz_1", up="<", down=">", w=W_SEG)} AS f FROM quotes)
""", "quotes")  # fmt: skip
def order_flow_imbalance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(features.order_flow_imbalance(view(spark, sf_dir, "quotes")).select(*ID, "ofi_l1", "ofi_l1_norm"))


@register(f"""
SELECT q.event_id AS decision, round(coalesce(sum(t.size) FILTER (t.side = 'buy'), 0), 6) AS buy_size, round(coalesce(sum(t.size) FILTER (t.side = 'sell'), 0), 6) AS sell_size, count(t.side)::BIGINT AS n_trades,
       round(coalesce((coalesce(sum(t.size) FILTER (t.side = 'buy'), 0) - coalesce(sum(t.size) FILTER (t.side = 'sell'), 0)) / nullif(sum(t.size), 0), 0), 6) AS trade_imbalance
FROM quotes q LEFT JOIN trades t ON q.symbol = t.symbol AND t.us > q.us - {HOUR} AND t.us <= q.us GROUP BY q.event_id
""", "quotes", "trades")  # fmt: skip
def recent_trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(features.recent_trades(view(spark, sf_dir, "quotes"), view(spark, sf_dir, "trades"), HOUR))


@register(f"""
SELECT a.event_id, count(*)::BIGINT AS activity, round(sum(CASE WHEN b.side = 'buy' THEN b.size ELSE -b.size END) / sum(b.size), 6) AS signed_ratio
FROM trades a JOIN trades b ON a.symbol = b.symbol AND b.us >= a.us - {HOUR} AND (b.us < a.us OR b.us = a.us AND b.event_id <= a.event_id) GROUP BY a.event_id
""", "trades")  # fmt: skip
def rolling_activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(features.rolling_activity(view(spark, sf_dir, "trades"), HOUR).select("event_id", "activity", "signed_ratio"))


@register(f"""
SELECT symbol, day, segment, event_index, {", ".join(f"round(({lead(MID, h)} / {MID} - 1) * 1e4, 6) AS markout_{h}" for h in (2, 5, 10))} FROM quotes
""", "quotes")  # fmt: skip
def offset_markouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(labels.offset_markouts(view(spark, sf_dir, "quotes"), [2, 5, 10]).select(*ID, "markout_2", "markout_5", "markout_10"))


@register(f"""
SELECT symbol, day, segment, event_index, round(({lead("bid_px_1", 6)} - {lead("ask_px_1", 1)}) / {lead(MID, 1)} * 1e4, 6) AS long_bps,
       round(({lead("bid_px_1", 1)} - {lead("ask_px_1", 6)}) / {lead(MID, 1)} * 1e4, 6) AS short_bps FROM quotes
""", "quotes")  # fmt: skip
def crossed_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(labels.crossed_labels(view(spark, sf_dir, "quotes"), 5, 1).select(*ID, "long_bps", "short_bps"))


_HALF = "((ask_px_1 - bid_px_1) / 2.0)"


@register(f"""
, parts AS (SELECT symbol, ({lead(MID, 6)} - {lead(MID, 1)}) / {lead(MID, 1)} * 1e4 AS g, {lead(_HALF, 1)} / {lead(MID, 1)} * 1e4 AS h0, {lead(_HALF, 6)} / {lead(MID, 1)} * 1e4 AS h1 FROM quotes)
SELECT symbol, count(g)::BIGINT AS n, round(avg(g), 6) AS gross_bps, round(avg(h0), 6) AS entry_half_bps, round(avg(h1), 6) AS exit_half_bps,
       round(avg(g - h0 - h1), 6) AS long_crossed_bps, round(avg(-g - h0 - h1), 6) AS short_crossed_bps FROM parts GROUP BY symbol
""", "quotes")  # fmt: skip
def cost_decomposition(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = labels.cost_components(view(spark, sf_dir, "quotes"), 5, 1)
    return rounded(parts.groupBy("symbol").agg(F.count("gross_bps").alias("n"), *[F.avg(c).alias(c) for c in ("gross_bps", "entry_half_bps", "exit_half_bps", "long_crossed_bps", "short_crossed_bps")]))


@register(f"""
, futures AS (SELECT q.event_id, f.us AS future_us, round((f.bid_px_1 + f.ask_px_1) / 2.0, 6) AS future_mid, ((f.bid_px_1 + f.ask_px_1) / 2.0) / {MID.replace("bid", "q.bid").replace("ask", "q.ask")} - 1 AS m
  FROM quotes q LEFT JOIN quotes f ON f.event_id = (SELECT arg_min(x.event_id, (x.us, x.event_id)) FROM quotes x WHERE x.symbol = q.symbol AND x.us >= q.us + {HOUR}))
SELECT event_id, future_us, future_mid, round(m * 1e4, 6) AS markout_bps, sign(m)::INT AS direction FROM futures
""", "quotes")  # fmt: skip
def clock_markouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(labels.clock_markouts(view(spark, sf_dir, "quotes"), HOUR).select("event_id", "future_us", "future_mid", "markout_bps", "direction"))


@register("""
, filled AS (SELECT event_id, ask_px_1 AS p1, ask_sz_1 AS s1, ask_px_1 + 0.01 AS p2, ask_sz_2 AS s2, (bid_px_1 + ask_px_1) / 2.0 AS mid FROM quotes)
SELECT event_id, round(least(12.0, s1 + s2), 6) AS filled, round(CASE WHEN s1 + s2 >= 12.0 THEN (least(12.0, s1) * p1 + (12.0 - least(12.0, s1)) * p2) / 12.0 END, 6) AS average_px,
       round(CASE WHEN s1 + s2 >= 12.0 THEN ((least(12.0, s1) * p1 + (12.0 - least(12.0, s1)) * p2) / 12.0 / mid - 1) * 1e4 + 1.5 END, 6) AS total_bps FROM filled
""", "quotes")  # fmt: skip
def depth_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    level = lambda px, sz: F.struct(px.alias("px"), F.col(sz).alias("sz"))
    books = view(spark, sf_dir, "quotes").select("event_id", F.array(level(F.col("ask_px_1"), "ask_sz_1"), level(F.col("ask_px_1") + 0.01, "ask_sz_2")).alias("asks"), F.col("bid_px_1").alias("best_bid"), F.col("ask_px_1").alias("best_ask"))
    return rounded(labels.sweep_depth(books, 12.0, 1.5).select("event_id", "filled", "average_px", "total_bps"))


RUNS = """
, flagged AS (SELECT *, CASE WHEN event_index = lag(event_index) OVER (PARTITION BY symbol, day, segment ORDER BY event_index) + 1 THEN 0 ELSE 1 END AS b FROM quotes WHERE bid_sz_1 > 2),
runs AS (SELECT *, sum(b) OVER (PARTITION BY symbol, day, segment ORDER BY event_index ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS run_id FROM flagged)
"""


@register(RUNS + "SELECT symbol, day, segment, event_index, run_id::BIGINT AS run_id, row_number() OVER (PARTITION BY symbol, day, segment, run_id ORDER BY event_index)::INT AS run_length FROM runs", "quotes")
def valid_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.valid_runs(view(spark, sf_dir, "quotes"), "bid_sz_1 > 2").select(*ID, F.col("run_id").cast("long").alias("run_id"), "run_length")


@register("""
SELECT symbol, day, segment, event_index, total, round(first_bid, 6) AS first_bid FROM (
  SELECT *, sum(bid_sz_1) OVER w AS total, first_value(bid_px_1) OVER w AS first_bid, count(*) OVER w AS n FROM quotes
  WINDOW w AS (PARTITION BY symbol, day, segment ORDER BY event_index ROWS BETWEEN 7 PRECEDING AND CURRENT ROW)) WHERE n = 8
""", "quotes")  # fmt: skip
def causal_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = features.causal_windows(view(spark, sf_dir, "quotes"), ["bid_px_1", "bid_sz_1"], 8)
    total: Column = F.aggregate("window", F.lit(0.0), lambda a, x: a + x["bid_sz_1"])
    return rounded(rows.select(*ID, total.alias("total"), F.element_at("window", 1)["bid_px_1"].alias("first_bid")))


@register(f"""
, marked AS (SELECT symbol, (bid_sz_1 - ask_sz_1) / (bid_sz_1 + ask_sz_1) AS p, ({lead(MID, 5)} / {MID} - 1) * 1e4 AS a FROM quotes),
clean AS (SELECT symbol, round(p, 9) AS p, a FROM marked WHERE a IS NOT NULL),
edges AS (SELECT symbol, list_sort(list_distinct(quantile_cont(p, [0, 0.2, 0.4, 0.6, 0.8, 1.0]))) AS e FROM clean GROUP BY symbol),
binned AS (SELECT c.*, greatest(0, len(list_filter(e[1:len(e)-1], lambda x: x < p)) - 1) AS bin FROM clean c JOIN edges USING (symbol))
SELECT symbol, bin::INT AS bin, count(*)::BIGINT AS n, round(avg(p), 6) AS mean_prediction, round(avg(a), 6) AS mean_actual FROM binned GROUP BY symbol, bin
""", "quotes")  # fmt: skip
def quantile_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _marked(spark, sf_dir).select("symbol", F.round("top_imbalance", 9).alias("p"), F.col("markout_5").alias("a"))
    return rounded(metrics.bucket_table(rows, ["symbol"], "p", "a", 5))


@register("""
, gaps AS (SELECT symbol, us - lag(us) OVER (PARTITION BY symbol, day ORDER BY event_index) AS g FROM quotes)
SELECT symbol, count(g) FILTER (g >= 0)::BIGINT AS valid, (count(*) - count(g) FILTER (g >= 0))::BIGINT AS invalid, count(*) FILTER (g = 0)::BIGINT AS zeros,
       round(quantile_cont(g::DOUBLE, 0.1), 3) AS p10, round(quantile_cont(g::DOUBLE, 0.5), 3) AS p50, round(quantile_cont(g::DOUBLE, 0.9), 3) AS p90, round(quantile_cont(g::DOUBLE, 0.99), 3) AS p99 FROM gaps GROUP BY symbol
""", "quotes")  # fmt: skip
def time_gap_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    gaps = view(spark, sf_dir, "quotes").withColumn("g", F.col("us") - F.lag("us").over(features.in_segment("symbol", "day")))
    return rounded(metrics.time_summary(gaps, ["symbol"], "g"), 3)


@register("""
, cells AS (SELECT symbol, day, avg(bid_sz_1) AS v FROM quotes WHERE NOT (symbol = 'S1' AND day LIKE '%-05') GROUP BY symbol, day),
grid AS (SELECT s.symbol, d.day FROM (SELECT DISTINCT symbol FROM quotes) s CROSS JOIN (SELECT DISTINCT day FROM quotes) d)
SELECT symbol, count(*)::BIGINT AS expected, count(v)::BIGINT AS defined, round(CASE WHEN count(v) = count(*) THEN avg(v) END, 6) AS strict_mean, round(avg(v), 6) AS available_mean
FROM grid LEFT JOIN cells USING (symbol, day) GROUP BY symbol
""", "quotes")  # fmt: skip
def strict_cell_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    quotes = view(spark, sf_dir, "quotes")
    grid = quotes.select("symbol").distinct().join(F.broadcast(quotes.select("day").distinct()))
    cells = quotes.where("NOT (symbol = 'S1' AND day LIKE '%-05')").groupBy("symbol", "day").agg(F.avg("bid_sz_1").alias("v"))
    return rounded(metrics.strict_mean(cells, grid, ["symbol"], ["day"], "v"))


_PAIRED = """
, cells AS (SELECT symbol, day, CASE WHEN event_index % 2 = 0 THEN 'even' ELSE 'odd' END AS arm, avg(bid_sz_1) AS v FROM quotes GROUP BY ALL),
deltas AS (SELECT a.symbol, a.day, a.v - b.v AS delta FROM cells a JOIN cells b ON a.symbol = b.symbol AND a.day = b.day AND a.arm = 'even' AND b.arm = 'odd')
"""


def _deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    arm = F.when(F.col("event_index") % 2 == 0, "even").otherwise("odd").alias("arm")
    return metrics.paired(view(spark, sf_dir, "quotes").groupBy("symbol", "day", arm).agg(F.avg("bid_sz_1").alias("v")), ["symbol", "day"], "arm", "even", "odd", "v")


@register(_PAIRED + "SELECT symbol, count(*)::BIGINT AS blocks, round(avg(delta), 6) AS mean_delta, round(median(delta), 6) AS median_delta, count(*) FILTER (delta > 0)::BIGINT AS wins FROM deltas GROUP BY symbol", "quotes")
def paired_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_deltas(spark, sf_dir).groupBy("symbol").agg(F.count("*").alias("blocks"), F.avg("delta").alias("mean_delta"), F.expr("percentile(delta, 0.5)").alias("median_delta"), F.count_if(F.col("delta") > 0).alias("wins")))


@register(_PAIRED + "SELECT s.symbol, round(avg(d.delta), 6) AS mean_without FROM (SELECT DISTINCT symbol FROM deltas) s JOIN deltas d ON s.symbol <> d.symbol GROUP BY s.symbol", "quotes")
def leave_one_symbol_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.leave_one_out(_deltas(spark, sf_dir), "symbol"))


@register("""
, days AS (SELECT day, row_number() OVER (ORDER BY day) AS n FROM (SELECT DISTINCT day FROM quotes)),
folds AS (SELECT t.day AS fold, d.day, CASE WHEN d.n < t.n THEN 'train' ELSE 'test' END AS part FROM days t JOIN days d ON d.n <= t.n WHERE t.n >= 2)
SELECT fold, part, count(*)::BIGINT AS rows FROM folds JOIN quotes USING (day) GROUP BY fold, part
""", "quotes")  # fmt: skip
def day_fold_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    quotes = view(spark, sf_dir, "quotes")
    per_day = quotes.groupBy("day").agg(F.count("*").alias("n"))
    return folds.day_folds(quotes).join(per_day, "day").groupBy("fold", "part").agg(F.sum("n").alias("rows"))


@register("""
SELECT symbol, day, event_id FROM quotes QUALIFY row_number() OVER (PARTITION BY symbol, day ORDER BY md5('1:' || event_id::VARCHAR), event_id) <= 5
""", "quotes")  # fmt: skip
def quota_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five rows a stock-day: the limit is the operator."""
    return folds.quota_sample(view(spark, sf_dir, "quotes"), ["symbol", "day"], ["event_id"], 5).select("symbol", "day", "event_id")


@register("""
, a AS (SELECT *, row_number() OVER (PARTITION BY symbol, day ORDER BY event_id) AS n FROM quotes),
b AS (SELECT symbol, day, bid_sz_1 AS shuffled, row_number() OVER (PARTITION BY symbol, day ORDER BY md5('1:' || event_id::VARCHAR), event_id) AS n FROM quotes)
SELECT event_id, bid_sz_1, shuffled FROM a JOIN b USING (symbol, day, n)
""", "quotes")  # fmt: skip
def permuted_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return folds.permute_labels(view(spark, sf_dir, "quotes"), ["symbol", "day"], ["event_id"], "bid_sz_1").select("event_id", "bid_sz_1", "shuffled")


@register(f"""
, x AS (SELECT symbol, (bid_sz_1 - ask_sz_1) / (bid_sz_1 + ask_sz_1) AS p, ({lead(MID, 5)} / {MID} - 1) * 1e4 AS a FROM quotes), c AS (SELECT * FROM x WHERE a IS NOT NULL)
SELECT symbol, count(*)::BIGINT AS n, round(regr_intercept(a, p), 4) AS intercept, round(regr_slope(a, p), 4) AS slope FROM c GROUP BY symbol
""", "quotes")  # fmt: skip
def ridge_by_symbol(spark: SparkSession, sf_dir: str) -> DataFrame:
    fitted = models.fit_ridge(_marked(spark, sf_dir).select("symbol", "top_imbalance", "markout_5"), "symbol", ["top_imbalance"], "markout_5")
    return fitted.select("symbol", "n", F.round("intercept", 4).alias("intercept"), F.round(F.element_at("weights", 1), 4).alias("slope"))


_LEVELS = """
, versions AS (SELECT *, lead(seq) OVER (PARTITION BY symbol, day, side, px ORDER BY seq) AS until FROM deltas),
live AS (SELECT d.symbol, d.day, d.seq, v.side, v.px, v.sz FROM deltas d JOIN versions v ON d.symbol = v.symbol AND d.day = v.day AND v.seq <= d.seq AND (v.until IS NULL OR v.until > d.seq) WHERE v.sz > 0)
SELECT d.symbol, d.day, d.seq, max(l.px) FILTER (l.side = 'bid') AS best_bid, arg_max(l.sz, l.px) FILTER (l.side = 'bid') AS bid_size, min(l.px) FILTER (l.side = 'ask') AS best_ask, arg_min(l.sz, l.px) FILTER (l.side = 'ask') AS ask_size,
       count(l.px) FILTER (l.side = 'bid')::BIGINT AS bid_levels, count(l.px) FILTER (l.side = 'ask')::BIGINT AS ask_levels
FROM deltas d LEFT JOIN live l USING (symbol, day, seq) GROUP BY d.symbol, d.day, d.seq
"""


@register(_LEVELS, "deltas")
def book_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    return book.replay_levels(view(spark, sf_dir, "deltas"))


_VERSIONS = """
, lives AS (SELECT *, coalesce(sum((action = 'D')::INT) OVER (PARTITION BY symbol, day, epoch, order_id ORDER BY event_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS life FROM messages),
filled AS (SELECT *, last_value(nullif(price, -1) IGNORE NULLS) OVER w AS price_now, last_value(nullif(volume, -1) IGNORE NULLS) OVER w AS volume_now FROM lives
  WINDOW w AS (PARTITION BY symbol, day, epoch, order_id, life ORDER BY event_index ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
v AS (SELECT *, lag(price_now) OVER w AS price_before, lag(volume_now) OVER w AS volume_before FROM filled WINDOW w AS (PARTITION BY symbol, day, epoch, order_id, life ORDER BY event_index))
"""


@register(_VERSIONS + "SELECT symbol, day, event_index, order_id, action, price_now, volume_now, price_before, volume_before FROM v", "messages")
def order_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return book.order_versions(view(spark, sf_dir, "messages")).select("symbol", "day", "event_index", "order_id", "action", "price_now", "volume_now", "price_before", "volume_before")


@register(_VERSIONS + """
, changes AS (SELECT symbol, day, epoch, event_index, side, price_now AS price, volume_now AS c FROM v WHERE action <> 'D' UNION ALL SELECT symbol, day, epoch, event_index, side, price_before, -volume_before FROM v WHERE price_before IS NOT NULL),
net AS (SELECT symbol, day, epoch, event_index, side, price, sum(c) AS c FROM changes GROUP BY ALL)
SELECT symbol, day, epoch::BIGINT AS epoch, event_index, side, price, (sum(c) OVER (PARTITION BY symbol, day, epoch, side, price ORDER BY event_index))::BIGINT AS quantity FROM net
""", "messages")  # fmt: skip
def level_quantities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return book.level_quantities(view(spark, sf_dir, "messages"))


@register("SELECT symbol, day, event_index, (sum(CASE action WHEN 'A' THEN 1 WHEN 'D' THEN -1 ELSE 0 END) OVER (PARTITION BY symbol, day, epoch ORDER BY event_index))::BIGINT AS live_orders FROM messages", "messages")
def live_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return book.live_orders(view(spark, sf_dir, "messages")).select("symbol", "day", "event_index", "live_orders")


@register("SELECT symbol, day, event_index FROM (SELECT *, lag(event_index) OVER (PARTITION BY symbol, day ORDER BY event_index) AS f FROM quotes) WHERE event_index <> f + 1", "quotes")
def index_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checks.gaps(view(spark, sf_dir, "quotes")).select("symbol", "day", "event_index")


@register("SELECT l_orderkey, count(*)::BIGINT AS times FROM lineitem GROUP BY l_orderkey HAVING count(*) > 1")
def duplicate_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checks.duplicates(spark.read.parquet(f"{sf_dir}/lineitem.parquet"), ["l_orderkey"])


@register("""
, seen AS (SELECT DISTINCT symbol, day FROM trades WHERE symbol <> 'S3'), grid AS (SELECT s.symbol, d.day FROM (SELECT DISTINCT symbol FROM quotes WHERE symbol <> 'S4') s CROSS JOIN (SELECT DISTINCT day FROM quotes) d)
SELECT symbol, day, 'missing' AS problem FROM grid ANTI JOIN seen USING (symbol, day) UNION ALL SELECT symbol, day, 'unexpected' FROM seen ANTI JOIN grid USING (symbol, day)
""", "quotes", "trades")  # fmt: skip
def denominator_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The expected grid lacks one stock that was seen, and one that it expects was not."""
    quotes = view(spark, sf_dir, "quotes")
    grid = quotes.where("symbol <> 'S4'").select("symbol").distinct().join(F.broadcast(quotes.select("day").distinct()))
    return checks.grid_difference(grid, view(spark, sf_dir, "trades").where("symbol <> 'S3'"), ["symbol", "day"])


@register(f"""
, m AS (SELECT symbol, day, event_id, ({lead(MID, 5)} / {MID} - 1) * 1e4 AS a FROM quotes)
SELECT symbol, day, count(*)::BIGINT AS rows, count(*) FILTER (event_id % 31 = 0)::BIGINT AS nonfinite, count(*) FILTER (a IS NULL AND event_id % 31 <> 0)::BIGINT AS label_only, count(a) FILTER (event_id % 31 <> 0)::BIGINT AS eligible FROM m GROUP BY symbol, day
""", "quotes")  # fmt: skip
def eligibility_funnel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every 31st row has a feature that is no finite number."""
    rows = _marked(spark, sf_dir).withColumn("spread_bps", F.when(F.col("event_id") % 62 == 0, F.lit(float("inf"))).when(F.col("event_id") % 31 == 0, F.lit(float("nan"))).otherwise(F.col("spread_bps")))
    return checks.funnel(rows, ["symbol", "day"], ["top_imbalance", "spread_bps"], "markout_5")


@register("""
SELECT symbol, day, count(*)::BIGINT AS n, round(avg(ask_px_1 - bid_px_1), 6) AS mean_spread FROM quotes GROUP BY GROUPING SETS ((symbol, day), (symbol), ())
""", "quotes")  # fmt: skip
def grouping_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = view(spark, sf_dir, "quotes")
    return rounded(rows.rollup("symbol", "day").agg(F.count("*").alias("n"), F.avg(F.col("ask_px_1") - F.col("bid_px_1")).alias("mean_spread")))
