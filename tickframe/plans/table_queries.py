"""Registered queries on tables: sources and sinks, coercion, declared joins, folds, checks and model runs."""

from __future__ import annotations

from collections.abc import Sequence
from functools import partial, reduce

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickframe.functions import columns
from tickframe.operators import baseline, checks, cohorts, features, folds, joins, labels, models
from tickframe.plans.queries import HOUR, MID, lead, register, rounded
from tickframe.sources import tables
from tickframe.views import view

# ---- sources and sinks

_ROW = ["event_index", "segment", "us", "bid_px_1", "ask_px_1"]


@register("SELECT symbol, day, event_index, round(bid_px_1, 6) AS bid_px_1, round(ask_px_1, 6) AS ask_px_1 FROM quotes WHERE symbol = 'S1' AND day >= '2024-01-10'", "quotes")
def partitioned_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quotes written by stock and day and read back: only the folders and columns that are asked for. One day is written
    twice, which replaces it."""
    path = tables.work_folder(spark, "quotes")
    quotes = view(spark, sf_dir, "quotes").select("symbol", "day", *_ROW)
    tables.write_partitions(quotes, path)
    tables.write_partitions(quotes.where("day = '2024-01-12'"), path)
    return rounded(tables.read_partitions(spark, path, quotes.schema, ["symbol", "day", "event_index", "bid_px_1", "ask_px_1"], "symbol = 'S1' AND day >= '2024-01-10'"))


@register("SELECT symbol, count(*)::BIGINT AS rows, round(avg(bid_px_1), 6) AS mean_bid FROM quotes WHERE symbol <> 'S3' GROUP BY symbol", "quotes")
def gated_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A scan that its manifest lets pass."""
    quotes = view(spark, sf_dir, "quotes")
    path = tables.work_folder(spark, "gated")
    tables.write_partitions(quotes.where("symbol <> 'S3'").select("symbol", "day", *_ROW), path)
    rows = spark.read.parquet(path)
    declared = cohorts.manifest(quotes.where("symbol <> 'S3'"), ["symbol", "day"], _ROW[:3])
    return rounded(tables.gated(rows, declared, ["symbol", "day"], _ROW[:3]).groupBy("symbol").agg(F.count("*").alias("rows"), F.avg("bid_px_1").alias("mean_bid")))


@register("SELECT symbol, day, count(*)::BIGINT AS rows, round(max(ask_px_1), 6) AS high FROM quotes GROUP BY symbol, day", "quotes")
def csv_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = tables.work_folder(spark, "csv")
    view(spark, sf_dir, "quotes").groupBy("symbol", "day").agg(F.count("*").alias("rows"), F.round(F.max("ask_px_1"), 6).alias("high")).write.option("header", True).csv(path)
    return spark.read.schema("symbol string, day string, rows long, high double").option("header", True).csv(path)


@register("SELECT symbol, count(*)::BIGINT AS rows, CASE WHEN symbol <> 'S2' THEN round(avg(ask_px_1 - bid_px_1), 6) END AS mean_spread FROM quotes GROUP BY symbol", "quotes")
def json_receipts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Receipts as JSON; a NaN (the stock S2 has one) is written as null."""
    path = tables.work_folder(spark, "json")
    mean = F.when(F.col("symbol") == "S2", F.lit(float("nan"))).otherwise(F.round(F.avg(F.col("ask_px_1") - F.col("bid_px_1")), 6))
    tables.write_json(view(spark, sf_dir, "quotes").groupBy("symbol").agg(F.count("*").alias("rows"), mean.alias("mean_spread")), path)
    return spark.read.schema("mean_spread double, rows long, symbol string").json(path)


@register("SELECT 'top' AS model, symbol, day, event_index, p_top AS prediction, actual FROM scored WHERE actual IS NOT NULL AND period = 'P1'", "scored")
def prediction_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predictions of two models and all periods, stored by model and period; one of each is read."""
    path = tables.work_folder(spark, "predictions")
    rows = view(spark, sf_dir, "scored").where("actual IS NOT NULL")
    of = lambda name, p: rows.select(F.lit(name).alias("model"), "period", "symbol", "day", "event_index", F.col(p).alias("prediction"), "actual")
    stored = of("top", "p_top").union(of("depth", "p_depth"))
    tables.write_partitions(stored, path, ["model", "period"])
    return tables.read_partitions(spark, path, stored.schema, ["model", "symbol", "day", "event_index", "prediction", "actual"], "model = 'top' AND period = 'P1'")


@register("SELECT count(DISTINCT symbol || day)::BIGINT AS partitions, count(*)::BIGINT AS rows, min(day) AS first_day, max(day) AS last_day FROM quotes", "quotes")
def preparation_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a preparation run reports of its rows, taken while they are written."""
    quotes = view(spark, sf_dir, "quotes").select("symbol", "day", *_ROW)
    found = tables.write_with_totals(quotes, tables.work_folder(spark, "totals"), {"rows": F.count("*"), "first_day": F.min("day"), "last_day": F.max("day")})
    return spark.createDataFrame([tuple(found[n] for n in ("partitions", "rows", "first_day", "last_day"))], "partitions long, rows long, first_day string, last_day string")


_DIGEST = "sum(('0x' || substr(md5(concat_ws(':', place, event_id, us, bid_px_1::VARCHAR)), 1, 15))::HUGEINT)::VARCHAR"


@register(f"""
, f AS (SELECT *, row_number() OVER (ORDER BY us, event_id) - 1 AS place FROM quotes), b AS (SELECT *, row_number() OVER (ORDER BY us DESC, event_id DESC) - 1 AS place FROM quotes)
SELECT 'forward' AS name, count(*)::BIGINT AS rows, {_DIGEST} AS digest FROM f UNION ALL SELECT 'backward', count(*)::BIGINT, {_DIGEST} FROM b
""", "quotes")  # fmt: skip
def ordered_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same rows in two orders have two digests."""
    quotes, content = view(spark, sf_dir, "quotes"), ["event_id", "us", "bid_px_1"]
    forward = checks.ordered_digest(quotes, ["us", "event_id"], content).withColumn("name", F.lit("forward"))
    return forward.unionByName(checks.ordered_digest(quotes, [-F.col("us"), -F.col("event_id")], content).withColumn("name", F.lit("backward")))


# ---- coercion, units and per-row checks


@register("""
SELECT event_id, CASE WHEN event_id % 4 <> 0 THEN event_id / 8.0 END AS amount, CASE WHEN event_id % 5 <> 0 THEN epoch_us(ts) END AS us FROM events
""")  # fmt: skip
def coerced_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts as numbers and times; what is none is NULL."""
    texts = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", F.expr("IF(event_id % 4 = 0, 'n/a', CAST(event_id / 8D AS STRING))").alias("a"), F.expr("IF(event_id % 5 = 0, 'soon', CAST(CAST(ts AS TIMESTAMP) AS STRING))").alias("t"))
    return texts.select("event_id", tables.number("a").alias("amount"), tables.instant("t").alias("us"))


@register("""
SELECT symbol, day, seq, side, px * 100 AS px_units, floor(sz / 0.5 / 3 + 0.5)::BIGINT AS sz_units FROM deltas
""", "deltas")  # fmt: skip
def normalised_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sides in any spelling and decimal prices and sizes, as bid or ask and whole ticks and lots."""
    d = view(spark, sf_dir, "deltas").withColumn("side", F.expr("CASE WHEN side = 'bid' THEN element_at(array('bid', 'BUY', 'bids'), CAST(seq % 3 AS INT) + 1) ELSE element_at(array('ask', 'Sell', 'asks'), CAST(seq % 3 AS INT) + 1) END"))
    return d.select("symbol", "day", "seq", columns.side_name("side").alias("side"), columns.units(F.col("px"), "0.01").alias("px_units"), columns.units(F.col("sz"), "1.5").alias("sz_units"))


@register("""
, x AS (SELECT event_id, symbol, CASE WHEN event_id % 29 = 0 THEN 0 ELSE bid_sz_1 END AS b, CASE WHEN event_id % 29 = 0 THEN 0 ELSE ask_sz_1 END AS a, bid_px_1, ask_px_1 FROM quotes)
SELECT event_id, round((b - a) / (b + a), 6) AS top_imbalance, round((ask_px_1 - bid_px_1) / ((bid_px_1 + ask_px_1) / 2) * 1e4, 6) AS spread_bps FROM x WHERE b + a > 0 AND event_id % 31 <> 0
""", "quotes")  # fmt: skip
def finite_study_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features without a guard: 0 / 0 is NULL. Rows with a NULL, a NaN or an infinity go."""
    q = view(spark, sf_dir, "quotes").withColumns({s: F.when(F.col("event_id") % 29 == 0, 0.0).otherwise(F.col(s)) for s in ("bid_sz_1", "ask_sz_1")})
    spread = F.when(F.col("event_id") % 62 == 0, F.lit(float("inf"))).when(F.col("event_id") % 31 == 0, F.lit(float("nan"))).otherwise(columns.spread_bps())
    made = q.select("event_id", columns.imbalance(F.col("bid_sz_1"), F.col("ask_sz_1"), guarded=False).alias("top_imbalance"), spread.alias("spread_bps"))
    return rounded(made.where(columns.finite("top_imbalance") & columns.finite("spread_bps")))


@register("""
SELECT symbol, sum(n1)::BIGINT AS f1, sum(n2)::BIGINT AS f2, sum(n3)::BIGINT AS f3 FROM (SELECT symbol, (event_id % 29 <> 0)::INT AS n1, (event_id % 29 <> 0)::INT AS n2, (event_id % 29 <> 0 AND actual IS NOT NULL)::INT AS n3 FROM scored) GROUP BY symbol
""", "scored")  # fmt: skip
def feature_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows with every feature of each nested group."""
    rows = view(spark, sf_dir, "scored").withColumn("p_top", F.when(F.col("event_id") % 29 != 0, F.col("p_top")))
    return rows.groupBy("symbol").agg(*[F.count_if(joins.all_defined(own)).alias(name) for name, own in features.GROUPS.items()])


@register("""
, l AS (SELECT *, CASE WHEN event_id % 7 = 0 THEN NULL ELSE bid_sz_2 END AS b2 FROM quotes)
SELECT event_id, bid_sz_1 + coalesce(b2, 0) AS bid_depth, ask_sz_1 + ask_sz_2 AS ask_depth, round((bid_sz_1 + coalesce(b2, 0) - ask_sz_1 - ask_sz_2) / (bid_sz_1 + coalesce(b2, 0) + ask_sz_1 + ask_sz_2), 6) AS depth_imbalance FROM l
""", "quotes")  # fmt: skip
def depth_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Depth of level arrays; a missing level counts as 0, and no level at all is an error."""
    level = lambda px, sz: F.struct(px.alias("px"), sz.alias("sz"))
    second = F.when(F.col("event_id") % 7 != 0, F.col("bid_sz_2"))
    books = view(spark, sf_dir, "quotes").select("event_id", F.array(level(F.col("bid_px_1"), F.col("bid_sz_1")), level(F.col("bid_px_1") - 0.01, second)).alias("bids"), F.array(level(F.col("ask_px_1"), F.col("ask_sz_1")), level(F.col("ask_px_1") + 0.01, F.col("ask_sz_2"))).alias("asks"))
    return rounded(features.level_depths(books, 3).select("event_id", "bid_depth", "ask_depth", "depth_imbalance"))


# ---- joins


@register("""
SELECT s.event_id, round(bid_px_1, 6) AS bid_px_1 FROM scored s LEFT JOIN (SELECT * FROM quotes WHERE event_id % 3 <> 0) q ON s.event_id = q.event_id
""", "scored")  # fmt: skip
def quotes_at_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A left join that is one to one on the identity, or an error; predictions without a quote stay."""
    quotes = view(spark, sf_dir, "quotes").where("event_id % 3 <> 0").select("event_id", "bid_px_1")
    return rounded(joins.declared_join(view(spark, sf_dir, "scored").select("event_id"), quotes, ["event_id"], "one_to_one", "left"))


@register("""
, d AS (SELECT symbol, day, avg(ask_px_1 - bid_px_1) AS day_spread FROM quotes WHERE symbol <> 'S4' GROUP BY ALL) SELECT event_id, round(day_spread, 6) AS day_spread FROM quotes JOIN d USING (symbol, day)
""", "quotes")  # fmt: skip
def day_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An inner join, many to one as declared."""
    quotes = view(spark, sf_dir, "quotes")
    per_day = quotes.where("symbol <> 'S4'").groupBy("symbol", "day").agg(F.avg(F.col("ask_px_1") - F.col("bid_px_1")).alias("day_spread"))
    return rounded(joins.declared_join(quotes.select("symbol", "day", "event_id"), per_day, ["symbol", "day"], "many_to_one").select("event_id", "day_spread"))


@register("""
, m AS (SELECT symbol, day, 'top' AS model, count(*) AS n FROM scored GROUP BY ALL UNION ALL SELECT symbol, day, 'depth', count(*) FROM scored WHERE day <> '2024-01-05' AND symbol <> 'S2' GROUP BY ALL)
SELECT symbol, day, model, n::BIGINT AS n FROM m WHERE (symbol, day) IN (SELECT (symbol, day) FROM m WHERE model = 'depth')
""", "scored")  # fmt: skip
def common_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks of every model in which the second model is there, too."""
    rows = view(spark, sf_dir, "scored").groupBy("symbol", "day").agg(F.count("*").alias("n"))
    both = rows.withColumn("model", F.lit("top")).unionByName(rows.where("day <> '2024-01-05' AND symbol <> 'S2'").withColumn("model", F.lit("depth")))
    return joins.common_blocks(both, ["symbol", "day"], "model", "depth").select("symbol", "day", "model", "n")


@register("""
SELECT event_id, CASE WHEN event_id % 19 = 0 THEN 'only in one' WHEN event_id % 17 = 0 THEN 'only in other' ELSE 'label' END AS problem FROM scored
WHERE event_id % 19 = 0 AND event_id % 17 <> 0 OR event_id % 17 = 0 AND event_id % 19 <> 0 OR event_id % 19 <> 0 AND event_id % 17 <> 0 AND event_id % 13 = 0 AND actual IS NOT NULL
""", "scored")  # fmt: skip
def misaligned_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two prediction sets: rows that one of them lacks, and labels that differ (a NULL equals a NULL)."""
    rows = view(spark, sf_dir, "scored").select("event_id", "actual")
    other = rows.where("event_id % 19 <> 0").withColumn("actual", F.when(F.col("event_id") % 13 == 0, F.col("actual") + 1).otherwise(F.col("actual")))
    return joins.misaligned(rows.where("event_id % 17 <> 0"), other, ["event_id"], "actual")


@register("""
, p AS (SELECT symbol, day, event_index AS placement FROM quotes WHERE event_index % 10 = 0)
SELECT symbol, day, placement, k::INT AS "offset", round(q.bid_px_1, 6) AS next_bid_px_1 FROM p CROSS JOIN range(1, 5) r(k) LEFT JOIN quotes q USING (symbol, day) WHERE q.event_index = placement + k
UNION ALL SELECT symbol, day, placement, k::INT, NULL FROM p CROSS JOIN range(1, 5) r(k) WHERE NOT EXISTS (SELECT 1 FROM quotes q WHERE q.symbol = p.symbol AND q.day = p.day AND q.event_index = placement + k)
""", "quotes")  # fmt: skip
def look_ahead(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every tenth message beside the next four, whether they are there or not."""
    quotes = view(spark, sf_dir, "quotes")
    placed = quotes.where("event_index % 10 = 0").select("symbol", "day", F.col("event_index").alias("placement"))
    return rounded(joins.look_ahead(placed, quotes, ["symbol", "day"], 4, ["bid_px_1"]))


# ---- windows and labels


@register("SELECT event_id, timestamp_ns - lag(timestamp_ns, 7) OVER (PARTITION BY symbol, day ORDER BY event_index) AS duration_ns FROM quotes", "quotes")
def window_durations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labels.window_duration(view(spark, sf_dir, "quotes"), 8).select("event_id", "duration_ns")


@register(f"SELECT event_id, round(({lead('timestamp_ns', 5)} - timestamp_ns) / 1e9, 6) AS clock_s FROM quotes", "quotes")
def exact_clock(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(labels.exact_clock(view(spark, sf_dir, "quotes"), 5).select("event_id", "clock_s"))


@register("""
, f AS (SELECT event_id, side, CASE side WHEN 'buy' THEN 1 ELSE -1 END AS s, CASE side WHEN 'buy' THEN ask_px_1 ELSE bid_px_1 END AS p1, CASE side WHEN 'buy' THEN ask_sz_1 ELSE bid_sz_1 END AS s1, CASE side WHEN 'buy' THEN ask_px_1 + 0.01 ELSE bid_px_1 - 0.01 END AS p2, CASE side WHEN 'buy' THEN ask_sz_2 ELSE bid_sz_2 END AS s2,
  (bid_px_1 + ask_px_1) / 2.0 AS mid, (ask_px_1 - bid_px_1) / ((bid_px_1 + ask_px_1) / 2.0) * 1e4 / 2 AS half FROM quotes CROSS JOIN (SELECT unnest(['buy', 'sell']) AS side)),
a AS (SELECT *, CASE WHEN s1 + s2 >= 12 THEN (least(12.0, s1) * p1 + (12.0 - least(12.0, s1)) * p2) / 12.0 END AS v FROM f)
SELECT event_id, side, round(v, 6) AS average_px, round(CASE WHEN v IS NOT NULL THEN half END, 6) AS spread_bps, round(CASE WHEN v IS NOT NULL THEN greatest(0, s * (v - mid) / mid * 1e4 - half) END, 6) AS depth_bps, round(s * (v - mid) / mid * 1e4 + 1.5, 6) AS total_bps FROM a
""", "quotes")  # fmt: skip
def depth_sweeps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Costs of buying and of selling a size of 12 through two levels."""
    level = lambda px, sz: F.struct(px.alias("px"), F.col(sz).alias("sz"))
    books = view(spark, sf_dir, "quotes").select("event_id", F.array(level(F.col("ask_px_1") + 0.01, "ask_sz_2"), level(F.col("ask_px_1"), "ask_sz_1")).alias("asks"), F.array(level(F.col("bid_px_1"), "bid_sz_1"), level(F.col("bid_px_1") - 0.01, "bid_sz_2")).alias("bids"), F.col("bid_px_1").alias("best_bid"), F.col("ask_px_1").alias("best_ask"))
    side = lambda s: labels.sweep_depth(books, 12.0, 1.5, s).select("event_id", F.lit(s).alias("side"), "average_px", "spread_bps", "depth_bps", "total_bps")
    return rounded(side("buy").union(side("sell")))


@register(f"""
, k AS (SELECT symbol, day, {" AND ".join(f"{lead(MID, k)} IS NOT NULL" for k in (1, 5, 6, 10, 11))} AND event_id % 37 <> 0 AS common FROM quotes)
SELECT symbol, day, count(*)::BIGINT AS rows, count(*) FILTER (common)::BIGINT AS common FROM k GROUP BY symbol, day
""", "quotes")  # fmt: skip
def common_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that every delay, horizon and model can use."""
    rows = view(spark, sf_dir, "quotes").withColumn("p", F.when(F.col("event_id") % 37 != 0, F.col("bid_sz_1")))
    return labels.common_rows(rows, [5, 10], [0, 1], ["p"]).groupBy("symbol", "day").agg(F.count("*").alias("rows"), F.count_if("common").alias("common"))


@register("""
SELECT 'actual' AS "column", count(*)::BIGINT AS rows, max(CASE WHEN actual IS NOT NULL THEN CASE WHEN event_id % 101 = 0 THEN 0.5 ELSE 0.0 END END)::DOUBLE AS max_difference, count(*) FILTER (event_id % 101 = 0 AND actual IS NOT NULL)::BIGINT AS violations FROM scored
""", "scored")  # fmt: skip
def label_rebuild(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored labels against labels made anew from quotes; every 101st stored one is off by a half."""
    stored = view(spark, sf_dir, "scored").select("event_id", F.when(F.col("event_id") % 101 == 0, F.col("actual") + 0.5).otherwise(F.col("actual")).alias("actual"))
    fresh = labels.offset_markouts(view(spark, sf_dir, "quotes"), [5]).select("event_id", F.round("markout_5", 9).alias("actual"))
    return checks.table_difference(stored, fresh, ["event_id"], ["actual"], 1e-6).withColumn("max_difference", F.round("max_difference", 6))


# ---- folds


@register("""
, d AS (SELECT DISTINCT period, day FROM scored), p AS (SELECT period, (SELECT count(DISTINCT day) FROM d x WHERE x.day < min(d.day)) AS prior FROM d GROUP BY period)
SELECT t AS target, min(period) AS fold, min(period) <> t AS substituted FROM (SELECT unnest(['P0', 'P1', 'P2', 'P3']) AS t) JOIN p ON period >= t AND prior >= 15 GROUP BY t
""", "scored")  # fmt: skip
def period_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each target period, or the next one with 15 days before it."""
    return folds.period_folds(view(spark, sf_dir, "scored").select("period", "day"), ["P0", "P1", "P2", "P3"], 15)


@register("SELECT symbol, CASE WHEN day < '2024-01-20' THEN 'train' ELSE 'test' END AS part, count(*)::BIGINT AS rows FROM scored GROUP BY ALL", "scored")
def fixed_cutoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = view(spark, sf_dir, "scored")
    return folds.fixed_cutoff(rows, rows.select("symbol", "day").distinct(), ["symbol", "day"], "2024-01-20").groupBy("symbol", "part").agg(F.count("*").alias("rows"))


@register("""
SELECT CASE period WHEN 'P0' THEN 'train' WHEN 'P1' THEN 'dev' ELSE 'eval' END AS part, NULL::VARCHAR AS fit_through, count(*)::BIGINT AS rows FROM scored WHERE period IN ('P0', 'P1', 'P2') GROUP BY ALL
UNION ALL SELECT 'refit ' || b.period, max(a.period), NULL FROM (SELECT DISTINCT period FROM scored) a JOIN (SELECT DISTINCT period FROM scored) b ON a.period < b.period GROUP BY b.period
""", "scored")  # fmt: skip
def period_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows by part, and for each period the last one that its model is fitted on."""
    rows = view(spark, sf_dir, "scored")
    parts = folds.period_parts(rows, ["P0"], ["P1"], ["P2"]).groupBy("part").agg(F.lit(None).cast("string").alias("fit_through"), F.count("*").alias("rows"))
    return parts.union(folds.rolling_refits(rows).select(F.concat(F.lit("refit "), "apply_to"), "fit_through", F.lit(None).cast("long")))


@register("""
, q AS (SELECT * FROM quotes QUALIFY row_number() OVER (PARTITION BY symbol, day ORDER BY md5('1:' || event_id::VARCHAR), event_id) <= 5)
SELECT symbol, event_id FROM q QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY md5('2:' || event_id::VARCHAR), event_id) <= 40
""", "quotes")  # fmt: skip
def quota_then_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five rows a stock-day, then forty a stock: the limits are the operator."""
    return folds.quota_then_cap(view(spark, sf_dir, "quotes"), "symbol", "day", ["event_id"], 5, 40).select("symbol", "event_id")


@register("SELECT symbol, count(*)::BIGINT AS n, round(avg(sign(p_top) * actual), 6) AS mean_signed FROM scored WHERE abs(p_top) > 0.2 AND abs(p_depth) > 0.2 GROUP BY symbol", "scored")
def selected_by_both(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = folds.selected_by_all(view(spark, sf_dir, "scored"), ["p_top", "p_depth"], 0.2)
    return rounded(rows.groupBy("symbol").agg(F.count("*").alias("n"), F.avg(F.signum("p_top") * F.col("actual")).alias("mean_signed")))


_CONTEXTS = """
, s AS (SELECT symbol, event_index % 4 AS context, round(avg(sign(p_top) * actual), 9) AS ic FROM scored WHERE period = 'P1' GROUP BY ALL)
"""


@register(_CONTEXTS + "SELECT symbol, min(context)::BIGINT AS chosen FROM s JOIN (SELECT symbol, max(ic) AS best FROM s GROUP BY symbol) USING (symbol) WHERE ic >= best - 1e-6 GROUP BY symbol", "scored")
def chosen_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best context on the dev period only, the smaller one on a tie."""
    scores = view(spark, sf_dir, "scored").where("period = 'P1'").groupBy("symbol", (F.col("event_index") % 4).alias("context")).agg(F.round(F.avg(F.signum("p_top") * F.col("actual")), 9).alias("ic"))
    return folds.chosen_context(scores.where("ic IS NOT NULL"), ["symbol"], "context", "ic")


@register("""
, w AS (SELECT symbol, day, segment, event_index, c, count(*) OVER (PARTITION BY symbol, day, segment ORDER BY event_index ROWS BETWEEN 7 PRECEDING AND CURRENT ROW) AS n FROM quotes CROSS JOIN (SELECT unnest([2, 4, 8]) AS c) WHERE c = 2),
t AS (SELECT symbol, day, segment, event_index, 2 AS context, sum(bid_sz_1) OVER (PARTITION BY symbol, day, segment ORDER BY event_index ROWS BETWEEN 1 PRECEDING AND CURRENT ROW) AS total FROM quotes
 UNION ALL SELECT symbol, day, segment, event_index, 8, sum(bid_sz_1) OVER (PARTITION BY symbol, day, segment ORDER BY event_index ROWS BETWEEN 7 PRECEDING AND CURRENT ROW) FROM quotes)
SELECT t.symbol, t.day, t.event_index, t.context, t.total FROM t JOIN w USING (symbol, day, segment, event_index) WHERE n = 8
""", "quotes")  # fmt: skip
def common_cohorts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contexts of two and eight states on the same rows: those that the longer one can use."""
    rows = folds.common_cohort(features.causal_windows(view(spark, sf_dir, "quotes"), ["bid_sz_1"], 8), 8, [2, 8])
    return rows.select("symbol", "day", "event_index", "context", F.aggregate("states", F.lit(0.0), lambda a, x: a + x["bid_sz_1"]).alias("total"))


# ---- checks


@register("""
SELECT symbol, day, event_index, 'bad quote' AS problem FROM quotes WHERE event_id % 41 = 0 UNION ALL SELECT symbol, day, event_index, 'time goes back' FROM (SELECT *, lag(CASE WHEN event_id % 43 = 0 THEN us + 864000000000 ELSE us END) OVER (PARTITION BY symbol, day ORDER BY event_index) AS b FROM quotes) WHERE CASE WHEN event_id % 43 = 0 THEN us + 864000000000 ELSE us END < b
""", "quotes")  # fmt: skip
def quote_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quotes with two kinds of faults put in: crossed ones and clocks ten days ahead."""
    rows = view(spark, sf_dir, "quotes").withColumns({"bid_px_1": F.when(F.col("event_id") % 41 == 0, F.col("ask_px_1")).otherwise(F.col("bid_px_1")), "us": F.when(F.col("event_id") % 43 == 0, F.col("us") + 864_000_000_000).otherwise(F.col("us"))})
    return checks.quote_problems(rows, ["symbol", "day", "event_index", "us", "bid_px_1", "ask_px_1"])


@register("""
SELECT event_id, CASE WHEN us % 86400000000 >= 82800000000 THEN 'day' ELSE 'code' END AS problem FROM trades WHERE us % 86400000000 >= 82800000000 OR event_id % 23 = 0
""", "trades")  # fmt: skip
def misplaced_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows whose UTC day is not their Warsaw day (the last hour of each day), and rows with another stock's code."""
    rows = view(spark, sf_dir, "trades").withColumn("code", F.when(F.col("event_id") % 23 == 0, -1).otherwise(F.substring("symbol", 2, 1).cast("int")))
    return checks.misplaced(rows, "Europe/Warsaw", {f"S{i}": i for i in range(5)}).select("event_id", "problem")


@register("SELECT count(*)::BIGINT AS violations, min(fold) AS first_fold FROM (SELECT DISTINCT day AS fold FROM scored WHERE day > '2024-01-25')", "scored")
def chronology_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Folds of which the last ones train on a day too many: those are found, the others pass."""
    cells = view(spark, sf_dir, "scored").select("symbol", "day").distinct()
    held = cells.select(F.col("day").alias("fold"), F.col("symbol").alias("held_out")).groupBy("fold").agg(F.min("held_out").alias("held_out"))
    train = held.join(cells, (F.col("day") < F.col("fold")) & (F.col("symbol") != F.col("held_out"))).withColumn("part", F.lit("train"))
    leak = held.where("fold > '2024-01-25'").withColumns({"symbol": F.lit("S9"), "day": F.col("fold"), "part": F.lit("train")})
    test = held.withColumns({"symbol": F.col("held_out"), "day": F.col("fold"), "part": F.lit("test")})
    return checks.chronology(train.unionByName(leak).unionByName(test), "fold").agg(F.count("*").alias("violations"), F.min("fold").alias("first_fold"))


@register("SELECT event_id, 'one' AS only_in, round(bid_px_1, 6) AS bid_px_1 FROM quotes WHERE event_id % 59 = 0 UNION ALL SELECT event_id, 'other', round(bid_px_1 + 1, 6) FROM quotes WHERE event_id % 59 = 0", "quotes")
def unequal_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two tables that should be equal, of which one has some prices changed."""
    rows = rounded(view(spark, sf_dir, "quotes").select("event_id", "bid_px_1"))
    return checks.unequal_rows(rows, rows.withColumn("bid_px_1", F.when(F.col("event_id") % 59 == 0, F.round(F.col("bid_px_1") + 1, 6)).otherwise(F.col("bid_px_1")))).select("event_id", "only_in", "bid_px_1")


@register("""
, c AS (SELECT symbol, day, count(*) AS rows, count(actual) AS valid, count(*) FILTER (abs(p_top) > 0.2) AS selected FROM scored GROUP BY ALL)
SELECT symbol, day, 'selected or common beyond its whole' AS problem FROM c WHERE selected > valid
""", "scored")  # fmt: skip
def accounting_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts by stock-day that must add up; where more rows are selected than have an outcome, they do not."""
    rows = view(spark, sf_dir, "scored").groupBy("symbol", "day").agg(F.count("*").alias("rows"), F.count("actual").alias("valid"), F.count_if(F.col("actual").isNull()).alias("invalid"), F.count_if(F.abs("p_top") > 0.2).alias("selected"))
    return checks.accounting(rows.withColumn("common", F.col("valid")), ["symbol", "day"])


@register("""
SELECT symbol, count(*) FILTER (part = 'same')::BIGINT AS same, count(*) FILTER (part = 'changed')::BIGINT AS changed FROM (SELECT DISTINCT symbol, day, CASE WHEN day LIKE '%-07' THEN 'changed' ELSE 'same' END AS part FROM quotes) GROUP BY symbol
""", "quotes")  # fmt: skip
def content_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order-free digests of each partition of two tables; one day differs by one unit of time."""
    quotes = view(spark, sf_dir, "quotes").select("symbol", "day", "event_index", "us")
    other = quotes.withColumn("us", F.when(F.col("day").endswith("-07"), F.col("us") + 1).otherwise(F.col("us"))).orderBy(F.desc("us"))
    both = checks.content(quotes, ["symbol", "day"]).join(checks.content(other, ["symbol", "day"]).withColumnRenamed("content_hash", "other_hash").drop("rows"), ["symbol", "day"])
    same = F.col("content_hash") == F.col("other_hash")
    return both.groupBy("symbol").agg(F.count_if(same).alias("same"), F.count_if(~same).alias("changed"))


# ---- models

_TWO = ["p_top", "p_depth"]
_SUMS = "count(*) AS n, sum(x) AS sx, sum(z) AS sz, sum(y) AS sy, sum(x * x) AS sxx, sum(z * z) AS szz, sum(x * z) AS sxz, sum(x * y) AS sxy, sum(z * y) AS szy"
_SOLVED = """
, mo AS (SELECT *, sx / n AS mx, sz / n AS mz, sy / n AS my FROM su), cv AS (SELECT *, sxx - n * mx * mx AS cxx, szz - n * mz * mz AS czz, sxz - n * mx * mz AS cxz, sxy - n * mx * my AS cxy, szy - n * mz * my AS czy FROM mo),
sd AS (SELECT *, sqrt(cxx / n) AS dx, sqrt(czz / n) AS dz FROM cv), nm AS (SELECT *, cxx / dx / dx + {penalty} AS a, czz / dz / dz + {penalty} AS c, cxz / dx / dz AS b, cxy / dx AS u, czy / dz AS v FROM sd),
fit AS (SELECT {keys}, n, (c * u - b * v) / (a * c - b * b) / dx AS wx, (a * v - b * u) / (a * c - b * b) / dz AS wz, my - (c * u - b * v) / (a * c - b * b) / dx * mx - (a * v - b * u) / (a * c - b * b) / dz * mz AS w0 FROM nm)
"""


@register(f", c AS (SELECT symbol, p_top AS x, p_depth AS z, actual AS y FROM scored WHERE actual IS NOT NULL), su AS (SELECT symbol, {_SUMS} FROM c GROUP BY symbol)" + _SOLVED.format(keys="symbol", penalty="250.0") + "SELECT symbol, n::BIGINT AS n, round(w0, 4) AS intercept, round(wx, 4) AS w_top, round(wz, 4) AS w_depth FROM fit", "scored")
def ridge_two_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ridge with two correlated features and a penalty that counts."""
    fitted = models.fit_ridge(view(spark, sf_dir, "scored").select("symbol", *_TWO, "actual"), "symbol", _TWO, "actual", 250.0)
    return fitted.select("symbol", "n", F.round("intercept", 4).alias("intercept"), F.round(F.element_at("weights", 1), 4).alias("w_top"), F.round(F.element_at("weights", 2), 4).alias("w_depth"))


def _walk_sizes(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, int, int, int]:
    rows = view(spark, sf_dir, "scored").where("actual IS NOT NULL").withColumn("future_us", F.col("us") + HOUR)
    n = rows.count()
    return rows, max(n // 2, 1), max(n // 10, 1), 5


_WALK = f"""
, c AS (SELECT *, us + {HOUR} AS future_us FROM scored WHERE actual IS NOT NULL), n AS (SELECT count(*) AS n FROM c), pl AS (SELECT c.*, row_number() OVER (ORDER BY us, event_id) - 1 AS place FROM c),
f AS (SELECT i AS fold, greatest(n // 2, 1) + i * greatest(n // 10, 1) AS stop, greatest(n // 10, 1) AS test FROM n CROSS JOIN range(5) r(i)), e AS (SELECT fold, stop, test, us AS last_us FROM f JOIN pl ON place = stop - 1),
s AS (SELECT fold, stop, test, min(place) AS first, min(us) AS test_us FROM e JOIN pl ON place >= stop AND us > last_us + {60_000_000} GROUP BY ALL HAVING count(*) >= test),
p AS (SELECT fold, CASE WHEN place < stop THEN 'train' ELSE 'test' END AS part, pl.* FROM s JOIN pl ON place < stop AND future_us < test_us OR place >= first AND place < first + test)
"""


@register(_WALK + "SELECT fold::INT AS fold, part, count(*)::BIGINT AS rows, min(us) AS first_us, max(us) AS last_us FROM p GROUP BY fold, part", "scored")
def walk_forward_purged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five anchored folds over all rows, a minute of embargo, and training labels purged that end after the test begins."""
    rows, train, test, splits = _walk_sizes(spark, sf_dir)
    return folds.purge(folds.walk_forward(rows, ["us", "event_id"], train, test, splits, 60_000_000)).groupBy("fold", "part").agg(F.count("*").alias("rows"), F.min("us").alias("first_us"), F.max("us").alias("last_us"))


_RUN = _WALK + """
, sh AS (SELECT fold, event_id, y AS shuffled FROM (SELECT fold, event_id, row_number() OVER (PARTITION BY fold ORDER BY event_id) AS k FROM p WHERE part = 'train') JOIN (SELECT fold, actual AS y, row_number() OVER (PARTITION BY fold ORDER BY md5('1:' || event_id::VARCHAR), event_id) AS k FROM p WHERE part = 'train') USING (fold, k)),
tr AS (SELECT fold, 'fitted' AS run, p_top AS x, p_depth AS z, actual AS y FROM p WHERE part = 'train' UNION ALL SELECT fold, 'shuffled', p_top, p_depth, shuffled FROM p JOIN sh USING (fold, event_id) WHERE part = 'train'),
su AS (SELECT fold, run, """ + _SUMS + " FROM tr GROUP BY ALL)" + _SOLVED.format(keys="fold, run", penalty="1e-6") + """
, pr AS (SELECT fold, run, round(w0 + wx * p_top + wz * p_depth, 9) AS q, actual FROM p JOIN fit USING (fold) WHERE part = 'test'),
rk AS (SELECT *, rank() OVER (PARTITION BY fold, run ORDER BY q) + (count(*) OVER (PARTITION BY fold, run, q) - 1) / 2.0 AS rq, rank() OVER (PARTITION BY fold, run ORDER BY actual) + (count(*) OVER (PARTITION BY fold, run, actual) - 1) / 2.0 AS ra FROM pr)
SELECT fold::INT AS fold, run, count(*)::BIGINT AS n, round(CASE WHEN min(q) < max(q) AND min(actual) < max(actual) THEN corr(rq, ra) END, 3) AS ic, round(avg((q - actual) * (q - actual)), 3) AS mse FROM rk GROUP BY fold, run
"""


@register(_RUN, "scored")
def walk_forward_ridge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole baseline as one job: purged folds, ridge fits, predictions, and a control with labels dealt anew in training."""
    return _baseline(spark, sf_dir).scores.where("fold IS NOT NULL").select("fold", "run", "n", F.round("ic", 3).alias("ic"), F.round("mse", 3).alias("mse"))


def _baseline(spark: SparkSession, sf_dir: str, fit: baseline.Fit = baseline.ridge, features_: Sequence[str] = ("p_top", "p_depth")) -> baseline.Baseline:
    rows, train, test, splits = _walk_sizes(spark, sf_dir)
    return baseline.run_baseline(rows, ["us", "event_id"], "event_id", features_, "actual", train, test, splits, 60_000_000, fit)


@register(_WALK + """
, q AS (SELECT fold, CASE WHEN place < stop THEN 'train' ELSE 'test' END AS part, future_us, us FROM s JOIN pl ON place < stop OR place >= first AND place < first + test),
b AS (SELECT fold, count(*) FILTER (part = 'train') AS train_before, max(future_us) FILTER (part = 'train') AS last_label_before, count(*) FILTER (part = 'test') AS test, min(us) FILTER (part = 'test') AS test_first_us, max(us) FILTER (part = 'test') AS test_last_us FROM q GROUP BY fold),
k AS (SELECT fold, count(*) AS train_after, max(us) AS last_train_us, max(future_us) AS last_label_after FROM p WHERE part = 'train' GROUP BY fold)
SELECT b.fold::INT AS fold, train_before::BIGINT AS train_before, last_label_before, test::BIGINT AS test, test_first_us, test_last_us, train_after::BIGINT AS train_after, last_train_us, last_label_after FROM b JOIN k USING (fold)
""", "scored")  # fmt: skip
def walk_forward_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fold log: what the purge takes away, and that no training label reaches into the test."""
    return _baseline(spark, sf_dir).folds


_PREDICTED = _RUN.split("\nrk AS")[0].rstrip().rstrip(",").replace("SELECT fold, run, round(w0", "SELECT fold, run, event_id, us, round(w0")


@register(_PREDICTED + " SELECT fold::INT AS fold, run, event_id, us, round(q, 4) + 0 AS prediction, round(actual, 6) + 0 AS actual FROM pr", "scored")
def walk_forward_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The prediction rows of all folds, fitted and control."""
    rows = _baseline(spark, sf_dir).predictions
    return rows.select("fold", "run", "event_id", "us", (F.round("prediction", 4) + 0.0).alias("prediction"), (F.round("actual", 6) + 0.0).alias("actual"))


@register(_PREDICTED + """
, rk AS (SELECT *, rank() OVER (PARTITION BY run ORDER BY q) + (count(*) OVER (PARTITION BY run, q) - 1) / 2.0 AS rq, rank() OVER (PARTITION BY run ORDER BY actual) + (count(*) OVER (PARTITION BY run, actual) - 1) / 2.0 AS ra FROM pr)
SELECT run, count(*)::BIGINT AS n, round(corr(rq, ra), 3) AS ic, round(avg((q - actual) * (q - actual)), 3) AS mse, round(avg(abs(actual)), 6) AS mean_abs_actual FROM rk GROUP BY run
""", "scored")  # fmt: skip
def walk_forward_pooled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both runs over all folds at once, ranked by ranges."""
    pooled = _baseline(spark, sf_dir).scores.where("fold IS NULL")
    return pooled.select("run", "n", F.round("ic", 3).alias("ic"), F.round("mse", 3).alias("mse"), F.round("mean_abs_actual", 6).alias("mean_abs_actual"))


@register(_PREDICTED + """
, ft AS (SELECT q, actual FROM pr WHERE run = 'fitted'), ed AS (SELECT list_sort(list_distinct(quantile_cont(q, [0, 0.2, 0.4, 0.6, 0.8, 1.0]))) AS e FROM ft)
SELECT greatest(0, len(list_filter(e[1:len(e)-1], lambda x: x < q)) - 1)::INT AS bin, count(*)::BIGINT AS n, round(avg(q), 4) AS mean_prediction, round(avg(actual), 4) AS mean_actual FROM ft, ed GROUP BY bin
""", "scored")  # fmt: skip
def walk_forward_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean outcome by fifths of the pooled predictions."""
    return _baseline(spark, sf_dir).buckets.select("bin", "n", F.round("mean_prediction", 4).alias("mean_prediction"), F.round("mean_actual", 4).alias("mean_actual"))


_WINDOWED = """
, w AS (SELECT symbol, event_id, p_top AS x, lag(p_top) OVER s AS z, actual AS y, period FROM scored WINDOW s AS (PARTITION BY symbol, day, segment ORDER BY event_index)), c AS (SELECT * FROM w WHERE z IS NOT NULL AND y IS NOT NULL)
"""


@register(_WINDOWED + f", su AS (SELECT symbol, {_SUMS} FROM c GROUP BY symbol)" + _SOLVED.format(keys="symbol", penalty="0.001") + "SELECT symbol, n::BIGINT AS n, round(w0, 4) AS intercept, round(wz, 4) AS w_before, round(wx, 4) AS w_now FROM fit", "scored")
def history_ridge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A regression on the flattened window of the last two states."""
    rows = features.causal_windows(view(spark, sf_dir, "scored"), ["p_top"], 2)
    flat, names = models.flattened(rows.where("actual IS NOT NULL"), "window", ["p_top"], 2)
    fitted = models.fit_ridge(flat.select("symbol", *names, "actual"), "symbol", names, "actual", 0.001)
    return fitted.select("symbol", "n", F.round("intercept", 4).alias("intercept"), F.round(F.element_at("weights", 1), 4).alias("w_before"), F.round(F.element_at("weights", 2), 4).alias("w_now"))


@register("""
, c AS (SELECT symbol, event_id, p_top, p_depth, round((p_top + p_depth) / 2, 9) AS p, actual FROM scored WHERE actual IS NOT NULL),
k AS (SELECT *, rank() OVER (PARTITION BY symbol ORDER BY p) + (count(*) OVER (PARTITION BY symbol, p) - 1) / 2.0 AS rp, rank() OVER (PARTITION BY symbol ORDER BY p_top) + (count(*) OVER (PARTITION BY symbol, p_top) - 1) / 2.0 AS r1, rank() OVER (PARTITION BY symbol ORDER BY p_depth) + (count(*) OVER (PARTITION BY symbol, p_depth) - 1) / 2.0 AS r2,
 rank() OVER (PARTITION BY symbol ORDER BY actual) + (count(*) OVER (PARTITION BY symbol, actual) - 1) / 2.0 AS ra FROM c)
SELECT symbol, round(corr(rp, ra), 6) AS ic_of_mean, round((corr(r1, ra) + corr(r2, ra)) / 2, 6) AS mean_of_ic FROM k GROUP BY symbol
""", "scored")  # fmt: skip
def ensemble_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The score of the mean prediction of two models, and the mean of their scores: they differ."""
    rows = view(spark, sf_dir, "scored").where("actual IS NOT NULL")
    long = rows.select("symbol", "event_id", "actual", F.explode(F.array(F.struct(F.lit(1).alias("seed"), F.col("p_top").alias("prediction")), F.struct(F.lit(2).alias("seed"), F.col("p_depth").alias("prediction")))).alias("m")).select("symbol", "event_id", "actual", "m.*")
    return rounded(models.ensembles(long, ["symbol"], ["event_id"], "seed", "prediction", "actual"))


@register(_WINDOWED + "SELECT event_id, round(0.25 * z + 0.75 * x, 6) AS prediction FROM w WHERE z IS NOT NULL", "scored")
def scored_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stored model (its weights are all there is to it) applied to batches of windows."""
    rows = features.causal_windows(view(spark, sf_dir, "scored"), ["p_top"], 2)
    return rounded(models.score_windows(rows.select("event_id", "window"), "event_id", lambda x: x[:, :, 0] @ [0.25, 0.75], 2, 1))


_CELL = {"input": [[0.8], [-0.5]], "hidden": [[0.3, -0.2], [0.1, 0.4]], "bias": [0.05, -0.1], "out": [1.5, -0.7], "offset": [0.02]}


def _cell_sql() -> str:
    """The cell written out over three states."""
    steps, before = [], ("0", "0")
    for k, x in enumerate(("x0", "x1", "x2")):
        h = [f"tanh({_CELL['input'][i][0]} * {x} + {_CELL['hidden'][i][0]} * {before[0]} + {_CELL['hidden'][i][1]} * {before[1]} + {_CELL['bias'][i]})" for i in (0, 1)]
        steps.append(f", h{k} AS (SELECT *, {h[0]} AS a{k}, {h[1]} AS b{k} FROM {'w3' if k == 0 else f'h{k - 1}'})")
        before = (f"a{k}", f"b{k}")
    return "".join(steps) + f" SELECT event_id, round({_CELL['out'][0]} * a2 + {_CELL['out'][1]} * b2 + {_CELL['offset'][0]}, 6) AS prediction FROM h2 WHERE x0 IS NOT NULL"


@register(", w3 AS (SELECT event_id, lag(p_top, 2) OVER s AS x0, lag(p_top) OVER s AS x1, p_top AS x2 FROM scored WINDOW s AS (PARTITION BY symbol, day, segment ORDER BY event_index))" + _cell_sql(), "scored")
def recurrent_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A recurrent cell that was stored as a table, loaded once and applied to windows of three states."""
    path = tables.work_folder(spark, "cell")
    models.store_cell(spark, {k: np.array(v) for k, v in _CELL.items()}, path)
    rows = features.causal_windows(view(spark, sf_dir, "scored"), ["p_top"], 3)
    return rounded(models.score_windows(rows.select("event_id", "window"), "event_id", models.load_cell(spark, path), 3, 1))


@register(None)
def boosted_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gradient-boosted trees of every variant: fitted on the first two periods, scored on the last one, with gain shares."""
    rows = tables.stored(view(spark, sf_dir, "scored").where("actual IS NOT NULL").select("symbol", "period", *_TWO, "spread_bps", "actual"), "scored")
    train, test = rows.where("period <> 'P2'"), rows.where("period = 'P2'")
    n = train.count()
    train = models.packed(train, n)
    each = models.side_by_side(spark, [partial(models.boosted_trees, train, test, [*_TWO, "spread_bps"], "actual", ["symbol"], variant) for variant in models.TREES], n)
    return reduce(DataFrame.unionByName, [scores.withColumn("variant", F.lit(variant)) for variant, scores in zip(models.TREES, each, strict=True)])


@register(None)
def walk_forward_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The walk-forward baseline with trees over all folds, beside the control."""
    return _baseline(spark, sf_dir, baseline.trees("small"), [*_TWO, "spread_bps"]).scores
