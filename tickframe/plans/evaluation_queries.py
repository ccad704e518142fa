"""Registered queries that evaluate predictions: scores, deciles, costs, blocks, contrasts and bootstraps."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickframe.operators import baseline, evaluation, joins, labels, metrics, resampling
from tickframe.operators.features import in_segment
from tickframe.plans.queries import MID, lead, register, rounded
from tickframe.views import view

_CLEAN = ", c AS (SELECT * FROM scored WHERE actual IS NOT NULL)"


def _ranked(keys: str) -> str:
    return f""", r AS (SELECT *, rank() OVER (PARTITION BY {keys} ORDER BY p_top) + (count(*) OVER (PARTITION BY {keys}, p_top) - 1) / 2.0 AS rp,
  rank() OVER (PARTITION BY {keys} ORDER BY actual) + (count(*) OVER (PARTITION BY {keys}, actual) - 1) / 2.0 AS ra FROM c)"""


@register(_CLEAN + _ranked("symbol, day") + """
SELECT symbol, day, count(*)::BIGINT AS n, round(CASE WHEN count(*) >= 3 AND min(actual) < max(actual) AND min(p_top) < max(p_top) THEN corr(rp, ra) END, 6) AS ic, round(avg((p_top - actual) * (p_top - actual)), 5) AS mse, round(avg(p_top), 6) AS mean_prediction, round(avg(actual), 6) AS mean_actual,
  round(stddev_pop(p_top), 6) AS std_prediction, round(stddev_pop(actual), 5) AS std_actual, CASE WHEN count(*) < 3 THEN 'fewer than 3 rows' WHEN min(actual) = max(actual) THEN 'constant label' WHEN min(p_top) = max(p_top) THEN 'constant prediction' END AS reason FROM r GROUP BY symbol, day
""", "scored")  # fmt: skip
def day_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = evaluation.day_scores(view(spark, sf_dir, "scored"), ["symbol", "day"], "p_top", "actual")
    return rounded(rows.withColumns({c: F.round(c, 5) for c in ("mse", "std_actual")}))


@register(_CLEAN + """
, m AS (SELECT symbol, day, round(avg(p_top), 9) AS p, round(avg(actual), 9) AS a FROM c GROUP BY ALL),
r AS (SELECT *, rank() OVER (PARTITION BY symbol ORDER BY p) + (count(*) OVER (PARTITION BY symbol, p) - 1) / 2.0 AS rp, rank() OVER (PARTITION BY symbol ORDER BY a) + (count(*) OVER (PARTITION BY symbol, a) - 1) / 2.0 AS ra FROM m)
SELECT symbol, count(*)::BIGINT AS days, round(CASE WHEN min(p) < max(p) AND min(a) < max(a) THEN corr(rp, ra) END, 6) AS ic FROM r GROUP BY symbol
""", "scored")  # fmt: skip
def daily_mean_correlation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(evaluation.daily_mean_correlation(view(spark, sf_dir, "scored"), ["symbol"], "day", "p_top", "actual"))


_SCORES = """count(*)::BIGINT AS n, round(CASE WHEN min(p_top) < max(p_top) AND min(actual) < max(actual) THEN corr(rp, ra) END, 6) AS ic, round(avg(CASE WHEN actual <> 0 THEN (sign(p_top) = sign(actual))::INT END), 6) AS direction_accuracy,
  round(avg((p_top <> 0)::INT), 6) AS coverage, round(avg(abs(actual)), 6) AS mean_abs_actual, round(avg(sign(p_top) * actual), 6) AS mean_signed_net"""


@register(_CLEAN + _ranked("symbol, day").replace(", r AS", ", rd AS") + _ranked("symbol").replace(", r AS", ", rs AS") + f"SELECT symbol, day, {_SCORES} FROM rd GROUP BY symbol, day UNION ALL SELECT symbol, 'all', {_SCORES} FROM rs GROUP BY symbol", "scored")
def grouped_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of each stock over all days, and of each of its days with ranks of its own."""
    return rounded(evaluation.grouped_scores(view(spark, sf_dir, "scored"), ["symbol"], "day", "p_top", "actual"))


@register(_CLEAN.replace("SELECT *", "SELECT *, 'all' AS pool") + _ranked("pool") + f"SELECT pool, {_SCORES} FROM r GROUP BY pool", "scored")
def pooled_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One score over all stocks' predictions together, ranked by ranges."""
    return rounded(baseline.pooled_scores(view(spark, sf_dir, "scored").withColumn("pool", F.lit("all")), ["pool"], "p_top", "actual").drop("mse"))


def _binned(keys: str, bins: int, rows: str = "c", value: str = "p_top") -> str:
    q = ", ".join(str(i / bins) for i in range(bins + 1))
    return f""", ed AS (SELECT {keys}, list_sort(list_distinct(quantile_cont({value}, [{q}]))) AS e FROM {rows} GROUP BY ALL),
b AS (SELECT {rows}.*, greatest(0, len(list_filter(e[1:len(e)-1], lambda x: x < {value})) - 1) AS bin FROM {rows} JOIN ed USING ({keys}))"""


@register(_CLEAN + _binned("period", 5) + """
SELECT period, bin::INT AS bin, NULL::BIGINT AS fold_count, count(*)::BIGINT AS n, round(avg(p_top), 6) AS mean_prediction, round(avg(actual), 6) AS mean_actual FROM b GROUP BY period, bin
UNION ALL SELECT NULL, bin::INT, count(DISTINCT period)::BIGINT, count(*)::BIGINT, round(avg(p_top), 6), round(avg(actual), 6) FROM b GROUP BY bin
""", "scored")  # fmt: skip
def fold_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quintile tables with bins cut inside each fold (a period), and pooled."""
    each, pooled = evaluation.fold_quantiles(view(spark, sf_dir, "scored"), "period", "p_top", "actual", 5)
    return rounded(each.unionByName(pooled, allowMissingColumns=True))


@register(_CLEAN + _binned("symbol", 5) + """
, t AS (SELECT symbol, bin, avg(actual) AS m FROM b GROUP BY symbol, bin)
SELECT symbol, bin::INT AS bin, round(m - lag(m) OVER (PARTITION BY symbol ORDER BY bin), 6) AS step, m - lag(m) OVER (PARTITION BY symbol ORDER BY bin) >= 0 AS rises FROM t
""", "scored")  # fmt: skip
def bucket_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = metrics.bucket_table(view(spark, sf_dir, "scored"), ["symbol"], "p_top", "actual", 5)
    return rounded(evaluation.bin_steps(table, ["symbol"], "mean_actual").select("symbol", "bin", "step", "rises"))


#: Outcomes across the spread from the features alone, for a long and a short position.
_CROSSED = """, x AS (SELECT *, actual - spread_bps / 2 - exit_spread_bps / 2 * (1 + actual / 1e4) AS long_bps, -actual - spread_bps / 2 - exit_spread_bps / 2 * (1 + actual / 1e4) AS short_bps FROM c)"""


def _crossed(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = view(spark, sf_dir, "scored").where("actual IS NOT NULL")
    side = lambda d: labels.crossed_from_features(F.col("actual"), F.col("spread_bps"), F.col("exit_spread_bps"), F.lit(d))
    return rows.withColumns({"long_bps": side(1), "short_bps": side(-1), "passive_bps": labels.passive_markout(F.col("spread_bps"))})


@register(_CLEAN + _CROSSED + "SELECT event_id, round(long_bps, 6) + 0.0 AS long_bps, round(short_bps, 6) + 0.0 AS short_bps, round(spread_bps / 2, 6) AS passive_bps, round(CASE WHEN p_top > 0 THEN long_bps WHEN p_top < 0 THEN short_bps END, 6) + 0.0 AS chosen_bps FROM x", "scored")
def feature_crossing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Crossed outcomes from features only, and the one that the prediction's sign chooses."""
    rows = _crossed(spark, sf_dir)
    return rounded(rows.select("event_id", "long_bps", "short_bps", "passive_bps", evaluation.side_selected(F.col("p_top"), F.col("long_bps"), F.col("short_bps")).alias("chosen_bps")))


@register(_CLEAN + _CROSSED + _binned("symbol", 10, "x") + """
, o AS (SELECT *, CASE WHEN p_top > 0 THEN long_bps WHEN p_top < 0 THEN short_bps END AS o, abs(p_top) > 0.3 AS k FROM b),
t AS (SELECT symbol, bin, count(*) AS n, count(*) FILTER (k) AS kn, sum(o) FILTER (k) AS s, count(o) FILTER (k) AS m, avg(o) AS v FROM o GROUP BY symbol, bin),
u AS (SELECT *, v - lag(v) OVER (PARTITION BY symbol ORDER BY bin) AS step FROM t)
SELECT symbol, sum(n)::BIGINT AS n, sum(kn)::BIGINT AS selected, round(sum(kn) / sum(n), 6) AS coverage, round(sum(s) / nullif(sum(m), 0), 6) AS selected_mean, round(arg_min(v, bin), 6) AS low_bin_mean, round(arg_max(v, bin), 6) AS high_bin_mean, coalesce(bool_and(step >= 0), true) AS ordered FROM u GROUP BY symbol
""", "scored")  # fmt: skip
def execution_deciles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(evaluation.execution_by_bin(_crossed(spark, sf_dir), ["symbol"], "p_top", "long_bps", "short_bps", 0.3))


@register(_CLEAN + _CROSSED + ", y AS (SELECT *, CASE WHEN p_top > 0 THEN long_bps WHEN p_top < 0 THEN short_bps END AS o FROM x), z AS (SELECT * FROM y WHERE o IS NOT NULL)" + _binned("symbol, period", 5, "z") + """
SELECT symbol, period, bin::INT AS bin, day, count(*)::BIGINT AS n, round(avg(o), 6) + 0.0 AS mean_outcome FROM b GROUP BY GROUPING SETS ((symbol, period, bin), (symbol, period, bin, day))
""", "scored")  # fmt: skip
def period_bins_by_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bins cut over a period, applied to its days."""
    rows = _crossed(spark, sf_dir).withColumn("o", evaluation.side_selected(F.col("p_top"), F.col("long_bps"), F.col("short_bps")))
    return rounded(evaluation.period_bins_by_day(rows, ["symbol"], "period", "day", "p_top", "o", 5))


_HALF = "((ask_px_1 - bid_px_1) / 2.0)"


def _costs_sql(latency: int, out: int) -> str:
    base = lead(MID, latency)
    return f"""SELECT symbol, day, event_index, (bid_sz_1 - ask_sz_1) / (bid_sz_1 + ask_sz_1) AS p, (bid_sz_1 + bid_sz_2 - ask_sz_1 - ask_sz_2) / (bid_sz_1 + bid_sz_2 + ask_sz_1 + ask_sz_2) AS p2,
  ({lead(MID, out)} - {base}) / {base} * 1e4 AS g, {lead(_HALF, latency)} / {base} * 1e4 AS h0, {lead(_HALF, out)} / {base} * 1e4 AS h1 FROM quotes"""


_SELECTED = """count(g) FILTER (k)::BIGINT AS selected, round(avg(sign(p) * g) FILTER (k), 6) AS gross_bps, round(avg(h0) FILTER (k), 6) AS entry_half_bps, round(avg(h1) FILTER (k), 6) AS exit_half_bps, round(avg(sign(p) * g - h0 - h1) FILTER (k), 6) AS net_bps,
  CASE WHEN count(g) FILTER (k) > 0 THEN 0.0::DOUBLE END AS max_residual, CASE WHEN count(g) FILTER (k) = 0 THEN 'no selected row' END AS reason"""


def _predicted(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = view(spark, sf_dir, "quotes")
    return q.withColumns({"p": (F.col("bid_sz_1") - F.col("ask_sz_1")) / (F.col("bid_sz_1") + F.col("ask_sz_1")), "p2": (F.col("bid_sz_1") + F.col("bid_sz_2") - F.col("ask_sz_1") - F.col("ask_sz_2")) / (F.col("bid_sz_1") + F.col("bid_sz_2") + F.col("ask_sz_1") + F.col("ask_sz_2"))})


@register(f", y AS ({_costs_sql(1, 6)}), w AS (SELECT *, abs(p) > 0.3 AND g IS NOT NULL AS k FROM y) SELECT symbol, day, {_SELECTED} FROM w GROUP BY symbol, day", "quotes")
def selected_costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gross move, half-spreads and net outcome of the selected rows, which must add up."""
    rows = evaluation.selected_costs(labels.cost_components(_predicted(spark, sf_dir), 5, 1), ["symbol", "day"], "p", 0.3)
    return rounded(rows.withColumn("max_residual", F.round("max_residual", 9)))


@register(f", y AS ({_costs_sql(1, 5)}), w AS (SELECT *, abs(p) > 0.3 AND g IS NOT NULL AND abs(p2) > 0.3 AS k FROM y) SELECT symbol, {_SELECTED} FROM w GROUP BY symbol", "quotes")
def fixed_exit_costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with an exit that does not move with the delay, on rows that both models select."""
    rows = evaluation.selected_costs(labels.cost_components(_predicted(spark, sf_dir), 5, 1, fixed_exit=True), ["symbol"], "p", 0.3, F.abs("p2") > 0.3)
    return rounded(rows.withColumn("max_residual", F.round("max_residual", 9)))


@register("""
, g AS (SELECT symbol, day, us - lag(us) OVER (PARTITION BY symbol, day ORDER BY event_index) AS gap FROM (SELECT symbol, day, event_index, us - us % 1000 AS us FROM quotes)),
u AS (SELECT symbol, gap, count(*) AS n FROM g WHERE gap IS NOT NULL GROUP BY ALL)
SELECT symbol, sum(n)::BIGINT AS gaps, coalesce(sum(n) FILTER (gap = 0), 0)::BIGINT AS zeros, min(gap) FILTER (gap > 0) AS least_positive, list_reduce(list(gap ORDER BY gap), lambda a, b: gcd(a, b)) AS divisor FROM u GROUP BY symbol
""", "quotes")  # fmt: skip
def clock_precision(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gaps of a clock cut to milliseconds: their greatest common divisor shows it."""
    rows = view(spark, sf_dir, "quotes").withColumn("us", F.col("us") - F.col("us") % 1000)
    gap = F.col("us") - F.lag("us").over(in_segment("symbol", "day"))
    return evaluation.gap_precision(rows.withColumn("gap", gap), ["symbol"], "gap")


@register("""
, d AS (SELECT s.symbol, x.day FROM (SELECT DISTINCT symbol FROM scored) s CROSS JOIN (SELECT DISTINCT day FROM scored UNION ALL SELECT '2024-02-01') x),
f AS (SELECT symbol, day, count(*) AS rows, count(actual) AS finite_rows, max(abs(actual - p_top)) AS e, avg(abs(actual - p_top)) AS a FROM scored GROUP BY ALL)
SELECT symbol, day, coalesce(rows, 0)::BIGINT AS rows, coalesce(finite_rows, 0)::BIGINT AS finite_rows, round(e, 6) AS max_error, round(a, 6) AS mean_error FROM d LEFT JOIN f USING (symbol, day)
""", "scored")  # fmt: skip
def partition_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Summary of the declared partitions, one of which is empty."""
    rows = view(spark, sf_dir, "scored")
    days = rows.select("day").distinct().union(spark.sql("SELECT '2024-02-01'"))
    declared = rows.select("symbol").distinct().join(F.broadcast(days))
    return rounded(evaluation.partition_summary(rows, declared, ["symbol", "day"], F.col("actual").isNotNull(), F.abs(F.col("actual") - F.col("p_top"))))


#: Cells: the mean selected outcome of two arms by stock, day and delay.
_CELLS = """, cells AS (SELECT symbol, day, period, arm, delay, avg(v) AS v, count(v)::BIGINT AS n FROM (
  SELECT symbol, day, period, 'top' AS arm, event_index % 3 AS delay, CASE WHEN abs(p_top) > 0.2 THEN sign(p_top) * actual END AS v FROM scored
  UNION ALL SELECT symbol, day, period, 'depth', event_index % 3, CASE WHEN abs(p_depth) > 0.2 THEN sign(p_depth) * actual END FROM scored) GROUP BY ALL)"""


def _cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = view(spark, sf_dir, "scored")
    arm = lambda name, p: rows.select("symbol", "day", "period", F.lit(name).alias("arm"), (F.col("event_index") % 3).alias("delay"), F.when(F.abs(p) > 0.2, F.signum(p) * F.col("actual")).alias("v"))
    return arm("top", "p_top").union(arm("depth", "p_depth")).groupBy("symbol", "day", "period", "arm", "delay").agg(F.avg("v").alias("v"), F.count("v").alias("n"))


@register(_CELLS + "SELECT symbol, arm, count(*)::BIGINT AS blocks, round(avg(v), 6) AS v, round(avg(n), 6) AS n FROM cells GROUP BY symbol, arm", "scored")
def block_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(evaluation.block_means(_cells(spark, sf_dir), ["symbol", "arm"], ["v", "n"]))


_GRID = ", grid AS (SELECT a.arm, t.delay, s.symbol, p.period FROM (SELECT unnest(['top', 'depth']) AS arm) a CROSS JOIN range(4) t(delay) CROSS JOIN (SELECT DISTINCT symbol FROM cells) s CROSS JOIN (SELECT DISTINCT period FROM cells) p), pc AS (SELECT symbol, period, arm, delay, avg(v) AS v, sum(n) AS n FROM cells GROUP BY ALL)"


def _grid(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    cells = _cells(spark, sf_dir).groupBy("symbol", "period", "arm", "delay").agg(F.avg("v").alias("v"), F.sum("n").alias("n"))
    arms = spark.createDataFrame([("top",), ("depth",)], "arm string")
    small = lambda df: F.broadcast(df)
    grid = arms.join(small(spark.range(4).select(F.col("id").alias("delay")))).join(small(cells.select("symbol").distinct())).join(small(cells.select("period").distinct()))
    return cells, grid


@register(_CELLS + _GRID + """
SELECT arm, delay::BIGINT AS delay, count(*)::BIGINT AS expected, count(v)::BIGINT AS v_defined, round(CASE WHEN count(v) = count(*) THEN avg(v) END, 6) AS v_mean, round(CASE WHEN count(v) = count(*) THEN median(v) END, 6) AS v_median, CASE WHEN count(v) = count(*) THEN count(*) FILTER (v > 0) END::BIGINT AS v_positive
FROM grid LEFT JOIN pc USING (arm, delay, symbol, period) GROUP BY arm, delay
""", "scored")  # fmt: skip
def strict_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Block summaries by arm and delay; the delay 3 has no blocks and stays undefined."""
    cells, grid = _grid(spark, sf_dir)
    return rounded(evaluation.strict_blocks(cells, grid, ["arm", "delay"], ["symbol", "period"], ["v"]))


@register(_CELLS + _GRID + """
SELECT arm, delay::BIGINT AS delay, count(*)::BIGINT AS expected, count(v)::BIGINT AS defined, round(CASE WHEN count(v) = count(*) THEN avg(v) END, 6) AS equal_mean, round(sum(v * n) / nullif(sum(n) FILTER (v IS NOT NULL), 0), 6) AS pooled_mean,
  coalesce(string_agg(symbol || '/' || period, ',' ORDER BY symbol || '/' || period) FILTER (v IS NULL), '') AS undefined FROM grid LEFT JOIN pc USING (arm, delay, symbol, period) GROUP BY arm, delay
""", "scored")  # fmt: skip
def delay_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells, grid = _grid(spark, sf_dir)
    return rounded(evaluation.delay_matrix(cells, grid, ["arm", "delay"], ["symbol", "period"], "v", "n"))


@register(_CELLS + """
, pc AS (SELECT symbol, arm, delay, avg(v) AS v FROM cells GROUP BY ALL) SELECT symbol, arm, delay, round(v - max(v) FILTER (delay = 0) OVER (PARTITION BY symbol, arm), 6) AS change FROM pc
""", "scored")  # fmt: skip
def change_from_no_delay(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = _cells(spark, sf_dir).groupBy("symbol", "arm", "delay").agg(F.avg("v").alias("v"))
    return rounded(evaluation.change_from_base(cells, ["symbol", "arm"], "delay", 0, "v").select("symbol", "arm", "delay", "change"))


@register(_CELLS + "SELECT arm, delay, round(avg(v), 6) AS equal_mean, round(sum(v * n) / nullif(sum(n) FILTER (v IS NOT NULL), 0), 6) AS pooled_mean, sum(n)::BIGINT AS rows FROM cells GROUP BY arm, delay", "scored")
def pooled_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edge by arm and delay: blocks with equal weight, and pooled by rows."""
    return rounded(evaluation.pooled_mean(_cells(spark, sf_dir), ["arm", "delay"], "v", "n"))


def _edge_sql(keys: str) -> str:
    parts = ("gross_bps", "entry_half_bps", "exit_half_bps", "net_bps")
    means = ", ".join([f"round(avg({x}), 6) AS equal_{x}, round(sum({x} * selected) / nullif(sum(selected) FILTER (net_bps IS NOT NULL), 0), 6) AS pooled_{x}" for x in parts])
    return f"""SELECT {keys}, count(*)::BIGINT AS blocks, count(net_bps)::BIGINT AS defined, (sum(selected) FILTER (net_bps IS NOT NULL))::BIGINT AS rows, {means},
  round((sum(entry_half_bps * selected) + sum(exit_half_bps * selected)) / nullif(sum(selected) FILTER (net_bps IS NOT NULL), 0), 6) AS pooled_cost_bps FROM z GROUP BY {keys}"""


@register("".join(f", y{d} AS ({_costs_sql(d, 5 + d)}), w{d} AS (SELECT *, abs(p) > 0.3 AND g IS NOT NULL AS k FROM y{d}), z{d} AS (SELECT symbol, day, {d} AS latency, {_SELECTED} FROM w{d} GROUP BY symbol, day)" for d in (0, 1, 5)) + ", z AS (SELECT * FROM z0 UNION ALL SELECT * FROM z1 UNION ALL SELECT * FROM z5) " + _edge_sql("latency"), "quotes")
def edge_vs_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edge and costs by delay, from blocks of a stock and a day."""
    predicted = _predicted(spark, sf_dir)
    cells = [evaluation.selected_costs(labels.cost_components(predicted, 5, d), ["symbol", "day"], "p", 0.3).withColumn("latency", F.lit(d)) for d in (0, 1, 5)]
    return rounded(evaluation.edge_and_costs(reduce(DataFrame.unionByName, cells), ["latency"]))


@register(_CELLS + ", x AS (SELECT symbol, day, arm, sum(n) AS n FROM cells GROUP BY ALL) SELECT symbol, day, min(n)::BIGINT AS least, max(n)::BIGINT AS most, count(*)::BIGINT AS arms FROM x GROUP BY symbol, day HAVING min(n) <> max(n)", "scored")
def unequal_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stock-days whose arms do not select the same number of rows."""
    rows = view(spark, sf_dir, "scored").where("actual IS NOT NULL")
    long = rows.where("abs(p_top) > 0.2").select("symbol", "day", F.lit("top").alias("arm")).union(rows.where("abs(p_depth) > 0.2").select("symbol", "day", F.lit("depth")))
    counts = rows.select("symbol", "day").distinct().join(F.broadcast(spark.createDataFrame([("top",), ("depth",)], "arm string"))).join(long.groupBy("symbol", "day", "arm").agg(F.count("*").alias("n")), ["symbol", "day", "arm"], "left")
    every = view(spark, sf_dir, "scored").select("symbol", "day").distinct().join(counts, ["symbol", "day"], "left")
    return every.groupBy("symbol", "day").agg(F.min(F.coalesce("n", F.lit(0))).alias("least"), F.max(F.coalesce("n", F.lit(0))).alias("most"), F.lit(2).cast("long").alias("arms")).where("least <> most")


@register(_CELLS + ", x AS (SELECT arm, day, avg(v) AS v FROM cells GROUP BY ALL) SELECT arm, count(v)::BIGINT AS seeds, round(min(v), 6) AS least, round(max(v), 6) AS most, round(avg(v), 6) AS mean, round(stddev_pop(v), 6) AS deviation FROM x GROUP BY arm", "scored")
def spread_over_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The summary that is made over seeds, here over days."""
    return rounded(evaluation.spread_over_seeds(_cells(spark, sf_dir).groupBy("arm", "day").agg(F.avg("v").alias("v")), ["arm"], "v"))


@register("SELECT symbol, period, count(*)::BIGINT AS n, round(avg(actual), 6) AS mean FROM scored WHERE actual IS NOT NULL GROUP BY GROUPING SETS ((), (symbol), (period))", "scored")
def levels_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(evaluation.levels_summary(view(spark, sf_dir, "scored").where("actual IS NOT NULL"), "symbol", "period", "actual"))


# ---- paired comparison and resampling

_DELTAS = _CELLS + """, dc AS (SELECT symbol, day, period, arm, avg(v) AS v FROM cells GROUP BY ALL),
dl AS (SELECT a.symbol, a.day, a.period, round(a.v - b.v, 9) AS delta FROM dc a JOIN dc b ON a.symbol = b.symbol AND a.day = b.day AND a.arm = 'top' AND b.arm = 'depth' WHERE a.v - b.v IS NOT NULL)"""


def _deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = _cells(spark, sf_dir).groupBy("symbol", "day", "period", "arm").agg(F.avg("v").alias("v"))
    return metrics.paired(cells, ["symbol", "day", "period"], "arm", "top", "depth", "v").withColumn("delta", F.round("delta", 9))


def _pick(parts: str, modulus: str) -> str:
    return f"('0x' || substr(md5(concat_ws(':', {parts})), 1, 15))::BIGINT % ({modulus})"


@register(_DELTAS + "SELECT s.period, round(avg(d.delta), 6) AS mean_without FROM (SELECT DISTINCT period FROM dl) s JOIN dl d ON s.period <> d.period GROUP BY s.period", "scored")
def leave_one_period_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mean difference of two arms without each period."""
    return rounded(metrics.leave_one_out(_deltas(spark, sf_dir), "period"))


@register(_CELLS + """
, pc AS (SELECT symbol, period, arm, avg(v) AS v FROM cells WHERE NOT (symbol = 'S2' AND period = 'P0' AND arm = 'top') GROUP BY ALL), gr AS (SELECT s.symbol, p.period FROM (SELECT DISTINCT symbol FROM cells) s CROSS JOIN (SELECT DISTINCT period FROM cells) p),
dl AS (SELECT gr.symbol, gr.period, a.v - b.v AS delta FROM gr LEFT JOIN (SELECT * FROM pc WHERE arm = 'top') a USING (symbol, period) LEFT JOIN (SELECT * FROM pc WHERE arm = 'depth') b USING (symbol, period))
SELECT 'symbol' AS axis, m.symbol AS member, count(*)::BIGINT AS expected, count(delta)::BIGINT AS defined, CASE WHEN count(*) = count(delta) THEN round(avg(delta), 6) END AS mean_without FROM (SELECT DISTINCT symbol FROM gr) m JOIN dl ON dl.symbol <> m.symbol GROUP BY m.symbol
UNION ALL SELECT 'period', m.period, count(*)::BIGINT, count(delta)::BIGINT, CASE WHEN count(*) = count(delta) THEN round(avg(delta), 6) END FROM (SELECT DISTINCT period FROM gr) m JOIN dl ON dl.period <> m.period GROUP BY m.period
""", "scored")  # fmt: skip
def strict_leave_one_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The strict difference without each stock and without each period; one block lacks an arm, so few members stay defined."""
    cells = _cells(spark, sf_dir).where("NOT (symbol = 'S2' AND period = 'P0' AND arm = 'top')").groupBy("symbol", "period", "arm").agg(F.avg("v").alias("v"))
    rows = _cells(spark, sf_dir)
    grid = rows.select("symbol").distinct().join(F.broadcast(rows.select("period").distinct()))
    each = [resampling.strict_without(cells, grid, ["symbol", "period"], m, "arm", "top", "depth", "v").withColumnRenamed(m, "member").withColumn("axis", F.lit(m)) for m in ("symbol", "period")]
    return rounded(reduce(DataFrame.unionByName, each))


@register(_DELTAS + f"""
, pl AS (SELECT row_number() OVER (ORDER BY symbol, day) - 1 AS place, delta FROM dl), n AS (SELECT count(*) AS n FROM pl),
dr AS (SELECT d.id, {_pick("'7', d.id, i.i", "n.n")} AS place FROM range(10000) d(id) CROSS JOIN n CROSS JOIN LATERAL (SELECT unnest(range(n.n)) AS i) i), m AS (SELECT id, avg(delta) AS m FROM dr JOIN pl USING (place) GROUP BY id)
SELECT round(quantile_cont(m, 0.025), 6) AS low, round(quantile_cont(m, 0.975), 6) AS high, count(*)::BIGINT AS draws FROM m
""", "scored")  # fmt: skip
def block_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(resampling.block_bootstrap(_deltas(spark, sf_dir), ["symbol", "day"], 10_000))


@register(_DELTAS + f"""
, dd AS (SELECT period, day, avg(delta) AS delta FROM dl GROUP BY ALL), pl AS (SELECT *, row_number() OVER (PARTITION BY period ORDER BY day) - 1 AS place FROM dd), sz AS (SELECT period, count(*) AS n FROM pl GROUP BY period),
st AS (SELECT d.id, period, n, k, {_pick("'3', d.id, period, k", "n - 3 + 1")} AS s FROM range(200) d(id) CROSS JOIN sz CROSS JOIN LATERAL (SELECT unnest(range((n - 1) // 3 + 1)) AS k) x),
pk AS (SELECT id, period, s + j AS place FROM st CROSS JOIN range(3) r(j) WHERE k * 3 + j < n), m AS (SELECT id, avg(delta) AS m FROM pk JOIN pl USING (period, place) GROUP BY id)
SELECT round(quantile_cont(m, 0.025), 6) AS low, round(quantile_cont(m, 0.975), 6) AS high, count(*)::BIGINT AS draws FROM m
""", "scored")  # fmt: skip
def moving_block_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of three days inside each period."""
    days = _deltas(spark, sf_dir).groupBy("period", "day").agg(F.avg("delta").alias("delta"))
    return rounded(resampling.moving_block_bootstrap(days, "period", "day", 3, 200, 3))


@register(_DELTAS + """
SELECT 'all' AS scope, NULL::VARCHAR AS member, round(avg(delta), 6) AS mean_delta, count(*)::BIGINT AS blocks FROM dl UNION ALL SELECT 'only', symbol, round(avg(delta), 6), count(*)::BIGINT FROM dl GROUP BY symbol
UNION ALL SELECT 'without', s.symbol, round(avg(delta), 6), count(*)::BIGINT FROM (SELECT DISTINCT symbol FROM dl) s JOIN dl ON dl.symbol <> s.symbol GROUP BY s.symbol
""", "scored")  # fmt: skip
def contrast_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(resampling.contrast(_deltas(spark, sf_dir), "symbol"))


@register("""
, a AS (SELECT symbol, day, 'F1' AS arm, avg(sign(p_top) * actual) AS v FROM scored GROUP BY ALL UNION ALL SELECT symbol, day, 'F2', avg(sign(p_depth) * actual) FROM scored GROUP BY ALL UNION ALL SELECT symbol, day, 'F3', avg(sign(p_top + p_depth) * actual) FROM scored GROUP BY ALL),
w AS (SELECT symbol, day, max(v) FILTER (arm = 'F1') AS f1, max(v) FILTER (arm = 'F2') AS f2, max(v) FILTER (arm = 'F3') AS f3 FROM a GROUP BY ALL),
s AS (SELECT 'F2 - F1' AS step, f2 - f1 AS delta FROM w UNION ALL SELECT 'F3 - F2', f3 - f2 FROM w)
SELECT step, count(delta)::BIGINT AS blocks, round(avg(delta), 6) AS mean_delta, count(*) FILTER (round(delta, 9) > 0)::BIGINT AS wins FROM s WHERE delta IS NOT NULL GROUP BY step
""", "scored")  # fmt: skip
def feature_ladder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each feature group less the one before it."""
    rows = view(spark, sf_dir, "scored")
    arms = {"F1": F.col("p_top"), "F2": F.col("p_depth"), "F3": F.col("p_top") + F.col("p_depth")}
    wide = rows.groupBy("symbol", "day").agg(*[F.avg(F.signum(p) * F.col("actual")).alias(a) for a, p in arms.items()])
    cells = wide.select("symbol", "day", F.explode(F.create_map(*[x for a in arms for x in (F.lit(a), F.round(a, 9))])).alias("arm", "v"))
    return rounded(resampling.ladder(cells, ["symbol", "day"], "arm", list(arms), "v"))


@register(_DELTAS + """
, g AS (SELECT s.symbol, d.day FROM (SELECT DISTINCT symbol FROM dc) s CROSS JOIN (SELECT DISTINCT day FROM dc) d)
SELECT count(*)::BIGINT AS expected, count(delta)::BIGINT AS defined, round(CASE WHEN count(delta) = count(*) THEN avg(delta) END, 6) AS mean_delta, round(CASE WHEN count(delta) = count(*) THEN median(delta) END, 6) AS median_delta FROM g LEFT JOIN dl USING (symbol, day)
""", "scored")  # fmt: skip
def strict_paired(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paired summary over all stock-days, undefined as long as one of them is."""
    cells = _cells(spark, sf_dir).groupBy("symbol", "day", "arm").agg(F.avg("v").alias("v"))
    grid = cells.select("symbol").distinct().join(F.broadcast(cells.select("day").distinct()))
    return rounded(resampling.strict_paired(cells, grid, ["symbol", "day"], "arm", "top", "depth", "v"))


@register(_CLEAN + _binned("symbol, period", 10) + """
, t AS (SELECT symbol, period, bin, avg(actual) AS m FROM b GROUP BY ALL)
SELECT symbol, period, count(DISTINCT bin)::BIGINT AS bins, round(CASE WHEN count(DISTINCT bin) = 10 THEN avg(m) FILTER (bin IN (0, 9)) - avg(m) FILTER (bin IN (4, 5)) END, 6) AS tail_minus_centre FROM t GROUP BY symbol, period
""", "scored")  # fmt: skip
def tail_contrasts(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = metrics.bucket_table(view(spark, sf_dir, "scored"), ["symbol", "period"], "p_top", "actual", 10)
    return rounded(resampling.tail_contrast(table, ["symbol", "period"], "mean_actual", 10))


@register(_CELLS + """
, pc AS (SELECT symbol, period, arm, avg(v) AS v FROM cells GROUP BY ALL), w AS (SELECT symbol, period, max(v) FILTER (arm = 'top') AS t, max(v) FILTER (arm = 'depth') AS d FROM pc GROUP BY ALL)
SELECT period, count(*)::BIGINT AS stocks, round(CASE WHEN count(t) = count(*) THEN avg(t) END, 6) AS top_mean, round(CASE WHEN count(d) = count(*) THEN avg(d) END, 6) AS depth_mean, round(CASE WHEN count(t - d) = count(*) THEN avg(t - d) END, 6) AS mean_delta, count(*) FILTER (round(t - d, 9) > 0)::BIGINT AS wins FROM w GROUP BY period
""", "scored")  # fmt: skip
def primary_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both models beside each other by period, strict over stocks."""
    cells = _cells(spark, sf_dir).groupBy("symbol", "period", "arm").agg(F.avg("v").alias("v"))
    wide = cells.groupBy("symbol", "period").pivot("arm", ["top", "depth"]).agg(F.first("v")).withColumn("delta", F.col("top") - F.col("depth"))
    strict = lambda c: F.when(F.count(c) == F.count("*"), F.avg(c))
    return rounded(wide.groupBy("period").agg(F.count("*").alias("stocks"), strict("top").alias("top_mean"), strict("depth").alias("depth_mean"), strict("delta").alias("mean_delta"), F.count_if(F.round("delta", 9) > 0).alias("wins")))


@register("""
SELECT symbol, count(*)::BIGINT AS n, round(avg(sign(p_top) * actual), 6) AS transfer, round(avg(sign(p_depth) * actual), 6) AS within, round(avg(sign(p_top) * actual) - avg(sign(p_depth) * actual), 6) AS delta FROM scored WHERE actual IS NOT NULL GROUP BY symbol
""", "scored")  # fmt: skip
def transfer_deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A transferred model less the stock's own on equal rows, which a one-to-one join on the identity makes sure of."""
    rows = view(spark, sf_dir, "scored").where("actual IS NOT NULL")
    both = joins.declared_join(rows.select("symbol", "event_id", "actual", F.col("p_top").alias("transfer")), rows.select("event_id", F.col("p_depth").alias("own")), ["event_id"], "one_to_one")
    signed = lambda p: F.avg(F.signum(p) * F.col("actual"))
    return rounded(both.groupBy("symbol").agg(F.count("*").alias("n"), signed("transfer").alias("transfer"), signed("own").alias("within"), (signed("transfer") - signed("own")).alias("delta")))
