"""Registered queries on full order logs and look-ahead races; they join those of `queries`."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tickframe.operators import orderlog, races
from tickframe.plans.queries import register, rounded
from tickframe.sources import feed
from tickframe.sources.tables import work_folder
from tickframe.views import view, with_views

_DAY = "PARTITION BY symbol, day ORDER BY event_index"
_UP_TO = "ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW"

_VERSIONS = f"""
, ep AS (SELECT *, count(*) FILTER (action = 'F') OVER w AS epoch, count(*) FILTER (action IN ('F', 'Y')) OVER w AS barriers FROM log WINDOW w AS ({_DAY} {_UP_TO})),
lv AS (SELECT *, count(*) FILTER (action = 'D') OVER (PARTITION BY symbol, day, epoch, order_date, order_id ORDER BY event_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS life FROM ep WHERE action <> 'F'),
fl AS (SELECT *, last_value(nullif(price, -1) IGNORE NULLS) OVER w AS p1, last_value(nullif(volume, -1) IGNORE NULLS) OVER w AS v1, row_number() OVER (PARTITION BY symbol, day, epoch, order_date, order_id, life ORDER BY event_index) > 1 AS known
  FROM lv WINDOW w AS (PARTITION BY symbol, day, epoch, order_date, order_id, life ORDER BY event_index {_UP_TO})),
vv AS (SELECT *, lag(p1) OVER w AS p0, lag(v1) OVER w AS v0, CASE WHEN action <> 'D' THEN p1 END AS pn, CASE WHEN action <> 'D' THEN v1 END AS vn FROM fl WINDOW w AS (PARTITION BY symbol, day, epoch, order_date, order_id, life ORDER BY event_index))
"""
_LEVELS = _VERSIONS + f"""
, ch AS (SELECT symbol, day, epoch, event_index, side, pn AS price, vn AS c, 1 AS k FROM vv WHERE pn > 0 UNION ALL SELECT symbol, day, epoch, event_index, side, p0, -v0, -1 FROM vv WHERE p0 > 0),
nt AS (SELECT symbol, day, epoch, event_index, side, price, sum(c) AS c, sum(k) AS k FROM ch GROUP BY ALL),
ls AS (SELECT *, sum(c) OVER w AS q, sum(k) OVER w AS n, lead(event_index) OVER (PARTITION BY symbol, day, epoch, side, price ORDER BY event_index) AS until FROM nt WINDOW w AS (PARTITION BY symbol, day, epoch, side, price ORDER BY event_index {_UP_TO})),
live AS (SELECT e.symbol, e.day, e.event_index, l.side, l.price, l.q, l.n FROM ep e JOIN ls l ON e.symbol = l.symbol AND e.day = l.day AND e.epoch = l.epoch AND l.event_index <= e.event_index AND (l.until IS NULL OR l.until > e.event_index) WHERE l.q <> 0),
up AS (SELECT symbol, day, event_index, sum((action <> 'D' AND coalesce(pn, 0) <= 0)::INT - (known AND coalesce(p0, 0) <= 0)::INT) OVER (PARTITION BY symbol, day, epoch ORDER BY event_index {_UP_TO}) AS unpriced FROM vv),
tp AS (SELECT symbol, day, event_index, coalesce(list(price ORDER BY price DESC) FILTER (side = 1), []) AS bp, coalesce(list(q ORDER BY price DESC) FILTER (side = 1), []) AS bq, coalesce(list(n ORDER BY price DESC) FILTER (side = 1), []) AS bn,
  coalesce(list(price ORDER BY price) FILTER (side = 2), []) AS ap, coalesce(list(q ORDER BY price) FILTER (side = 2), []) AS aq, coalesce(list(n ORDER BY price) FILTER (side = 2), []) AS an FROM live GROUP BY ALL),
bk AS (SELECT e.symbol, e.day, e.epoch, e.event_index, e.us, e.action, e.barriers, coalesce(unpriced, 0) AS unpriced, bp, bq, bn, ap, aq, an FROM ep e LEFT JOIN tp USING (symbol, day, event_index) LEFT JOIN up USING (symbol, day, event_index))
"""
_SNAPSHOTS = _LEVELS + f"""
, ok AS (SELECT * FROM bk WHERE unpriced = 0 AND len(bp) >= 2 AND len(ap) >= 2 AND bp[1] < ap[1]),
fg AS (SELECT *, CASE WHEN event_index = lag(event_index) OVER ({_DAY}) + 1 THEN 0 ELSE 1 END AS s, least(bp[1] - bp[2], ap[2] - ap[1]) AS g FROM ok)
"""


def _packed(levels: str) -> Column:
    return F.array_join(F.transform(levels, lambda x: F.concat_ws(":", x["px"], x["sz"])), ",")


@register(_SNAPSHOTS + f"""
SELECT symbol, day, event_index, (sum(s) OVER w)::BIGINT AS segment, (min(g) OVER w)::BIGINT AS tick, barriers::BIGINT AS barriers, concat(bp[1], ':', bq[1], ',', bp[2], ':', bq[2]) AS bids, concat(ap[1], ':', aq[1], ',', ap[2], ':', aq[2]) AS asks
FROM fg WINDOW w AS ({_DAY} {_UP_TO})
""", "log")  # fmt: skip
def book_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Valid two-level books of the order log, by segments."""
    rows = orderlog.snapshots(view(spark, sf_dir, "log"), levels=2)
    return rows.select("symbol", "day", "event_index", "segment", "tick", "barriers", _packed("bids").alias("bids"), _packed("asks").alias("asks"))


@register(_LEVELS + """
, bz AS (SELECT symbol, day, event_index, unpriced, coalesce(bp, []) AS bp, coalesce(bq, []) AS bq, coalesce(bn, []) AS bn, coalesce(ap, []) AS ap, coalesce(aq, []) AS aq, coalesce(an, []) AS an FROM bk)
SELECT symbol, day, event_index, len(bp)::INT AS bid_levels, len(ap)::INT AS ask_levels, sha256(concat_ws('|', array_to_string(list_transform(range(1, len(bp) + 1), lambda i: concat_ws(':', bp[i], bq[i], bn[i])), ','), array_to_string(list_transform(range(1, len(ap) + 1), lambda i: concat_ws(':', ap[i], aq[i], an[i])), ','), unpriced::BIGINT)) AS state FROM bz
""", "log")  # fmt: skip
def book_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A digest of the whole book after each message: every level with its quantity and orders, and the unpriced orders."""
    return orderlog.book_states(view(spark, sf_dir, "log")).select("symbol", "day", "event_index", "bid_levels", "ask_levels", "state")


@register(_SNAPSHOTS.replace("bp[1] < ap[1]", "bp[1] < ap[1] AND (us // 1000000 + 3600) % 86400 BETWEEN 36000 AND 57599") + f"""
, sg AS (SELECT symbol, day, count(*) AS snapshot_rows, sum(s) AS segments FROM fg GROUP BY ALL)
SELECT symbol, day, count(*)::BIGINT AS source_rows, {", ".join(f"count(*) FILTER (action = '{a}')::BIGINT AS n_{a.lower()}" for a in "FAYMD")}, count(*) FILTER (NOT (us // 1000000 + 3600) % 86400 BETWEEN 36000 AND 57599)::BIGINT AS outside_window,
  coalesce(any_value(snapshot_rows), 0)::BIGINT AS snapshot_rows, coalesce(any_value(segments), 0)::BIGINT AS segments,
  (count(*) - count(*) FILTER (NOT (us // 1000000 + 3600) % 86400 BETWEEN 36000 AND 57599) - coalesce(any_value(snapshot_rows), 0))::BIGINT AS invalid_book
FROM bk LEFT JOIN sg USING (symbol, day) GROUP BY symbol, day
""", "log")  # fmt: skip
def day_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counters of the replay in the session of 10 to 16 o'clock, Warsaw time (an hour ahead of UTC in these tables)."""
    return orderlog.day_audit(view(spark, sf_dir, "log"), 2, "Europe/Warsaw")


@register(_VERSIONS + """
SELECT symbol, day, event_index, CASE WHEN action = 'A' AND known THEN 'duplicate add' ELSE 'unknown order' END AS problem FROM vv WHERE action = 'A' AND known OR action IN ('M', 'D') AND NOT known
""", "log")  # fmt: skip
def order_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orderlog.order_problems(view(spark, sf_dir, "log"))


_QUEUE = _LEVELS + f"""
, qp AS (SELECT *, NOT known OR pn IS DISTINCT FROM p0 AS moved, priority <> -1 AS reported FROM vv),
qa AS (SELECT *, last_value(CASE WHEN reported THEN priority WHEN moved OR action = 'M' AND {{reset}} THEN us END IGNORE NULLS) OVER (PARTITION BY symbol, day, epoch, order_date, order_id, life ORDER BY event_index {_UP_TO}) AS pr FROM qp),
qb AS (SELECT *, lag(pr) OVER (PARTITION BY symbol, day, epoch, order_date, order_id, life ORDER BY event_index) AS pr0 FROM qa),
qc AS (SELECT *, last_value(CASE WHEN coalesce(CASE WHEN reported THEN moved OR pr <> pr0 ELSE moved OR action = 'M' AND {{reset}} END, true) THEN event_index END IGNORE NULLS) OVER (PARTITION BY symbol, day, epoch, order_date, order_id, life ORDER BY event_index {_UP_TO}) AS entered FROM qb),
qq AS (SELECT *, lag(entered) OVER (PARTITION BY symbol, day, epoch, order_date, order_id, life ORDER BY event_index) AS entered0 FROM qc)
"""


@register(_QUEUE.format(reset="true") + "SELECT symbol, day, event_index, order_date, order_id, pr AS priority, pr0 AS priority_before, entered, entered0 AS entered_before FROM qq", "log")
def queue_priorities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Priority and entry of every version, where a change without a report loses its place."""
    rows = orderlog.queue_orders(view(spark, sf_dir, "log"), reset=True)
    return rows.select("symbol", "day", "event_index", "order_date", "order_id", F.col("new_priority").alias("priority"), F.col("old_priority").alias("priority_before"), F.col("new_entered").alias("entered"), F.col("old_entered").alias("entered_before"))


#: The session of 10 to 16 o'clock, Warsaw time (an hour ahead of UTC in these tables).
_OPEN = "(us // 1000000 + 3600) % 86400 BETWEEN 36000 AND 57599"
_EVENTS = _QUEUE + f"""
, eg AS (SELECT *, coalesce(unpriced = 0 AND len(bp) >= 2 AND len(ap) >= 2 AND bp[1] < ap[1] AND {{open}}, false) AS valid FROM bk),
es AS (SELECT *, CASE WHEN valid AND NOT coalesce(lag(valid) OVER ({_DAY}), false) THEN 1 ELSE 0 END AS s, CASE WHEN valid THEN least(bp[1] - bp[2], ap[2] - ap[1]) END AS g FROM eg),
ev AS (SELECT b.symbol, b.day, b.event_index, b.us, b.barriers, bp[1] AS bid_px, bq[1] AS bid_size, bn[1] AS bid_orders, ap[1] AS ask_px, aq[1] AS ask_size, an[1] AS ask_orders, valid, sum(s) OVER w AS segment, min(g) OVER w AS tick,
  sum(CASE WHEN q.action = 'D' AND known THEN -1 WHEN q.action <> 'D' AND NOT known THEN 1 ELSE 0 END) OVER (PARTITION BY b.symbol, b.day, b.epoch ORDER BY b.event_index {_UP_TO}) AS live_orders,
  side, pn, vn, CASE WHEN q.action <> 'D' THEN entered END AS en, CASE WHEN q.action <> 'D' THEN pr END AS rn, p0, v0, entered0 AS e0, pr0 AS r0,
  coalesce(CASE WHEN NOT known THEN 0 WHEN q.action = 'D' THEN v0 WHEN q.action = 'M' AND pn IS NOT DISTINCT FROM p0 THEN greatest(0, v0 - vn) ELSE 0 END, 0) AS execution
  FROM es b LEFT JOIN (SELECT symbol, day, event_index, action, side, pn, vn, p0, v0, pr, pr0, entered, entered0, known FROM qq) q USING (symbol, day, event_index)
  WINDOW w AS (PARTITION BY b.symbol, b.day ORDER BY b.event_index {_UP_TO}))
"""


def _event_columns(suffix: str) -> str:
    return f"en AS new_entered{suffix}, e0 AS old_entered{suffix}, rn AS new_priority{suffix}, r0 AS old_priority{suffix}"


@register(
    f"SELECT * FROM ({with_views('log')} {_EVENTS.format(reset='false', open=_OPEN)} SELECT symbol, day, event_index, bid_px, bid_size::BIGINT AS bid_size, bid_orders::BIGINT AS bid_orders, ask_px, ask_size::BIGINT AS ask_size, ask_orders::BIGINT AS ask_orders, valid, segment::BIGINT AS segment, tick, live_orders::BIGINT AS live_orders, pn AS new_price, vn AS new_volume, p0 AS old_price, v0 AS old_volume, {_event_columns('')}, execution::BIGINT AS execution FROM ev)"
    f" JOIN ({with_views('log')} {_EVENTS.format(reset='true', open=_OPEN)} SELECT symbol, day, event_index, {_event_columns('_reset')} FROM ev) USING (symbol, day, event_index)"
)
def event_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every message with book, validity, tick and its order's versions under both rules of what a change does to its place."""
    rows = orderlog.event_rows(view(spark, sf_dir, "log"), 2, "Europe/Warsaw")
    return rows.select("symbol", "day", "event_index", "bid_px", "bid_size", "bid_orders", "ask_px", "ask_size", "ask_orders", "valid", "segment", "tick", "live_orders", "new_price", "new_volume", "old_price", "old_volume", *[f"{v}_{c}" for v in ("new", "old") for c in ("entered", "priority", "entered_reset", "priority_reset")], "execution")


def _event_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event rows of whole days, which the races run on: the sessions of the small tables hold too few messages for fills."""
    return orderlog.event_rows(view(spark, sf_dir, "log"), 2)


#: Versions, executions and live orders as the stream of order versions gives them; a message that breaks the rules changes nothing.
_VERSION_STREAM_SQL = _QUEUE.format(reset="false") + f"""
, cl AS (SELECT *, CASE WHEN action IN ('M', 'D') AND NOT known THEN 'unknown order' WHEN action = 'A' AND known THEN 'duplicate add' END AS problem FROM qq)
SELECT e.symbol, e.day, e.event_index, CASE WHEN p0 IS NOT NULL THEN q.side END AS old_side, p0 AS old_price, v0 AS old_volume, pr0 AS old_priority, entered0 AS old_entered,
  CASE WHEN q.action <> 'D' THEN q.side END AS new_side, pn AS new_price, vn AS new_volume, CASE WHEN q.action <> 'D' THEN pr END AS new_priority, CASE WHEN q.action <> 'D' THEN entered END AS new_entered,
  coalesce(CASE WHEN NOT known THEN 0 WHEN q.action = 'D' THEN v0 WHEN q.action = 'M' AND pn IS NOT DISTINCT FROM p0 THEN greatest(0, v0 - vn) ELSE 0 END, 0)::BIGINT AS execution,
  coalesce(sum(CASE WHEN q.action = 'D' AND known THEN -1 WHEN q.action <> 'D' AND NOT known THEN 1 ELSE 0 END) OVER (PARTITION BY e.symbol, e.day, e.epoch ORDER BY e.event_index {_UP_TO}), 0)::BIGINT AS live_orders, problem
FROM ep e LEFT JOIN (SELECT symbol, day, event_index, action, side, p0, v0, pr0, entered0, pn, vn, pr, entered, known, problem FROM cl) q USING (symbol, day, event_index)
"""


@register("SELECT symbol, day, 0::BIGINT AS problems, count(*)::BIGINT AS messages FROM log GROUP BY symbol, day", "log")
def queue_parity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Levels whose ordered queue and aggregate depth disagree, counted by stock-day beside its messages."""
    log = view(spark, sf_dir, "log")
    bad = orderlog.queue_parity(log).groupBy("symbol", "day").agg(F.count("*").alias("problems"))
    return log.groupBy("symbol", "day").agg(F.count("*").alias("messages")).join(bad, ["symbol", "day"], "left").select("symbol", "day", F.coalesce("problems", F.lit(0)).alias("problems"), "messages")


def _signals(events: DataFrame, model: str = "turn") -> DataFrame:
    """The event rows with the predictions of two made-up models; some valid and some invalid messages have none."""
    value = F.col("event_index") % 3 - 1 if model == "turn" else F.signum(F.col("bid_size") - F.col("ask_size"))
    return events.withColumn("prediction", F.when(F.col("event_index") % 4 != 3, value))


def _stored_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event rows as a table, written once for several passes."""
    path = work_folder(spark, "events")
    _event_rows(spark, sf_dir).write.parquet(path)
    return spark.read.parquet(path)


def _race_sql(latency: int, reset: str, horizon: int = 10, model: str = "turn") -> str:
    value = "n.event_index % 3 - 1" if model == "turn" else "coalesce(sign(n.bid_size - n.ask_size), 0)"
    known = "true" if model == "turn" else "n.bid_size - n.ask_size IS NOT NULL"
    return _EVENTS.format(reset=reset, open='true') + f"""
, ps AS (SELECT n.symbol, n.day, n.event_index, n.event_index + {latency} AS placement, {value} AS dir, a.segment, a.barriers, a.tick, a.bid_px, a.ask_px, a.bid_size, a.ask_size,
  CASE WHEN a.event_index IS NULL THEN 'no message' WHEN NOT n.valid THEN 'invalid signal' WHEN NOT a.valid THEN 'invalid placement' WHEN n.segment <> a.segment OR n.barriers <> a.barriers THEN 'other segment' END AS excluded
  FROM ev n LEFT JOIN ev a ON n.symbol = a.symbol AND n.day = a.day AND a.event_index = n.event_index + {latency} WHERE n.event_index % 4 <> 3 AND {known}),
pl AS (SELECT symbol, day, event_index, placement, excluded, segment, barriers, tick, CASE WHEN excluded IS NULL THEN dir END AS direction, CASE WHEN dir >= 0 THEN 1 ELSE 2 END AS my_side,
  CASE WHEN excluded IS NULL AND dir <> 0 THEN CASE WHEN dir >= 0 THEN bid_px ELSE ask_px END END AS price, CASE WHEN excluded IS NULL AND dir <> 0 THEN CASE WHEN dir >= 0 THEN bid_size ELSE ask_size END END AS queue_ahead, (bid_px + ask_px) / 2.0 AS entry_mid FROM ps),
ah AS (SELECT p.*, k, x.valid AND x.segment = p.segment AND x.barriers = p.barriers AS same, x.bid_px, x.ask_px, x.execution,
  coalesce(x.side = my_side AND x.pn = price, false) AS here1, coalesce(x.side = my_side AND x.p0 = price, false) AS here0, x.en, x.e0, x.vn, x.v0
  FROM pl p CROSS JOIN range(1, {horizon + 1}) r(k) LEFT JOIN ev x ON x.symbol = p.symbol AND x.day = p.day AND x.event_index = p.placement + k WHERE direction <> 0),
al AS (SELECT * FROM (SELECT *, count(*) FILTER (NOT coalesce(same, false)) OVER (PARTITION BY symbol, day, placement ORDER BY k {_UP_TO}) AS b FROM ah) WHERE b = 0),
lf AS (SELECT *, queue_ahead + coalesce(sum((CASE WHEN here1 AND en <= placement THEN vn ELSE 0 END) - (CASE WHEN here0 AND e0 <= placement THEN v0 ELSE 0 END)) OVER (PARTITION BY symbol, day, placement ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS l FROM al),
fn AS (SELECT symbol, day, placement, min(k) FILTER (here0 AND NOT (e0 <= placement) AND l <= 0 AND execution >= 1) AS fill_time, min(k) FILTER (direction * ((bid_px + ask_px) / 2.0 - entry_mid) <= -tick + 1e-10) AS adverse_time FROM lf GROUP BY ALL),
rc AS (SELECT p.*, fill_time, adverse_time, coalesce(fill_time IS NOT NULL AND (adverse_time IS NULL OR fill_time < adverse_time), false) AS fill_first, coalesce(adverse_time IS NOT NULL AND (fill_time IS NULL OR adverse_time < fill_time), false) AS adverse_first,
  coalesce(fill_time = adverse_time, false) AS simultaneous FROM pl p LEFT JOIN fn USING (symbol, day, placement))
"""


@register(_race_sql(1, "false", 50) + """
SELECT symbol, day, event_index, placement, excluded, direction::INT AS direction, queue_ahead::BIGINT AS queue_ahead, fill_time::INT AS fill_time, adverse_time::INT AS adverse_time, fill_first, adverse_first, simultaneous FROM rc
""", "log")  # fmt: skip
def queue_races(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which comes first within fifty messages of every placement: a fill, or an adverse move of the mid; or why none was placed."""
    raced = races.races_of(_signals(_event_rows(spark, sf_dir)), races.Race(50, (1,)))
    return raced.select("symbol", "day", "event_index", "placement", "excluded", "direction", "queue_ahead", "fill_time", "adverse_time", "fill_first", "adverse_first", "simultaneous")


@register(_race_sql(1, "false", 50) + """
, mk AS (SELECT r.*, r.placement + fill_time AS fa, (f.bid_px + f.ask_px) / 2.0 AS fm, CASE WHEN x.valid AND x.segment = r.segment AND x.barriers = r.barriers THEN (x.bid_px + x.ask_px) / 2.0 END AS m1, CASE WHEN y.valid AND y.segment = r.segment AND y.barriers = r.barriers THEN (y.bid_px + y.ask_px) / 2.0 END AS mr
  FROM rc r JOIN ev f ON f.symbol = r.symbol AND f.day = r.day AND f.event_index = r.placement + fill_time LEFT JOIN ev x ON x.symbol = r.symbol AND x.day = r.day AND x.event_index = r.placement + fill_time + 1
  LEFT JOIN ev y ON y.symbol = r.symbol AND y.day = r.day AND y.event_index = r.placement + 49 AND 49 >= fill_time)
SELECT symbol, day, event_index, round(direction * (m1 - fm) / fm * 1e4, 6) AS markout_1, round(2 * direction * (m1 - price) / price * 1e4, 6) AS spread_1, round(direction * (mr - fm) / fm * 1e4, 6) AS markout_remaining, round(2 * direction * (mr - price) / price * 1e4, 6) AS spread_remaining FROM mk
""", "log")  # fmt: skip
def fill_markouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Moves of the mid after each fill."""
    raced = races.races_of(_signals(_event_rows(spark, sf_dir)), races.Race(50, (1,))).where("fill_time IS NOT NULL")
    return rounded(raced.select("symbol", "day", "event_index", "markout_1", "spread_1", "markout_remaining", "spread_remaining"))


_RACE_STATS = """count(*) FILTER (excluded IS NOT NULL)::BIGINT AS excluded, count(*) FILTER (excluded IS NULL)::BIGINT AS eligible, count(*) FILTER (direction <> 0)::BIGINT AS placed, count(*) FILTER (direction = 0)::BIGINT AS zero_signals, count(fill_time)::BIGINT AS fills, round(avg((fill_time IS NOT NULL)::INT) FILTER (excluded IS NULL), 6) AS fill_probability,
  round(avg((direction <> 0 AND fill_time IS NULL)::INT) FILTER (excluded IS NULL), 6) AS unfilled, round(avg(fill_time), 6) AS mean_fill_time, round(median(fill_time), 6) AS median_fill_time, {quantiles},
  round(avg(fill_first::INT) FILTER (excluded IS NULL), 6) AS fill_first, round(avg(adverse_first::INT) FILTER (excluded IS NULL), 6) AS adverse_first, round(avg(simultaneous::INT) FILTER (excluded IS NULL), 6) AS simultaneous, round(1 - avg((fill_first OR adverse_first OR simultaneous)::INT) FILTER (excluded IS NULL), 6) AS no_event"""
_QUANTILES = ", ".join(f"round(quantile_cont(queue_ahead::DOUBLE, {q}) FILTER (direction <> 0), 6) AS {n}" for n, q in (("median_queue_ahead", 0.5), ("queue_ahead_p10", 0.1), ("queue_ahead_p90", 0.9)))
_PERIOD = "concat('P', CAST(floor((CAST(substring(day, 9, 2) AS INT) - 1) / 10.01) AS INT))"
_CELLS = [(horizon, model) for horizon in (10, 50) for model in ("turn", "size")]


def _race_blocks_sql() -> str:
    each = [
        f"SELECT * FROM ({with_views('log')} {_race_sql(latency, str(reset).lower(), horizon, model)} SELECT symbol, {_PERIOD} AS period, {_RACE_STATS.format(quantiles=_QUANTILES)}, {latency} AS latency, {str(reset).lower()} AS reset, {horizon} AS horizon, '{model}' AS model FROM rc GROUP BY ALL)"
        for horizon, model in _CELLS for latency in (0, 1, 5) for reset in (False, True)
    ]
    return " UNION ALL ".join(each)


@register(_race_blocks_sql())
def race_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cube of races by stock, period, horizon, model, delay, and what a change without a report does to an order's place.

    The event rows are written once; each horizon and model reads them once for all delays and both rules.
    """
    events, parts = _stored_events(spark, sf_dir), []
    for horizon, model in _CELLS:
        raced = races.races_of(_signals(events, model), races.Race(horizon, (0, 1, 5), (False, True)))
        parts.append(races.race_summary(raced.withColumn("period", F.expr(_PERIOD)), ["symbol", "period", "latency", "reset"], []).withColumns({"horizon": F.lit(horizon), "model": F.lit(model)}))
    return rounded(reduce(DataFrame.unionByName, parts))


@register(_race_sql(1, "false", 50) + f"""
, pz AS (SELECT * FROM rc WHERE direction <> 0), ed AS (SELECT symbol, list_sort(list_distinct(quantile_cont(queue_ahead::DOUBLE, [0, 0.25, 0.5, 0.75, 1.0]))) AS e FROM pz GROUP BY symbol),
bn AS (SELECT pz.*, greatest(0, len(list_filter(e[1:len(e)-1], lambda x: x < queue_ahead)) - 1) AS bin FROM pz JOIN ed USING (symbol))
SELECT symbol, bin::INT AS bin, {_RACE_STATS.format(quantiles=_QUANTILES)} FROM bn GROUP BY symbol, bin
""", "log")  # fmt: skip
def race_queue_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The races by quartile of the queue ahead."""
    path = work_folder(spark, "races")
    races.races_of(_signals(_event_rows(spark, sf_dir)), races.Race(50, (1,))).write.parquet(path)
    return rounded(races.race_deciles(spark.read.parquet(path), ["symbol"], "queue_ahead", [], 4))


_FEED = """
WITH lv AS (
  SELECT event_id AS receive_index, concat('S', CAST(user_id % 5 AS VARCHAR)) AS product_id, event_id % 5 = 0 AS resets, x.side, x.price, x.size FROM events, LATERAL (
    SELECT 'bid' AS side, 100 - event_id % 4 AS price, 1 + event_id % 7 AS size WHERE event_id % 5 = 0 UNION ALL SELECT 'bid', 95 - event_id % 4, 2 + event_id % 7 WHERE event_id % 5 = 0
    UNION ALL SELECT 'ask', 101 + event_id % 4, 1 + event_id % 3 WHERE event_id % 5 = 0 UNION ALL SELECT 'ask', 106 + event_id % 4, 2 + event_id % 3 WHERE event_id % 5 = 0
    UNION ALL SELECT 'bid', 99 - event_id % 3, event_id % 6 WHERE event_id % 5 IN (1, 2) UNION ALL SELECT 'ask', 102 + event_id % 3, event_id % 8 WHERE event_id % 5 IN (1, 2)) x
), ms AS (
  SELECT *, sum(resets::INT) OVER (PARTITION BY product_id ORDER BY receive_index ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS epoch FROM (SELECT DISTINCT product_id, receive_index, resets FROM lv)
), vs AS (
  SELECT lv.product_id, ms.epoch, lv.receive_index, side, price, size, lead(lv.receive_index) OVER (PARTITION BY lv.product_id, ms.epoch, side, price ORDER BY lv.receive_index) AS until FROM lv JOIN ms USING (product_id, receive_index)
), live AS (
  SELECT m.product_id, m.receive_index, m.epoch, side, price, size FROM ms m LEFT JOIN vs v ON m.product_id = v.product_id AND m.epoch = v.epoch AND v.receive_index <= m.receive_index AND (until IS NULL OR until > m.receive_index) AND size > 0 WHERE m.epoch > 0
)
SELECT product_id, receive_index, epoch::BIGINT AS epoch, max(price) FILTER (side = 'bid')::DOUBLE AS best_bid, (arg_max(size, price) FILTER (side = 'bid'))::DOUBLE AS bid_size, min(price) FILTER (side = 'ask')::DOUBLE AS best_ask, (arg_min(size, price) FILTER (side = 'ask'))::DOUBLE AS ask_size,
       count(price) FILTER (side = 'bid')::BIGINT AS bid_levels, count(price) FILTER (side = 'ask')::BIGINT AS ask_levels FROM live GROUP BY ALL
"""


@register(_FEED)
def feed_books(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The book after each feed message, from the first snapshot of a product on."""
    rows = feed.level_rows(feed.parse(feed.event_lines(spark.read.parquet(f"{sf_dir}/events.parquet"))))
    return orderlog.feed_books(rows, strict=False).select("product_id", "receive_index", "epoch", "best_bid", "bid_size", "best_ask", "ask_size", "bid_levels", "ask_levels")


@register("""
SELECT event_id, CASE WHEN event_id % 41 = 0 THEN 'unknown action' WHEN event_id % 43 = 0 THEN 'unknown symbol' ELSE 'price scale' END AS problem FROM events WHERE event_id % 41 = 0 OR event_id % 43 = 0 OR event_id % 47 = 0
""")  # fmt: skip
def record_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records with one fault in some forty each: an unknown kind, symbol or price scale."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    records = events.selectExpr("event_id", "IF(event_id % 41 = 0, 'X', 'A') AS action", "IF(event_id % 43 = 0, 'S9', concat('S', user_id % 5)) AS symbol", "IF(event_id % 47 = 0, 13, 2) AS price_level")
    return orderlog.record_problems(records, [f"S{i}" for i in range(5)]).select("event_id", "problem")
