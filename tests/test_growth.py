"""Work that grows no faster than the input: plans and results on crowded keys."""

import random

import pytest
from pyspark.sql import functions as F


def _plan(frame):
    return frame._jdf.queryExecution().optimizedPlan().toString().lower()


def test_recent_trades_of_a_crowded_hour_slide_no_frame(spark):
    from tickframe.operators.features import recent_trades

    dice, hour = random.Random(7), 1000
    times = [dice.randrange(3 * hour) for _ in range(400)] + [0, hour - 1, hour, 2 * hour - 1, 2 * hour]
    trades = [("A", t, dice.choice(["buy", "sell"]), float(dice.randrange(9))) for t in times] + [("A", hour, "buy", None)]
    decisions = [("A", dice.choice(times) + dice.choice([0, hour - 1, hour]), i) for i in range(300)]
    decisions += [decisions[5], ("B", 5, 900)]
    out = recent_trades(spark.createDataFrame(decisions, "symbol string, us long, event_id long"), spark.createDataFrame(trades, "symbol string, us long, side string, size double"), hour)
    assert "rangeframe, -" not in _plan(out)
    want = []
    for symbol, us, i in decisions:
        near = [t for t in trades if t[0] == symbol and us - hour < t[1] <= us]
        want.append((i, *[sum(t[3] or 0.0 for t in near if t[2] == side) for side in ("buy", "sell")], len(near)))
    assert sorted(tuple(r)[:4] for r in out.collect()) == sorted(want)


def test_order_problems_take_one_sort(spark):
    from tickframe.operators.orderlog import order_problems

    rows = [("A", "d", 0, 5, 1, "A", 1, 100, 5), ("A", "d", 1, 4, 1, "A", -1, -1, -1), ("A", "d", 2, 6, 2, "M", 2, 101, -7), ("A", "d", 3, 7, 1, "D", -1, -1, -1), ("A", "d", 4, 8, 1, "D", -1, -1, -1), ("A", "d", 5, 9, 3, "X", 1, 99, 1), ("A", "d", 6, 9, 0, "F", -1, -1, -1), ("A", "d", 7, 9, 2, "A", 5, 101, 1), ("A", "d", 8, 9, 4, "A", 3, 101, 1), ("B", "d", 0, 1, 0, "F", -1, -1, -1)]
    out = order_problems(spark.createDataFrame(rows, "symbol string, day string, event_index long, us long, order_id long, action string, side long, price long, volume long"))
    assert "window" not in _plan(out)
    found = sorted((r.event_index, r.problem) for r in out.collect())
    assert found == [(0, "day does not begin with F"), (1, "duplicate add"), (1, "time goes back"), (2, "negative depth"), (2, "unknown order"), (4, "unknown order"), (5, "unknown action"), (8, "invalid side or volume")]


def test_labels_are_dealt_anew_without_a_task_a_group(spark):
    from pyspark.sql import Window
    from tickframe.operators.folds import permute_labels

    rows = spark.range(500).selectExpr("id AS event_id", "CAST(id % 3 AS INT) AS fold", "id * 7 AS place", "id / 10D AS actual")
    out = permute_labels(rows, ["fold"], ["event_id"], "actual")
    assert "row_number" not in _plan(out) and out.columns == [*rows.columns, "shuffled"]
    mixed = rows.select("fold", F.col("actual").alias("shuffled"), F.row_number().over(Window.partitionBy("fold").orderBy(F.md5(F.concat_ws(":", F.lit("1"), "event_id")), "event_id")).alias("_n"))
    want = rows.withColumn("_n", F.row_number().over(Window.partitionBy("fold").orderBy("event_id"))).join(mixed, ["fold", "_n"]).select(*out.columns)
    assert sorted(out.collect()) == sorted(want.collect())


def test_boosted_trees_compute_their_rows_once(spark, monkeypatch):
    from tickframe.plans import table_queries

    seen = spark.sparkContext.accumulator(0)

    def mark(i: int) -> int:
        seen.add(1)
        return i

    rows = spark.range(600).select(F.udf(mark, "long").asNondeterministic()("id").alias("v")).selectExpr("'S' AS symbol", "IF(v % 3 = 0, 'P2', 'P1') AS period", "v % 17 / 17D AS p_top", "v % 5 / 5D AS p_depth", "v % 3 / 1D AS spread_bps", "v % 17 * 1D AS actual")
    monkeypatch.setattr(table_queries, "view", lambda *_: rows)
    assert len(table_queries.boosted_trees(spark, "").collect()) == 3
    assert seen.value == 600


@pytest.fixture
def asked(monkeypatch):
    """(trees, depth, rows) that fits of boosted trees were asked for; one tree is fitted."""
    from pyspark.ml.regression import GBTRegressor

    seen, whole = [], GBTRegressor.fit

    def counted(self, rows):
        seen.append((self.getMaxIter(), self.getMaxDepth(), rows.count()))
        return whole(self, rows, {self.maxIter: 1})

    monkeypatch.setattr(GBTRegressor, "fit", counted)
    return seen


def test_boosted_trees_fit_every_tree_of_a_variant(spark, monkeypatch, asked):
    from tickframe.operators import models
    from tickframe.plans import table_queries

    rows = spark.range(300).selectExpr("'S' AS symbol", "IF(id % 3 = 0, 'P2', 'P1') AS period", "id % 17 / 17D AS p_top", "id % 5 / 5D AS p_depth", "id % 3 / 1D AS spread_bps", "id % 17 * 1D AS actual")
    monkeypatch.setattr(table_queries, "view", lambda *_: rows)
    out = table_queries.boosted_trees(spark, "").collect()
    assert sorted(r.variant for r in out) == sorted(models.TREES) and [r.n for r in out] == [100] * 3
    assert sorted(asked) == sorted((trees, depth, 200) for trees, depth, *_ in models.TREES.values())


def test_walk_forward_trees_fit_every_tree_of_every_fold(spark, monkeypatch, asked):
    from tickframe.plans import table_queries

    rows = spark.range(300).selectExpr("id AS event_id", "id * 3600000000 AS us", "id % 17 / 17D AS p_top", "id % 5 / 5D AS p_depth", "id % 3 / 1D AS spread_bps", "id % 17 * 1D AS actual")
    monkeypatch.setattr(table_queries, "view", lambda *_: rows)
    out = table_queries.walk_forward_trees(spark, "").collect()
    assert {(r.fold, r.run, r.n) for r in out} == {(f, run, 30 if f is not None else 150) for f in (0, 1, 2, 3, 4, None) for run in ("fitted", "shuffled")}
    assert [(trees, depth) for trees, depth, _ in asked] == [(200, 3)] * 10
