"""Ranges, digests, gates, models and baselines on small tables made here."""

import numpy as np
import pytest
from pyspark.sql import functions as F


def test_quantiles_and_ranks_by_ranges_equal_plain_ones(spark):
    from tickframe.operators.metrics import quantile_bins
    from tickframe.operators.ranges import exact_quantiles, ranked

    rows = spark.range(3000).select(F.when(F.col("id") % 30 == 0, "b").otherwise("a").alias("k"), F.when(F.col("id") % 97 != 0, F.round(F.sin(F.col("id") * 7919.0), 2)).alias("v"))
    shares = [0.0, 0.1, 0.37, 0.5, 1.0]
    got = {r["k"]: r["quantiles"] for r in exact_quantiles(rows, ["k"], "v", shares).collect()}
    frame = rows.toPandas()
    for k, part in frame.groupby("k"):
        assert got[k] == pytest.approx(np.quantile(part.v.dropna(), shares))
    out = ranked(rows, ["k"], "v", "r").toPandas()
    want = out.groupby("k").v.rank()
    assert out.r.dropna().tolist() == pytest.approx(want[out.v.notna()].tolist()) and out.r[out.v.isna()].isna().all()
    binned = quantile_bins(rows.where("v IS NOT NULL"), ["k"], "v", 4).toPandas()
    assert sorted(binned.bin.unique()) == [0, 1, 2, 3] and binned.groupby("bin").v.min().is_monotonic_increasing


def test_equal_rows_in_another_order_have_another_digest(spark):
    from tickframe.operators.checks import ordered_digest

    rows = spark.createDataFrame([(i, i % 3, None if i % 4 == 0 else "x") for i in range(50)], "id long, a long, b string")
    digest = lambda df, order: tuple(ordered_digest(df, order, ["a", "b"]).first())
    assert digest(rows, ["id"]) == digest(rows.orderBy(F.desc("id")).repartition(7), ["id"])
    assert digest(rows, ["id"]) != digest(rows, [-F.col("id")])
    assert digest(rows, ["id"]) != digest(rows.withColumn("b", F.lit("x")), ["id"])


def test_a_changed_type_does_not_pass_the_gate(spark):
    from tickframe.operators.cohorts import manifest
    from tickframe.sources.tables import gated

    rows = spark.createDataFrame([("a", "d", 1)], "symbol string, day string, v long")
    with pytest.raises(ValueError, match="a/d types"):
        gated(rows.withColumn("v", F.col("v").cast("int")), manifest(rows, ["symbol", "day"], ["v"]), ["symbol", "day"], ["v"])


def test_totals_are_those_of_the_written_rows(spark, tmp_path):
    from tickframe.sources.tables import write_with_totals

    rows = spark.range(100).selectExpr("concat('S', id % 3) AS symbol", "concat('d', id % 2) AS day", "id")
    assert write_with_totals(rows, f"{tmp_path}/t", {"rows": F.count("*"), "most": F.max("id")}) == {"partitions": 6, "rows": 100, "most": 99}


def test_divisors_of_gaps_in_batches(spark):
    from tickframe.operators.evaluation import _gap_fold, gap_precision

    rows = spark.createDataFrame([("a", g) for g in [12, 18, 0, 30, None]] + [("b", 0)] + [(None, 7)] * 3 + [("a", 42)] * 50, "k string, gap long").repartition(5)
    got = {r["k"]: tuple(r)[1:] for r in gap_precision(rows, ["k"], "gap").collect()}
    assert got == {"a": (54, 1, 12, 6), "b": (1, 1, None, 0), None: (3, 0, 7, 7)}
    import pyarrow as pa

    batch = pa.RecordBatch.from_pydict({"k": ["x", "y", "y", "z"], "gaps": [1, 1, 1, 1], "zeros": [0, 0, 0, 0], "least_positive": [4, 6, 9, 5], "divisor": [4, 6, 9, 5]})
    lines = [row for out in _gap_fold(["k"], ["k", "gaps", "zeros", "least_positive", "divisor"], most_keys=1)([batch, batch.slice(3)]) for row in out.to_pylist()]
    assert [(x["k"], x["gaps"], x["divisor"]) for x in lines] == [("x", 1, 4), ("y", 2, 3), ("z", 2, 5)]


def test_trees_beat_their_control_and_name_their_gains(spark):
    from tickframe.operators import baseline, models

    rows = spark.range(1200).selectExpr("id AS event_id", "id * 10 AS us", "id * 10 + 25 AS future_us", "sin(id * 7919D) AS x", "cos(id * 104729D) AS noise").withColumn("y", F.when(F.col("x") > 0.2, 5.0).otherwise(-1.0) + F.col("noise") * 0.3)
    out = baseline.run_baseline(rows, ["us", "event_id"], "event_id", ["x", "noise"], "y", 700, 200, 5, 15, baseline.trees("standard", count=4))
    scores = {(r.fold, r.run): r.mse for r in out.scores.collect()}
    assert {f for f, _ in scores} == {0, 1, None} and all(scores[f, "fitted"] < 0.5 * scores[f, "shuffled"] for f in (0, 1, None))
    log = {r.fold: r for r in out.folds.collect()}
    assert log[0].train_before == 700 and log[0].train_after < 700 and log[0].last_label_after < log[0].test_first_us and log[0].test == 200
    assert out.predictions.count() == 800 and [r.n for r in out.buckets.orderBy("bin").collect()][0] > 0
    gains = models.boosted_trees(rows.where("event_id < 900").withColumn("k", F.lit(1)), rows.where("event_id >= 900").withColumn("k", F.lit(1)), ["x", "noise"], "y", ["k"], "small", count=3).first()
    assert gains.gain_x > 0.9 and gains.gain_x + gains.gain_noise == pytest.approx(1)
    with pytest.raises(ValueError, match="unknown variant"):
        baseline.trees("none")
    with pytest.raises(ValueError, match="no fold"):
        baseline.run_baseline(rows.where("event_id < 50"), ["us", "event_id"], "event_id", ["x"], "y", 700, 200, 5)


def test_a_stored_cell_is_what_was_stored(spark, tmp_path):
    from tickframe.operators import models

    rng = np.random.default_rng(3)
    weights = {"input": rng.normal(size=(4, 2)), "hidden": rng.normal(size=(4, 4)), "bias": rng.normal(size=4), "out": rng.normal(size=4), "offset": np.array([0.5])}
    models.store_cell(spark, weights, f"{tmp_path}/cell")
    states = rng.normal(size=(30, 3, 2))
    h = np.zeros((30, 4))
    for k in range(3):
        h = np.tanh(states[:, k] @ weights["input"].T + h @ weights["hidden"].T + weights["bias"])
    want = h @ weights["out"] + 0.5
    rows = spark.createDataFrame([(i, [{"a": float(x), "b": float(y)} for x, y in s]) for i, s in enumerate(states)], "id long, window array<struct<a:double,b:double>>")
    got = {r.id: r.prediction for r in models.score_windows(rows, "id", models.load_cell(spark, f"{tmp_path}/cell"), 3, 2).collect()}
    assert [got[i] for i in range(30)] == pytest.approx(want.tolist())
    with pytest.raises(ValueError, match="a cell has"):
        models.store_cell(spark, {"input": np.eye(2)}, f"{tmp_path}/none")


def test_components_that_do_not_add_up(spark):
    from tickframe.operators.evaluation import edge_and_costs

    rows = spark.createDataFrame([("a", 2, 3.0, 1.0, 0.5, 1.5), ("a", 6, 2.0, 1.0, 0.5, 0.5), ("a", 0, None, None, None, None)], "k string, selected long, gross_bps double, entry_half_bps double, exit_half_bps double, net_bps double")
    one = edge_and_costs(rows, ["k"]).first()
    assert (one.blocks, one.defined, one.rows, one.equal_net_bps, one.pooled_net_bps, one.pooled_cost_bps) == (3, 2, 8, 1.0, 0.75, 1.5)
    with pytest.raises(Exception, match="do not add up"):
        edge_and_costs(rows.withColumn("net_bps", F.col("net_bps") + 1), ["k"]).collect()
