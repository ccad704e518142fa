"""What operators refuse, on small tables made here."""

import pytest
from pyspark.sql import functions as F


def test_gate_names_what_does_not_match(spark):
    from tickframe.operators.cohorts import manifest
    from tickframe.sources.tables import gated

    rows = spark.createDataFrame([("a", "d", 1), ("b", "d", 2)], "symbol string, day string, v long")
    keys, content = ["symbol", "day"], ["v"]
    declared = manifest(rows, keys, content)
    assert gated(rows, declared, keys, content).count() == 2
    with pytest.raises(ValueError, match="b/d missing"):
        gated(rows.where("symbol = 'a'"), declared, keys, content)
    with pytest.raises(ValueError, match="a/d changed"):
        gated(rows.withColumn("v", F.when(F.col("symbol") == "a", 9).otherwise(F.col("v"))), declared, keys, content)
    with pytest.raises(ValueError, match="no partition"):
        gated(rows.where("false"), declared.where("false"), keys, content)


def test_declared_cardinality(spark):
    from tickframe.operators.joins import declared_join

    left = spark.createDataFrame([(1, "x"), (1, "y")], "k long, a string")
    right = spark.createDataFrame([(1, 5)], "k long, b long")
    assert declared_join(left, right, ["k"], "many_to_one").count() == 2
    with pytest.raises(Exception, match="k is not unique"):
        declared_join(left, right, ["k"], "one_to_one").collect()
    with pytest.raises(Exception, match="k is not unique"):
        declared_join(right, left, ["k"], "many_to_one").collect()


def test_strict_forms_raise(spark):
    from tickframe.functions.columns import side_name, units
    from tickframe.operators.features import level_depths
    from tickframe.operators.folds import fixed_cutoff, period_parts, walk_forward
    from tickframe.operators.labels import crossed_from_features, sweep_depth
    from tickframe.operators.resampling import moving_block_bootstrap

    books = spark.sql("SELECT array(struct(102D AS px, 2D AS sz)) AS asks, array(struct(100D AS px, 1D AS sz), struct(99D AS px, 4D AS sz)) AS bids, 100D AS best_bid, 102D AS best_ask")
    sold = sweep_depth(books, 2.0, 1.0, "sell").first()
    assert sold["average_px"] == 99.5 and sold["total_bps"] == pytest.approx(1.5 / 101 * 1e4 + 1) and sold["depth_bps"] == pytest.approx(0.5 / 101 * 1e4)
    with pytest.raises(Exception, match="insufficient"):
        sweep_depth(books, 3.0, strict=True).collect()
    with pytest.raises(Exception, match="no level"):
        level_depths(spark.sql("SELECT array() AS bids, array(struct(1D AS px, 1D AS sz)) AS asks").select(F.col("bids").cast("array<struct<px:double,sz:double>>").alias("bids"), "asks"), 2).collect()
    with pytest.raises(Exception, match="unknown side"):
        spark.sql("SELECT 'left' AS side").select(side_name("side")).collect()
    assert spark.sql("SELECT 0.015 AS x").select(units(F.col("x"), "0.01").alias("u")).first()["u"] == 2
    with pytest.raises(Exception, match="direction"):
        spark.range(1).select(crossed_from_features(F.lit(1.0), F.lit(1.0), F.lit(1.0), F.lit(0))).collect()
    rows = spark.createDataFrame([("s", "d1", "P")], "symbol string, day string, period string")
    with pytest.raises(ValueError, match="no rows"):
        fixed_cutoff(rows, rows.union(spark.sql("SELECT 's', 'd2', 'P'")), ["symbol", "day"], "d2")
    with pytest.raises(ValueError, match="two parts"):
        period_parts(rows, ["P"], ["P"], [])
    with pytest.raises(ValueError, match="positive"):
        walk_forward(rows, ["day"], 0, 1, 1)
    with pytest.raises(Exception, match="shorter than a block"):
        moving_block_bootstrap(spark.sql("SELECT 'P' AS period, 'd' AS day, 1D AS delta"), "period", "day", 2, 3, 1).collect()


def test_walk_forward_takes_the_first_rows_after_the_embargo(spark):
    from tickframe.operators.folds import walk_forward

    rows = spark.createDataFrame([(i * 10, i) for i in range(20)], "us long, event_id long")
    out = walk_forward(rows, ["us", "event_id"], 5, 4, 9, 25).toPandas()
    tests = {f: sorted(x.event_id) for f, x in out[out.part == "test"].groupby("fold")}
    # Fold 0 trains on 0 to 4 (until 40); 5 and 6 lie in the embargo.
    assert tests == {0: [7, 8, 9, 10], 1: [11, 12, 13, 14], 2: [15, 16, 17, 18]}
    assert sorted(out[(out.part == "train") & (out.fold == 2)].event_id) == list(range(13))


def test_feed_rules(spark):
    from tickframe.operators.orderlog import feed_books

    schema = "product_id string, receive_index long, change_index int, type string, side string, price double, size double"
    snap = [("P", 1, 1, "snapshot", "bid", 1.0, 2.0), ("P", 1, 2, "snapshot", "ask", 3.0, 1.0)]
    # The last change of a level in a message holds; the update removes the bid.
    update = [("P", 2, 1, "l2update", "bid", 1.0, 5.0), ("P", 2, 2, "l2update", "bid", 1.0, 0.0)]
    last = feed_books(spark.createDataFrame(snap + update, schema)).orderBy("receive_index").collect()[-1]
    assert last["best_bid"] is None and last["best_ask"] == 3.0 and last["bid_levels"] == 0
    for bad, match in ((update, "before snapshot"), ([*snap, ("P", 2, 1, "l2update", "bid", 4.0, 1.0)], "crossed"), ([*snap, ("P", 1, 3, "l2update", "bid", 1.0, 1.0)], "mixed")):
        with pytest.raises(Exception, match=match):
            feed_books(spark.createDataFrame(bad, schema)).collect()


def test_order_log_by_hand(spark):
    from tickframe.operators import orderlog

    schema = "symbol string, day string, event_index long, us long, order_id long, action string, side int, price long, volume long, priority long"
    steps = [("F", 0, -1, -1, -1), ("A", 1, 1, 100, 5), ("A", 2, 2, 102, 3), ("A", 3, 1, 100, 4), ("M", 1, -1, -1, 2), ("Y", 4, 5, 103, 1), ("D", 3, -1, -1, -1), ("M", 1, -1, 99, -1), ("A", 1, 1, 98, 1), ("D", 9, -1, -1, -1)]
    rows = spark.createDataFrame([("S", "d", i, 10 * i, o, a, side, price, volume, -1) for i, (a, o, side, price, volume) in enumerate(steps)], schema)
    tops = {r["event_index"]: r for r in orderlog.books(rows.where("event_index < 8"), 2).collect()}
    best = lambda i, side: [(x["px"], x["sz"], x["orders"]) for x in tops[i][side]]
    assert best(0, "bids") == [] and best(3, "bids") == [(100, 9, 2)] and best(4, "bids") == [(100, 6, 2)]
    assert best(5, "asks") == [(102, 3, 1), (103, 1, 1)] and best(6, "bids") == [(100, 2, 1)] and best(7, "bids") == [(99, 2, 1)]
    queue = {r["event_index"]: (r["new_priority"], r["new_entered"]) for r in orderlog.queue_orders(rows.where("event_index < 8")).collect()}
    assert queue[4] == (10, 1) and queue[7] == (70, 7)
    assert {r["event_index"]: (r["new_priority"], r["new_entered"]) for r in orderlog.queue_orders(rows.where("event_index < 8"), reset=True).collect()}[4] == (40, 4)
    assert {(r["event_index"], r["problem"]) for r in orderlog.order_problems(rows).collect()} == {(8, "duplicate add"), (9, "unknown order")}


def test_state_survives_micro_batches(spark, tmp_path):
    from tickframe.streaming import stateful
    from tickframe.streaming.metrics import run_to_table

    schema = "symbol string, us long, event_id long, mid double"
    for i in range(3):
        spark.createDataFrame([("A", 10 * i + k, 10 * i + k, 100.0 + 10 * i + k) for k in range(3)], schema).coalesce(1).write.parquet(f"{tmp_path}/in", mode="append")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    out = run_to_table(stateful.keyed(stream, ["symbol"], stateful.Markouts(2))).toPandas()
    assert len(out) == 7 and out.event_id.is_unique
