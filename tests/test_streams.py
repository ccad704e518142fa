"""Streams over several micro-batches: late rows, timers, and state that ends."""

from pyspark.sql import functions as F


def _run(stream, folder):
    query = stream.writeStream.format("parquet").option("path", f"{folder}/rows").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    kept = [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{folder}/rows").collect(), kept


def test_a_late_trade_is_named_and_not_counted(spark, tmp_path):
    from tickframe.streaming.metrics import stream_in_files
    from tickframe.streaming.stateful import RecentTrades, keyed

    rows = spark.createDataFrame([("A", 90, 1, False, "buy", 4.0, 0), ("A", 100, 2, False, "buy", 1.0, 0), ("A", 95, 3, False, "buy", 2.0, 1), ("A", 106, 4, True, "buy", 0.0, 1), ("A", 103, 5, True, "buy", 0.0, 2)], "symbol string, us long, event_id long, is_decision boolean, side string, size double, part int")
    out, _ = _run(keyed(stream_in_files(rows, "part", 3), ["symbol"], RecentTrades(10)), tmp_path)
    found = {r.event_id: (r.buy_size, r.n_trades, r.problem) for r in out}
    assert found == {3: (None, None, "late"), 4: (1.0, 1, None), 5: (None, None, "late")}


def test_state_of_a_day_ends_by_its_timer(spark, tmp_path):
    from tickframe.streaming.metrics import stream_in_files
    from tickframe.streaming.stateful import OrderVersions, keyed

    second = 1_000_000
    rows = [("A", "d1", 0, 0, 0, 0, "F", -1, -1, -1, -1, 0), ("A", "d1", 1, second, 0, 1, "A", 1, 100, 5, -1, 0), ("A", "d1", 2, 2 * second, 0, 1, "Y", 1, 100, 2, -1, 1), ("A", "d1", 1, second, 0, 2, "A", 1, 99, 1, -1, 1)]
    rows += [("~", "d9", 0, 99 * second, 0, 0, "F", -1, -1, -1, -1, 2), ("~", "d9", 1, 999 * second, 0, 0, "F", -1, -1, -1, -1, 3)]
    frame = spark.createDataFrame(rows, "symbol string, day string, event_index long, us long, order_date long, order_id long, action string, side long, price long, volume long, priority long, part int")
    stream = stream_in_files(frame.withColumn("at", F.timestamp_micros("us")), "part", 4).withWatermark("at", "10 seconds")
    out, kept = _run(keyed(stream, ["symbol", "day"], OrderVersions(5 * second), event_time=True), tmp_path)
    own = {(r.event_index, r.problem): r for r in out if r.symbol == "A"}
    assert own[1, None].new_volume == 5 and own[2, None].execution == 0 and own[2, None].old_volume == 5 and own[2, None].live_orders == 1
    assert own[1, "late"].live_orders is None
    # only the last stock's `last` row and its timer are left
    assert max(kept) > kept[-1] and kept[-1] <= 3


def test_clock_markouts_wait_for_rows_out_of_order(spark, tmp_path):
    from tickframe.streaming.metrics import stream_in_files
    from tickframe.streaming.stateful import ClockMarkouts, keyed

    minute = 60_000_000
    rows = [("A", 0, 1, 100.0, 0), ("A", 3, 2, 103.0, 0), ("A", 1, 3, 101.0, 1), ("A", 30, 4, 90.0, 1), ("~", 600, 9, 1.0, 2)]
    frame = spark.createDataFrame([(s, (60 + at) * minute, *more) for s, at, *more in rows], "symbol string, us long, event_id long, mid double, part int").withColumn("at", F.timestamp_micros("us"))
    out, kept = _run(keyed(stream_in_files(frame, "part", 3).withWatermark("at", "5 minutes"), ["symbol"], ClockMarkouts(minute, 10 * minute), event_time=True), tmp_path)
    found = {r.event_id: (r.future_us, None if r.markout_bps is None else round(r.markout_bps, 6), r.direction) for r in out if r.symbol == "A"}
    assert found == {1: (61 * minute, 100.0, 1), 3: (63 * minute, round((103 / 101 - 1) * 1e4, 6), 1), 2: (None, None, None), 4: (None, None, None)}
    assert len(out) == 4 and kept[-1] < max(kept)


def test_trades_of_a_crowded_hour_are_summed_without_pairs(spark, tmp_path):
    import random

    from tickframe.streaming.metrics import recent_trades, stream_in_files

    dice, hour = random.Random(3), 3_600_000_000
    times = [dice.randrange(3 * hour) // 1000 * 1000 for _ in range(3000)] + [0, hour, 2 * hour, 3 * hour]
    trades = [("A", t, dice.choice(["buy", "sell"]), float(dice.randrange(100))) for t in times] + [("A", hour, "buy", None)]
    decisions = [("A", dice.choice(times) + dice.choice([0, hour]), i) for i in range(1000)]
    streams = []
    for rows, schema, far in ((decisions, "symbol string, us long, event_id long", ("~", 99 * hour, -1)), (trades, "symbol string, us long, side string, size double", ("~", 99 * hour, "buy", 0.0))):
        frame = spark.createDataFrame([*rows, far], schema).withColumns({"part": F.expr(f"IF(us > {9 * hour}, 2, pmod(hash(us), 2))"), "at": F.timestamp_micros("us")})
        streams.append(stream_in_files(frame, "part", 3))
    summed = recent_trades(*streams, hour, "4 hours")
    assert "Join" not in summed._jdf.queryExecution().analyzed().toString()
    out, _ = _run(summed.select(F.unix_micros("at").alias("us"), "event_id", "buy_size", "sell_size", "n_trades"), tmp_path)
    found = {r.event_id: tuple(r) for r in out}
    assert len(out) == len(found) == 1000
    for _, us, i in decisions:
        near = [t for t in trades if us - hour < t[1] <= us]
        assert found[i] == (us, i, *[sum(t[3] or 0.0 for t in near if t[2] == side) for side in ("buy", "sell")], len(near))


def test_clock_markouts_keep_quotes_by_block(spark, tmp_path):
    from tickframe.streaming.metrics import stream_in_files
    from tickframe.streaming.stateful import ClockMarkouts, keyed

    minute, n = 60_000_000, 30_000
    quotes = spark.range(n).selectExpr("'A' AS symbol", "(1 + id * 7919 % 30000) * 100000 AS us", "id AS event_id", "100 + id % 7 / 10D AS mid", "CAST(id * 7919 % 30000 DIV 15000 AS INT) AS part")
    frame = quotes.union(spark.createDataFrame([("~", 10**12, -1, 1.0, 2)], quotes.schema)).withColumn("at", F.timestamp_micros("us"))
    out, kept = _run(keyed(stream_in_files(frame, "part", 3).withWatermark("at", "1 second"), ["symbol"], ClockMarkouts(minute, minute), event_time=True), tmp_path)
    assert max(kept) < 30
    by_us = {r.us: r for r in out}
    assert len(out) == len(by_us) == n
    mids = {r.us: r.mid for r in quotes.collect()}
    for us, r in by_us.items():
        assert r.future_us == (us + minute if us + minute in mids else None)
        assert r.markout_bps == ((mids[us + minute] / mids[us] - 1) * 1e4 if r.future_us else None)


def test_micro_batches_are_bounded_and_in_order(spark, tmp_path, monkeypatch):
    from tickframe.streaming import metrics
    from tickframe.streaming.stateful import Markouts, keyed

    monkeypatch.setattr(metrics, "BATCH", 100)
    rows = spark.range(1000).selectExpr("'A' AS symbol", "id * 389 % 1000 * 10 AS us", "id AS event_id", "1.0D + id AS mid")
    query = keyed(metrics.in_batches(rows, "us"), ["symbol"], Markouts(5)).writeStream.format("parquet").option("path", f"{tmp_path}/rows").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    sizes = [p["numInputRows"] for p in query.recentProgress]
    assert sum(sizes) == 1000 and max(sizes) <= 120
    out = spark.read.parquet(f"{tmp_path}/rows").collect()
    mids = [r.mid for r in sorted(rows.collect(), key=lambda r: r.us)]
    assert all(r.problem is None for r in out)
    assert sorted(round(r.markout_bps, 6) for r in out) == sorted(round((b / a - 1) * 1e4, 6) for a, b in zip(mids, mids[5:]))


def test_a_book_of_many_levels_keeps_its_best_prices_over_batches(spark, tmp_path, monkeypatch):
    import random

    from tickframe.streaming import metrics
    from tickframe.streaming.stateful import Books, keyed

    monkeypatch.setattr(metrics, "BATCH", 400)
    dice, book, want = random.Random(5), {}, {}
    rows = [("P", 0, 1, "snapshot", "bid", 1.0, 1.0), ("P", 0, 2, "snapshot", "ask", 1001.0, 2.0)]
    book = {("bid", 1.0): 1.0, ("ask", 1001.0): 2.0}
    for i in range(1, 1000):
        side = dice.choice(["bid", "ask"])
        price, size = dice.randrange(1, 1000) / 2 + (501 if side == "ask" else 0), float(dice.randrange(3))
        rows.append(("P", i, 1, "l2update", side, price, size))
        book[side, price] = size
        best = [f((p for (s, p), x in book.items() if s == own and x), default=None) for own, f in (("bid", max), ("ask", min))]
        want[i] = (best[0], book.get(("bid", best[0])), best[1], book.get(("ask", best[1])))
    frame = spark.createDataFrame(rows, "product_id string, receive_index long, change_index int, type string, side string, price double, size double")
    out, _ = _run(keyed(metrics.in_batches(frame, "receive_index"), ["product_id"], Books()), tmp_path)
    found = {r.receive_index: tuple(r)[2:6] for r in out if r.receive_index}
    assert all(r.problem is None for r in out) and found == want


def test_rows_of_a_stream_are_computed_once(spark):
    from tickframe.streaming.metrics import stream_in_files

    seen = spark.sparkContext.accumulator(0)

    def mark(i: int) -> int:
        seen.add(1)
        return i

    rows = spark.range(100).select(F.udf(mark, "long")("id").alias("v"), (F.col("id") % 4).cast("int").alias("part"))
    stream_in_files(rows, "part", 4)
    assert seen.value == 100


def test_tiles_by_ranges_are_those_of_ntile(spark):
    from pyspark.sql import Window
    from tickframe.operators.resampling import tiled

    for n in (3, 4, 1003):
        rows = spark.range(n).select((F.col("id") * 389 % 1009).alias("event_id"))
        want = rows.withColumn("part", F.ntile(4).over(Window.orderBy("event_id")) - 1)
        assert sorted(tiled(rows, ["event_id"], 4, "part").collect()) == sorted(want.collect())
