"""The streamed replay of order logs and the races on its rows, on small logs made here."""

import random

import pytest

LOG = "symbol string, day string, event_index long, us long, order_date long, order_id long, action string, side long, price long, volume long, priority long"


def log_of(spark, rows):
    """rows of (action, order id, side, price, volume[, priority[, order date]])."""
    full = [("A", "2024-01-02", i, 1000 + i, (r[6] if len(r) > 6 else 0), r[1], r[0], r[2], r[3], r[4], (r[5] if len(r) > 5 else -1)) for i, r in enumerate(rows)]
    return spark.createDataFrame(full, LOG)


def by_index(rows):
    return {r.event_index: r for r in rows.collect()}


def test_a_repeated_order_executes_nothing_but_changes_and_deletions_do(spark):
    from tickframe.operators.orderlog import event_rows

    rows = by_index(event_rows(log_of(spark, [("F", 0, -1, -1, -1), ("A", 1, 1, 100, 5), ("Y", 1, 1, 100, 2), ("M", 1, -1, -1, 1), ("M", 1, 1, 99, 1), ("D", 1, -1, -1, -1), ("Y", 2, 2, 105, 4)]), 1))
    assert [rows[i].execution for i in range(7)] == [0, 0, 0, 1, 0, 1, 0]
    assert (rows[2].old_volume, rows[2].new_volume, rows[2].bid_size) == (5, 2, 2)
    assert [rows[i].live_orders for i in range(7)] == [0, 1, 1, 1, 1, 0, 1]
    assert (rows[5].new_price, rows[5].bid_px) == (None, None)


def test_orders_are_named_by_date_and_id(spark):
    from tickframe.operators.orderlog import event_rows

    rows = by_index(event_rows(log_of(spark, [("F", 0, -1, -1, -1), ("A", 1, 1, 100, 5, -1, 1), ("A", 1, 1, 100, 3, -1, 2), ("D", 1, -1, -1, -1, -1, 1)]), 1))
    assert (rows[2].bid_size, rows[2].bid_orders, rows[2].live_orders, rows[3].execution, rows[3].bid_size) == (8, 2, 2, 5, 3)


def test_places_in_the_queue_under_both_rules(spark):
    from tickframe.operators.orderlog import event_rows

    rows = by_index(event_rows(log_of(spark, [("F", 0, -1, -1, -1), ("A", 1, 1, 100, 5, 7), ("M", 1, -1, -1, 4), ("M", 1, -1, -1, 3, 9), ("Y", 1, 1, 100, 2, 9), ("M", 1, -1, 101, -1)]), 1))
    assert [(rows[i].new_entered, rows[i].new_entered_reset, rows[i].new_priority, rows[i].new_priority_reset) for i in range(1, 6)] == [(1, 1, 7, 7), (1, 2, 7, 1002), (3, 3, 9, 9), (3, 3, 9, 9), (5, 5, 1005, 1005)]


@pytest.mark.parametrize("levels", [1, 3, 10])
def test_books_equal_a_plain_replay(spark, levels):
    from tickframe.operators.replay import replay_orders

    rng, rows, live, want, tick = random.Random(levels), [("F", 0, -1, -1, -1)], {}, [([], [], 0, None)], None
    for _ in range(700):
        action, key, side = rng.choice("AAYMMDF" if rng.random() < 0.05 else "AAYMMD"), rng.randrange(60), rng.choice([1, 2, 5])
        action = "A" if action in "MD" and key not in live else "M" if action == "A" and key in live else action
        price, volume = (-1 if action in "MD" and rng.random() < 0.5 else rng.choice([0, *range(80, 120)])), (-1 if action in "MD" and rng.random() < 0.5 else rng.randrange(4))
        side = live[key][0] if action in "MD" else 2 if side == 5 else side
        price = price if price <= 0 else min(price, 99) if side == 1 else max(price, 100)
        rows.append((action, key, side, price, volume))
        if action == "F":
            live = {}
        elif action == "D":
            del live[key]
        else:
            old = live.get(key, (side, None, None))
            live[key] = (side, old[1] if price == -1 else price, old[2] if volume == -1 else volume)
        tops = []
        for s in (1, 2):
            found = {}
            for x, p, v in live.values():
                if x == s and p > 0:
                    found.setdefault(p, [0, 0])
                    found[p][0] += v
                    found[p][1] += 1
            tops.append([(p, *found[p]) for p in sorted(found, reverse=s == 1) if found[p][0]][:levels])
        unpriced = sum(p <= 0 for _, p, _ in live.values())
        if not unpriced and len(tops[0]) == len(tops[1]) == levels:
            for t in tops:
                for a, b in zip(t, t[1:]):
                    tick = abs(a[0] - b[0]) if tick is None else min(tick, abs(a[0] - b[0]))
        want.append((tops[0], tops[1], unpriced, tick))
    got = by_index(replay_orders(log_of(spark, rows), levels))
    assert [([tuple(x) for x in got[i].bids], [tuple(x) for x in got[i].asks], got[i].unpriced, got[i].tick) for i in range(len(rows))] == want


def events(spark, changes, n=60, moves=(), breaks=()):
    """n valid messages at 100 / 102; changes: index -> (old volume, new volume, entered, execution, price); moves: index -> mid shift."""
    rows, shift, segment = [], 0, 1
    for i in range(n):
        shift += dict(moves).get(i, 0)
        segment += i in breaks
        old, new, entered, execution, price = changes.get(i, (None, None, None, 0, 100))
        there = i in changes
        side = 1 if there else None
        rows.append(("A", "d", i, segment, 0, 1, 100 + shift, 2, 1, 102 + shift, 2, 1, True, side if new else None, price if new else None, new, entered, entered, side if old else None, price if old else None, old, entered, entered, execution))
    names = ["bid_px long", "bid_size long", "bid_orders long", "ask_px long", "ask_size long", "ask_orders long", "valid boolean", *[f"{v}_{c} long" for v in ("new", "old") for c in ("side", "price", "volume", "entered", "entered_reset")], "execution long"]
    return spark.createDataFrame(rows, "symbol string, day string, event_index long, segment long, barriers long, tick long, " + ", ".join(names))


def race(spark, frame, at=0, **more):
    from tickframe.operators.races import Race, races

    signals = spark.createDataFrame([("A", "d", at, 1.0)], "symbol string, day string, event_index long, prediction double")
    return races(frame, signals, Race(**({"horizon": 10} | more))).first()


def test_what_is_ahead_goes_first(spark):
    parts = {1: (2, 1, 0, 1, 100), 2: (1, None, 0, 1, 100)}
    assert race(spark, events(spark, parts)).fill_time is None
    filled = race(spark, events(spark, parts | {3: (2, 1, 1, 1, 100)}))
    assert (filled.fill_time, filled.queue_ahead, filled.fill_first) == (3, 2, True)
    assert race(spark, events(spark, {1: (None, 100, 1, 0, 100), 2: (100, None, 1, 100, 100)})).fill_time is None
    assert race(spark, events(spark, {1: (2, None, 0, 0, 100), 2: (5, 4, 1, 1, 99)})).fill_time is None


def test_a_race_ends_with_horizon_and_segment(spark):
    late = {1: (2, None, 0, 0, 100), 11: (5, 4, 1, 1, 100)}
    assert race(spark, events(spark, late)).fill_time is None
    assert race(spark, events(spark, late), horizon=20).fill_time == 11
    assert race(spark, events(spark, late, breaks=(5,)), horizon=20).fill_time is None


def test_moves_and_fills_at_once_and_delays(spark):
    both = race(spark, events(spark, {1: (2, None, 0, 0, 100), 2: (5, 4, 1, 1, 100)}, moves=((2, -1),)))
    assert both.simultaneous and not both.fill_first and not both.adverse_first and both.markout_1 == 0
    assert race(spark, events(spark, {}, moves=((3, -1),))).adverse_time == 3
    later = race(spark, events(spark, {6: (2, None, 0, 0, 100), 11: (5, 4, 6, 1, 100)}), latencies=(5,))
    assert (later.placement, later.fill_time, later.markout_remaining) == (5, 6, None)
    assert race(spark, events(spark, {}), at=58, latencies=(5,)).excluded == "no message"
    assert race(spark, events(spark, {}, breaks=(5,)), at=3, latencies=(4,)).excluded == "other segment"


def test_blocks_and_batches_change_nothing(spark):
    from tickframe.operators import orderlog, races
    from tickframe.views import view

    rows = orderlog.event_rows(view(spark, "/root/testdata/sf0.01", "log").where("symbol IN ('S0', 'S1')"), 2).selectExpr("*", "event_index % 3 - 1 AS prediction")
    run = lambda block: sorted(map(str, races.races_of(rows, races.Race(20, (0, 5), (False, True), (1, 5), block=block)).collect()))
    whole = run(8192)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "17")
    try:
        assert run(5) == whole
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert any("fill_first=True" in x for x in whole)
    with pytest.raises(ValueError, match="positive"):
        races.Race(0)


def test_feed_messages_that_break_the_rules(spark):
    from tickframe.operators.orderlog import feed_books

    schema = "product_id string, receive_index long, change_index long, type string, side string, price double, size double"
    start = [("P", 1, 0, "snapshot", "bid", 10.0, 1.0), ("P", 1, 1, "snapshot", "ask", 11.0, 2.0)]
    last = feed_books(spark.createDataFrame([*start, ("P", 2, 0, "l2update", "bid", 10.5, 3.0), ("P", 2, 1, "l2update", "bid", 10.5, 0.0)], schema)).orderBy("receive_index").collect()[-1]
    assert (last.best_bid, last.bid_size, last.best_ask, last.bid_levels) == (10.0, 1.0, 11.0, 1)
    for bad, problem in ((("P", 2, 0, "l2update", "bid", 11.0, 1.0), "crossed"), (("P", 2, 0, "l2update", "bid", 9.0, -1.0), "negative"), (("P", 1, 2, "l2update", "bid", 9.0, 1.0), "mixed"), (("P", 0, 0, "l2update", "bid", 9.0, 1.0), "before snapshot")):
        with pytest.raises(Exception, match=problem):
            feed_books(spark.createDataFrame([*start, bad], schema)).collect()
