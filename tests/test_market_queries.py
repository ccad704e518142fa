"""Every market query against its DuckDB SQL on the smallest tables."""

import duckdb
import pandas as pd
import pytest

from tickframe.plans import evaluation_queries, feed_queries, log_queries, stream_queries, table_queries  # noqa: F401
from tickframe.plans.queries import QUERIES, SQL

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in ("events", "lineitem"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_equals_oracle(spark, duck, name):
    got = QUERIES[name](spark, SF).toPandas()
    if name not in SQL:
        assert len(got)
        return
    want = duck.execute(SQL[name]).fetchdf()
    assert sorted(got.columns) == sorted(want.columns)
    order = sorted(want.columns)
    clean = lambda x: x[order].astype(object).where(x[order].notna(), None).sort_values(order, key=lambda c: c.astype(str)).reset_index(drop=True)
    got, want = clean(got), clean(want)
    assert len(got) == len(want)
    for c in order:
        bad = [(a, b) for a, b in zip(got[c], want[c], strict=True) if a != b and not (isinstance(a, float) and b is not None and abs(a - b) < 2e-6)]
        assert not bad, (c, bad[:3])


def test_recent_window_is_half_open(spark):
    from tickframe.operators.features import recent_trades

    decisions = spark.createDataFrame([("A", 10, 1)], "symbol string, us long, event_id long")
    trades = spark.createDataFrame([("A", 5, "buy", 1.0), ("A", 6, "buy", 2.0), ("A", 10, "sell", 4.0), ("B", 9, "buy", 8.0)], "symbol string, us long, side string, size double")
    row = recent_trades(decisions, trades, 5).first()
    assert (row["buy_size"], row["sell_size"], row["n_trades"]) == (2.0, 4.0, 2)


def test_sweep_averages_levels(spark):
    from tickframe.operators.labels import sweep_depth

    books = spark.sql("SELECT array(struct(102D AS px, 2D AS sz), struct(101D AS px, 1.5D AS sz)) AS asks, 100D AS best_bid, 101D AS best_ask")
    row = sweep_depth(books, 2.0).first()
    assert row["average_px"] == pytest.approx(101.25)
    assert sweep_depth(books, 9.0).first()["average_px"] is None


def test_crossed_book_and_gap_are_errors(spark):
    from tickframe.operators.book import replay_levels

    rows = [("A", "d", 1, 0, "bid", 100, 2), ("A", "d", 2, 0, "ask", 101, 1)]
    schema = "symbol string, day string, seq long, us long, side string, px long, sz long"
    last = replay_levels(spark.createDataFrame(rows, schema)).orderBy("seq").collect()[-1]
    assert (last["best_bid"], last["best_ask"]) == (100, 101)
    for bad in (("A", "d", 4, 0, "ask", 101, 1), ("A", "d", 3, 0, "ask", 99, 1)):
        with pytest.raises(Exception, match="sequence|crossed"):
            replay_levels(spark.createDataFrame([*rows, bad], schema)).collect()


def test_permutation_keeps_labels(spark):
    from tickframe.operators.folds import permute_labels

    rows = spark.range(40).selectExpr("id % 2 AS g", "id", "id * 3 AS y")
    out = permute_labels(rows, ["g"], ["id"], "y").toPandas()
    for _, part in out.groupby("g"):
        assert sorted(part.y) == sorted(part.shuffled)
    assert (out.y != out.shuffled).any()


def test_future_rows_do_not_change_features(spark):
    from tickframe.operators.features import order_flow_imbalance, quote_features
    from tickframe.views import view

    quotes = view(spark, SF, "quotes").where("symbol = 'S1'")
    early = quotes.where("event_index <= 3")
    pick = lambda df: df.where("event_index <= 3").select("event_id", "ofi_l1", "microprice").toPandas().sort_values("event_id").reset_index(drop=True)
    pd.testing.assert_frame_equal(pick(order_flow_imbalance(quote_features(quotes))), pick(order_flow_imbalance(quote_features(early))))


def test_feed_lines(spark, tmp_path):
    from tickframe.sources import feed

    (tmp_path / "a.jsonl").write_text('{"type": "snapshot", "product_id": "P", "time": "t0", "bids": [["1", "2"]], "asks": [["3", "4"]]}\n\n{"type": "heartbeat"}\n')
    (tmp_path / "b.jsonl").write_text('{"local_ts": "here", "message": {"type": "match", "product_id": "P", "time": "t1", "price": "2", "size": "5", "side": "sell"}}\n')
    messages = feed.parse(feed.read_lines(spark, str(tmp_path)))
    assert [(r.receive_index, r.local_ts, r.side, r.price) for r in feed.level_rows(messages).orderBy("change_index").collect()] == [(1, "t0", "bid", 1.0), (1, "t0", "ask", 3.0)]
    assert [(r.receive_index, r.local_ts, r.aggressor, r.trade_sign) for r in feed.trade_rows(messages).collect()] == [(3, "here", "buy", 1)]
