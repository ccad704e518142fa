"""Column expressions of quotes; an undefined value is NULL, never NaN."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def safe_ratio(top: Column, bottom: Column) -> Column:
    """top / bottom, 0 where the bottom is 0, NULL where either is NULL."""
    return F.when(bottom == 0, F.lit(0.0)).otherwise(F.try_divide(top, bottom))


def mid(bid: str = "bid_px_1", ask: str = "ask_px_1") -> Column:
    return (F.col(bid) + F.col(ask)) / 2.0


def spread_bps(bid: str = "bid_px_1", ask: str = "ask_px_1") -> Column:
    return F.try_divide(F.col(ask) - F.col(bid), mid(bid, ask)) * 1e4


def imbalance(bid: Column, ask: Column, guarded: bool = True) -> Column:
    """(bid - ask) / (bid + ask); 0 (guarded) or NULL where both are 0."""
    return safe_ratio(bid - ask, bid + ask) if guarded else F.try_divide(bid - ask, bid + ask)


def microprice() -> Column:
    """The mid weighted by the opposite sizes; the plain mid where both sizes are 0."""
    total = F.col("bid_sz_1") + F.col("ask_sz_1")
    return F.when(total > 0, (F.col("ask_px_1") * F.col("bid_sz_1") + F.col("bid_px_1") * F.col("ask_sz_1")) / total).otherwise(mid())


def finite(column: str) -> Column:
    return F.col(column).isNotNull() & ~F.isnan(column) & (F.abs(column) < float("inf"))


def side_name(column: str) -> Column:
    """bid or ask; any other spelling than bid, bids, buy, ask, asks, sell is an error."""
    plain = F.lower(F.col(column))
    return F.when(plain.isin("bid", "bids", "buy"), "bid").when(plain.isin("ask", "asks", "sell"), "ask").otherwise(F.raise_error(F.concat(F.lit("unknown side "), F.coalesce(F.col(column), F.lit("null")))))


def units(column: Column, quantum: str) -> Column:
    """A decimal price or size in whole ticks or lots, halves away from zero."""
    return F.round(column.cast("decimal(38,18)") / F.lit(quantum).cast("decimal(38,18)")).cast("long")
