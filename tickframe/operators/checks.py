"""Data-quality rules; each returns its violations, so an empty result is a pass."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickframe.operators.resampling import hashed, numbered

from tickframe.operators.features import in_segment


def require_columns(df: DataFrame, columns: Sequence[str]) -> None:
    if missing := [c for c in columns if c not in df.columns]:
        raise ValueError(f"missing columns: {', '.join(missing)}")


def duplicates(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("times")).where("times > 1")


def gaps(df: DataFrame, keys: Sequence[str] = ("symbol", "day")) -> DataFrame:
    """Rows whose index is not the former one plus one."""
    return df.withColumn("former", F.lag("event_index").over(in_segment(*keys))).where(F.col("event_index") != F.col("former") + 1)


def not_monotonic(df: DataFrame, time: str, keys: Sequence[str] = ("symbol", "day")) -> DataFrame:
    return df.withColumn("former", F.lag(time).over(in_segment(*keys))).where(F.col(time) < F.col("former"))


def bad_quotes(df: DataFrame) -> DataFrame:
    """Missing, not positive, or crossed best quotes."""
    bid, ask = F.col("bid_px_1"), F.col("ask_px_1")
    return df.where(bid.isNull() | ask.isNull() | F.isnan(bid) | F.isnan(ask) | (bid <= 0) | (bid >= ask))


def grid_difference(grid: DataFrame, seen: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that are missing from `seen` or not expected by `grid`."""
    missing = grid.select(*keys).distinct().join(seen, list(keys), "left_anti").withColumn("problem", F.lit("missing"))
    extra = seen.select(*keys).distinct().join(grid, list(keys), "left_anti").withColumn("problem", F.lit("unexpected"))
    return missing.union(extra)


def content(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows and an order-free hash of each partition, for manifests and comparisons."""
    return df.groupBy(*keys).agg(F.count("*").alias("rows"), F.bit_xor(F.xxhash64(*sorted(df.columns))).alias("content_hash"))


def ordered_digest(rows: DataFrame, order: Sequence[Column | str], content: Sequence[str]) -> DataFrame:
    """(rows, digest) of a row set in an order: each row's hash takes its place in, so equal rows in other orders differ.

    Places come from a sort by ranges, and the hashes are added up as exact numbers, in any order.
    """
    keyed = rows.select(*[F.col(o).alias(f"_o{i}") if isinstance(o, str) else o.alias(f"_o{i}") for i, o in enumerate(order)], *content)
    placed = numbered(keyed, [f"_o{i}" for i in range(len(order))])
    fields = [F.coalesce(F.col(c).cast("string"), F.lit("\\N")) for c in content]
    return placed.agg(F.count("*").alias("rows"), F.sum(hashed("place", *fields).cast("decimal(20, 0)")).cast("string").alias("digest"))


def funnel(df: DataFrame, keys: Sequence[str], features: Sequence[str], label: str) -> DataFrame:
    """rows, rows without finite features, rows that only lack the label, eligible rows."""
    good = F.lit(True)
    for c in features:
        good = good & F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    return df.withColumn("_g", F.coalesce(good, F.lit(False))).groupBy(*keys).agg(F.count("*").alias("rows"), F.count_if(~F.col("_g")).alias("nonfinite"), F.count_if(F.col("_g") & F.col(label).isNull()).alias("label_only"), F.count_if(F.col("_g") & F.col(label).isNotNull()).alias("eligible"))


def quote_problems(df: DataFrame, required: Sequence[str]) -> DataFrame:
    """All violations of a quotes table, one row each: problem and the row's symbol, day and event_index.

    Times going back, indices that repeat or fall, and quotes that are missing, not positive or crossed.
    """
    require_columns(df, required)
    name = lambda rows, problem: rows.select("symbol", "day", "event_index", F.lit(problem).alias("problem"))
    repeated = df.withColumn("_former", F.lag("event_index").over(in_segment("symbol", "day"))).where(F.col("event_index") <= F.col("_former"))
    return name(not_monotonic(df, "us"), "time goes back").union(name(repeated, "index repeats")).union(name(bad_quotes(df), "bad quote"))


def misplaced(df: DataFrame, zone: str, codes: dict[str, int]) -> DataFrame:
    """Rows whose day is not the local date of their time, or whose code is not their symbol's."""
    local = F.date_format(F.from_utc_timestamp(F.timestamp_micros("us"), zone), "yyyy-MM-dd")
    code = F.element_at(F.create_map(*[F.lit(x) for pair in codes.items() for x in pair]), F.col("symbol"))
    problem = F.when(local != F.col("day"), "day").when(~F.col("code").eqNullSafe(code), "code")
    return df.withColumn("problem", problem).where("problem IS NOT NULL")


def table_difference(old: DataFrame, new: DataFrame, keys: Sequence[str], values: Sequence[str], tolerance: float) -> DataFrame:
    """Per value column the largest difference of two tables over keys that both have, and the rows beyond the tolerance or
    NULL on one side only."""
    pack = lambda df, name: df.select(*keys, F.struct(*values).alias(name))
    both = pack(old, "old").join(pack(new, "new"), list(keys))
    each = both.select(F.explode(F.array(*[F.struct(F.lit(v).alias("column"), F.col("old")[v].cast("double").alias("a"), F.col("new")[v].cast("double").alias("b")) for v in values])).alias("x")).select("x.*")
    gap = F.abs(F.col("a") - F.col("b"))
    return each.groupBy("column").agg(F.count("*").alias("rows"), F.max(gap).alias("max_difference"), F.count_if((gap > tolerance) | (F.col("a").isNull() != F.col("b").isNull())).alias("violations"))


def unequal_rows(one: DataFrame, other: DataFrame) -> DataFrame:
    """Rows that one of two tables has more often than the other, with the side that has them."""
    left = one.exceptAll(other.select(*one.columns)).withColumn("only_in", F.lit("one"))
    return left.unionAll(other.select(*one.columns).exceptAll(one).withColumn("only_in", F.lit("other")))


def chronology(rows: DataFrame, fold: str) -> DataFrame:
    """Folds whose training reaches into the test days, or that train on the held-out symbol."""
    ends = rows.groupBy(fold).agg(F.max(F.when(F.col("part") == "train", F.col("day"))).alias("last_train"), F.min(F.when(F.col("part") == "test", F.col("day"))).alias("first_test"), F.count_if((F.col("part") == "train") & (F.col("symbol") == F.col("held_out"))).alias("held_out_rows"))
    problem = F.when(F.col("last_train") >= F.col("first_test"), "train after test").when(F.col("held_out_rows") > 0, "held-out symbol in training")
    return ends.withColumn("problem", problem).where("problem IS NOT NULL")


def accounting(cells: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Cells whose counts do not add up: valid + invalid = rows, and selected <= common <= rows."""
    problem = F.when(F.col("valid") + F.col("invalid") != F.col("rows"), "valid + invalid <> rows").when((F.col("selected") > F.col("common")) | (F.col("common") > F.col("rows")), "selected or common beyond its whole")
    return cells.withColumn("problem", problem).where("problem IS NOT NULL").select(*keys, "problem")
