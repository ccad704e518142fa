"""Joins with declared cardinality, alignment of prediction sets, and look-ahead over the next messages."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def unique_on(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """`df` as it is; a key that occurs twice is an error when the rows are read."""
    counted = df.groupBy(*keys).agg(F.count("*").alias("_times"), F.first(F.struct(*[c for c in df.columns if c not in keys])).alias("_row"))
    checked = F.when(F.col("_times") > 1, F.raise_error(F.lit(f"{', '.join(keys)} is not unique"))).otherwise(F.col("_row"))
    return counted.select(*keys, checked.alias("_row")).select(*keys, *[F.col("_row")[c].alias(c) for c in df.columns if c not in keys])


def declared_join(left: DataFrame, right: DataFrame, keys: Sequence[str], cardinality: str, how: str = "inner") -> DataFrame:
    """A join that is one_to_one or many_to_one as declared, or an error."""
    if cardinality not in ("one_to_one", "many_to_one"):
        raise ValueError(f"unknown cardinality {cardinality}")
    if cardinality == "one_to_one":
        left = unique_on(left, keys)
    return left.join(unique_on(right, keys), list(keys), how)


def misaligned(one: DataFrame, other: DataFrame, keys: Sequence[str], label: str) -> DataFrame:
    """Rows whose identity is in one prediction set only, or whose labels differ (NULL equals NULL)."""
    side = lambda df, name: df.select(*keys, F.struct(F.col(label).alias("label")).alias(name))
    both = side(one, "one").join(side(other, "other"), list(keys), "full_outer")
    problem = F.when(F.col("other").isNull(), "only in one").when(F.col("one").isNull(), "only in other").when(~F.col("one.label").eqNullSafe(F.col("other.label")), "label")
    return both.select(*keys, problem.alias("problem")).where("problem IS NOT NULL")


def common_blocks(rows: DataFrame, keys: Sequence[str], model: str, other: str) -> DataFrame:
    """Rows of blocks in which the model `other` has rows, too."""
    return rows.join(rows.where(F.col(model) == other).select(*keys).distinct(), list(keys), "left_semi")


def look_ahead(placements: DataFrame, events: DataFrame, keys: Sequence[str], horizon: int, carried: Sequence[str]) -> DataFrame:
    """Each placement (`placement` index) beside the next `horizon` messages: offset 1 to horizon, `carried` under `next_`.

    An equi-join on the message index; offsets past the last message have NULLs, so no placement is lost.
    """
    wide = placements.withColumn("offset", F.explode(F.sequence(F.lit(1), F.lit(horizon)))).withColumn("at", F.col("placement") + F.col("offset"))
    ahead = events.select(*keys, F.col("event_index").alias("at"), *[F.col(c).alias(f"next_{c}") for c in carried])
    return wide.join(ahead, [*keys, "at"], "left").drop("at")


def all_defined(columns: Sequence[str]) -> Column:
    """True where every column has a value."""
    out = F.lit(True)
    for c in columns:
        out = out & F.col(c).isNotNull()
    return out
