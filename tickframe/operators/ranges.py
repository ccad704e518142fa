"""Order statistics and ranks of any number of rows a key, by one sort in ranges of (key, value).

No task holds a key: rows are numbered by ranges, a key is a stretch of numbers, and what is asked for is picked by number.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickframe.operators.resampling import numbered


def _placed(rows: DataFrame, keys: Sequence[str], value: str) -> tuple[DataFrame, DataFrame]:
    placed = numbered(rows.where(F.col(value).isNotNull()).select(*keys, value), [*keys, value])
    return placed, placed.groupBy(*keys).agg(F.min("place").alias("_start"), F.count("*").alias("_n"))


def exact_quantiles(rows: DataFrame, keys: Sequence[str], value: str, shares: Sequence[float]) -> DataFrame:
    """(keys, quantiles): the quantiles at `shares`, in their order, linear between neighbours; NULLs are left out."""
    placed, spans = _placed(rows, keys, value)
    asked = spans.withColumn("_i", F.explode(F.sequence(F.lit(0), F.lit(len(shares) - 1))))
    at = (F.col("_n") - 1) * F.element_at(F.array(*[F.lit(float(s)) for s in shares]), F.col("_i") + 1)
    ends = asked.select(*keys, "_i", at.alias("_at"), F.explode(F.array(F.struct(F.lit("low").alias("end"), (F.col("_start") + F.floor(at)).alias("place")), F.struct(F.lit("high").alias("end"), (F.col("_start") + F.ceil(at)).alias("place")))).alias("_e"))
    ends = ends.select("_i", "_at", F.col("_e.end").alias("_end"), F.col("_e.place").alias("place"))
    met = placed.join(ends, "place")
    of = lambda end: F.max(F.when(F.col("_end") == end, F.col(value)))
    both = met.groupBy(*keys, "_i", "_at").agg(of("low").alias("_low"), of("high").alias("_high"))
    between = F.when(F.col("_low") == F.col("_high"), F.col("_low")).otherwise((F.ceil("_at") - F.col("_at")) * F.col("_low") + (F.col("_at") - F.floor("_at")) * F.col("_high"))
    return both.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("_i", between.cast("double").alias("q")))), lambda x: x["q"]).alias("quantiles"))


def ranked(rows: DataFrame, keys: Sequence[str], value: str, name: str) -> DataFrame:
    """Adds the rank of `value` within its key, from 1, ties at their mean; NULL for a NULL."""
    placed, spans = _placed(rows, keys, value)
    ties = placed.groupBy(*keys, value).agg(((F.min("place") + F.max("place")) / 2.0).alias("_middle"))
    ranks = (ties.join(spans, list(keys)) if keys else ties.crossJoin(F.broadcast(spans))).select(*keys, value, (F.col("_middle") - F.col("_start") + 1).alias(name))
    return rows.join(ranks, [*keys, value], "left")
