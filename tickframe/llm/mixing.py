"""Operator 3, mixing sources to target weights.

Documents get hash-random keys. Within a source they are taken in key order: whole epochs first, then a prefix up to the
rest of the source's budget. The prefix sum is distributed over three levels: 256 coarse ranges of keys a source, 256 fine
ones in each of them, and a running sum inside each fine range gives every document its place. So a source with a third of
all rows is spread over all tasks, and no task adds up more than 256 sums of one source.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickframe.llm.common import WORD_PATTERN, cut_lineage

WEIGHTS = (5.0, 2.0, 1.0)
MAX_EPOCHS = 3
#: Hexadecimal digits of a key that name its coarse and its fine range.
COARSE, FINE = 2, 4
#: Cuts of up to so many sources (about 100 bytes each) go to the texts; more of them are joined by a shuffle.
BROADCAST_SOURCES = 100_000


def word_count(column: str) -> Column:
    return F.coalesce(F.regexp_count(F.col(column), F.lit(WORD_PATTERN)), F.lit(0)).cast("long")


def random_key(doc_id: str, text: str) -> Column:
    """The same for equal rows in every run; texts take part so that repeated or null ids still spread."""
    return F.md5(F.concat(F.lit("mix:"), F.coalesce(F.col(doc_id).cast("string"), F.lit("")), F.lit(":"), F.coalesce(F.col(text), F.lit(""))).cast("binary"))


def source_targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, max_epochs: float = MAX_EPOCHS) -> DataFrame:
    """(source, source_size) to (source, source_size, target), one row per source.

    Sources by code point, null last, take the weights in turn. Where a share is above max_epochs times the source, the
    excess goes to the others by weight. The fixed point is found directly: in the order of source_size / weight, the
    sources before the first one whose share of what is left stays within its bound are full. From there on the level
    per weight only falls, so it is the largest one that stays within. The windows run over one row per source.
    """
    order, level = Window.orderBy(F.col("source").asc_nulls_last()), Window.orderBy("fill", F.col("source").asc_nulls_last())
    before = level.rowsBetween(Window.unboundedPreceding, -1)
    after = level.rowsBetween(0, Window.unboundedFollowing)
    ranked = sizes.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int")))
    ranked = ranked.withColumn("bound", F.lit(float(max_epochs)) * F.col("source_size")).withColumn("fill", F.col("bound") / F.col("weight"))
    whole = F.sum("source_size").over(Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    ranked = ranked.withColumn("per_weight", (whole - F.coalesce(F.sum("bound").over(before), F.lit(0.0))) / F.sum("weight").over(after))
    ranked = ranked.withColumn("open", F.col("per_weight") <= F.col("fill"))
    water = F.max(F.when(F.col("open"), F.col("per_weight"))).over(level.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return ranked.withColumn("water", water).select("source", "source_size", F.least("bound", F.coalesce(F.col("water") * F.col("weight"), F.col("bound"))).alias("target"))


def mix_sources(docs: DataFrame, weights: Sequence[float] = WEIGHTS, max_epochs: float = MAX_EPOCHS) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken, source, key.

    `taken` counts words: each whole epoch takes the document once; in the last one the document at the cut gives only
    the words that still fit, so a source's words add up to its rounded target. Null and empty texts have size 0 and
    take 0. Null is a source of its own. Equal rows are interchangeable. An empty table gives an empty result.
    """
    sized = docs.select("doc_id", "source", word_count("text").alias("size"), random_key("doc_id", "text").alias("key"))
    sized = sized.withColumn("bucket", F.substring("key", 1, FINE))
    sums = sized.groupBy("source", "bucket").agg(F.sum("size").alias("bucket_size")).withColumn("coarse", F.substring("bucket", 1, COARSE))
    coarse = sums.groupBy("source", "coarse").agg(F.sum("bucket_size").alias("coarse_size"))
    targets = source_targets(coarse.groupBy("source").agg(F.sum("coarse_size").alias("source_size")), weights, max_epochs).withColumnRenamed("source", "of")
    earlier = lambda part, order: Window.partitionBy(*part).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    ahead = coarse.withColumn("coarse_offset", F.coalesce(F.sum("coarse_size").over(earlier(["source"], "coarse")), F.lit(0))).join(targets, F.col("source").eqNullSafe(F.col("of")))
    ahead = ahead.select(F.col("source").alias("of"), F.col("coarse").alias("of_coarse"), "coarse_offset", "source_size", "target")
    starts = sums.withColumn("fine_offset", F.coalesce(F.sum("bucket_size").over(earlier(["source", "coarse"], "bucket")), F.lit(0))).join(ahead, (F.col("coarse") == F.col("of_coarse")) & F.col("source").eqNullSafe(F.col("of")))
    starts = starts.select(F.col("source").alias("of"), F.col("bucket").alias("in_bucket"), (F.col("coarse_offset") + F.col("fine_offset")).alias("offset"), "source_size", "target")
    inside = Window.partitionBy("source", "bucket").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = sized.withColumn("ahead", F.coalesce(F.sum("size").over(inside), F.lit(0))).join(starts, (F.col("bucket") == F.col("in_bucket")) & F.col("source").eqNullSafe(F.col("of")))
    budget = F.round(F.col("target")).cast("long")
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0)
    rest = budget - epochs * F.col("source_size") - F.col("offset") - F.col("ahead")
    taken = epochs * F.col("size") + F.greatest(F.lit(0), F.least(F.col("size"), rest))
    return placed.select("doc_id", "size", "source_size", "target", taken.cast("long").alias("taken"), "source", "key")


def repeat_by_mix(docs: DataFrame, weights: Sequence[float] = WEIGHTS, max_epochs: float = MAX_EPOCHS) -> DataFrame:
    """The mixed corpus, same columns: each row as often as its words are taken.

    Texts are never cut: the document at a source's cut is in the last epoch if at least half of its words fit, and equal
    rows at the cut share its fate. Null and empty texts have no words; they stay in once, as they use no budget. A null
    source is a source of its own; an empty table stays empty; other columns may have any names.

    A source's cut is one row (whole epochs, last place taken), so rows are repeated where they lie and no text is moved.
    """
    mixed = mix_sources(docs, weights, max_epochs)
    times = F.floor(F.col("taken") / F.col("size") + 0.5)
    place = lambda key, doc_id, size: F.struct(key.alias("key"), doc_id.alias("doc_id"), size.alias("size"))
    counted = mixed.where("size > 0").select("source", times.alias("times"), F.floor(F.round(F.col("target")).cast("long") / F.col("source_size")).alias("epochs"), place(F.col("key"), F.col("doc_id"), F.col("size")).alias("place"))
    cuts = cut_lineage(counted.groupBy("source").agg(F.max("epochs").alias("epochs"), F.max(F.when(F.col("times") > F.col("epochs"), F.col("place"))).alias("last"))).withColumnRenamed("source", "of")
    if cuts.count() <= BROADCAST_SOURCES:
        cuts = F.broadcast(cuts)
    packed = docs.select(F.struct(*docs.columns).alias("row"), "source", "text", "doc_id").withColumn("size", word_count("text"))
    joined = packed.join(cuts, (F.col("size") > 0) & F.col("source").eqNullSafe(F.col("of")), "left")
    mine = place(random_key("doc_id", "text"), F.col("doc_id"), F.col("size"))
    count = F.when(F.col("size") == 0, 1).otherwise(F.col("epochs") + F.coalesce((mine <= F.col("last")).cast("int"), F.lit(0))).cast("int")
    return joined.select("row", F.explode(F.array_repeat(F.lit(1), count)).alias("copy")).select(*[F.col("row")[c].alias(c) for c in docs.columns])


SQL = """
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size,
         md5('mix:' || coalesce(doc_id::VARCHAR, '') || ':' || coalesce(text, '')) AS key
  FROM documents
), sources AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0 WHEN 1 THEN 2.0 ELSE 1.0 END::DOUBLE AS weight
  FROM sized GROUP BY source
), filled AS (
  SELECT *, 3.0::DOUBLE * source_size AS bound, 3.0::DOUBLE * source_size / weight AS fill FROM sources
), leveled AS (
  SELECT *, (sum(source_size) OVER () - coalesce(sum(bound) OVER (ORDER BY fill, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0))
            / sum(weight) OVER (ORDER BY fill, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS per_weight
  FROM filled
), targets AS (
  SELECT source, source_size, least(bound, coalesce(max(per_weight) FILTER (per_weight <= fill) OVER () * weight, bound)) AS target FROM leveled
), placed AS (
  SELECT s.doc_id, s.size, t.source_size, t.target, round(t.target)::BIGINT AS budget, s.source, s.key,
         coalesce(sum(s.size) OVER (PARTITION BY s.source ORDER BY s.key, s.doc_id, s.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS ahead
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target,
       (CASE WHEN source_size > 0 THEN budget // source_size ELSE 0 END * size
        + greatest(0, least(size, budget - CASE WHEN source_size > 0 THEN budget // source_size ELSE 0 END * source_size - ahead)))::BIGINT AS taken,
       source, key
FROM placed
"""
