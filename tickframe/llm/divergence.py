"""Operator 13, source divergence audit: how far the sources of a language lie apart in their words, and by which words.

The steps are those of a count vectoriser with a least document frequency and no limit to its vocabulary (2^31 - 1 terms), fitted by
language: whole documents become sparse count vectors, their sums by language and source are the groups, and pairs of groups are
compared sparsely. Spark's own CountVectorizer hands its vocabulary to the driver and every executor, and counts each document's
terms twice (README has its figures); here a task sums the vectors of its documents, and one shuffle by language and term
brings counts and document frequencies together, so that the vocabulary stays a table. All arithmetic is on integers.
"""

from __future__ import annotations

import uuid
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickframe.llm.common import shared_folder, slices, small_batches, texts

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: By byte of UTF-8: A to Z in lower case, a to z and everything beyond ASCII as they are, all else a blank.
_LETTERS = bytes(ord(chr(b).lower()) if b < 128 and chr(b).isalpha() else b if b >= 128 else 32 for b in range(256))
_PAIRS = "lang string, a int, b int, value long"


@dataclass(frozen=True)
class Divergence:
    min_docs: int = 30
    prior: int = 5
    scale: int = 1_000_000_000
    top_terms: int = 50
    #: Counts that a task holds before it hands them on.
    most_cells: int = 1_000_000
    #: Groups (language, source) that are broadcast at most, about 100 bytes each; more of them are joined by a shuffle.
    broadcast_groups: int = 200_000
    #: Counts of terms that one task compares at once, on average.
    block_rows: int = 500_000
    least_blocks: int = 16


def _vectors(c: Divergence):
    """Rows of (lang, source, term, n, docs): the summed count vectors of a task's documents, handed on when they grow large. A
    group's empty term has no counts; it tells that the group is there."""

    def add(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[tuple[str, str], Counter[bytes]] = defaultdict(Counter)
        docs: dict[tuple[str, str], Counter[bytes]] = defaultdict(Counter)
        for batch in slices(batches):
            for lang, source, text in zip(batch.column("lang").to_pylist(), batch.column("source").to_pylist(), texts(batch), strict=True):
                vector = text.translate(_LETTERS).split()
                counts[lang, source].update(vector)
                docs[lang, source].update(set(vector))
            if sum(map(len, counts.values())) > c.most_cells:
                yield from _rows(counts, docs)
                counts.clear()
                docs.clear()
        yield from _rows(counts, docs)

    return add


def _rows(counts: dict[tuple[str, str], Counter[bytes]], docs: dict[tuple[str, str], Counter[bytes]]) -> Iterator[pa.RecordBatch]:
    for (lang, source), own in counts.items():
        terms, groups = [b"", *own], docs[lang, source]
        names = [pa.repeat(pa.scalar(x, pa.string()), len(terms)) for x in (lang, source)]
        yield pa.RecordBatch.from_arrays([*names, pa.array(terms, pa.binary()).cast(pa.string()), pa.array([0, *own.values()], pa.int64()), pa.array([0, *(groups[t] for t in own)], pa.int64())], ["lang", "source", "item", "n", "docs"])


def group_counts(docs: DataFrame, c: Divergence) -> DataFrame:
    """lang, source, item, n of every kept term of every group, and for each group a row with the item ''."""
    small_batches(docs.sparkSession)
    read = docs.select(*[F.coalesce(F.col(x), F.lit("")).alias(x) for x in ("lang", "source", "text")])
    dealt = read.mapInArrow(_vectors(c), "lang string, source string, item string, n long, docs long").repartition("lang", "item")
    sums = dealt.groupBy("lang", "source", "item").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    spread = sums.withColumn("docs", F.sum("docs").over(Window.partitionBy("lang", "item")))
    return spread.where((F.col("docs") >= c.min_docs) | (F.col("item") == "")).drop("docs")


def source_divergence(docs: DataFrame, c: Divergence = Divergence()) -> DataFrame:
    """lang, source, part, item, value, rank: distances to the other sources of a language, and the terms that stand out.

    Null text, lang and source count as ''. A group without terms is compared, too; a language without kept terms has
    distances of 0 and no terms. Equal values rank by the item's UTF-8. Repeated rows count as often as they stand there,
    an empty table gives none, columns other than text, lang and source are not read, and texts of any length count whole.
    """
    spark = docs.sparkSession
    folder = f"{shared_folder(spark)}/divergence-{uuid.uuid4().hex}"
    group_counts(docs, c).write.option("compression", "zstd").parquet(f"{folder}/counts")
    counts = spark.read.parquet(f"{folder}/counts")
    sums = counts.where("item <> ''")
    levels = lambda n, total: F.expr(f"CASE WHEN terms = 0 THEN 0L ELSE 1L + (CAST({c.scale} AS DECIMAL(19, 0)) * ({n} + {c.prior})) div CAST({total} + {c.prior} * terms AS DECIMAL(19, 0)) END")
    per_term = sums.groupBy("lang", "item").agg(F.sum("n").alias("lang_n"))
    langs = per_term.groupBy("lang").agg(F.count("*").alias("terms"), F.sum("lang_n").alias("lang_total"))
    totals = sums.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count("*").alias("cells"))
    groups = counts.where("item = ''").select("lang", "source").join(totals, ["lang", "source"], "left").join(langs, "lang", "left")
    groups = groups.fillna(0, ["total", "cells", "terms", "lang_total"]).withColumn("base", levels("0", "total"))
    groups = groups.withColumns({"number": F.row_number().over(Window.partitionBy("lang").orderBy("source")), "blocks": c.least_blocks + F.floor(F.sum("cells").over(Window.partitionBy("lang")) / c.block_rows)})
    groups.write.parquet(f"{folder}/groups")
    groups = spark.read.parquet(f"{folder}/groups")
    offered = F.broadcast(groups) if groups.count() <= c.broadcast_groups else groups
    cells = sums.join(offered, ["lang", "source"]).withColumn("level", levels("n", "total"))
    return _pairs(cells, groups).unionByName(_terms(cells, per_term, levels, c))


def _terms(cells: DataFrame, per_term: DataFrame, levels, c: Divergence) -> DataFrame:
    """The terms of a group above their language's level, the first `top_terms` of them; ranks are limited before the shuffle."""
    found = cells.join(per_term, ["lang", "item"]).withColumn("value", F.col("level") - levels("lang_n", "lang_total")).where("value > 0")
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    return found.select("lang", "source", "item", "value").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= c.top_terms).select("lang", "source", F.lit("term").alias("part"), "item", "value", "rank")


def _pairs(cells: DataFrame, groups: DataFrame) -> DataFrame:
    """Every two sources of a language: the sum of the differences of their levels over all of the language's terms.

    Most terms are absent from most sources. A pair starts with the difference of its base levels times the number of terms;
    blocks of terms add what the terms that a source has change, and what those that both have change once more.
    """
    cut = F.pmod(F.xxhash64("item"), F.col("blocks")).cast("int")
    own = cells.select("lang", cut.alias("block"), F.col("number").alias("source"), F.xxhash64("item").alias("term"), "level", F.lit(None).cast("long").alias("base"), F.lit(None).cast("long").alias("terms"))
    heads = groups.select("lang", F.explode(F.sequence(F.lit(0), (F.col("blocks") - 1).cast("int"))).alias("block"), F.col("number").alias("source"), F.lit(None).cast("long").alias("term"), F.lit(None).cast("long").alias("level"), "base", "terms")
    parts = own.unionByName(heads).groupBy("lang", "block").applyInArrow(_compare, _PAIRS)
    found = parts.groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    both = found.select("lang", F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("x"), "value").select("lang", F.col("x.a").alias("a"), F.col("x.b").alias("b"), "value")
    names = groups.select("lang", "number", "source")
    named = both.join(names.withColumnRenamed("number", "a"), ["lang", "a"]).join(names.select("lang", F.col("number").alias("b"), F.col("source").alias("item")), ["lang", "b"])
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    return named.select("lang", "source", F.lit("pair").alias("part"), "item", "value", F.row_number().over(order).alias("rank"))


def _compare(key: tuple, table: pa.Table) -> pa.Table:
    """Sums of one block of one language's terms by pairs of source numbers (a < b)."""
    lang, block = key[0].as_py(), key[1].as_py()
    columns = {n: table.column(n).combine_chunks() for n in ("source", "term", "level", "base", "terms")}
    head = columns["term"].is_null().to_numpy(zero_copy_only=False)
    numbers = columns["source"].to_numpy(zero_copy_only=False)
    order = np.argsort(numbers[head])
    count, base = len(order), columns["base"].filter(pa.array(head)).to_numpy()[order]
    terms = int(columns["terms"].filter(pa.array(head))[0].as_py())
    body = pa.array(~head)
    source, term, level = numbers[~head].astype(np.int64) - 1, columns["term"].filter(body).to_numpy(), columns["level"].filter(body).to_numpy()
    return pa.Table.from_batches(list(_sums(lang, block, count, base, terms, source, term, level)) or [], schema=pa.schema([("lang", pa.string()), ("a", pa.int32()), ("b", pa.int32()), ("value", pa.int64())]))


def _sums(lang: str, block: int, count: int, base: np.ndarray, terms: int, source: np.ndarray, term: np.ndarray, level: np.ndarray) -> Iterator[pa.RecordBatch]:
    def rows(a: np.ndarray, b: np.ndarray, value: np.ndarray) -> pa.RecordBatch:
        low, high = np.minimum(a, b) + 1, np.maximum(a, b) + 1
        return pa.RecordBatch.from_arrays([pa.array([lang] * len(a), pa.string()), pa.array(low.astype(np.int32)), pa.array(high.astype(np.int32)), pa.array(value.astype(np.int64))], ["lang", "a", "b", "value"])

    everyone = np.arange(count)
    order = np.lexsort((level, source))
    ends = np.searchsorted(source[order], np.arange(count + 1))
    for a in everyone:
        apart = np.abs(base - base[a])
        value = np.zeros(count, np.int64)
        if block == 0:
            value += np.where(everyone > a, apart * terms, 0)
        own = level[order[ends[a] : ends[a + 1]]]
        if len(own):
            below = np.searchsorted(own, base, "right")
            before = np.concatenate([[0], np.cumsum(own)])
            value += base * (2 * below - len(own)) + before[-1] - 2 * before[below] - apart * len(own)
        others = everyone != a
        if others.any() and (block == 0 or len(own)):
            yield rows(np.full(count - 1, a), everyone[others], value[others])
    order = np.argsort(term, kind="stable")
    source, term, level = source[order], term[order], level[order]
    step = 1
    while step < len(term) and (same := np.flatnonzero(term[step:] == term[:-step])).size:
        a, b = source[same], source[same + step]
        value = np.abs(level[same] - level[same + step]) - np.abs(level[same] - base[b]) - np.abs(base[a] - level[same + step]) + np.abs(base[a] - base[b])
        keys, where = np.unique(np.minimum(a, b) * count + np.maximum(a, b), return_inverse=True)
        sums = np.zeros(len(keys), np.int64)
        np.add.at(sums, where, value)
        yield rows(keys // count, keys % count, sums)
        step += 1


_MAP = f"translate(coalesce(text, ''), '{UPPER}', '{LOWER}')"
SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, regexp_extract_all({_MAP}, '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS ts FROM documents),
t AS (SELECT r, lang, source, unnest(ts) AS item FROM d),
k AS (SELECT lang, item, count(*)::HUGEINT AS ln FROM t GROUP BY lang, item HAVING count(DISTINCT r) >= 30),
l AS (SELECT lang, count(*)::HUGEINT AS v, sum(ln) AS lt FROM k GROUP BY lang),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT t.lang, t.source, t.item, count(*)::HUGEINT AS n FROM t JOIN k ON t.lang = k.lang AND t.item = k.item GROUP BY ALL),
s AS (SELECT g.lang, g.source, coalesce(sum(n), 0) AS total FROM g LEFT JOIN c ON g.lang = c.lang AND g.source = c.source GROUP BY ALL),
p AS (SELECT s.lang, s.source, k.item, coalesce(n, 0) AS n, 1 + (1000000000 * (coalesce(n, 0) + 5)) // (s.total + 5 * v) AS p, 1 + (1000000000 * (ln + 5)) // (lt + 5 * v) AS q
  FROM s JOIN l ON s.lang = l.lang JOIN k ON s.lang = k.lang LEFT JOIN c ON c.lang = s.lang AND c.source = s.source AND c.item = k.item),
x AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.item = b.item AND a.source <> b.source GROUP BY ALL),
w AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(x.value, 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN x ON x.lang = a.lang AND x.source = a.source AND x.item = b.source
  UNION ALL SELECT lang, source, 'term', item, p - q FROM p WHERE n > 0 AND p > q),
o AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM w)
SELECT lang, source, part, item, value::BIGINT AS value, rank::INT AS rank FROM o WHERE part = 'pair' OR rank <= 50
"""
