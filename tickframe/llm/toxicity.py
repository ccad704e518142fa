"""Operator 10, toxicity by class-conditional Kneser-Ney models.

Two byte n-gram models, one of toxic and one of ordinary labelled texts, are interpolated by absolute discounting. Their
lowest order is shared: continuation counts over both classes, so that a rare expression backs off to the same
probability in either model and only expressions that a class uses differently tell. A text's score compares the two
log-likelihoods per character, and how the ratio lies to that of ordinary texts.

The counts are gathered over every labelled training row and grow with it; all model tables are joins and groupings of
n-gram rows. Scoring tasks get every n-gram seen, with its whole key, in hash tables that grow with the n-grams counted (32 to
64 bytes each): an n-gram not seen meets no other's ratio and backs off.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickframe.llm.common import cut_lineage, remainder, slices, small_batches, texts


@dataclass(frozen=True)
class KneserNey:
    order: int = 5
    discount: float = 0.75
    #: Labelled texts of each class that are counted, at most (drawn by a hash of doc_id): it bounds the tables that every task gets.
    learned: int = 200_000
    #: Labelled rows on which the score is calibrated, at most; they take no part in the counts.
    calibration: int = 20_000
    #: Up to so many labels (about 16 bytes each) go to the texts; more of them, and both sides are shuffled.
    broadcast_labels: int = 2_000_000


_MIX = np.uint64(0x9E3779B97F4A7C15)


def _prepare(text: bytes) -> bytes:
    lowered = text.lower() if text.isascii() else text.decode().lower().encode()
    return b" " + b" ".join(lowered.split()) + b" "


def _codes(data: np.ndarray, order: int) -> np.ndarray:
    """The n-grams of `order` bytes, each as one number."""
    n = len(data) - order + 1
    codes = np.zeros(max(n, 0), np.int64)
    for k in range(order if n > 0 else 0):
        codes = (codes << 8) | data[k : k + n]
    return codes


class Table:
    """Ratio (NaN: not seen) and backoff ratio of n-grams by their exact codes, in an open hash table half full at most."""

    def __init__(self, codes: np.ndarray, values: np.ndarray):
        self.bits = max(4, int(2 * len(codes) - 1).bit_length()) if len(codes) else 4
        self.codes = np.full(1 << self.bits, -1, np.int64)
        self.values = np.tile(np.array([np.nan, 0], np.float32), (1 << self.bits, 1))
        left, at = np.arange(len(codes)), self._start(codes)
        while len(left):
            free = self.codes[at] < 0
            self.codes[at[free]] = codes[left[free]]
            placed = self.codes[at] == codes[left]
            self.values[at[placed]] = values[left[placed]]
            left, at = left[~placed], (at[~placed] + 1) & (len(self.codes) - 1)

    def _start(self, codes: np.ndarray) -> np.ndarray:
        mixed = codes.astype(np.uint64) * _MIX
        return ((mixed ^ (mixed >> np.uint64(29))) * _MIX >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = self._start(codes)
        held = self.codes[at]
        left = np.flatnonzero((held != codes) & (held >= 0))
        while len(left):
            at[left] = (at[left] + 1) & (len(self.codes) - 1)
            held = self.codes[at[left]]
            left = left[(held != codes[left]) & (held >= 0)]
        # A search that ends at a free place finds its NaN and 0.
        found = self.values[at]
        return found[:, 0], found[:, 1]


def _count_ngrams(order: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 8 << 20):
            labels = np.array(batch.column("toxic").to_pylist())
            data = texts(batch)
            found = []
            for label in (0, 1):
                joined = np.frombuffer(b"\0".join(_prepare(t or b"") for t, x in zip(data, labels, strict=True) if x == label), np.uint8).astype(np.int64)
                codes = _codes(joined, order)
                whole = np.ones(len(codes), bool)
                for k in range(order):
                    whole &= joined[k : k + len(codes)] != 0
                found.append(np.unique(codes[whole], return_counts=True))
            codes = np.concatenate([f[0] for f in found])
            toxic = np.repeat([0, 1], [len(f[0]) for f in found])
            counts = np.concatenate([f[1] for f in found])
            yield pa.RecordBatch.from_arrays([pa.array(codes), pa.array(np.where(toxic == 0, counts, 0)), pa.array(np.where(toxic == 1, counts, 0))], ["gram", "n0", "n1"])

    return run


def ngram_table(labelled: DataFrame, settings: KneserNey) -> DataFrame:
    """(gram, n0, n1): counts of each n-gram of the highest order in ordinary and toxic texts."""
    return labelled.mapInArrow(_count_ngrams(settings.order), "gram long, n0 long, n1 long").groupBy("gram").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))


def log_ratios(top: DataFrame, settings: KneserNey) -> DataFrame:
    """(order, gram, ratio, back, n): log of toxic over ordinary probability of every n-gram seen, and of its context's
    backoff weights.

    Orders above 1 have counts by class; the lowest order has shared continuation counts. A class without counts for a
    context uses the next lower order as it is.
    """
    d = settings.discount
    orders = {settings.order: top}
    for k in range(settings.order - 1, 1, -1):
        # Kneser-Ney: a lower order counts the distinct n-grams that it ends, by class.
        above = orders[k + 1]
        orders[k] = cut_lineage(above.groupBy((F.col("gram").bitwiseAND((1 << 8 * k) - 1)).alias("gram")).agg(F.sum((F.col("n0") > 0).cast("long")).alias("n0"), F.sum((F.col("n1") > 0).cast("long")).alias("n1")))
    kinds = orders[2].groupBy(F.col("gram").bitwiseAND(255).alias("gram")).agg(F.count("*").alias("n"))
    total = F.sum("n").over(Window.partitionBy())
    lower = kinds.select("gram", ((F.col("n") + d) / (total + 256 * d)).alias("p0"), ((F.col("n") + d) / (total + 256 * d)).alias("p1"))
    tables = []
    for k in range(2, settings.order + 1):
        grams = orders[k].withColumn("context", F.shiftright("gram", 8)).withColumn("tail", F.col("gram").bitwiseAND((1 << 8 * (k - 1)) - 1))
        contexts = grams.groupBy("context").agg(*[f for c in "01" for f in (F.sum(f"n{c}").alias(f"t{c}"), F.sum((F.col(f"n{c}") > 0).cast("long")).alias(f"u{c}"))])
        weight = lambda c: F.when(F.col(f"t{c}") > 0, d * F.col(f"u{c}") / F.col(f"t{c}")).otherwise(1.0)
        contexts = contexts.select(F.col("context").alias("of_context"), "t0", "t1", weight("0").alias("w0"), weight("1").alias("w1"))
        joined = grams.join(contexts, F.col("context") == F.col("of_context")).join(lower.select(F.col("gram").alias("of_tail"), F.col("p0").alias("q0"), F.col("p1").alias("q1")), F.col("tail") == F.col("of_tail"))
        p = lambda c: F.when(F.col(f"t{c}") > 0, F.greatest(F.col(f"n{c}") - d, F.lit(0.0)) / F.col(f"t{c}")).otherwise(0.0) + F.col(f"w{c}") * F.col(f"q{c}")
        lower = cut_lineage(joined.select("gram", p("0").alias("p0"), p("1").alias("p1"), (F.col("n0") + F.col("n1")).alias("n")))
        tables.append(lower.select(F.lit(k).alias("order"), "gram", F.log(F.col("p1") / F.col("p0")).alias("ratio"), F.col("n")))
        tables.append(contexts.select(F.lit(-k).alias("order"), F.col("of_context").alias("gram"), F.log(F.col("w1") / F.col("w0")).alias("ratio"), (F.col("t0") + F.col("t1")).alias("n")))
    whole = tables[0]
    for t in tables[1:]:
        whole = whole.union(t)
    return whole


def _pack(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of (order, gram, ratio) as one row of arrays for each order of a batch."""
    for batch in slices(batches):
        order, gram, ratio = (batch.column(k).to_numpy(zero_copy_only=False) for k in ("order", "gram", "ratio"))
        kinds = np.unique(order)
        yield pa.RecordBatch.from_arrays([pa.array(kinds, pa.int32()), *[pa.array([x[order == k].astype(t).tobytes() for k in kinds], pa.binary()) for x, t in ((gram, np.int64), (ratio, np.float32))]], ["order", "grams", "ratios"])


def score_tables(ratios: DataFrame, settings: KneserNey) -> dict[int, Table]:
    """Per n-gram length the ratios of n-grams and, for the order above, the backoff ratios of contexts.

    The tables hold every n-gram of the counted texts, whose number `learned` bounds.
    """
    parts: dict[int, tuple[list, list]] = {k: ([], []) for o in range(2, settings.order + 1) for k in (o, -o)}
    for row in ratios.select("order", "gram", "ratio").coalesce(64).mapInArrow(_pack, "order int, grams binary, ratios binary").collect():
        parts[row["order"]][0].append(np.frombuffer(row["grams"], np.int64))
        parts[row["order"]][1].append(np.frombuffer(row["ratios"], np.float32))
    empty = (np.zeros(0, np.int64), np.zeros(0, np.float32))
    flat = {k: tuple(np.concatenate([e, *x]) for e, x in zip(empty, part, strict=True)) for k, part in parts.items()}
    tables = {}
    for k in range(1, settings.order + 1):
        (own, ratio), (context, back) = flat.get(k, empty), flat.get(-k - 1, empty)
        codes = np.union1d(own, context)
        values = np.tile(np.array([np.nan, 0], np.float32), (len(codes), 1))
        values[np.searchsorted(codes, own), 0] = ratio
        values[np.searchsorted(codes, context), 1] = back
        tables[k] = Table(codes, values)
    return tables


def log_ratio(text: bytes | None, tables: dict[int, Table], settings: KneserNey) -> float:
    """Toxic minus ordinary log-likelihood per character."""
    data = np.frombuffer(_prepare(text or b""), np.uint8).astype(np.int64)
    n = len(data)
    if n < 2:
        return 0.0
    total = np.zeros(n - 1, np.float32)
    _, back = tables[1].find(data)
    for k in range(2, settings.order + 1):
        if n < k:
            break
        seen, above = tables[k].find(_codes(data, k))
        own = total[k - 2 :]
        # The context of an n-gram is the one a byte shorter that starts where it starts.
        np.copyto(own, np.where(np.isnan(seen), own + back[: len(own)], seen))
        back = above
    return float(total.sum() / n)


def _evidence(x: np.ndarray, size: np.ndarray, centre: float) -> np.ndarray:
    """How far the log ratio per character lies above that of ordinary texts (`centre`), and how sure that is: a mean over n
    characters varies with one over the root of n.

    Both are 0 at the centre, so length alone tells nothing; a text without two characters tells nothing either.
    """
    above = np.where(size < 2, 0.0, x - centre)
    return np.column_stack([above, above * np.sqrt(np.clip(size, 1, 40_000)), np.ones(len(x))])


@dataclass(frozen=True)
class Curve:
    """Logistic weights of the evidence."""

    weights: tuple[float, ...] = (0.0, 0.0, 0.0)
    centre: float = 0.0

    def score(self, x: np.ndarray, size: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(_evidence(x, size, self.centre) @ np.array(self.weights), -500, 500)))


def _scores(shared, settings: KneserNey, curve: Curve, keep: list[str]):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = shared.value
        for batch in slices(batches):
            data = texts(batch)
            x, size = np.array([log_ratio(t, tables, settings) for t in data]), np.array([len(t or b"") for t in data])
            score = curve.score(x, size)
            yield pa.RecordBatch.from_arrays([*[batch.column(k) for k in keep], pa.array(x), pa.array(size, pa.int64()), pa.array(score), pa.array((score >= 0.5).astype(np.int32))], [*keep, "log_ratio", "size", "score", "predicted"])

    return run


def calibrate(x: np.ndarray, size: np.ndarray, y: np.ndarray) -> Curve:
    """The curve by Newton steps with a small ridge, centred at the median ordinary text; without both classes a constant."""
    if len(x) == 0 or y.min() == y.max():
        return Curve((0.0, 0.0, 1.0 if len(x) and y.max() > 0 else -1.0))
    centre = float(np.median(x[y == 0]))
    rows = _evidence(x, size, centre)
    scale = np.append(np.maximum(rows[:, :-1].std(axis=0), 1e-9), 1.0)
    rows, beta = rows / scale, np.zeros(3)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(rows @ beta, -30, 30)))
        step = np.linalg.solve(rows.T @ (rows * (p * (1 - p))[:, None]) + 1e-2 * np.eye(3), rows.T @ (y - p) - 1e-2 * beta)
        beta += step
        if np.abs(step).max() < 1e-9:
            break
    return Curve(tuple((beta / scale).tolist()), centre)


def score_toxicity(docs: DataFrame, labels: DataFrame, settings: KneserNey = KneserNey()) -> DataFrame:
    """One row per row of `docs`: doc_id, held_out, score, predicted, log_ratio.

    Learns from labelled rows whose crc32(doc_id) mod 5 is not 0: remainders 1 to 3 give the counts (at most `learned` rows of
    each class), remainder 4 (at most `calibration` rows) the logistic curve from log ratio and length to score. Null labels are left out; of several labels of one
    doc_id the largest counts. Null, empty and one-character texts have a log ratio of 0. With no labels, or labels of
    one class only, scores tell nothing and stay on one side of 0.5. A null doc_id is neither learned from nor held out.
    """
    spark = docs.sparkSession
    small_batches(spark)
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    fold: Column = remainder("doc_id", 5)
    known = labels.where("toxic IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("int").alias("toxic"))
    known = cut_lineage(known)
    if known.count() <= settings.broadcast_labels:
        known = F.broadcast(known)
    counted = known.where(fold.between(1, 3))
    drawn = F.pmod(F.xxhash64(F.lit("learn"), "doc_id"), F.lit(1 << 20))
    share = F.lit(0)
    for kind, n in counted.groupBy("toxic").count().collect():
        share = F.when(F.col("toxic") == kind, int(min(1.0, settings.learned / n) * (1 << 20))).otherwise(share)
    learned = own.where(fold.between(1, 3)).join(counted.where(drawn < share), "doc_id").select("toxic", "text")
    tables = score_tables(log_ratios(cut_lineage(ngram_table(learned, settings)), settings), settings)
    shared = spark.sparkContext.broadcast(tables)
    share = min(1.0, settings.calibration / max(known.where(fold == 4).count(), 1))
    judged = known.where((fold == 4) & (F.pmod(F.xxhash64(F.lit("cal"), "doc_id"), F.lit(1 << 20)) < int(share * (1 << 20))))
    probe = own.where(fold == 4).join(judged, "doc_id").select("toxic", "text").mapInArrow(_scores(shared, settings, Curve(), ["toxic"]), "toxic int, log_ratio double, size long, score double, predicted int")
    seen = probe.select("toxic", "log_ratio", "size").toPandas()
    curve = calibrate(seen["log_ratio"].to_numpy(float), seen["size"].to_numpy(float), seen["toxic"].to_numpy(float))
    marked = own.select("doc_id", F.coalesce(fold == 0, F.lit(False)).alias("held_out"), "text")
    scored = marked.mapInArrow(_scores(shared, settings, curve, ["doc_id", "held_out"]), "doc_id long, held_out boolean, log_ratio double, size long, score double, predicted int")
    return scored.select("doc_id", "held_out", "score", "predicted", "log_ratio")
