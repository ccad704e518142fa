"""Operator 12, scoring by context-tree weighting over bytes.

A byte is eight binary decisions, from its highest bit on. Each decision (the bits of the byte so far) has a tree of contexts: the
last byte, the last two, up to `depth`. Every context holds counts of zeros and ones from the training texts and their
Krichevsky-Trofimov (KT) estimate; a context's weighted probability is half its own KT probability and half the product of
those of the contexts one byte longer. What a context says of a new bit is mixed along the path in the proportion that the
training text gave each depth; the walk ends at the deepest context that the training texts hold.

The logarithm of a byte's probability depends on the byte and `depth` bytes before it alone, so the model is a table of grams.
No task holds that table. Texts are dealt into chunks; a chunk asks once for each of its distinct grams and words, the counts
are summed over all chunks, trees are weighted in parts by the two nearest bytes (below them at most 2^24 grams), and the
answers meet the chunk's texts: a task reads a chunk's answers first and then its texts a megabyte at a time. Only the trees' tops, contexts of at most one byte (65,792 rows at most), go through the driver.
"""

from __future__ import annotations

import uuid
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickframe.llm.common import shared_folder, slices, small_batches, texts

#: No byte of UTF-8; ends a text, and stands before it as context.
END = 0xFF

#: Texts are framed so much at a time: a byte takes some 40 bytes of work space.
_AT_ONCE = 1 << 20


@dataclass(frozen=True)
class ContextTrees:
    #: Bytes of the longest context, 2 to 4.
    depth: int = 4
    folds: int = 5
    held_out: int = 1
    #: Text of one chunk: tasks hold a chunk's answers. A longer single text is a chunk of its own length.
    chunk_bytes: int = 32 << 20
    #: Distinct words that a task holds before it hands its requests on.
    most_words: int = 1_000_000
    #: Grams that are weighted at once, or those below two nearest bytes.
    batch_grams: int = 1 << 17

    def __post_init__(self) -> None:
        if not 2 <= self.depth <= 4:
            raise ValueError("depth must be 2 to 4")


def _framed(docs: list[bytes], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Codes of all grams of the texts (nearest context byte highest, the byte itself lowest), and the bounds of each text's."""
    edge = bytes([END])
    data = np.frombuffer(b"".join([x for d in docs for x in (edge * depth, d, edge)]), np.uint8).astype(np.int64)
    lengths = np.fromiter(map(len, docs), np.int64, len(docs)) + 1
    code = data[depth:].copy()
    for back in range(1, depth + 1):
        code |= data[depth - back : len(data) - back] << (8 * (depth + 1 - back))
    starts = np.concatenate([[0], np.cumsum(lengths + depth)[:-1]])
    valid = np.ones(len(code), bool)
    for k in range(1, depth + 1):
        valid[starts[1:] - k] = False
    return code[valid], np.concatenate([[0], np.cumsum(lengths)])


class _Requests:
    """Distinct words and grams of one chunk, with their counts in training texts."""

    def __init__(self) -> None:
        self.words: Counter[bytes] = Counter()
        self.others: set[bytes] = set()
        self.grams: list[tuple[np.ndarray, np.ndarray]] = [(np.empty(0, np.int64), np.empty(0, np.int64))]

    def add(self, docs: list[bytes], train: np.ndarray, depth: int) -> None:
        for doc, counts in zip(docs, train, strict=True):
            if counts:
                self.words.update(doc.split())
            else:
                self.others.update(doc.split())
        code, bounds = _framed(docs, depth)
        places, distinct = pd.factorize(code)
        self.grams.append((distinct, np.bincount(places, np.repeat(train, np.diff(bounds)), len(distinct)).astype(np.int64)))
        # New grams are merged when they outnumber the merged ones, so a chunk holds its distinct grams about twice at most.
        if sum(len(g) for g, _ in self.grams[1:]) > max(len(self.grams[0][0]), _AT_ONCE // 4):
            self.merge()

    def merge(self) -> None:
        if len(self.grams) > 1:
            distinct, where = np.unique(np.concatenate([g for g, _ in self.grams]), return_inverse=True)
            self.grams = [(distinct, np.bincount(where, np.concatenate([n for _, n in self.grams])).astype(np.int64))]

    def batches(self, chunk: int, rows: int = 1 << 16) -> Iterator[pa.RecordBatch]:
        names = ["chunk", "gram", "word", "n"]
        self.merge()
        distinct, counts = self.grams[0]
        for start in range(0, len(distinct), rows):
            own = distinct[start : start + rows]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), chunk)), pa.array(own), pa.nulls(len(own), pa.binary()), pa.array(counts[start : start + rows])], names)
        words = sorted(self.words.keys() | self.others)
        for start in range(0, len(words), rows):
            own = words[start : start + rows]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), chunk)), pa.nulls(len(own), pa.int64()), pa.array(own, pa.binary()), pa.array([self.words[w] for w in own], pa.int64())], names)


def _requests(c: ContextTrees):
    def gather(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: dict[int, _Requests] = defaultdict(_Requests)
        for batch in slices(batches, _AT_ONCE):
            docs = [t.lower() for t in texts(batch)]
            chunks, train = (batch.column(n).to_numpy(zero_copy_only=False) for n in ("chunk", "train"))
            for chunk in np.unique(chunks):
                rows = np.flatnonzero(chunks == chunk)
                own[int(chunk)].add([docs[i] for i in rows], train[rows], c.depth)
            if sum(len(r.words) + len(r.others) for r in own.values()) > c.most_words:
                for chunk, r in own.items():
                    yield from r.batches(chunk)
                own.clear()
        for chunk, r in own.items():
            yield from r.batches(chunk)

    return gather


def log_gamma(x: np.ndarray) -> np.ndarray:
    """ln of the gamma function for x > 0, by Stirling's series at x + 8."""
    y = x + 8.0
    series = (y - 0.5) * np.log(y) - y + 0.9189385332046727 + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - 1 / (1680 * y**7)
    for k in range(8):
        series -= np.log(x + k)
    return series


def log_kt(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """ln of the KT probability of a row of so many zeros and ones."""
    return log_gamma(zeros + 0.5) + log_gamma(ones + 0.5) - log_gamma(zeros + ones + 1.0) - 1.1447298858494002


@dataclass
class _Level:
    """The nodes of one context length: keys (context * 256 + decision), counts, the log odds of stopping here, ln weighted."""

    keys: np.ndarray
    zeros: np.ndarray
    ones: np.ndarray
    odds: np.ndarray | None
    weighted: np.ndarray


def _decisions(grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The eight decisions of each gram's byte: their number in the binary tree, and the bit taken."""
    byte, k = grams & 255, np.arange(8)[:, None]
    return (1 << k) | (byte >> (8 - k)), (byte >> (7 - k)) & 1


def _parents(keys: np.ndarray) -> np.ndarray:
    return (keys >> 16 << 8) | (keys & 255)


def _level(keys: np.ndarray, zeros: np.ndarray, ones: np.ndarray, below: _Level | None) -> _Level:
    own = log_kt(zeros, ones)
    if below is None:
        return _Level(keys, zeros, ones, None, own)
    longer = np.bincount(np.searchsorted(keys, _parents(below.keys)), below.weighted, len(keys))
    return _Level(keys, zeros, ones, own - longer, np.logaddexp(own, longer) - np.log(2))


def _levels(grams: np.ndarray, counts: np.ndarray, depth: int) -> tuple[list[_Level], list[np.ndarray], np.ndarray]:
    """Levels `depth` to 2 of these grams, each gram's place in them by decision, and the bits."""
    number, bit = _decisions(grams)
    levels, places, below = [], [], None
    for d in range(depth, 1, -1):
        keys, where = np.unique(((grams >> (8 * (depth + 1 - d))) << 8) | number, return_inverse=True)
        where = where.reshape(number.shape)
        ones = np.bincount(where.ravel(), (bit * counts).ravel(), len(keys))
        below = _level(keys, np.bincount(where.ravel(), ((1 - bit) * counts).ravel(), len(keys)), ones, below)
        levels.append(below)
        places.append(where)
    return levels, places, bit


def _whole_parts(batches: Iterable[pa.RecordBatch], least: int, depth: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Sorted grams and counts in runs that do not cut the grams of two nearest bytes."""
    grams, counts = np.empty(0, np.int64), np.empty(0, np.int64)
    for batch in batches:
        grams, counts = np.concatenate([grams, batch.column("gram").to_numpy()]), np.concatenate([counts, batch.column("n").to_numpy()])
        if len(grams) >= least:
            near = grams >> (8 * (depth - 1))
            cut = int(np.searchsorted(near, near[-1]))
            if cut:
                yield grams[:cut], counts[:cut]
                grams, counts = grams[cut:], counts[cut:]
    if len(grams):
        yield grams, counts


def _tops(c: ContextTrees):
    def up(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for grams, counts in _whole_parts(batches, c.batch_grams, c.depth):
            last = _levels(grams, counts, c.depth)[0][-1]
            keys, where = np.unique(_parents(last.keys), return_inverse=True)
            yield pa.RecordBatch.from_arrays([pa.array(keys), *[pa.array(np.bincount(where, x, len(keys))) for x in (last.zeros, last.ones, last.weighted)]], ["key", "zeros", "ones", "longer"])

    return up


def _top_levels(rows: pd.DataFrame) -> list[_Level]:
    """Contexts of one byte and of none from the sums of those of two."""
    rows = rows.sort_values("key")
    keys, zeros, ones = rows["key"].to_numpy(np.int64), rows["zeros"].to_numpy(float), rows["ones"].to_numpy(float)
    own, longer = log_kt(zeros, ones), rows["longer"].to_numpy(float)
    one = _Level(keys, zeros, ones, own - longer, np.logaddexp(own, longer) - np.log(2))
    roots, where = np.unique(_parents(keys), return_inverse=True)
    return [one, _level(roots, np.bincount(where, zeros, len(roots)), np.bincount(where, ones, len(roots)), one)]


def _values(c: ContextTrees, tops: list[_Level]):
    def down(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for grams, counts in _whole_parts(batches, c.batch_grams, c.depth):
            levels, places, bit = _levels(grams, counts, c.depth)
            number = _decisions(grams)[0]
            for d, level in zip((1, 0), tops, strict=True):
                keys = ((grams >> (8 * (c.depth + 1 - d))) << 8) | number
                at = np.minimum(np.searchsorted(level.keys, keys), max(len(level.keys) - 1, 0))
                levels.append(level)
                places.append(at)
            p, deeper = np.full(bit.shape, 0.5), np.zeros(bit.shape, bool)
            for level, at in zip(levels, places, strict=True):
                zeros, ones = level.zeros[at], level.ones[at]
                seen = zeros + ones > 0
                estimate = (np.where(bit, ones, zeros) + 0.5) / (zeros + ones + 1)
                stop = np.ones(bit.shape) if level.odds is None else np.where(deeper, 1 / (1 + np.exp(-np.clip(level.odds, -700, 700)))[at], 1.0)
                p = np.where(seen, stop * estimate + (1 - stop) * p, p)
                deeper = seen
            yield pa.RecordBatch.from_arrays([pa.array(grams), pa.array(np.log10(p).sum(0))], ["gram", "value"])

    return down


_SCORED = "doc_id long, held_out boolean, n_tokens long, n_known long, known_score double, score double, n_bytes long"


class _Answers:
    """The values of a chunk's grams, and the counts of its words in training texts."""

    def __init__(self) -> None:
        self.pieces: list[tuple[np.ndarray, np.ndarray]] = []
        self.grams, self.values = np.empty(0, np.int64), np.empty(0)
        self.counts: dict[bytes, float] = {}

    def add(self, batch: pa.RecordBatch) -> None:
        is_gram = batch.column("bytes").is_null()
        of_grams, of_words = batch.filter(is_gram), batch.filter(pa.compute.invert(is_gram))
        # Copies, as an array of Arrow would keep its whole batch.
        self.pieces.append((of_grams.column("number").to_numpy(zero_copy_only=False).copy(), of_grams.column("value").to_numpy().copy()))
        self.counts.update(zip(of_words.column("bytes").to_pylist(), of_words.column("value").to_pylist(), strict=True))

    def of(self, codes: np.ndarray) -> np.ndarray:
        if self.pieces:
            grams, values = (np.concatenate(x) for x in zip(*self.pieces, strict=True))
            self.pieces = []
            order = np.argsort(grams)
            self.grams, self.values = grams[order], values[order]
        places, distinct = pd.factorize(codes)
        at = np.searchsorted(self.grams, distinct)
        if len(self.grams) == 0 or at.max() >= len(self.grams) or (self.grams[at] != distinct).any():
            raise KeyError("gram")
        return self.values[at][places]


def _score(c: ContextTrees):
    """Reads rows (at, number, bytes, value) sorted by `at`: 2 * chunk for answers (gram or word, value), 2 * chunk + 1 for texts (doc_id, text, held out)."""

    def score(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, answers = None, _Answers()
        for batch in batches:
            ats = batch.column("at").to_numpy()
            edges = np.concatenate([[0], np.flatnonzero(np.diff(ats)) + 1, [len(ats)]])
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                if a == b:
                    continue
                if int(ats[a]) // 2 != chunk:
                    chunk, answers = int(ats[a]) // 2, _Answers()
                if ats[a] % 2 == 0:
                    answers.add(batch.slice(a, b - a))
                    continue
                for docs in slices([batch.slice(a, b - a)], _AT_ONCE):
                    yield _scored(docs, answers, c.depth)

    return score


def _scored(docs: pa.RecordBatch, answers: _Answers, depth: int) -> pa.RecordBatch:
    own = [t.lower() for t in texts(docs, "bytes")]
    words = [d.split() for d in own]
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    try:
        n = np.array([answers.counts[w] for d in words for w in d], float)
        code, bounds = _framed(own, depth)
        each = answers.of(code)
    except KeyError as missing:
        raise ValueError("the documents' partitions changed between two reads; write them to files first") from missing
    sums = lambda x, ends: np.diff(np.concatenate([[0], np.cumsum(x)])[ends])
    ends = np.concatenate([[0], np.cumsum(lengths)])
    known = np.array([np.log10(n[a:b] + 0.5).sum() for a, b in zip(ends[:-1], ends[1:], strict=True)])
    total = np.array([each[a:b].sum() for a, b in zip(bounds[:-1], bounds[1:], strict=True)])
    held_out = docs.column("value").to_numpy() > 0
    columns = [docs.column("number"), held_out, lengths, sums(n > 0, ends), known, total, np.diff(bounds)]
    return pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x) for x in columns], _names(_SCORED))


def _names(schema: str) -> list[str]:
    return [x.split()[0] for x in schema.split(", ")]


def score_texts(docs: DataFrame, c: ContextTrees = ContextTrees()) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, n_bytes, bits_per_byte of every document.

    A-Z are lower-cased first, for both scores. A null text is an empty one: its score is that of the end alone. A null
    doc_id counts as '' in the deal of folds, and is not held out. Repeated rows count and are scored each. Without
    training texts every bit has 1/2 and the base score is 0. No other column is read; an empty table gives an empty result.
    `docs` is read twice, and its partitions must come out alike, as those of files do; a difference is an error.
    """
    spark = docs.sparkSession
    small_batches(spark)
    folder = f"{shared_folder(spark)}/contexts-{uuid.uuid4().hex}"
    fold = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % F.lit(c.folds)
    read = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("_split", F.spark_partition_id())
    largest = read.groupBy("_split").agg(F.sum(F.octet_length("text")).alias("n")).agg(F.max("n")).first()[0]
    if largest is None:
        return spark.createDataFrame([], "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, n_bytes long, bits_per_byte double")
    cuts = max(1, -(-largest // c.chunk_bytes))
    dealt = read.select("doc_id", "text", (fold == c.held_out).alias("held_out"), (F.col("_split").cast("long") * cuts + F.pmod(F.xxhash64("doc_id", "text"), F.lit(cuts))).alias("chunk"))
    asked = dealt.select("chunk", "text", F.when(F.col("held_out"), 0).otherwise(1).alias("train")).mapInArrow(_requests(c), "chunk long, gram long, word binary, n long")
    asked.write.option("compression", "zstd").parquet(f"{folder}/asked")
    asked = spark.read.parquet(f"{folder}/asked")
    grams = asked.where("word IS NULL").select("chunk", "gram", "n")
    grams.groupBy("gram").agg(F.sum("n").alias("n")).write.option("compression", "zstd").parquet(f"{folder}/grams")
    near = F.shiftright("gram", 8 * (c.depth - 1))
    parts = spark.read.parquet(f"{folder}/grams").repartition(near).sortWithinPartitions("gram")
    tops = parts.mapInArrow(_tops(c), "key long, zeros double, ones double, longer double").groupBy("key").agg(*[F.sum(x).alias(x) for x in ("zeros", "ones", "longer")])
    values = parts.mapInArrow(_values(c, _top_levels(tops.toPandas())), "gram long, value double")
    by_word = asked.where("word IS NOT NULL").select("chunk", "word", "n").repartition("word")
    counted = by_word.groupBy("word").agg(F.sum("n").alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("tokens"), F.count_if(F.col("n") > 0).alias("distinct"))
    ends = dealt.agg(F.count_if(~F.col("held_out")).alias("texts"))
    of_words = by_word.select((F.col("chunk") * 2).alias("at"), F.lit(None).cast("long").alias("number"), F.col("word").alias("bytes"), F.sum("n").over(Window.partitionBy("word")).cast("double").alias("value"))
    of_grams = grams.drop("n").join(values, "gram").select((F.col("chunk") * 2).alias("at"), F.col("gram").alias("number"), F.lit(None).cast("binary").alias("bytes"), "value")
    asking = dealt.select((F.col("chunk") * 2 + 1).alias("at"), F.col("doc_id").cast("long").alias("number"), F.col("text").cast("binary").alias("bytes"), F.col("held_out").cast("double").alias("value"))
    met = of_words.unionByName(of_grams).unionByName(asking).repartition(F.shiftright("at", 1)).sortWithinPartitions("at")
    scored = met.mapInArrow(_score(c), _SCORED)
    whole = scored.crossJoin(F.broadcast(counted.crossJoin(ends)))
    train = F.col("tokens") + F.col("texts")
    space = F.log10(train + 0.5 * (F.col("distinct") + F.when(F.col("texts") > 0, 1).otherwise(0) + 1))
    n_tokens = F.col("n_tokens") + 1
    base = F.col("known_score") + F.log10(F.col("texts") + 0.5) - n_tokens * space
    return whole.select("doc_id", "held_out", n_tokens.alias("n_tokens"), (F.col("n_known") + F.when(F.col("texts") > 0, 1).otherwise(0)).alias("n_known"), train.alias("train_tokens"), F.round(base, 6).alias("base_score"), F.round("score", 6).alias("score"), "n_bytes", (-F.col("score") / F.log10(F.lit(2.0)) / F.col("n_bytes")).alias("bits_per_byte"))
