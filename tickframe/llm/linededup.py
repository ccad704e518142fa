"""Operator 5, line deduplication with two Bloom filters.

A line's key is the line without blanks at both ends and with A-Z in lower case. Keys of at least ten code points that
occur in two or more documents keep their lines only in the smallest doc_id that holds them.

1. Each task reads its documents' distinct keys and passes on the first 16 bytes of each one's SHA-256 with the document's
   id. Keys that two documents of a slice of the table share are suspected at once: their documents go on as such, and only
   one mark a slice goes to the filters, so that a line of very many documents brings no more than a row a slice.
2. Rows are dealt by their digests over as many tasks as the table has partitions. Each task feeds two Bloom filters: what
   the once-seen filter holds already, or a slice marked, sets its bits in the twice-seen one. Both are sized by the
   digests that they take, so that they tell as much in a large table as in a small one.
3. The same task asks its twice-seen filter about its rows, so filters never leave their tasks, at any size. Only suspected
   rows are shuffled again: grouping by the digest confirms keys of at least two documents and finds the first one.
4. The confirmed drops return to their documents.

A key that very many documents share is grouped before it is shuffled, and where its lines meet the confirmed key, both
sides are plain shuffles, which Spark's adaptive execution splits.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickframe.llm.common import STAGE_BYTES, cut_lineage, slices, small_batches, texts

MIN_KEY = 10
#: A filter gets so many bits for each hash, and each hash sets so many of them.
BITS_PER_HASH, BITS_SET = 16, 4
#: What a line's row is: the only one of its slice, a mark for a key that a slice repeats, or a suspected repeat.
ONCE, AGAIN, SURE = 0, 1, 2
_SPREAD = np.uint64(0x9E3779B97F4A7C15)


def line_key(line: bytes) -> bytes | None:
    """The key of a line; null if it is shorter than ten code points."""
    key = line.strip().lower()
    if len(key) < MIN_KEY or len(key) < 4 * MIN_KEY and len(key.decode("utf-8", "replace")) < MIN_KEY:
        return None
    return key


def key_digest(key: bytes) -> bytes:
    return hashlib.sha256(key).digest()[:16]


def _keys(text: bytes) -> set[bytes]:
    return {k for k in map(line_key, text.split(b"\n")) if k is not None}


def _positions(hashes: np.ndarray, bits: int) -> np.ndarray:
    """Bit positions of each hash, one row a hash (double hashing; `bits` is a power of two)."""
    step = (hashes >> np.uint64(32)) | np.uint64(1)
    k = np.arange(BITS_SET, dtype=np.uint64)
    return (hashes[:, None] + k * step[:, None]) & np.uint64(bits - 1)


class Bloom:
    def __init__(self, bits: int):
        self.bits, self.words = bits, np.zeros(bits >> 3, np.uint8)

    def add(self, hashes: np.ndarray) -> None:
        at = _positions(hashes, self.bits).ravel()
        np.bitwise_or.at(self.words, at >> np.uint64(3), np.left_shift(1, (at & np.uint64(7)).astype(np.uint8)).astype(np.uint8))

    def holds(self, hashes: np.ndarray) -> np.ndarray:
        at = _positions(hashes, self.bits)
        return (self.words[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8) & 1).all(axis=1)


def _filter_bits(hashes: int) -> int:
    return 1 << max(6, int(max(hashes, 1) * BITS_PER_HASH - 1).bit_length())


def _line_rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(route, kind, key, doc_id, owner): the distinct keys of each owner, and marks; rows of one route meet in a task."""
    for batch in slices(batches, STAGE_BYTES):
        by_owner: dict[str, tuple[int | None, set[bytes]]] = {}
        for doc_id, owner, text in zip(batch.column("doc_id").to_pylist(), batch.column("owner").to_pylist(), texts(batch), strict=True):
            if text:
                by_owner.setdefault(owner, (doc_id, set()))[1].update(_keys(text))
        flat = [k for _, keys in by_owner.values() for k in keys]
        digest_of = {k: key_digest(k) for k in set(flat)}
        digests = np.frombuffer(b"".join(map(digest_of.__getitem__, flat)), np.uint64).reshape(-1, 2)
        sizes = [len(keys) for _, keys in by_owner.values()]
        ids = pa.array([i for i, _ in by_owner.values()], pa.int64())
        # An owner is spelled out only where it does not follow from the id.
        owners = pa.array([o if i is None else None for o, (i, _) in by_owner.items()], pa.string())
        _, first, inverse, counts = np.unique(digests[:, 0], return_index=True, return_inverse=True, return_counts=True)
        sure, marks = counts[inverse] > 1, first[counts > 1]
        who = np.repeat(np.arange(len(sizes)), sizes)
        route = digests[:, 0] + np.where(sure, np.arange(len(flat), dtype=np.uint64) * _SPREAD, np.uint64(0))
        at = np.concatenate([np.arange(len(flat)), marks])
        is_mark = pa.array(np.arange(len(at)) >= len(flat))
        null = lambda column: pa.compute.if_else(is_mark, pa.scalar(None, column.type), column.take(pa.array(who[at])))  # noqa: E731, B023
        kinds = np.append(np.where(sure, SURE, ONCE), np.full(len(marks), AGAIN)).astype(np.int8)
        routes = np.append(route, digests[marks, 0]).view(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(routes), pa.array(kinds), _binary(digests[at]), null(ids), null(owners)], ["route", "kind", "key", "doc_id", "owner"])


def _binary(digests: np.ndarray) -> pa.Array:
    ends = np.arange(0, 16 * len(digests) + 1, 16, dtype=np.int32)
    return pa.Array.from_buffers(pa.binary(), len(digests), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(digests))])


def twice_seen(parts: list[tuple[np.ndarray, np.ndarray]]) -> Bloom:
    """The filter of all hashes that stand twice in the (hashes, kinds) of `parts`, or are marked there."""
    once, found = Bloom(_filter_bits(sum(len(h) for h, _ in parts))), []
    for hashes, kinds in parts:
        own, counts = np.unique(hashes, return_counts=True)
        found += [own[(counts > 1) | once.holds(own)], hashes[kinds == AGAIN]]
        once.add(own)
    twice = Bloom(_filter_bits(sum(map(len, found))))
    for hashes in found:
        twice.add(hashes)
    return twice


def _suspected(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, owner, key) of the rows that the filters of these routes suspect, and of those that a slice did."""
    kept, parts = [], []
    for batch in batches:
        kinds = batch.column("kind").to_numpy()
        rows = batch.select(["doc_id", "owner", "key"])
        if (kinds == SURE).any():
            yield rows.filter(pa.array(kinds == SURE))
        rest = kinds != SURE
        hashes = np.frombuffer(b"".join(batch.column("key").to_pylist()), np.uint64)[::2]
        parts.append((hashes[rest], kinds[rest]))
        kept.append(rows.filter(pa.array(rest)))
    twice = twice_seen(parts)
    for rows, (hashes, kinds) in zip(kept, parts, strict=True):
        yield rows.filter(pa.array((kinds == ONCE) & twice.holds(hashes)))


def _owner() -> Column:
    """Rows that lose the same lines: those with one doc_id, or without a doc_id and with one text."""
    return F.coalesce(F.col("doc_id").cast("long").cast("string"), F.concat(F.lit("text:"), F.md5(F.col("text").cast("binary"))), F.lit("text:"))


def suspected_lines(docs: DataFrame) -> DataFrame:
    """(doc_id, owner, key): the digests of all lines' keys that may stand in two documents, each once a document and slice."""
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), _owner().alias("owner"), "text")
    rows = own.mapInArrow(_line_rows, "route long, kind tinyint, key binary, doc_id long, owner string")
    dealt = rows.repartition(max(1, docs.rdd.getNumPartitions()), "route").drop("route")
    found = dealt.mapInArrow(_suspected, "doc_id long, owner string, key binary")
    return found.withColumn("owner", F.coalesce("owner", F.col("doc_id").cast("string")))


def repeated_lines(docs: DataFrame) -> DataFrame:
    """(drop_owner, drop_keys): for each owner the digests of the keys whose lines it loses.

    A document is a doc_id: rows that share one, null included, count as the same document, and null comes last. What a
    row loses is kept by its doc_id, and without one by its text, so that rows without doc_id gather in no one place.
    """
    small_batches(docs.sparkSession, STAGE_BYTES)
    suspected = cut_lineage(suspected_lines(docs))
    # Nulls are kept apart from the smallest and largest id, as either of them is a valid id.
    first = suspected.groupBy("key").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"), F.max(F.col("doc_id").isNull()).alias("no_id"))
    confirmed = cut_lineage(first.where((F.col("first") < F.col("last")) | F.col("no_id") & F.col("first").isNotNull()).select(F.col("key").alias("of_key"), "first"))
    lost = suspected.join(confirmed, F.col("key") == F.col("of_key")).where(~F.col("doc_id").eqNullSafe(F.col("first")))
    return lost.groupBy(F.col("owner").alias("drop_owner")).agg(F.collect_set("key").alias("drop_keys"))


def _apply(names: list[str]):
    """Rewrites text without the lines of `drop_keys`; adds what the digest needs where `names` asks for it."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, STAGE_BYTES):
            kept, total, dropped, digest = [], [], [], []
            for text, keys in zip(texts(batch), batch.column("drop_keys").to_pylist(), strict=True):
                lines = (text or b"").split(b"\n")
                left = lines
                if keys:
                    keys = set(keys)
                    left = [x for x in lines if (key := line_key(x)) is None or key_digest(key) not in keys]
                joined = b"\n".join(left)
                kept.append(None if text is None else joined)
                total.append(len(lines))
                dropped.append(len(lines) - len(left))
                digest.append(hashlib.sha256(joined).hexdigest())
            own = {"kept_text": lambda: pa.array(kept, pa.binary()).cast(pa.string()), "n_lines": lambda: pa.array(total, pa.int64()), "n_dropped": lambda: pa.array(dropped, pa.int64()), "kept_sha256": lambda: pa.array(digest, pa.string())}
            yield pa.RecordBatch.from_arrays([own[n]() if n in own else batch.column(n) for n in names], names)

    return run


def dedup_lines(docs: DataFrame) -> DataFrame:
    """One row per row of `docs`: doc_id, n_lines, n_dropped, kept_sha256.

    A null or empty text is one empty line that stays. Rows with equal doc_id lose the same lines. An empty table gives
    an empty result; other columns are not read. `docs` is read twice and must give the same rows each time.
    """
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), _owner().alias("owner"), "text")
    joined = own.join(repeated_lines(docs), F.col("owner") == F.col("drop_owner"), "left").select("doc_id", "text", "drop_keys")
    return joined.mapInArrow(_apply(["doc_id", "n_lines", "n_dropped", "kept_sha256"]), "doc_id long, n_lines long, n_dropped long, kept_sha256 string")


def drop_repeated_lines(docs: DataFrame) -> DataFrame:
    """`docs` with the same rows and columns, texts without their repeated lines.

    A null text stays null, an empty one empty, and a text that loses all lines becomes empty. Rows with equal doc_id lose
    the same lines. An empty table stays empty; other columns may have any names.
    """
    packed = docs.select(F.struct(*docs.columns).alias("row"), _owner().alias("owner"), "text")
    joined = packed.join(repeated_lines(docs), F.col("owner") == F.col("drop_owner"), "left").select("row", "text", "drop_keys")
    row_type = docs.schema.simpleString()
    rewritten = joined.select(F.col("row").withField("text", F.lit(None).cast("string")).alias("row"), "text", "drop_keys").mapInArrow(_apply(["row", "kept_text"]), f"row {row_type}, kept_text string")
    return rewritten.select(*[F.col("kept_text").alias("text") if c == "text" else F.col("row")[c].alias(c) for c in docs.columns])


SQL = """
WITH lines AS (
  SELECT doc_id, u.i AS i, u.line AS line
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
       LATERAL (SELECT unnest(ls) AS line, generate_subscripts(ls, 1) AS i) u
), keyed AS (
  SELECT doc_id, i, line, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM lines
), firsts AS (
  SELECT k, min(doc_id) AS first FROM keyed WHERE length(k) >= 10 GROUP BY k HAVING count(DISTINCT doc_id) >= 2
), marked AS (
  SELECT doc_id, i, line, coalesce(first <> doc_id, false) AS gone FROM keyed LEFT JOIN firsts USING (k)
)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (gone)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
