"""Small helpers shared by the training-data operators."""

from __future__ import annotations

import os
import tempfile
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are maximal runs of characters outside this set (space and U+0009 to U+000D).
WORD_PATTERN = "[^\\x20\\x09-\\x0D]+"


#: Bytes of text that a task of a pipeline stage takes at once: Spark uses its Python processes again, so what one stage
#: has needed there stands beside the next one's memory.
STAGE_BYTES = 2 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession, most_bytes: int = 8 << 20) -> None:
    """Texts go to Python in Arrow batches of 8 MB at most (64 MB is usual): a task holds a batch on both sides and copies of it."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(most_bytes))


def texts(batch: pa.RecordBatch, name: str = "text") -> list[bytes | None]:
    """A string column of an Arrow batch as UTF-8 bytes; `bytes.split()` then cuts exactly at the blanks above."""
    return batch.column(name).cast(pa.binary()).to_pylist()


def slices(batches: Iterable[pa.RecordBatch], most_bytes: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in smaller batches, so that what a task holds at once does not follow the length of its texts.

    A single row is never cut; a batch holds at least one row.
    """
    for batch in batches:
        rows = batch.num_rows
        if rows == 0:
            continue
        step = max(1, int(rows * most_bytes / max(batch.nbytes, most_bytes)))
        for start in range(0, rows, step):
            yield batch.slice(start, step)


def stream_groups(batches: Iterable[pa.RecordBatch], keys: list[str]) -> Iterator[dict[str, np.ndarray | list[np.ndarray]]]:
    """The groups of rows that come sorted by `keys`, as arrays by column; a list column gives one array a row.

    Small groups come out of a batch without a call of their own, which makes millions of them affordable.
    """
    rest: pa.RecordBatch | None = None
    for batch in batches:
        if batch.num_rows == 0:
            continue
        if rest is not None:
            batch = pa.Table.from_batches([rest, batch]).combine_chunks().to_batches()[0]
        columns = [batch.column(k).to_numpy(zero_copy_only=False) for k in keys]
        changed = np.zeros(batch.num_rows - 1, bool)
        for c in columns:
            changed |= c[1:] != c[:-1]
        starts = np.concatenate([[0], np.flatnonzero(changed) + 1])
        yield from _cut(batch, starts)
        rest = batch.slice(int(starts[-1]))
    if rest is not None:
        yield from _cut(rest, np.array([0, rest.num_rows]))


def _cut(batch: pa.RecordBatch, edges: np.ndarray) -> Iterator[dict[str, np.ndarray | list[np.ndarray]]]:
    whole = {}
    for name, column in zip(batch.schema.names, batch.columns, strict=True):
        if pa.types.is_list(column.type):
            offsets, values = column.offsets.to_numpy(), column.values.to_numpy(zero_copy_only=False)
            whole[name] = [values[a:b] for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
        else:
            whole[name] = column.to_numpy(zero_copy_only=False)
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        yield {name: values[a:b] for name, values in whole.items()}


def word_hashes(words: list[bytes]) -> np.ndarray:
    """64-bit hashes that agree between processes and runs."""
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], np.uint64)


def window_hashes(hashes: np.ndarray, width: int) -> np.ndarray:
    """One 64-bit hash for each run of `width` neighbouring words (none if there are fewer words)."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    total = np.zeros(n, np.uint64)
    for k in range(width):
        total += hashes[k : k + n] * _ODD[k % 8] + np.uint64(k)
        total ^= total >> np.uint64(29)
        total *= _ODD[(k + 3) % 8]
    return total ^ (total >> np.uint64(32))


def remainder(column: str, modulus: int) -> Column:
    """crc32 of an id as text, modulo `modulus`; null for a null id."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % F.lit(modulus)


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, or one made here where it is unset and all runs in one process."""
    context = spark.sparkContext
    folder = context.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not context.master.startswith("local[") and context.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="spark-checkpoint-", dir=os.environ.get("TMPDIR", "/tmp"))
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(folder)
    return folder


def cut_lineage(df: DataFrame) -> DataFrame:
    """The rows written once to the shared checkpoint folder, so that a lost executor does not lose them."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)
