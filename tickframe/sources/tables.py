"""Partitioned tables, plain files and manifests on a shared store."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType, StructType

from tickframe.operators.cohorts import manifest, manifest_violations


def work_folder(spark: SparkSession, name: str) -> str:
    """A new folder under spark.checkpoint.dir, which all executors share; in one process a local folder will do."""
    shared = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if shared is None:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        import tempfile

        shared = tempfile.mkdtemp(prefix="spark-tables-")
    return f"{shared}/{name}-{uuid.uuid4().hex}"


def stored(rows: DataFrame, name: str = "stored") -> DataFrame:
    """The rows written once to the shared folder and read back: what follows scans columns in place of computing them again."""
    path = work_folder(rows.sparkSession, name)
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def write_partitions(df: DataFrame, path: str, keys: Sequence[str] = ("symbol", "day")) -> None:
    """One folder a partition, zstd. Only the partitions in `df` are replaced, each as a whole; others stay.

    Rows are dealt by their keys first, so that a partition is written by one task, and a large one split by adaptive execution.
    """
    dealt = df.repartition(*keys)
    dealt.write.partitionBy(*keys).mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", "zstd").parquet(path)


def write_with_totals(df: DataFrame, path: str, totals: dict[str, Column], keys: Sequence[str] = ("symbol", "day")) -> dict[str, object]:
    """Writes as `write_partitions`, and gives `totals` (aggregates by name) with the number of partitions.

    The aggregates are taken from the rows on their way to the files: nothing is read again. Partitions are counted by folder.
    """
    seen = Observation("totals")
    write_partitions(df.observe(seen, *[a.alias(n) for n, a in totals.items()]), path, keys)
    folders = {f.rpartition("/")[0] for f in df.sparkSession.read.schema(df.schema).parquet(path).inputFiles()}
    return {"partitions": len(folders)} | seen.get


def read_partitions(spark: SparkSession, path: str, schema: StructType, columns: Sequence[str], condition: str = "true") -> DataFrame:
    """The rows of the partitions that meet `condition`; the schema is given, so an empty partition can't change a type."""
    return spark.read.schema(schema).parquet(path).where(condition).select(*columns)


def gated(rows: DataFrame, declared: DataFrame, keys: Sequence[str], content: Sequence[str]) -> DataFrame:
    """`rows` if their partitions are those that `declared` (a manifest) lists; else, or if it lists none, an error.

    The check is one small aggregate, run when the gate is passed.
    """
    problems = [f"{'/'.join(str(r[k]) for k in keys)} {r['problem']}" for r in manifest_violations(declared, manifest(rows, keys, content), keys).limit(5).collect()]
    if problems:
        raise ValueError(f"partitions do not match their manifest: {', '.join(problems)}")
    if declared.isEmpty():
        raise ValueError("no partition is selected")
    return rows


def finite_or_null(df: DataFrame) -> DataFrame:
    """NaN and infinities as NULL, and columns in the order of their names: what a JSON receipt may hold."""
    own = lambda f: F.when(~F.isnan(f.name) & (F.abs(f.name) < float("inf")), F.col(f.name)).alias(f.name) if isinstance(f.dataType, DoubleType | FloatType) else F.col(f.name)
    return df.select(*[own(f) for f in sorted(df.schema.fields, key=lambda f: f.name)])


def write_json(df: DataFrame, path: str) -> None:
    finite_or_null(df).write.option("ignoreNullFields", "false").json(path)


def number(text: Column | str) -> Column:
    """A number, or NULL where the text is none."""
    return (F.col(text) if isinstance(text, str) else text).try_cast("double")


def instant(text: Column | str) -> Column:
    """Microseconds since 1970 of a UTC time, or NULL where the text is none; the session's time zone must be UTC."""
    return F.unix_micros(F.try_to_timestamp(F.col(text) if isinstance(text, str) else text))
