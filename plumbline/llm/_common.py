"""Shared plumbing of the llm operators: tables, the shared folder, workers."""

from __future__ import annotations

import atexit
import contextlib
import gc
import os
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
_WRITTEN: list[tuple[SparkSession, str]] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows of an Arrow batch.
BATCH = 512


def ship(spark: SparkSession) -> None:
    """Lets Python workers import this package, and bounds their Arrow batches.

    Documents differ in length by four orders of magnitude, so that the default of 10,000 rows a batch isn't a bound on memory.
    The bound is the same for all operators, for a lazy DataFrame runs under what is set when it is computed; a lower one is kept.
    """
    env = spark.sparkContext.environment
    if _ROOT not in env.get("PYTHONPATH", "").split(":"):
        env["PYTHONPATH"] = ":".join(x for x in (_ROOT, env.get("PYTHONPATH", "")) if x)
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(name, "0") or 0)
    if not 0 < now <= BATCH:
        spark.conf.set(name, str(BATCH))


def gathered(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """The rows of batches in batches of about `rows`, for work in numpy on short rows."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        held.append(b)
        if sum(x.num_rows for x in held) >= rows:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
            held = []
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Where that is unset and Spark runs on this machine alone, one inside the warehouse; on a cluster that is an error, for the warehouse's default is a folder of one machine."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        at = spark.conf.get("spark.checkpoint.dir", None)
        if not at:
            if not sc.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            at = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_checkpoints"
        sc.setCheckpointDir(at)
    return sc.getCheckpointDir()


def written(df: DataFrame, name: str) -> DataFrame:
    """Writes df to the shared folder and reads it again: cuts the lineage, and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _WRITTEN.append((spark, path))
    out = spark.read.schema(df.schema).parquet(path)
    out._written_at = path  # for forget()
    return out


def forget(*tables: DataFrame) -> None:
    """Removes tables that written() returned, once nothing reads them any more."""
    for df in tables:
        if path := df.__dict__.get("_written_at"):
            _remove(df.sparkSession, path)


def settled(spark: SparkSession) -> None:
    """Lets Spark remove the shuffle files of DataFrames that are no longer used; else they stay until the driver happens to collect its garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def _remove(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


@atexit.register
def _sweep() -> None:
    """Removes what written() left, if Spark still runs then."""
    for spark, path in _WRITTEN:
        with contextlib.suppress(Exception):  # a session that has ended
            _remove(spark, path)


def text_of(df: DataFrame, name: str = "text") -> Column:
    """The text, null as empty."""
    return F.coalesce(df[name], F.lit(""))


def hex64(c: Column) -> Column:
    """A long as 16 lowercase hex digits."""
    return F.lpad(F.lower(F.hex(c)), 16, "0")
