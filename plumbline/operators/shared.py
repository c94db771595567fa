"""The shared folder and the Python workers of the operators that need them."""

from __future__ import annotations

import atexit
import contextlib
import os
import uuid

from pyspark.sql import DataFrame, SparkSession

_ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
_WRITTEN: list[tuple[SparkSession, str]] = []

#: Rows of an Arrow batch. Texts differ in length by four orders of magnitude, so that Spark's 10,000 aren't a bound on memory.
BATCH = 512


def ship(spark: SparkSession) -> None:
    """Lets Python workers import this package, and bounds their Arrow batches; a lower bound is kept."""
    env = spark.sparkContext.environment
    if _ROOT not in env.get("PYTHONPATH", "").split(":"):
        env["PYTHONPATH"] = ":".join(x for x in (_ROOT, env.get("PYTHONPATH", "")) if x)
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(name, "0") or 0)
    if not 0 < now <= BATCH:
        spark.conf.set(name, str(BATCH))


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
    """Writes df to the shared folder and reads it again: it is computed once, its size is known to the plans that join it, and it survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _WRITTEN.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


@atexit.register
def _sweep() -> None:
    """Removes what written() left, if Spark still runs then."""
    for spark, path in _WRITTEN:
        with contextlib.suppress(Exception):  # a session that has ended
            at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
