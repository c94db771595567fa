"""Summaries that follow a growing folder of result files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def running_summary(spark: SparkSession, path: str, schema: str, name: str, checkpoint: str) -> StreamingQuery:
    """A streaming query over Parquet results (run_id, k, claim_hits, claim_count, claim_recall, complete) that keeps macro and micro recall per run and k in a table in memory."""
    stream = spark.readStream.schema(schema).parquet(path)
    got = stream.groupBy("run_id", "k").agg(F.count("*").alias("questions"), F.avg("claim_recall").alias("macro_claim_recall"), (F.sum("claim_hits") / F.sum("claim_count")).alias("micro_claim_recall"), F.avg(F.col("complete").cast("int")).alias("complete_chain_rate"))
    return got.writeStream.outputMode("complete").format("memory").queryName(name).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def each_batch(results: DataFrame, sink: str, checkpoint: str) -> StreamingQuery:
    """Appends streamed results to a table of runs, exactly once by batch."""

    def put(df: DataFrame, epoch: int) -> None:
        df.withColumn("epoch", F.lit(epoch)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("epoch").parquet(sink)

    return results.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
