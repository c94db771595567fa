"""Resampling and tests with draws from hashes, so that results don't depend on partitions.

Draw i of sample b is the first 15 hex digits of md5("seed:b:i"). Resampling is over clusters, whose
sums are formed first: a sample needs a cluster's sum and count, not its rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def draw(*parts: Column | int | str) -> Column:
    """A number below 2^60, the same for equal parts."""
    text = F.concat_ws(":", *(p.cast("string") if isinstance(p, Column) else F.lit(str(p)) for p in parts))
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("bigint")


def clusters(values: DataFrame, cluster: str, value: str, by: tuple[str, ...] = ()) -> DataFrame:
    """by, cluster, total and n of each cluster, with nth (from 0, by name) and clusters (their number)."""
    sums = values.groupBy(*by, cluster).agg(F.sum(value).alias("total"), F.count("*").alias("n"))
    own = W.partitionBy(*by) if by else W.partitionBy(F.lit(0))
    return sums.withColumn("nth", F.row_number().over(own.orderBy(cluster)) - 1).withColumn("clusters", F.count("*").over(own))


def cluster_bootstrap(values: DataFrame, cluster: str, value: str, by: tuple[str, ...] = (), samples: int = 200, seed: int = 7, level: float = 0.95) -> DataFrame:
    """by, low and high: the interval of the mean over the questions of resampled clusters; null with fewer than two clusters.

    The ends are the samples of rank floor and ceiling of the tails' shares.
    """
    sums = clusters(values, cluster, value, by)
    drawn = sums.select(*by, "clusters", "nth").withColumn("b", F.explode(F.sequence(F.lit(1), F.lit(samples))))
    drawn = drawn.withColumn("pick", F.pmod(draw(F.lit(seed), F.col("b"), F.col("nth")), F.col("clusters")))
    picked = drawn.select(*by, "b", F.col("pick").alias("nth")).join(sums.select(*by, "nth", "total", "n", "clusters"), [*by, "nth"])
    means = picked.groupBy(*by, "b").agg((F.sum("total") / F.sum("n")).alias("mean"), F.max("clusters").alias("clusters"))
    rank = F.row_number().over((W.partitionBy(*by) if by else W.partitionBy(F.lit(0))).orderBy("mean", "b"))
    tail = (1 - level) / 2
    low, high = int(tail * samples) + 1, samples - int(tail * samples)
    at = means.withColumn("r", rank)
    ends = at.groupBy(*by).agg(F.max(F.when(F.col("r") == low, F.col("mean"))).alias("low"), F.max(F.when(F.col("r") == high, F.col("mean"))).alias("high"), F.max("clusters").alias("clusters"))
    enough = F.col("clusters") > 1
    return ends.select(*by, F.when(enough, F.col("low")).alias("low"), F.when(enough, F.col("high")).alias("high"), "clusters")


def sign_flip(values: DataFrame, cluster: str, value: str, by: tuple[str, ...] = (), samples: int = 500, seed: int = 3) -> DataFrame:
    """by, delta and p: the two-sided chance of a mean difference as large when the signs of whole clusters are flipped; (1 + hits) / (1 + samples)."""
    sums = clusters(values, cluster, value, by)
    each = sums.withColumn("b", F.explode(F.sequence(F.lit(1), F.lit(samples))))
    flip = F.when(draw(F.lit(seed), F.col("b"), F.col("nth")) % 2 == 0, 1.0).otherwise(-1.0)
    stats = each.groupBy(*by, "b").agg(F.sum(flip * F.col("total")).alias("flipped"), F.sum("total").alias("seen"), F.sum("n").alias("n"))
    hit = F.abs("flipped") >= F.abs("seen") - 1e-9
    got = stats.groupBy(*by).agg(F.max(F.col("seen") / F.col("n")).alias("delta"), F.count_if(hit).alias("hits"), F.count("*").alias("samples"))
    return got.select(*by, "delta", ((F.col("hits") + 1) / (F.col("samples") + 1)).alias("p"))


def holm(ps: DataFrame, by: tuple[str, ...] = (), p: str = "p", order: tuple[str, ...] = ()) -> DataFrame:
    """ps with holm: Holm's step-down adjustment inside each group; a null p isn't counted."""
    own = W.partitionBy(*by) if by else W.partitionBy(F.lit(0))
    real = ps.where(F.col(p).isNotNull())
    ranked = own.orderBy(p, *order)
    raw = real.withColumn("__i", F.row_number().over(ranked)).withColumn("__m", F.count("*").over(own))
    raw = raw.withColumn("__raw", (F.col("__m") - F.col("__i") + 1) * F.col(p))
    so_far = F.max("__raw").over(ranked.rowsBetween(W.unboundedPreceding, 0))
    return raw.withColumn("holm", F.least(F.lit(1.0), so_far)).drop("__i", "__m", "__raw").unionByName(ps.where(F.col(p).isNull()).withColumn("holm", F.lit(None).cast("double")))
