"""Aggregates over questions: macro, micro, groups, abstention, hops and chains."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def macro_micro(metrics: DataFrame, by: tuple[str, ...] = ("run_id", "k")) -> DataFrame:
    """Per run and k: questions, mean recall, hits over claims, and the share of complete chains."""
    return metrics.groupBy(*by).agg(
        F.count("*").alias("questions"),
        F.avg("claim_recall").alias("macro_claim_recall"),
        F.try_divide(F.sum("claim_hits"), F.sum("claim_count")).alias("micro_claim_recall"),
        F.avg(F.col("complete").cast("int")).alias("complete_chain_rate"),
        F.avg("novel_claim_rank_score").alias("novel_claim_rank_score"),
    )


def report_macro(recalls: list[float], places: int = 4) -> float | None:
    """A mean as reports print it: each question's value is rounded first."""
    return round(sum(round(x, places) for x in recalls) / len(recalls), places) if recalls else None


def group_metrics(metrics: DataFrame, dimensions: tuple[str, ...], by: tuple[str, ...] = ("run_id", "k")) -> DataFrame:
    """macro_micro() for each value of each dimension, in one pass over grouping sets: dimension, value, and the metrics."""
    each = F.explode(F.array(*(F.struct(F.lit(d).alias("dimension"), F.col(d).cast("string").alias("value")) for d in dimensions)))
    return macro_micro(metrics.withColumn("__d", each).select("*", "__d.dimension", "__d.value"), (*by, "dimension", "value"))


def top_scores(asked: DataFrame, chunks: DataFrame) -> DataFrame:
    """asked with top_score: the first chunk's score, minus infinity for an empty list; null where the score is missing."""
    first = chunks.groupBy("run_id", "question_id").agg(F.min_by("score", "rank").alias("__score"), F.count("*").alias("__n"))
    got = asked.join(first, ["run_id", "question_id"], "left")
    return got.withColumn("top_score", F.when(F.col("__n").isNull(), F.lit(float("-inf"))).otherwise(F.col("__score").cast("double"))).withColumn("empty", F.col("__n").isNull()).drop("__score", "__n")


def mann_whitney(scores: DataFrame, by: tuple[str, ...] = ("run_id",), score: str = "top_score", positive: str = "positive") -> DataFrame:
    """auc per group: the chance that a positive's score is above a negative's, a tie counting half; null if a side is empty or a score missing.

    Scores are counted by value first, so the pairs of both sides are never formed.
    """
    counts = scores.groupBy(*by, score).agg(F.count_if(F.col(positive)).alias("p"), F.count_if(~F.col(positive)).alias("n"))
    below = F.coalesce(F.sum("n").over(W.partitionBy(*by).orderBy(F.col(score).asc_nulls_first()).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    each = counts.withColumn("__below", below)
    total = each.groupBy(*by).agg(
        F.sum(F.col("p") * (F.col("__below") + F.col("n") / 2)).alias("__u"),
        F.sum("p").alias("positives"),
        F.sum("n").alias("negatives"),
        F.count_if(F.col(score).isNull()).alias("__missing"),
    )
    auc = F.when(F.col("__missing") == 0, F.try_divide(F.col("__u"), F.col("positives") * F.col("negatives")))
    reason = F.when(F.col("__missing") > 0, "scores are missing").when(F.col("positives") * F.col("negatives") == 0, "a side is empty")
    return total.select(*by, auc.alias("auc"), "positives", "negatives", reason.alias("unavailable"))


def empty_response_rate(scores: DataFrame) -> DataFrame:
    """Per run: the share of unanswerable questions (not positive) without any chunk."""
    return scores.where("not positive").groupBy("run_id").agg(F.avg(F.col("empty").cast("int")).alias("unanswerable_empty_response_rate"))


def pass_rate(metrics: DataFrame) -> DataFrame:
    """Per run and k: the share of questions with complete evidence, for sanity questions."""
    return metrics.groupBy("run_id", "k").agg(F.avg(F.col("complete").cast("int")).alias("pass_rate"))


def path_status() -> Column:
    """How a chain question's path fared, from role counts and hits; null for questions without hops."""
    ends, bridge = F.col("endpoint_hits") == F.col("endpoint_count"), F.col("bridge_hits") == F.col("bridge_count")
    return (
        F.when((F.col("endpoint_count") + F.col("bridge_count")) == 0, None)
        .when(ends & bridge, "complete")
        .when(ends & ~bridge, "bridge_missing")
        .when(~ends & bridge, "endpoint_missing")
        .otherwise("multiple_missing")
    )


def hop_split(metrics: DataFrame) -> DataFrame:
    """metrics with path_status, endpoint and bridge recall, and bridge_only_miss."""
    got = metrics.withColumn("path_status", path_status())
    got = got.withColumn("endpoint_recall", F.try_divide("endpoint_hits", "endpoint_count")).withColumn("bridge_recall", F.try_divide("bridge_hits", "bridge_count"))
    return got.withColumn("bridge_only_miss", F.col("path_status") == "bridge_missing")


def multihop(hops: DataFrame, by: tuple[str, ...] = ("run_id", "k")) -> DataFrame:
    """Per run and k, of chain questions: their number, recalls by role, and the gap between these."""
    own = hops.where("path_status is not null")
    got = own.groupBy(*by).agg(
        F.count("*").alias("chain_questions"),
        F.try_divide(F.sum("endpoint_hits"), F.sum("endpoint_count")).alias("endpoint_claim_recall"),
        F.try_divide(F.sum("bridge_hits"), F.sum("bridge_count")).alias("bridge_claim_recall"),
        F.avg(F.col("bridge_only_miss").cast("int")).alias("bridge_only_miss_rate"),
    )
    return got.withColumn("recall_gap", F.col("endpoint_claim_recall") - F.col("bridge_claim_recall"))


def multihop_by_chain(hops: DataFrame) -> DataFrame:
    """multihop() for each chain_id, and once for all with a null chain_id, in one pass. hops: with chain_id."""
    named = hops.withColumn("chain_id", F.coalesce("chain_id", F.lit("")))
    each = named.withColumn("chain_id", F.explode(F.array(F.col("chain_id"), F.lit(None).cast("string"))))
    return multihop(each, ("run_id", "k", "chain_id"))


def histogram(df: DataFrame, column: str, by: tuple[str, ...] = ("run_id", "k")) -> DataFrame:
    return df.where(F.col(column).isNotNull()).groupBy(*by, column).agg(F.count("*").alias("questions"))


def two_level_macro(df: DataFrame, value: str, inner: str, by: tuple[str, ...]) -> DataFrame:
    """The mean of the means of each inner group, so that a chain's paraphrases don't count as independent."""
    inside = df.groupBy(*by, inner).agg(F.avg(value).alias("__v"))
    return inside.groupBy(*by).agg(F.avg("__v").alias(f"chain_macro_{value}"), F.count("*").alias("independent_chain_count"))


def errors_as_zero(asked: DataFrame, metrics: DataFrame, value: str) -> DataFrame:
    """asked with value, 0 for questions without metrics (request errors)."""
    return asked.join(metrics, ["run_id", "question_id"], "left").withColumn(value, F.coalesce(value, F.lit(0.0)))


def statuses(status: DataFrame) -> DataFrame:
    """Per run: counts by status, and request_success_rate."""
    counts = status.groupBy("run_id", "status").agg(F.count("*").alias("n"))
    own = W.partitionBy("run_id")
    ok = F.sum(F.when(F.col("status") == "ok", F.col("n")).otherwise(0)).over(own) / F.sum("n").over(own)
    return counts.withColumn("request_success_rate", ok)
