"""Comparison of runs: gates first, then paired differences with cluster inference."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.operators.statistics import cluster_bootstrap, holm, sign_flip

#: Fields of runs that must be equal for runs to be compared.
FIELDS = ("exam_sha256", "corpus", "retrieval_protocol", "question_order", "metrics_version")


class ComparisonError(ValueError):
    """Runs that mustn't be compared."""


def blockers(runs: DataFrame) -> DataFrame:
    """run_id and blockers: why a run isn't eligible for comparison; empty if it is."""
    given = lambda c, else_: F.coalesce(F.col(c), F.lit(else_)) if c in runs.columns else F.lit(else_)  # noqa: E731  optional columns
    why = {
        "run_not_completed": F.col("run_status") != "completed",
        "run_scope_not_full": F.col("run_scope") != "full",
        "dataset_revision_unverified": given("dataset_revision", "unverified") == "unverified",
        "git_dirty": given("git_dirty", False),
        "unmatched_document_names": given("unmatched", 0) > 0,
        "corpus_drift": given("corpus_drift", False),
    }
    return runs.select("run_id", F.array_compact(F.array(*(F.when(c, name) for name, c in why.items()))).alias("blockers"))


def mismatched(runs: DataFrame, fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """field and values of the fields in which runs differ."""
    present = [f for f in fields if f in runs.columns]
    each = runs.select(F.explode(F.array(*(F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("value")) for f in present))).alias("x")).select("x.*")
    return each.groupBy("field").agg(F.count_distinct(F.coalesce("value", F.lit("\x00"))).alias("n"), F.sort_array(F.collect_set("value")).alias("values")).where("n > 1").drop("n")


def config_conflicts(runs: DataFrame) -> DataFrame:
    """Profiles of which runs have different request configurations."""
    return runs.groupBy("profile").agg(F.count_distinct("request_config").alias("configs")).where("configs > 1")


#: Fields that are noted, but don't keep runs from being compared.
AUDITED = ("evaluator_sha256",)


def notes(runs: DataFrame) -> dict:
    """What a report on compared runs must say: profiles of which runs have different configurations, whether profiles and configurations differ at all, and audited fields that differ. Runs are few: one row for each."""
    conflict = [r["profile"] for r in config_conflicts(runs).orderBy("profile").collect()]
    one = runs.agg(F.count_distinct("profile").alias("p"), F.count_distinct("request_config").alias("c")).first()
    audit = [r["field"] for r in mismatched(runs, AUDITED).orderBy("field").collect()] if set(AUDITED) & set(runs.columns) else []
    return {"same_profile_config_conflict": conflict, "backend_profiles_differ": one["p"] > 1, "request_config_differs": one["c"] > 1, "evaluator_notes": audit}


def gate(runs: DataFrame, allow_config_diff: bool = False) -> None:
    """Raises ComparisonError unless the runs may be compared. Runs are few: one row for each."""
    bad = blockers(runs).where("size(blockers) > 0").orderBy("run_id").collect()
    if bad:
        raise ComparisonError("; ".join(f"{r['run_id']}: {', '.join(r['blockers'])}" for r in bad))
    differ = [r["field"] for r in mismatched(runs).orderBy("field").collect()]
    if differ:
        raise ComparisonError(f"fields differ: {', '.join(differ)}")
    if not allow_config_diff and (same := [r["profile"] for r in config_conflicts(runs).orderBy("profile").collect()]):
        raise ComparisonError(f"one profile with different configurations: {', '.join(same)}")


def paired(results: DataFrame) -> DataFrame:
    """results (run_id, question_id, status, ...) of the questions that are ok in every run."""
    bad = results.where("status <> 'ok'").select("question_id").distinct()
    return results.join(bad, "question_id", "left_anti")


def excluded(results: DataFrame) -> DataFrame:
    """question_id of those that failed in some run: left out, not counted as 0."""
    return results.where("status <> 'ok'").select("question_id").distinct()


def deltas(values: DataFrame, value: str = "value", keys: tuple[str, ...] = ("metric",)) -> DataFrame:
    """keys, question_id, cluster_id, left_run, right_run, delta (right minus left) for each pair of runs. values: keys, run_id, question_id, cluster_id, value."""
    left = values.select(*keys, "question_id", "cluster_id", F.col("run_id").alias("left_run"), F.col(value).alias("__l"))
    right = values.select(*keys, "question_id", F.col("run_id").alias("right_run"), F.col(value).alias("__r"))
    return left.join(right, [*keys, "question_id"]).where("left_run < right_run").withColumn("delta", F.col("__r") - F.col("__l")).drop("__l", "__r")


def run_means(values: DataFrame, value: str = "value", keys: tuple[str, ...] = ("metric",)) -> DataFrame:
    return values.groupBy(*keys, "run_id").agg(F.avg(value).alias("run_mean"), F.count("*").alias("questions"))


def compared(values: DataFrame, samples: int = 200, seed: int = 7, keys: tuple[str, ...] = ("metric",)) -> DataFrame:
    """Per metric and pair of runs: mean difference, interval, p, and p adjusted by Holm among the pairs of a metric."""
    each = deltas(values, keys=keys)
    by = (*keys, "left_run", "right_run")
    got = sign_flip(each, "cluster_id", "delta", by, samples, seed).join(cluster_bootstrap(each, "cluster_id", "delta", by, samples, seed), list(by))
    return holm(got, keys, "p", ("left_run", "right_run"))


def same_order(questions: DataFrame) -> DataFrame:
    """run_id and order_hash: equal for runs that asked the same questions in the same order (run_id, ord, question_id)."""
    listed = F.array_sort(F.collect_list(F.struct("ord", "question_id")))
    return questions.groupBy("run_id").agg(F.sha2(F.concat_ws("\n", F.transform(listed, lambda x: x["question_id"])), 256).alias("order_hash"))
