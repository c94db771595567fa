"""Entity-bridge metrics: recall by the declared role of a claim's document, images apart from text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.text import document_key

ROLES = ("endpoint", "bridge", "supporting")


def roles(questions: DataFrame) -> DataFrame:
    """question_id, document_key, role of the documents that questions declare."""
    each = F.array(*(F.struct(F.lit(r).alias("role"), F.coalesce(f"{r}_documents", F.array().cast("array<string>")).alias("names")) for r in ROLES))
    got = questions.select("question_id", F.explode(each).alias("x")).select("question_id", "x.role", F.explode("x.names").alias("name"))
    return got.select("question_id", "role", document_key("name").alias("document_key")).distinct()


def bridge_metrics(detail: DataFrame, questions: DataFrame, retrieved: DataFrame) -> DataFrame:
    """Per run, question: recalls by role, completeness, document recalls and path_status.

    detail: run_id, question_id, claim_id, kind, document_key, hit. retrieved: run_id, question_id,
    document_key of the chunks in the window. Text metrics are null where no text claim has the role.
    """
    own = roles(questions)
    claims = detail.join(own, ["question_id", "document_key"], "left")
    text, image = F.col("kind") == "text", F.col("kind") == "asset"
    count = lambda cond, name: F.count_if(cond).alias(name)
    per = claims.groupBy("run_id", "question_id").agg(
        *(x for r in ROLES for x in (count(text & (F.col("role") == r), f"{r}_n"), count(text & (F.col("role") == r) & F.col("hit"), f"{r}_h"))),
        count(image, "image_n"),
        count(image & F.col("hit"), "image_h"),
    )
    seen = detail.select("run_id", "question_id").distinct().join(own, "question_id").join(retrieved.select("run_id", "question_id", "document_key").distinct().withColumn("__got", F.lit(1)), ["run_id", "question_id", "document_key"], "left")
    docs = seen.groupBy("run_id", "question_id").agg(*(x for r in ROLES for x in (count(F.col("role") == r, f"{r}_docs"), count((F.col("role") == r) & F.col("__got").isNotNull(), f"{r}_got"))))
    got = per.join(docs, ["run_id", "question_id"], "left")
    full = lambda r: F.when(F.col(f"{r}_n") > 0, F.col(f"{r}_h") == F.col(f"{r}_n"))
    core = F.when((F.col("endpoint_n") > 0) & (F.col("bridge_n") > 0), full("endpoint") & full("bridge"))
    ends = F.col("endpoint_got") == F.col("endpoint_docs")
    return got.select(
        "run_id",
        "question_id",
        *(F.try_divide(f"{r}_h", f"{r}_n").alias(f"{r}_text_claim_recall") for r in ROLES),
        core.alias("complete_core_bridge_chain"),
        F.when(core.isNotNull(), core & F.coalesce(full("supporting"), F.lit(True))).alias("complete_declared_text_chain"),
        F.try_divide("endpoint_got", "endpoint_docs").alias("endpoint_document_recall"),
        F.try_divide("bridge_got", "bridge_docs").alias("bridge_document_recall"),
        (ends & (F.col("bridge_got") < F.col("bridge_docs"))).alias("bridge_only_document_miss"),
        F.try_divide("image_h", "image_n").alias("image_reference_claim_recall"),
        F.when(F.col("image_n") > 0, F.col("image_h") == F.col("image_n")).alias("complete_image_reference_chain"),
        _status(full).alias("path_status"),
    )


def _status(full) -> Column:  # noqa: ANN001
    lacks = [~F.coalesce(full(r), F.lit(True)) for r in ROLES]
    n = sum((c.cast("int") for c in lacks), F.lit(0))
    no_text = sum((F.col(f"{r}_n") for r in ROLES), F.lit(0)) == 0
    out = F.when(no_text & (F.col("image_n") > 0), F.when(F.col("image_h") == F.col("image_n"), "image_reference_complete").otherwise("image_reference_missing"))
    out = out.when(n == 0, "complete").when(n > 1, "multiple_missing")
    for r, c in zip(ROLES, lacks, strict=True):
        out = out.when(c, f"{r}_missing")
    return out


def question_macro(asked: DataFrame, metrics: DataFrame, values: tuple[str, ...]) -> DataFrame:
    """Means over questions (run_id, question_id, status); a failed request counts as 0 where the metric would apply."""
    got = asked.join(metrics, ["run_id", "question_id"], "left")
    failed = F.col("status") != "ok"
    return got.groupBy("run_id").agg(*(F.avg(F.when(failed, 0.0).otherwise(F.col(v).cast("double"))).alias(v) for v in values))


def chain_macro(asked: DataFrame, metrics: DataFrame, values: tuple[str, ...]) -> DataFrame:
    """Means of chains' means, and independent_chain_count. asked has chain_id and status."""
    got = asked.join(metrics, ["run_id", "question_id"], "left")
    failed = F.col("status") != "ok"
    inner = got.groupBy("run_id", "chain_id").agg(*(F.avg(F.when(failed, 0.0).otherwise(F.col(v).cast("double"))).alias(v) for v in values))
    return inner.groupBy("run_id").agg(*(F.avg(v).alias(v) for v in values), F.count("*").alias("independent_chain_count"))


def status_counts(asked: DataFrame, metrics: DataFrame) -> DataFrame:
    """path_status of ok questions, and the status itself of the others."""
    got = asked.join(metrics, ["run_id", "question_id"], "left")
    what = F.when(F.col("status") == "ok", F.col("path_status")).otherwise(F.col("status"))
    return got.groupBy("run_id", what.alias("path_status")).agg(F.count("*").alias("questions"))


def negatives_per_chain(questions: DataFrame, negatives: DataFrame) -> DataFrame:
    return questions.join(negatives, "question_id").groupBy("chain_id").agg(F.count_distinct("question_id").alias("hard_negative_questions"))
