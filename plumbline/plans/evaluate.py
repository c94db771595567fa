"""The three ways through the library: validate an exam, evaluate captured responses, compare runs."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions.text import normalize_exact, rounded
from plumbline.operators import aggregates, bridge, comparing, matching, validation
from plumbline.sources import backends, corpus, runs
from plumbline.sources.exam import ExamTables, check_protocol, read_exam, resolved_protocol


class ExamValidationError(ValueError):
    """An exam with violations."""


class DocumentNameMismatch(ValueError):
    """No returned document is declared by the exam: all scores would be zero without a word."""


@dataclass
class Evaluation:
    """The tables of an evaluation of one or more runs."""

    chunks: DataFrame
    detail: DataFrame
    metrics: DataFrame
    budgets: DataFrame
    questions: DataFrame
    headline: DataFrame
    unmatched: DataFrame
    statuses: DataFrame
    groups: DataFrame
    multihop: DataFrame
    bridges: DataFrame
    bridge_headline: DataFrame
    protocol: dict
    protocol_source: dict


def validated(spark: SparkSession, exam_path: str, corpus_dir: str, allow_corpus_drift: bool = False) -> tuple[ExamTables, dict]:
    """(tables, facts) of a valid exam; raises ExamValidationError with the first violations of another."""
    t, docs = read_exam(spark, exam_path), corpus.read_files(spark, corpus_dir)
    declared = t.exam.select(F.size("exam_meta.corpus.image_assets").alias("n")).first()["n"]
    images = corpus.read_images(spark, corpus_dir) if declared and declared > 0 else None
    bad = validation.violations(t, docs, allow_corpus_drift, images).orderBy("rule", "subject").limit(20).collect()
    if bad:
        raise ExamValidationError("; ".join(f"{r['rule']}: {r['subject']} {r['detail']}".strip() for r in bad))
    return t, validation.facts(t, docs).first().asDict()


def evaluated(
    t: ExamTables,
    responses: DataFrame,
    profile: backends.Profile,
    overrides: dict | None = None,
    aliases: DataFrame | None = None,
    check_names: bool = True,
) -> Evaluation:
    """Scores captured responses (run_id, question_id, status, body) of any number of runs in one plan.

    Metrics are over questions whose request was answered and whose response isn't a fault; the others
    are in statuses, and left out of comparisons. Headline means are of each question's rounded value.
    Questions without a cluster are clustered by their chain, and without one stand alone. Bridge
    metrics are of questions that declare documents by role; there a failed request counts as 0.
    """
    protocol, source = resolved_protocol(t.protocol.first().asDict(), overrides or {})
    check_protocol(protocol)
    k, budget = protocol["primary_k"], protocol["primary_budget"]
    responses = backends.checked(responses, profile)
    answered = responses.where("status = 'ok'")
    chunks = backends.parsed(answered, profile)
    if aliases is not None:
        chunks = matching.aliased(chunks, aliases)
    if check_names and not chunks.isEmpty() and not matching.names_match(chunks, t.documents):
        raise DocumentNameMismatch(", ".join(r[0] for r in chunks.select("document_name").distinct().orderBy("document_name").limit(10).collect()))
    norm = normalize_exact("content")
    chunks = chunks.withColumn("content_norm", norm).withColumn("norm_len", F.length("content_norm"))
    asked = answered.select("run_id", "question_id").join(t.claims.select("question_id").distinct(), "question_id", "left_semi").select("run_id", "question_id")
    spans = t.spans.select("question_id", "claim_id", "document_key", "span_index", "span_norm")
    claims = t.claims.select("question_id", "claim_id", "claim_ord", "claim_type", "kind", "hop_role", "document_key")
    detail = matching.claim_detail(asked, claims, matching.first_hits(chunks, spans))
    metrics = aggregates.hop_split(matching.question_metrics(detail, protocol["eval_ks"]))
    budgets = matching.budget_recall(asked, chunks, claims, spans, protocol["char_budgets"])
    about = t.questions.select("question_id", "ord", "role", F.coalesce("cluster_id", "chain_id", "question_id").alias("cluster_id"), "chain_id", "difficulty", "primary_type", "tags")
    asked_all = responses.select("run_id", "question_id", "status").join(about, "question_id")
    at_k = metrics.where(F.col("k") == k).select("run_id", "question_id", "claim_hits", "claim_count", "claim_recall", "complete", "novel_claim_rank_score", "path_status", "bridge_only_miss", "endpoint_hits", "endpoint_count", "bridge_hits", "bridge_count")
    spent = budgets.where(F.col("budget") == budget).select("run_id", "question_id", F.col("claim_recall").alias("budget_claim_recall"))
    both = ["run_id", "question_id"]
    questions = asked_all.join(at_k, both, "left").join(spent, both, "left")
    questions = questions.join(matching.intrusion(asked, chunks, t.negatives.select("question_id", "document_key", "span_norm"), k), both, "left")
    targets = t.claims.select("question_id", "document_key")
    questions = questions.join(matching.ground_truth_documents(targets), "question_id", "left")
    questions = questions.join(matching.off_target(chunks, targets, k).select(*both, "off_target_chunk_rate"), both, "left").join(matching.duplicate_documents(chunks, k).select(*both, "duplicate_document_rate"), both, "left")

    scored = questions.where("role = 'scored' and status = 'ok'")
    main = scored.groupBy("run_id").agg(
        F.count("*").alias("questions"),
        F.avg(rounded(F.col("claim_recall"))).alias("macro_claim_recall"),
        F.try_divide(F.sum("claim_hits"), F.sum("claim_count")).alias("micro_claim_recall"),
        F.avg(F.col("complete").cast("int")).alias("complete_chain_rate"),
        F.avg(rounded(F.col("budget_claim_recall"))).alias("budget_claim_recall"),
        F.try_divide(F.sum("bridge_hits"), F.sum("bridge_count")).alias("bridge_claim_recall"),
        F.try_divide(F.sum("endpoint_hits"), F.sum("endpoint_count")).alias("endpoint_claim_recall"),
        F.avg(F.col("hard_negative_intrusion").cast("int")).alias("hard_negative_intrusion_rate"),
    )
    sanity = questions.where("role = 'sanity' and status = 'ok'").groupBy("run_id").agg(F.avg(F.col("complete").cast("int")).alias("sanity_pass_rate"))
    sides = questions.where("role in ('scored', 'unanswerable') and status = 'ok'").select(*both, (F.col("role") == "scored").alias("positive"))
    scores = aggregates.top_scores(sides, chunks)
    auc = aggregates.mann_whitney(scores).select("run_id", F.col("auc").alias("abstention_auc"), F.col("unavailable").alias("abstention_unavailable"))
    empty = aggregates.empty_response_rate(scores)
    headline = responses.select("run_id").distinct()
    for part in (main, sanity, auc, empty):
        headline = headline.join(part, "run_id", "left")
    unmatched = matching.unmatched_documents(chunks, t.documents)
    of_scored = metrics.join(about.where("role = 'scored'").select("question_id", "chain_id", "difficulty", "primary_type"), "question_id")
    groups = aggregates.group_metrics(of_scored, ("difficulty", "primary_type", "claim_count"))
    multihop = aggregates.multihop_by_chain(of_scored)
    roles = t.questions.where("bridge_documents is not null").select("question_id", *(f"{r}_documents" for r in bridge.ROLES))
    hit = F.coalesce(F.col("first_rank") <= k, F.lit(False)).alias("hit")
    named = detail.select(*both, "claim_id", "kind", "document_key", hit)
    bridges = bridge.bridge_metrics(named, roles, chunks.where(F.col("rank") <= k).select(*both, "document_key"))
    asked_roles = asked_all.where("role = 'scored'").join(roles.select("question_id"), "question_id", "left_semi")
    values = ("endpoint_text_claim_recall", "bridge_text_claim_recall", "complete_core_bridge_chain", "complete_declared_text_chain")
    by_question = bridge.question_macro(asked_roles, bridges, values)
    by_chain = bridge.chain_macro(asked_roles, bridges, values).select("run_id", "independent_chain_count", *(F.col(v).alias(f"chain_macro_{v}") for v in values))
    return Evaluation(chunks, detail, metrics, budgets, questions, headline, unmatched, aggregates.statuses(questions), groups, multihop, bridges, by_question.join(by_chain, "run_id", "left"), protocol, source)


def write_evaluation(e: Evaluation, manifest: DataFrame, out: str) -> None:
    """The tables of an evaluation under out, results by run, and a report for each run.

    manifest: run_id, exam_sha256, run_status, run_scope, dataset_revision, ...; a row for each run.
    """
    runs.write_results(e.questions.drop("tags"), f"{out}/results")
    runs.export(e.headline, f"{out}/summary")
    runs.export(manifest, f"{out}/manifest")
    for name, df in (("groups", e.groups), ("multihop", e.multihop), ("bridge", e.bridge_headline)):
        runs.export(df, f"{out}/{name}")
    hops = e.multihop.where(F.col("k") == e.protocol["primary_k"]).orderBy(F.col("chain_id").isNotNull(), "chain_id").collect()  # a row for each run and chain
    why = {r["run_id"]: r["blockers"] for r in comparing.blockers(manifest).collect()}
    rows = {r["run_id"]: r.asDict() for r in e.headline.collect()}  # a row for each run
    reports = [(m["run_id"], runs.report(runs.summary(rows.get(m["run_id"], {}), m["run_status"], why[m["run_id"]]), m.asDict(), [h.asDict() for h in hops if h["run_id"] == m["run_id"]])) for m in manifest.collect()]
    manifest.sparkSession.createDataFrame(reports, "run_id string, value string").write.mode("overwrite").partitionBy("run_id").text(f"{out}/report")


def compared_runs(questions: DataFrame, manifest: DataFrame, allow_config_diff: bool = False, samples: int = 1000, seed: int = 7) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(pairs, ranking, excluded) of runs' per-question results (those of evaluated()); raises ComparisonError where they mustn't be compared."""
    orders = comparing.same_order(questions.select("run_id", "ord", "question_id")).withColumnRenamed("order_hash", "question_order")
    comparing.gate(manifest.join(orders, "run_id"), allow_config_diff)
    scored = questions.where("role = 'scored'")
    fair = comparing.paired(scored)
    named = ("claim_recall", "complete", "budget_claim_recall", "novel_claim_rank_score")
    each = F.explode(F.array(*(F.struct(F.lit(n).alias("metric"), F.col(n).cast("double").alias("value")) for n in named))).alias("x")
    values = fair.select("run_id", "question_id", "cluster_id", each).select("run_id", "question_id", "cluster_id", "x.*").where("value is not null")
    ranking = comparing.run_means(values).orderBy("metric", F.desc("run_mean"), "run_id")
    return comparing.compared(values, samples, seed), ranking, comparing.excluded(scored)
