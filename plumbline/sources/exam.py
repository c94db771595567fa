"""Exams: nested JSON in, normalised tables out. Two schema versions are read."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions.text import document_key, normalize_exact

_EVIDENCE = "id STRING, source_document STRING, section STRING, accepted_spans ARRAY<STRING>"
_HOP = "STRUCT<chain_id STRING, relation_type STRING, endpoint_entities ARRAY<STRING>, endpoint_documents ARRAY<STRING>, bridge_documents ARRAY<STRING>, bridge_entities ARRAY<STRING>>"
PROTOCOL = "primary_k INT, eval_ks ARRAY<INT>, request_k INT, char_budgets ARRAY<INT>, primary_budget INT"
CONSTRAINTS = "min_claims_per_document INT, max_claim_share_per_document DOUBLE, min_low_lexical_overlap_questions INT, min_hard_negative_questions INT, min_spans_per_claim INT, max_span_normalized_len INT, min_sanity_questions INT, min_unanswerable_questions INT"
#: Schema 4.1; the fields of 3.0 and of the entity-bridge exams are beside them, null where absent.
SCHEMA = f"""schema_version STRING,
exam_meta STRUCT<exam_id STRING, title STRING, retrieval_protocol STRUCT<{PROTOCOL}>,
  question_counts STRUCT<total INT, scored INT, sanity INT, diagnostic INT, unanswerable INT, by_primary_type MAP<STRING, INT>, by_difficulty MAP<STRING, INT>>,
  clusters ARRAY<STRUCT<id STRING, family STRING, axis STRING, documents ARRAY<STRING>>>,
  bridge_chains ARRAY<STRUCT<id STRING, family STRING, relation_type STRING, bridge_entities ARRAY<STRING>, documents ARRAY<STRING>>>,
  design_constraints STRUCT<{CONSTRAINTS}>,
  entity_bridge_design STRUCT<benchmark_kind STRING, questions_per_chain INT, min_image_reference_questions INT, chains ARRAY<STRUCT<id STRING, relation_type STRING>>>,
  corpus STRUCT<snapshot_id STRING, relative_dir STRING, documents ARRAY<STRUCT<name STRING, sha256 STRING>>, image_assets ARRAY<STRUCT<name STRING, sha256 STRING, media_type STRING, width INT, height INT>>>>,
questions ARRAY<STRUCT<id STRING, question_role STRING, scored BOOLEAN, cluster_id STRING, chain_id STRING, relation_type STRING, difficulty STRING, primary_type STRING, tags ARRAY<STRING>,
  question STRING, reference_answer STRING, evidence_chain ARRAY<STRING>, expected_behavior STRING, diagnostic_reason STRING,
  endpoint_documents ARRAY<STRING>, bridge_documents ARRAY<STRING>, supporting_documents ARRAY<STRING>,
  claims ARRAY<STRUCT<id STRING, kind STRING, claim_type STRING, source_document STRING, section STRING, accepted_spans ARRAY<STRING>, hop_role STRING>>,
  negative_evidence ARRAY<STRUCT<{_EVIDENCE}>>, hop_design {_HOP}>>"""


@dataclass
class ExamTables:
    """The normalised tables of one exam."""

    exam: DataFrame
    questions: DataFrame
    claims: DataFrame
    spans: DataFrame
    negatives: DataFrame
    clusters: DataFrame
    chains: DataFrame
    documents: DataFrame
    protocol: DataFrame
    constraints: DataFrame
    counts: DataFrame


def read_exam(spark: SparkSession, path: str) -> ExamTables:
    return exam_tables(spark.read.schema(SCHEMA).json(path, multiLine=True))


def exam_tables(exam: DataFrame) -> ExamTables:
    """Tables of an exam read with SCHEMA. In schema 3.0, `scored` gives the role."""
    each = exam.select(F.posexplode("questions").alias("ord", "q"))
    role = F.coalesce("q.question_role", F.when(F.col("q.scored"), "scored").when(~F.col("q.scored"), "diagnostic"))
    questions = each.select("ord", F.col("q.id").alias("question_id"), role.alias("role"), "q.cluster_id", F.coalesce("q.hop_design.chain_id", "q.chain_id").alias("chain_id"), "q.relation_type", "q.difficulty", "q.primary_type", F.coalesce("q.tags", F.array().cast("array<string>")).alias("tags"), "q.question", "q.reference_answer", "q.evidence_chain", "q.hop_design", F.coalesce("q.endpoint_documents", "q.hop_design.endpoint_documents").alias("endpoint_documents"), F.coalesce("q.bridge_documents", "q.hop_design.bridge_documents").alias("bridge_documents"), "q.supporting_documents")
    claims = each.select(F.col("q.id").alias("question_id"), F.posexplode("q.claims").alias("claim_ord", "c"))
    claims = claims.select("question_id", F.col("c.id").alias("claim_id"), "claim_ord", F.coalesce("c.kind", F.lit("text")).alias("kind"), "c.claim_type", "c.hop_role", F.col("c.source_document").alias("document_name"), document_key("c.source_document").alias("document_key"), "c.section", "c.accepted_spans")
    spans = claims.select("question_id", "claim_id", "document_key", F.posexplode("accepted_spans").alias("span_index", "span")).withColumn("span_norm", normalize_exact("span"))
    negatives = each.select(F.col("q.id").alias("question_id"), F.explode("q.negative_evidence").alias("n"))
    negatives = negatives.select("question_id", F.col("n.id").alias("negative_id"), document_key("n.source_document").alias("document_key"), F.explode("n.accepted_spans").alias("span")).withColumn("span_norm", normalize_exact("span"))
    meta = F.col("exam_meta")
    return ExamTables(
        exam,
        questions,
        claims.drop("accepted_spans"),
        spans,
        negatives,
        exam.select(F.explode(meta["clusters"]).alias("c")).select(F.col("c.id").alias("cluster_id"), "c.family", "c.axis", "c.documents"),
        exam.select(F.explode(meta["bridge_chains"]).alias("c")).select(F.col("c.id").alias("chain_id"), "c.family", "c.relation_type", "c.bridge_entities", "c.documents"),
        exam.select(F.explode(meta["corpus"]["documents"]).alias("d")).select("d.name", "d.sha256", document_key("d.name").alias("document_key")),
        exam.select("exam_meta.retrieval_protocol.*"),
        exam.select("exam_meta.design_constraints.*"),
        exam.select("exam_meta.question_counts.*"),
    )


def resolved_protocol(given: dict, overrides: dict) -> tuple[dict, dict]:
    """(protocol, source of each field): a value given on the command line wins over the exam's."""
    merged = {k: overrides[k] if overrides.get(k) is not None else v for k, v in given.items()}
    return merged, {k: "cli_override" if overrides.get(k) is not None else "exam" for k in given}


class OptionError(ValueError):
    """Options that don't go together."""


def check_protocol(protocol: dict) -> None:
    """Raises OptionError for values that are not positive, repeated, or outside of the grid."""
    ks, budgets = protocol["eval_ks"], protocol.get("char_budgets") or []
    for name, values in (("eval_ks", ks), ("char_budgets", budgets)):
        if any(v <= 0 for v in values):
            raise OptionError(f"{name}: values must be positive")
        if len(set(values)) != len(values):
            raise OptionError(f"{name}: values repeat")
    if protocol["primary_k"] not in ks:
        raise OptionError("primary_k must be one of eval_ks")
    if budgets and protocol.get("primary_budget") not in budgets:
        raise OptionError("primary_budget must be one of char_budgets")
    if protocol["request_k"] < max(ks):
        raise OptionError("request_k is less than the largest of eval_ks")


def limited(questions: DataFrame, n: int) -> DataFrame:
    """The first n questions in the exam's order, for a smoke run; such a run can't be compared."""
    return questions.orderBy("ord").limit(n)



def check_options(profile: str, flat: bool, search_method: str | None = None, graph: bool = False, score_threshold: float | None = None) -> None:
    """Raises OptionError for options of the segments' family given to a flat backend, and for ones that exclude each other."""
    if flat and (search_method or graph or score_threshold is not None):
        raise OptionError(f"{profile} takes no search method, graph search or score threshold")
    if search_method == "coverage_search" and graph:
        raise OptionError("coverage_search can't be used with graph search")


def check_depth(protocol: dict, supports_top_k: bool) -> str | None:
    """A note for backends that can't be told how many chunks to return: recall beyond what they send can't be seen."""
    return None if supports_top_k else f"the backend decides how many chunks it returns; up to {protocol['request_k']} are read"
