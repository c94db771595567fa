"""Runs' results: tables partitioned by run, and the JSON and Markdown files of a report."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions.text import python_round

#: The headline metrics and their labels in reports.
HEADLINE = {
    "macro_claim_recall": "query macro claim recall",
    "complete_chain_rate": "complete evidence chain rate",
    "budget_claim_recall": "claim recall within the character budget",
    "bridge_claim_recall": "bridge claim recall",
    "abstention_auc": "abstention AUC",
}


def write_results(results: DataFrame, path: str) -> None:
    """Per-question results (run_id, question_id, ...) as Parquet, one folder for each run."""
    results.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run_id").parquet(path)


def read_results(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def read_payloads(spark: SparkSession, paths: list[str], schema: str) -> DataFrame:
    """Results of runs that were stored as JSON, a file for each run: all runs in one table."""
    return spark.read.schema(schema).json(paths, multiLine=True).withColumn("path", F.input_file_name())


def truncated(chunks: DataFrame, limit: int) -> DataFrame:
    """chunks with their content cut for storage; scoring uses the whole."""
    return chunks.withColumn("content", F.left("content", F.lit(limit)))


def export(df: DataFrame, path: str) -> None:
    """A small table (a summary, a manifest) as JSON lines in one file."""
    df.coalesce(1).write.mode("overwrite").json(path)


def summary(headline: dict[str, float | None], run_status: str, blockers: list[str]) -> dict:
    """The summary of a run; an aborted run has no headline."""
    done = run_status == "completed"
    return {"run_status": run_status, "headline": {k: python_round(headline.get(k)) for k in HEADLINE} if done else None, "comparison_eligible": done and not blockers, "comparison_blockers": blockers}


def report(summary_: dict, manifest: dict, multihop: list[dict] | None = None) -> str:
    """The Markdown report of a run. multihop: rows of multihop_by_chain(), the one of all chains without chain_id."""
    lines = [f"# Run {manifest.get('run_id', '')}", "", f"- status: {summary_['run_status']}", f"- exam: {manifest.get('exam_sha256', '')}", ""]
    if summary_["headline"] is None:
        lines += ["No headline: the run was aborted.", ""]
    else:
        lines += ["| metric | value |", "|-|-|", *(f"| {label} | {'n/a' if summary_['headline'][k] is None else summary_['headline'][k]} |" for k, label in HEADLINE.items()), ""]
    if multihop:
        shown = lambda v: "n/a" if v is None else python_round(v)
        lines += ["## Questions over several documents", "", "| chain | questions | endpoint recall | bridge recall | bridge missed alone |", "|-|-|-|-|-|"]
        lines += [f"| {r['chain_id'] or 'all'} | {r['chain_questions']} | {shown(r['endpoint_claim_recall'])} | {shown(r['bridge_claim_recall'])} | {shown(r['bridge_only_miss_rate'])} |" for r in multihop] + [""]
    if summary_["comparison_blockers"]:
        lines += ["Not eligible for comparison: " + ", ".join(summary_["comparison_blockers"]), ""]
    lines += ["Image references are matched as path strings; images aren't looked at.", ""]
    return "\n".join(lines)


def comparison_report(pairs: list[dict], excluded: list[str], notes: dict | None = None) -> str:
    """The Markdown report of a comparison. pairs: rows of compared(); notes: from comparing.notes()."""
    lines = ["# Comparison", "", "| metric | left | right | difference | interval | p | p (Holm) |", "|-|-|-|-|-|-|-|"]
    shown = lambda v: "n/a" if v is None else python_round(v)
    lines += [f"| {r['metric']} | {r['left_run']} | {r['right_run']} | {shown(r['delta'])} | {shown(r['low'])} to {shown(r['high'])} | {shown(r['p'])} | {shown(r['holm'])} |" for r in pairs]
    lines += ["", f"Questions left out because a run failed on them: {', '.join(excluded) or 'none'}.", "Inference is over clusters; recall within a character budget doesn't depend on how a product cuts its chunks.", ""]
    notes = notes or {}
    if same := notes.get("same_profile_config_conflict"):
        lines += [f"Retrieval was configured differently in runs of one product ({', '.join(same)}): differences may come from the configuration.", ""]
    if notes.get("backend_profiles_differ"):
        lines += ["Runs of different products are compared: requests differ by nature, and budget_claim_recall is the fairest of the metrics, for chunks are cut differently.", ""]
    if audit := notes.get("evaluator_notes"):
        lines += [f"Runs were scored by different revisions of the evaluator ({', '.join(audit)}), with the same metrics' version.", ""]
    return "\n".join(lines)


def output_root(given: str | None, profile: str, base: str) -> str:
    """The folder of a run's results: the given one, or the base's name with the profile's."""
    return given or f"{base}-{profile}"


def manifest_json(manifest: dict) -> str:
    """A manifest without anything that looks like a credential."""
    clean = {k: v for k, v in manifest.items() if not any(x in k.lower() for x in ("cookie", "authorization", "api_key", "secret", "xsrf"))}
    return json.dumps(clean, ensure_ascii=False, indent=2, sort_keys=True)
