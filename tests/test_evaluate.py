"""From captured responses to reports and comparisons, with answers made up for a fixture exam."""

import hashlib
import json

import exam_fixture as X
import pytest
from plumbline import __main__ as cli
from plumbline.operators.comparing import ComparisonError
from plumbline.plans import evaluate
from plumbline.sources import backends
from plumbline.sources import exam as E
from pyspark.sql import functions as F


def body(*records):
    return json.dumps({"records": [{"score": s, "segment": {"id": f"c{i}", "document_id": d, "content": t, "document": {"name": d}}} for i, (d, t, s) in enumerate(records)]})


def perfect(q):
    return body(*((c["source_document"], X.CORPUS[c["source_document"]], 0.9 - i / 10) for i, c in enumerate(q["claims"])))


def no_bridge(q):
    return body(*((c["source_document"], X.CORPUS[c["source_document"]], 0.9) for c in q["claims"] if c.get("hop_role") != "bridge"))


def noisy(q):
    return body(("other.md", "nothing of use", 0.8), *((c["source_document"], "too little", 0.5) for c in q["claims"]))


@pytest.fixture(scope="module")
def at(tmp_path_factory):
    root = tmp_path_factory.mktemp("eval")
    X.write_corpus(root / "corpus")
    X.write_json(root / "exam.json", X.exam())
    return root


@pytest.fixture(scope="module")
def tables(spark, at):
    return evaluate.validated(spark, f"{at}/exam.json", f"{at}/corpus")[0]


def responses(spark, runs, failed=()):
    rows = [(r, q["id"], "request_error" if (r, q["id"]) in failed else "ok", answer(q)) for r, answer in runs.items() for q in X.exam()["questions"]]
    return spark.createDataFrame(rows, "run_id string, question_id string, status string, body string")


def manifest(spark, *run_ids, **change):
    base = {"profile": "segments-api", "exam_sha256": "x", "request_config": "{}", "run_status": "completed", "run_scope": "full", "dataset_revision": "1", "git_dirty": False} | change
    return spark.createDataFrame([tuple(({"run_id": r} | base).values()) for r in run_ids], cli.MANIFEST)


def test_runs_side_by_side(spark, tables):
    e = evaluate.evaluated(tables, responses(spark, {"a": perfect, "b": no_bridge, "c": noisy}), backends.load_profile("segments-api"))
    h = {r.run_id: r for r in e.headline.collect()}
    a, b, c = h["a"], h["b"], h["c"]
    assert (a.macro_claim_recall, a.complete_chain_rate, a.bridge_claim_recall, a.sanity_pass_rate, a.abstention_auc, a.unanswerable_empty_response_rate) == (1.0, 1.0, 1.0, 1.0, 1.0, 1.0)
    assert (b.bridge_claim_recall, b.endpoint_claim_recall, b.macro_claim_recall) == (0.0, 1.0, 0.875)
    assert (c.macro_claim_recall, c.sanity_pass_rate, c.abstention_auc) == (0.0, 0.0, 0.5)
    assert {(r.run_id, r.document_key) for r in e.unmatched.collect()} == {("c", "other")}
    paths = {r.run_id: r.path_status for r in e.questions.where("question_id = 'hop'").collect()}
    assert paths == {"a": "complete", "b": "bridge_missing", "c": "multiple_missing"}
    assert e.questions.where("run_id = 'a' and question_id = 'both'").first().hard_negative_intrusion  # whole documents come back, the negative's too


def test_groups_hops_and_bridges(spark, tables):
    e = evaluate.evaluated(tables, responses(spark, {"a": perfect, "b": no_bridge}, failed={("a", "cool")}), backends.load_profile("segments-api"))
    hops = {(r.run_id, r.chain_id): r for r in e.multihop.where("k = 4").collect()}
    assert set(hops) == {(r, c) for r in "ab" for c in (None, "harbour")}
    assert (hops["a", None].bridge_claim_recall, hops["b", "harbour"].bridge_claim_recall, hops["b", "harbour"].endpoint_claim_recall) == (1.0, 0.0, 1.0)
    heads = {r.run_id: r for r in e.bridge_headline.collect()}
    assert (heads["a"].complete_core_bridge_chain, heads["b"].complete_core_bridge_chain, heads["b"].chain_macro_bridge_text_claim_recall, heads["a"].independent_chain_count) == (1.0, 0.0, 0.0, 1)
    by = {(r.dimension, r.value): r.questions for r in e.groups.where("run_id = 'a' and k = 4").collect()}
    assert by["difficulty", "hard"] == 2 and by["primary_type", "single"] == 1
    assert e.questions.where("run_id = 'a' and question_id = 'both'").first().gt_document_count == 2


def test_faulty_bodies_are_failures_not_empty_lists(spark, tables):
    bad = responses(spark, {"a": perfect, "b": perfect}).withColumn("body", F.when(F.col("question_id") == "lid", '{"records": {}}').otherwise(F.col("body")))
    e = evaluate.evaluated(tables, bad, backends.load_profile("segments-api"))
    assert {r.status for r in e.questions.where("question_id = 'lid'").collect()} == {"schema_error"}
    assert {r.macro_claim_recall for r in e.headline.collect()} == {1.0}
    assert {(r.status, r.n) for r in e.statuses.where("run_id = 'a'").collect()} == {("ok", 6), ("schema_error", 1)}


def test_chains_are_clusters_where_no_cluster_is_given(spark, at, tables):
    data = X.exam()
    for question in data["questions"]:
        question.pop("cluster_id")
    e = evaluate.evaluated(E.read_exam(spark, X.write_json(at / "bare.json", data)), responses(spark, {"a": perfect}), backends.load_profile("segments-api"))
    assert {r.question_id: r.cluster_id for r in e.questions.collect()} == {q["id"]: "harbour" if q["id"] == "hop" else q["id"] for q in data["questions"]}


def test_questions_per_chain_and_images(spark, at):
    data = X.exam()
    data["exam_meta"]["entity_bridge_design"] = {"questions_per_chain": 3}
    png = X.png(6, 4)
    data["exam_meta"]["corpus"]["image_assets"] = [{"name": "plan.png", "sha256": hashlib.sha256(png).hexdigest(), "media_type": "image/png", "width": 6, "height": 4}, {"name": "gone.png", "sha256": "0", "media_type": "image/png", "width": 1, "height": 1}]
    (at / "corpus" / "plan.png").write_bytes(png)
    with pytest.raises(evaluate.ExamValidationError) as caught:
        evaluate.validated(spark, X.write_json(at / "chained.json", data), f"{at}/corpus")
    assert "questions_per_chain: harbour 1" in str(caught.value) and "image_fault: gone.png missing" in str(caught.value) and "plan.png" not in str(caught.value)


def test_wrong_names_end_a_run(spark, tables):
    strange = lambda q: body(("x.md", "t", 0.5))
    with pytest.raises(evaluate.DocumentNameMismatch, match="x.md"):
        evaluate.evaluated(tables, responses(spark, {"a": strange}), backends.load_profile("segments-api"))
    evaluate.evaluated(tables, responses(spark, {"a": strange}), backends.load_profile("segments-api"), check_names=False)


def test_comparison(spark, tables):
    given = responses(spark, {"a": perfect, "b": no_bridge}, failed={("b", "lid")})
    e = evaluate.evaluated(tables, given, backends.load_profile("segments-api"))
    pairs, ranking, excluded = evaluate.compared_runs(e.questions, manifest(spark, "a", "b"), samples=50)
    got = {r.metric: r for r in pairs.collect()}
    assert round(got["claim_recall"].delta, 6) == round((1 / 2 - 1) / 3, 6) and got["claim_recall"].holm >= got["claim_recall"].p
    assert [r.run_id for r in ranking.where("metric = 'claim_recall'").collect()] == ["a", "b"]
    assert [r.question_id for r in excluded.collect()] == ["lid"]
    with pytest.raises(ComparisonError):
        evaluate.compared_runs(e.questions, manifest(spark, "a", "b", git_dirty=True))


def test_command_line(spark, at, tmp_path):
    responses(spark, {"a": perfect, "b": no_bridge}).write.json(f"{tmp_path}/responses")
    manifest(spark, "a", "b").write.json(f"{tmp_path}/manifest")
    exam = ["--exam", f"{at}/exam.json", "--corpus", f"{at}/corpus"]
    assert cli.main(["validate", *exam]) == 0
    run = ["evaluate", *exam, "--responses", f"{tmp_path}/responses", "--manifest", f"{tmp_path}/manifest", "--backend-profile", "segments-api"]
    assert cli.main(run) == 2
    assert cli.main([*run, "--out", f"{tmp_path}/out"]) == 0
    assert cli.main([*run, "--out", f"{tmp_path}/out", "--primary-k", "7"]) == 2
    assert "macro claim recall" in "\n".join(r.value for r in spark.read.text(f"{tmp_path}/out/report").collect())
    assert cli.main(["compare", "--results", f"{tmp_path}/out/results", "--manifest", f"{tmp_path}/manifest", "--out", f"{tmp_path}/cmp"]) == 0
    assert spark.read.json(f"{tmp_path}/cmp/pairs").count() == 4
    X.write_json(tmp_path / "ledger.json", X.ledger())
    assert cli.main(["build", "--ledger", f"{tmp_path}/ledger.json", "--corpus", f"{at}/corpus", "--out", f"{tmp_path}/built"]) == 0
    bad = X.exam()
    bad["questions"][X.EASY]["cluster_id"] = "none"
    X.write_json(tmp_path / "bad.json", bad)
    assert cli.main(["validate", "--exam", f"{tmp_path}/bad.json", "--corpus", f"{at}/corpus"]) == 1
