import copy
import json

import exam_fixture as X
import pytest
from plumbline.operators import building, validation
from plumbline.sources import corpus as C
from plumbline.sources import exam as E
from pyspark.sql import functions as F


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    return C.read_files(spark, X.write_corpus(tmp_path_factory.mktemp("corpus"))).cache()


def broken(spark, corpus, tmp_path, mutate=None, **options):
    data = X.exam()
    if mutate:
        mutate(data)
    t = E.read_exam(spark, X.write_json(tmp_path / "exam.json", data))
    return {(r.rule, r.subject) for r in validation.violations(t, corpus, **options).collect()}


def test_valid_exam(spark, corpus, tmp_path):
    assert broken(spark, corpus, tmp_path) == set()
    t = E.read_exam(spark, str(tmp_path / "exam.json"))
    f = validation.facts(t, corpus).first()
    assert (f.role_counts, f.total_claims, f.chain_question_counts, f.corpus_drift) == ({"sanity": 1, "scored": 4, "unanswerable": 2}, 10, {"harbour": 1}, False)


def q(data, i):
    return data["questions"][i]


def m_few(d):
    q(d, X.EASY)["claims"][0]["accepted_spans"].pop()


def m_ambiguous(d):
    q(d, X.EASY)["claims"][0]["accepted_spans"][0] = "degrees"


def m_missing(d):
    q(d, X.EASY)["claims"][0]["accepted_spans"][0] = "no such sentence here"


def m_long(d):
    q(d, X.EASY)["claims"][0]["accepted_spans"][0] = "Glaze firing ends at 1180 degrees in the upper chamber. Nobody lifts the lid"


def m_cluster(d):
    q(d, X.BOTH)["cluster_id"] = "barn"


def m_counts(d):
    d["exam_meta"]["question_counts"]["scored"] = 9


def m_types(d):
    d["exam_meta"]["question_counts"]["by_primary_type"]["compare"] = 4


def m_reuse(d):
    q(d, X.COOL)["claims"][0]["accepted_spans"] = list(X.SPANS["heat_new"])


def m_overlap(d):
    q(d, X.COOL)["tags"] = ["low_lexical_overlap"]
    q(d, X.COOL)["question"] = "Is a slow cooling of 20 hours right?"


def m_leak(d):
    q(d, X.HOP)["question"] = "Where do Pier Nine and Ona Vey meet?"
    q(d, X.HOP)["hop_design"]["endpoint_entities"] = ["Pier Nine", "Ona Vey"]


def m_unnamed(d):
    q(d, X.HOP)["question"] = "Who is behind the berth?"


def m_role(d):
    q(d, X.HOP)["claims"][2]["hop_role"] = "endpoint"


def m_nobridge(d):
    del q(d, X.HOP)["claims"][1:3]


def m_oneend(d):
    del q(d, X.HOP)["claims"][3]


def m_hops(d):
    q(d, X.LID)["hop_design"] = copy.deepcopy(X.DESIGN)


def m_drift(d):
    d["exam_meta"]["corpus"]["documents"][0]["sha256"] = "0" * 64


def m_sanity(d):
    d["exam_meta"]["design_constraints"]["min_sanity_questions"] = 2


def m_share(d):
    d["exam_meta"]["design_constraints"]["max_claim_share_per_document"] = 0.25


def m_relation(d):
    q(d, X.HOP)["relation_type"] = "trade"


def m_negative(d):
    q(d, X.BOTH)["negative_evidence"][0]["accepted_spans"] = ["nowhere to be read"]


def m_document(d):
    d["exam_meta"]["corpus"]["documents"] = [x for x in d["exam_meta"]["corpus"]["documents"] if x["name"] != X.NEW]


RULES = [
    (m_few, "too_few_spans", "easy.a"), (m_ambiguous, "span_ambiguous", "easy.a"), (m_missing, "span_missing", "easy.a"), (m_long, "span_too_long", "easy.a"), (m_cluster, "cluster_undeclared", "both"),
    (m_counts, "counts_differ", "scored"), (m_types, "counts_differ", "compare"), (m_reuse, "span_reused", "both.b"), (m_overlap, "overlap_not_low", "cool"), (m_leak, "bridge_leaks_endpoint", "hop"), (m_unnamed, "endpoint_not_in_question", "hop"),
    (m_role, "hop_role_mismatch", "hop.c"), (m_nobridge, "no_bridge_claim", "hop"), (m_oneend, "too_few_endpoints", "hop"), (m_hops, "unexpected_hops", "lid"), (m_drift, "corpus_drift", X.OLD),
    (m_sanity, "too_few", "sanity"), (m_share, "claim_share", "kiln-second"), (m_relation, "relation_mismatch", "hop"), (m_negative, "negative_missing", "both.n1"), (m_document, "document_undeclared", "cool.a"),
]


@pytest.mark.parametrize(("mutate", "rule", "subject"), RULES, ids=[r[0].__name__[2:] for r in RULES])
def test_each_rule(spark, corpus, tmp_path, mutate, rule, subject):
    assert (rule, subject) in broken(spark, corpus, tmp_path, mutate)


def test_drift_can_be_allowed(spark, corpus, tmp_path):
    assert broken(spark, corpus, tmp_path, m_drift, allow_corpus_drift=True) == set()


def test_older_schema_gives_roles(spark, tmp_path):
    data = X.exam()
    data["schema_version"] = "3.0"
    for question in data["questions"]:
        question["scored"] = question.pop("question_role") == "scored"
        question.pop("cluster_id")
    t = E.read_exam(spark, X.write_json(tmp_path / "old.json", data))
    assert {r.role: r["count"] for r in t.questions.groupBy("role").count().collect()} == {"scored": 4, "diagnostic": 3}


def test_images(spark, tmp_path):
    (tmp_path / "a.png").write_bytes(X.png(7, 5))
    (tmp_path / "b.png").write_bytes(b"not an image")
    found = C.read_images(spark, str(tmp_path))
    rows = {r.name: r for r in found.collect()}
    assert (rows["a.png"].media_type, rows["a.png"].width, rows["a.png"].height) == ("image/png", 7, 5)
    assert rows["b.png"].width is None
    declared = found.withColumn("width", F.lit(9)).unionByName(found.limit(1).withColumn("name", F.lit("gone.png")))
    assert {r.why for r in C.image_faults(declared, found).collect()} == {"size differs", "missing"}


def test_protocol():
    p, source = E.resolved_protocol(X.PROTOCOL, {"primary_k": 6})
    assert p["primary_k"] == 6 and source["primary_k"] == "cli_override" and source["request_k"] == "exam"
    E.check_protocol(p)
    for change in ({"primary_k": 5}, {"eval_ks": [4, 4]}, {"eval_ks": [4, -1]}, {"request_k": 3}, {"primary_budget": 61}):
        with pytest.raises(E.OptionError):
            E.check_protocol(X.PROTOCOL | change)


def raw(name):
    return X.CORPUS[name]


def test_derived_spans():
    from plumbline.functions.text import normalize_python as norm

    text = raw(X.OLD)
    span, fault = building.derived_span(text, "14 hours keeps")
    assert fault is None and "14 hours keeps" in span and 12 <= len(norm(span)) <= 40 and norm(text).count(norm(span)) == 1
    assert building.derived_span(text, "hours") == (None, "occurs 2 times")
    assert building.derived_span(text, "porcelain")[1] == "missing"
    assert building.derived_span(text, text[30:140])[1] == "too long"


def read_ledger(spark, tmp_path, data):
    return spark.read.schema(building.LEDGER).json(X.write_json(tmp_path / "ledger.json", data), multiLine=True)


def test_resolve_and_build(spark, corpus, tmp_path):
    ledger = read_ledger(spark, tmp_path, X.ledger())
    places = building.resolved(ledger, corpus).cache()
    building.check_resolved(places)
    assert places.where("span is null or normalized_length not between 12 and 40").count() == 0
    assert building.unique_spans(places, corpus).count() == 0
    exam = json.loads(building.built(ledger, places, corpus).toJSON().first())
    again = json.loads(building.built(ledger, places.repartition(5), corpus).toJSON().first())
    assert exam == again
    counts = exam["exam_meta"]["question_counts"]
    assert (counts["total"], counts["scored"], counts["sanity"], counts["unanswerable"]) == (5, 2, 1, 2)
    by_id = {x["id"]: x for x in exam["questions"]}
    assert by_id["l-both"]["evidence_chain"] == ["l-both_c1", "l-both_c2"] and [c["source_document"] for c in by_id["l-both"]["claims"]] == [X.OLD, X.NEW]
    assert all(len(c["accepted_spans"]) == 2 for c in by_id["l-both"]["claims"]) and by_id["l-both"]["negative_evidence"][0]["source_document"] == X.BOAT
    assert by_id["l-rain"]["expected_behavior"] == "no_relevant_evidence" and by_id["l-rain"]["claims"] == []
    assert [c["hop_role"] for c in by_id["l-hop"]["claims"]] == ["endpoint", "bridge", "endpoint"] and by_id["l-hop"]["hop_design"]["chain_id"] == "harbour" and "hop_design" not in by_id["l-both"]
    t = E.read_exam(spark, X.write_json(tmp_path / "built.json", exam))
    assert {(r.rule, r.subject, r.detail) for r in validation.violations(t, corpus).collect()} == set()
    assert building.audit(t, places, ledger, corpus, min_separation=10).collect() == []


def test_ledger_faults(spark, corpus, tmp_path):
    data = X.ledger()
    data["facts"][3]["locations"][X.OLD].pop()
    with pytest.raises(building.LedgerError, match="at least 2"):
        building.check_resolved(building.resolved(read_ledger(spark, tmp_path, data), corpus))
    data = X.ledger()
    data["facts"][4]["locations"][X.NEW][1]["locator"] = "porcelain"
    with pytest.raises(building.LedgerError, match="missing"):
        building.check_resolved(building.resolved(read_ledger(spark, tmp_path, data), corpus))
    data = X.ledger()
    data["questions"][1]["claims"][0]["fact_id"] = "smoke"
    ledger = read_ledger(spark, tmp_path, data)
    with pytest.raises(building.BuildError, match="undefined fact"):
        building.built(ledger, building.resolved(ledger, corpus), corpus)
    with pytest.raises(building.BuildError):
        building.built(ledger, building.locations(ledger), corpus)


def test_gates(spark, corpus, tmp_path):
    ledger = read_ledger(spark, tmp_path, X.ledger())
    places = building.resolved(ledger, corpus).cache()
    clean = json.loads(building.built(ledger, places, corpus).toJSON().first())

    def gates(mutate):
        exam = copy.deepcopy(clean)
        mutate({x["id"]: x for x in exam["questions"]}, exam)
        t = E.read_exam(spark, X.write_json(tmp_path / "m.json", exam))
        return {r.gate for r in building.audit(t, places, ledger, corpus, min_separation=10).collect()}

    assert "G12" in gates(lambda x, _: x["l-hop"]["claims"][1].update(hop_role="endpoint"))
    assert "G11" in gates(lambda x, _: x["l-hop"]["claims"][1].update(accepted_spans=x["l-hop"]["claims"][2]["accepted_spans"]))
    assert "G10" in gates(lambda x, _: x["l-hop"]["hop_design"].update(endpoint_entities=["Pier Nine"]))
    assert "G8" in gates(lambda _, e: e["exam_meta"]["corpus"]["documents"][1].update(name="ofen\u00fcbersicht.md"))
    assert "G6" in gates(lambda x, _: x["l-easy"].update(question="Were it 1180 degrees?"))
    assert "G5" in gates(lambda x, _: x["l-both"].update(reference_answer="It takes longer."))
    assert "G4" in gates(lambda x, _: x["l-both"]["negative_evidence"][0].update(source_document=X.NEW))
    t = E.read_exam(spark, X.write_json(tmp_path / "m.json", clean))
    assert "separation" in {r.gate for r in building.audit(t, places, ledger, corpus, min_separation=5000).collect()}


def test_screening(spark, corpus, tmp_path):
    ledger = read_ledger(spark, tmp_path, X.ledger())
    exam = json.loads(building.built(ledger, building.resolved(ledger, corpus), corpus).toJSON().first())
    t = E.read_exam(spark, X.write_json(tmp_path / "s.json", exam))
    got = {r.question_id: r for r in building.screen(t, corpus, 200, 50, 2).collect()}
    assert set(got) == {"l-easy", "l-both", "l-hop"}
    next(x for x in exam["questions"] if x["id"] == "l-hop")["question"] = "Did granite for Pier Nine come from the yard, and are repairs still paid by that guild?"
    t = E.read_exam(spark, X.write_json(tmp_path / "s.json", exam))
    assert {r.question_id: r for r in building.screen(t, corpus, 200, 50, 1).collect()}["l-hop"].bridge_reachable
