"""A small exam about a pottery kiln and a harbour, its ledger and its corpus."""

import copy
import hashlib
import json
import os
import struct
import zlib

OLD, NEW, BOAT, PIER, MASON = "kiln-first.md", "kiln-second.md", "lark.md", "pier.md", "vey.md"
CORPUS = {
    OLD: "# Kiln, first edition\n\nGlaze firing ends at 1180 degrees in the upper chamber. Nobody lifts the lid before dawn.\n\nA slow cooling of 14 hours keeps bowls whole. Cracked bowls go to the gravel heap.\n\n> Rule of thumb: 1180 degrees finish a glaze, and cooling for 14 hours saves it.\n\nThe shelf order is on ![shelves](https://example.invalid/shelf-order.png) overleaf.\n",
    NEW: "# Kiln, second edition\n\nGlaze firing ends at 1240 degrees in the upper chamber. The lid stays shut until noon.\n\nA slow cooling of 20 hours keeps bowls whole. Broken bowls become grog for new clay.\n\n> Rule of thumb: 1240 degrees finish a glaze, and cooling for 20 hours saves it.\n\nCones are read through the spyhole, never by hand.\n",
    BOAT: "The ferry Lark ties up at Pier Nine every evening. Painted green, Lark has used Pier Nine for eleven summers.\n",
    PIER: "Granite for Pier Nine came from the yard of the Dunlow Guild. Repairs of Pier Nine are still paid by that guild. Dunlow Guild apprentices sign the north wall of Pier Nine.\n",
    MASON: "Ona Vey cut her first stone with the Dunlow Guild. Until she retired, Ona Vey kept the guild's tools in order.\n",
}
SPANS = {
    "heat_old": ["Glaze firing ends at 1180 degrees", "1180 degrees finish a glaze"],
    "heat_new": ["Glaze firing ends at 1240 degrees", "1240 degrees finish a glaze"],
    "cool_old": ["A slow cooling of 14 hours", "cooling for 14 hours saves it"],
    "cool_new": ["A slow cooling of 20 hours", "cooling for 20 hours saves it"],
    "lid_new": ["The lid stays shut until noon", "Broken bowls become grog"],
    "boat": ["ferry Lark ties up at Pier Nine", "Lark has used Pier Nine for eleven summers"],
    "stone": ["Granite for Pier Nine came from the yard", "Repairs of Pier Nine are still paid"],
    "wall": ["Dunlow Guild apprentices sign the north wall", "sign the north wall of Pier Nine"],
    "mason": ["Ona Vey cut her first stone", "Ona Vey kept the guild's tools"],
}
DESIGN = {"chain_id": "harbour", "relation_type": "stonework", "endpoint_entities": ["Lark", "Ona Vey"], "endpoint_documents": [BOAT, MASON], "bridge_documents": [PIER], "bridge_entities": ["Pier Nine", "Dunlow Guild"]}
PROTOCOL = {"primary_k": 4, "eval_ks": [2, 4, 6], "request_k": 9, "char_budgets": [60, 300, 900], "primary_budget": 300}
LIMITS = {"min_claims_per_document": 1, "max_claim_share_per_document": 0.8, "min_low_lexical_overlap_questions": 0, "min_hard_negative_questions": 1, "min_spans_per_claim": 2, "max_span_normalized_len": 48, "min_sanity_questions": 1, "min_unanswerable_questions": 2}
#: The places of questions in the exam.
HOP, WEATHER, LID, BOTH, EASY, COOL, PRICE = range(7)


def claim(cid, document, spans, kind="text", claim_type="anchor", **more):
    return {"id": cid, "kind": kind, "claim_type": claim_type, "source_document": document, "section": "s", "accepted_spans": list(spans)} | more


def question(qid, role, cluster, ptype, text, claims=(), difficulty="hard", **more):
    return {"id": qid, "question_role": role, "cluster_id": cluster, "difficulty": difficulty, "primary_type": ptype, "tags": [], "question": text, "reference_answer": "-", "claims": list(claims), "evidence_chain": [c["id"] for c in claims], "negative_evidence": []} | more


def negative(nid, document, span):
    return {"id": nid, "source_document": document, "section": "s", "accepted_spans": [span]}


def exam():
    nothing = {"expected_behavior": "no_relevant_evidence", "diagnostic_reason": "no document says so"}
    chain = [claim("hop.a", BOAT, SPANS["boat"], hop_role="endpoint"), claim("hop.b", PIER, SPANS["stone"], claim_type="passage", hop_role="bridge"), claim("hop.c", PIER, SPANS["wall"], claim_type="passage", hop_role="bridge"), claim("hop.d", MASON, SPANS["mason"], hop_role="endpoint")]
    both = [claim("both.a", OLD, SPANS["cool_old"]), claim("both.b", NEW, SPANS["heat_new"], claim_type="passage"), claim("both.c", OLD, ["https://example.invalid/shelf-order.png"], "asset", "passage")]
    questions = [
        question("hop", "scored", "quay", "cross_doc_chain", "Whose craft does Lark owe its berth to, and how does Ona Vey come in?", chain, hop_design=copy.deepcopy(DESIGN)),
        question("weather", "unanswerable", "kiln", "none", "Will it rain on Sunday?", (), "diagnostic", **nothing),
        question("lid", "scored", "kiln", "single", "Up to when must nobody look inside nowadays?", [claim("lid.a", NEW, SPANS["lid_new"])], "medium"),
        question("both", "scored", "kiln", "compare", "Set both editions side by side: what changed?", both, negative_evidence=[negative("both.n1", NEW, "A slow cooling of 20 hours"), negative("both.n2", OLD, "Glaze firing ends at 1180 degrees")]),
        question("easy", "sanity", "kiln", "single", "How hot did one fire in the first edition?", [claim("easy.a", OLD, SPANS["heat_old"])], "simple"),
        question("cool", "scored", "new-kiln", "single", "How long do pots rest now?", [claim("cool.a", NEW, SPANS["cool_new"])], "medium"),
        question("price", "unanswerable", "quay", "none", "What does a ticket cost?", (), "diagnostic", **nothing),
    ]
    meta = {
        "exam_id": "kiln-and-quay",
        "title": "kiln and quay",
        "retrieval_protocol": PROTOCOL,
        "question_counts": {"total": 7, "scored": 4, "sanity": 1, "unanswerable": 2, "by_primary_type": {"single": 3, "compare": 1, "none": 2, "cross_doc_chain": 1}, "by_difficulty": {"simple": 1, "hard": 2, "medium": 2, "diagnostic": 2}},
        "clusters": [{"id": "kiln", "family": "K", "axis": "version", "documents": [OLD, NEW]}, {"id": "new-kiln", "family": "K", "axis": "version", "documents": [NEW]}, {"id": "quay", "family": "H", "axis": "entity_bridge", "documents": [BOAT, PIER, MASON]}],
        "bridge_chains": [{"id": "harbour", "family": "H", "relation_type": "stonework", "bridge_entities": DESIGN["bridge_entities"], "documents": [BOAT, PIER, MASON]}],
        "design_constraints": dict(LIMITS),
        "corpus": {"snapshot_id": "s", "relative_dir": ".", "documents": [{"name": n, "sha256": hashlib.sha256(t.encode()).hexdigest()} for n, t in CORPUS.items()]},
    }
    return {"schema_version": "4.1", "exam_meta": meta, "questions": questions}


def write_corpus(folder):
    os.makedirs(folder, exist_ok=True)
    for name, text in CORPUS.items():
        with open(os.path.join(folder, name), "w", encoding="utf-8") as f:
            f.write(text)
    return str(folder)


def write_json(path, data):
    with open(path, "w", encoding="utf-8") as f:
        json.dump(data, f, ensure_ascii=False, indent=1)
    return str(path)


def png(width, height):
    part = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    head = part(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 0, 0, 0, 0))
    return b"\x89PNG\r\n\x1a\n" + head + part(b"IDAT", zlib.compress(b"\x00" * (height * (width + 1)))) + part(b"IEND", b"")


def fact(fid, family, cluster, values, locations, claim_type="anchor", **more):
    return {"fact_id": fid, "family": family, "cluster_id": cluster, "kind": "text", "claim_type": claim_type, "dimension": fid, "values": values, "locations": {d: [{"section": "s", "locator": x} for x in xs] for d, xs in locations.items()}} | more


def ledger():
    on_chain = lambda role: {"chain_id": "harbour", "hop_role": role}
    ask = lambda qid, role, cluster, ptype, text, answer="", claims=(), difficulty="hard", **more: {"id": qid, "question_role": role, "cluster_id": cluster, "difficulty": difficulty, "primary_type": ptype, "tags": [], "question": text, "reference_answer": answer, "claims": [{"fact_id": f, "document": d} for f, d in claims]} | more
    none = {"difficulty": "diagnostic", "diagnostic_reason": "no document says so"}
    return {
        "ledger_version": "1", "exam_id": "laid", "exam_title": "laid", "purpose": "test", "corpus_snapshot_id": "s", "corpus_relative_dir": ".", "retrieval_protocol": PROTOCOL, "design_constraints": LIMITS,
        "families": [{"id": "K", "cluster_id": "kiln", "axis": "version", "title": "kilns", "documents": [OLD, NEW]}],
        "chains": [{"id": "harbour", "family": "H", "cluster_id": "quay", "relation_type": "stonework", "path": "-", "endpoint_entities": ["Lark", "Ona Vey"], "bridge_entities": ["Pier Nine", "Dunlow Guild"], "endpoint_documents": [BOAT, MASON], "bridge_documents": [PIER], "documents": [BOAT, PIER, MASON]}],
        "facts": [
            fact("mason", "H", "quay", {MASON: "Dunlow Guild"}, {MASON: ["Ona Vey cut her first stone", "kept the guild's tools"]}, **on_chain("endpoint")),
            fact("boat", "H", "quay", {BOAT: "Pier Nine"}, {BOAT: ["ties up at Pier Nine", "for eleven summers"]}, **on_chain("endpoint")),
            fact("stone", "H", "quay", {PIER: "Dunlow Guild"}, {PIER: ["Granite for Pier Nine", "still paid by that guild"]}, "passage", **on_chain("bridge")),
            fact("heat", "K", "kiln", {OLD: "1180 degrees", NEW: "1240 degrees"}, {OLD: ["ends at 1180 degrees", "1180 degrees finish"], NEW: ["ends at 1240 degrees", "1240 degrees finish"]}),
            fact("cool", "K", "kiln", {OLD: "14 hours", NEW: "20 hours"}, {OLD: ["slow cooling of 14 hours", "for 14 hours saves"], NEW: ["slow cooling of 20 hours", "for 20 hours saves"]}, "passage"),
        ],
        "questions": [
            ask("l-hop", "scored", "quay", "cross_doc_chain", "Whose craft does Lark owe its berth to, and how does Ona Vey come in?", "Pier Nine is the work of the Dunlow Guild", [("boat", BOAT), ("stone", PIER), ("mason", MASON)], chain_id="harbour"),
            ask("l-both", "scored", "kiln", "compare", "What changed about resting pots?", "first 14 hours, then 20 hours", [("cool", OLD), ("cool", NEW)], negatives=[{"fact_id": "boat", "document": BOAT}]),
            ask("l-rain", "unanswerable", "kiln", "none", "Will it rain?", **none),
            ask("l-easy", "sanity", "kiln", "single", "How hot did one fire at first?", "1180 degrees", [("heat", OLD)], "simple"),
            ask("l-cost", "unanswerable", "kiln", "none", "What is the price?", **none),
        ],
    }
