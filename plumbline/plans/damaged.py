"""The derived exam as an exam's tables, with faults put in by question and document numbers, so that each rule has violations.

Beside each rule's query stands its SQL, which counts the violations of a subject; so do the
entity-bridge metrics, the gates of comparisons and the faults of responses.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions.text import normalize_sql, normalize_text
from plumbline.operators import aggregates, bridge, comparing, matching, statistics, validation
from plumbline.plans.derived import PRIMARY_K, Exam
from plumbline.plans.queries import SIX, _values, _with, query, six
from plumbline.sources import backends
from plumbline.sources.exam import ExamTables

LIMITS = {"min_claims_per_document": 2, "max_claim_share_per_document": 0.02, "min_low_lexical_overlap_questions": 100_000, "min_hard_negative_questions": 0, "min_spans_per_claim": 2, "max_span_normalized_len": 60, "min_sanity_questions": 0, "min_unanswerable_questions": 100_000}
NO_SPAN = "no such words anywhere"


#: Rules that read negatives.
HARD = ("negative_missing", "negative_without_entity", "too_few")


def tables(x: Exam, hard: bool = True) -> tuple[ExamTables, DataFrame]:
    """The exam's tables and its corpus; without the negatives, which take a retrieval, unless hard."""
    spark, q = x.spark, F.col("question_id")
    name = F.concat(F.col("document_key").cast("string"), F.lit(".md"))
    docs = x.docs.select(name.alias("name"), F.col("document_key").cast("string").alias("document_key"), F.sha2("text", 256).alias("sha256"), "text", normalize_text("text").alias("text_norm"), "lang", "source")
    n = x.claims.groupBy("question_id").agg(F.count("*").alias("n"))
    own = x.questions.withColumn("document_key", F.col("source_key").cast("string")).join(docs.select("document_key", "name", "lang", "source"), "document_key", "left").join(n, "question_id", "left")
    chain = F.coalesce(F.col("n") >= 3, F.lit(False))
    words = F.split("question", " ")
    design = F.struct(F.col("lang").alias("chain_id"), F.lit("kin").alias("relation_type"), F.array(words[0], F.concat(F.lit("Zz"), words[1])).alias("endpoint_entities"), F.array("name").alias("endpoint_documents"), F.array("name").alias("bridge_documents"), F.array(F.lit("the")).alias("bridge_entities"))
    questions = own.select(
        "question_id", q.cast("int").alias("ord"), F.when((q % 10 == 0) & F.col("source_key").isNotNull(), "sanity").otherwise(F.col("role")).alias("role"), F.col("source").alias("cluster_id"),
        F.when(chain, F.col("lang")).alias("chain_id"), F.when(chain, F.when(q % 3 == 0, "trade").otherwise("kin")).alias("relation_type"), F.when(chain, "hard").otherwise("simple").alias("difficulty"),
        F.when(chain, "cross_doc_chain").otherwise("single").alias("primary_type"), F.when(q % 2 == 1, F.array(F.lit("low_lexical_overlap"))).otherwise(F.array().cast("array<string>")).alias("tags"),
        "question", F.when(F.when(chain, q % 5 != 0).otherwise((q % 7 == 0) & F.col("name").isNotNull()), design).alias("hop_design"),
    )
    claims = x.claims.select("question_id", "claim_id", "claim_ord", F.lit("text").alias("kind"), "claim_type", F.when((q % 4 == 1) & (F.col("hop_role") == "bridge") | (q % 4 == 2) & (F.col("hop_role") == "endpoint"), None).otherwise(F.col("hop_role")).alias("hop_role"), name.alias("document_name"), F.col("document_key").cast("string").alias("document_key"), F.col("span").alias("text"))
    more = F.when(F.col("claim_ord").isin(1, 3), F.lit(NO_SPAN)).when(F.col("claim_ord") % 2 == 0, F.left("text", F.lit(5)))
    span = F.posexplode(F.array_compact(F.array(F.col("text"), more))).alias("span_index", "span")
    spans = claims.select("question_id", "claim_id", "document_key", span).withColumn("span_norm", normalize_text("span"))
    lost = F.when(q % 2 == 0, F.concat(F.lit("zz "), "span_norm")).otherwise(F.col("span_norm"))
    negatives = (x.negatives if hard else spark.createDataFrame([], "question_id bigint, document_key bigint, span_norm string")).select("question_id", F.concat(q.cast("string"), F.lit("_n")).alias("negative_id"), F.col("document_key").cast("string").alias("document_key"), lost.alias("span"), lost.alias("span_norm"))
    declared = docs.where("cast(document_key as bigint) % 4 <> 0").select("name", F.when(F.col("document_key").cast("bigint") % 3 == 0, "0").otherwise(F.col("sha256")).alias("sha256"), "document_key")
    chains = docs.select(F.col("lang").alias("chain_id")).distinct().select("chain_id", F.lit("L").alias("family"), F.lit("kin").alias("relation_type"), F.array(F.lit("the"), F.lit("der")).alias("bridge_entities"), F.array(F.lit("-")).alias("documents"))
    clusters = docs.select(F.col("source").alias("cluster_id")).distinct().where("cluster_id not like '%4'").select("cluster_id", F.lit("S").alias("family"), F.lit("-").alias("axis"), F.array(F.lit("-")).alias("documents"))
    exam = spark.sql("select named_struct('entity_bridge_design', named_struct('questions_per_chain', 7)) as exam_meta")
    limits = spark.sql("select " + ", ".join(f"{v} as {k}" for k, v in LIMITS.items()))
    counts = spark.sql("select 7 as total, 1 as scored, 2 as sanity, cast(null as int) as diagnostic, 3 as unanswerable, map('single', 1, 'compare', 5) as by_primary_type, map('hard', 2) as by_difficulty")
    t = ExamTables(exam, questions, claims.drop("text"), spans, negatives, clusters, chains, declared, spark.range(0), limits, counts)
    return t, docs


_TABLES = f""", dd AS (SELECT CAST(document_key AS VARCHAR) AS dk, document_key || '.md' AS name, text, {normalize_sql("text")} AS text_norm, lang, source FROM docs),
qq AS (SELECT p.question_id, passage AS question, d.name, d.lang, d.source AS cluster_id, CASE WHEN p.question_id % 10 = 0 AND s.document_key IS NOT NULL THEN 'sanity' WHEN s.document_key IS NULL THEN 'unanswerable' ELSE 'scored' END AS role,
  coalesce((SELECT count(*) FROM claims c WHERE c.question_id = p.question_id), 0) >= 3 AS chain FROM passages p LEFT JOIN sources s USING (question_id) LEFT JOIN dd d ON d.dk = CAST(s.document_key AS VARCHAR)),
hop AS (SELECT *, CASE WHEN chain THEN question_id % 5 <> 0 ELSE question_id % 7 = 0 AND name IS NOT NULL END AS designed, [split_part(question, ' ', 1), 'Zz' || split_part(question, ' ', 2)] AS entities FROM qq),
cc AS (SELECT question_id, claim_id, claim_ord, CASE WHEN question_id % 4 = 1 AND hop_role = 'bridge' OR question_id % 4 = 2 AND hop_role = 'endpoint' THEN NULL ELSE hop_role END AS hop_role, document_key || '.md' AS name, CAST(document_key AS VARCHAR) AS dk, span AS text FROM claims),
ss AS (SELECT question_id, claim_id, dk, text AS span, {normalize_sql("text")} AS span_norm FROM cc
  UNION ALL SELECT question_id, claim_id, dk, x, {normalize_sql("x")} FROM (SELECT *, CASE WHEN claim_ord IN (1, 3) THEN '{NO_SPAN}' ELSE left(text, 5) END AS x FROM cc WHERE claim_ord IN (1, 3) OR claim_ord % 2 = 0)),
seen AS (SELECT ss.*, coalesce((length(text_norm) - length(replace(text_norm, span_norm, ''))) / length(span_norm), 0) AS n FROM ss LEFT JOIN dd USING (dk)),
nn AS (SELECT question_id, question_id || '_n' AS negative_id, CAST(document_key AS VARCHAR) AS dk, CASE WHEN question_id % 2 = 0 THEN 'zz ' || span_norm ELSE span_norm END AS span FROM negatives),
declared AS (SELECT * FROM dd WHERE CAST(dk AS BIGINT) % 4 <> 0),
per AS (SELECT dk, (SELECT count(*) FROM cc WHERE cc.dk = declared.dk) AS n FROM declared)
"""

RULES = {
    "span_missing": "SELECT claim_id AS subject FROM seen WHERE n = 0",
    "span_ambiguous": "SELECT claim_id AS subject FROM seen WHERE n > 1",
    "too_few_spans": f"SELECT claim_id AS subject FROM ss GROUP BY claim_id HAVING count(*) < {LIMITS['min_spans_per_claim']}",
    "span_too_long": f"SELECT claim_id AS subject FROM ss WHERE length(span_norm) > {LIMITS['max_span_normalized_len']}",
    "span_reused": "SELECT min(claim_id) AS subject FROM ss GROUP BY dk, span_norm HAVING count(DISTINCT question_id) > 1 UNION ALL SELECT min(claim_id) FROM ss GROUP BY question_id, dk, span_norm HAVING count(DISTINCT claim_id) > 1",
    "negative_missing": "SELECT negative_id AS subject FROM nn JOIN dd USING (dk) WHERE NOT contains(text_norm, nn.span)",
    "negative_without_entity": "SELECT negative_id AS subject FROM nn JOIN qq USING (question_id) WHERE chain AND lang IS NOT NULL AND NOT (contains(span, 'the') OR contains(span, 'der'))",
    "cluster_undeclared": "SELECT CAST(question_id AS VARCHAR) AS subject FROM qq WHERE cluster_id LIKE '%4'",
    "counts_differ": """SELECT subject FROM (SELECT 'total' AS subject, 7 AS want, count(*) AS n FROM qq UNION ALL SELECT 'scored', 1, count(*) FROM qq WHERE role = 'scored' UNION ALL SELECT 'sanity', 2, count(*) FROM qq WHERE role = 'sanity'
UNION ALL SELECT 'unanswerable', 3, count(*) FROM qq WHERE role = 'unanswerable' UNION ALL SELECT 'single', 1, count(*) FROM qq WHERE NOT chain UNION ALL SELECT 'cross_doc_chain', 0, count(*) FROM qq WHERE chain UNION ALL SELECT 'compare', 5, 0
UNION ALL SELECT 'hard', 2, count(*) FROM qq WHERE chain UNION ALL SELECT 'simple', 0, count(*) FROM qq WHERE NOT chain) WHERE want <> n""",
    "too_few": "SELECT unnest(['low_lexical_overlap', 'unanswerable']) AS subject",
    "too_few_claims": f"SELECT dk AS subject FROM per WHERE n < {LIMITS['min_claims_per_document']}",
    "claim_share": f"SELECT dk AS subject FROM per WHERE n > {LIMITS['max_claim_share_per_document']} * (SELECT count(*) FROM cc)",
    "document_undeclared": "SELECT claim_id AS subject FROM cc WHERE CAST(dk AS BIGINT) % 4 = 0",
    "overlap_not_low": f"""SELECT CAST(question_id AS VARCHAR) AS subject FROM (SELECT ss.question_id, list_distinct(list_transform(range(1, greatest(length(span_norm), 1)), lambda i: substring(span_norm, i, 2))) AS g,
list_distinct(list_transform(range(1, greatest(length(qn), 1)), lambda i: substring(qn, i, 2))) AS w FROM ss JOIN (SELECT question_id, {normalize_sql("question")} AS qn FROM qq) z USING (question_id) WHERE ss.question_id % 2 = 1) WHERE len(g) > 0 AND len(list_intersect(g, w)) / len(g) > 0.5""",
    "bridge_leaks_endpoint": "SELECT CAST(question_id AS VARCHAR) AS subject FROM (SELECT question_id, name, unnest(entities) AS entity FROM hop WHERE chain AND designed) JOIN dd USING (name) WHERE contains(text, entity)",
    "endpoint_not_in_question": "SELECT CAST(question_id AS VARCHAR) AS subject FROM (SELECT question_id, question, unnest(entities) AS entity FROM hop WHERE chain AND designed) WHERE NOT contains(question, entity)",
    "hop_role_mismatch": "SELECT claim_id AS subject FROM cc JOIN hop USING (question_id) WHERE chain AND designed AND cc.name = hop.name AND hop_role IS DISTINCT FROM 'bridge'",
    "no_bridge_claim": "SELECT CAST(question_id AS VARCHAR) AS subject FROM cc JOIN qq USING (question_id) WHERE chain GROUP BY question_id HAVING count(*) FILTER (hop_role = 'bridge') < 1",
    "too_few_endpoints": "SELECT CAST(question_id AS VARCHAR) AS subject FROM cc JOIN qq USING (question_id) WHERE chain GROUP BY question_id HAVING count(*) FILTER (hop_role = 'endpoint') < 2",
    "hop_design_missing": "SELECT CAST(question_id AS VARCHAR) AS subject FROM hop WHERE chain AND NOT designed",
    "unexpected_hops": "SELECT CAST(question_id AS VARCHAR) AS subject FROM hop WHERE NOT chain AND designed",
    "relation_mismatch": "SELECT CAST(question_id AS VARCHAR) AS subject FROM qq WHERE chain AND lang IS NOT NULL AND question_id % 3 = 0",
    "questions_per_chain": "SELECT l.lang AS subject FROM (SELECT DISTINCT lang FROM dd) l LEFT JOIN (SELECT lang, count(*) AS n FROM qq WHERE chain GROUP BY 1) c ON c.lang = l.lang WHERE l.lang IS NOT NULL AND coalesce(n, 0) <> 7",
    "corpus_drift": "SELECT name AS subject FROM declared WHERE CAST(dk AS BIGINT) % 3 = 0",
}


def _rule(name: str):  # noqa: ANN202
    def violations(x: Exam) -> DataFrame:
        t, corpus = tables(x, name in HARD)
        got = validation.violations(t, corpus).where(F.col("rule") == name)
        return got.groupBy("rule", "subject").agg(F.count("*").alias("n"))

    return violations


for _name, _sql in RULES.items():
    query(f"rule_{_name}", _TABLES + f"SELECT '{_name}' AS rule, subject, count(*) AS n FROM ({_sql}) GROUP BY subject")(_rule(_name))


# Entity-bridge metrics: each document is taken apart by the parity of a claim's place into one that
# stands for endpoints, one for the bridge and one that supports.
_SIDE = "CASE claim_ord % 3 WHEN 0 THEN 'endpoint' WHEN 1 THEN 'bridge' ELSE 'supporting' END"
_BRIDGE = f""", bd AS (SELECT run_id, d.question_id, claim_id, document_key || '-' || ({_SIDE}) AS dk, {_SIDE} AS role, CASE WHEN d.question_id % 6 = 0 THEN 'asset' ELSE 'text' END AS kind, coalesce(first_rank <= {PRIMARY_K}, false) AS hit FROM detail d),
seen_docs AS (SELECT DISTINCT run_id, question_id, document_key || '-' || CASE rank % 3 WHEN 0 THEN 'endpoint' WHEN 1 THEN 'bridge' ELSE 'supporting' END AS dk FROM chunks WHERE rank <= {PRIMARY_K}),
roles AS (SELECT DISTINCT question_id, dk, role FROM bd),
counted AS (SELECT run_id, question_id, {", ".join(f"count(*) FILTER (kind = 'text' AND role = '{r}') AS {r}_n, count(*) FILTER (kind = 'text' AND role = '{r}' AND hit) AS {r}_h" for r in bridge.ROLES)}, count(*) FILTER (kind = 'asset') AS image_n, count(*) FILTER (kind = 'asset' AND hit) AS image_h FROM bd GROUP BY ALL),
got AS (SELECT a.run_id, a.question_id, {", ".join(f"count(*) FILTER (role = '{r}') AS {r}_docs, count(*) FILTER (role = '{r}' AND s.dk IS NOT NULL) AS {r}_got" for r in bridge.ROLES)} FROM (SELECT DISTINCT run_id, question_id FROM bd) a JOIN roles r USING (question_id) LEFT JOIN seen_docs s ON s.run_id = a.run_id AND s.question_id = a.question_id AND s.dk = r.dk GROUP BY ALL),
bm AS (SELECT run_id, question_id, {", ".join(f"CASE WHEN {r}_n > 0 THEN {r}_h / {r}_n END AS {r}_text_claim_recall" for r in bridge.ROLES)}, CASE WHEN endpoint_n > 0 AND bridge_n > 0 THEN endpoint_h = endpoint_n AND bridge_h = bridge_n END AS complete_core_bridge_chain,
  CASE WHEN endpoint_n > 0 AND bridge_n > 0 THEN endpoint_h = endpoint_n AND bridge_h = bridge_n AND supporting_h = supporting_n END AS complete_declared_text_chain,
  CASE WHEN endpoint_docs > 0 THEN endpoint_got / endpoint_docs END AS endpoint_document_recall, endpoint_got = endpoint_docs AND bridge_got < bridge_docs AS bridge_only_document_miss, CASE WHEN image_n > 0 THEN image_h / image_n END AS image_reference_claim_recall,
  CASE WHEN endpoint_n + bridge_n + supporting_n = 0 AND image_n > 0 THEN CASE WHEN image_h = image_n THEN 'image_reference_complete' ELSE 'image_reference_missing' END
    ELSE CASE (CASE WHEN endpoint_h < endpoint_n THEN 1 ELSE 0 END) + (CASE WHEN bridge_h < bridge_n THEN 1 ELSE 0 END) + (CASE WHEN supporting_h < supporting_n THEN 1 ELSE 0 END) WHEN 0 THEN 'complete' WHEN 1 THEN CASE WHEN endpoint_h < endpoint_n THEN 'endpoint_missing' WHEN bridge_h < bridge_n THEN 'bridge_missing' ELSE 'supporting_missing' END ELSE 'multiple_missing' END END AS path_status
  FROM counted JOIN got USING (run_id, question_id)),
asked_status AS (SELECT run_id, question_id, source AS chain_id, CASE WHEN question_id % 8 = 3 THEN 'request_error' ELSE 'ok' END AS status FROM asked JOIN sources USING (question_id) JOIN docs USING (document_key))
"""
_MEANS = ("endpoint_text_claim_recall", "bridge_text_claim_recall", "complete_core_bridge_chain")


def _bridges(x: Exam) -> DataFrame:
    side = lambda n: F.when(n % 3 == 0, "endpoint").when(n % 3 == 1, "bridge").otherwise("supporting")
    part = lambda n: F.concat_ws("-", F.col("document_key").cast("string"), side(F.col(n)))
    detail = x.detail.select("run_id", "question_id", "claim_id", F.when(F.col("question_id") % 6 == 0, "asset").otherwise("text").alias("kind"), part("claim_ord").alias("document_key"), F.coalesce(F.col("first_rank") <= PRIMARY_K, F.lit(False)).alias("hit"))
    parts = x.claims.select("question_id", part("claim_ord").alias("d"), side(F.col("claim_ord")).alias("role"))
    asked = parts.groupBy("question_id").agg(*(F.collect_set(F.when(F.col("role") == r, F.col("d"))).alias(f"{r}_documents") for r in bridge.ROLES))
    return bridge.bridge_metrics(detail, asked, x.chunks.where(F.col("rank") <= PRIMARY_K).select("run_id", "question_id", part("rank").alias("document_key")))


def _asked_status(x: Exam) -> DataFrame:
    own = x.sources.join(x.docs.select("document_key", "source"), "document_key")
    return x.asked.join(own, "question_id").select("run_id", "question_id", F.col("source").alias("chain_id"), F.when(F.col("question_id") % 8 == 3, "request_error").otherwise("ok").alias("status"))


@query("bridge_metrics", _BRIDGE + f"SELECT run_id, question_id, {', '.join(f'round({r}_text_claim_recall, 6) AS {r}_text_claim_recall' for r in bridge.ROLES)}, complete_core_bridge_chain, complete_declared_text_chain, round(endpoint_document_recall, 6) AS endpoint_document_recall, bridge_only_document_miss, round(image_reference_claim_recall, 6) AS image_reference_claim_recall, path_status FROM bm")
def bridge_metrics(x: Exam) -> DataFrame:
    return _bridges(x).select("run_id", "question_id", *(six(f"{r}_text_claim_recall") for r in bridge.ROLES), "complete_core_bridge_chain", "complete_declared_text_chain", six("endpoint_document_recall"), "bridge_only_document_miss", six("image_reference_claim_recall"), "path_status")


_FAILED_AS_ZERO = ", ".join(f"avg(CASE WHEN status <> 'ok' THEN 0.0 ELSE CAST({v} AS DOUBLE) END) AS {v}" for v in _MEANS)


@query("bridge_question_macro", _BRIDGE + f"SELECT run_id, {', '.join(f'round({v}, 6) AS {v}' for v in _MEANS)} FROM (SELECT run_id, {_FAILED_AS_ZERO} FROM asked_status LEFT JOIN bm USING (run_id, question_id) GROUP BY run_id)")
def bridge_question_macro(x: Exam) -> DataFrame:
    return bridge.question_macro(_asked_status(x), _bridges(x), _MEANS).select("run_id", *(six(v) for v in _MEANS))


@query("bridge_chain_macro", _BRIDGE + f"SELECT run_id, {', '.join(f'round(avg({v}), 6) AS {v}' for v in _MEANS)}, count(*) AS independent_chain_count FROM (SELECT run_id, chain_id, {_FAILED_AS_ZERO} FROM asked_status LEFT JOIN bm USING (run_id, question_id) GROUP BY run_id, chain_id) GROUP BY run_id")
def bridge_chain_macro(x: Exam) -> DataFrame:
    return bridge.chain_macro(_asked_status(x), _bridges(x), _MEANS).select("run_id", *(six(v) for v in _MEANS), "independent_chain_count")


@query("bridge_status_counts", _BRIDGE + "SELECT run_id, CASE WHEN status = 'ok' THEN path_status ELSE status END AS path_status, count(*) AS questions FROM asked_status LEFT JOIN bm USING (run_id, question_id) GROUP BY ALL")
def bridge_status_counts(x: Exam) -> DataFrame:
    return bridge.status_counts(_asked_status(x), _bridges(x))


@query("negatives_per_chain", "SELECT source AS chain_id, count(DISTINCT n.question_id) AS hard_negative_questions FROM negatives n JOIN sources s ON s.question_id = n.question_id JOIN docs d ON d.document_key = s.document_key GROUP BY 1")
def negatives_per_chain(x: Exam) -> DataFrame:
    own = x.sources.join(x.docs.select("document_key", "source"), "document_key").select("question_id", F.col("source").alias("chain_id"))
    return bridge.negatives_per_chain(own, x.negatives.select("question_id"))


@query(
    "multihop_by_chain",
    f"""SELECT run_id, k, chain_id, count(*) AS chain_questions, round(sum(endpoint_hits) / sum(endpoint_count), 6) AS endpoint_claim_recall, round(sum(bridge_hits) / sum(bridge_count), 6) AS bridge_claim_recall, round(avg(CASE WHEN endpoint_hits = endpoint_count AND bridge_hits < bridge_count THEN 1.0 ELSE 0.0 END), 6) AS bridge_only_miss_rate
FROM (SELECT *, unnest([coalesce(lang, ''), NULL]) AS chain_id FROM clustered WHERE endpoint_count + bridge_count > 0) GROUP BY ALL""",
)
def multihop_by_chain(x: Exam) -> DataFrame:
    got = aggregates.multihop_by_chain(aggregates.hop_split(x.clustered.withColumn("chain_id", F.col("lang"))))
    return got.select("run_id", "k", "chain_id", "chain_questions", six("endpoint_claim_recall"), six("bridge_claim_recall"), six("bridge_only_miss_rate"))


@query("sanity_pass_rate", "SELECT run_id, k, round(avg(CAST(complete AS INTEGER)), 6) AS pass_rate FROM metrics WHERE question_id % 2 = 0 GROUP BY ALL")
def sanity_pass_rate(x: Exam) -> DataFrame:
    return aggregates.pass_rate(x.metrics.where("question_id % 2 = 0")).select("run_id", "k", six("pass_rate"))


@query("ground_truth_documents", "SELECT question_id, count(DISTINCT document_key) AS gt_document_count FROM (SELECT question_id, document_key FROM claims UNION ALL SELECT question_id, document_key FROM negatives) GROUP BY 1")
def ground_truth_documents(x: Exam) -> DataFrame:
    """Of claims and negatives together, so that there is more than one."""
    return matching.ground_truth_documents(x.claims.select("question_id", "document_key").unionByName(x.negatives.select("question_id", "document_key")))


@query("iid_bootstrap", _with("SELECT metric, left_run, right_run, count(*) AS clusters, round(avg(delta), 6) AS mean, true AS inside FROM pairs GROUP BY ALL"))
def iid_bootstrap(x: Exam) -> DataFrame:
    """The interval over questions drawn alone; whether it holds the mean."""
    each = comparing.deltas(_values(x))
    by = ("metric", "left_run", "right_run")
    got = statistics.cluster_bootstrap(each, "question_id", "delta", by, 200, 7).join(each.groupBy(*by).agg(F.avg("delta").alias("mean")), list(by))
    return got.select(*by, "clusters", six("mean"), F.col("mean").between(F.col("low") - 1e-9, F.col("high") + 1e-9).alias("inside"))


_RUNS = """(VALUES ('a', 'mill', 'x', '{1}', 'completed', 'full', '7', false, 'e1'), ('b', 'mill', 'x', '{2}', 'aborted_auth', 'full', '7', true, 'e2'), ('c', 'weir', 'y', '{1}', 'completed', 'smoke', NULL, false, 'e1'), ('d', 'weir', 'x', '{1}', 'completed', 'full', 'unverified', false, 'e1'))
 t(run_id, profile, exam_sha256, request_config, run_status, run_scope, dataset_revision, git_dirty, evaluator_sha256)"""


def _runs(x: Exam) -> DataFrame:
    return x.spark.sql(f"select * from {_RUNS}".replace("(VALUES", "values").replace(")\n t(", "\n t("))


@query("run_blockers", f"""SELECT run_id, array_to_string(list_filter([CASE WHEN run_status <> 'completed' THEN 'run_not_completed' END, CASE WHEN run_scope <> 'full' THEN 'run_scope_not_full' END, CASE WHEN coalesce(dataset_revision, 'unverified') = 'unverified' THEN 'dataset_revision_unverified' END, CASE WHEN git_dirty THEN 'git_dirty' END], lambda b: b IS NOT NULL), ',') AS blockers FROM {_RUNS}""", False)
def run_blockers(x: Exam) -> DataFrame:
    return comparing.blockers(_runs(x)).select("run_id", F.concat_ws(",", "blockers").alias("blockers"))


@query("run_mismatches", f"SELECT 'exam_sha256' AS field, string_agg(DISTINCT exam_sha256, ',' ORDER BY exam_sha256) AS vals FROM {_RUNS} UNION ALL SELECT 'evaluator_sha256', string_agg(DISTINCT evaluator_sha256, ',' ORDER BY evaluator_sha256) FROM {_RUNS}", False)
def run_mismatches(x: Exam) -> DataFrame:
    return comparing.mismatched(_runs(x), (*comparing.FIELDS, *comparing.AUDITED)).select("field", F.concat_ws(",", "values").alias("vals"))


@query("config_conflicts", f"SELECT profile, count(DISTINCT request_config) AS configs FROM {_RUNS} GROUP BY 1 HAVING count(DISTINCT request_config) > 1", False)
def config_conflicts(x: Exam) -> DataFrame:
    return comparing.config_conflicts(_runs(x))


_BODY = """CASE question_id % 6 WHEN 0 THEN '{"records": []}' WHEN 1 THEN 'not json' WHEN 2 THEN '{"records": {"a": 1}}' WHEN 3 THEN '{"records": [{"segment": "x"}]}' WHEN 4 THEN '{"records": [{"segment": {}, "child_chunks": 3}]}' END"""


@query("response_faults", "SELECT 'A' AS run_id, CAST(question_id AS VARCHAR) AS question_id, 'schema_error' AS fault, CASE question_id % 6 WHEN 2 THEN 'records' WHEN 3 THEN 'segment' WHEN 4 THEN 'child_chunks' ELSE 'body' END AS message FROM passages WHERE question_id % 6 <> 0")
def response_faults(x: Exam) -> DataFrame:
    bodies = x.passages.select(F.lit("A").alias("run_id"), F.col("question_id").cast("string").alias("question_id"), F.expr(_BODY).alias("body"))
    return backends.faults(bodies, backends.load_profile("segments-api"))


@query("answered_statuses", "SELECT 'A' AS run_id, status, count(*) AS n FROM (SELECT CASE WHEN question_id % 9 = 4 THEN 'request_error' WHEN question_id % 6 = 0 THEN 'ok' ELSE 'schema_error' END AS status FROM passages) GROUP BY status")
def answered_statuses(x: Exam) -> DataFrame:
    """What checked() makes of responses that say ok."""
    given = x.passages.select(F.lit("A").alias("run_id"), F.col("question_id").cast("string").alias("question_id"), F.when(F.col("question_id") % 9 == 4, "request_error").otherwise("ok").alias("status"), F.expr(_BODY).alias("body"))
    return backends.checked(given, backends.load_profile("segments-api")).groupBy("run_id", "status").agg(F.count("*").alias("n"))


@query("segment_positions", "SELECT CAST(question_id AS VARCHAR) AS question_id, rank, rank * 3 + 1 AS server_top FROM (SELECT question_id, unnest([1, 2, 3]) AS rank FROM passages)")
def segment_positions(x: Exam) -> DataFrame:
    """The place that a segment says it has."""
    record = lambda i: F.struct(F.struct(F.lit(i * 3 + 1).alias("position")).alias("segment"))
    bodies = x.passages.select(F.lit("A").alias("run_id"), F.col("question_id").cast("string").alias("question_id"), F.to_json(F.struct(F.array(*(record(i) for i in (1, 2, 3))).alias("records"))).alias("body"))
    return backends.parsed(bodies, backends.load_profile("segments-api")).select("question_id", F.col("rank").cast("int").alias("rank"), F.col("server_top").cast("int").alias("server_top"))
