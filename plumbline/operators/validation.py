"""Exam validation: each rule gives violating rows (rule, subject, detail); an exam is valid without any."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.text import lexical_overlap, normalize_exact, occurrences
from plumbline.sources.exam import ExamTables

CHAIN = "cross_doc_chain"
#: A span whose share of bigrams in the question is above this overlaps it.
MAX_OVERLAP = 0.5


def _rule(name: str, df: DataFrame, subject: str | Column, detail: str | Column = "") -> DataFrame:
    subject = F.col(subject) if isinstance(subject, str) else subject
    detail = F.lit(detail) if isinstance(detail, str) else detail
    return df.select(F.lit(name).alias("rule"), subject.cast("string").alias("subject"), detail.cast("string").alias("detail"))


def _texts(corpus: DataFrame, rows: DataFrame) -> DataFrame:
    """document_key and text_norm of the documents that rows name: Spark normalises texts after this join, so that those of other documents are neither normalised nor shuffled."""
    return corpus.select("document_key", "text_norm").join(rows.select("document_key").distinct(), "document_key", "left_semi")


def span_rules(t: ExamTables, corpus: DataFrame) -> list[DataFrame]:
    """Spans exist in their documents, once; text claims have enough of them, none too long; none serves two questions."""
    named = t.spans.join(_texts(corpus, t.spans), "document_key", "left")
    count = F.coalesce(occurrences(F.col("text_norm"), F.col("span_norm")), F.lit(0))
    counted = named.join(t.claims.select("claim_id", "kind"), "claim_id").withColumn("n", count)
    limits = t.constraints.select("min_spans_per_claim", "max_span_normalized_len")
    few = t.spans.groupBy("claim_id").agg(F.count("*").alias("n"))
    few = t.claims.where("kind = 'text'").join(few, "claim_id", "left").join(limits, F.coalesce("n", F.lit(0)) < F.col("min_spans_per_claim"))
    long = counted.where("kind = 'text'").join(limits, F.length("span_norm") > F.col("max_span_normalized_len"))
    shared = t.spans.groupBy("document_key", "span_norm").agg(F.count_distinct("question_id").alias("q"), F.min("claim_id").alias("claim_id"), F.count("*").alias("n")).where("q > 1")
    repeated = t.spans.groupBy("question_id", "document_key", "span_norm").agg(F.count_distinct("claim_id").alias("n"), F.min("claim_id").alias("claim_id")).where("n > 1")
    return [
        _rule("span_missing", counted.where("n = 0"), "claim_id", F.col("span")),
        _rule("span_ambiguous", counted.where("n > 1"), "claim_id", F.concat_ws(" x ", "span", "n")),
        _rule("too_few_spans", few, "claim_id"),
        _rule("span_too_long", long, "claim_id", F.col("span")),
        _rule("span_reused", shared, "claim_id", F.col("span_norm")),
        _rule("span_reused", repeated, "claim_id", F.col("span_norm")),
        _rule("negative_missing", t.negatives.join(_texts(corpus, t.negatives), "document_key", "left").where(~F.coalesce(F.contains("text_norm", "span_norm"), F.lit(False))), "negative_id", F.col("span")),
    ]


def structure_rules(t: ExamTables) -> list[DataFrame]:
    """Clusters are declared, counts agree, minimums hold, and claims' documents are declared."""
    undeclared = t.questions.where("cluster_id is not null").join(t.clusters.select("cluster_id"), "cluster_id", "left_anti")
    actual = t.questions.agg(F.count("*").alias("total"), *(F.count_if(F.col("role") == r).alias(r) for r in ("scored", "sanity", "unanswerable", "diagnostic")))
    pairs = lambda df: df.select(F.explode(F.array(*(F.struct(F.lit(c).alias("what"), F.col(c).cast("bigint").alias("n")) for c in actual.columns))).alias("x")).select("x.*")
    wrong = pairs(t.counts).where("n is not null").join(pairs(actual).withColumnRenamed("n", "is"), "what").where("n <> is")
    by = []
    for column, declared in (("primary_type", "by_primary_type"), ("difficulty", "by_difficulty")):
        want = t.counts.where(F.col(declared).isNotNull()).select(F.explode(declared).alias("what", "n"))
        have = t.questions.groupBy(F.col(column).alias("what")).agg(F.count("*").alias("is"))
        both = want.join(have, "what", "full").where("coalesce(n, 0) <> coalesce(is, 0)").where(F.lit(True))
        any_declared = t.counts.where(F.col(declared).isNotNull()).select(F.lit(1).alias("one"))
        by.append(_rule("counts_differ", both.join(any_declared, how="left_semi", on=F.lit(True)), "what"))
    c = t.constraints
    low = t.questions.agg(F.count_if(F.array_contains("tags", "low_lexical_overlap")).alias("low"), F.count_if(F.col("role") == "sanity").alias("sanity"), F.count_if(F.col("role") == "unanswerable").alias("none"))
    hard = t.negatives.agg(F.count_distinct("question_id").alias("hard"))
    have = low.join(hard, how="cross").join(c, how="cross")  # one row each
    least = lambda what, n, limit: _rule("too_few", have.where(F.col(n) < F.col(limit)), F.lit(what))
    per = t.claims.groupBy("document_key").agg(F.count("*").alias("n"))
    every = t.documents.select("document_key").distinct().join(per, "document_key", "left").select("document_key", F.coalesce("n", F.lit(0)).alias("n"))
    total = t.claims.agg(F.count("*").alias("all"))
    share = every.join(total, how="cross").join(c, how="cross")
    undeclared_docs = t.claims.join(t.documents.select("document_key"), "document_key", "left_anti")
    return [
        _rule("cluster_undeclared", undeclared, "question_id", F.col("cluster_id")),
        _rule("counts_differ", wrong, "what", F.concat_ws(" is ", "n", "is")),
        *by,
        least("sanity", "sanity", "min_sanity_questions"),
        least("unanswerable", "none", "min_unanswerable_questions"),
        least("low_lexical_overlap", "low", "min_low_lexical_overlap_questions"),
        least("hard_negative", "hard", "min_hard_negative_questions"),
        _rule("too_few_claims", share.where("n < min_claims_per_document"), "document_key"),
        _rule("claim_share", share.where("n > max_claim_share_per_document * all"), "document_key"),
        _rule("document_undeclared", undeclared_docs, "claim_id", F.col("document_name")),
    ]


def overlap_rule(t: ExamTables, most: float = MAX_OVERLAP) -> DataFrame:
    """Questions tagged low_lexical_overlap whose wording shares too much with a span."""
    tagged = t.questions.where(F.array_contains("tags", "low_lexical_overlap")).select("question_id", normalize_exact("question").alias("q"))
    got = t.spans.join(tagged, "question_id").withColumn("share", lexical_overlap(F.col("q"), F.col("span_norm")))
    return _rule("overlap_not_low", got.where(F.col("share") > most), "question_id", F.col("span"))


def hop_rules(t: ExamTables, corpus: DataFrame) -> list[DataFrame]:
    """Chain questions: entities isolated and named, roles as declared, enough claims of each; others have no hops."""
    chain = t.questions.where(F.col("primary_type") == CHAIN)
    hops = chain.where("hop_design is not null").select("question_id", "question", "hop_design.*")
    ends = hops.select("question_id", "question", "bridge_documents", F.explode("endpoint_entities").alias("entity"))
    keys = F.explode("bridge_documents").alias("name")
    leak = ends.select("question_id", "entity", keys).join(corpus.select(F.col("name"), "text"), "name").where(F.contains("text", "entity"))
    unnamed = ends.where(~F.contains("question", "entity"))
    role = F.when(F.array_contains("bridge_documents", F.col("document_name")), "bridge").when(F.array_contains("endpoint_documents", F.col("document_name")), "endpoint")
    wrong = t.claims.join(hops, "question_id").withColumn("declared", role).where(~F.col("declared").eqNullSafe(F.col("hop_role")) & (F.coalesce("hop_role", F.lit("")) != "supporting"))
    n = t.claims.groupBy("question_id").agg(F.count_if(F.col("hop_role") == "bridge").alias("bridges"), F.count_if(F.col("hop_role") == "endpoint").alias("ends"))
    counted = chain.select("question_id").join(n, "question_id", "left").na.fill(0)
    hopped = t.claims.where("hop_role is not null").select("question_id").distinct()
    plain = t.questions.where(F.col("primary_type") != CHAIN)
    return [
        _rule("bridge_leaks_endpoint", leak, "question_id", F.col("entity")),
        _rule("endpoint_not_in_question", unnamed, "question_id", F.col("entity")),
        _rule("hop_role_mismatch", wrong, "claim_id", F.col("declared")),
        _rule("no_bridge_claim", counted.where("bridges < 1"), "question_id"),
        _rule("too_few_endpoints", counted.where("ends < 2"), "question_id"),
        _rule("hop_design_missing", chain.where("hop_design is null"), "question_id"),
        _rule("unexpected_hops", plain.where("hop_design is not null"), "question_id"),
        _rule("unexpected_hops", plain.join(hopped, "question_id", "left_semi"), "question_id"),
    ]


def chain_rules(t: ExamTables) -> list[DataFrame]:
    """Questions per chain as declared; relations as the chain's; negatives that share an entity with the chain."""
    asked = t.questions.where("chain_id is not null")
    relation = asked.where("relation_type is not null").join(t.chains.select("chain_id", F.col("relation_type").alias("declared")), "chain_id").where("relation_type <> declared")
    hard = t.negatives.join(asked.select("question_id", "chain_id"), "question_id").join(t.chains.select("chain_id", "bridge_entities"), "chain_id")
    strange = hard.where(~F.exists("bridge_entities", lambda e: F.contains(F.col("span"), e)))
    out = [_rule("relation_mismatch", relation, "question_id", F.col("declared")), _rule("negative_without_entity", strange, "negative_id")]
    n = t.chains.select("chain_id").join(asked.groupBy("chain_id").agg(F.count("*").alias("n")), "chain_id", "left").na.fill(0)
    want = t.exam.select(F.col("exam_meta.entity_bridge_design.questions_per_chain").alias("want")).where("want is not null")  # one row, or none
    out.append(_rule("questions_per_chain", n.join(want, F.col("n") != F.col("want")), "chain_id", F.col("n")))
    return out


def drift_rule(t: ExamTables, corpus: DataFrame) -> DataFrame:
    from plumbline.sources.corpus import drifted

    return _rule("corpus_drift", drifted(t.documents, corpus), "name", F.col("why"))


def image_rule(t: ExamTables, images: DataFrame) -> DataFrame:
    """Declared images that are missing or differ from the files. images: from read_images()."""
    from plumbline.sources.corpus import image_faults

    declared = t.exam.select(F.explode("exam_meta.corpus.image_assets").alias("i")).select("i.*")
    return _rule("image_fault", image_faults(declared, images), "name", F.col("why"))


def violations(t: ExamTables, corpus: DataFrame, allow_corpus_drift: bool = False, images: DataFrame | None = None) -> DataFrame:
    """All violations. corpus: name, document_key, sha256, text, text_norm; images: files beside it, if they are to be checked."""
    rules = [*span_rules(t, corpus), *structure_rules(t), overlap_rule(t), *hop_rules(t, corpus), *chain_rules(t)]
    if not allow_corpus_drift:
        rules.append(drift_rule(t, corpus))
    if images is not None:
        rules.append(image_rule(t, images))
    return reduce(DataFrame.unionByName, rules)


def facts(t: ExamTables, corpus: DataFrame) -> DataFrame:
    """One row about an exam: counts by role, claims, and whether its corpus has drifted."""
    roles = t.questions.groupBy("role").agg(F.count("*").alias("n")).agg(F.map_from_entries(F.collect_list(F.struct("role", "n"))).alias("role_counts"))
    chains = t.questions.where(F.col("primary_type") == CHAIN).groupBy("chain_id").agg(F.count("*").alias("n")).agg(F.map_from_entries(F.collect_list(F.struct("chain_id", "n"))).alias("chain_question_counts"))
    claims = t.claims.agg(F.count("*").alias("total_claims"))
    drift = drift_rule(t, corpus).agg((F.count("*") > 0).alias("corpus_drift"))
    return roles.join(chains, how="cross").join(claims, how="cross").join(drift, how="cross")  # one row each
