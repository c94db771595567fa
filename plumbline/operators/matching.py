"""Evidence matching: claims' spans against retrieved chunks.

Tables: chunks(run_id, question_id, rank, score, document_key, chunk_id, content_norm, norm_len),
spans(question_id, claim_id, document_key, span_index, span_norm), claims(question_id, claim_id,
claim_ord, claim_type, kind, hop_role, document_key), negatives(question_id, document_key, span_norm).
A span is matched once; the K grid and the budgets read the first rank from the result. The joins
are equi-joins on question and document, and containment is their remaining condition.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plumbline.functions.text import within_budget

QUESTION = ["run_id", "question_id"]


def ranked_records(records: DataFrame, position: str = "pos") -> DataFrame:
    """rank: the response order from 1, of records exploded with their positions."""
    return records.withColumn("rank", F.col(position) + 1)


def first_hits(chunks: DataFrame, spans: DataFrame, content: str = "content_norm") -> DataFrame:
    """run_id, question_id, claim_id with first_rank, span_index and chunk_id of the first chunk that holds a span of the claim."""
    met = chunks.join(spans, ["question_id", "document_key"]).where(F.contains(F.col(content), F.col("span_norm")))
    first = F.min(F.struct("rank", "span_index", "chunk_id"))
    return met.groupBy(*QUESTION, "claim_id").agg(first.alias("f")).select(*QUESTION, "claim_id", F.col("f.rank").alias("first_rank"), "f.span_index", "f.chunk_id")


def claim_detail(asked: DataFrame, claims: DataFrame, hits: DataFrame) -> DataFrame:
    """Every claim of every asked question (run_id, question_id), with first_rank or null."""
    return asked.join(claims, "question_id").join(hits, [*QUESTION, "claim_id"], "left")


def document_hits(chunks: DataFrame, claims: DataFrame, k: int) -> DataFrame:
    """run_id, question_id, claim_id of claims whose document is in the top k."""
    top = chunks.where(F.col("rank") <= k).select(*QUESTION, "document_key").distinct()
    return claims.join(top, ["question_id", "document_key"]).select(*QUESTION, "claim_id").distinct()


def document_hit_claim_miss(detail: DataFrame, chunks: DataFrame, claims: DataFrame, k: int) -> DataFrame:
    """detail with document_hit_claim_miss: the document came, the evidence didn't."""
    hit = F.coalesce(F.col("first_rank") <= k, F.lit(False))
    came = document_hits(chunks, claims, k).withColumn("__came", F.lit(True))
    return detail.join(came, [*QUESTION, "claim_id"], "left").withColumn("document_hit_claim_miss", F.coalesce("__came", F.lit(False)) & ~hit).drop("__came")


def grid(detail: DataFrame, ks: list[int]) -> DataFrame:
    """detail for every k, with hit."""
    return detail.withColumn("k", F.explode(F.array(*map(F.lit, ks)))).withColumn("hit", F.coalesce(F.col("first_rank") <= F.col("k"), F.lit(False)))


def question_metrics(detail: DataFrame, ks: list[int]) -> DataFrame:
    """Per run, question and k: hits, claims, recall, whether the chain is complete, the rank score, and hits by type and role."""
    of = lambda c: F.sum(c.cast("int"))
    both = {"anchor": F.col("claim_type") == "anchor", "passage": F.col("claim_type") == "passage", "endpoint": F.col("hop_role") == "endpoint", "bridge": F.col("hop_role") == "bridge"}
    split = [x for name, is_it in both.items() for x in (F.count_if(is_it).alias(f"{name}_count"), F.count_if(is_it & F.col("hit")).alias(f"{name}_hits"))]
    return (
        grid(detail, ks)
        .groupBy(*QUESTION, "k")
        .agg(of(F.col("hit")).alias("claim_hits"), F.count("*").alias("claim_count"), F.bool_and("hit").alias("complete"), F.avg(rank_worth()).alias("novel_claim_rank_score"), *split)
        .withColumn("claim_recall", F.try_divide("claim_hits", "claim_count"))
    )


def rank_worth() -> Column:
    """What a claim's first hit is worth: 1 / log2(1 + rank); 1 at rank 1, a half at rank 3, nothing without a hit."""
    return F.when(F.col("hit"), F.lit(1.0) / F.log2(F.col("first_rank") + 1)).otherwise(0.0)


def novel_claims(detail: DataFrame) -> DataFrame:
    """The rank at which each claim is new, in the order of ranks; repeats add nothing."""
    order = W.partitionBy(*QUESTION).orderBy("first_rank", "claim_ord")
    return detail.where("first_rank is not null").withColumn("nth", F.row_number().over(order))


def duplicate_documents(chunks: DataFrame, k: int) -> DataFrame:
    """duplicate_document_rate: of the chunks in the top k, those beyond each document's first."""
    top = chunks.where(F.col("rank") <= k)
    got = top.groupBy(*QUESTION).agg(F.count("*").alias("returned"), F.countDistinct("document_key").alias("documents"))
    return got.withColumn("duplicate_document_rate", (F.col("returned") - F.col("documents")) / F.col("returned"))


def off_target(chunks: DataFrame, targets: DataFrame, k: int) -> DataFrame:
    """off_target_chunk_rate: of the returned chunks in the top k, those of no target document (question_id, document_key)."""
    top = chunks.where(F.col("rank") <= k)
    mark = targets.select("question_id", "document_key").distinct().withColumn("__on", F.lit(True))
    got = top.join(mark, ["question_id", "document_key"], "left")
    off = F.sum(F.when(F.col("__on"), 0).otherwise(1))
    return got.groupBy(*QUESTION).agg(off.alias("off_target"), F.count("*").alias("returned")).withColumn("off_target_chunk_rate", F.col("off_target") / F.col("returned"))


def intrusion(asked: DataFrame, chunks: DataFrame, negatives: DataFrame, k: int) -> DataFrame:
    """hard_negative_intrusion: whether the top k holds negative evidence; of questions that declare some."""
    met = chunks.where(F.col("rank") <= k).join(negatives, ["question_id", "document_key"]).where(F.contains("content_norm", "span_norm"))
    bad = met.select(*QUESTION).distinct().withColumn("__bad", F.lit(True))
    own = asked.join(negatives.select("question_id").distinct(), "question_id", "left_semi")
    return own.join(bad, QUESTION, "left").select(*QUESTION, F.coalesce("__bad", F.lit(False)).alias("hard_negative_intrusion"))


def budget_recall(asked: DataFrame, chunks: DataFrame, claims: DataFrame, spans: DataFrame, budgets: list[int]) -> DataFrame:
    """Per run, question and budget: hits, claims and recall when normalised characters are spent in order of rank."""
    before = F.coalesce(F.sum("norm_len").over(W.partitionBy(*QUESTION).orderBy("rank").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    spent = chunks.withColumn("__before", before)
    each = spent.withColumn("budget", F.explode(F.array(*map(F.lit, budgets)))).where("__before < budget")
    each = each.withColumn("__cut", within_budget(F.col("content_norm"), F.col("__before"), F.col("budget")))
    met = each.join(spans, ["question_id", "document_key"]).where(F.contains("__cut", "span_norm"))
    hit = met.select(*QUESTION, "budget", "claim_id").distinct().withColumn("__hit", F.lit(1))
    every = asked.join(claims.select("question_id", "claim_id"), "question_id").withColumn("budget", F.explode(F.array(*map(F.lit, budgets))))
    got = every.join(hit, [*QUESTION, "budget", "claim_id"], "left").groupBy(*QUESTION, "budget").agg(F.count("__hit").alias("claim_hits"), F.count("*").alias("claim_count"))
    return got.withColumn("claim_recall", F.try_divide("claim_hits", "claim_count"))


def ranking_anomaly(chunks: DataFrame) -> DataFrame:
    """Whether a score rises down a run's list."""
    above = F.lag("score").over(W.partitionBy(*QUESTION).orderBy("rank"))
    got = chunks.withColumn("__above", above)
    return got.groupBy(*QUESTION).agg(F.coalesce(F.bool_or(F.col("__above") < F.col("score")), F.lit(False)).alias("ranking_anomaly"))


def relevance_counterfactual(chunks: DataFrame) -> DataFrame:
    """chunks with counterfactual_rank by falling score; null for a list in which a score is missing."""
    own = W.partitionBy(*QUESTION)
    order = own.orderBy(F.desc("score"), "rank")
    missing = F.count_if(F.col("score").isNull()).over(own) > 0
    return chunks.withColumn("counterfactual_rank", F.when(~missing, F.row_number().over(order)))


def aliased(chunks: DataFrame, aliases: DataFrame) -> DataFrame:
    """chunks with names and keys replaced by aliases(document_name, to_name)."""
    from plumbline.functions.text import document_key

    got = chunks.join(aliases, "document_name", "left")
    return got.withColumn("document_name", F.coalesce("to_name", "document_name")).withColumn("document_key", document_key("document_name")).drop("to_name").select(*chunks.columns)


def unmatched_documents(chunks: DataFrame, declared: DataFrame) -> DataFrame:
    """Documents that runs returned and the exam doesn't declare."""
    return chunks.select("run_id", "document_key").distinct().join(declared.select("document_key").distinct(), "document_key", "left_anti")


def names_match(chunks: DataFrame, declared: DataFrame) -> bool:
    """The preflight gate: whether any returned document is declared."""
    return not chunks.join(declared.select("document_key").distinct(), "document_key", "left_semi").isEmpty()


def parent_child(chunks: DataFrame) -> DataFrame:
    """Counts of records with children, and of children, for backends that return them."""
    n = F.coalesce(F.size("child_chunks"), F.lit(0))
    return chunks.groupBy(*QUESTION).agg(F.count_if(n > 0).alias("parents"), F.sum(F.greatest(n, F.lit(0))).alias("children"))


def parent_records(chunks: DataFrame) -> DataFrame:
    """A row for each record with children: its rank, the parent chunk, and how many children it has with their best score. Scoring reads the parent's content."""
    own = chunks.where(F.size("child_chunks") > 0)
    return own.select(*QUESTION, "rank", F.col("chunk_id").alias("parent_chunk_id"), F.size("child_chunks").alias("child_chunk_count"), F.array_max(F.transform("child_chunks", lambda c: c["score"])).alias("best_child_score"))


def ground_truth_documents(claims: DataFrame) -> DataFrame:
    """question_id and gt_document_count: how many documents a question's claims come from."""
    return claims.groupBy("question_id").agg(F.count_distinct("document_key").alias("gt_document_count"))
