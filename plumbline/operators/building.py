"""Exam building: spans derived from a corpus, a ledger projected to an exam, gates and screening."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from plumbline.functions.text import non_ascii, normalize_exact, normalize_python, occurrences
from plumbline.operators import retrieval

MIN_SPAN, MAX_SPAN = 12, 40
MIN_SEPARATION = 300
#: Share of common bigrams above which two claims' evidence counts as alike.
ALIKE = 0.8

LEDGER = """ledger_version STRING, exam_id STRING, exam_title STRING, purpose STRING, corpus_snapshot_id STRING, corpus_relative_dir STRING,
retrieval_protocol STRUCT<primary_k: INT, eval_ks: ARRAY<INT>, request_k: INT, char_budgets: ARRAY<INT>, primary_budget: INT>,
families ARRAY<STRUCT<id: STRING, cluster_id: STRING, axis: STRING, title: STRING, documents: ARRAY<STRING>>>,
chains ARRAY<STRUCT<id: STRING, family: STRING, cluster_id: STRING, relation_type: STRING, path: STRING, endpoint_entities: ARRAY<STRING>, bridge_entities: ARRAY<STRING>, endpoint_documents: ARRAY<STRING>, bridge_documents: ARRAY<STRING>, documents: ARRAY<STRING>>>,
facts ARRAY<STRUCT<fact_id: STRING, family: STRING, cluster_id: STRING, kind: STRING, claim_type: STRING, dimension: STRING, chain_id: STRING, hop_role: STRING, values: MAP<STRING, STRING>, locations: MAP<STRING, ARRAY<STRUCT<section: STRING, locator: STRING>>>>>,
questions ARRAY<STRUCT<id: STRING, question_role: STRING, cluster_id: STRING, chain_id: STRING, difficulty: STRING, primary_type: STRING, tags: ARRAY<STRING>, question: STRING, reference_answer: STRING, diagnostic_reason: STRING, claims: ARRAY<STRUCT<fact_id: STRING, document: STRING>>, negatives: ARRAY<STRUCT<fact_id: STRING, document: STRING>>>>"""


class LedgerError(ValueError):
    """A ledger that can't be resolved."""


class BuildError(ValueError):
    """An exam that can't be built."""


def derived_span(raw: str, locator: str, least: int = MIN_SPAN, most: int = MAX_SPAN) -> tuple[str | None, str | None]:
    """(span, fault): the locator grown to a readable span of least to most normalised characters that occurs once.

    It grows to its line's bounds, at the next break of clause on either side first, and by single
    characters where a clause would be too long.
    """
    norm, own = normalize_python(raw), normalize_python(locator)
    n = norm.count(own) if own else 0
    if n == 0:
        return None, "missing"
    if n > 1:
        return None, f"occurs {n} times"
    if len(own) > most:
        return None, "too long"
    at = raw.find(locator)
    if at < 0:
        return (locator, None) if len(own) >= least else (None, "too short")
    breaks = "。；，、.;,!?！？\n"
    begin, end = at, at + len(locator)
    size = lambda a, b: len(normalize_python(raw[a:b]))
    while size(begin, end) < least:
        to = end
        while to < len(raw) and raw[to] != "\n" and (to == end or raw[to - 1] not in breaks):
            to += 1
        if to > end and size(begin, to) <= most:
            end = to
            continue
        back = begin
        while back > 0 and raw[back - 1] != "\n" and (back == begin or raw[back - 1] not in breaks):
            back -= 1
        if back < begin and size(back, end) <= most:
            begin = back
        elif end < len(raw) and raw[end] != "\n":
            end += 1
        elif begin > 0 and raw[begin - 1] != "\n":
            begin -= 1
        else:
            return None, "too short"
    span = raw[begin:end].strip()
    return (span, None) if norm.count(normalize_python(span)) == 1 else (None, "ambiguous after growth")


@F.pandas_udf(StructType([StructField("span", StringType()), StructField("fault", StringType())]))
def derive_span(raws, locators):  # noqa: ANN001, ANN201
    """derived_span() over Arrow batches: growth is a search, which expressions can't hold."""
    import pandas as pd

    return pd.DataFrame([derived_span(r or "", x or "") for r, x in zip(raws, locators, strict=True)], columns=["span", "fault"])


def locations(ledger: DataFrame) -> DataFrame:
    """One row for each location of each fact in each document."""
    fact = ledger.select(F.explode("facts").alias("f"))
    each = fact.select("f.fact_id", "f.family", "f.cluster_id", F.coalesce("f.kind", F.lit("text")).alias("kind"), "f.claim_type", "f.dimension", "f.chain_id", "f.hop_role", F.col("f.values").alias("facts_values"), F.explode("f.locations").alias("document", "places"))
    each = each.withColumn("value", F.col("facts_values")[F.col("document")]).drop("facts_values")
    return each.select("*", F.posexplode("places").alias("place", "p")).select("*", "p.section", "p.locator").drop("p", "places")


def resolved(ledger: DataFrame, corpus: DataFrame) -> DataFrame:
    """locations() with span, normalized_length and fault; an asset's span is its locator as it is. corpus: name, text."""
    each = locations(ledger).join(corpus.select(F.col("name").alias("document"), "text"), "document", "left")
    made = derive_span("text", "locator")
    out = each.withColumn("__m", made).drop("text")
    asset = F.col("kind") == "asset"
    out = out.withColumn("span", F.when(asset, F.col("locator")).otherwise(F.col("__m.span"))).withColumn("fault", F.when(~asset, F.col("__m.fault"))).drop("__m")
    return out.withColumn("normalized_length", F.length(normalize_exact("span")))


def check_resolved(places: DataFrame) -> None:
    """Raises LedgerError for faults, and for text facts with fewer than two locations in a document."""
    bad = places.where("fault is not null").select("fact_id", "document", "locator", "fault").orderBy("fact_id", "document", "place").limit(20).collect()
    if bad:
        raise LedgerError("; ".join(f"{r['fact_id']} in {r['document']}: {r['locator']!r} {r['fault']}" for r in bad))
    few = places.where("kind = 'text'").groupBy("fact_id", "document").count().where("count < 2").orderBy("fact_id").limit(20).collect()
    if few:
        raise LedgerError("; ".join(f"{r['fact_id']} in {r['document']}: at least 2 locations" for r in few))


def _claimed(ledger: DataFrame, places: DataFrame, what: str, suffix: str) -> DataFrame:
    asked = ledger.select(F.explode("questions").alias("q")).select(F.col("q.id").alias("question_id"), F.posexplode(f"q.{what}").alias("ord", "c"))
    asked = asked.select("question_id", "ord", "c.fact_id", "c.document")
    spans = places.groupBy("fact_id", "document").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("place", "span"))), lambda x: x["span"]).alias("accepted_spans"),
        F.min_by("section", "place").alias("section"),
        *(F.first(c, ignorenulls=True).alias(c) for c in ("kind", "claim_type", "hop_role", "value")),
    )
    return asked.join(spans, ["fact_id", "document"], "left").withColumn("id", F.concat("question_id", F.lit(f"_{suffix}"), F.col("ord") + 1))


def built(ledger: DataFrame, places: DataFrame, corpus: DataFrame) -> DataFrame:
    """The exam as one row of schema 4.1, from a ledger and its resolved locations. Deterministic: all lists are ordered."""
    if "span" not in places.columns:
        raise BuildError("the ledger isn't resolved")
    claims, negatives = _claimed(ledger, places, "claims", "c"), _claimed(ledger, places, "negatives", "n")
    unknown = claims.unionByName(negatives).where("accepted_spans is null").select("question_id", "fact_id", "document").orderBy("question_id").limit(20).collect()
    if unknown:
        raise BuildError("; ".join(f"{r['question_id']}: undefined fact {r['fact_id']} in {r['document']}" for r in unknown))
    listed = lambda df, *cols: df.groupBy("question_id").agg(F.array_sort(F.collect_list(F.struct("ord", *cols))).alias("x"))
    source = F.col("document").alias("source_document")
    mine = listed(claims, "id", "kind", "claim_type", source, "section", "accepted_spans", "hop_role").withColumnRenamed("x", "cs")
    theirs = listed(negatives, "id", source, "section", "accepted_spans").withColumnRenamed("x", "ns")
    each = ledger.select(F.posexplode("questions").alias("at", "q")).select("at", "q.*").withColumnRenamed("id", "question_id").drop("claims", "negatives")
    chains = ledger.select(F.explode("chains").alias("h")).select(F.col("h.id").alias("chain_id"), F.struct(F.col("h.id").alias("chain_id"), "h.relation_type", "h.endpoint_entities", "h.endpoint_documents", "h.bridge_documents", "h.bridge_entities").alias("hop_design"))
    got = each.join(mine, "question_id", "left").join(theirs, "question_id", "left").join(chains, "chain_id", "left")
    strip = lambda c, *names: F.coalesce(F.transform(c, lambda x: F.struct(*(x[n].alias(n) for n in names))), F.expr("array()"))
    question = F.struct(
        F.col("question_id").alias("id"), "question_role", "cluster_id", "difficulty", "primary_type", "tags", "question", "reference_answer", "diagnostic_reason",
        F.when(F.col("question_role") == "unanswerable", "no_relevant_evidence").alias("expected_behavior"),
        strip("cs", "id", "kind", "claim_type", "source_document", "section", "accepted_spans", "hop_role").alias("claims"),
        F.coalesce(F.transform("cs", lambda x: x["id"]), F.array().cast("array<string>")).alias("evidence_chain"),
        strip("ns", "id", "source_document", "section", "accepted_spans").alias("negative_evidence"), "hop_design",
    )
    counts = lambda c: F.map_from_entries(F.array_sort(F.collect_list(F.struct(c, "n"))))
    by = {name: got.groupBy(c).agg(F.count("*").alias("n")).agg(counts(c).alias(name)) for c, name in (("primary_type", "by_primary_type"), ("difficulty", "by_difficulty"))}
    rows = got.agg(
        F.transform(F.array_sort(F.collect_list(F.struct("at", question.alias("q")))), lambda x: x["q"]).alias("questions"),
        F.count("*").alias("total"), *(F.count_if(F.col("question_role") == r).alias(r) for r in ("scored", "sanity", "unanswerable")),
    )
    clusters = ledger.select(
        F.concat(
            F.transform("families", lambda f: F.struct(f["cluster_id"].alias("id"), f["id"].alias("family"), f["axis"].alias("axis"), f["documents"].alias("documents"))),
            F.transform(F.coalesce("chains", F.expr("array()")), lambda h: F.struct(h["cluster_id"].alias("id"), h["family"].alias("family"), F.lit("entity_bridge").alias("axis"), h["documents"].alias("documents"))),
        ).alias("clusters"),
        F.transform("chains", lambda h: F.struct(h["id"].alias("id"), h["family"].alias("family"), h["relation_type"].alias("relation_type"), h["bridge_entities"].alias("bridge_entities"), h["documents"].alias("documents"))).alias("bridge_chains"),
        "exam_id", F.col("exam_title").alias("title"), "retrieval_protocol", F.col("corpus_snapshot_id").alias("snapshot_id"), F.col("corpus_relative_dir").alias("relative_dir"),
    )
    used = ledger.select(F.array_distinct(F.flatten(F.concat(F.transform("families", lambda f: f["documents"]), F.transform("chains", lambda h: h["documents"])))).alias("names")).select(F.explode("names").alias("name"))
    docs = corpus.join(used, "name", "left_semi").agg(F.array_sort(F.collect_list(F.struct("name", "sha256"))).alias("documents"))
    one = rows.join(by["by_primary_type"], how="cross").join(by["by_difficulty"], how="cross").join(clusters, how="cross").join(docs, how="cross")  # one row each
    question_counts = F.struct("total", "scored", "sanity", "unanswerable", "by_primary_type", "by_difficulty").alias("question_counts")
    meta = F.struct("exam_id", "title", "retrieval_protocol", question_counts, "clusters", "bridge_chains", F.struct("snapshot_id", "relative_dir", "documents").alias("corpus"))
    return one.select(F.lit("4.1").alias("schema_version"), meta.alias("exam_meta"), "questions")


def _problem(gate: str, df: DataFrame, subject: str) -> DataFrame:
    return df.select(F.lit(gate).alias("gate"), F.col(subject).cast("string").alias("subject")).distinct()


def audit(tables, places: DataFrame, ledger: DataFrame, corpus: DataFrame, min_separation: int = MIN_SEPARATION, alike: float = ALIKE) -> DataFrame:  # noqa: ANN001
    """gate, subject of the problems of an exam (ExamTables) against its ledger; clean without rows."""
    t = tables
    positive = t.claims.select("question_id", "document_key").distinct()
    g4 = t.negatives.join(positive, ["question_id", "document_key"], "left_semi")
    asked = ledger.select(F.explode("questions").alias("q")).select(F.col("q.id").alias("question_id"), F.explode("q.claims").alias("c")).select("question_id", "c.*")
    worth = asked.join(places.where("kind <> 'asset'").select("fact_id", "document", "value").distinct(), ["fact_id", "document"])
    both = worth.join(t.questions.select("question_id", "question", "reference_answer", "hop_design", "primary_type"), "question_id")
    g5 = both.where(~F.coalesce(F.contains(normalize_exact("reference_answer"), normalize_exact("value")), F.lit(False)))
    g6 = both.where(F.contains(normalize_exact("question"), normalize_exact("value")))
    g8 = t.documents.where(non_ascii(F.col("name")))
    hops = t.questions.where("hop_design is not null").select("question_id", "hop_design.*")
    leak = hops.select("question_id", F.explode("bridge_documents").alias("name"), "endpoint_entities").join(corpus.select("name", "text"), "name")
    g10 = leak.where(F.exists("endpoint_entities", lambda e: F.contains(F.col("text"), e)))
    one = t.spans.join(hops.select("question_id"), "question_id", "left_semi")
    left, right = one.select("question_id", F.col("claim_id").alias("a"), F.col("span_norm").alias("s")), one.select("question_id", F.col("claim_id").alias("b"), F.col("span_norm").alias("z"))
    from plumbline.functions.text import grams

    same = F.try_divide(F.size(F.array_intersect(grams(F.col("s")), grams(F.col("z")))), F.size(F.array_union(grams(F.col("s")), grams(F.col("z")))))
    g11 = left.join(right, "question_id").where("a < b").where(same >= alike)
    role = F.when(F.array_contains("bridge_documents", F.col("document_name")), "bridge").when(F.array_contains("endpoint_documents", F.col("document_name")), "endpoint")
    g12 = t.claims.join(hops, "question_id").where(~role.eqNullSafe(F.col("hop_role")))
    gates = [_problem("G4", g4, "question_id"), _problem("G5", g5, "question_id"), _problem("G6", g6, "question_id"), _problem("G8", g8, "name"), _problem("G10", g10, "question_id"), _problem("G11", g11, "question_id"), _problem("G12", g12, "claim_id")]
    gates.append(_problem("separation", crowded(places, corpus, min_separation), "fact_id"))
    return reduce(DataFrame.unionByName, gates)


def crowded(places: DataFrame, corpus: DataFrame, min_separation: int = MIN_SEPARATION) -> DataFrame:
    """Facts with two locations in a document that are fewer than min_separation characters apart."""
    at = places.where("kind = 'text' and span is not null").join(corpus.select(F.col("name").alias("document"), "text"), "document")
    at = at.withColumn("begin", F.instr("text", F.col("span"))).where("begin > 0")
    before = F.lag("begin").over(W.partitionBy("fact_id", "document").orderBy("begin"))
    return at.withColumn("gap", F.col("begin") - before).where(F.col("gap") < min_separation)


def screen(tables, corpus: DataFrame, window: int = 200, overlap: int = 50, top_k: int = 10, least: int = 1) -> DataFrame:  # noqa: ANN001
    """Per question with claims: baseline recall by BM25, trivial (all found), floor_suspicious (none, though not of low overlap), bridge_reachable.

    Terms of texts without spaces are their character bigrams, so that the baseline works in any language.
    """
    t = tables
    windows = retrieval.chunk_windows(corpus.select("document_key", "text"), window, overlap)
    spaced = lambda c: F.concat_ws(" ", retrieval.terms(F.col(c)), F.transform(_bigrams(c), lambda g: g))
    chunks = windows.withColumn("whole", F.col("content")).withColumn("content", spaced("content"))
    asked = t.questions.join(t.claims.select("question_id").distinct(), "question_id", "left_semi")
    found = retrieval.bm25(chunks, asked.select("question_id", spaced("question").alias("question")), top_k, least)
    top = retrieval.with_content(found, corpus, window, overlap).withColumn("content_norm", normalize_exact("content"))
    hit = top.join(t.spans, ["question_id", "document_key"]).where(F.contains("content_norm", "span_norm")).select("question_id", "claim_id").distinct().withColumn("hit", F.lit(1))
    per = t.claims.join(hit, ["question_id", "claim_id"], "left").groupBy("question_id").agg(F.count("*").alias("claims"), F.count("hit").alias("hits"))
    bridge = t.claims.where("hop_role = 'bridge'").select("question_id", "document_key").join(found.select("question_id", "document_key"), ["question_id", "document_key"], "left_semi").select("question_id").distinct().withColumn("__b", F.lit(True))
    got = asked.select("question_id", "role", "tags", "primary_type").join(per, "question_id").join(bridge, "question_id", "left")
    low = F.array_contains("tags", "low_lexical_overlap")
    return got.select(
        "question_id", "role", "claims", "hits", (F.col("hits") / F.col("claims")).alias("baseline_recall"),
        ((F.col("role") == "scored") & (F.col("hits") == F.col("claims"))).alias("trivial"), ((F.col("hits") == 0) & ~low).alias("floor_suspicious"), F.coalesce("__b", F.lit(False)).alias("bridge_reachable"),
    )


def _bigrams(c: str):  # noqa: ANN202
    """Bigrams of characters beyond Latin script, in order."""
    wide = F.regexp_extract_all(F.col(c), F.lit(r"[぀-鿿]{2,}"), F.lit(0))
    return F.flatten(F.transform(wide, lambda w: F.transform(F.sequence(F.lit(1), F.length(w) - 1), lambda i: F.substr(w, i, F.lit(2)))))


def unique_spans(places: DataFrame, corpus: DataFrame) -> DataFrame:
    """Places whose span doesn't occur exactly once in its document's normalised text."""
    got = places.join(corpus.select(F.col("name").alias("document"), "text_norm"), "document")
    return got.where(occurrences(F.col("text_norm"), normalize_exact("span")) != 1)
