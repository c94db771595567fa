"""An exam, runs and a corpus, derived from the driver's tables.

Questions are the rows of benchmark; the documents that contain a passage answer it, the least one
is its declared source; passages that no document contains are unanswerable. Claims are a passage's
sentences of 12 characters or more. Run A ranks chunk windows by shared terms of 6 characters or
more, run B by terms of 8 or more with a score of 2 or more, run C is A's list in the order of a hash.
"""

from __future__ import annotations

from functools import cached_property, reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plumbline.functions.text import normalize_sql, normalize_text
from plumbline.operators import matching, retrieval
from plumbline.operators.shared import written

KS = [1, 3, 5, 10]
PRIMARY_K = 5
BUDGETS = [200, 400, 1000]


class Exam:
    """The derived tables of one folder of driver tables; each is a plan, built when asked for.

    Those that most plans read several times are written when they are first asked for, so that each takes its passes
    over the texts once, and joins with documents know that they are small.
    """

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.sf_dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @property
    def docs(self) -> DataFrame:
        return self.table("documents").select(F.col("doc_id").alias("document_key"), F.coalesce("text", F.lit("")).alias("text"), "lang", "source")

    @property
    def passages(self) -> DataFrame:
        return self.table("benchmark").select(F.col("item_id").alias("question_id"), F.col("text").alias("passage"))

    @cached_property
    def truth(self) -> DataFrame:
        """question_id, document_key of all documents that contain the passage."""
        return written(retrieval.containing(self.docs.select("document_key", "text"), self.passages), "truth")

    @property
    def sources(self) -> DataFrame:
        """question_id, document_key: the declared source."""
        return self.truth.groupBy("question_id").agg(F.min("document_key").alias("document_key"))

    @property
    def questions(self) -> DataFrame:
        got = self.passages.join(self.sources.withColumnRenamed("document_key", "source_key"), "question_id", "left")
        return got.select("question_id", F.col("passage").alias("question"), "source_key", F.when(F.col("source_key").isNull(), "unanswerable").otherwise("scored").alias("role"))

    @cached_property
    def claims(self) -> DataFrame:
        """Claims of answerable questions, with first and last sentences as endpoints where there are three or more."""
        parts = F.filter(F.split("passage", r"\. |\n"), lambda s: F.length(s) >= 12)
        each = self.passages.select("question_id", F.size(parts).alias("n"), F.posexplode(parts).alias("claim_ord", "span"))
        edge = (F.col("claim_ord") == 0) | (F.col("claim_ord") == F.col("n") - 1)
        role = F.when(F.col("n") >= 3, F.when(edge, "endpoint").otherwise("bridge"))
        kind = F.when(F.col("claim_ord") == 0, "anchor").otherwise("passage")
        each = each.select("question_id", F.concat_ws("_c", "question_id", F.col("claim_ord") + 1).alias("claim_id"), "claim_ord", "span", kind.alias("claim_type"), role.alias("hop_role"))
        return written(each.join(self.sources, "question_id"), "claims")

    @property
    def spans(self) -> DataFrame:
        return self.claims.select("question_id", "claim_id", "document_key", F.lit(0).alias("span_index"), normalize_text("span").alias("span_norm"))

    @property
    def windows(self) -> DataFrame:
        return retrieval.chunk_windows(self.docs)

    @cached_property
    def chunks(self) -> DataFrame:
        """The retrieved chunks of runs A, B and C."""
        asked = self.passages.withColumnRenamed("passage", "question")
        ties = ("document_key", "chunk_no")
        best = written(retrieval.overlap_best(self.windows, asked, {"A": 6, "B": 8}), "best").withColumnRenamed("list", "run_id")
        a, b = best.where("run_id = 'A'"), best.where("run_id = 'B' and score >= 2")
        c = a.withColumn("run_id", F.lit("C")).withColumn("rank", F.row_number().over(W.partitionBy("question_id").orderBy(F.md5(F.concat_ws(":", "question_id", *ties)))))
        got = retrieval.with_content(reduce(DataFrame.unionByName, (a, b, c)), self.docs)
        norm = normalize_text("content")
        return written(got.select("run_id", "question_id", "rank", "score", "document_key", F.concat_ws(":", *ties).alias("chunk_id"), norm.alias("content_norm"), F.length(norm).alias("norm_len")), "chunks")

    @property
    def runs(self) -> DataFrame:
        return self.spark.sql("select * from values ('A'), ('B'), ('C') as t(run_id)")

    @property
    def asked(self) -> DataFrame:
        """run_id, question_id of answerable questions."""
        return self.sources.select("question_id").join(self.runs, how="cross")

    @property
    def detail(self) -> DataFrame:
        return matching.claim_detail(self.asked, self.claims, matching.first_hits(self.chunks, self.spans))

    @property
    def metrics(self) -> DataFrame:
        return matching.question_metrics(self.detail, KS)

    @property
    def clustered(self) -> DataFrame:
        """metrics with lang, source and cluster_id (the source) of the question's document."""
        own = self.sources.join(self.docs.drop("text"), "document_key").select("question_id", "lang", "source")
        return self.metrics.join(own, "question_id").withColumn("cluster_id", F.col("source"))

    @cached_property
    def negatives(self) -> DataFrame:
        """The best of run B's documents that don't hold the passage, with the first 40 normalised characters."""
        b = self.chunks.where("run_id = 'B'").select("question_id", "document_key", "rank")
        off = b.join(self.truth, ["question_id", "document_key"], "left_anti").groupBy("question_id").agg(F.min_by("document_key", "rank").alias("document_key"))
        text = off.join(self.docs.select("document_key", "text"), "document_key").withColumn("span_norm", F.left(normalize_text("text"), F.lit(40)))
        # Written before the filter, which Spark would push below the join, so that all texts were normalised.
        return written(text.select("question_id", "document_key", "span_norm"), "negatives").where("span_norm <> ''")


#: The same tables in DuckDB SQL, as common table expressions.
CTE = f"""
docs AS (SELECT doc_id AS document_key, coalesce(text, '') AS text, lang, source FROM documents),
passages AS (SELECT item_id AS question_id, text AS passage FROM benchmark),
truth AS (SELECT question_id, document_key FROM passages JOIN docs ON contains(docs.text, passages.passage)),
sources AS (SELECT question_id, min(document_key) AS document_key FROM truth GROUP BY 1),
parts AS (SELECT question_id, list_filter(string_split_regex(passage, '\\. |\\n'), lambda s: length(s) >= 12) AS ps FROM passages),
sentences AS (SELECT question_id, len(ps) AS n, unnest(ps) AS span, generate_subscripts(ps, 1) - 1 AS claim_ord FROM parts),
claims AS (SELECT s.question_id, s.question_id || '_c' || (claim_ord + 1) AS claim_id, claim_ord, span,
  CASE WHEN claim_ord = 0 THEN 'anchor' ELSE 'passage' END AS claim_type,
  CASE WHEN n >= 3 THEN CASE WHEN claim_ord = 0 OR claim_ord = n - 1 THEN 'endpoint' ELSE 'bridge' END END AS hop_role,
  document_key FROM sentences s JOIN sources USING (question_id)),
spans AS (SELECT question_id, claim_id, document_key, 0 AS span_index, {normalize_sql("span")} AS span_norm FROM claims),
windows AS (SELECT document_key, chunk_no, substring(text, chunk_no * 150 + 1, 200) AS content FROM
  (SELECT document_key, text, unnest(range(CAST(ceil(length(text) / 150.0) AS BIGINT))) AS chunk_no FROM docs)),
chunk_terms AS (SELECT DISTINCT document_key, chunk_no, term FROM
  (SELECT document_key, chunk_no, unnest(string_split_regex(lower(content), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')) AS term FROM windows) WHERE length(term) >= 6),
asked_terms AS (SELECT DISTINCT question_id, term FROM
  (SELECT question_id, unnest(string_split_regex(lower(passage), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')) AS term FROM passages) WHERE length(term) >= 6),
met AS (SELECT question_id, document_key, chunk_no, CAST(count(*) AS DOUBLE) AS sa, CAST(count(*) FILTER (length(term) >= 8) AS DOUBLE) AS sb FROM chunk_terms JOIN asked_terms USING (term) GROUP BY ALL),
run_a AS (SELECT 'A' AS run_id, question_id, document_key, chunk_no, sa AS score, row_number() OVER (PARTITION BY question_id ORDER BY sa DESC, document_key, chunk_no) AS rank FROM met QUALIFY rank <= 10),
run_b AS (SELECT 'B' AS run_id, question_id, document_key, chunk_no, sb AS score, row_number() OVER (PARTITION BY question_id ORDER BY sb DESC, document_key, chunk_no) AS rank FROM met WHERE sb >= 2 QUALIFY rank <= 10),
run_c AS (SELECT 'C' AS run_id, question_id, document_key, chunk_no, score, row_number() OVER (PARTITION BY question_id ORDER BY md5(question_id || ':' || document_key || ':' || chunk_no)) AS rank FROM run_a),
ranked AS (SELECT * FROM run_a UNION ALL SELECT * FROM run_b UNION ALL SELECT * FROM run_c),
chunks AS (SELECT run_id, question_id, rank, score, document_key, document_key || ':' || chunk_no AS chunk_id, {normalize_sql("content")} AS content_norm, length(content_norm) AS norm_len FROM ranked JOIN windows USING (document_key, chunk_no)),
runs AS (SELECT * FROM (VALUES ('A'), ('B'), ('C')) t(run_id)),
asked AS (SELECT run_id, question_id FROM sources CROSS JOIN runs),
hits AS (SELECT run_id, c.question_id, claim_id, min(rank) AS first_rank, min(span_index) AS span_index, arg_min(chunk_id, rank) AS chunk_id FROM chunks c JOIN spans s ON c.question_id = s.question_id AND c.document_key = s.document_key AND contains(content_norm, span_norm) GROUP BY ALL),
detail AS (SELECT a.run_id, a.question_id, c.claim_id, claim_ord, claim_type, hop_role, c.document_key, first_rank, h.chunk_id FROM asked a JOIN claims c USING (question_id) LEFT JOIN hits h ON h.run_id = a.run_id AND h.question_id = a.question_id AND h.claim_id = c.claim_id),
metrics AS (SELECT run_id, question_id, k, count(*) FILTER (first_rank <= k) AS claim_hits, count(*) AS claim_count, bool_and(coalesce(first_rank <= k, false)) AS complete,
  avg(CASE WHEN first_rank <= k THEN 1.0 / log2(1 + first_rank) ELSE 0.0 END) AS novel_claim_rank_score,
  count(*) FILTER (claim_type = 'anchor') AS anchor_count, count(*) FILTER (claim_type = 'anchor' AND first_rank <= k) AS anchor_hits,
  count(*) FILTER (claim_type = 'passage') AS passage_count, count(*) FILTER (claim_type = 'passage' AND first_rank <= k) AS passage_hits,
  count(*) FILTER (hop_role = 'endpoint') AS endpoint_count, count(*) FILTER (hop_role = 'endpoint' AND first_rank <= k) AS endpoint_hits,
  count(*) FILTER (hop_role = 'bridge') AS bridge_count, count(*) FILTER (hop_role = 'bridge' AND first_rank <= k) AS bridge_hits,
  claim_hits / claim_count AS claim_recall
  FROM detail CROSS JOIN (SELECT unnest([1, 3, 5, 10]) AS k) GROUP BY run_id, question_id, k),
clustered AS (SELECT m.*, lang, source, source AS cluster_id FROM metrics m JOIN sources s USING (question_id) JOIN docs d ON d.document_key = s.document_key),
negatives AS (SELECT question_id, o.document_key, left({normalize_sql("text")}, 40) AS span_norm FROM
  (SELECT question_id, arg_min(document_key, rank) AS document_key FROM run_b b WHERE NOT EXISTS (SELECT 1 FROM truth t WHERE t.question_id = b.question_id AND t.document_key = b.document_key) GROUP BY 1) o JOIN docs USING (document_key) WHERE span_norm <> '')
"""


def sql(body: str) -> str:
    """A query over the derived tables."""
    return f"WITH {CTE.strip()}\n{body}"
