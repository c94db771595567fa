"""Terms met in Arrow batches, against brute force, and what they shuffle."""

import math
import random
import re

import pytest
from plumbline.operators import postings, retrieval
from plumbline.plans import damaged as _damaged  # noqa: F401
from plumbline.plans import queries as _queries  # noqa: F401
from plumbline.plans import registry
from pyspark.sql import functions as F

WORDS = "the of river mill größe naïve Ångström weir. stone-works a 12 x1 ٣".split()


def shuffled(spark, f):
    """What f returns, with the rows and bytes that its stages shuffled."""

    def total():
        sc = spark.sparkContext
        stages = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), None)
        each = [stages.apply(i) for i in range(stages.size())]
        return sum(s.shuffleWriteRecords() for s in each), sum(s.shuffleWriteBytes() for s in each)

    before = total()
    got = f()
    return got, *(b - a for a, b in zip(before, total(), strict=True))


def texts_of(seed, n, most=40):
    rnd = random.Random(seed)
    return [(f"d{i % 7}-{i}", " ".join(rnd.choice(WORDS) for _ in range(rnd.randint(0, most)))) for i in range(n)]


def split(text, least=1):
    return [t for t in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", text.lower()) if len(t) >= least]


@pytest.mark.parametrize("least", [1, 4])
def test_bm25_in_blocks_against_brute_force(spark, least):
    rows = [*texts_of(1, 60), ("dup1", "mill of the river"), ("dup0", "mill of the river"), ("none", "")]
    asked = [(f"q{i}", t) for i, (_, t) in enumerate(texts_of(2, 7, 9))]
    chunks = spark.createDataFrame([(k, 0, t) for k, t in rows], "document_key string, chunk_no int, content string")
    questions = spark.createDataFrame(asked, "question_id string, question string")
    terms = questions.select("question_id", F.explode(retrieval.terms(F.col("question"), least)).alias("term")).groupBy("question_id", "term").agg(F.count("*").alias("qf"))
    best = postings.best_chunks(chunks, terms.select(F.lit("").alias("list"), "*"), 5, least, (1.2, 0.75), block_pairs=6, block_questions=2)
    got = {(r.question_id, r["rank"]): (r.document_key, r.score) for r in retrieval.ranked(best, 5).collect()}
    mean = sum(len(split(t, least)) for _, t in rows) / len(rows)
    want = {}
    for q, question in asked:
        scores = []
        for k, t in rows:
            ts, score = split(t, least), 0.0
            for term in split(question, least):
                df = sum(term in split(x, least) for _, x in rows)
                tf = ts.count(term)
                score += math.log(1 + (len(rows) - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(ts) / mean))
            if set(ts) & set(split(question, least)):
                scores.append((-round(score, 6), k))
        want |= {(q, i): (k, -s) for i, (s, k) in enumerate(sorted(scores)[:5], 1)}
    assert {k: v[0] for k, v in got.items()} == {k: v[0] for k, v in want.items()}
    assert all(abs(got[k][1] - want[k][1]) < 2e-6 for k in want)


def test_overlap_against_brute_force(spark):
    rows, asked = texts_of(3, 80), [(i, t) for i, (_, t) in enumerate(texts_of(4, 6, 12))]
    chunks = spark.createDataFrame([(k, 1, t) for k, t in rows], "document_key string, chunk_no int, content string")
    got = retrieval.overlap_best(chunks, spark.createDataFrame(asked, "question_id int, question string"), {"short": 3, "long": 5}, 4)
    want = set()
    for name, least in (("short", 3), ("long", 5)):
        for q, question in asked:
            scores = sorted((-len(set(split(t, least)) & set(split(question, least))), k) for k, t in rows)
            want |= {(name, q, k, float(-s), i) for i, (s, k) in enumerate([x for x in scores if x[0]][:4], 1)}
    assert {(r.list, r.question_id, r.document_key, r.score, r["rank"]) for r in got.collect()} == want


@pytest.mark.parametrize(("window", "overlap"), [(200, 50), (30, 0), (7, 6)])
def test_windows_against_slices(spark, window, overlap):
    texts = {i: ("a\u00e9\n\U0001f600\r\u2028 x" * 300)[:n] for i, n in enumerate([0, 1, 149, 150, 151, 599, 600, 601, 650, 651, 1350, 2399])}
    got = retrieval.chunk_windows(spark.createDataFrame([*texts.items(), (99, None)], "document_key int, text string"), window, overlap).collect()
    step = window - overlap
    assert {tuple(r) for r in got} == {(k, i // step, t[i : i + window]) for k, t in texts.items() for i in range(0, len(t), step)}


def test_bm25_shuffles_the_best_chunks_only(spark):
    chunks = spark.range(4000).select(F.col("id").alias("document_key"), F.lit(0).alias("chunk_no"), F.concat(F.lit("the river and the mill "), F.col("id") % 97).alias("content"))
    asked = spark.range(40).select(F.col("id").alias("question_id"), F.concat(F.lit("the mill and the river "), F.col("id")).alias("question"))
    got, rows, _ = shuffled(spark, lambda: retrieval.bm25(chunks, asked, 3).count())
    assert got == 120 and rows < 5000  # 4000 x 40 pairs share a term


@pytest.fixture(scope="module")
def long_texts(spark, tmp_path_factory):
    """A folder of tables whose texts are too large to be broadcast, and the size of these."""
    at, rnd = tmp_path_factory.mktemp("tables"), random.Random(6)
    texts = [" ".join(f"{rnd.getrandbits(40):x}" for _ in range(2000)) for _ in range(200)]
    texts[7] += " the millers by the river stand still"
    texts[9] = "the millers by a river " + texts[9]
    docs = [(i, t, "en", "s", 0) for i, t in enumerate(texts)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(1, "the millers by the river"), (2, "no such passage")], "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    name = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(name)
    spark.conf.set(name, "200000")
    yield str(at), sum(map(len, texts))
    spark.conf.set(name, before)


#: Queries of which the plans shuffled all texts, or their windows.
READERS = [
    "trivial_questions",
    "hard_negative_intrusion",
    "rule_negative_without_entity",
    "rule_negative_missing",
    "holm",
    "response_parse",
    "k_curve",
    "errors_as_zero",
    "chain_macro",
    "bridge_metrics",
    "rule_too_few",
    "iid_bootstrap",
    "comparison",
    "status_counts",
    "excluded_questions",
    "cluster_bootstrap",
    "bridge_chain_macro",
    "bridge_status_counts",
    "unmatched_docs",
]


@pytest.mark.parametrize("name", READERS)
def test_texts_are_read_but_not_shuffled(spark, long_texts, name):
    at, size = long_texts
    _, _, sent = shuffled(spark, lambda: registry.QUERIES[name](spark, at).collect())
    assert sent < size / 20


def test_containing_in_blocks_against_brute_force(spark):
    docs = {k: t + "\n" * (i % 2) + "  end" for i, (k, t) in enumerate(texts_of(5, 90, 25))} | {"e": ""}
    passages = {i: t for i, t in enumerate(["the of", "mill", "", "river  mill", "the river mill of", " of the ", "größe naïve", "x1 ٣ 12", "no such words here"])}
    passages |= {50 + i: t[3:20] for i, t in enumerate(list(docs.values())[:20])}
    df = spark.createDataFrame([*docs.items(), ("null", None)], "document_key string, text string")
    asked = spark.createDataFrame([*passages.items(), (99, None)], "question_id int, passage string")
    want = {(q, d) for q, p in passages.items() for d, t in docs.items() if p in t}
    assert {(r.question_id, r.document_key) for r in retrieval.containing(df, asked).collect()} == want
    few = postings.holding(df, asked, retrieval.anchors(F.col("passage")), block_bytes=30, block_questions=3)
    assert {(r.question_id, r.document_key) for r in few.collect()} == want


def test_no_auc_of_runs_whose_questions_are_all_answered(spark, tmp_path):
    import duckdb

    spark.createDataFrame([(1, "a stonemason by the river mill stands still", "en", "s", 0)], "doc_id long, text string, lang string, source string, n_chars long").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, "stonemason by the river")], "item_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/benchmark.parquet")
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        part = next(iter((tmp_path / f"{t}.parquet").glob("*.parquet")))
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{part}'")
    assert registry.QUERIES["abstention_auc"](spark, str(tmp_path)).collect() == con.execute(registry.ORACLES["abstention_auc"]).fetchall() == []
