import pytest

from plumbline.functions import text as T
from pyspark.sql import functions as F

# Golden values of the normaliser.
CASES = [
    ("# 标题 ![示意图](assets/a.png)", "标题assets/a.png"),
    ("详见 [附录 A](docs/a.md)", "详见附录adocs/a.md"),
    ("A—B “C”", 'a-b"c"'),
    ("**关键**\n证据\t１２３", "关键证据123"),
    ("", ""),
    (None, ""),
    ("~~x~~ `y`　‑ Ａ", "xy-a"),
]


def test_normalize_text_in_both_forms(spark):
    df = spark.createDataFrame([(i, a) for i, (a, _) in enumerate(CASES)], "i int, t string")
    rows = df.select("i", T.normalize_text("t").alias("a"), T.normalize_exact("t").alias("b")).orderBy("i").collect()
    assert [r["a"] for r in rows] == [b for _, b in CASES]
    assert [r["b"] for r in rows] == [b for _, b in CASES]


@pytest.mark.parametrize("name", ["T1-alpha-2023.md", " docs/T1-Alpha-2023.MD", "C:\\x\\t1-alpha-2023.txt", "t1-alpha-2023"])
def test_document_key(spark, name):
    assert spark.range(1).select(T.document_key(F.lit(name))).first()[0] == "t1-alpha-2023"


def test_document_key_keeps_other_spellings_apart(spark):
    assert spark.range(1).select(T.document_key(F.lit("x/T1_alpha_2023 (1).md"))).first()[0] != "t1-alpha-2023"


def test_occurrences_do_not_overlap(spark):
    df = spark.createDataFrame([("aaaa", "aa"), ("abab", "x"), ("a.a.", "."), ("a", "")], "t string, p string")
    assert [r[0] for r in df.select(T.occurrences(F.col("t"), F.col("p"))).collect()] == [2, 0, 2, 0]


def test_lexical_overlap(spark):
    df = spark.createDataFrame([("abcd", "abc"), ("xyz", "abc"), ("x", "a")], "q string, s string")
    assert [r[0] for r in df.select(T.lexical_overlap(F.col("q"), F.col("s"))).collect()] == [1.0, 0.0, None]


def test_report_rounding_is_in_two_stages():
    from plumbline.operators.aggregates import report_macro

    assert report_macro([1.0, 1 / 3]) == 0.6666
    assert T.python_round(2 / 3) == 0.6667
