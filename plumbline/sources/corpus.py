"""Corpora: whole text files, their hashes, and images' headers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions.text import document_key, normalize_exact

PNG = "89504E470D0A1A0A"


def _name(path: str) -> F.Column:
    return F.element_at(F.split(path, "/"), -1)


def read_files(spark: SparkSession, folder: str, pattern: str = "*.md") -> DataFrame:
    """name, document_key, sha256 of the raw bytes, text and text_norm of each file in a folder."""
    raw = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder)
    text = raw.select(F.url_decode(_name("path")).alias("name"), F.sha2("content", 256).alias("sha256"), F.decode("content", "UTF-8").alias("text"))
    return text.withColumn("document_key", document_key("name")).withColumn("text_norm", normalize_exact("text"))


def read_images(spark: SparkSession, folder: str, pattern: str = "*.png") -> DataFrame:
    """name, sha256, media_type, width and height; sizes come from the PNG header, null for other data."""
    raw = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder)
    head = raw.select(F.url_decode(_name("path")).alias("name"), F.sha2("content", 256).alias("sha256"), F.hex(F.substring("content", 1, 24)).alias("h"))
    is_png = F.col("h").startswith(PNG) & (F.substring("h", 25, 8) == "49484452")
    number = lambda at: F.when(is_png, F.conv(F.substring("h", at, 8), 16, 10).cast("int"))
    return head.select("name", "sha256", F.when(is_png, "image/png").alias("media_type"), number(33).alias("width"), number(41).alias("height"))


def drifted(declared: DataFrame, found: DataFrame) -> DataFrame:
    """name and why, of declared files (name, sha256) that are missing or changed."""
    got = declared.select("name", F.col("sha256").alias("want")).join(found.select("name", "sha256"), "name", "left")
    why = F.when(F.col("sha256").isNull(), "missing").when(F.col("sha256") != F.col("want"), "sha256 differs")
    return got.select("name", why.alias("why")).where("why is not null")


def image_faults(declared: DataFrame, found: DataFrame) -> DataFrame:
    """name and why, of declared images (name, sha256, media_type, width, height) that differ from the files."""
    f = found.select("name", *(F.col(c).alias(f"__{c}") for c in ("sha256", "media_type", "width", "height")))
    got = declared.join(f, "name", "left")
    wrong = lambda c: ~F.col(c).eqNullSafe(F.col(f"__{c}"))
    why = F.when(F.col("__sha256").isNull(), "missing").when(wrong("sha256"), "sha256 differs").when(wrong("media_type"), "media type differs").when(wrong("width") | wrong("height"), "size differs")
    return got.select("name", why.alias("why")).where("why is not null")
