"""Secrets: base patterns, and a battery of randomness tests under false-discovery control; native Spark.

Candidates are tokens of MIN_LENGTH or more characters of base64's alphabets, whatever stands before
or after them, that no base span covers. For each an encoding is inferred (hex, base32, base36,
base62, base64), and over its alphabet three tests are made of the symbols' places: chi-squared for
uniformity (as a normal deviate, by Wilson and Hilferty's cube root), runs above and below the
middle, and serial correlation at lag 1. The statistic is the largest deviate; a random token has a
small one.

Under the null hypothesis a token is natural language, written in that encoding. Its distribution is
taken from whole texts: each different stretch of neighbouring words, run together, counts once, for
one encoding and one band of length, by its hash, cut to the band's least length. A candidate's
p-value is the share of the null's statistics, of its band and encoding, that are not larger;
Benjamini and Hochberg's rule at Q then sets the limit of each band and encoding. Counts are held by
band, encoding and step of the statistic, a table of fixed size, so that nothing is sorted or collected.

Cases: a null text is empty; an empty table gives an empty result; a very long text is read whole;
equal texts count once for the statistics, and equal rows get equal results; without natural text or
candidates in a band nothing is added there; base spans stay.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plumbline.llm._common import table, text_of, written
from plumbline.llm.spans import free, joined, spans

MIN_LENGTH = 20
Q = 0.05
#: Least lengths of the bands.
BANDS = (20, 28, 40, 64)
#: Steps of the statistic, for one unit and in all.
STEPS, LAST = 20, 400

# The base kinds' patterns, each equal to the plain form in its matches.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]+"""
ASSIGNED = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"(?<![0-9a-f])[0-9a-f]{24,}+"
KINDS = ("assign", "access", "hex")
CANDIDATE = r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}+"
#: Neighbouring words of lower-case letters.
NATURAL = r"(?<![^\s])(?:[a-z]{2,} ){4,40}"

# The encodings' alphabets.
_DIGITS, _UPPER, _LOWER = "0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
ALPHABETS = {"hex": _DIGITS + "abcdef", "base32": _UPPER + "234567", "base36": _DIGITS + _LOWER, "base62": _UPPER + _LOWER + _DIGITS, "base64": _UPPER + _LOWER + _DIGITS + "+/"}


def base_spans(t: Column) -> dict[str, Column]:
    return {
        "assign": spans(t, ASSIGN, lambda v: F.length(F.regexp_extract(v, ASSIGNED, 1)) >= 6, where=t.rlike(r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]""")),
        "access": spans(t, ACCESS, lambda v: F.length(v) >= 20, where=F.contains(t, F.lit("AKIA"))),
        "hex": spans(t, HEX, where=t.rlike(HEX)),
    }


def with_encoding(df: DataFrame) -> DataFrame:
    """df (with v), and encoding, and s: v in the letters of the encoding's alphabet."""
    v = F.col("v")
    kind = F.when(v.rlike("^(?:[0-9a-f]+|[0-9A-F]+)$"), "hex").when(v.rlike("^[A-Z2-7]+$"), "base32").when(v.rlike("^(?:[0-9a-z]+|[0-9A-Z]+)$"), "base36").when(v.rlike("^[0-9A-Za-z]+$"), "base62").otherwise("base64")
    own = F.when(F.col("encoding").isin("hex", "base36"), F.lower("v")).when(F.col("encoding") == "base64", F.translate("v", "-_", "+/")).otherwise(v)
    return df.withColumn("encoding", kind).withColumn("s", own)


def as_encoded(df: DataFrame) -> DataFrame:
    """df (with v, of lower-case letters, and encoding), and s: v as it would be in the encoding; letters share the places of hex."""
    letters = ALPHABETS["hex"] + ALPHABETS["hex"][:10]
    return df.withColumn("s", F.when(F.col("encoding") == "hex", F.translate("v", _LOWER, letters)).when(F.col("encoding") == "base32", F.upper("v")).otherwise(F.col("v")))


def tested(df: DataFrame) -> DataFrame:
    """df (with encoding and s), and z_chi, z_runs, z_serial and statistic."""
    alphabet = F.lit(None).cast("string")
    for name, letters in ALPHABETS.items():
        alphabet = F.when(F.col("encoding") == name, letters).otherwise(alphabet)
    df = df.withColumn("alphabet", alphabet)
    df = df.withColumn("size", F.length("alphabet").cast("double")).withColumn("n", F.length("s").cast("double"))
    # Each symbol's place in the alphabet, and the sum of squares of the symbols' counts.
    df = df.withColumn("x", F.expr("transform(filter(split(s, ''), c -> c <> ''), c -> instr(alphabet, c) - 1)"))
    df = df.withColumn("squares", F.expr("aggregate(filter(split(alphabet, ''), c -> c <> ''), 0D, (a, c) -> a + power(length(s) - length(replace(s, c, '')), 2))"))
    df = df.withColumn("high", F.expr("transform(x, i -> if(i * 2 >= size, 1, 0))"))
    df = df.withColumn("walk", F.expr("aggregate(high, struct(-1 as last, 0 as runs), (a, h) -> struct(h as last, a.runs + if(h <> a.last, 1, 0) as runs)).runs"))
    df = df.withColumn("ups", F.expr("aggregate(high, 0, (a, h) -> a + h)").cast("double"))
    df = df.withColumn("lag", F.expr("aggregate(x, struct(cast(null as double) as last, 0D as total), (a, i) -> struct(cast(i - (size - 1) / 2 as double) as last, a.total + coalesce(a.last * (i - (size - 1) / 2), 0D) as total)).total"))
    k, n, ups = F.col("size") - 1, F.col("n"), F.col("ups")
    chi = F.col("size") / n * F.col("squares") - n
    df = df.withColumn("z_chi", (F.pow(chi / k, F.lit(1 / 3)) - (1 - 2 / (9 * k))) / F.sqrt(2 / (9 * k)))
    pairs = 2 * ups * (n - ups) / n
    spread = F.sqrt(F.greatest(pairs * (pairs - 1) / (n - 1), F.lit(0.0)))
    df = df.withColumn("z_runs", F.when(spread > 0, (F.col("walk") - pairs - 1) / spread).otherwise(F.sqrt(n)))
    df = df.withColumn("z_serial", F.col("lag") / ((F.col("size") * F.col("size") - 1) / 12 * F.sqrt(n - 1)))
    return df.withColumn("statistic", F.greatest(F.col("z_chi"), F.abs("z_runs"), F.abs("z_serial"), F.lit(0.0)))


def _band(n: Column) -> Column:
    out = F.lit(BANDS[0])
    for b in BANDS[1:]:
        out = F.when(n >= b, b).otherwise(out)
    return out


def _step() -> Column:
    return F.least(F.floor(F.col("statistic") * STEPS), F.lit(LAST)).cast("int").alias("step")


def limits(candidates: DataFrame, natural: DataFrame, q: float = Q) -> DataFrame:
    """band, encoding and most: the largest step that is a discovery. candidates, natural: tested, with band."""
    cell = ("band", "encoding")
    held = candidates.groupBy(*cell, _step()).agg(F.count("*").alias("found"), F.lit(0).cast("bigint").alias("null"))
    null = natural.groupBy(*cell, _step()).agg(F.lit(0).cast("bigint").alias("found"), F.count("*").alias("null"))
    # At most one row for each band, encoding and step, so one task can add them up.
    each = held.unionByName(null).groupBy(*cell, "step").agg(F.sum("found").alias("found"), F.sum("null").alias("null"))
    upto, whole = W.partitionBy(*cell).orderBy("step"), W.partitionBy(*cell)
    p = (F.sum("null").over(upto) + 1) / (F.sum("null").over(whole) + 1)
    share = F.sum("found").over(upto) / F.greatest(F.sum("found").over(whole), F.lit(1))
    ranked = each.select(*cell, "step", p.alias("p"), share.alias("share"))
    return ranked.where(F.col("p") <= q * F.col("share")).groupBy(*cell).agg(F.max("step").alias("most"))


def natural(docs: DataFrame) -> DataFrame:
    """band, encoding and v: each different stretch of words of the texts of docs, run together and cut, in one of the bands that it fills."""
    each = docs.select(F.explode(F.regexp_extract_all(text_of(docs), F.lit(NATURAL), F.lit(0))).alias("v")).select(F.substring(F.replace("v", F.lit(" "), F.lit("")), 1, BANDS[-1]).alias("v"))
    each = each.where(F.length("v") >= BANDS[0]).distinct().withColumn("h", F.xxhash64("v"))
    filled = sum(F.when(F.length("v") >= b, 1).otherwise(0) for b in BANDS)
    pick = lambda values, by, n: F.element_at(F.array(*map(F.lit, values)), (F.pmod(F.shiftright("h", by), n) + 1).cast("int"))
    each = each.select("v", pick(BANDS, 8, filled).alias("band"), pick(ALPHABETS, 32, F.lit(len(ALPHABETS))).alias("encoding"))
    return each.select("band", "encoding", F.substr("v", F.lit(1), F.col("band")).alias("v"))


def found_spans(docs: DataFrame, q: float = Q) -> DataFrame:
    """doc_id, base spans by kind, and more: spans of random tokens that overlap no base span."""
    t = text_of(docs)
    rows = docs.select("doc_id", t.alias("t"), *(c.alias(k) for k, c in base_spans(t).items()))
    rows = rows.withColumn("taken", F.concat(*KINDS)).withColumn("near", spans(F.col("t"), CANDIDATE, where=F.col("t").rlike(CANDIDATE)))
    other = F.filter("near", lambda s: free(s, F.col("taken")))
    some = F.size("near") > 0
    short = lambda k: F.transform(k, lambda s: F.struct(s["a"].alias("a"), s["b"].alias("b"))).alias(k)
    rows = written(rows.select("doc_id", F.when(some, F.sha2("t", 256)).alias("key"), *(short(k) for k in KINDS), other.alias("other")), "secrets")

    tokens = written(rows.where("size(other) > 0").select("key", F.explode("other").alias("o")).select("key", "o.a", "o.b", "o.v").distinct(), "tokens")
    values = written(tested(with_encoding(tokens.select("v").distinct())).select("v", "encoding", "statistic", _band(F.length("v")).alias("band")), "values")
    most = limits(values, tested(as_encoded(natural(docs))).select("band", "encoding", "statistic"), q)
    # One row for each band and encoding.
    good = values.withColumn("step", _step()).join(F.broadcast(most), ["band", "encoding"]).where("step <= most").select("v")
    more = written(tokens.join(good, "v").groupBy("key").agg(F.sort_array(F.collect_set(F.struct("a", "b"))).alias("more")), "more")
    kept, none = rows.drop("other"), "array<struct<a:int,b:int>>"
    # Most texts have no candidates, and so no key: they needn't be shuffled to meet the others.
    out = kept.where("key is not null").join(more, "key", "left").unionByName(kept.where("key is null").withColumn("more", F.lit(None).cast(none)))
    return out.select("doc_id", *KINDS, F.coalesce("more", F.array().cast(none)).alias("more"))


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = found_spans(table(spark, sf_dir, "documents"))
    rank = lambda k, c: F.transform(c, lambda s: F.struct(s["a"].alias("a"), F.lit(k).alias("o"), s["b"].alias("b"), F.lit((*KINDS, "random")[k]).alias("kind")))
    base = F.array_sort(F.concat(*(rank(k, F.col(c)) for k, c in enumerate(KINDS))))
    both = F.array_sort(F.concat(*(rank(k, F.col(c)) for k, c in enumerate(KINDS)), rank(len(KINDS), F.col("more"))))
    return got.select(
        "doc_id",
        *(F.size(k).cast("bigint").alias(f"n_{k}") for k in KINDS),
        F.sha2(joined(base), 256).alias("base_sha256"),
        joined(both).alias("spans"),
        F.size("more").cast("bigint").alias("n_random"),
    )
