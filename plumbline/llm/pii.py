"""Personal data: base patterns, and contextual extraction bootstrapped from them; native Spark.

The base kinds are found by regular expressions and arithmetic (octets, Luhn's sum, digit counts).
They seed the bootstrap: the one and two words before an entity are its lexical patterns. Candidates
are tokens of letters, digits, "_", "-" and "/" with a digit that no base span covers; which of them
are taken is up to the patterns' confidence. Patterns and instances form a bipartite graph, kept once for each
pair. A pattern's confidence is the sum of its instances' confidences over their number and the number
of places, in all texts, where a plain word (without digit or "@") follows it, smoothed by PRIOR more;
so words that are mostly followed by plain words count for little, whatever identifiers they also
precede. An instance's confidence is the largest of its patterns'; seeds stay at 1. After ROUNDS
rounds, the candidates after a pattern with a confidence of MIN_CONFIDENCE and MIN_SEEDS instances
that are seeds or have that confidence by other patterns are added as kind "context".

The graph holds a key of the text, not a document, so that any number of copies of a text count and
shuffle once. Texts are read three times and never shuffled; of their words, only those that follow a
pattern of MIN_SEEDS instances or more are counted, and summed in the task. The join with accepted patterns and the join
back by key have plain exchanges on both sides, so that Spark can split a hot pattern or copy.

Cases: a null text is empty; an empty table gives an empty result; a very long text is read whole, in
time linear in its length; equal rows get equal results; a null doc_id stays null; entities at a
text's beginning have no pattern; without accepted patterns only base spans are returned.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm._common import table, text_of, written
from plumbline.llm.spans import free, joined, spans, tagged

ROUNDS = 3
PRIOR = 2.0
MIN_CONFIDENCE = 0.6
MIN_SEEDS = 3
#: Code points before a span in which its context is looked for.
REACH = 48

# The base kinds' patterns, each equal to the plain form in its matches.
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){12,18}+(?![ -]?[0-9])"
PHONE = r"\+[0-9][ ().0-9-]+[0-9]"
KINDS = ("email", "ip", "card", "phone")
#: Tokens with a digit.
CANDIDATE = r"(?<![A-Za-z0-9@._+/-])(?=[A-Za-z_/-]*[0-9])[A-Za-z0-9]++(?:[_/-]++[A-Za-z0-9]++)*+(?!@)"


def octets(v: Column) -> Column:
    """Whether all parts of a dotted number are at most 255."""
    return F.forall(F.split(v, r"\."), lambda p: F.regexp_replace(p, "^0+", "").rlike("^(?:[0-9]{0,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$"))


def luhn(v: Column) -> Column:
    """Luhn's sum over the digits, from the last."""
    digits = F.split(F.reverse(F.regexp_replace(v, "[^0-9]", "")), "")
    worth = F.transform(digits, lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise(d.cast("int") * 2 - F.when(d.cast("int") > 4, 9).otherwise(0)))
    return F.aggregate(worth, F.lit(0), lambda a, x: a + x) % 10 == 0


def base_spans(t: Column) -> dict[str, Column]:
    """The base kinds' spans."""
    digits = lambda v: F.length(F.regexp_replace(v, "[^0-9]", ""))
    return {
        "email": spans(t, EMAIL, where=F.contains(t, F.lit("@"))),
        "ip": spans(t, IP, octets, where=t.rlike(r"[0-9]\.[0-9]+\.[0-9]+\.[0-9]")),
        "card": spans(t, CARD, luhn, where=t.rlike(r"[0-9](?:[ -]?[0-9]){12}")),
        "phone": spans(t, PHONE, lambda v: digits(v).between(9, 15), where=F.contains(t, F.lit("+"))),
    }


#: What separates words, for patterns.
BETWEEN = r"[\s\"'(<\[]+"


def _words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), BETWEEN), lambda w: w != "")


def contexts(t: Column, start: Column) -> Column:
    """The lexical patterns before a place: its last word, and its last two, in lower case."""
    words = _words(F.substring(t, F.greatest(start - REACH, F.lit(0)) + 1, F.least(start, F.lit(REACH))))
    n = F.size(words)
    one = F.when(n >= 1, F.concat(F.lit("1 "), F.element_at(words, -1)))
    two = F.when(n >= 2, F.concat(F.lit("2 "), F.element_at(words, -2), F.lit(" "), F.element_at(words, -1)))
    return F.array_compact(F.array(one, two))


def others(docs: DataFrame, patterns: DataFrame) -> DataFrame:
    """pattern and others: at how many places of the texts of docs a plain word follows each of the given patterns, if any."""
    words = docs.select(_words(text_of(docs)).alias("w")).where(F.size("w") > 1)
    here = lambda i: F.get("w", i)
    at = F.transform(F.sequence(F.lit(1), F.size("w") - 1), lambda i: F.when(~here(i).rlike("[0-9@]"), F.struct(here(i - 2).alias("far"), here(i - 1).alias("near"))))
    each = words.select(F.explode(F.array_compact(at)).alias("x"))
    each = each.select(F.explode(F.array_compact(F.array(F.concat(F.lit("1 "), "x.near"), F.concat(F.lit("2 "), "x.far", F.lit(" "), "x.near")))).alias("pattern"))
    return each.join(patterns, "pattern").groupBy("pattern").agg(F.count("*").alias("others"))


def _marked(docs: DataFrame) -> DataFrame:
    """doc_id, key, the base spans by kind, and instances (place, value, whether a seed, patterns) of each row."""
    t = text_of(docs)
    found = docs.select("doc_id", t.alias("t"), *(c.alias(k) for k, c in base_spans(t).items()))
    # Base columns are used by what follows several times, so they stay in a projection of their own.
    every = F.concat(*KINDS)
    found = found.withColumn("taken", every).withColumn("near", spans(F.col("t"), CANDIDATE, where=F.col("t").rlike(CANDIDATE)))
    other = F.filter("near", lambda s: free(s, F.col("taken")))
    as_instance = lambda seed: lambda s: F.struct(s["a"].alias("a"), s["b"].alias("b"), s["v"].alias("v"), F.lit(seed).alias("seed"), contexts(F.col("t"), s["a"]).alias("patterns"))
    every = F.concat(F.transform("taken", as_instance(True)), F.transform(other, as_instance(False)))
    return found.select("doc_id", F.when(F.size("taken") + F.size("near") > 0, F.sha2("t", 256)).alias("key"), *(F.transform(k, lambda s: F.struct(s["a"].alias("a"), s["b"].alias("b"))).alias(k) for k in KINDS), every.alias("instances"))


def accepted(edges: DataFrame, plain: DataFrame, rounds: int = ROUNDS, prior: float = PRIOR, min_confidence: float = MIN_CONFIDENCE, min_seeds: int = MIN_SEEDS) -> DataFrame:
    """pattern and confidence of the patterns to trust. edges: distinct (pattern, v, seed); plain: pattern, others."""
    worth = F.when(F.col("seed"), F.lit(1.0)).otherwise(F.coalesce("conf", F.lit(0.0)))

    def scored(each: DataFrame) -> DataFrame:
        sums = each.groupBy("pattern").agg(F.sum(worth).alias("worth"), F.count("*").alias("n"), F.count_if(worth >= min_confidence).alias("support"))
        return sums.join(plain, "pattern", "left").select("pattern", (F.col("worth") / (F.col("n") + F.coalesce("others", F.lit(0)) + prior)).alias("p"), "support")

    patterns = scored(edges.withColumn("conf", F.lit(0.0)))
    for _ in range(rounds - 1):
        instances = edges.where(~F.col("seed")).join(patterns, "pattern").groupBy("v").agg(F.max("p").alias("conf"))
        patterns = scored(edges.join(instances, "v", "left"))
    return patterns.where((F.col("p") >= min_confidence) & (F.col("support") >= min_seeds)).select("pattern", F.col("p").alias("confidence"))


def _more(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """key and more: the contextual spans of each text of docs, from the instances of _marked()."""
    each = rows.where("size(instances) > 0").select("key", F.explode("instances").alias("i"))
    each = each.select("key", "i.a", "i.b", "i.v", "i.seed", F.explode("i.patterns").alias("pattern"))
    # One row for each text, place and pattern, however many copies the text has.
    each = written(each.distinct(), "instances")
    edges = written(each.groupBy("pattern", "v").agg(F.max("seed").alias("seed")), "edges")
    many = edges.groupBy("pattern").agg(F.count("*").alias("n")).where(F.col("n") >= MIN_SEEDS).select("pattern")
    plain = written(others(docs, written(many, "patterns")), "others")
    good = written(accepted(edges, plain), "patterns")
    extra = each.where(~F.col("seed")).join(good, "pattern").groupBy("key").agg(F.sort_array(F.collect_set(F.struct("a", "b"))).alias("more"))
    return written(extra, "more")


_NONE = "array<struct<a:int,b:int>>"


def found_spans(docs: DataFrame) -> DataFrame:
    """doc_id, base spans by kind, and more: the contextual spans that overlap no base span."""
    rows = written(_marked(docs), "pii")
    kept = rows.drop("instances")
    # Most texts have no instances, and so no key: they needn't be shuffled to meet the others.
    out = kept.where("key is not null").join(_more(docs, rows), "key", "left").unionByName(kept.where("key is null").withColumn("more", F.lit(None).cast(_NONE)))
    return out.select("doc_id", *KINDS, F.coalesce("more", F.array().cast(_NONE)).alias("more"))


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = found_spans(table(spark, sf_dir, "documents"))
    base = F.concat(*(tagged(k, F.col(k)) for k in KINDS))
    return got.select(
        "doc_id",
        *(F.size(k).cast("bigint").alias(f"n_{k}") for k in KINDS),
        F.sha2(joined(base), 256).alias("base_sha256"),
        joined(F.concat(base, tagged("context", F.col("more")))).alias("spans"),
        F.size("more").cast("bigint").alias("n_context"),
    )


def redacted(docs: DataFrame) -> DataFrame:
    """docs with each span of personal data in text replaced by its kind in angle brackets; its columns are those of docs.

    Overlapping spans are replaced together, under the kind of the first. Only texts with candidates
    are shuffled, to meet their contextual spans; the others are changed where they are read.
    """
    names = docs.columns
    more = _more(docs, written(_marked(docs), "pii"))
    own = docs.withColumn("__t", text_of(docs))
    may = F.col("__t").rlike(CANDIDATE)
    near = own.where(may).withColumn("__key", F.sha2("__t", 256)).join(more.select(F.col("key").alias("__key"), F.col("more").alias("__more")), "__key", "left")
    far = own.where(~may).withColumn("__more", F.lit(None).cast(_NONE))

    def changed(df: DataFrame) -> DataFrame:
        base = [tagged(k, c) for k, c in base_spans(F.col("__t")).items()]
        df = df.withColumn("__all", F.array_sort(F.concat(*base, tagged("context", F.coalesce("__more", F.array().cast(_NONE))))))

        def step(x: Column, s: Column) -> Column:
            fresh = F.concat(x["out"], F.substr(F.col("__t"), x["at"] + 1, s["a"] - x["at"]), F.lit("<"), s["kind"], F.lit(">"))
            return F.struct(F.greatest(x["at"], s["b"]).alias("at"), F.when(s["a"] >= x["at"], fresh).otherwise(x["out"]).alias("out"))

        start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
        text = F.aggregate("__all", start, step, lambda x: F.concat(x["out"], F.substr(F.col("__t"), x["at"] + 1)))
        return df.select(*(F.when(F.size("__all") > 0, text).otherwise(F.col("text")).alias("text") if c == "text" else c for c in names))

    return changed(near).unionByName(changed(far))
