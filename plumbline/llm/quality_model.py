"""Quality classifier: ordinal cumulative-link regression on graded ratings.

A document's features are its distinct words (A-Z lower-cased, cut at other ASCII characters), their
beginnings, and a few measures of style, each cut into steps; all are hashed to 2^18 places. One weight vector is
shared by all thresholds: P(grade > j) = logistic(w x - t_j), t_0 < t_1 < ... The expected grade is
the sum of these tail probabilities, and the last is used for selection.

The model is fitted on the driver to a bounded sample of whole labelled documents: in the order of
hashes of their ids, at most FIT_ROWS, and no more from the one on with which they would have over
FIT_PLACES features. A document has the same features when it is fitted to as when it is scored. It is
fitted by accelerated proximal gradient steps, until they change next to nothing, with an L1 penalty,
which leaves weights to few words, so that long texts don't drift. Weights are of fixed size (1 MB)
when broadcast. Every document is scored on its whole text, however long.

Cases: a null text is empty and has only features of style; an empty table of documents gives an empty
result; ids may have any type that joins and sorts; ids labelled more than once take the least grade,
and of documents that share an id the least features; labels that are null are not used; without
labels every document gets the highest grade; ratings of one grade only give that grade to all;
repeated rows get equal scores.
"""

from __future__ import annotations

from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from plumbline.llm._common import ship, table
from plumbline.llm.decontam import words_of

PLACES = 1 << 18
FIT_ROWS, FIT_PLACES = 12_000, 12_000_000
MIN_DOCS = 4
#: Bytes of a word's beginning that is a feature too.
STEM = 6
#: Steps at most, and the change of the thresholds and of the largest weight below which they end.
STEPS, STILL = 300, 1e-4
L1 = 4e-4
#: Documents with a probability of the highest grade below this are rejected.
MIN_TAIL = 0.4


def features(text: str | None) -> np.ndarray:
    """Hashed places of a text's words and style."""
    text = text or ""
    words = words_of(text)
    distinct = set(words)
    raw = text.split()
    n, chars = len(words), max(1, len(text))
    step = lambda share, k=20: int(min(1.0, share) * k)
    letters = sum(map(len, raw)) or 1
    upper = sum(map(str.isupper, raw))
    symbols = sum(map(text.count, "#*$%&|<>"))
    lines = text.split("\n")
    style = (
        f"\x00words {min(12, int(np.log2(n + 1)))}",
        f"\x00symbols {step(4 * symbols / letters)}",
        f"\x00bangs {step(8 * text.count('!') / chars)}",
        f"\x00upper {step(upper / max(1, len(raw)))}",
        f"\x00distinct {step(len(distinct) / max(1, n))} {min(12, int(np.log2(n + 1)))}",
        f"\x00lines {step(1 - len(set(lines)) / len(lines))}",
        f"\x00digits {step(8 * sum(map(text.count, '0123456789')) / chars)}",
        f"\x00length {min(30, letters // max(1, len(raw)))}",
    )
    places = {crc32(w) & (PLACES - 1) for w in distinct}
    places.update(crc32(w, 1) & (PLACES - 1) for w in {w[:STEM] for w in distinct})
    places.update(crc32(s.encode()) & (PLACES - 1) for s in style)
    return np.fromiter(places, dtype=np.int32, count=len(places))


def _logistic(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Ordinal:
    """Shared weights and ordered thresholds."""

    def __init__(self, weights: np.ndarray, thresholds: np.ndarray) -> None:
        self.weights, self.thresholds = weights, thresholds

    def tails(self, places: np.ndarray) -> np.ndarray:
        """P(grade > j) for each j."""
        return _logistic(float(self.weights[places].sum()) - self.thresholds)


def fit(rows: list[np.ndarray], grades: np.ndarray, top: int, steps: int = STEPS, l1: float = L1, still: float = STILL) -> Ordinal:
    """The model of feature rows and grades 0 to top."""
    weights = np.zeros(PLACES)
    if not rows or len(set(grades.tolist())) < 2:
        level = int(grades[0]) if len(grades) else top
        return Ordinal(weights, np.where(np.arange(top) < level, -20.0, 20.0))
    owner = np.repeat(np.arange(len(rows), dtype=np.int32), [len(r) for r in rows])
    place = np.concatenate(rows)
    often = np.bincount(place, minlength=PLACES) >= MIN_DOCS
    owner, place = owner[often[place]], place[often[place]]
    used = np.flatnonzero(np.bincount(place, minlength=PLACES))
    place = np.searchsorted(used, place).astype(np.int32)
    n = len(rows)
    by_row = np.searchsorted(owner, np.arange(n + 1, dtype=np.int32))
    held_by = owner[np.argsort(place, kind="stable")]
    by_place = np.concatenate(([0], np.cumsum(np.bincount(place, minlength=len(used)))))
    del owner

    def sums(x: np.ndarray, cuts: np.ndarray) -> np.ndarray:
        """Sums of the stretches between cuts, 0 for empty ones."""
        out, some = np.zeros(len(cuts) - 1), cuts[1:] > cuts[:-1]
        if len(x):
            out[some] = np.add.reduceat(x, cuts[:-1][some])
        return out

    above = (grades[:, None] > np.arange(top)).astype(float)
    base = np.clip(above.mean(axis=0), 1e-3, 1 - 1e-3)
    t = np.log((1 - base) / base)
    w = np.zeros(len(used))
    ahead_w, ahead_t, momentum = w, t, 1.0
    share = np.diff(by_place) / n
    scale = 1 / (share + 0.02)  # steps by how common a place is
    rate = 1.0 / max(1.0, sums((scale * share)[place], by_row).mean())
    for _ in range(steps):
        error = _logistic(sums(ahead_w[place], by_row)[:, None] - ahead_t) - above
        g = sums(error.sum(axis=1)[held_by], by_place) / n
        new = ahead_w - rate * scale * g
        new = np.sign(new) * np.maximum(0, np.abs(new) - rate * scale * l1)
        new_t = np.sort(ahead_t + rate * 4 * error.mean(axis=0))
        again = (1 + np.sqrt(1 + 4 * momentum**2)) / 2
        pull = (momentum - 1) / again
        if ((ahead_w - new) * (new - w)).sum() > 0:  # restart where the step turns back
            again, pull = 1.0, 0.0
        moved = max(np.abs(new - w).max(initial=0), np.abs(new_t - t).max(initial=0))
        ahead_w, ahead_t = new + pull * (new - w), np.sort(new_t + pull * (new_t - t))
        w, t, momentum = new, new_t, again
        if moved < still:
            break
    weights[used] = w
    return Ordinal(weights, t)


def sampled(rated: DataFrame, fit_rows: int) -> DataFrame:
    """The fit_rows rows of rated (or all) with the least hashes of doc_id."""
    hashed, total = F.shiftrightunsigned(F.xxhash64("doc_id"), 32), rated.count()
    share, some = 1.5 * fit_rows / max(1, total), rated
    # Only hashes that can be among the least are sorted; more of them where these are too few.
    while share < 1:
        some = rated.where(hashed < int((1 << 32) * share))
        if some.count() >= fit_rows:
            break
        share, some = 2 * share, rated
    return some.orderBy(hashed, "doc_id").limit(fit_rows)


def train(docs: DataFrame, ratings: DataFrame, top: int, fit_rows: int = FIT_ROWS, fit_places: int = FIT_PLACES) -> Ordinal:
    """Fits to the sample. ratings: doc_id, grade (0 to top)."""
    ship(docs.sparkSession)
    rated = ratings.where("doc_id is not null and grade is not null").groupBy("doc_id").agg(F.min("grade").cast("int").alias("grade"))
    # At most fit_rows rows; documents that repeat an id are taken once.
    texts = docs.select("doc_id", "text").join(F.broadcast(sampled(rated, fit_rows)), "doc_id").select("doc_id", "grade", "text")
    whole = StructType([*texts.schema.fields[:2], *StructType.fromDDL("places array<int>").fields])
    target = to_arrow_schema(whole)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            places = [np.sort(features(t)) for t in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(places, pa.list_(pa.int32()))], schema=target)

    got = texts.mapInArrow(work, whole).groupBy("doc_id").agg(F.min(F.struct("grade", "places")).alias("x"))
    rows, grades, held = [], [], 0
    for r in got.select("x.grade", "x.places").orderBy(F.xxhash64("doc_id"), "doc_id").toLocalIterator():
        held += len(r["places"])
        if rows and held > fit_places:
            break
        rows.append(np.array(r["places"], dtype=np.int32))
        grades.append(r["grade"])
    return fit(rows, np.array(grades, dtype=np.int64), top)


def scored(docs: DataFrame, model: Ordinal, keep: tuple[str, ...] = ("doc_id",), text: str = "text", min_tail: float = MIN_TAIL, prefix: str = "") -> DataFrame:
    """keep, expected_grade, tail (of the highest grade), tails and kept for each document; prefix goes before these names."""
    spark = docs.sparkSession
    ship(spark)
    held = spark.sparkContext.broadcast((model.weights.astype(np.float32), model.thresholds))
    given = docs.select(*(keep if text in keep else (*keep, text)))
    at = given.columns.index(text)
    whole = StructType([*(given.schema[k] for k in keep), *StructType.fromDDL(f"{prefix}expected_grade double, {prefix}tail double, {prefix}tails array<double>, {prefix}kept boolean")])
    target = to_arrow_schema(whole)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Ordinal(*held.value)
        for b in batches:
            tails = [m.tails(features(t)) for t in b.column(at).to_pylist()]
            made = ([float(p.sum()) for p in tails], [float(p[-1]) for p in tails], [p.tolist() for p in tails], [bool(p[-1] >= min_tail) for p in tails])
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], *(pa.array(v, f.type) for v, f in zip(made, list(target)[len(keep) :], strict=True))], schema=target)

    return given.mapInArrow(work, whole)


def graded() -> Column:
    """The tables' labels as grades: 0 toxic, 1 of low quality, 2 good."""
    return F.when(F.col("toxic") == 1, 0).when(F.col("quality") == 0, 1).when((F.col("quality") == 1) & (F.col("toxic") == 0), 2)


def selected(docs: DataFrame, ratings: DataFrame, top: int = 2, min_tail: float = MIN_TAIL) -> DataFrame:
    """docs without those that the model rejects; its columns are those of docs."""
    names = tuple(docs.columns)
    return scored(docs.select(*names), train(docs, ratings, top), names, min_tail=min_tail, prefix="__").where("__kept").select(*names)


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = train(docs, table(spark, sf_dir, "labels").select("doc_id", graded().alias("grade")), 2)
    return scored(docs, model)
