"""SimHash near-duplicates, found in an embedding of segments' bit counts.

A fingerprint of 64 bits is cut into 32 segments of two bits, and each segment is mapped to its
number of ones: a point of a grid with coordinates 0, 1, 2. The Manhattan distance of two points is
at most the number of differing bits. The coordinates are cut into blocks, so few that a link of
`radius` bits leaves some block with a distance of 2 or less; there, both points or neighbours of
both at a distance of 1 meet in one cell of the grid. So a range join is an equi-join on cells, to
which each distinct fingerprint sends about 25 rows a block, and nothing is lost. Every meeting is
verified by the exact number of differing bits.

Cells of near copies can hold very many fingerprints. Components need no more than a spanning set of
links, so the join runs twice. First each fingerprint is compared with the least of its cell, and
components are formed. Then fingerprints of different components that share a cell are compared; of
these, those of the cell's largest component needn't be compared with each other. All links between
different components are found, and no cell is expanded into all its pairs.

For the pipeline, deduplicated() takes all these links if it is given a radius, and always those of
near copies, however far apart their fingerprints are: texts of which about 0.8 or more of the five-word shingles agree. Candidates for the
latter share a rare shingle (a prefix filter), which no kind of edit avoids.

Cases: a null text is empty; a text without words has fingerprint zero, and so links like any other;
equal rows share a component; a null doc_id never is a component's id unless all its ids are null.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import LongType, StructField, StructType

from plumbline.llm._common import forget, hex64, settled, ship, table, written
from plumbline.llm.graph import components

SHINGLE_WORDS = 4
RADIUS = 4
#: Shingles that are counted at once.
CHUNK = 1 << 14
#: Every second bit, the lower of each segment.
_LOW = 0x5555555555555555


def fingerprint(text: str | None, shingle: int = SHINGLE_WORDS, seed: int = 42) -> int:
    """The signed 64-bit SimHash of a text's word shingles, repeats included."""
    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    n = max(1, len(words) - shingle + 1)
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1)
    begin = np.concatenate(([0], ends[:-1]))[:n].tolist()
    stop = (ends[min(shingle, len(words)) - 1 :] - 1).tolist()
    digest, ones = xxhash.xxh64_intdigest, np.zeros(64, dtype=np.int64)
    for k in range(0, n, CHUNK):
        h = np.array([digest(joined[a:b], seed) for a, b in zip(begin[k : k + CHUNK], stop[k : k + CHUNK], strict=True)], dtype=np.uint64)
        ones += np.unpackbits(h.view(np.uint8), bitorder="little").reshape(-1, 64).sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > n, bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), text: str = "text", shingle: int = SHINGLE_WORDS) -> DataFrame:
    """keep, and fp (long) for each row."""
    ship(docs.sparkSession)
    given = docs.select(*keep, text)
    whole = StructType([given.schema[k] for k in keep] + [StructField("fp", LongType())])
    target = to_arrow_schema(whole)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = pa.array([fingerprint(t, shingle) for t in b.column(len(keep)).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], made], schema=target)

    return given.mapInArrow(work, whole)


def bit_counts(fp: Column) -> Column:
    """The grid point: 32 fields of two bits, each the number of ones of its segment."""
    above, low = F.shiftrightunsigned(fp, 1), F.lit(_LOW).cast("long")
    one = fp.bitwiseXOR(above).bitwiseAND(low)
    two = fp.bitwiseAND(above).bitwiseAND(low)
    return one.bitwiseOR(F.shiftleft(two, 1))


def cells(fp: Column, radius: int = RADIUS) -> Column:
    """The cells of all blocks where a fingerprint is met: its own, and those at a distance of one."""
    blocks = radius // 3 + 1  # then a block has a distance of at most 2
    out = []
    for k in range(blocks):
        first, last = 32 * k // blocks, 32 * (k + 1) // blocks
        mask = (1 << 2 * (last - first)) - 1 if last - first < 32 else -1
        here = F.shiftrightunsigned(bit_counts(fp), 2 * first).bitwiseAND(F.lit(mask).cast("long"))
        if blocks > 1:  # the number of the block, above its fields
            here = here.bitwiseOR(F.lit(k << 60).cast("long"))
        out.append(here)
        for i in range(last - first):
            field = F.shiftrightunsigned(here, 2 * i).bitwiseAND(F.lit(3).cast("long"))
            moved = lambda to, field=field, here=here, i=i: here.bitwiseXOR(F.shiftleft(field.bitwiseXOR(to), 2 * i))
            out.append(F.when(field < 2, moved(field + 1)))
            out.append(F.when(field > 0, moved(field - 1)))
    return F.array_compact(F.array(*out))


def differing(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


#: Rows that a task turns into cells.
ROWS_EACH = 8192


def _spread(df: DataFrame) -> DataFrame:
    """df in as many tasks as its rows need, however few files hold them: they are short now, but become many cells each."""
    return df.repartition(max(1, -(-df.count() // ROWS_EACH)))


def linked(distinct: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(node, root) for the fingerprints fp that have a link; root is the least of the component."""
    at = F.explode(cells(F.col("fp"), radius)).alias("cell")
    least = _spread(distinct.select("fp")).select("fp", at).selectExpr("fp", "min(fp) over (partition by cell) as r")
    stars = least.where(F.col("fp") != F.col("r")).where(differing(F.col("fp"), F.col("r")) <= radius)
    first = components(stars, "fp", "r")

    sizes = first.groupBy("root").agg(F.count("*").alias("n"))
    weight = F.log2(F.coalesce("n", F.lit(1))).cast("long")
    known = distinct.join(first.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp")).join(sizes, "root", "left")
    # Larger components have larger marks; marks of different components differ but for one pair in 2^56.
    mark = F.shiftleft(weight, 56).bitwiseOR(F.shiftrightunsigned(F.xxhash64("root"), 8))
    met = _spread(written(known.select("fp", "root", mark.alias("mark")), "marked")).select("*", at)
    met = met.selectExpr("*", "max(mark) over (partition by cell) as most", "min(mark) over (partition by cell) as least").where("most <> least")
    small = met.where("mark <> most").select(F.col("cell"), F.col("fp").alias("f"), F.col("root").alias("a"), F.col("mark").alias("m"))
    other = met.select("cell", F.col("fp").alias("g"), F.col("root").alias("b"), F.col("mark").alias("w"))
    # Of two small components, the pair is met from one side only.
    close = (F.col("a") != F.col("b")) & ((F.col("w") > F.col("m")) | (F.col("w") == F.col("m"))) & (differing(F.col("f"), F.col("g")) <= radius)
    more = components(small.join(other, "cell").where(close).select("a", "b"))
    both = first.join(more.select(F.col("node").alias("root"), F.col("root").alias("top")), "root", "left").select("node", F.coalesce("top", "root").alias("root"))
    alone = more.join(first.select("node"), "node", "left_anti")
    return both.unionByName(alone)


def grouped(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), text: str = "text", shingle: int = SHINGLE_WORDS, radius: int = RADIUS) -> DataFrame:
    """keep (with doc_id), fp and component_id for each row."""
    own = written(fingerprints(docs, keep, text, shingle), "fingerprints")
    distinct = written(own.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    roots = written(linked(distinct.select("fp"), radius).withColumnRenamed("node", "fp"), "linked")
    tops = distinct.join(roots, "fp").groupBy("root").agg(F.min("least").alias("component_id"))
    of = roots.join(tops, "root").select("fp", "component_id")
    classes = written(distinct.join(of, "fp", "left").select("fp", F.coalesce("component_id", "least").alias("component_id")), "classes")
    return own.join(classes, "fp").select(*keep, "fp", "component_id")


#: The near-copy search: words of a shingle, and the similarity of copies as a fraction (Jaccard of their sets of shingles).
COPY_WORDS, COPY_LIKE = 5, (4, 5)
#: One text in ONE_IN has its shingles counted to tell common ones (more of few texts, so that LEAST are); the count that makes one common, and how many of them are held.
ONE_IN, LEAST, COMMON, HELD = 4, 8192, 3, 262_144


def _parts(text: str | None, shingle: int) -> set[bytes]:
    """The distinct shingles of a text; one without words has the empty one."""
    words = (text or "").encode("utf-8", "replace").lower().split()
    return {b" ".join(words[i : i + shingle]) for i in range(max(1, len(words) - shingle + 1))}


def shingles(text: str | None, shingle: int = COPY_WORDS) -> np.ndarray:
    """The sorted 64-bit hashes of a text's distinct shingles."""
    return np.unique(np.fromiter(map(xxhash.xxh64_intdigest, _parts(text, shingle)), dtype=np.uint64).view(np.int64))


def prefix(hashes: np.ndarray, common: np.ndarray, counts: np.ndarray, like: tuple[int, int] = COPY_LIKE) -> np.ndarray:
    """The first hashes in the order of all texts, by count and hash: so many that two sets as similar as `like` share one of them."""
    at = np.minimum(np.searchsorted(common, hashes), max(0, len(common) - 1))
    known = np.where(common[at] == hashes, counts[at], 0) if len(common) else np.zeros(len(hashes), dtype=np.int64)
    return hashes[np.lexsort((hashes, known))][: len(hashes) - -(-len(hashes) * like[0] // like[1]) + 1]


def common_shingles(docs: DataFrame, shingle: int = COPY_WORDS) -> tuple[np.ndarray, np.ndarray]:
    """(sorted hashes, counts) of shingles that several of the texts looked at hold, whose share is fixed, so that they grow with the input. They only decide the order in prefix(): any order is right, and this one keeps common shingles out of the prefixes."""
    one_in = min(ONE_IN, max(1, docs.count() // LEAST))
    some = docs.where(F.pmod(F.xxhash64("text", F.lit(1)), F.lit(one_in)) == 0).select("text").distinct()
    target = pa.schema([("h", pa.int64())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for t in b.column(0).to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array(shingles(t, shingle))], schema=target)

    held = some.mapInArrow(work, "h bigint").groupBy("h").agg(F.count("*").alias("n")).where(F.col("n") >= COMMON)
    got = held.orderBy(F.desc("n"), "h").limit(HELD).toArrow()
    h, n = got["h"].to_numpy().astype(np.int64), got["n"].to_numpy().astype(np.int64)
    order = np.argsort(h)
    return h[order], n[order]


def _may(x: Column, y: Column, like: tuple[int, int]) -> Column:
    """Whether two sets (structs with n and at, the place of the hash that they share) can be similar if it is the first one shared, as it is in some cell of every similar pair."""
    return F.least(x["n"] - x["at"], y["n"] - y["at"]) * sum(like) >= (x["n"] + y["n"]) * like[0]


def _pairs(met: DataFrame, x: Column, y: Column, like: tuple[int, int]) -> DataFrame:
    """Distinct (a, b), b < a, of the nodes of x and y that can be similar."""
    near = met.where((x["node"] != y["node"]) & _may(x, y, like))
    return near.select(F.greatest(x["node"], y["node"]).alias("a"), F.least(x["node"], y["node"]).alias("b")).distinct()


def cells_of(texts: DataFrame) -> DataFrame:
    """cell and x (node, n, at) for each hash in the prefixes of several texts, and pivots. texts: node, n, prefix.

    Pivots are the least node of a cell, and the one that shares most hashes in all: the middle of a
    group rather than its border.
    """
    each = texts.select("node", "n", F.posexplode("prefix").alias("at", "cell"))
    shared = written(each.selectExpr("*", "count(*) over (partition by cell) as held").where("held > 1").drop("held"), "shared")
    marked = shared.join(shared.groupBy("node").agg(F.count("*").alias("degree")), "node").withColumn("x", F.struct("node", "n", "at"))
    out = written(marked.selectExpr("cell", "x", "min(x) over (partition by cell) as p0", "max(struct(degree, x)) over (partition by cell).x as p1"), "met")
    forget(shared)
    return out


def likely(pairs: DataFrame, held: DataFrame, like: tuple[int, int] = COPY_LIKE) -> DataFrame:
    """The pairs (a, b) that can be similar by what their prefixes share; drops no similar one. held: node, n, cells.

    What two sets share outside both prefixes is, of the set whose prefix ends first, no part of the prefix.
    """
    side = lambda n: held.select(F.col("node").alias(n), F.col("n").alias(f"n{n}"), F.col("cells").alias(f"c{n}"))
    most = F.greatest("na", "nb")
    rest = F.floor((most * like[0] + like[1] - 1) / like[1]) - 1
    may = (F.size(F.array_intersect("ca", "cb")) + rest) * sum(like) >= (F.col("na") + F.col("nb")) * like[0]
    return pairs.join(side("a"), "a").join(side("b"), "b").where(may).select("a", "b")


def alike(pairs: DataFrame, sets: DataFrame, like: tuple[int, int] = COPY_LIKE) -> DataFrame:
    """The pairs (a, b) whose sets have a Jaccard similarity of like or more, exactly. sets: node, hashes."""
    side = lambda n: sets.select(F.col("node").alias(n), F.col("hashes").alias(f"s{n}"))
    both = F.size(F.array_intersect("sa", "sb"))
    return pairs.join(side("a"), "a").join(side("b"), "b").where(both * sum(like) >= (F.size("sa") + F.size("sb")) * like[0]).select("a", "b")


def copies(met: DataFrame, sets: DataFrame, like: tuple[int, int] = COPY_LIKE, known_links: DataFrame | None = None) -> DataFrame:
    """(node, root) of similar texts. met: from cells_of(); sets: node and hashes for each node in it; known_links: pairs (a, b) of nodes that are linked in any case.

    Similar texts share a hash of their prefixes, whatever the edit. First every text is compared
    with the pivots of its cells, and components are formed; then texts of different components that
    share a cell are compared, but for those of the cell's largest component with each other.
    """
    stars = written(_pairs(met, F.col("x"), F.col("p0"), like).union(_pairs(met, F.col("x"), F.col("p1"), like)).distinct(), "stars")
    held = written(met.groupBy("x.node", "x.n").agg(F.collect_list("cell").alias("cells")), "held")
    links = alike(written(likely(stars, held, like), "likely"), sets, like)
    first = components(links.unionByName(known_links) if known_links else links)
    settled(met.sparkSession)

    sizes = first.groupBy("root").agg(F.count("*").alias("n"))
    weight = F.log2(F.coalesce("n", F.lit(1))).cast("long")
    # Marks as in linked().
    mark = F.shiftleft(weight, 56).bitwiseOR(F.shiftrightunsigned(F.xxhash64("root"), 8))
    known = sets.select("node").join(first, "node", "left").withColumn("root", F.coalesce("root", "node")).join(sizes, "root", "left").select("node", "root", mark.alias("mark"))
    each = met.select("cell", "x", F.col("x.node").alias("node")).join(known, "node")
    each = each.selectExpr("cell", "x", "root", "mark", "max(mark) over (partition by cell) as most", "min(mark) over (partition by cell) as least").where("most <> least")
    each = written(each, "rest")
    small = each.where("mark <> most").select("cell", "x", F.col("root").alias("u"), F.col("mark").alias("m"))
    other = each.select("cell", F.col("x").alias("y"), F.col("root").alias("v"), F.col("mark").alias("w"))
    rest = _pairs(small.join(other, "cell").where((F.col("u") != F.col("v")) & (F.col("w") >= F.col("m"))), F.col("x"), F.col("y"), like)
    links = alike(written(likely(rest.join(stars, ["a", "b"], "left_anti"), held, like), "likely"), sets, like)

    top = lambda n: known.select(F.col("node").alias(n), F.col("root").alias(f"r{n}"))
    more = components(links.join(top("a"), "a").join(top("b"), "b").select("ra", "rb"), "ra", "rb")
    both = first.join(more.select(F.col("node").alias("root"), F.col("root").alias("top")), "root", "left").select("node", F.coalesce("top", "root").alias("root"))
    return both.unionByName(more.join(first.select("node"), "node", "left_anti"))


def same_fingerprints(prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(a, b): each node with the least one of those whose fingerprints linked() puts in one component. prints: node, fp."""
    distinct = written(prints.select("node", "fp").distinct(), "fps")
    roots = written(linked(distinct.select("fp").distinct(), radius).withColumnRenamed("node", "fp"), "linked")
    of = distinct.join(roots, "fp", "left").select("node", F.coalesce("root", "fp").alias("root"))
    least = of.groupBy("root").agg(F.min("node").alias("b"))
    out = written(of.join(least, "root").where("node <> b").select(F.col("node").alias("a"), "b").distinct(), "same")
    forget(distinct, roots)
    return out


def deduplicated(docs: DataFrame, shingle: int = COPY_WORDS, like: tuple[int, int] = COPY_LIKE, radius: int | None = None) -> DataFrame:
    """docs with one document of each group of equal or similar texts, and with a radius of those with linked fingerprints too: the one with the least doc_id, null last (of rows that share it, one with the least hash of its text). Its columns are those of docs.

    A node is the hash of a text's set of shingles, so that results don't depend on partitions; texts of equal sets are one node.
    """
    ship(docs.sparkSession)
    names = docs.columns
    common = docs.sparkSession.sparkContext.broadcast(common_shingles(docs, shingle))
    marked = docs.withColumn("__hash", F.xxhash64("text"))
    given = marked.select("doc_id", "__hash", "text")
    whole = StructType([*given.schema.fields[:2], *StructType.fromDDL("node bigint, fp bigint, n int, prefix array<bigint>")])
    target = to_arrow_schema(whole)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(2).to_pylist()
            sets = [shingles(t, shingle) for t in texts]
            node = np.array([xxhash.xxh3_64_intdigest(s.tobytes()) for s in sets], dtype=np.uint64).view(np.int64)
            more = pa.array(node), pa.array([None if radius is None else fingerprint(t) for t in texts], pa.int64()), pa.array([len(s) for s in sets], pa.int32()), pa.array([prefix(s, *common.value, like) for s in sets], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip([*b.columns[:2], *more], target, strict=True)], schema=target)

    def whole_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([shingles(t, shingle) for t in b.column(1).to_pylist()], pa.list_(pa.int64()))], names=["node", "hashes"])

    def picked(best: DataFrame) -> DataFrame:
        """The rows of docs that best (with a struct of that name) points at, at least one for each."""
        at = written(best.select(F.col("best.doc_id").alias("__id"), F.col("best.__hash").alias("__h"), *(c for c in best.columns if c != "best")).distinct(), "best")
        return marked.join(at, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__hash") == F.col("__h")))

    own = written(given.mapInArrow(work, whole), "prints")
    order = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "__hash")).alias("best")
    texts = written(own.groupBy("node").agg(order, F.first("n").alias("n"), F.first("prefix").alias("prefix")), "texts")
    same = None if radius is None else same_fingerprints(own, radius)
    forget(own)
    settled(docs.sparkSession)
    met = cells_of(texts)
    settled(docs.sparkSession)
    near = met.select("x.node").distinct().withColumnRenamed("node", "__node")
    near = picked(texts.select(F.col("node").alias("__node"), "best").join(near, "__node"))
    sets = written(near.select(F.col("__node").alias("node"), "text").dropDuplicates(["node"]).mapInArrow(whole_sets, "node bigint, hashes array<bigint>"), "sets")
    slim = written(texts.select("node", "best"), "texts")
    forget(texts)
    classes = slim.join(copies(met, sets, like, same), "node", "left")
    best = classes.groupBy(F.coalesce("root", "node").alias("root")).agg(F.min("best").alias("best"))
    return picked(best.select("best")).dropDuplicates(["__id", "__h"]).select(*names)


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = grouped(table(spark, sf_dir, "documents"))
    return got.select("doc_id", hex64(F.col("fp")).alias("fingerprint"), "component_id")
