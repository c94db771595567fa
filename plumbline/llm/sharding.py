"""Sharding by balanced label propagation over links of equal texts; native Spark. Law: rows.

Every document starts with a label, a shard that a hash of its row number gives. Linked documents
(equal texts) of one label move alike, so labels are counted by group and shard. In each round,
every unsettled group proposes to move to the neighbours' shard where most of it is already, among
the shards with room for it; a shard takes proposals by the number of edges they save, up to its
quota. Prefix sums over steps of priority decide what fits; a step that doesn't fit waits for the
next round, when its groups propose again. A group of more than 1/PARTS of a shard is first cut into
parts of that size by row number, for no shard may hold it whole; there are at most shards x PARTS
such groups, so that this list is small enough to broadcast, whatever the input.

Documents without links, and groups that found no room in ROUNDS rounds, then fill the quotas in
order of group, so that counts are at most one apart. Ranks and slots are taken in two levels:
numbers of buckets are added up, and rows are numbered within their bucket.

Cases: a null text is empty (equal to other empty ones, crc 0, size 8); equal rows are different
documents with slots of their own; null ids are kept; with fewer documents than shards some shards
are empty; an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plumbline.llm._common import forget, table, text_of, written

SHARDS = 24
ROUNDS = 6
PARTS = 4
#: Rows of a bucket in the two-level numbering, about; at least MIN_BUCKETS.
BUCKET_ROWS, MIN_BUCKETS = 500_000, 256
#: Steps of priority among groups of about one size.
TIES = 256


def _array(values: list[int]) -> Column:
    return F.array(*(F.lit(int(v)).cast("bigint") for v in values))


def _numbered(df: DataFrame, within: list[str], bucket: list[str], order: list[str], n: int, name: str) -> DataFrame:
    """df with name: gapless numbers from 0 in each group of within, by n buckets of the bucket columns, and in order inside them."""
    bucketed = df.withColumn("__bucket", F.pmod(F.xxhash64(*bucket), F.lit(n)))
    sums = bucketed.groupBy(*within, "__bucket").agg(F.count("*").alias("__n"))
    # One row for each group and bucket.
    before = F.coalesce(F.sum("__n").over(W.partitionBy(*within).orderBy("__bucket").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    offsets = sums.select(*within, "__bucket", before.alias("__before"))
    own = F.row_number().over(W.partitionBy(*within, "__bucket").orderBy(*order))
    out = bucketed.withColumn("__own", own).join(F.broadcast(offsets), [*within, "__bucket"])
    return out.withColumn(name, F.col("__before") + F.col("__own") - 1).drop("__bucket", "__own", "__before")


def settled(units: DataFrame, rooms: list[int], rounds: int = ROUNDS) -> tuple[DataFrame, list[int]]:
    """(key, part, shard, w) of the groups that found room, and the room left. units: key, part, label, n."""
    k = len(rooms)
    open_units, done, left, quota = units, None, list(rooms), max(1, *rooms)
    for _ in range(rounds):
        room = _array(left)
        votes = open_units.select("key", "label", "n")
        if done is not None:
            votes = votes.unionByName(done.join(open_units.select("key").distinct(), "key").select("key", F.col("shard").alias("label"), F.col("w").alias("n")))
        votes = votes.groupBy("key", "label").agg(F.sum("n").alias("n"))
        turn = F.pmod(F.col("label") + F.xxhash64("key"), F.lit(k))
        # At most one entry for each shard.
        ranked = F.sort_array(F.collect_list(F.struct("n", turn.alias("turn"), "label")), asc=False)
        votes = votes.groupBy("key").agg(F.transform(ranked, lambda x: x["label"]).alias("labels"), F.sum("n").alias("all"))
        wish = open_units.groupBy("key", "part").agg(F.sum("n").alias("w")).join(votes, "key")
        # The parts of a group that needs several shards take as many of its labels in turn.
        share = F.ceil(F.col("all") / quota)
        fit = F.filter("labels", lambda s: F.element_at(room, s + 1) >= F.col("w"))
        label = F.get(fit, F.pmod(F.col("part"), F.greatest(F.least(share, F.size(fit)), F.lit(1))).cast("int"))
        # No neighbour's shard has room: any that has.
        others = F.filter(F.sequence(F.lit(0), F.lit(k - 1)), lambda s: F.element_at(room, s + 1) >= F.col("w"))
        other = F.get(others, F.pmod(F.xxhash64("key", "part"), F.greatest(F.size(others), F.lit(1))).cast("int"))
        saved = (F.lit(63) - F.floor(F.log2(F.col("w")))) * TIES + F.pmod(F.xxhash64("part", "key"), F.lit(TIES))
        wish = written(wish.select("key", "part", "w", F.coalesce(label, other).cast("int").alias("shard"), saved.cast("int").alias("step")).where("shard is not null"), "wishes")
        # At most shards x 64 x TIES rows.
        sums = wish.groupBy("shard", "step").agg(F.sum("w").alias("w"))
        upto = F.sum("w").over(W.partitionBy("shard").orderBy("step"))
        cut = sums.withColumn("upto", upto).where(F.col("upto") <= F.element_at(room, F.col("shard") + 1)).groupBy("shard").agg(F.max("step").alias("last"), F.max("upto").alias("taken"))
        cut = written(cut, "cuts")
        taken = {r["shard"]: r["taken"] for r in cut.collect()}  # a row for each shard at most
        if not taken:
            break
        got = written(wish.join(F.broadcast(cut), "shard").where("step <= last").select("key", "part", "shard", "w"), "settled")
        done = got if done is None else done.unionByName(got)
        left = [r - taken.get(s, 0) for s, r in enumerate(left)]
        old, open_units = open_units, written(open_units.join(got, ["key", "part"], "left_anti"), "open")
        forget(wish, cut, old)
        if open_units.isEmpty():
            break
    if done is None:
        done = units.select("key", "part", F.lit(0).alias("shard"), F.lit(0).alias("w")).limit(0)
    return done, left


def sharded(docs: DataFrame, shards: int = SHARDS, rounds: int = ROUNDS) -> DataFrame:
    """doc_id, size, text_crc32, shard and slot for each row; counts of shards are at most one apart."""
    t = text_of(docs)
    rows = docs.select("doc_id", (F.octet_length(t) + 8).cast("bigint").alias("size"), F.crc32(t).alias("text_crc32"), F.unhex(F.md5(t)).alias("key"), F.monotonically_increasing_id().alias("row"))
    rows = written(rows, "rows")
    n = rows.count()
    quotas = [n // shards + (s < n % shards) for s in range(shards)]
    most = max(1, n // (shards * PARTS))
    groups = written(rows.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "groups")
    # Fewer than shards x PARTS groups can have more than n / (shards x PARTS) rows.
    heavy = groups.where(F.col("n") > most).select("key", F.ceil(F.col("n") / most).alias("parts"))
    rows = rows.join(F.broadcast(heavy), "key", "left").withColumn("part", F.coalesce(F.pmod(F.xxhash64("row"), F.col("parts")), F.lit(0)).cast("bigint")).drop("parts")
    linked = rows.join(groups.select("key"), "key").select("key", "part", F.pmod(F.xxhash64("row", F.lit(7)), F.lit(shards)).cast("int").alias("label"))
    units = written(linked.groupBy("key", "part", "label").agg(F.count("*").alias("n")), "units")
    done, left = settled(units, quotas, rounds)

    placed = written(rows.join(done.drop("w"), ["key", "part"], "left"), "placed")
    buckets = max(MIN_BUCKETS, n // BUCKET_ROWS)
    free = _numbered(placed.where("shard is null"), [], ["key", "part"], ["key", "part", "row"], buckets, "rank")
    ends, total = [], 0
    for r in left:
        total += r
        ends.append(total)
    shard = F.size(F.filter(_array(ends), lambda e: e <= F.col("rank")))
    free = free.withColumn("shard", shard).drop("rank")
    placed = written(placed.where("shard is not null").unionByName(free.select(*placed.columns)), "sharded")
    out = _numbered(placed, ["shard"], ["row"], ["row"], max(MIN_BUCKETS, n // shards // BUCKET_ROWS), "slot")
    return out.select("doc_id", "size", "text_crc32", F.col("shard").cast("int").alias("shard"), F.col("slot").cast("bigint").alias("slot"))


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = sharded(table(spark, sf_dir, "documents"))
    return got.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
