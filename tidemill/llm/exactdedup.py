"""Exact duplicates through an extendible-hash index on shared files; DataFrame operations only.

1. A light pass counts the rows of each 64-bit hash of a text (8 bytes a hash, combined in the map tasks).
2. The directory starts as one bucket, the whole range of hashes, and doubles while a bucket holds more than ``capacity`` hashes:
   an overfull bucket splits on its next bits, the others stay.  The directory has an entry for each of the ``2**TOP`` prefixes of
   ``TOP`` bits at most (so it may always be broadcast), which says how many bits make the bucket; these may be more than ``TOP``,
   so buckets go on splitting however many hashes there are.
3. Every row goes to its bucket's owner task, text and all.  The owner sorts a bucket's rows into groups of one hash and one text: equal
   hashes are chained, and the texts of a chain are told apart by their bytes.  Rows of hashes that occur more than ``hot`` times
   are combined in the map tasks first, so that a text with any number of copies is one row a task in the shuffle.
4. Owners write their groups to shared files, sorted by hash: bucket, hash, SHA-256, the id that stays, the group's size.
5. Rows look their group up in their bucket by hash; rows whose chain has several texts by hash and text.

Null texts count as empty.  Equal texts keep the row with the largest id; rows that repeat that id are all marked as kept.
A null id never stays unless the whole group has none (``keep_id`` null, ``kept`` false).  Very long texts are shuffled once, whole.
An empty table gives an empty result; other columns play no part.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import Scratch

CAPACITY, HOT, TOP = 256, 1024, 14
BUCKET = ["depth", "bucket"]


def prefix(hash_: Column, depth: Column) -> Column:
    """The first ``depth`` bits of a hash."""
    return F.when(depth > 0, F.call_function("shiftrightunsigned", hash_, (64 - depth).cast("int"))).otherwise(F.lit(0).cast("long"))


def slot(hash_: Column) -> Column:
    return F.call_function("shiftrightunsigned", hash_, F.lit(64 - TOP))


def directory(hashes: DataFrame, capacity: int, scratch: Scratch) -> DataFrame:
    """(slot, depth) after the doublings that ``capacity`` needs; ``hashes`` has one row for each distinct ``hash``.

    One round counts all buckets and splits the overfull ones by as many bits as their counts ask for.
    """
    now = scratch.put(hashes.select(slot(F.col("hash")).alias("slot")).distinct().withColumn("depth", F.lit(0)), "directory-0")
    for k in range(1, 65):
        placed = hashes.withColumn("slot", slot(F.col("hash"))).join(F.broadcast(now), "slot")  # 2**TOP rows at most
        counted = placed.groupBy("depth", prefix(F.col("hash"), F.col("depth")).alias("bucket"), "slot").agg(F.count("*").alias("n"))
        held = counted.groupBy("depth", "bucket").agg(F.sum("n").alias("n"), F.collect_set("slot").alias("slots"))  # 2**TOP slots at most
        over = held.filter((F.col("n") > capacity) & (F.col("depth") < 64))
        more = F.greatest(F.lit(1), F.ceil(F.log2(F.col("n") / capacity))).cast("int")
        split = scratch.put(over.select(F.explode("slots").alias("slot"), F.least(F.lit(64), F.col("depth") + more).alias("to")).groupBy("slot").agg(F.max("to").alias("to")), f"split-{k}")
        if split.isEmpty():
            return now
        now = scratch.put(now.join(F.broadcast(split), "slot", "left").select("slot", F.coalesce("to", "depth").alias("depth")), f"directory-{k}")
    return now


def route(rows: DataFrame, depths: DataFrame) -> DataFrame:
    """``rows`` with the bucket that the directory names for their hash."""
    found = rows.withColumn("__slot", slot(F.col("hash"))).join(F.broadcast(depths.withColumnRenamed("slot", "__slot")), "__slot")
    return found.withColumn("bucket", prefix(F.col("hash"), F.col("depth"))).drop("__slot")


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, hash_of: Callable[[Column], Column] = F.xxhash64, hot: int = HOT) -> DataFrame:
    """``doc_id, keep_id, group_size, kept, text_sha256`` per row of ``docs``.

    ``hash_of`` may be a weak function: texts are told apart by their bytes.
    """
    scratch = Scratch(docs.sparkSession, "exact")
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), text.alias("text")).withColumn("hash", hash_of(F.col("text")))
    hashes = scratch.put(rows.groupBy("hash").agg(F.count("*").alias("n")), "hashes")
    depths = directory(hashes.select("hash"), capacity, scratch)

    kept = F.coalesce(F.col("doc_id") == F.col("keep_id"), F.lit(False)).alias("kept")
    result = ["doc_id", "keep_id", "group_size", kept, "text_sha256"]
    sha = F.sha2("text", 256).alias("text_sha256")
    group = [*BUCKET, "hash", "text"]
    best = [F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size")]
    # One row in ``hot`` names a hot hash at most; whether the list is broadcast is Spark's choice by its size.
    many = scratch.put(hashes.filter(F.col("n") > hot).select("hash"), "hot")
    none = many.isEmpty()
    groups = route(rows if none else rows.join(many, "hash", "left_anti"), depths).repartition(*BUCKET).groupBy(*group).agg(*best)
    if not none:
        groups = groups.unionByName(route(rows.join(many, "hash", "left_semi"), depths).groupBy(*group).agg(*best))
    index = scratch.put(groups.select(*BUCKET, "hash", sha, "keep_id", "group_size").sortWithinPartitions(*BUCKET, "hash"), "index")

    chains = scratch.put(index.groupBy(*BUCKET, "hash").agg(F.count("*").alias("n")).filter("n > 1").drop("n"), "chains")
    alone = chains.isEmpty()
    single = index if alone else index.join(chains, [*BUCKET, "hash"], "left_anti")
    found = route(rows.select("doc_id", "hash"), depths).join(single, [*BUCKET, "hash"]).select(*result)
    if alone:
        return found
    links = route(rows, depths).join(chains, [*BUCKET, "hash"], "left_semi")
    return found.unionByName(links.join(links.groupBy(*group).agg(*best), group).select("*", sha).select(*result))
