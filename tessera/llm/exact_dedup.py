"""Exact dedup by an extendible-hash index on shared files. DataFrame functions only.

1. Entries. Every row's text is normalised and hashed to a 64-bit key; rows, keys and digests are written to the shared folder.
2. Directory. The keys are counted by their leading bits. One bucket holds all keys at first; an overfull bucket is split by
   its next bit, and the directory of 2 ** depth entries doubles when the bucket is as deep as it. The index on
   shared files holds each key with its bucket and number of rows.
3. Owner tasks. Rows whose key several rows share go to the tasks that own their buckets. There the entries of one key form a
   chain, told apart by their bytes; each learns its size and the row that stays.
4. Probes. Each row finds its bucket by the directory, its key in the bucket, and its text in the chain by the digest, or by
   the bytes where a chain holds two texts of one digest. A key of one row has no chain: the row stays.

Hot groups: the rows of a key with a large share of all rows are dealt to several owner tasks, and what these found is
merged; their probes are answered without a shuffle. The driver sees numbers of keys by leading bits only, a few for each of
MAX_BUCKETS buckets at most: with more keys than MAX_BUCKETS * BUCKET_SLOTS a bucket holds more.

Defined results: null counts as empty text, and all empty texts are equal; rows with a null id take part, and a null id is
the last choice among rows of equal length. One row of a group is kept: of identical rows, and of rows
without id and equal in length, the first in the order of reading. An empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import TOLD_ROWS, hot_limit, join_groups, materialize, shuffle_partitions, told

#: Keys that a bucket holds before it splits, and the most buckets.
BUCKET_SLOTS = 1_000
MAX_BUCKETS = 1 << 15
#: Characters that don't count for equality: [\x20\x09-\x0D].
IGNORED = " \t\n\x0b\x0c\r"


def normalized(text: Column) -> Column:
    return F.translate(F.coalesce(text, F.lit("")), IGNORED, "")


def directory(counts: dict[int, int], bits: int, capacity: int) -> list[int]:
    """The bucket of each entry of a directory, from the number of keys by their first `bits` bits.

    A bucket over capacity is split by its next bit; if its depth is the directory's, the directory doubles. A bucket's
    entries lie side by side, and buckets are numbered in the order of keys.
    """
    before = [0, *accumulate(counts.get(p, 0) for p in range(1 << bits))]
    depth, work, buckets = 1, [(0, 0)], []
    while work:
        low, local = work.pop()
        half = 1 << (bits - local) >> 1
        if before[low + (1 << (bits - local))] - before[low] <= capacity or local == bits:
            buckets.append((low, local))
            continue
        depth = max(depth, local + 1)
        work += [(low, local + 1), (low + half, local + 1)]
    return [number for number, (_, local) in enumerate(sorted(buckets)) for _ in range(1 << (depth - local))]


def index(entries: DataFrame, capacity: int) -> tuple[DataFrame, DataFrame, int]:
    """The directory (entry, bucket), the index (bucket, key, rows), both on shared files, and the directory's depth."""
    spark = entries.sparkSession
    keys = materialize(entries.groupBy("key").agg(F.count("*").alias("rows")), "keys")
    total = keys.count()
    capacity = max(capacity, -(-total // MAX_BUCKETS))
    bits = (total // capacity).bit_length() + 2
    prefix = F.shiftrightunsigned("key", 64 - bits).cast("int")
    counts = {r["p"]: r["n"] for r in keys.groupBy(prefix.alias("p")).agg(F.count("*").alias("n")).collect()}
    points = directory(counts, bits, capacity)
    depth = len(points).bit_length() - 1
    entry = F.shiftrightunsigned("key", 64 - depth).cast("int")
    owners = materialize(spark.createDataFrame(list(enumerate(points)), "entry int, bucket int"), "directory")
    held = keys.withColumn("entry", entry).join(F.broadcast(owners), "entry").select("bucket", "key", "rows")
    return owners, materialize(held.repartitionByRange("bucket", "key").sortWithinPartitions("bucket", "key"), "index"), depth


def chains(rows: DataFrame, several: DataFrame, total: int) -> DataFrame:
    """bucket, key, text_sha256, bytes, group_size, best of each distinct text of rows (with their buckets), by owner tasks."""
    limit = hot_limit(rows.sparkSession, total)
    hot = several.where(F.col("rows") > limit).select("key", F.ceil(F.col("rows") / limit).alias("parts"))  # few: each has a share of all rows
    salt = F.coalesce(F.pmod(F.col("at"), F.col("parts")), F.lit(-1).cast("long"))
    owned = rows.join(F.broadcast(hot), "key", "left").withColumn("salt", salt).repartition(shuffle_partitions(rows.sparkSession), "bucket", "salt")
    # the longest text, then a known id, the smallest one, the first row
    rank = F.struct("n", F.col("doc_id").isNotNull().alias("known"), F.bitwise_not(F.coalesce("doc_id", F.lit(0))).alias("inverse_id"), F.bitwise_not("at").alias("inverse_at"))
    found = owned.groupBy("bucket", "salt", "key", "bytes").agg(F.min("text_sha256").alias("text_sha256"), F.count("*").alias("group_size"), F.max(rank).alias("best"))
    found = materialize(found, "chained")
    whole = found.where("salt < 0").drop("salt")
    parts = found.where("salt >= 0").groupBy("bucket", "key", "bytes").agg(F.min("text_sha256").alias("text_sha256"), F.sum("group_size").alias("group_size"), F.max("best").alias("best"))
    return materialize(whole.unionByName(parts), "chains")


def decide(df: DataFrame, doc_id: str = "doc_id", text: str = "text", capacity: int = BUCKET_SLOTS, whole: bool = False) -> tuple[DataFrame, DataFrame]:
    """All rows of df as written: at (the row's number), doc_id, text and others (its other columns, if whole); and the decisions:
    at, doc_id, keep_id, group_size, kept, text_sha256."""
    norm = normalized(F.col("text"))
    source = [F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")]
    if whole:
        source.append(F.struct(*[F.col(c) for c in df.columns if c != text]).alias("others"))
    source = df.select(*source).withColumn("at", F.monotonically_increasing_id())
    entries = materialize(source.select("*", F.char_length(F.coalesce("text", F.lit(""))).alias("n"), F.xxhash64(norm).alias("key"), F.sha2(norm, 256).alias("text_sha256")), "entries")

    owners, held, depth = index(entries, capacity)
    several = held.where("rows > 1")
    bucketed = entries.withColumn("entry", F.shiftrightunsigned("key", 64 - depth).cast("int")).join(F.broadcast(owners), "entry")
    light = bucketed.select("at", "doc_id", "n", "bucket", "key", "text_sha256")
    alone = None
    asked = bucketed
    if several.count() <= TOLD_ROWS:  # else all rows go to the owners, and those of a key of their own are chains of one
        keys = F.broadcast(several.select("key"))
        asked, alone, light = bucketed.join(keys, "key", "left_semi"), light.join(keys, "key", "left_anti"), light.join(keys, "key", "left_semi")
    total = held.agg(F.sum("rows")).first()[0] or 0
    found = chains(asked.select("at", "doc_id", "n", "bucket", "key", "text_sha256", norm.alias("bytes")), several, total)

    def answered(rows: DataFrame, by: DataFrame, on: list[str]) -> DataFrame:
        best = F.col("best")
        keep = F.when(best["known"], F.bitwise_not(best["inverse_id"]))
        kept = F.col("at") == F.bitwise_not(best["inverse_at"])
        return join_groups(rows, by, on, "group_size").select("at", "doc_id", keep.alias("keep_id"), "group_size", kept.alias("kept"), "text_sha256")

    place = ["bucket", "key", "text_sha256"]
    clashes = materialize(found.groupBy(*place).agg(F.count("*").alias("c")).where("c > 1").drop("c"), "clashes")
    if clashes.isEmpty():
        out = answered(light, found.drop("bytes"), place)
    else:  # a digest stands for several texts of a chain: their rows are told apart by their bytes
        clashes = told(clashes)
        by_bytes = asked.join(clashes, place, "left_semi").select("at", "doc_id", *place, norm.alias("bytes"))
        out = answered(light.join(clashes, place, "left_anti"), found.join(clashes, place, "left_anti").drop("bytes"), place)
        out = out.unionByName(answered(by_bytes, found.join(clashes, place, "left_semi"), [*place, "bytes"]))
    if alone is not None:
        out = out.unionByName(alone.select("at", "doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "text_sha256"))
    return entries, out


def exact_dedup(df: DataFrame, doc_id: str = "doc_id", text: str = "text", capacity: int = BUCKET_SLOTS) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256; one row for each row of df."""
    return decide(df, doc_id, text, capacity)[1].drop("at")


def without_copies(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """df's rows that stay, with all its columns."""
    entries, decided = decide(df, doc_id, text, whole=True)
    gone = materialize(decided.where("not kept").select("at"), "gone")
    stay = entries.join(told(gone), "at", "left_anti")
    return stay.select(*[F.col("text").alias(c) if c == text else F.col("others")[c].alias(c) for c in df.columns])
