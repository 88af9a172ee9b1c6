"""Sharding: rendezvous hashing of stable record keys over weighted shards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

#: Ranges of the key's hash in which slots are numbered on their own.
BUCKETS = 256


def _unit(key: Column, shard: int) -> Column:
    """A number in (0, 1) that depends on key and shard alone: 52 bits of an XXH64."""
    return (F.shiftrightunsigned(F.xxhash64(F.lit("shard"), F.lit(shard), key), 12).cast("double") + 0.5) / F.lit(float(1 << 52))


def rendezvous(key: Column, weights: list[float]) -> Column:
    """Number of the shard with the highest score -weight / ln(u). A new shard takes keys only into itself; a change
    of a weight moves only keys into or out of that shard. Ties go to the higher number. Null keys share one shard."""
    scores = [F.struct((-F.lit(float(w)) / F.log(_unit(key, i))).alias("s"), F.lit(i).alias("i")) for i, w in enumerate(weights) if w > 0]
    if not scores:
        raise ValueError("a shard with a weight above 0 is needed")
    return (F.greatest(*scores) if len(scores) > 1 else scores[0])["i"]


def shard(docs: DataFrame, weights: list[float], grown: list[float] | None = None, key: str = "doc_id") -> DataFrame:
    """doc_id, size, text_crc32, shard, slot and grown_shard (under the weights `grown`) of every document.

    size: UTF-8 bytes of the text (null: none) plus 16. slot numbers a shard's rows without gaps, in order of a hash bucket
    of key, CRC and size and then of these three. It takes one shuffle of narrow rows by (shard, bucket) plus counts of at
    most shards x 256 rows, so no task holds a shard, nor all rows of one key: only rows equal in key and text stay
    together. Those are kept, next to each other, in any order; rows that share a key share a shard; null ids share one; a
    very long text is a row like any other; an empty table gives no rows; other columns are ignored."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(
        F.col(key).alias("doc_id"),
        (F.octet_length(text) + 16).cast("long").alias("size"),
        F.crc32(F.encode(text, "UTF-8")).cast("long").alias("text_crc32"),
    ).withColumns({"shard": rendezvous(F.col("doc_id"), weights), "grown_shard": rendezvous(F.col("doc_id"), grown) if grown else F.lit(None).cast("int")})
    rows = common.written(rows.withColumn("__bucket", F.pmod(F.xxhash64(F.lit("slot"), "doc_id", "text_crc32", "size"), F.lit(BUCKETS)).cast("int")), "sharded")
    counts = rows.groupBy("shard", "__bucket").agg(F.count("*").alias("__n"))  # at most shards x BUCKETS rows
    ahead = Window.partitionBy("shard").orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("shard", "__bucket", F.coalesce(F.sum("__n").over(ahead), F.lit(0)).alias("__start"))
    inside = Window.partitionBy("shard", "__bucket").orderBy("doc_id", "text_crc32", "size")
    return rows.join(F.broadcast(starts), ["shard", "__bucket"]).select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard",
        (F.col("__start") + F.row_number().over(inside) - 1).cast("long").alias("slot"), "grown_shard",
    )


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents over 40 equal shards, and where they would be with 41."""
    return shard(common.table(spark, sf_dir, "documents"), [1.0] * 40, [1.0] * 41)
