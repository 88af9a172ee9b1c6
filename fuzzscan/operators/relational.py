"""What is asked of matches: best hits, texts with and without any, counts; all built-in aggregations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def best_hits(matches: DataFrame) -> DataFrame:
    """For each pattern and text the match of least cost, of those the one that ends first, + before -. An aggregate, so
    a text with many matches is reduced before the shuffle."""
    order = F.struct("cost", "text_end", "strand", "text_start", "pattern_start", "pattern_end", "match_region", "cigar")
    return matches.groupBy("pattern_id", "text_id").agg(F.min(order).alias("m")).select("pattern_id", "text_id", "m.*")


def hits_per_pattern(matches: DataFrame) -> DataFrame:
    return matches.groupBy("pattern_id").agg(F.count("*").alias("hits"), F.countDistinct("text_id").alias("texts"), F.min("cost").alias("best_cost"))


def strand_counts(matches: DataFrame) -> DataFrame:
    return matches.groupBy("pattern_id", "strand").agg(F.count("*").alias("hits"))


def with_hit(texts: DataFrame, matches: DataFrame, text_id: str = "text_id") -> DataFrame:
    """Texts with any match (semi-join)."""
    ids = matches.select(F.col("text_id").alias("__hit")).distinct()
    return texts.join(ids, F.col(text_id).cast("string") == F.col("__hit"), "left_semi")


def without_hit(texts: DataFrame, matches: DataFrame, text_id: str = "text_id") -> DataFrame:
    """Texts without any match (anti-join)."""
    ids = matches.select(F.col("text_id").alias("__hit")).distinct()
    return texts.join(ids, F.col(text_id).cast("string") == F.col("__hit"), "left_anti")


def summary(matches: DataFrame) -> DataFrame:
    """One row: matches found, each counted once."""
    return matches.agg(F.count("*").alias("total_found"))


def batch_plan(texts: DataFrame, limit: int = 1 << 18, text_id: str = "text_id", text: str = "text") -> DataFrame:
    """text_id and the number of the batch of about `limit` bytes in which it would be searched, in order of id. Bytes
    before a text are summed inside ranges of ids and then over the ranges."""
    from ..plans.ordered import running_before

    sizes = texts.select(F.col(text_id).alias("text_id"), F.coalesce(F.octet_length(F.col(text)), F.lit(0)).cast("long").alias("size"))
    return running_before(sizes, "text_id", "size").select("text_id", F.floor((F.col("before") + F.col("size")) / limit).cast("long").alias("batch_id"))
