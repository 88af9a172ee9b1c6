"""Tables of matches as TSV or Parquet."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SEARCH_COLUMNS = ("pat_id", "text_id", "cost", "strand", "start", "end", "match_region", "cigar")


def search_table(matches: DataFrame) -> DataFrame:
    """Matches under the names of the search table."""
    return matches.select(F.col("pattern_id").alias("pat_id"), "text_id", "cost", "strand", F.col("text_start").alias("start"), F.col("text_end").alias("end"), "match_region", "cigar")


def write_tsv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """A folder of tab-separated files, each with a header; written by the executors, in no order."""
    df.write.mode(mode).option("sep", "\t").option("header", True).option("emptyValue", "").csv(path)


def write_parquet(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).parquet(path)
