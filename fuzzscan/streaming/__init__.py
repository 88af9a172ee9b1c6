"""The search on streams: it keeps no state, so it appends and needs no watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..operators.search import search


def search_stream(texts: DataFrame, patterns: list[tuple[str, bytes]], k: int, **how) -> DataFrame:
    """Matches of a stream of texts, as they arrive."""
    if not texts.isStreaming:
        raise ValueError("the texts are no stream")
    return search(texts, patterns, k, **how)


def write_stream(matches: DataFrame, path: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Appends matches to Parquet files, each match once."""
    writer = matches.writeStream.format("parquet").outputMode("append").option("path", path).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
