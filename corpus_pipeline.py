"""The corpus pipeline: documents through language identification, quality rules, near-duplicate removal, mixing and
encoding. Each stage reads what the one before wrote."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from fuzzscan.llm import bpe, common, langid, mixing, near, quality


def identify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text looks like a language known from their labels; the others go."""
    docs = docs.select(*docs.columns)
    return langid.keep(docs, langid.fit(docs.where(~langid.held_out())))


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules."""
    return quality.keep(docs)


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, the one with the least id: SimHash candidates, verified to have sets
    of five-word shingles with a Jaccard similarity of 0.8 or more."""
    return near.keep(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as often as the mix of sources takes them, whole: mixing.apply()."""
    return mixing.apply(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Digests of the ids of every document left and of the bytes decoded from them."""
    return bpe.round_trip(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", identify),
    ("quality", rules),
    ("near_duplicates", deduplicate),
    ("mixing", mixed),
    ("encoding", tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the documents of sf_dir; each but the last is written to the shared folder and read again, and deleted
    when the next one is written.

    Any column may be null; null texts and texts without letters go with the first stage. A very long text is a document
    like any other. Rows with equal ids are told apart by their texts, and of equal rows one stays. Columns that documents
    have beyond their own are kept, whatever their names, up to the last stage. An empty table gives none."""
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        before, docs = docs, common.written(stage(spark, docs, sf_dir), f"stage-{name}")
        common.done(before)
    return STAGES[-1][1](spark, docs, sf_dir)


#: Fingerprints, hash thresholds and the fitted classifier are beyond SQL; tests hold run() against brute force.
ORACLE_SQL: str | None = None
