"""FASTA, FASTQ and guide files, plain or gzip, from any path that Spark reads."""

from __future__ import annotations

import gzip
import io
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_fasta(spark: SparkSession, path: str | list[str], id_mode: str = "header") -> DataFrame:
    """text_id and text (binary) of every record. Records are split at a line that begins with >, by Spark's own text
    reader, so large files are read in parallel (gzip files whole). id_mode: `header` is the whole line, `first_token`
    its first word."""
    rows = spark.read.text(path, lineSep="\n>")
    value = F.regexp_replace(F.col("value"), r"^>", "")
    rows = rows.select(value.alias("v")).select(F.substring_index("v", "\n", 1).alias("h"), F.when(F.instr("v", "\n") > 0, F.regexp_replace(F.expr("substring(v, instr(v, '\\n') + 1)"), r"[\r\n]", "")).otherwise("").alias("text"))
    header = F.regexp_replace(F.col("h"), r"\r$", "")
    if id_mode == "first_token":
        header = F.regexp_extract(header, r"^(\S*)", 1)
    elif id_mode != "header":
        raise ValueError("id_mode is header or first_token")
    return rows.where("h <> '' or text <> ''").select(header.alias("text_id"), F.col("text").cast("binary").alias("text"))


def records(data: bytes) -> Iterator[tuple[str, bytes]]:
    """(header, sequence) of a FASTA or FASTQ file's bytes, gzip or not; gzip is inflated as it is read."""
    lines = io.BytesIO(data)
    if data[:2] == b"\x1f\x8b":
        lines = io.BufferedReader(gzip.GzipFile(fileobj=lines), 1 << 20)
    header, parts = None, []
    while line := lines.readline():
        line = line.rstrip(b"\r\n")
        if line.startswith(b"@") and header is None:
            name, seq = line[1:], []
            while (line := lines.readline()) and not line.startswith(b"+"):
                seq.append(line.strip())
            sequence, quality = b"".join(seq), 0
            while quality < len(sequence) and (line := lines.readline()):
                quality += len(line.rstrip(b"\r\n"))
            yield name.decode(), sequence
        elif line.startswith(b">"):
            if header is not None:
                yield header.decode(), b"".join(parts)
            header, parts = line[1:], []
        elif header is not None:
            parts.append(line.strip())
        elif line:
            raise ValueError("neither FASTA nor FASTQ")
    if header is not None:
        yield header.decode(), b"".join(parts)


def read_fastx(spark: SparkSession, path: str | list[str], id_mode: str = "header") -> DataFrame:
    """text_id and text of every record of FASTA or FASTQ files; a file is read by one task, which holds its bytes as they
    are stored (2 GB at most) and some 16 MB of records."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column(0).to_pylist():
                ids, seqs, size = [], [], 0
                for name, seq in records(data):
                    ids.append(name.split(maxsplit=1)[0] if id_mode == "first_token" and name.split() else name)
                    seqs.append(seq)
                    size += len(seq)
                    if size > 16 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(seqs, pa.binary())], names=["text_id", "text"])
                        ids, seqs, size = [], [], 0
                if ids:
                    yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(seqs, pa.binary())], names=["text_id", "text"])

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, "text_id string, text binary")


def read_patterns(spark: SparkSession, path: str) -> DataFrame:
    """pattern_id and pattern of a FASTA file."""
    return read_fastx(spark, path).select(F.col("text_id").alias("pattern_id"), F.col("text").alias("pattern"))


def inline_pattern(pattern: str | bytes) -> list[tuple[str, bytes]]:
    """One pattern with the id `pattern`."""
    return [("pattern", pattern.encode() if isinstance(pattern, str) else bytes(pattern))]


def read_guides(spark: SparkSession, path: str) -> list[str]:
    """The lines of a guide file in order, blank ones left out. A guide file is small: it is the driver's argument."""
    whole = [r.value for r in spark.read.text(path, wholetext=True).collect()]
    return [line.strip() for text in whole for line in text.splitlines() if line.strip()]
