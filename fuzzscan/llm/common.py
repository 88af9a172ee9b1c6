"""Helpers shared by the pipeline operators: shared-folder tables, ordered prefix sums, Arrow slicing."""

from __future__ import annotations

import atexit
import ctypes
import os
import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A word, for the JVM's regular expressions.
WORD = r"[^\x20\x09-\x0D]+"
#: The white space that separates words; bytes.split() splits at exactly these.
SPACE = b" \t\n\x0b\x0c\r"
#: Lower-cases A-Z alone.
LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder (spark.checkpoint.dir). Where it is unset, as in tests, a temporary one, but only if
    driver and executors are one process: elsewhere each executor would write to a folder of its own."""
    context = spark.sparkContext
    at = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not at:
        if not re.match(r"local(\[|$)", context.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="fuzzscan-"))
        at = context.getCheckpointDir()
    return at


def _forget(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # the session has ended before; the folder belongs to the cluster's own cleaning
        pass


def written(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """Writes df as a Parquet table in the shared folder and returns the table: cuts the lineage, survives lost
    executors (Spark's commit protocol) and keeps column pruning. Deleted by done(), else when the application ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", codec).parquet(path)
    _paths[path] = spark
    out = spark.read.schema(df.schema).parquet(path)
    out._fuzzscan_path = path
    return out


def done(*tables: DataFrame) -> None:
    """Deletes written tables that nothing reads any more; leaves other frames alone."""
    for table in tables:
        path = getattr(table, "_fuzzscan_path", None)
        if path in _paths:
            _forget(_paths.pop(path), path)


#: Written tables that are still there, and their sessions.
_paths: dict[str, SparkSession] = {}
atexit.register(lambda: [_forget(spark, path) for path, spark in _paths.items()])


def prefixed(df: DataFrame, order: list, totals: dict[str, str | Column]) -> DataFrame:
    """Adds, by name, the sum of each of `totals` over all rows before a row in the order. Range partitions are summed on
    their own and shifted by the sums of the partitions before them, so no task sees more than one range; the driver gets
    one row for each range. Rows equal in the whole order follow each other in any order."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    placed = written(df.repartitionByRange(parts, *order).withColumn("__part", F.spark_partition_id()), "ranged")
    weights = {n: F.col(c) if isinstance(c, str) else c for n, c in totals.items()}
    sums = {r["__part"]: r for r in placed.groupBy("__part").agg(*[F.sum(c).alias(n) for n, c in weights.items()]).collect()}
    kinds = dict(placed.select(*[c.alias(n) for n, c in weights.items()]).dtypes)
    kinds = {n: "double" if k in ("double", "float") else "long" for n, k in kinds.items()}
    held, rows = {n: 0.0 if kinds[n] == "double" else 0 for n in weights}, []
    for k in sorted(sums):
        rows.append((k, *held.values()))
        held = {n: x + (sums[k][n] or 0) for n, x in held.items()}
    starts = df.sparkSession.createDataFrame(rows, ", ".join(["__part int", *(f"`__start_{n}` {kinds[n]}" for n in weights)]))
    window = Window.partitionBy("__part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    added = {n: F.col(f"__start_{n}") + F.coalesce(F.sum(c).over(window), F.lit(0)).cast(kinds[n]) for n, c in weights.items()}
    return placed.join(F.broadcast(starts), "__part").withColumns(added).drop("__part", *(f"__start_{n}" for n in weights))


def ranked(df: DataFrame, order: list) -> DataFrame:
    """Adds `position`, the gapless 0-based rank of each row in the order."""
    return prefixed(df, order, {"position": F.lit(1)})


def slices(batch: pa.RecordBatch, column: str, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The batch in slices of about `most` bytes of a string column, one row at least, so that what a task holds in
    Python is bounded by one row or `most`."""
    if not batch.num_rows:
        return
    col = batch.column(batch.schema.get_field_index(column))
    lengths = pc.binary_length(col).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    groups = np.cumsum(lengths + 64) // most
    edges = [0, *(np.flatnonzero(np.diff(groups)) + 1).tolist(), batch.num_rows]
    for a, b in zip(edges, edges[1:]):
        if b > a:
            yield batch.slice(a, b - a)


def release() -> None:
    """What Arrow and the C library hold for reuse goes back to the system."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def freed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches; release() at the end of the task, since Python workers outlive their tasks and share an executor's
    memory."""
    try:
        yield from batches
    finally:
        release()


def texts(batch: pa.RecordBatch, column: str = "text") -> list[str | None]:
    return batch.column(batch.schema.get_field_index(column)).to_pylist()


def joined(words: pa.Array) -> bytes:
    """The words, none of which is null or holds a space, with a space between each two: splitting that at spaces gives a
    list of them quicker than Arrow does."""
    return pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), words.cast(pa.binary())), b" ")[0].as_py()


def coded(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """XXH64 of the distinct words (A-Z lowered) as signed longs, the number of each word's in the order of the texts,
    and how many words each text has. Arrow splits and numbers them."""
    split = pc.ascii_split_whitespace(pc.ascii_lower(texts.fill_null("")))
    n = pc.list_value_length(split).to_numpy(zero_copy_only=False).astype(np.int64)
    table = split.flatten().dictionary_encode()
    keys, codes = joined(table.dictionary).split(b" ") if len(table) else [], table.indices.to_numpy()
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, keys), np.uint64, len(keys)).view(np.int64)
    if b"" in keys:  # white space at either end of a text leaves an empty string
        real = codes != keys.index(b"")
        n = np.bincount(np.repeat(np.arange(len(n)), n)[real], minlength=len(n))
        codes = codes[real]
    return hashes, codes, n


def mixed(x: np.ndarray) -> np.ndarray:
    """Unsigned 64-bit numbers with their bits spread; one to one."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def arrow_schema(ddl: str) -> pa.Schema:
    """pyarrow schema of a list like 'doc_id long, text string'."""
    kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "double": pa.float64(), "boolean": pa.bool_(), "binary": pa.binary()}
    return pa.schema([(n, kinds[k]) for n, k in (x.split() for x in re.split(r",\s*", ddl))])


def tokenizer_file(name: str) -> str:
    """Path of a public vocabulary file, by the package that installs them or by $FUZZSCAN_TOKENIZERS."""
    if at := os.environ.get("FUZZSCAN_TOKENIZERS"):
        return os.path.join(at, name)
    import public_tokenizers

    return public_tokenizers.path(name)
