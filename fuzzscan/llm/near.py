"""SimHash near-duplicates by the similarity of shingle sets: wide fingerprints of the distinct shingles, candidates by the
generalised pigeonhole of simhash, and every link verified on the whole sets."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import acos, ceil, log, log2, pi, sqrt

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common, simhash

SHINGLE = 5
#: Least Jaccard similarity of a link, as a fraction.
UP, DOWN = 4, 5
#: Share of the pairs just at that similarity that some partition must bring together; more similar ones are found more
#: often. The number of partitions follows from it, so it holds at every size.
RECALL = 0.997
#: Share of bits in which the fingerprints of a pair just at that similarity differ: the angle between the sets.
APART = acos(2 * UP / (UP + DOWN)) / pi
#: Words of the fingerprint that candidates carry and are compared by, and standard deviations allowed beyond APART.
CHECK, SLACK = 3, 3.3
#: Documents and shingles of one block of a component that is verified at once; larger components are cut into blocks.
BLOCK_DOCS, BLOCK_SHINGLES = 1024, 1 << 20
#: Rows of a table that is broadcast (at most 32 bytes each); a larger one is joined by sorting.
MOST = 500_000
_MANY = np.uint64(0x0101010101010101)


def _odd(n: int) -> np.ndarray:
    """n odd constants, from the hashes of 0..n-1."""
    return np.array([xxhash.xxh64_intdigest(i.to_bytes(8, "little"), simhash.SEED) | 1 for i in range(n)], np.uint64)


def shingles(texts: pa.Array, size: int = SHINGLE) -> list[np.ndarray]:
    """For each text the hashes of its distinct shingles (A-Z lowered), ascending: XXH64 of the words, combined with a
    constant for each place. A text of fewer words than a shingle is one shingle, a text without words has none."""
    hashes, codes, n = common.coded(texts)
    words, place = hashes.view(np.uint64)[codes] if len(codes) else np.zeros(0, np.uint64), _odd(size)
    joined = np.zeros(max(0, len(words) - size + 1), np.uint64)
    for i in range(size if len(joined) else 0):
        joined += words[i : i + len(joined)] * place[i]
    joined = common.mixed(joined)
    out, at = [], 0
    for m in n.tolist():
        if m >= size:
            out.append(np.unique(joined[at : at + m - size + 1]))
        else:
            out.append(common.mixed(np.array([(words[at : at + m] * place[:m]).sum(dtype=np.uint64) + np.uint64(m)], np.uint64)) if m else np.zeros(0, np.uint64))
        at += m
    return out


def wide(sets: list[np.ndarray], words: int) -> np.ndarray:
    """SimHash of words x 64 bits of each set: a bit is 1 if set in over half of the hashes. Bits are counted eight at a
    time in the bytes of 64-bit sums over at most 255 hashes."""
    sizes = np.array([len(s) for s in sets], np.int64)
    flat = np.concatenate([np.zeros(0, np.uint64), *sets])
    out = np.zeros((len(sets), words), np.uint64)
    some = np.flatnonzero(sizes)
    if not len(some):
        return out
    begins = (np.cumsum(sizes) - sizes)[some]
    parts = -(-sizes[some] // 255)
    inner = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
    starts, heads = np.repeat(begins, parts) + 255 * inner, np.cumsum(parts) - parts
    for j, c in enumerate(_odd(words + 8)[8:]):
        x = common.mixed(flat * c)
        bits = np.empty((len(some), 8, 8), bool)  # document, byte, bit
        for k in range(8):
            sums = np.add.reduceat((x >> np.uint64(k)) & _MANY, starts)
            each = np.add.reduceat(sums.view(np.uint8).reshape(-1, 8).astype(np.int64), heads, axis=0)
            bits[:, :, k] = 2 * each > sizes[some, None]
        out[some, j] = np.packbits(bits.reshape(len(some), 64), axis=1, bitorder="little").view("<u8").reshape(-1)
    return out


def layout(n: int) -> tuple[int, int, int]:
    """Width of a partition, partitions that RECALL needs, and words of the fingerprint, for n distinct sets: about 256
    sets agree by chance in a partition, at every size."""
    width = max(8, round(log2(max(2, n))) - 8)
    needed = ceil(log(1 - RECALL) / log(1 - (1 - APART) ** width))
    return width, needed, max(CHECK, -(-width * needed // 64))


def prints(docs: DataFrame, words: int, size: int = SHINGLE) -> DataFrame:
    """doc_id, tid (a hash of the text), fp (a hash of the shingle set), n (its size) and p0, p1, ... (its fingerprint)."""
    columns = [f"p{j}" for j in range(words)]
    ddl = "doc_id long, tid long, fp long, n int, " + ", ".join(f"{c} long" for c in columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = common.arrow_schema(ddl)
        for batch in common.freed(batches):
            for part in common.slices(batch, "text", 2 << 20):
                sets = shingles(part.column(2), size)
                fp = np.array([xxhash.xxh64_intdigest(s.tobytes(), simhash.SEED) for s in sets], np.uint64).view(np.int64)
                bits = wide(sets, words).view(np.int64)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(fp), pa.array([len(s) for s in sets], pa.int32()), *(pa.array(bits[:, j]) for j in range(words))], schema=schema)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("tid"), "text").mapInArrow(run, ddl)


def probes(fps: DataFrame, plan: simhash.Plan, words: int) -> DataFrame:
    """key, fp, c0..: for each partition in use, a hash of its bits with every change of up to its threshold."""
    used = [(i, part, t) for i, (part, t) in enumerate(zip(plan.parts, plan.allowed)) if t >= 0]
    checks = [f"c{j}" for j in range(CHECK)]
    ddl = "key long, fp long, " + ", ".join(f"{c} long" for c in checks)
    masks = []
    for i, part, t in used:
        for flips in (c for j in range(t + 1) for c in combinations(part, j)):
            mask, flip = np.zeros(words, np.uint64), np.zeros(words, np.uint64)
            for b in part:
                mask[b >> 6] |= np.uint64(1 << (b & 63))
            for b in flips:
                flip[b >> 6] |= np.uint64(1 << (b & 63))
            masks.append((np.uint64(i + 1), mask, flip))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema, odd = common.arrow_schema(ddl), _odd(words + 1)
        for batch in batches:
            fp = batch.column(0)
            own = np.stack([c.to_numpy().view(np.uint64) for c in batch.columns[1:]], 1)
            for number, mask, flip in masks:
                at = np.flatnonzero(mask)
                key = common.mixed(((own[:, at] ^ flip[at]) & mask[at]) @ odd[at] + number * odd[words])
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), fp, *batch.columns[1 : 1 + CHECK]], schema=schema)

    return fps.select("fp", *[f"p{j}" for j in range(words)]).mapInArrow(run, ddl)


def candidates(fps: DataFrame, n: int, block: int = simhash.BLOCK) -> DataFrame:
    """a, b: links between distinct sets whose fingerprints agree in some partition and differ in few enough bits; of each
    bucket those that connect what is connected in it. fps: a written table of fp and p0, p1, ..."""
    width, needed, words = layout(n)
    columns = [f"p{j}" for j in range(words)]
    share = min(1.0, simhash.SAMPLE / max(1, n))
    picked = fps.where(F.pmod(F.xxhash64(F.lit("plan"), "fp"), F.lit(1 << 30)) < F.lit(int(share * (1 << 30)))).select(*columns).toPandas()
    sample = np.sort(picked.to_numpy(np.int64).view(np.uint64), axis=0) if not len(picked) else picked.sort_values(columns).to_numpy(np.int64).view(np.uint64)
    parts = simhash.grouped_bits(simhash.bits_of(sample, words), words * 64 // width)
    plan = simhash.Plan(tuple(parts), simhash.allocate(simhash.costs(sample, parts, n, 1), needed)[1])
    bits = 64 * CHECK
    most = int(bits * APART + SLACK * sqrt(bits * APART * (1 - APART)))
    return simhash.matched(probes(fps, plan, words), ["key"], [f"c{j}" for j in range(CHECK)], most, block)


def linked(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of sets as similar as UP / DOWN, as links that span what is connected: a search in which each set found
    leaves the pool. A set meets the others through the lists of sets that hold its shingles, so all overlaps are exact."""
    sizes = np.array([len(s) for s in sets], np.int64)
    flat, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes)
    code = np.unique(flat, return_inverse=True)[1]
    order = np.argsort(code, kind="stable")
    holders, counts = owner[order], np.bincount(code)
    begins, at = np.cumsum(counts) - counts, np.cumsum(sizes) - sizes
    open_ = np.ones(len(sets), bool)
    a, b = [], []
    for first in range(len(sets)):
        if not open_[first]:
            continue
        open_[first] = False
        stack = [first]
        while stack:
            x = stack.pop()
            own = code[at[x] : at[x] + sizes[x]]
            lists = counts[own]
            total = int(lists.sum())
            inner = np.arange(total) - np.repeat(np.cumsum(lists) - lists, lists)
            same = np.bincount(holders[np.repeat(begins[own], lists) + inner], minlength=len(sets))
            near = np.flatnonzero(open_ & (DOWN * same >= UP * (sizes[x] + sizes - same)) & (same > 0))
            if len(near):
                open_[near] = False
                a.append(np.full(len(near), x))
                b.append(near)
                stack.extend(near.tolist())
    none = np.zeros(0, np.int64)
    return (np.concatenate(a), np.concatenate(b)) if a else (none, none)


def _verified(rows: DataFrame) -> DataFrame:
    """a, b: verified links inside each bucket (root, i, j) of rows (root, i, j, fp, shingles). Memory holds a batch and a
    bucket, which two blocks bound."""
    ddl = "a long, b long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, fps, sets = None, [], []

        def flush() -> pa.RecordBatch:
            a, b = linked(sets)
            own = np.array(fps, np.int64)
            return pa.RecordBatch.from_arrays([pa.array(own[a]), pa.array(own[b])], schema=common.arrow_schema(ddl))

        for batch in common.freed(batches):
            for *now, fp, raw in zip(*(c.to_pylist() for c in batch.columns)):
                if now != key:
                    if len(fps) > 1:
                        yield flush()
                    key, fps, sets = now, [], []
                if not fps or fps[-1] != fp:  # copies of a text that several tasks have read
                    fps.append(fp)
                    sets.append(np.frombuffer(raw, np.uint64))
        if len(fps) > 1:
            yield flush()

    return rows.select("root", "i", "j", "fp", "shingles").repartition("root", "i", "j").sortWithinPartitions("root", "i", "j", "fp").mapInArrow(run, ddl)


def _small(df: DataFrame, n: int) -> DataFrame:
    return F.broadcast(df) if n <= MOST else df.hint("merge")


def verified(docs: DataFrame, fps: DataFrame, roots: DataFrame, size: int = SHINGLE, block_docs: int = BLOCK_DOCS) -> DataFrame:
    """a, b: links as similar as UP / DOWN inside the components of candidates (node, root). One text of each set is read
    again. First each block of a component is searched; where a component of several blocks is not yet connected, all its
    pairs of blocks are."""
    members = common.written(fps.select("fp", "n", "first").join(roots.withColumnRenamed("node", "fp").hint("merge"), "fp"), "members")
    n = members.count()
    blocks = F.greatest(F.ceil(F.count("*") / F.lit(block_docs)), F.ceil(F.sum("n") / F.lit(BLOCK_SHINGLES))).cast("int")
    large = common.written(members.groupBy("root").agg(blocks.alias("blocks")).where("blocks > 1"), "large")
    sized = members.join(_small(large, large.count()), "root", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    sized = common.written(sized.withColumn("i", F.pmod(F.xxhash64(F.lit("block"), "fp"), F.col("blocks")).cast("int")), "blocks")
    ddl = "root long, i int, blocks int, fp long, shingles binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in common.freed(batches):
            for part in common.slices(batch, "text", 2 << 20):
                fresh = []
                for fp in part.column(3).to_pylist():
                    fresh.append(fp not in seen)
                    seen.add(fp)
                part = part.filter(pa.array(fresh, pa.bool_()))
                yield pa.RecordBatch.from_arrays([*part.columns[:4], pa.array([s.tobytes() for s in shingles(part.column(4), size)], pa.binary())], schema=common.arrow_schema(ddl))

    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("tid"), "text")
    wanted = sized.select("root", "i", "blocks", "fp", F.col("first.id").alias("w_id"), F.col("first.tid").alias("w_tid"))
    found = keyed.join(_small(wanted, n), (F.col("tid") == F.col("w_tid")) & F.col("doc_id").eqNullSafe(F.col("w_id")))
    own = common.written(found.select("root", "i", "blocks", "fp", "text").mapInArrow(run, ddl), "sets")
    once = common.written(_verified(own.withColumn("j", F.col("i"))), "verified")
    exact = simhash.components(once)
    named = sized.where("blocks > 1").join(exact.select(F.col("node").alias("fp"), F.col("root").alias("exact")).hint("merge"), "fp", "left")
    split = named.groupBy("root").agg(F.min(F.coalesce("exact", "fp")).alias("x"), F.max(F.coalesce("exact", "fp")).alias("y")).where("x < y").select("root")
    rest = own.where("blocks > 1").join(split.hint("merge"), "root", "left_semi")
    other = F.explode(F.expr("filter(sequence(0, blocks - 1), x -> x != i)"))
    pairs = rest.withColumn("other", other).select("root", F.least("i", "other").alias("i"), F.greatest("i", "other").alias("j"), "fp", "shingles")
    return once.unionAll(_verified(pairs))


def _first() -> Column:
    """What orders the rows of a group: rows with an id come first, then by id, then by a hash of the text."""
    return F.struct(F.col("doc_id").isNull().alias("gone"), F.col("doc_id").alias("id"), "tid")


def names(docs: DataFrame, size: int = SHINGLE, block: int = simhash.BLOCK, block_docs: int = BLOCK_DOCS) -> tuple[DataFrame, DataFrame]:
    """The prints of docs, and for each distinct fp the `first` row (gone, id, tid) of its component, with n, its rows."""
    n = docs.count()
    words = layout(n)[2]
    own = common.written(prints(docs, words, size).withColumn("first", _first()), "prints")
    columns = [F.first(f"p{j}").alias(f"p{j}") for j in range(words)]
    fps = common.written(own.groupBy("fp").agg(F.min("first").alias("first"), F.count("*").alias("rows"), F.first("n").alias("n"), *columns), "distinct")
    loose = simhash.components(candidates(fps, n, block))
    exact = simhash.components(verified(docs, fps, common.written(loose, "loose"), size, block_docs))
    placed = fps.select("fp", "first", "rows").join(exact.withColumnRenamed("node", "fp").hint("merge"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    placed = common.written(placed, "placed")
    least = placed.groupBy("root").agg(F.min("first").alias("least"))
    return own.select("doc_id", "tid", "fp", "first"), common.written(placed.join(least.hint("merge"), "root").select("fp", F.col("least").alias("kept"), F.col("rows").alias("n")), "named")


def resolve(docs: DataFrame, size: int = SHINGLE, **blocks: int) -> DataFrame:
    """doc_id, fp (a hash of the shingle set), component_id (the least doc_id of the component) and kept (whether this row,
    or one equal to it in id and text, is the one that keep() leaves).

    Links join sets of shingles of `size` words whose Jaccard similarity is UP / DOWN or more: no link is given that does
    not hold, and RECALL of those just at that similarity are found by a partition of their own, the more similar ones
    more often. Null and empty texts and texts without words are copies of each other; repeated rows each get a row; null
    ids come last and are named by an id of their component; a very long text is one set; an empty table gives none;
    other columns are ignored."""
    rows, named = names(docs, size, **blocks)
    return simhash.by_print(rows, named).select("doc_id", "fp", F.col("kept.id").alias("component_id"), (F.col("first") == F.col("kept")).alias("kept"))


def keep(docs: DataFrame, size: int = SHINGLE) -> DataFrame:
    """The rows of docs, with all columns, of one document of each component: that with the least id, of several with
    that id the one whose text has the least hash, and of rows equal in both any one. Cases as for resolve()."""
    rows, named = names(docs, size)
    judged = common.written(simhash.by_print(rows, named).select("doc_id", "tid", (F.col("first") == F.col("kept")).alias("stays")), "judged")
    lost = judged.where("not stays").select(F.col("doc_id").alias("__near_id"), F.col("tid").alias("__near_tid")).distinct()
    n, tid = judged.where("not stays").count(), F.xxhash64(docs["text"])
    if n <= MOST:
        kept = docs.join(F.broadcast(lost), docs["doc_id"].cast("long").eqNullSafe(F.col("__near_id")) & (tid == F.col("__near_tid")), "left_anti")
    else:
        stays = judged.where("stays").select(F.col("doc_id").alias("__near_id"), F.col("tid").alias("__near_tid"))
        kept = docs.join(stays.hint("merge"), docs["doc_id"].cast("long").eqNullSafe(F.col("__near_id")) & (tid == F.col("__near_tid")), "left_semi")
    again = judged.where("stays").groupBy("doc_id", "tid").count().where("count > 1").select(F.col("doc_id").alias("__near_id"), F.col("tid").alias("__near_tid"))
    again = common.written(again, "repeated")
    twice = again.count()
    if not twice:
        return kept
    at = kept["doc_id"].cast("long").eqNullSafe(F.col("__near_id")) & (F.xxhash64(kept["text"]) == F.col("__near_tid"))
    once = kept.join(_small(again, twice), at, "left_semi").dropDuplicates(["doc_id", "text"])
    return kept.join(_small(again, twice), at, "left_anti").unionAll(once)
