"""SimHash near-duplicates by the generalised pigeonhole principle: correlated bits are grouped into partitions, unequal
thresholds are allocated by dynamic programming on estimated candidate counts, then probed and verified."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

SEED, SHINGLE, DISTANCE = 42, 3, 3
#: Fingerprints from which partitions and thresholds are chosen; the choice moves cost between partitions, not results.
SAMPLE = 2048
#: Fingerprints of one bucket that one task compares; larger buckets are cut into pairs of blocks.
BLOCK = 4096
#: A fingerprint with more documents than both of these is resolved by broadcast: at most HOT_SHARE can be so common.
HOT_ROWS, HOT_SHARE = 1000, 500
_HASHES = 1 << 16


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """64-bit SimHash, unsigned; 0 for a text without words. Texts of fewer words than a shingle are one shingle."""
    words = (text or "").encode().translate(common.LOWER).split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) < shingle:
        return xxhash.xxh64_intdigest(joined, SEED)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    n = len(words) - shingle + 1
    ones = np.zeros(64, np.int64)
    for at in range(0, n, _HASHES):
        stop = min(n, at + _HASHES)
        digest = xxhash.xxh64_intdigest
        hashes = np.array([digest(joined[a:b], SEED) for a, b in zip(starts[at:stop].tolist(), ends[at + shingle - 1 : stop + shingle - 1].tolist())], ">u8")
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id and fp (the fingerprint's bits as a signed long)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = common.arrow_schema("doc_id long, fp long")
        for batch in batches:
            for part in common.slices(batch, "text"):
                fps = np.array([fingerprint(t, shingle) for t in common.texts(part)], np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(fps)], schema=schema)

    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(run, "doc_id long, fp long")


@dataclass(frozen=True)
class Plan:
    """Bit positions of each partition and the number of them in which a pair may differ; -1 leaves a partition out."""

    parts: tuple[tuple[int, ...], ...]
    allowed: tuple[int, ...]


def bits_of(sample: np.ndarray, words: int = 1) -> np.ndarray:
    """Rows of 0 and 1, lowest bit first, of fingerprints (rows x words)."""
    return np.unpackbits(np.ascontiguousarray(sample.reshape(-1, words)).astype("<u8").view(np.uint8), axis=1, bitorder="little").astype(np.float64).reshape(len(sample), 64 * words)


def grouped_bits(bits: np.ndarray, m: int) -> list[tuple[int, ...]]:
    """m partitions of all bits. Each starts with the free bit most correlated with the other free bits and takes those
    most correlated with its members, so that dependence is spent inside partitions and the rest stay selective."""
    total = bits.shape[1]
    widths = [total * (i + 1) // m - total * i // m for i in range(m)]
    if len(bits) < 2:
        return [tuple(range(total * i // m, total * (i + 1) // m)) for i in range(m)]
    x = bits - bits.mean(0)
    scale = np.sqrt((x * x).sum(0))
    link = np.abs(x.T @ x) / np.maximum(np.outer(scale, scale), 1e-9)
    np.fill_diagonal(link, 0)
    free, parts = np.ones(total, bool), []
    for width in widths:
        score, part = link[:, free].sum(1), []
        while len(part) < width:
            best = int(np.where(free, score, -1).argmax())
            part.append(best)
            free[best] = False
            score = link[:, part].sum(1)
        parts.append(tuple(sorted(part)))
    return parts


def costs(sample: np.ndarray, parts: list[tuple[int, ...]], n: int, most: int = 2) -> list[list[float]]:
    """For each partition the cost of leaving it out and of thresholds 0..most, in probes of n fingerprints (a row each)
    and candidates (a comparison each). Both sides are probed, so a threshold t brings together what differs in up to 2t
    bits of the partition: as often as pairs of the sample do, scaled to n, but no more rarely than random bits."""
    sample = sample if sample.ndim > 1 else sample[:, None]
    pairs, out = max(1, len(sample) * (len(sample) - 1) // 2), []
    for part in parts:
        mask = np.zeros(sample.shape[1], np.uint64)
        for b in part:
            mask[b >> 6] |= np.uint64(1 << (b & 63))
        at = np.flatnonzero(mask)
        near, held = np.zeros(2 * most + 2), sample[:, at] & mask[at]
        for i in range(len(sample) - 1):
            d = np.bitwise_count(held[i + 1 :] ^ held[i]).sum(1, dtype=np.int64)
            near += np.bincount(np.minimum(d, 2 * most + 1), minlength=2 * most + 2)
        row = [0.0]
        for t in range(most + 1):
            balls = [sum(comb(len(part), j) for j in range(r + 1)) for r in (t, 2 * t)]
            chance = max(near[: 2 * t + 1].sum() / pairs, balls[1] / 2.0 ** len(part))
            row.append(n * balls[0] * 4.0 + chance * n * n / 2 * 0.01)
        out.append(row)
    return out


def allocate(cost: list[list[float]], total: int) -> tuple[float, tuple[int, ...]]:
    """Thresholds t >= -1 whose sum of (t + 1) is total and whose costs add up to least; cost[i][t + 1]."""
    best: dict[int, tuple[float, tuple[int, ...]]] = {0: (0.0, ())}
    for row in cost:
        step: dict[int, tuple[float, tuple[int, ...]]] = {}
        for used, (sum_, picks) in best.items():
            for k, c in enumerate(row[: total - used + 1]):
                if used + k not in step or sum_ + c < step[used + k][0]:
                    step[used + k] = (sum_ + c, (*picks, k - 1))
        best = step
    return best.get(total, (float("inf"), ()))


def choose(sample: np.ndarray, n: int, distance: int = DISTANCE) -> Plan:
    """The cheapest plan for n fingerprints. If two differ in at most `distance` bits, then with thresholds t whose t + 1
    add up to distance + 1 they differ in at most t bits of some partition."""
    bits, best = bits_of(sample), None
    for m in range(2, distance + 4):
        parts = grouped_bits(bits, m)
        found = (*allocate(costs(sample, parts, n, min(distance, 2)), distance + 1), parts)
        if best is None or found[0] < best[0]:
            best = found
    return Plan(tuple(best[2]), best[1])


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def probes(fps: DataFrame, plan: Plan) -> DataFrame:
    """part, key, fp: for each partition in use, the masked fingerprint with every change of up to t of its bits."""
    def keys(i: int, mask: int, flips: list[int]) -> Column:
        # one parameter each: a second one would get the element's index
        masked = F.transform(F.array(*map(F.lit, flips)), lambda x: F.col("fp").bitwiseXOR(x).bitwiseAND(F.lit(mask)))
        return F.transform(masked, lambda k: F.struct(F.lit(i).alias("part"), k.alias("key")))

    made = []
    for i, (part, t) in enumerate(zip(plan.parts, plan.allowed)):
        if t >= 0:
            flips = [sum(1 << b for b in c) for j in range(t + 1) for c in combinations(part, j)]
            made.append(keys(i, _signed(sum(1 << b for b in part)), [_signed(x) for x in flips]))
    return fps.select("fp", F.explode(F.concat(*made) if len(made) > 1 else made[0]).alias("p")).select("p.part", "p.key", "fp")


def forest(values: np.ndarray, distance: int = DISTANCE) -> tuple[np.ndarray, np.ndarray]:
    """Links (numbers of rows) that span the components of these fingerprints (rows x words): a search in which each one
    found leaves the pool, so a tight group costs one comparison with each member and no pair is emitted twice."""
    left, a, b = np.arange(len(values)), [], []
    while len(left):
        stack, left = [left[0]], left[1:]
        while stack and len(left):
            x = stack.pop()
            near = np.bitwise_count(values[left] ^ values[x]).sum(1, dtype=np.int64) <= distance
            if near.any():
                found = left[near]
                a.append(np.full(len(found), x))
                b.append(found)
                stack.extend(found.tolist())
                left = left[~near]
    none = np.zeros(0, np.int64)
    return (np.concatenate(a), np.concatenate(b)) if a else (none, none)


def bucket_links(values: np.ndarray, distance: int = DISTANCE) -> tuple[np.ndarray, np.ndarray]:
    """Links of one bucket of fingerprints: all of them where they are few, else those of a forest."""
    a, b, found = [], [], 0
    for at in range(0, len(values), 256):
        i, j = np.nonzero(np.bitwise_count(values[at : at + 256, None] ^ values[None, at:]).sum(2, dtype=np.int16) <= distance)
        i, j = i[i < j], j[i < j]
        found += len(i)
        if found > len(values):
            return forest(values, distance)
        a.append(at + i)
        b.append(at + j)
    return np.concatenate(a), np.concatenate(b)


def tree(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The links that join what earlier ones have not joined."""
    up: dict[int, int] = {}
    keep = []
    for x, y in zip(a.tolist(), b.tolist()):
        while (p := up.get(x, x)) != x:
            up[x] = x = up.get(p, p)
        while (p := up.get(y, y)) != y:
            up[y] = y = up.get(p, p)
        keep.append(x != y)
        if x != y:
            up[max(x, y)] = min(x, y)
    keep = np.array(keep, bool)
    return a[keep], b[keep]


def _links(rows: DataFrame, key: list[str], words: list[str], distance: int = DISTANCE) -> DataFrame:
    """a, b: links that connect what is connected inside each bucket (equal key columns), verified by the fingerprints in
    the columns `words`. rows must hold a bounded number of fingerprints a bucket. Buckets are streamed in order: memory
    holds a batch and one bucket."""
    ddl = "a long, b long"

    def compared(bucket: np.ndarray, fp: np.ndarray, v: np.ndarray) -> pa.RecordBatch:
        """Buckets of a few by shifts of the whole array, the others one by one."""
        edges = np.flatnonzero(np.diff(bucket)) + 1
        sizes = np.diff(np.concatenate([[0], edges, [len(bucket)]]))
        few = np.flatnonzero(np.repeat(sizes <= 16, sizes))
        out_a, out_b, w, g = [], [], v[few], bucket[few]
        for d in range(1, 16):
            same = np.flatnonzero(g[d:] == g[:-d])
            near = same[np.bitwise_count(w[same + d] ^ w[same]).sum(1, dtype=np.int64) <= distance]
            out_a.append(few[near])
            out_b.append(few[near + d])
        at = np.cumsum(sizes) - sizes
        for s, n in zip(at[sizes > 16], sizes[sizes > 16]):
            own = s + np.unique(fp[s : s + n], return_index=True)[1]
            x, y = bucket_links(v[own], distance)
            out_a.append(own[x])
            out_b.append(own[y])
        a, b = fp[np.concatenate(out_a)], fp[np.concatenate(out_b)]
        a, b = tree(a[a != b], b[a != b])
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], schema=common.arrow_schema(ddl))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in common.freed(batches):
            cols = [c.to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns]
            cols = cols if rest is None else [np.concatenate(x) for x in zip(rest, cols)]
            if not len(cols[0]):
                continue
            new = np.any([c[1:] != c[:-1] for c in cols[: len(key)]], 0)
            bucket = np.concatenate([[0], np.cumsum(new)])
            last = np.searchsorted(bucket, bucket[-1])
            if last:
                yield compared(bucket[:last], cols[len(key)][:last], np.stack([c[:last] for c in cols[-len(words) :]], 1).view(np.uint64))
            rest = [c[last:] for c in cols]
        if rest is not None and len(rest[0]) > 1:
            yield compared(np.zeros(len(rest[0]), np.int64), rest[len(key)], np.stack(rest[-len(words) :], 1).view(np.uint64))

    return rows.select(*key, *dict.fromkeys(["fp", *words])).repartition(*key).sortWithinPartitions(*key).mapInArrow(run, ddl)


def matched(rows: DataFrame, key: list[str], words: list[str], distance: int, block: int = BLOCK) -> DataFrame:
    """a, b: links inside the buckets of probe rows (key columns, fp, words). Buckets of over `block` rows are cut into
    blocks by a hash and every pair of blocks is one task's bucket, so no candidate is left out and no task holds more
    than about twice a block."""
    large = common.written(rows.groupBy(*key).count().where(F.col("count") > block), "large")
    n_large = large.count()
    if not n_large:
        return _links(rows, key, words, distance)
    side = F.broadcast(large) if n_large <= 100_000 else large.hint("merge")  # 100,000 rows of 24 bytes
    small = rows.join(side, key, "left_anti")
    cut = rows.join(side, key).withColumn("blocks", F.ceil(F.col("count") / F.lit(block)).cast("int"))
    cut = cut.withColumn("own", F.pmod(F.xxhash64(F.lit("block"), "fp"), F.col("blocks")).cast("int"))
    cut = cut.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    cut = cut.withColumns({"i": F.least("own", "other"), "j": F.greatest("own", "other")})
    return _links(small, key, words, distance).unionAll(_links(cut, [*key, "i", "j"], words, distance))


def links(fps: DataFrame, n: int, distance: int = DISTANCE, block: int = BLOCK) -> DataFrame:
    """a, b: links between distinct fingerprints that connect all within `distance`. fps: a written table of n distinct
    fp."""
    share = min(1.0, SAMPLE / max(1, n))
    sample = fps.where(F.pmod(F.xxhash64(F.lit("plan"), "fp"), F.lit(1 << 30)) < F.lit(int(share * (1 << 30)))).select("fp").toPandas()["fp"].to_numpy(np.int64).view(np.uint64)
    return matched(probes(fps, choose(np.sort(sample), n, distance)), ["part", "key"], ["fp"], distance, block)


def components(edges: DataFrame, most: int = 60) -> DataFrame:
    """node, root of every node of the links (a, b): root is the least node of the component. Alternating large-star and
    small-star steps; each writes its links to the shared folder, which replaces those before, and they are done when a
    step changes nothing. A node with very many links is one key of narrow rows, 16 bytes a link, after distinct()."""

    def star(e: DataFrame, large: bool) -> DataFrame:
        both = e.unionAll(e.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        joined = both.join(least, "a")
        if large:
            return joined.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        return joined.where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionAll(least.select("a", F.col("m").alias("b"))).where("a != b").distinct()

    state = common.written(edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    mark = None
    if not state.limit(1).count():
        return state.select(F.col("a").alias("node"), F.col("b").alias("root"))
    for _ in range(most):
        before, middle = state, common.written(star(state, True), "star")
        state = common.written(star(middle, False), "star")
        common.done(before, middle)
        now = tuple(state.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if now == mark:
            return state.select(F.col("a").alias("node"), F.col("b").alias("root")).unionAll(state.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
        mark = now
    raise RuntimeError("the components did not settle")


def resolve(docs: DataFrame, distance: int = DISTANCE, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, fp, component_id of every document.

    Copies meet as one fingerprint with its least id (summed before the shuffle), and links join distinct fingerprints
    only. Null and empty texts have fingerprint 0; a bit set in just half of the hashes is 0; a very long text is hashed in
    parts. Repeated rows each get a row; null ids are kept, never name a component, and get null if all ids reachable are
    null; an empty table gives none; other columns are ignored."""
    prints = common.written(fingerprints(docs, shingle), "fingerprints")
    fps = common.written(prints.groupBy("fp").agg(F.min("doc_id").alias("label"), F.count("*").alias("n")), "distinct")
    return named(prints, fps, links(fps, fps.count(), distance))


def by_print(prints: DataFrame, names: DataFrame) -> DataFrame:
    """prints (fp, ...) with the columns of names (fp, n, ...): a row for each distinct fp, n its rows. Fingerprints that
    very many rows share are joined by broadcast, so that none is a hot key."""
    total = names.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    is_hot = F.col("n") > max(HOT_ROWS, total // HOT_SHARE)
    hot = F.broadcast(names.where(is_hot).drop("n"))  # HOT_SHARE rows at most
    return prints.join(hot, "fp").unionByName(prints.join(hot, "fp", "left_anti").join(names.where(~is_hot).drop("n").hint("merge"), "fp"))


def named(prints: DataFrame, fps: DataFrame, edges: DataFrame) -> DataFrame:
    """doc_id, fp, component_id of every row of prints (doc_id, fp). fps: fp, label (its least id) and n (its rows)."""
    roots = components(edges)
    joined = common.written(fps.join(roots.withColumnRenamed("node", "fp").hint("merge"), "fp", "left").withColumn("root", F.coalesce("root", "fp")), "rooted")
    least = joined.groupBy("root").agg(F.min("label").alias("component_id"))
    names = common.written(joined.join(least, "root").select("fp", "component_id", "n"), "named")
    return by_print(prints, names).select("doc_id", "fp", "component_id")


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    return resolve(common.table(spark, sf_dir, "documents")).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
