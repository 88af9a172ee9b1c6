"""Mixing sources to target weights: hash-threshold histograms find nested budget thresholds without sorting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

#: Bits of a document's hash, and those that one level of the histogram resolves. After LEVELS levels what is left of a
#: source's boundary bucket is a share of 2 ** -(STEP x LEVELS) of its hashes, which is read exactly.
BITS, STEP, LEVELS = 60, 12, 2
#: Sources up to which their plan is broadcast (names of up to NAME characters); beyond, it is joined with SALT parts of
#: each source.
MOST_SOURCES, NAME, SALT = 20_000, 256, 32


def words(text: Column) -> Column:
    """Number of words; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(common.WORD)), F.lit(0)).cast("long")


def order_key(seed: int) -> Column:
    """The document's place in [0, 2^60): it depends on doc_id alone, or on the text where doc_id is null."""
    by = F.when(F.col("doc_id").isNull(), F.concat(F.lit(f"{seed}t"), F.coalesce("text", F.lit("")))).otherwise(F.concat(F.lit(f"{seed}:"), F.col("doc_id").cast("string")))
    return F.conv(F.substring(F.md5(by), 1, BITS // 4), 16, 10).cast("long")


def targets(sizes: DataFrame, weights: tuple[float, ...] = (1.0, 2.0, 3.0), share: float = 1.0, most: float = 3.0) -> DataFrame:
    """source, source_size, target. sizes: source, source_size, a row for each source.

    Sources by code point, null last, get the weights in turn, repeating. They share `share` of all sizes by weight; a
    target stops at `most` times its source's size and the excess is reshared. That is the level L at which the sum of
    min(weight x L, cap) is the total. In the order of cap / weight the capped sources come first, so L follows from
    prefix sums: it is the first (total - caps before) / (weights from here on) that is no more than cap / weight here."""
    placed = common.ranked(sizes, [F.col("source").asc_nulls_last()])
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("position") % len(weights) + 1).cast("int"))
    caps = common.written(placed.select("source", "source_size", (F.col("source_size") * F.lit(float(most))).alias("cap"), weight.alias("weight")).withColumn("ratio", F.col("cap") / F.col("weight")), "caps")
    all_size, all_weight = caps.agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.sum("weight"), F.lit(0.0))).first()
    total = min(share, most) * all_size
    steps = common.prefixed(caps, [F.col("ratio"), F.col("source").asc_nulls_last()], {"held": "cap", "passed": "weight"})
    level = (F.lit(float(total)) - F.col("held")) / (F.lit(float(all_weight)) - F.col("passed"))
    found = steps.withColumn("level", level).where("level <= ratio").agg(F.min_by("level", F.struct("ratio", "level"))).first()[0]
    # every source is capped if no level is found
    reach = F.col("weight") * F.lit(float("inf") if found is None else float(found))
    return caps.select("source", "source_size", F.least(F.col("cap"), reach).alias("target"))


def _by_source(rows: DataFrame, plan: DataFrame, sources: int) -> DataFrame:
    """rows joined with their source's row of plan (its name as `of`). Few sources are broadcast; else every source is cut
    into SALT parts by hash, so that a hot one is no single key."""
    if sources <= MOST_SOURCES and not plan.where(F.length("of") > NAME).limit(1).count():
        return rows.join(F.broadcast(plan), rows["source"].eqNullSafe(plan["of"])).drop("of")
    salted = plan.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
    cut = rows.withColumn("__salt", F.pmod(F.xxhash64("h"), F.lit(SALT)).cast("int"))
    return cut.join(salted.hint("merge"), cut["source"].eqNullSafe(salted["of"]) & (cut["__salt"] == salted["__salt"])).drop("of", "__salt")


def _boundary(sums: DataFrame, state: DataFrame, key: str) -> DataFrame:
    """For each source (`of`, `need`): the least key at which the running sum of `s` is above the need, what is still
    needed of it, and its sum. sums: source, key, s."""
    upto = Window.partitionBy("source").orderBy(key).rowsBetween(Window.unboundedPreceding, 0)
    joined = sums.join(state.select("of", "need"), F.col("source").eqNullSafe(F.col("of")))
    passed = joined.withColumn("upto", F.sum("s").over(upto)).where("upto > need")
    return passed.groupBy("of").agg(F.min_by(F.struct(F.col(key).alias("at"), (F.col("need") - F.col("upto") + F.col("s")).alias("need"), F.col("s").alias("held")), key).alias("b")).select("of", "b.*")


def plan(rows: DataFrame, **shares) -> tuple[DataFrame, int]:
    """The number of sources and, for each: of (its name), source_size, target, copies (whole passes), cut, rest and tied.

    Documents whose hash is below `cut` get one pass more; those at the cut, which hold `tied` words, give `rest` words of
    theirs. Sizes are summed by source and hash bucket, the bucket in which the budget ends is the only one that the next
    level reads, and the thresholds of the levels are nested. rows: a table of source, size and h."""
    top = BITS - STEP
    first = common.written(rows.groupBy("source", F.shiftright("h", top).alias("bucket")).agg(F.sum("size").alias("s")), "buckets")
    goal = targets(common.written(first.groupBy("source").agg(F.sum("s").alias("source_size")), "sources"), **shares)
    copies = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    goal = goal.withColumn("copies", copies.cast("int")).withColumn("need", F.floor(F.col("target") - F.col("copies") * F.col("source_size")).cast("long"))
    goal = common.written(goal.withColumnRenamed("source", "of"), "goals")
    sources = goal.count()
    state = goal.where("need > 0").select("of", "need")
    inside, sums = rows, first
    for level in range(1, LEVELS + 1):
        state = common.written(_boundary(sums, state, "bucket"), "boundary")
        shift = BITS - STEP * level
        inside = common.written(_by_source(inside, state.select("of", F.col("at").alias("__at")), sources).where(F.shiftright("h", shift) == F.col("__at")).select("source", "size", "h"), "inside")
        if level < LEVELS:
            sums = inside.groupBy("source", F.shiftright("h", shift - STEP).alias("bucket")).agg(F.sum("size").alias("s"))
    last = _boundary(inside.groupBy("source", "h").agg(F.sum("size").alias("s")), state, "h").selectExpr("of found", "at cut", "need rest", "held tied")
    made = goal.join(last, F.col("of").eqNullSafe(F.col("found")), "left").select("of", "source_size", "target", "copies", F.coalesce("cut", F.lit(-1)).alias("cut"), F.coalesce("rest", F.lit(0)).alias("rest"), F.coalesce("tied", F.lit(0)).alias("tied"))
    return common.written(made, "plan"), sources


def extra(size: Column) -> Column:
    """Words that a document gives beyond whole passes: all below the cut; at the cut the rest, shared by size among the
    documents with that very hash (one, unless ids repeat) and rounded down."""
    at = F.floor(F.col("rest").cast("decimal(38,0)") * size / F.col("tied").cast("decimal(38,0)")).cast("long")
    return F.when(F.col("h") < F.col("cut"), size).when(F.col("h") == F.col("cut"), at).otherwise(F.lit(0).cast("long"))


def _measured(docs: DataFrame, seed: int) -> DataFrame:
    return common.written(docs.select("doc_id", "source", words(F.col("text")).alias("size"), order_key(seed).alias("h")), "sizes")


def mix(docs: DataFrame, seed: int = 17, **shares) -> DataFrame:
    """doc_id, size, source_size, target, taken, passes and source of every document.

    A document is taken `passes` times whole, and the one at a source's threshold gives the words that are still missing:
    a source's taken words are its target rounded down, less one word for each further document of the very same hash.
    Null and empty texts have size 0 and take nothing; a very long text is one document like any other; a null source is
    a source; rows with equal ids share a hash (so do equal texts without an id) and share what is taken of it by size;
    an empty table gives none; other columns are ignored. Reruns agree: nothing depends on the order of rows."""
    rows = _measured(docs, seed)
    made = _by_source(rows, *plan(rows, **shares))
    taken = F.col("copies") * F.col("size") + extra(F.col("size"))
    passes = F.col("copies") + (F.col("h") < F.col("cut")).cast("int")
    return made.select("doc_id", "size", "source_size", "target", taken.cast("long").alias("taken"), passes.alias("passes"), "source")


def apply(docs: DataFrame, seed: int = 17, **shares) -> DataFrame:
    """The mixed documents: each row of docs, with all its columns, as often as the mix takes it. Documents stay whole: the
    one at a source's threshold gets a pass more if at least half of its words are wanted, so a source misses its target
    by at most half of that document. The plan is joined to the rows by source, under names that nothing clashes with."""
    made, sources = plan(_measured(docs, seed), **shares)
    names = ["copies", "cut", "rest", "tied"]
    packed = made.select("of", F.struct(*names).alias("__mix"))
    held = docs.select(F.struct(*docs.columns).alias("__doc"), F.col("source"), order_key(seed).alias("h"))
    p = F.col("__mix")
    more = (F.col("h") < p["cut"]) | (F.col("h") == p["cut"]) & (2 * p["rest"] >= p["tied"])
    joined = _by_source(held, packed, sources).withColumn("__pass", F.explode(F.array_repeat(F.lit(1), p["copies"] + more.cast("int"))))
    return joined.select("__doc.*")


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents mixed with weights 1, 2, 3 over the sources in turn, to as many words as there are."""
    return mix(common.table(spark, sf_dir, "documents"))


#: The same rows in DuckDB's SQL, thresholds by a sort.
ORACLE = r"""
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
        CAST('0x' || substr(md5(CASE WHEN doc_id IS NULL THEN '17t' || coalesce(text, '') ELSE '17:' || doc_id END), 1, 15) AS BIGINT) AS h FROM documents),
    s AS (SELECT source, sum(size) AS source_size, 3.0::DOUBLE * sum(size) AS cap,
        [1.0::DOUBLE, 2.0::DOUBLE, 3.0::DOUBLE][1 + CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS INTEGER)] AS weight FROM d GROUP BY source),
    r AS (SELECT *, cap / weight AS ratio, coalesce(sum(cap) OVER w, 0) AS held, coalesce(sum(weight) OVER w, 0) AS passed
        FROM s WINDOW w AS (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
    l AS (SELECT arg_min(level, ratio) AS level FROM (
        SELECT ratio, ((SELECT sum(source_size) FROM s)::DOUBLE - held) / ((SELECT sum(weight) FROM s) - passed) AS level FROM r) WHERE level <= ratio),
    t AS (SELECT source, CAST(source_size AS BIGINT) AS source_size, least(cap, weight * coalesce((SELECT level FROM l), 'inf'::DOUBLE)) AS target FROM s),
    g AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS INTEGER) ELSE 0 END AS copies FROM t),
    n AS (SELECT *, CAST(floor(target - copies * source_size) AS BIGINT) AS need FROM g),
    x AS (SELECT d.*, n.source_size, n.target, n.copies, n.need, sum(size) OVER (PARTITION BY d.source ORDER BY h RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto,
        sum(size) OVER (PARTITION BY d.source, h) AS tied FROM d JOIN n ON d.source IS NOT DISTINCT FROM n.source),
    e AS (SELECT *, CASE WHEN upto <= need THEN size WHEN upto - tied < need THEN CAST((need - (upto - tied)) * size // tied AS BIGINT) ELSE 0 END AS more, upto <= need AND need > 0 AS whole FROM x)
SELECT doc_id, size, source_size, target, CAST(copies * size + CASE WHEN need > 0 THEN more ELSE 0 END AS BIGINT) AS taken, CAST(copies + CAST(whole AS INTEGER) AS INTEGER) AS passes, source FROM e
"""
