"""Rewrites: a seed filter in Spark's own code before Python, and long texts in parts all over the cluster."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import reduce
from typing import TYPE_CHECKING

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.alphabets import VALID, complement, fold, pattern_regex, reverse_complement
from ..operators.kernel import Ends, Seeded, all_ends, seeds

if TYPE_CHECKING:
    from ..operators.search import Options

#: Seeds up to which testing them one by one is cheaper than passing the text on.
MOST_SEEDS = 48


def seed_filter(text: Column, kind: str, patterns: list[tuple[str, bytes]], options: Options) -> Column | None:
    """A condition that every text with a match meets: it holds one of the k + 1 pieces of some pattern, on some strand.
    None where pieces can't tell: overhang, iupac, short pieces, too many, or a filter that Spark can't run as text."""
    if options.alpha is not None or kind != "string":
        return None
    if options.alphabet == "iupac":
        if options.k or len(patterns) * (1 + options.rc) > MOST_SEEDS:
            return None
        # without edits a text matches where the codes of pattern and text share a base
        needles = [p.decode("latin-1") for _, p in patterns] + ([reverse_complement(p, "iupac").decode("latin-1") for _, p in patterns] if options.rc else [])
        return text.rlike("|".join(map(pattern_regex, sorted(set(needles)))))
    if not all(Seeded.usable(fold(p, options.alphabet), options.k, options.alphabet) for _, p in patterns):
        return None
    needles = [p for _, p in patterns] + ([reverse_complement(p, options.alphabet) for _, p in patterns] if options.rc else [])
    try:
        parts = sorted({piece.decode() for p in needles for _, piece in seeds(fold(p, options.alphabet), options.k)})
    except UnicodeDecodeError:
        return None
    if len(parts) > MOST_SEEDS:
        return None
    if options.alphabet == "ascii_ci" and not all(p.isascii() for p in parts):
        return None
    # A-Z alone are folded: Spark's lower() and upper() could turn other letters into these
    az, up = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    shown = {"ascii_ci": F.translate(text, up, az), "dna": F.translate(text, az, up)}.get(options.alphabet, text)
    return reduce(lambda a, b: a | b, [F.contains(shown, F.lit(p)) for p in parts])


LONG = "pattern_id string, text_id string, cost int, strand string, text_start long, text_end long, pattern_start int, pattern_end int, match_region string, cigar string, __row long, __pattern int, __low long, __open boolean, __entered boolean"


def part_minima(e: Ends, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray, dict[int, tuple[bool, bool]]]:
    """Local minima of parts of texts. e: all ends from low to high + 1 of each part, in order; a part owns those above low
    up to high, the first part of a text 0 too. Returns which ends are minima as far as the part can tell, which of these
    are open (their run comes in from the part before), and for each part whose last own end belongs to a run: whether
    that run comes in from the part before, and whether it was entered from a higher cost."""
    n = len(e.end)
    if not n:
        return np.zeros(0, bool), np.zeros(0, bool), {}
    joined = (e.text[1:] == e.text[:-1]) & (e.end[1:] == e.end[:-1] + 1)
    step = np.where(joined, e.cost[1:] - e.cost[:-1], 0)
    begins = np.concatenate([[True], ~joined | (step != 0)])
    run = np.cumsum(begins) - 1
    entered = np.concatenate([[True], ~joined | (step < 0)])[begins][run]
    through = ((e.end == low[e.text]) & (low[e.text] > 0))[begins][run]
    last = np.concatenate([~joined | (step > 0), [True]])
    own = ((e.end > low[e.text]) | (low[e.text] == 0)) & (e.end <= high[e.text])
    edge = np.flatnonzero(e.end == high[e.text])
    return last & own & (entered | through), through, {int(e.text[i]): (bool(through[i]), bool(entered[i])) for i in edge.tolist()}


def _parts(texts: DataFrame, chunk: int, reach: int) -> DataFrame:
    """__row, text_id, n, at, first and part: short texts where they are, long ones cut and spread over the cluster. A part
    has `reach` more bytes on both sides."""
    whole = texts.where(F.col("n") <= chunk).select("__row", "text_id", "n", F.lit(0).cast("long").alias("at"), F.lit(0).cast("long").alias("first"), F.col("raw").alias("part"))
    cut = texts.where(F.col("n") > chunk).withColumn("at", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(chunk).cast("long"))))
    cut = cut.withColumn("first", F.greatest(F.lit(0).cast("long"), F.col("at") - reach))
    cut = cut.select("__row", "text_id", "n", "at", "first", F.substring("raw", (F.col("first") + 1).cast("int"), (F.col("at") - F.col("first") + chunk + reach).cast("int")).alias("part"))
    return whole.unionByName(cut.repartition("__row", "at"))


def search_long(
    texts: DataFrame, patterns: DataFrame | Iterable[tuple[str, bytes]], k: int, *, chunk: int = 4 << 20, text_id: str = "text_id", text: str = "text", pattern_id: str = "pattern_id", pattern: str = "pattern", **how
) -> DataFrame:
    """search() with texts of over `chunk` bytes cut into parts that are searched on their own, all over the cluster: the
    same rows for the same options, without overhang. An end filter needs a `reach` and gets no more than that.

    Both strands of a part are searched in one task. A part has all it needs to find its ends and their alignments; only a
    run of equal costs that comes in from the part before asks, through a window over such runs, how it was entered."""
    from ..operators.search import Options, kept, pattern_blocks, placed, slices
    from ..operators.trace import region, turned

    options = Options(k, **how)
    if options.alpha is not None:
        raise ValueError("long texts are searched without overhang")
    filter_reach = getattr(options.end_filter, "reach", None) if options.end_filter else 0
    if filter_reach is None:
        raise ValueError("an end filter of long texts needs a reach")
    raw = F.col(text).cast("binary")
    rows = texts.select(F.monotonically_increasing_id().alias("__row"), F.col(text_id).cast("string").alias("text_id"), raw.alias("raw")).where("raw is not null")
    if options.validate != "off":
        valid = F.decode("raw", "ISO-8859-1").rlike(VALID[options.alphabet])
        if options.validate == "filter":
            rows = rows.where(valid)
        else:
            rows = rows.withColumn("raw", F.when(valid, F.col("raw")).otherwise(F.raise_error(F.concat(F.lit("not "), F.lit(options.alphabet), F.lit(": text "), F.coalesce("text_id", F.lit("null")))).cast("binary")))
    rows = rows.withColumn("n", F.octet_length("raw").cast("long"))
    local, schema = options.mode == "local", _schema(LONG)

    def searched(names: list[str], seqs: list[bytes], reach: int) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for some in slices(batch, 5):
                    out = found(*(c.to_pylist() for c in some.columns))
                    if out:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)

        def found(number: list[int], ids: list[str | None], sizes: list[int], ats: list[int], firsts: list[int], parts: list[bytes]) -> list[tuple]:
            n, at, first, length = (np.array(x, np.int64) for x in (sizes, ats, firsts, [len(p) for p in parts]))
            stop, out = np.minimum(at + chunk, n), []
            for strand in "+-" if options.rc else "+":
                if strand == "+":
                    data, needles, shift, low, high = parts, seqs, first, at, stop
                else:
                    data, needles, shift, low, high = [p[::-1] for p in parts], [complement(p, options.alphabet) for p in seqs], n - first - length, n - stop, n - at
                for j, e in enumerate(all_ends(data, needles, k, options.alphabet, None, options.seeded)):
                    zero = np.flatnonzero((low == 0) & ((n == 0) | local)) if len(needles[j]) <= k else np.zeros(0, np.int64)
                    e = Ends(np.concatenate([zero, e.text]), np.concatenate([np.zeros(len(zero), np.int64), e.end + shift[e.text]]), np.concatenate([np.full(len(zero), len(needles[j]), np.int64), e.cost]))
                    e = e.where(np.lexsort((e.end, e.text)))
                    e = e.where((e.end >= low[e.text]) & (e.end <= high[e.text] + local))
                    if local:
                        minima, open_, edges = part_minima(e, low, high)
                        e, open_ = e.where(minima), open_[minima]
                        out += [(None, ids[t], None, strand, None, None, None, None, None, None, number[t], j, int(low[t]), False, None if through else entered) for t, (through, entered) in edges.items() if high[t] < n[t]]
                    else:
                        e = e.where((e.end > low[e.text]) | (e.end == 0))
                        open_ = np.zeros(len(e.end), bool)
                    e = Ends(e.text, e.end - shift[e.text], e.cost)
                    if options.end_filter is not None and len(e.end):
                        numbered = kept(data, needles[j], Ends(e.text, e.end, np.arange(len(e.end))), strand, options).cost
                        e, open_ = e.where(numbered), open_[numbered]
                    for (t, m), wait in zip(placed(data, needles[j], e, options), open_.tolist()):
                        m = turned(m, len(parts[t])) if strand == "-" else m
                        if options.with_alignment:
                            shown = region(parts[t], m, options.alphabet).decode("utf-8", "replace")
                            place = (m.text_start + firsts[t], m.text_end + firsts[t], m.pattern_start, m.pattern_end, shown, m.cigar)
                        else:
                            place = (None, m.text_end + firsts[t], None, None, None, None) if strand == "+" else (m.text_start + firsts[t], None, None, None, None, None)
                        out.append((names[j], ids[t], m.cost, strand, *place, number[t], j, int(low[t]), wait, None))
            return out

        made = _parts(rows, chunk, reach).mapInArrow(run, LONG)
        if local:
            # ends that are settled stand alone; runs that cross parts meet those of their text, pattern and strand
            crossing = F.col("__open") | F.col("cost").isNull()
            alone = F.when(~crossing, F.struct("text_start", "text_end"))
            before = Window.partitionBy("__row", "__pattern", "strand", alone).orderBy("__low").rangeBetween(Window.unboundedPreceding, -1)
            made = made.withColumn("__was", F.last("__entered", ignorenulls=True).over(before)).where("cost is not null and (not __open or __was)")
        return made.select(*[f.name for f in schema][:10])

    made = None
    for block in pattern_blocks(patterns, options, pattern_id, pattern):
        names, seqs = [x for x, _ in block], [x for _, x in block]
        one = searched(names, seqs, max(max(map(len, seqs)) + k + 1, filter_reach))
        made = one if made is None else made.unionAll(one)
    if made is None:
        raise ValueError("there is no pattern")
    return made


def _schema(ddl: str) -> pa.Schema:
    kinds = {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "boolean": pa.bool_()}
    return pa.schema([(n, kinds[t]) for n, t in (x.split() for x in ddl.split(", "))])
