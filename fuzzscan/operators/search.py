"""Approximate search of patterns in texts: DataFrames in, matches out; and the same for one text in Python."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.alphabets import checked, complement, valid_seq
from .kernel import Ends, all_ends, floors, local_minima, with_zero
from .trace import Match, aligned, region, turned

#: (pattern, text up to the end, strand) -> whether to keep the end. On the - strand both are as they are searched there:
#: the complemented pattern and the reversed text. A filter with an attribute `reach` gets only so many bytes before the
#: end; one with a method `mask(pattern, texts, owner, ends, strand)` is asked once for all ends (number of the text,
#: position) of a pattern and gives an array.
EndFilter = Callable[[bytes, bytes, str], bool]
MATCHES = "pattern_id string, text_id string, cost int, strand string, text_start long, text_end long, pattern_start int, pattern_end int, match_region string, cigar string"
_FIELDS = pa.schema([("pattern_id", pa.string()), ("text_id", pa.string()), ("cost", pa.int32()), ("strand", pa.string()), ("text_start", pa.int64()), ("text_end", pa.int64()), ("pattern_start", pa.int32()), ("pattern_end", pa.int32()), ("match_region", pa.string()), ("cigar", pa.string())])
#: Bytes of text that one call of the kernel gets, and of patterns that one scan of the texts carries to the workers.
SLICE, PATTERN_BYTES = 4 << 20, 16 << 20


@dataclass(frozen=True)
class Options:
    """How to search. rc None: both strands where the alphabet has a complement and overhang is off. alpha: cost of a
    pattern character beyond the ends of the text, for iupac only."""

    k: int
    alphabet: str = "ascii"
    mode: str = "local"
    rc: bool | None = None
    alpha: float | None = None
    with_alignment: bool = True
    validate: str = "off"
    end_filter: EndFilter | None = None
    seeded: bool = True

    def __post_init__(self):
        object.__setattr__(self, "alphabet", checked(self.alphabet))
        two = self.alphabet in ("dna", "iupac")
        if self.k < 0:
            raise ValueError("k is below 0")
        if self.mode not in ("local", "all"):
            raise ValueError("mode is local or all")
        if self.validate not in ("off", "error", "filter"):
            raise ValueError("validate is off, error or filter")
        if self.rc and not two:
            raise ValueError(f"the {self.alphabet} alphabet has no complement")
        if self.rc is None:
            object.__setattr__(self, "rc", two)
        if self.alpha is not None and (self.alphabet != "iupac" or not 0 <= self.alpha <= 1):
            raise ValueError("overhang needs the iupac alphabet and an alpha from 0 to 1")


def _checked_patterns(patterns: Iterable[tuple[str, bytes]], options: Options) -> list[tuple[str, bytes]]:
    out = []
    for name, seq in patterns:
        seq = seq.encode() if isinstance(seq, str) else bytes(seq) if seq is not None else None
        if seq is None:
            continue
        if not seq:
            raise ValueError("a pattern is empty")
        if options.validate != "off" and not valid_seq(seq, options.alphabet):
            if options.validate == "error":
                raise ValueError(f"pattern {name!r} is not {options.alphabet}")
            continue
        out.append((str(name), seq))
    return out


def ends_of(texts: list[bytes], patterns: list[bytes], options: Options) -> list[Ends]:
    """The ends that the mode selects, for each pattern, on the strand as given."""
    lengths = np.array([len(t) for t in texts], np.int64)
    local, out = options.mode == "local", []
    for p, e in zip(patterns, all_ends(texts, patterns, options.k, options.alphabet, options.alpha, options.seeded)):
        zero = len(p) if options.alpha is None else int(floors(options.alpha, len(p))[-1])
        e = with_zero(e, lengths, zero, options.k, local)
        out.append(local_minima(e) if local else e)
    return out


def matches(texts: list[bytes], patterns: list[bytes], options: Options) -> Iterator[tuple[int, int, Match]]:
    """(text, pattern, match) of all texts, by strand, pattern, text and end."""
    for strand in "+-" if options.rc else "+":
        if strand == "-":
            texts, patterns = [t[::-1] for t in texts], [complement(p, options.alphabet) for p in patterns]
        for number, e in enumerate(ends_of(texts, patterns, options)):
            for t, m in placed(texts, patterns[number], kept(texts, patterns[number], e, strand, options), options):
                yield t, number, turned(m, len(texts[t])) if strand == "-" else m


def kept(texts: list[bytes], pattern: bytes, e: Ends, strand: str, options: Options) -> Ends:
    """The ends that the end filter keeps."""
    ask = options.end_filter
    if ask is None or not len(e.end):
        return e
    if hasattr(ask, "mask"):
        return e.where(ask.mask(pattern, texts, e.text, e.end, strand))
    reach = getattr(ask, "reach", None)
    upto = lambda t, end: texts[t][0 if reach is None else max(0, min(end, len(texts[t])) - reach) : end]
    return e.where(np.array([bool(ask(pattern, upto(t, end), strand)) for t, end in zip(e.text.tolist(), e.end.tolist())], bool))


def placed(texts: list[bytes], pattern: bytes, e: Ends, options: Options) -> Iterator[tuple[int, Match]]:
    """Number of the text and match of each end, on the strand as given."""
    if options.with_alignment:
        yield from zip(e.text.tolist(), aligned(texts, e.text, e.end, pattern, options.k, options.alphabet, options.alpha))
    else:
        for t, end, cost in zip(e.text.tolist(), e.end.tolist(), e.cost.tolist()):
            yield t, Match(-1, min(end, len(texts[t])), -1, -1, cost, "+", "")


class Searcher:
    """Searches one pattern in one text, in this process."""

    def __init__(self, alphabet: str, rc: bool | None = None, alpha: float | None = None, mode: str = "local"):
        self.options = {"alphabet": alphabet, "rc": rc, "alpha": alpha, "mode": mode}
        Options(0, **self.options)

    def search(self, pattern: bytes, text: bytes, k: int, end_filter: EndFilter | None = None) -> list[Match]:
        options = Options(k, **self.options, end_filter=end_filter)
        ((_, pattern),) = _checked_patterns([("pattern", pattern)], options)
        return [m for _, _, m in matches([bytes(text)], [pattern], options)]


def slices(batch: pa.RecordBatch, column: int = 1) -> Iterator[pa.RecordBatch]:
    """The batch in slices of about SLICE bytes of a column, one row at least."""
    sizes = pc.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    groups = np.cumsum(sizes + 64) // SLICE
    edges = [0, *(np.flatnonzero(np.diff(groups)) + 1).tolist(), batch.num_rows]
    for a, b in zip(edges, edges[1:]):
        if b > a:
            yield batch.slice(a, b - a)


def _searched(texts: DataFrame, patterns: list[tuple[str, bytes]], options: Options) -> DataFrame:
    names, seqs = [n for n, _ in patterns], [s for _, s in patterns]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                ids, raw = part.column(0).to_pylist(), part.column(1).to_pylist()
                rows = [i for i, t in enumerate(raw) if t is not None]
                held = []
                for i in rows:
                    if options.validate != "off" and not valid_seq(raw[i], options.alphabet):
                        if options.validate == "error":
                            raise ValueError(f"text {ids[i]!r} is not {options.alphabet}")
                        continue
                    held.append(i)
                data, out = [raw[i] for i in held], []
                for t, number, m in matches(data, seqs, options):
                    if options.with_alignment:
                        shown = region(data[t], m, options.alphabet).decode("utf-8", "replace")
                        out.append((names[number], ids[held[t]], m.cost, m.strand, m.text_start, m.text_end, m.pattern_start, m.pattern_end, shown, m.cigar))
                    else:
                        at = (None, m.text_end) if m.strand == "+" else (m.text_start, None)
                        out.append((names[number], ids[held[t]], m.cost, m.strand, *at, None, None, None, None))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), _FIELDS)], schema=_FIELDS)

    return texts.mapInArrow(run, MATCHES)


def pattern_blocks(patterns: DataFrame | Iterable[tuple[str, bytes]], options: Options, pattern_id: str, pattern: str, most: int = PATTERN_BYTES) -> Iterator[list[tuple[str, bytes]]]:
    """The patterns in blocks of a bounded size; a DataFrame is read row by row, never collected whole."""
    if isinstance(patterns, DataFrame):
        rows = ((r[0], r[1]) for r in patterns.select(F.col(pattern_id).cast("string"), F.col(pattern).cast("binary")).toLocalIterator())
    else:
        rows = iter(patterns)
    block, size = [], 0
    for one in _checked_patterns(rows, options):
        if block and size + len(one[1]) > most:
            yield block
            block, size = [], 0
        block.append(one)
        size += len(one[1]) + len(one[0])
    if block:
        yield block


def search(
    texts: DataFrame,
    patterns: DataFrame | Iterable[tuple[str, bytes]],
    k: int,
    *,
    text_id: str = "text_id",
    text: str = "text",
    pattern_id: str = "pattern_id",
    pattern: str = "pattern",
    prefilter: bool = True,
    **how,
) -> DataFrame:
    """All matches (MATCHES) of the patterns in the texts with at most k edits; `how` as in Options.

    Positions are bytes, from 0, half open; strings are searched as UTF-8. mode `local`: for each run of neighbouring
    ends of equal cost, its last end if the cost is higher on both sides. mode `all`: every end. For each end there is
    one alignment. Null texts and patterns have no matches; an empty pattern is an error. Rows are in no order.

    The texts are read once for each block of patterns (one block up to PATTERN_BYTES), in place: there is no shuffle,
    only the id and the text reach Python, and where seeds make it possible texts without any are dropped before.
    Works on streams. Without alignment only the end is known: text_end on +, text_start on -."""
    from ..plans.rewrite import seed_filter

    options = Options(k, **how)
    made = None
    for block in pattern_blocks(patterns, options, pattern_id, pattern):
        rows = texts.select(F.col(text_id).cast("string").alias("text_id"), F.col(text).alias("text"))
        keep: Column | None = seed_filter(F.col("text"), dict(rows.dtypes)["text"], block, options) if prefilter else None
        rows = (rows.where(keep) if keep is not None else rows).select("text_id", F.col("text").cast("binary").alias("text"))
        found = _searched(rows, block, options)
        made = found if made is None else made.unionAll(found)
    if made is None:
        raise ValueError("there is no pattern")
    return made
