"""One alignment for an end position: dynamic programming over the window in which the match must lie, walked back."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from ..functions.alphabets import equal_mask, fold, reverse_complement
from ..functions.cigar import packed
from .kernel import floors

#: Cells of dynamic programming that are held at once, and a cost above all others.
CELLS, FAR = 1 << 22, 1 << 20


@dataclass(frozen=True)
class Match:
    """A match: half-open ranges of text and pattern, cost, strand (+ or -) and CIGAR in pattern direction."""

    text_start: int
    text_end: int
    pattern_start: int
    pattern_end: int
    cost: int
    strand: str
    cigar: str


def align(text: bytes, pattern: bytes, end: int, k: int, alphabet: str, alpha: float | None = None) -> Match:
    """The alignment that ends at `end`, on the forward strand; see aligned()."""
    return aligned([text], np.zeros(1, np.int64), np.array([end], np.int64), pattern, k, alphabet, alpha)[0]


def aligned(texts: list[bytes], owner: np.ndarray, ends: np.ndarray, pattern: bytes, k: int, alphabet: str, alpha: float | None = None) -> list[Match]:
    """One alignment for each end (number of the text, position) on the forward strand. Going back from the end, of the
    steps that keep the cost least it takes the first of: match, text character alone, substitution, pattern character
    alone. With alpha, what is left of the pattern at the start of the text, or beyond its end, hangs over and is not in
    the CIGAR. Many ends are worked on together; memory is bounded by CELLS."""
    m = len(pattern)
    most, out = max(1, CELLS // ((m + 1) * (m + k + 1))), []
    for at in range(0, len(ends), most):
        out += _aligned(texts, owner[at : at + most], ends[at : at + most], pattern, k, alphabet, alpha)
    return out


def _aligned(texts: list[bytes], owner: np.ndarray, ends: np.ndarray, pattern: bytes, k: int, alphabet: str, alpha: float | None) -> list[Match]:
    m, n = len(pattern), np.array([len(texts[t]) for t in owner.tolist()], np.int64)
    steps = floors(alpha, m) if alpha is not None else np.arange(m + 1)
    over, stop = np.maximum(0, ends - n), np.minimum(ends, n)
    rows, first = m - over, np.maximum(0, stop - (m + k))
    width, count = int((stop - first).max(initial=0)), len(ends)
    # windows end at the right edge; column `edge` stands before a window's first character
    raw = np.frombuffer(b"".join(texts[t][a:b].rjust(width, b"\0") for t, a, b in zip(owner.tolist(), first.tolist(), stop.tolist())), np.uint8).reshape(count, width)
    edge = (width - (stop - first)).astype(np.int64)
    shown = np.frombuffer(fold(raw.tobytes(), alphabet), np.uint8).reshape(count, width)
    needle = fold(pattern, alphabet)
    equal = {c: equal_mask(shown, c, alphabet) for c in set(needle)}
    columns = np.arange(width + 1, dtype=np.int32)
    before = columns[None, :] < edge[:, None]
    here = np.arange(count)
    table = np.zeros((m + 1, count, width + 1), np.int32)
    table[0][before] = FAR
    for j in range(1, m + 1):
        above, row = table[j - 1], table[j]
        np.add(above[:, :-1], ~equal[needle[j - 1]], out=row[:, 1:])
        np.minimum(row[:, 1:], above[:, 1:] + 1, out=row[:, 1:])
        row[:, 0] = FAR
        row[before] = FAR
        row[here, edge] = steps[j]
        row -= columns
        np.minimum.accumulate(row, axis=1, out=row)
        row += columns
        row[before] = FAR
    j, i = rows.copy(), np.full(count, width, np.int64)
    cost = table[j, here, i] + np.where(over > 0, steps[over], 0)
    ops = np.zeros((m + width + 1, count), np.uint8)
    live = j > 0
    if alpha is not None:
        live &= i > edge
    t = 0
    while live.any():
        at = np.flatnonzero(live)
        ja, ia = j[at], i[at]
        now, text = table[ja, at, ia], ia > edge[at]
        left = np.maximum(ia - 1, 0)
        same = np.zeros(len(at), bool)
        letters = np.frombuffer(needle, np.uint8)[ja - 1]
        for c in np.unique(letters).tolist():
            own = np.flatnonzero((letters == c) & text)
            same[own] = equal[c][at[own], left[own]]
        diagonal = table[ja - 1, at, left]
        match = text & same & (now == diagonal)
        insert = text & ~match & (now == table[ja, at, left] + 1)
        change = text & ~match & ~insert & (now == diagonal + 1)
        ops[t, at] = np.where(match, 61, np.where(insert, 73, np.where(change, 88, 68)))  # = I X D
        i[at] = np.where(match | insert | change, left, ia)
        j[at] = np.where(insert, ja, ja - 1)
        live[at] = j[at] > 0
        if alpha is not None:
            live &= i > edge
        t += 1
    paths = np.ascontiguousarray(ops[:t][::-1].T)
    return [
        Match(f + b - e, s, p, r, c, "+", packed(path.tobytes().lstrip(b"\0").decode()))
        for f, b, e, s, p, r, c, path in zip(first.tolist(), i.tolist(), edge.tolist(), stop.tolist(), j.tolist(), rows.tolist(), cost.tolist(), paths)
    ]


def turned(match: Match, n: int) -> Match:
    """A match in a reversed text of n bytes, in coordinates of the text itself, on the - strand."""
    return Match(n - match.text_end, n - match.text_start, match.pattern_start, match.pattern_end, match.cost, "-", match.cigar)


def region(text: bytes, match: Match, alphabet: str) -> bytes:
    """The matched bytes in pattern direction."""
    part = text[match.text_start : match.text_end]
    return part if match.strand == "+" else reverse_complement(part, alphabet)
