"""The search kernel: where patterns end in texts with at most k edits. numpy, no Spark.

C(e) is the least number of edits between the whole pattern and any substring of the text that ends at e. It is computed
by bit-parallel dynamic programming (Myers 1999, Hyyro 2003) with the text along the bits: a block of texts is one row of
64-bit words and each pattern character takes some twenty operations on it, with carries from word to word. Texts of a
block are divided by k + 1 places that equal nothing, which a match of k edits cannot cross, so every value up to k is
exact."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import ahocorasick
import numpy as np

from ..functions.alphabets import code_table, equal_mask, fold, iupac_code

#: Bytes of text that are scanned as one row of bits: a dozen such rows stay in the cache.
BLOCK = 1 << 20
_ONE, _TOP = np.uint64(1), np.uint64(63)
_BASES = re.compile(rb"[ACGT]+")


@dataclass
class Ends:
    """End positions: number of the text, position, C(position)."""

    text: np.ndarray
    end: np.ndarray
    cost: np.ndarray

    @classmethod
    def none(cls) -> Ends:
        return cls(*(np.zeros(0, np.int64) for _ in range(3)))

    @classmethod
    def joined(cls, parts: list[Ends]) -> Ends:
        return cls(*(np.concatenate([getattr(p, f) for p in parts]) for f in ("text", "end", "cost"))) if parts else cls.none()

    def where(self, keep: np.ndarray) -> Ends:
        return Ends(self.text[keep], self.end[keep], self.cost[keep])


def floors(alpha: float, n: int) -> np.ndarray:
    """floor(alpha * i) for i = 0..n in single precision."""
    return np.floor(np.float32(alpha) * np.arange(n + 1, dtype=np.float32)).astype(np.int64)


class Block:
    """Folded texts in a row, divided, with the equality masks made so far."""

    def __init__(self, texts: list[bytes], alphabet: str, gap: int, pad: int = 0):
        self.alphabet, self.lengths = alphabet, np.array([len(t) for t in texts], np.int64)
        self.starts = np.cumsum(self.lengths + gap + pad) - (self.lengths + gap + pad)
        self.data = np.frombuffer((b"\0" * (gap + pad)).join(texts) + b"\0" * (gap + pad), np.uint8)
        self.gap, self.pad, self.n = gap, pad, len(self.data)
        self.inside = np.repeat(np.tile([True, False], len(texts)), np.stack([self.lengths, np.full(len(texts), gap + pad)], 1).reshape(-1))
        self.codes = code_table()[self.data] if alphabet == "iupac" else None
        self.masks: dict[int, np.ndarray] = {}
        self.room: list[np.ndarray] = []

    def mask(self, byte: int) -> np.ndarray:
        """A bit for each place that equals the byte."""
        if byte not in self.masks:
            equal = (self.codes & iupac_code(byte)) != 0 if self.codes is not None else equal_mask(self.data, byte, self.alphabet)
            equal &= self.inside
            if self.pad and iupac_code(byte):  # the padding behind a text equals whatever means anything
                for s, n in zip(self.starts, self.lengths):
                    equal[s + n : s + n + self.pad] = True
            raw = np.packbits(equal, bitorder="little")
            self.masks[byte] = np.concatenate([raw, np.zeros(-len(raw) % 8, np.uint8)]).view(np.uint64)
        return self.masks[byte]

    def ends(self, pattern: bytes, rise: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Places of the block at which C <= k (i: after i + 1 bytes), and C there, counted from the left edge of the block.
        rise[j]: how much more j + 1 pattern characters cost than j before any text."""
        size = -(-self.n // 64)
        if not self.room:
            self.room = [np.zeros(size, np.uint64) for _ in range(5)]
        up, down, diagonal, more, less = self.room
        up[:], down[:] = 0, 0

        def shift(x: np.ndarray, out: np.ndarray) -> None:
            np.left_shift(x, _ONE, out=out)
            out[1:] |= x[:-1] >> _TOP

        for j, byte in enumerate(pattern):
            equal = self.mask(byte)
            np.bitwise_and(equal, up, out=more)
            np.add(more, up, out=diagonal)
            carry = diagonal < up
            np.add(diagonal[1:], carry[:-1], out=diagonal[1:])
            again = np.flatnonzero(carry[:-1] & (diagonal[1:] == 0)) + 1
            while len(again):  # a carry that a word of ones passes on
                again = again[again + 1 < size] + 1
                diagonal[again] += _ONE
                again = again[diagonal[again] == 0]
            diagonal ^= up
            diagonal |= equal
            diagonal |= down
            np.bitwise_or(diagonal, up, out=less)
            np.invert(less, out=less)
            less |= down
            shift(less, more)
            if rise[j]:
                more[0] |= _ONE
            np.bitwise_and(diagonal, up, out=down)
            shift(down, less)
            np.bitwise_or(diagonal, more, out=up)
            np.invert(up, out=up)
            up |= less
            np.bitwise_and(more, diagonal, out=down)
        # the cost at every eighth place tells where it can fall to k before the next
        rises, falls = up.view(np.uint8), down.view(np.uint8)
        low = np.bitwise_count(falls)
        step = np.bitwise_count(rises).astype(np.int8) - low.astype(np.int8)
        begins = np.cumsum(step, dtype=np.int32) - step + int(rise.sum())
        near = np.flatnonzero(begins - low <= k)
        each = lambda x: np.unpackbits(x[near], bitorder="little").reshape(-1, 8).view(np.int8)
        cost = begins[near, None] + np.cumsum(each(rises) - each(falls), 1, dtype=np.int32)
        row, bit = np.nonzero(cost <= k)
        at = near[row] * 8 + bit
        inside = at < self.n
        return at[inside], cost[row, bit][inside].astype(np.int64)


def scan(texts: list[bytes], pattern: bytes, k: int, alphabet: str, block: Block | None = None) -> Ends:
    """All ends from 1 on with C <= k, in order of text and end. texts and pattern are folded."""
    block = block or Block(texts, alphabet, k + 1)
    at, cost = block.ends(pattern, np.ones(len(pattern), np.int64), k)
    own = block.inside[at]
    at, cost = at[own], cost[own]
    text = np.searchsorted(block.starts, at, "right") - 1
    return Ends(text, at - block.starts[text] + 1, cost)


def scan_overhang(text: bytes, pattern: bytes, k: int, alphabet: str, alpha: float) -> Ends:
    """All ends from 1 to len(text) + len(pattern) with C <= k, where pattern characters beyond either end of the text
    cost alpha each, rounded down in total. Overhang changes only ends within a match's reach of either end of the text,
    so a long text is scanned as a head, a tail and plain parts between them."""
    m, n, steps = len(pattern), len(text), floors(alpha, len(pattern))
    reach = m + k
    if n > BLOCK + 4 * reach:
        head, tail = scan_overhang(text[: 2 * reach], pattern, k, alphabet, alpha), scan_overhang(text[n - 2 * reach :], pattern, k, alphabet, alpha)
        parts = [head.where(head.end <= 2 * reach)]
        for at in range(2 * reach, n - reach, BLOCK):
            stop = min(at + BLOCK, n - reach)
            e = scan([text[at - reach : stop]], pattern, k, alphabet)
            e.end += at - reach
            parts.append(e.where(e.end > at))
        tail.end += n - 2 * reach
        return Ends.joined([*parts, tail.where(tail.end > n - reach)])
    at, cost = Block([text], alphabet, 0, pad=m).ends(pattern, np.diff(steps), k)
    cost = cost + np.where(at >= n, steps[np.minimum(np.maximum(at - n + 1, 0), m)], 0)
    keep = cost <= k
    return Ends(np.zeros(int(keep.sum()), np.int64), at[keep] + 1, cost[keep])


def seeds(pattern: bytes, k: int) -> list[tuple[int, bytes]]:
    """k + 1 pieces of the pattern with their places: a match of k edits holds one of them unchanged."""
    cuts = [len(pattern) * i // (k + 1) for i in range(k + 2)]
    return [(a, pattern[a:b]) for a, b in zip(cuts, cuts[1:])]


def plain_part(pattern: bytes, alphabet: str) -> tuple[int, bytes]:
    """Where the longest run of characters that equal themselves alone begins, and that run: for iupac the bases."""
    if alphabet != "iupac":
        return 0, pattern
    runs = [(m.start(), m[0]) for m in _BASES.finditer(pattern.upper())]
    return max(runs, key=lambda r: len(r[1]), default=(0, b""))


def sharp(text: bytes, alphabet: str) -> bool:
    """Whether every character of a text equals itself alone among bases; U and the codes of several bases do not."""
    return alphabet != "iupac" or not text.translate(None, b"ACGTacgt")


class Seeded:
    """Finds all ends of many patterns by their seeds: places of the seeds in a text, by plain search for a few seeds, by
    a table of all GRAM-base words for DNA, and by one pass of an automaton for others, tell near which ends a match can
    be; only windows around them are scanned. For texts and parts of patterns in which a folded byte equals itself alone."""

    LEAST = {"ascii": 4, "ascii_ci": 4, "dna": 6, "iupac": 6}
    #: Seeds up to which each is searched on its own, with and without a table.
    FEW, FEW_DNA, GRAM = 40, 1, 8
    #: Places of a text whose words are made at once.
    SPAN = 1 << 18

    def __init__(self, patterns: list[bytes], k: int, alphabet: str):
        self.patterns, self.k, self.alphabet = patterns, k, alphabet
        self.uses: dict[bytes, list[tuple[int, int]]] = {}
        for number, p in enumerate(patterns):
            begin, part = plain_part(p, alphabet)
            for at, piece in seeds(part, k):
                self.uses.setdefault(piece, []).append((number, begin + at))
        self.automaton, self.grams = None, None
        if alphabet in ("dna", "iupac") and len(self.uses) > self.FEW_DNA and min(map(len, self.uses)) >= self.GRAM:
            self.grams = np.zeros(1 << (2 * self.GRAM), bool)
            self.by_gram: dict[bytes, list[bytes]] = {}
            for piece in self.uses:
                self.grams[self._words(piece[: self.GRAM])[0]] = True
                self.by_gram.setdefault(piece[: self.GRAM], []).append(piece)
        elif len(self.uses) > self.FEW:
            self.automaton = ahocorasick.Automaton()
            for piece, uses in self.uses.items():
                self.automaton.add_word(piece.decode("latin-1"), (len(piece), uses))
            self.automaton.make_automaton()

    @classmethod
    def usable(cls, pattern: bytes, k: int, alphabet: str) -> bool:
        least = cls.LEAST.get(alphabet)
        if alphabet == "dna" and not all(c in b"ACGT" for c in pattern):
            return False
        return least is not None and len(plain_part(pattern, alphabet)[1]) // (k + 1) >= least

    @classmethod
    def _words(cls, text: bytes) -> np.ndarray:
        """The GRAM bases from every place on as one number. Bytes that are no base take some base's; what is found is
        compared byte by byte."""
        x = np.frombuffer(text, np.uint8) >> np.uint8(1) & np.uint8(3)  # two bits in which A, C, G and T differ
        for width in (1, 2):
            x = x[:-width] << np.uint8(2 * width) | x[width:]
        return x[:-4].astype(np.uint16) << np.uint16(8) | x[4:]

    def hits(self, text: bytes) -> Iterator[tuple[int, list[tuple[int, int]]]]:
        """Where seeds begin in a text, and the patterns and places that they stand for."""
        if self.grams is not None:
            for begin in range(0, max(0, len(text) - self.GRAM + 1), self.SPAN):
                part = text[begin : begin + self.SPAN + self.GRAM - 1]
                for at in np.flatnonzero(self.grams[self._words(part)]).tolist():
                    for piece in self.by_gram.get(part[at : at + self.GRAM], ()):
                        if text.startswith(piece, begin + at):
                            yield begin + at, self.uses[piece]
            return
        if self.automaton is not None:
            for last, (size, uses) in self.automaton.iter(text.decode("latin-1")):
                yield last - size + 1, uses
            return
        for piece, uses in self.uses.items():
            at = text.find(piece)
            while at >= 0:
                yield at, uses
                at = text.find(piece, at + 1)

    def candidates(self, texts: list[bytes]) -> dict[int, np.ndarray]:
        """By pattern: rows of text, first and last end that a seed allows, merged where they meet, in order."""
        raw: dict[int, list[tuple[int, int]]] = {}
        for t, text in enumerate(texts):
            for begin, uses in self.hits(text.upper() if self.alphabet == "iupac" else text):
                for number, at in uses:
                    raw.setdefault(number, []).append((t, begin - at))
        out, lengths = {}, np.array([len(t) for t in texts], np.int64)
        for number, found in raw.items():
            spot = np.unique(np.array(found, np.int64), axis=0)
            text, middle = spot[:, 0], spot[:, 1] + len(self.patterns[number])
            first, last = np.maximum(1, middle - self.k), np.minimum(lengths[text], middle + self.k)
            some = first <= last
            text, first, last = text[some], first[some], last[some]
            new = np.concatenate([[True], (text[1:] != text[:-1]) | (first[1:] > last[:-1] + 1)]) if len(text) else np.zeros(0, bool)
            begins = np.flatnonzero(new)
            stops = np.concatenate([begins[1:], [len(text)]]) - 1 if len(begins) else begins
            out[number] = np.stack([text[begins], first[begins], last[stops]], 1)
        return out

    def ends(self, texts: list[bytes]) -> dict[int, Ends]:
        """By pattern number: all ends with C <= k."""
        made = {}
        for number, spots in self.candidates(texts).items():
            pattern, parts = self.patterns[number], []
            reach = len(pattern) + self.k
            group = np.cumsum(spots[:, 2] - spots[:, 1] + reach) // BLOCK
            for some in np.split(spots, np.flatnonzero(np.diff(group)) + 1) if len(spots) else []:
                text, first, last = some.T
                begin = np.maximum(0, first - reach)
                windows = [texts[t][a:b] for t, a, b in zip(text.tolist(), begin.tolist(), last.tolist())]
                found = scan(windows, pattern, self.k, self.alphabet)
                end = found.end + begin[found.text]
                keep = (end >= first[found.text]) & (end <= last[found.text])
                parts.append(Ends(text[found.text][keep], end[keep], found.cost[keep]))
            made[number] = Ends.joined(parts)
        return made


def pieces(text: bytes, reach: int, block: int = BLOCK) -> list[tuple[int, bytes]]:
    """A long text in parts, each with the `reach` bytes before it, and where the part itself begins."""
    return [(at, text[max(0, at - reach) : at + block]) for at in range(0, max(1, len(text)), block)]


def all_ends(texts: list[bytes], patterns: list[bytes], k: int, alphabet: str, alpha: float | None = None, seeded: bool = True) -> list[Ends]:
    """For each pattern, all ends from 1 on with C <= k. Texts and patterns as given; they are folded here. Long texts go
    through in parts that overlap by as much as a match can span, so memory is bounded by BLOCK."""
    folded, needles = [fold(t, alphabet) for t in texts], [fold(p, alphabet) for p in patterns]
    out: list[Ends] = [Ends.none()] * len(patterns)
    if alpha is not None:
        for number, p in enumerate(needles):
            parts = []
            for t, text in enumerate(folded):
                e = scan_overhang(text, p, k, alphabet, alpha)
                parts.append(Ends(np.full(len(e.end), t, np.int64), e.end, e.cost))
            out[number] = Ends.joined(parts)
        return out
    gathered: dict[int, list[Ends]] = {i: [] for i in range(len(needles))}
    quick = [i for i, p in enumerate(needles) if seeded and Seeded.usable(p, k, alphabet)]
    exact = np.array([sharp(t, alphabet) for t in folded], bool) if quick else np.zeros(len(folded), bool)
    if quick and exact.any():
        own = np.flatnonzero(exact)
        for number, e in Seeded([needles[i] for i in quick], k, alphabet).ends([folded[t] for t in own.tolist()]).items():
            gathered[quick[number]].append(Ends(own[e.text], e.end, e.cost))
    slow = [i for i in range(len(needles)) if i not in set(quick)]
    for wanted, numbers in ((range(len(folded)), slow), (np.flatnonzero(~exact).tolist(), quick)):
        for i, e in _scanned(folded, wanted, needles, numbers, k, alphabet):
            gathered[i].append(e)
    for i, parts in gathered.items():
        out[i] = Ends.joined(parts)
        if len(parts) > 1:
            out[i] = out[i].where(np.lexsort((out[i].end, out[i].text)))
    return out


def _scanned(texts: list[bytes], wanted: Iterable[int], needles: list[bytes], numbers: list[int], k: int, alphabet: str) -> Iterator[tuple[int, Ends]]:
    """All ends of some patterns in some texts, by scanning them whole, block by block."""
    if not numbers:
        return
    reach = max(len(needles[i]) for i in numbers) + k
    parts: list[tuple[int, int, bytes]] = [(t, at, piece) for t in wanted for at, piece in pieces(texts[t], reach)]
    at = 0
    while at < len(parts):
        group, size = [], 0
        while at < len(parts) and (not group or size + len(parts[at][2]) <= BLOCK + reach):
            group.append(parts[at])
            size += len(parts[at][2])
            at += 1
        block = Block([g[2] for g in group], alphabet, k + 1)
        text, begin = (np.array([g[i] for g in group], np.int64) for i in range(2))
        for i in numbers:
            e = scan([], needles[i], k, alphabet, block)
            own = np.maximum(0, begin - reach)[e.text] + e.end
            keep = (own > begin[e.text]) | (begin[e.text] == 0)
            yield i, Ends(text[e.text][keep], own[keep], e.cost[keep])


def with_zero(ends: Ends, lengths: np.ndarray, zero_cost: int, k: int, local: bool) -> Ends:
    """Adds end 0, the pattern before all text, where it counts: for local minima, and in an empty text."""
    if zero_cost > k:
        return ends
    at = np.arange(len(lengths)) if local else np.flatnonzero(lengths == 0)
    text = np.concatenate([at, ends.text])
    order = np.lexsort((np.concatenate([np.zeros(len(at), np.int64), ends.end]), text))
    return Ends(text[order], np.concatenate([np.zeros(len(at), np.int64), ends.end])[order], np.concatenate([np.full(len(at), zero_cost, np.int64), ends.cost])[order])


def local_minima(e: Ends) -> Ends:
    """Of each run of neighbouring ends of equal cost the last, if the cost on both sides of the run is higher; ends that
    are missing, being above k or outside the text, count as higher. e: all ends, in order of text and end."""
    n = len(e.end)
    if not n:
        return e
    joined = (e.text[1:] == e.text[:-1]) & (e.end[1:] == e.end[:-1] + 1)
    step = np.where(joined, e.cost[1:] - e.cost[:-1], 0)
    begins = np.concatenate([[True], ~joined | (step != 0)])
    falls = np.concatenate([[True], ~joined | (step < 0)])  # into the run from a higher cost, or from nothing
    run = np.cumsum(begins) - 1
    entered = falls[begins]
    last = np.concatenate([begins[1:], [True]])
    rises = np.concatenate([~joined | (step > 0), [True]])
    return e.where(last & rises & entered[run])
