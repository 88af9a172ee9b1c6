"""Seeded sequences for tests and benchmarks: random ones, mutated copies, texts with planted matches."""

from __future__ import annotations

import random
from itertools import product

from .alphabets import IUPAC_CODES, is_match

LETTERS = {"dna": b"ACGT", "iupac": "".join(c for c in IUPAC_CODES if c != "X").encode(), "ascii": bytes(range(256))}


def sequence(rng: random.Random, n: int, alphabet: str = "dna") -> bytes:
    """n letters, each as likely as the other; X, which matches nothing, is never drawn."""
    letters = LETTERS[alphabet]
    return bytes(rng.choice(letters) for _ in range(n))


def mutated(rng: random.Random, seq: bytes, least: int, most: int, alphabet: str = "dna") -> tuple[bytes, int]:
    """The sequence after a random number of single edits from least to most, and that number. A substitution changes the
    letter; the last letter is not deleted."""
    out, edits = bytearray(seq), rng.randint(least, most)
    for _ in range(edits):
        kind = rng.choice(("substitute", "insert", "delete") if len(out) > 1 else ("substitute", "insert"))
        at = rng.randrange(len(out) + (kind == "insert"))
        if kind == "insert":
            out.insert(at, rng.choice(LETTERS[alphabet]))
        elif kind == "delete":
            del out[at]
        else:
            out[at] = rng.choice([c for c in LETTERS[alphabet] if c != out[at]])
    return bytes(out), edits


def planted(rng: random.Random, pattern: bytes, n: int, matches: int, edits: int, alphabet: str = "dna") -> tuple[bytes, bytes, list[int]]:
    """A random text of n letters with mutated copies of the pattern written over it where they do not meet, the same text
    with the pattern itself at its very end, and where the copies begin. A copy that finds no free place in ten tries is
    left out."""
    text, places = bytearray(sequence(rng, n, alphabet)), []
    for _ in range(matches):
        copy, _ = mutated(rng, pattern, 0, edits, alphabet)
        for _ in range(10):
            at = rng.randrange(max(1, n - len(copy) + 1))
            if at + len(copy) <= n and all(at + len(copy) <= a or b <= at for a, b in places):
                text[at : at + len(copy)] = copy
                places.append((at, at + len(copy)))
                break
    more = bytes(text[: max(0, n - len(pattern))]) + pattern
    return bytes(text), more, sorted(a for a, _ in places)


def overhang_sample(rng: random.Random) -> tuple[bytes, bytes]:
    """A pattern of 20 letters and a text of 100 that holds its last half at the start, all of it so that it ends at 50, and
    its first half at the end."""
    pattern, text = sequence(rng, 20), bytearray(sequence(rng, 100))
    text[0:10], text[30:50], text[90:100] = pattern[10:], pattern, pattern[:10]
    return pattern, bytes(text)


def edit_distance(a: bytes, b: bytes) -> int:
    """Edits between two whole sequences, by the plain recurrence."""
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        above, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(above[j - 1] + (x != y), above[j] + 1, row[-1] + 1))
    return row[-1]


def equal_pairs() -> list[tuple[str, str]]:
    """All pairs of IUPAC codes, in either case, that are equal: for aligners that take a list of equalities."""
    letters = [c for x in IUPAC_CODES for c in (x, x.lower())]
    return [(a, b) for a, b in product(letters, letters) if a != b and is_match(ord(a), ord(b), "iupac")]
