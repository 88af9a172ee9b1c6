"""Alphabets: which bytes are equal, complements and validity; in Python for the kernel and as Spark columns.

Three alphabets and a folded one. `ascii`: equal bytes. `ascii_ci`: A-Z and a-z are equal. `dna`: A, C, G and T in either
case; no other byte equals anything, itself included. `iupac`: codes for sets of bases, equal if their sets meet."""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

ALPHABETS = ("ascii", "ascii_ci", "dna", "iupac")
# Sets of bases (A 1, C 2, T 4, G 8) of the IUPAC codes, and complements.
IUPAC_CODES = {"A": 1, "C": 2, "T": 4, "U": 4, "G": 8, "N": 15, "R": 9, "Y": 6, "S": 10, "W": 5, "K": 12, "M": 3, "B": 14, "D": 13, "H": 7, "V": 11, "X": 0}
IUPAC_COMPLEMENT = {"A": "T", "C": "G", "G": "C", "T": "A", "U": "A", "R": "Y", "Y": "R", "K": "M", "M": "K", "B": "V", "V": "B", "D": "H", "H": "D", "S": "S", "W": "W", "N": "N", "X": "X"}
DNA_COMPLEMENT = {"A": "T", "C": "G", "G": "C", "T": "A"}
VALID = {"ascii": r"(?s)^.*$", "ascii_ci": r"(?s)^.*$", "dna": r"^[ACGTacgt]*\z", "iupac": r"^[" + "".join(IUPAC_CODES) + "".join(IUPAC_CODES).lower() + r"]*\z"}


def checked(alphabet: str) -> str:
    """The alphabet's name in lower case; ValueError if there is none of that name."""
    name = alphabet.lower()
    if name not in ALPHABETS:
        raise ValueError(f"unknown alphabet {alphabet!r}; there are {', '.join(ALPHABETS)}")
    return name


def code_table() -> np.ndarray:
    """The IUPAC set of every byte; bytes that are no code have the empty set."""
    table = np.zeros(256, np.uint8)
    for c, bits in IUPAC_CODES.items():
        table[ord(c)] = table[ord(c.lower())] = bits
    return table


def _complement_table(pairs: dict[str, str]) -> bytes:
    table = bytearray(range(256))
    for a, b in pairs.items():
        table[ord(a)], table[ord(a.lower())] = ord(b), ord(b.lower())
    return bytes(table)


_CODES = code_table()
_COMPLEMENTS = {"dna": _complement_table(DNA_COMPLEMENT), "iupac": _complement_table(IUPAC_COMPLEMENT)}


def iupac_code(byte: int) -> int:
    return int(_CODES[byte])


def is_match(a: int, b: int, alphabet: str) -> bool:
    """Whether two bytes are equal in the alphabet."""
    if alphabet == "ascii":
        return a == b
    if alphabet == "ascii_ci":
        return bytes([a]).lower() == bytes([b]).lower()
    if alphabet == "dna":
        return bytes([a]).upper() == bytes([b]).upper() and a in b"ACGTacgt"
    return bool(_CODES[a] & _CODES[b])


def complement(seq: bytes, alphabet: str) -> bytes:
    """Base by base, in the case of each base; other bytes stay. Only DNA and IUPAC have complements."""
    if alphabet not in _COMPLEMENTS:
        raise ValueError(f"the {alphabet} alphabet has no complement")
    return seq.translate(_COMPLEMENTS[alphabet])


def reverse_complement(seq: bytes, alphabet: str) -> bytes:
    return complement(seq, alphabet)[::-1]


def valid_seq(seq: bytes, alphabet: str) -> bool:
    """Whether all bytes belong to the alphabet; an empty sequence does."""
    return re.match(VALID[alphabet].replace(r"\z", r"\Z").encode(), seq) is not None


def equal_mask(text: np.ndarray, byte: int, alphabet: str) -> np.ndarray:
    """Which bytes of a text equal the byte. The text must be folded for ascii_ci and dna, as by fold()."""
    if alphabet == "iupac":
        return (_CODES[text] & _CODES[byte]) != 0
    if alphabet == "dna" and byte not in b"ACGT":
        return np.zeros(len(text), bool)
    return text == byte


def fold(seq: bytes, alphabet: str) -> bytes:
    """The form in which bytes can be compared: lower case for ascii_ci, upper case for dna."""
    return seq.lower() if alphabet == "ascii_ci" else seq.upper() if alphabet == "dna" else seq


# ---------------------------------------------------------------- Spark columns


def complement_col(seq: Column, alphabet: str = "dna") -> Column:
    pairs = {"dna": DNA_COMPLEMENT, "iupac": IUPAC_COMPLEMENT}[checked(alphabet)]
    a, b = "".join(pairs), "".join(pairs.values())
    return F.translate(seq, a + a.lower(), b + b.lower())


def reverse_complement_col(seq: Column, alphabet: str = "dna") -> Column:
    return F.reverse(complement_col(seq, alphabet))


def valid_seq_col(seq: Column, alphabet: str) -> Column:
    return seq.rlike(VALID[checked(alphabet)])


def iupac_code_col(char: Column) -> Column:
    """The set of bases of a one-character string; 0 for what is no code."""
    pairs = [x for c, bits in IUPAC_CODES.items() for x in (F.lit(c), F.lit(bits))]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), F.upper(char)), F.lit(0))


def is_match_col(a: Column, b: Column, alphabet: str) -> Column:
    """Whether two one-character strings are equal in the alphabet."""
    name = checked(alphabet)
    if name == "ascii":
        return a == b
    if name == "iupac":
        return iupac_code_col(a).bitwiseAND(iupac_code_col(b)) != 0
    same = F.lower(a) == F.lower(b)
    return same & F.upper(a).isin("A", "C", "G", "T") if name == "dna" else same


def matching_seq_col(a: Column, b: Column, alphabet: str = "iupac") -> Column:
    """Whether two strings are equal place by place, up to the end of the shorter one."""
    n = F.least(F.length(a), F.length(b))
    chars = lambda s: F.split(F.substring(s, F.lit(1), n), "")
    pairs = F.zip_with(chars(a), chars(b), lambda x, y: (x == "") & (y == "") | is_match_col(x, y, alphabet))
    return (n == 0) | F.forall(pairs, lambda ok: ok)


def pattern_regex(pattern: str) -> str:
    """A regular expression for the places at which an IUPAC pattern matches without edits: at each place the codes, in
    either case, that share a base with the pattern's."""
    out = []
    for c in pattern.upper():
        bits = IUPAC_CODES.get(c, 0)
        chars = "".join(x + x.lower() for x, y in IUPAC_CODES.items() if bits & y)
        out.append(f"[{chars}]" if chars else r"[^\s\S]")
    return "".join(out)


def n_fraction_col(region: Column) -> Column:
    """Share of N in a region; null for an empty one."""
    return F.when(F.length(region) > 0, (F.length(region) - F.length(F.replace(F.upper(region), F.lit("N"), F.lit("")))) / F.length(region))
