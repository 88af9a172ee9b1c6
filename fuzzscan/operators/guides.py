"""Guide (CRISPR) off-target search: guides with a PAM against sequences, all ends, IUPAC."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.alphabets import code_table, complement, n_fraction_col
from ..plans.rewrite import search_long
from .search import EndFilter, search

PAM = 3
#: Columns of the guide table; `start` and `end` are bytes of the text.
GUIDE_COLUMNS = ("guide_id", "text_id", "cost", "strand", "start", "end", "match_region", "cigar")


def numbered(guides: list[str]) -> list[tuple[str, bytes]]:
    """Ids guide_1, guide_2, ... in order, blank lines left out."""
    kept = [g.strip() for g in guides if g.strip()]
    return [(f"guide_{i}", g.encode()) for i, g in enumerate(kept, 1)]


def common_pam(guides: list[tuple[str, bytes]]) -> bytes:
    """The last three characters, which all guides must share."""
    if any(len(g) <= PAM for _, g in guides):
        raise ValueError("a guide is no longer than its PAM")
    pams = {g[-PAM:].upper() for _, g in guides}
    if len(pams) != 1:
        raise ValueError(f"guides end in different PAMs: {', '.join(sorted(p.decode() for p in pams))}")
    return pams.pop()


@dataclass(frozen=True)
class PamFilter:
    """Keeps ends at which the last characters of the text match the PAM; the alignment may still put edits there. On the
    - strand the reversed text is held against the complemented PAM."""

    pam: bytes

    @property
    def reach(self) -> int:
        return len(self.pam)

    def __call__(self, pattern: bytes, upto: bytes, strand: str) -> bool:
        return bool(self.mask(pattern, [upto], np.zeros(1, np.int64), np.array([len(upto)]), strand)[0])

    def mask(self, pattern: bytes, texts: list[bytes], owner: np.ndarray, ends: np.ndarray, strand: str) -> np.ndarray:
        codes, size = code_table(), self.reach
        want = codes[np.frombuffer(self.pam if strand == "+" else complement(self.pam, "iupac"), np.uint8)]
        have = np.frombuffer(b"".join(texts[t][max(0, e - size) : e].rjust(size, b"\0") for t, e in zip(owner.tolist(), ends.tolist())), np.uint8).reshape(-1, size)
        return ((codes[have] & want) != 0).all(1)


def pam_filter(pam: bytes) -> EndFilter:
    return PamFilter(pam)


def search_guides(texts: DataFrame, guides: list[str], k: int, *, max_n_frac: float = 1.0, allow_pam_edits: bool = False, rc: bool = True, text_id: str = "text_id", text: str = "text", chunk: int | None = None) -> DataFrame:
    """GUIDE_COLUMNS of every end with at most k edits of guide and PAM together, on both strands unless rc is off. With
    `chunk`, records of more bytes (chromosomes) are cut into parts of that size and searched all over the cluster. Regions with a larger share of N than max_n_frac, and empty ones, are dropped. No guides give an empty table."""
    if not 0 <= max_n_frac <= 1:
        raise ValueError("max_n_frac is a share from 0 to 1")
    named = numbered(guides)
    if not named:
        return texts.sparkSession.createDataFrame([], "guide_id string, text_id string, cost int, strand string, start long, end long, match_region string, cigar string")
    keep = None if allow_pam_edits else pam_filter(common_pam(named))
    if allow_pam_edits:
        common_pam(named)
    how = {"alphabet": "iupac", "mode": "all", "rc": rc, "end_filter": keep, "text_id": text_id, "text": text}
    found = search_long(texts, named, k, chunk=chunk, **how) if chunk else search(texts, named, k, **how)
    found = found.where(n_fraction_col(F.col("match_region")) <= max_n_frac)
    return found.select(F.col("pattern_id").alias("guide_id"), "text_id", "cost", "strand", F.col("text_start").alias("start"), F.col("text_end").alias("end"), "match_region", "cigar")
