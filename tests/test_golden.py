"""Known matches, as whole rows where all of a row is known."""

import pytest

from fuzzscan import Searcher
from fuzzscan.functions import alphabets, cigar
from fuzzscan.operators.kernel import all_ends


def found(alphabet, pattern, text, k, rc=False, alpha=None, mode="local", end_filter=None):
    return Searcher(alphabet, rc=rc, alpha=alpha, mode=mode).search(pattern, text, k, end_filter)


def rows(matches):
    return sorted((m.text_start, m.text_end, m.cost, m.strand, m.cigar) for m in matches)


def ends(alphabet, pattern, text, k, alpha):
    (e,) = all_ends([text], [pattern], k, alphabet, alpha)
    return dict(zip(e.end.tolist(), e.cost.tolist()))


WHOLE = [
    ("dna", b"ATCG", b"AAAATCGGGGGGCATGGG", 1, True, None, [(3, 7, 0, "+", "4="), (12, 15, 1, "-", "2=D="), (13, 17, 1, "+", "2=X=")]),
    ("dna", b"ATCGATCG", b"GGGGATCGATCGTTTT", 1, True, None, [(2, 10, 1, "-", "7=X"), (4, 12, 0, "+", "8="), (6, 14, 1, "-", "=X6=")]),
    ("dna", b"ATCGATCA", b"G" * 8 + alphabets.reverse_complement(b"ATCGATCA", "dna") + b"G" * 8, 0, True, None, [(8, 16, 0, "-", "8=")]),
    ("dna", b"ATCGATCA", b"G" * 8 + alphabets.reverse_complement(b"ATCGATCA", "dna") + b"G" * 8, 0, False, None, []),
    ("ascii", b"AAA", b"AAAAAA", 0, False, None, [(3, 6, 0, "+", "3=")]),
]


@pytest.mark.parametrize("alphabet,pattern,text,k,rc,alpha,want", WHOLE)
def test_whole_rows(alphabet, pattern, text, k, rc, alpha, want):
    assert rows(found(alphabet, pattern, text, k, rc, alpha)) == want


def test_overhang_rows():
    a, b = sorted(found("iupac", b"ACGT", b"GTXXXNNN", 1, alpha=0.5), key=lambda m: m.text_start)[:2]
    assert (a.pattern_start, a.pattern_end, a.text_start, a.text_end, a.cost, a.cigar) == (2, 4, 0, 2, 1, "2=")
    assert (b.pattern_start, b.pattern_end, b.text_start, b.text_end, b.cost, b.cigar) == (0, 3, 5, 8, 0, "3=")
    two = found("iupac", b"GGGGAAAA", b"T" * 16 + b"GGGG", 4, alpha=0.5)
    assert len(two) == 2 and any((m.text_end, m.pattern_end, m.cost) == (20, 3, 2) for m in two)
    for mode in ("local", "all"):
        assert any((m.text_end, m.cost) == (1, 1) for m in found("iupac", b"ATC", b"CGGGGGG", 3, alpha=0.5, mode=mode))


def test_overhang_ends():
    assert ends("iupac", b"AAAAGGGG", b"GGGG" + b"T" * 16, 2, 0.5)[3] <= 2
    assert ends("iupac", b"GGGGAAAA", b"T" * 16 + b"GGGG", 2, 0.5)[24] <= 2
    both = ends("iupac", b"AAAAGGGG", b"GGGGGAAAAA", 2, 0.5)
    assert both[3] == 2 and both[13] == 2
    # a long text is scanned as a head, a tail and parts between
    from fuzzscan.operators import kernel

    text = b"GTACA" * 12
    whole, kernel.BLOCK, old = ends("iupac", b"ACAGTAC", text, 3, 0.5), 7, kernel.BLOCK
    try:
        assert ends("iupac", b"ACAGTAC", text, 3, 0.5) == whole
    finally:
        kernel.BLOCK = old


PATHS = [
    ("dna", b"ATGC", b"GGGGATGCGGG", 0, None, [(0, 4), (1, 5), (2, 6), (3, 7)]),
    ("dna", b"ATGC", b"GGGGATTGCGGG", 1, None, [(0, 4), (1, 5), (1, 6), (2, 7), (3, 8)]),
    ("iupac", b"ATCGATCG", b"ATCGGGGGGGGGG", 2, 0.5, [(4, 0), (5, 1), (6, 2), (7, 3)]),
    ("iupac", b"ATCGATCG", b"GGGGGGGATCG", 2, 0.5, [(0, 7), (1, 8), (2, 9), (3, 10)]),
]


@pytest.mark.parametrize("alphabet,pattern,text,k,alpha,want", PATHS)
def test_paths(alphabet, pattern, text, k, alpha, want):
    assert any(cigar.path(m.cigar, m.pattern_start, m.text_start) == want for m in found(alphabet, pattern, text, k, alpha=alpha))


def test_end_filters():
    pattern, rc = b"ATCGATCA", alphabets.reverse_complement(b"ATCGATCA", "dna")
    text = b"G" * 10 + pattern + b"G" * 32 + pattern + b"G" * 42
    assert [m.text_start for m in found("dna", pattern, text, 0)] == [10, 50]
    assert [m.text_start for m in found("dna", pattern, text, 0, end_filter=lambda p, upto, strand: len(upto) > 10 + len(p))] == [50]
    seen = []
    text = b"G" * 10 + pattern + b"G" * 32 + rc + b"G" * 42
    both = found("dna", pattern, text, 0, rc=True, end_filter=lambda p, upto, strand: seen.append((p, upto[-len(p) :], strand)) or upto.endswith(p))
    assert sorted(m.text_start for m in both) == [10, 50] and {s for *_, s in seen} == {"+", "-"}


def test_planted_and_turned():
    text = bytearray(b"G" * 1000)
    for at in (50, 150, 250, 350, 450, 800):
        text[at : at + 8] = b"ATCGATCA"
    assert {50, 150, 250, 350, 450, 800} <= {m.text_start for m in found("dna", b"ATCGATCA", bytes(text), 1, mode="all")}
    assert len(found("dna", b"GCC", b"AGCGCTA", 1)) != len(found("dna", b"CCG", b"ATCGCGA", 1))
    pattern = b"ATCATGCTAGC"
    text = b"G" * 10 + pattern + b"G" * 11
    place = lambda ms: sorted((m.text_start, m.text_end, m.cost) for m in ms)
    assert place(found("iupac", pattern, text, 0, rc=True, alpha=0.5)) == place(found("iupac", alphabets.reverse_complement(pattern, "iupac"), text, 0, rc=True, alpha=0.5))
    text = b"GGGGAATAAAAGGG"
    assert found("dna", b"AAAAAAA", text, 1, rc=False)[0].cigar == [m for m in found("dna", b"AAAAAAA", alphabets.reverse_complement(text, "dna"), 1, rc=True) if m.strand == "-"][0].cigar
    assert found("iupac", b"ATG", b"ATGCTACA", 0, rc=True) and found("dna", b"AAGGGGA", b"CCCCCCCCCAAGGGGACCCCCAAGGCGACCCCCCCCC", 1, rc=True)
    assert [m.text_end for m in found("ascii", b"AAA", b"AAAAAA", 0, mode="all")] == [3, 4, 5, 6]
    found("ascii", b"hello", b"heeloo world", 1)
    with pytest.raises(ValueError):
        Searcher("dna", alpha=0.5)
