"""The kernel against naive dynamic programming, and the known cases."""

import random

import pytest

from fuzzscan import Searcher
from fuzzscan.functions import alphabets, cigar
from fuzzscan.operators import kernel
from fuzzscan.operators.kernel import floors
from fuzzscan.operators.search import Options, ends_of, matches


def costs(text, pattern, alphabet, alpha=None):
    """C(0..n), or to n + m with overhang, by the plain recurrence."""
    steps = list(range(len(pattern) + 1)) if alpha is None else floors(alpha, len(pattern)).tolist()
    width = len(text) + (len(pattern) if alpha is not None else 0)
    row = [0] * (width + 1)
    for j, p in enumerate(pattern, 1):
        new = [steps[j]]
        for i in range(1, width + 1):
            same = alphabets.is_match(p, text[i - 1], alphabet) if i <= len(text) else alphabets.iupac_code(p) != 0
            new.append(min(row[i - 1] + (not same), row[i] + 1, new[i - 1] + 1))
        row = new
    return [c + (steps[i - len(text)] if i > len(text) else 0) for i, c in enumerate(row)]


def selected(c, k, mode, n):
    if mode == "all":
        return [(i, x) for i, x in enumerate(c) if x <= k and (i or n == 0)]
    out, falling = [], True
    for i in range(1, len(c)):
        if c[i] > c[i - 1]:
            if falling and c[i - 1] <= k:
                out.append((i - 1, c[i - 1]))
            falling = False
        elif c[i] < c[i - 1]:
            falling = True
    if falling and c[-1] <= k:
        out.append((len(c) - 1, c[-1]))
    return out


LETTERS = {"ascii": b"ab", "dna": b"ACGTacN", "iupac": b"ACGTNRYX", "ascii_ci": b"aAbB["}


@pytest.mark.parametrize("alphabet", LETTERS)
def test_ends_equal_naive(alphabet):
    rng = random.Random(7)
    word = lambda sizes: bytes(rng.choice(LETTERS[alphabet]) for _ in range(rng.choice(sizes)))
    for _ in range(150):
        texts, patterns, k = [word([0, 1, 5, 20, 90]) for _ in range(3)], [word([1, 4, 9, 20]) for _ in range(2)], rng.choice([0, 1, 2, 5])
        for mode in ("local", "all"):
            for seeded in (True, False):
                for pattern, e in zip(patterns, ends_of(texts, patterns, Options(k, alphabet, mode, seeded=seeded))):
                    want = [(t, i, c) for t, text in enumerate(texts) for i, c in selected(costs(text, pattern, alphabet), k, mode, len(text))]
                    assert list(zip(e.text.tolist(), e.end.tolist(), e.cost.tolist())) == want


@pytest.mark.parametrize("alpha", [0.0, 0.4, 0.5, 1.0])
def test_overhang_equals_naive(alpha):
    rng = random.Random(3)
    for _ in range(150):
        text, pattern = (bytes(rng.choice(b"ACGTNX") for _ in range(rng.choice(s))) for s in ([0, 1, 6, 30], [1, 3, 8, 12]))
        k = rng.choice([0, 1, 3, 6])
        for mode in ("local", "all"):
            (e,) = ends_of([text], [pattern], Options(k, "iupac", mode, alpha=alpha))
            want = selected(costs(text, pattern, "iupac", alpha), k, mode, len(text))
            if mode == "all" and len(text) == 0:
                    zero = int(floors(alpha, len(pattern))[-1])
                    want = [(0, zero)] * (zero <= k) + [x for x in want if x[0]]
            assert list(zip(e.end.tolist(), e.cost.tolist())) == want


def test_long_texts_in_parts(monkeypatch):
    rng = random.Random(5)
    monkeypatch.setattr(kernel, "BLOCK", 64)
    monkeypatch.setattr(kernel.pieces, "__defaults__", (64,))
    for _ in range(40):
        text, pattern, k = bytes(rng.choice(b"ACGT") for _ in range(500)), bytes(rng.choice(b"ACGT") for _ in range(rng.choice([6, 14, 24]))), rng.choice([1, 2, 3])
        for mode in ("local", "all"):
            for seeded in (True, False):
                (e,) = ends_of([text], [pattern], Options(k, "dna", mode, seeded=seeded))
                assert list(zip(e.end.tolist(), e.cost.tolist())) == selected(costs(text, pattern, "dna"), k, mode, len(text))


def replayed(m, text, pattern, alphabet):
    """Cost of the CIGAR, checked character by character."""
    j, i, edits = m.pattern_start, m.text_start, 0
    for op, n in cigar.runs(m.cigar):
        for _ in range(n):
            if op in "=X":
                assert alphabets.is_match(pattern[j], text[i], alphabet) == (op == "=")
            edits += op != "="
            j += op != "I"
            i += op != "D"
    assert (j, i) == (m.pattern_end, m.text_end)
    return edits


@pytest.mark.parametrize("alphabet,alpha", [("ascii", None), ("dna", None), ("iupac", None), ("iupac", 0.5)])
def test_alignments_replay(alphabet, alpha):
    rng = random.Random(11)
    letters = {"ascii": b"abc", "dna": b"ACGT", "iupac": b"ACGTNRYX"}[alphabet]
    for _ in range(200):
        text, pattern = (bytes(rng.choice(letters) for _ in range(n)) for n in (rng.choice([3, 40, 120]), rng.choice([2, 8, 15])))
        k = rng.choice([0, 1, 3])
        for _, _, m in matches([text], [pattern], Options(k, alphabet, "all", rc=alphabet != "ascii", alpha=alpha)):
            if m.strand == "-":
                n = len(text)
                turned = type(m)(n - m.text_end, n - m.text_start, m.pattern_start, m.pattern_end, m.cost, "+", m.cigar)
                edits = replayed(turned, text[::-1], alphabets.complement(pattern, alphabet), alphabet)
            else:
                edits = replayed(m, text, pattern, alphabet)
            if alpha is not None:
                steps = floors(alpha, len(pattern))
                edits += int(steps[m.pattern_start]) + int(steps[len(pattern) - m.pattern_end])
            assert edits == m.cost <= k


def shown(ms):
    return [(m.text_start, m.text_end, m.pattern_start, m.pattern_end, m.cost, m.strand, m.cigar) for m in ms]


def test_known_cases():
    assert shown(Searcher("dna").search(b"ATCG", b"AAAATCGGGGGGCATGGG", 1)) == [(3, 7, 0, 4, 0, "+", "4="), (13, 17, 0, 4, 1, "+", "2=X="), (12, 15, 0, 4, 1, "-", "2=D=")]
    half = Searcher("iupac", rc=False, alpha=0.5)
    assert shown(half.search(b"ACGT", b"GTXXXNNN", 1)) == [(0, 2, 2, 4, 1, "+", "2="), (5, 8, 0, 3, 0, "+", "3=")]
    assert shown(half.search(b"GGGGAAAA", b"T" * 16 + b"GGGG", 4)) == [(0, 1, 7, 8, 4, "+", "X"), (17, 20, 0, 3, 2, "+", "3=")]
    assert any(m.text_end == 1 and m.cost == 1 for m in half.search(b"ATC", b"CGGGGGG", 3))
    assert shown(Searcher("dna").search(b"ATCGATCG", b"GGGGATCGATCGTTTT", 1)) == [(4, 12, 0, 8, 0, "+", "8="), (6, 14, 0, 8, 1, "-", "=X6="), (2, 10, 0, 8, 1, "-", "7=X")]
    ends = lambda mode: [m.text_end for m in Searcher("ascii", mode=mode).search(b"AAA", b"AAAAAA", 0)]
    assert ends("local") == [6] and ends("all") == [3, 4, 5, 6]
    pattern = b"ATCGATCA"
    text = b"G" * 8 + alphabets.reverse_complement(pattern, "dna") + b"G" * 8
    assert [m.text_start for m in Searcher("dna").search(pattern, text, 0)] == [8]
    assert not Searcher("dna", rc=False).search(pattern, text, 0)


def test_paths():
    path = lambda s, p, t, k: cigar.path(*((m := s.search(p, t, k)[0]).cigar, m.pattern_start, m.text_start))
    dna, half = Searcher("dna", rc=False), Searcher("iupac", rc=False, alpha=0.5)
    assert path(dna, b"ATGC", b"GGGGATGCGGG", 0) == [(0, 4), (1, 5), (2, 6), (3, 7)]
    assert path(dna, b"ATGC", b"GGGGATTGCGGG", 1) == [(0, 4), (1, 5), (1, 6), (2, 7), (3, 8)]
    assert path(half, b"ATCGATCG", b"ATCGGGGGGGGGG", 2) == [(4, 0), (5, 1), (6, 2), (7, 3)]
    assert path(half, b"ATCGATCG", b"GGGGGGGATCG", 2) == [(0, 7), (1, 8), (2, 9), (3, 10)]


def test_end_filter():
    pattern, text = b"ATCGATCA", bytearray(b"G" * 100)
    text[10:10], text[50:50] = pattern, pattern
    late = lambda p, upto, strand: len(upto) > 10 + len(p)
    assert [m.text_start for m in Searcher("dna", rc=False).search(pattern, bytes(text), 0)] == [10, 50]
    assert [m.text_start for m in Searcher("dna", rc=False).search(pattern, bytes(text), 0, late)] == [50]


def test_rejected():
    for bad in ({"alphabet": "dna", "alpha": 0.5}, {"alphabet": "ascii", "rc": True}, {"alphabet": "iupac", "alpha": 1.5}, {"alphabet": "rna"}):
        with pytest.raises(ValueError):
            Searcher(**bad)
    with pytest.raises(ValueError):
        Searcher("dna").search(b"", b"ACGT", 1)


def test_alphabet_functions():
    assert alphabets.is_match(ord("a"), ord("N"), "iupac") and not alphabets.is_match(ord("X"), ord("N"), "iupac")
    assert not alphabets.is_match(ord("N"), ord("N"), "dna") and alphabets.is_match(ord("t"), ord("T"), "dna")
    assert alphabets.valid_seq(b"ACGTactg", "dna") and not alphabets.valid_seq(b"ACGN", "dna")
    for n in (1, 31, 33, 64, 129):
        assert alphabets.valid_seq((b"ACTUGNRYSWKMBDHVXacgt" * 9)[:n], "iupac")
    for bad in (b"@CGT", b"ACGZ", b"ACG~", b"ACG\n", b"ACG\0"):
        assert not alphabets.valid_seq(bad, "iupac")
    assert alphabets.reverse_complement(b"ACGTRYKMBVDHSWNX", "iupac") == b"XNWSDHBVKMRYACGT"
    assert cigar.packed("==X=") == "2=X=" and cigar.cost("2=X=3D") == 4
