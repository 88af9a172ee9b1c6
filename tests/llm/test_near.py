"""Near-duplicates by wide fingerprints against brute-force Jaccard."""

import random

import pytest
from pyspark.sql import functions as F

from fuzzscan.llm import common, near, simhash

from .test_operators import SCHEMA


def brute(text):
    words = (text or "").encode().lower().split()
    return {b" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def texts(rng):
    """Groups of texts with more and more words replaced, a passage that many hold, and copies."""
    words = [f"w{i}" for i in range(3000)]
    passage = [rng.choice(words) for _ in range(60)]
    out = []
    for g in range(40):
        base = [rng.choice(words) for _ in range(rng.choice([3, 30, 120, 300]))] + (passage if g % 2 else [])
        for edits in range(rng.choice([2, 4, 9])):
            own = list(base)
            for _ in range(edits):
                own[rng.randrange(len(own))] = rng.choice(words)
            out.append(" ".join(own))
    for _ in range(60):  # a group of near copies
        own = list(passage)
        own[rng.randrange(60)] = rng.choice(words)
        out.append(" ".join(own))
    return out + out[:5] + [None, "", " ", out[7].upper()]


def brute_roots(made):
    """Links of brute-force Jaccard, and the least number of each component."""
    own, parent, links = [brute(t) for t in made], list(range(len(made))), []

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(made)):
        for j in range(i):
            if 5 * len(own[i] & own[j]) >= 4 * len(own[i] | own[j]):
                a, b = root(i), root(j)
                links.append((j, i))
                parent[max(a, b)] = min(a, b)
    return links, [root(i) for i in range(len(made))]


@pytest.fixture(scope="module")
def made():
    return texts(random.Random(3))


@pytest.mark.parametrize("block,block_docs", [(simhash.BLOCK, near.BLOCK_DOCS), (8, 8)])
def test_resolve(spark, made, block, block_docs):
    """Every link, also where small blocks make every bucket and every component a hot one."""
    _, roots = brute_roots(made)
    docs = spark.createDataFrame([(i, t, "en", "a", 0) for i, t in enumerate(made)], SCHEMA).repartition(3)
    got = {r.doc_id: r.component_id for r in near.resolve(docs, block=block, block_docs=block_docs).collect()}
    assert got == dict(enumerate(roots))


def test_keep(spark, made):
    _, roots = brute_roots(made)
    rows = [(i, t, "en", "a", 0) for i, t in enumerate(made)]
    rows += [rows[3], rows[3], (None, made[5], "en", "a", 0), (None, "alone " * 9 + "x", "en", "a", 0), (7, "another text under an id that is taken by one before", "en", "a", 0)]
    names = ("first", "kept", "fp", "tid", "n", "root", "i", "j", "rows", "p0", "least")
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3).withColumns({x: F.lit("x") for x in names})
    want = sorted([str(i) for i in set(roots)] + ["None", "7"])
    for most in (near.MOST, 0):
        near.MOST, old = most, near.MOST
        kept = near.keep(docs)
        assert kept.columns == docs.columns and sorted(str(r.doc_id) for r in kept.collect()) == want
        near.MOST = old


def test_empty(spark):
    docs = spark.createDataFrame([], SCHEMA)
    assert near.resolve(docs).count() == 0 and near.keep(docs).count() == 0


def test_fingerprints(made):
    """Bits against a count one by one, and how far apart pairs at the least similarity are."""
    import numpy as np
    import pyarrow as pa

    sets = near.shingles(pa.array(made, pa.string()))
    assert [len(s) for s in sets] == [len(brute(t)) for t in made]
    long = near.shingles(pa.array([" ".join(str(i) for i in range(2000))]))
    bits = near.wide(sets + long, 2)
    odd = near._odd(10)[8:]
    for s, row in zip(sets[:40] + long, [*bits[:40], bits[-1]]):
        for j in range(2):
            x = common.mixed(s * odd[j])
            assert int(row[j]) == sum(1 << b for b in range(64) if 2 * int(((x >> np.uint64(b)) & np.uint64(1)).sum()) > len(s))


def test_recall(spark):
    """Pairs just at the least similarity, each alone: most are found, at every layout of partitions."""
    rng = random.Random(8)
    rows = []
    for g in range(400):
        n = 180
        words = [f"v{rng.randrange(10**9)}" for _ in range(n + 4)]
        other = words[:-20] + [f"u{rng.randrange(10**9)}" for _ in range(20)]  # 160 of 200 shingles in common
        rows += [(2 * g, " ".join(words), "en", "a", 0), (2 * g + 1, " ".join(other), "en", "a", 0)]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    for n in (800, 10**6):
        words = near.layout(n)[2]
        fps = common.written(near.prints(docs, words).select("doc_id", "fp", *[f"p{j}" for j in range(words)]), "fps")
        ids = {r.fp: r.doc_id for r in fps.collect()}
        found = {frozenset((ids[r.a], ids[r.b])) for r in near.candidates(fps, n).collect()}
        assert sum(frozenset((2 * g, 2 * g + 1)) in found for g in range(400)) >= 394
