"""Each operator against brute force, and on nulls, empty and long texts, repeated rows, empty tables and clashing names."""

import base64
import collections
import hashlib
import io
import math
import random
import subprocess
import sys
import zlib

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from fuzzscan.llm import attention, bpe, common, html, langid, lm, media, mixing, quality, sharding, simhash, subword, tokenfile

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LANGS = {"en": "the of and to in is that it was for on with", "de": "der die und in den von zu das mit sich des auf", "fr": "de la le et les des en un du une que est"}


def prose(rng, lang, n):
    return " ".join(rng.choice(LANGS[lang].split()) + rng.choice(["", "", "er", "ing" if lang == "en" else "ung" if lang == "de" else "eux", "."]) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(1)
    out = []
    for i in range(240):
        lang = rng.choice(list(LANGS))
        out.append((i, prose(rng, lang, rng.choice([3, 12, 60, 300])), lang, rng.choice(["a", "a", "a", "b", "é", None]), 0))
    out += [(300 + i, out[5][1], "en", "hot", 0) for i in range(40)]  # copies
    out += [(400, None, "en", "a", 0), (401, "", "en", "a", 0), (402, " \t\n\x0b", None, None, 0), (None, "no id at all here", "en", "a", 0), (403, "12 34 !!", "en", "b", 0)]
    out += [(404, "word " * 30000, "en", "b", 0), (405, "x" * 20000, "en", "b", 0), (406, "double  space\n\nand \ttab ", "en", "b", 0), (406, "double  space\n\nand \ttab ", "en", "b", 0)]
    return out


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def clashing(df):
    """Columns under names that operators use inside."""
    return df.withColumns({x: F.lit("x") for x in ("size", "h", "shard", "fp", "ids", "n", "row", "key", "part", "slot", "label", "root", "component_id", "media", "copies", "segments", "target")})


def words(text):
    return (text or "").encode().split()


def by_id(df):
    return {r.doc_id: r for r in df.collect() if r.doc_id is not None}


def same(a, b):
    assert sorted(map(str, a.collect())) == sorted(map(str, b.collect()))


# ---------------------------------------------------------------- 1


def brute_mix(rows, seed_hash):
    sizes = collections.defaultdict(int)
    for r in rows:
        sizes[r[3]] += len(words(r[1]))
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: i % 3 + 1 for i, s in enumerate(order)}
    total, open_, target = sum(sizes.values()), set(order), {}
    while open_:
        level = (total - sum(target.values())) / sum(weight[s] for s in open_)
        over = [s for s in open_ if weight[s] * level >= 3 * sizes[s]]
        if not over:
            target |= {s: weight[s] * level for s in open_}
            break
        for s in over:
            target[s] = 3 * sizes[s]
            open_.remove(s)
    return sizes, target


def brute_taken(rows, seed=17):
    """Rows in order of hash, each whole while the budget lasts, then what is left of it."""
    sizes, target = brute_mix(rows, None)
    left, out = {}, []
    for s in sizes:
        copies = int(target[s] // sizes[s]) if sizes[s] else 0
        left[s] = (copies, int(target[s] - copies * sizes[s]))
    key = lambda r: int(hashlib.md5((f"{seed}t{r[1] or ''}" if r[0] is None else f"{seed}:{r[0]}").encode()).hexdigest()[:15], 16)
    groups = collections.defaultdict(list)
    for r in rows:
        groups[r[3], key(r)].append(r)
    need = {s: n for s, (_, n) in left.items()}
    for (s, _), same in sorted(groups.items(), key=lambda x: x[0][1]):
        total = sum(len(words(r[1])) for r in same)
        give = min(total, need[s])
        need[s] -= give
        out += [(str(r[0]), left[s][0] * len(words(r[1])) + (len(words(r[1])) * give // total if total else 0)) for r in same]
    return sorted(out)


@pytest.mark.parametrize("few", [mixing.MOST_SOURCES, 0])
def test_mixing(docs, rows, empty, few, monkeypatch):
    monkeypatch.setattr(mixing, "MOST_SOURCES", few)
    got = mixing.mix(docs).collect()
    sizes, target = brute_mix(rows, None)
    assert len(got) == len(rows)
    taken = collections.Counter()
    for r in got:
        assert r.source_size == sizes[r.source] and abs(r.target - target[r.source]) < 1e-6 * max(1, target[r.source])
        assert 0 <= r.taken <= 3 * r.size
        taken[r.source] += r.taken
    for s in sizes:
        assert -1e-6 <= target[s] - taken[s] < 2  # two rows share an id
    assert sorted((str(r.doc_id), r.taken) for r in got) == brute_taken(rows)
    same(mixing.mix(docs), mixing.mix(clashing(docs.repartition(7))))
    assert mixing.mix(empty).count() == 0 and mixing.apply(empty).count() == 0
    applied = mixing.apply(clashing(docs))
    assert applied.columns == clashing(docs).columns
    made = collections.Counter(str(r.doc_id) for r in applied.select("doc_id").collect())
    held = collections.Counter(str(r[0]) for r in rows)
    for r in got:
        if held[str(r.doc_id)] == 1:
            assert made[str(r.doc_id)] - r.passes in (0, 1) and (made[str(r.doc_id)] == r.passes or 2 * (r.taken - r.passes * r.size) >= r.size)


@pytest.mark.parametrize("n", [1, 3, 30])
def test_mixing_coarse(spark, n):
    """Sources of one or a few documents, heavy-tailed: the budget is met all the same."""
    rng = random.Random(n)
    made = [(i * 10 + s, "w " * (1000 if n == 1 else int(10 * rng.paretovariate(0.7)) % 9000 + 1), None, f"s{s}", 0) for i in range(n) for s in range(5)]
    sizes, target = brute_mix(made, None)
    taken = collections.Counter()
    for r in mixing.mix(spark.createDataFrame(made, SCHEMA)).collect():
        taken[r.source] += r.taken
    assert all(0 <= target[s] - taken[s] < 1 for s in sizes)


def test_mixing_targets(spark):
    sizes = spark.createDataFrame([("a", 10), ("b", 1000), ("c", 10), (None, 500), ("d", 0)], "source string, source_size long")
    got = {r.source: r.target for r in mixing.targets(sizes).collect()}
    assert got["a"] == 30 and got["c"] == 30 and got["d"] == 0
    assert abs(sum(got.values()) - 1520) < 1e-6 and abs(got["b"] / got[None] - 1) < 1e-9


# ---------------------------------------------------------------- 2


@pytest.fixture(scope="module")
def oracle():
    import public_tokenizers as P
    import tiktoken

    with open(P.path(bpe.VOCABULARY), "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe(docs, rows, empty, oracle):
    got = by_id(bpe.round_trip(clashing(docs)))
    for i, text, *_ in rows:
        if i is not None:
            ids = oracle.encode_ordinary(text or "")
            assert got[i].n_tokens == len(ids) and got[i].ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
            assert got[i].decoded_sha256 == hashlib.sha256((text or "").encode()).hexdigest()
    assert bpe.round_trip(empty).count() == 0
    back = {r.doc_id: bytes(r.bytes) for r in bpe.decode(bpe.encode(docs)).collect()}
    assert all(back[i] == (t or "").encode() for i, t, *_ in rows if i != 406)


def test_bpe_odd_texts(oracle, monkeypatch):
    codec = bpe.codec()
    rng = random.Random(2)
    texts = ["".join(rng.choice("ab c\n\t'sé 1漢!   \r'll😀\x1c\x85　") for _ in range(rng.randrange(50))) for _ in range(500)] + ["ab" * 50000, "'" * 3000]
    want = [oracle.encode_ordinary(t) for t in texts]
    ids = lambda some: [np.frombuffer(x, codec.dtype).tolist() for x in codec.encode_batch(some)]
    for memo in (250_000, 10):
        monkeypatch.setattr(bpe, "PIECES", memo)
        codec.remembered = memo
        assert ids(texts) == want and [ids([t])[0] for t in texts[:50]] == want[:50]
    monkeypatch.setattr(subword, "SPAN", 4)
    assert ids(texts) == want
    keys = [f"{i}".encode() for i in range(5000)]
    hashed = bpe.PerfectHash(keys)
    assert sorted(hashed.number(keys).tolist()) == list(range(5000))


def test_bpe_words_are_remembered_once(oracle):
    """A word of one pre-token is not among the pre-tokens as well."""
    codec = bpe.Codec(common.tokenizer_file(bpe.VOCABULARY), oracle._pat_str)
    text = "a " + " ".join(f"q{'xyz'[i % 3] * (i // 3 + 1)}k" for i in range(60)) + " it's, so"
    (got,) = codec.encode_batch([text])
    assert np.frombuffer(got, codec.dtype).tolist() == oracle.encode_ordinary(text)
    assert len(codec.known) >= 60 and not any(w in codec.pieces for w in (" qxk", " qzzk"))


ENCODING = """
import resource, sys
import numpy as np, pyarrow as pa
from fuzzscan.llm import bpe

class Frame:  # gives what a worker runs
    selectExpr = lambda self, *_: self
    mapInArrow = lambda self, run, ddl: run

def words(rng, n):  # of 7 letters, one of six met nowhere else
    out = np.frombuffer(b"etaoinshrdlu", np.uint8)[rng.integers(0, 12, (n, 8), np.uint8)]
    out[:, 7] = 32
    often = np.flatnonzero(rng.integers(0, 6, n, np.uint8))
    out[often] = out[often % 1000]
    return out.tobytes()

rng, row = np.random.default_rng(1), 4096
flat = b"".join([words(rng, 1 << 16) for _ in range(64)])
edges = np.arange(0, len(flat) + 1, row, dtype=np.int32)
texts = pa.StringArray.from_buffers(len(edges) - 1, pa.py_buffer(edges), pa.py_buffer(flat))
batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), texts], names=["doc_id", "text"])
run = bpe.round_trip(Frame())
bpe.codec(bpe.VOCABULARY)
before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
rows = sum(made.num_rows for made in run(iter([batch])))
print(rows == batch.num_rows, (resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before) >> 10)
"""


def test_bpe_memory():
    """A worker needs a small part of an executor's memory beside its batch, many new words or not."""
    whole, mb = subprocess.run([sys.executable, "-c", ENCODING], capture_output=True, text=True, check=True, timeout=300).stdout.split()
    assert whole == "True" and int(mb) < 300


# ---------------------------------------------------------------- 3


def test_quality(docs, rows, empty):
    got = by_id(quality.judge(clashing(docs)))
    for i, text, *_ in rows:
        if i is None:
            continue
        w = [x.decode() for x in words(text)]
        windows = collections.Counter(tuple(w[j : j + 5]) for j in range(len(w) - 4))
        covered = {j + d for j in range(len(w) - 4) if windows[tuple(w[j : j + 5])] > 1 for d in range(5)}
        lines = [x for x in (text or "").split("\n") if x.encode().split()]
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_repeat_words) == (len(w), sum(map(len, w)), len(covered))
        assert r.n_symbols == sum(c in "#*$%&|<>" for c in text or "") and r.n_dup_lines == len(lines) - len(set(lines))
        assert r.base_failed == (len(w) < 10 or 100 * len(covered) > 20 * len(w)) and (not r.kept or not r.base_failed)
    assert quality.judge(empty).count() == 0 and quality.keep(empty).count() == 0
    kept = {r.doc_id for r in quality.keep(clashing(docs)).collect()}
    assert {i for i, r in got.items() if r.kept} == kept - {None}
    again = quality.judge(docs, list(quality.RULES)[::-1])
    same(quality.judge(docs, list(quality.RULES)), again)


def test_quality_rules():
    clean = "The one of it and more of the same text that is long enough to be kept as good prose. " * 1
    bad = ["".join(w + "%%% " for w in clean.split()), " | ".join(clean.split()), "".join(w.upper() + "!! " for w in clean.split()), "1 2 3 4 5 6 7 8 9 10 11 12 13"]
    assert quality.verdict(quality.Features(clean), list(quality.RULES))
    assert not any(quality.verdict(quality.Features(x), list(quality.RULES)) for x in bad)
    long = [f"{i % 700}".encode() for i in range(3000)]
    assert quality._repeats_of_long(long, 5).all() and quality.repeated_words(long) == 3000


# ---------------------------------------------------------------- 4


@pytest.mark.parametrize("head", [1 << 21, 8])
def test_lm_base(docs, rows, head):
    got = [r for r in lm.score(clashing(docs).drop("row"), head=head).collect()]
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    c = collections.Counter()
    low = lambda t: (t or "").encode().translate(common.LOWER).split()
    for i, text, *_ in rows:
        if not held(i):
            c.update(low(text) + [None])
    n, v = sum(c.values()), len(c)
    texts = collections.defaultdict(list)
    for i, text, *_ in rows:
        texts[i].append(text)
    assert len(got) == len(rows)
    for r in got:
        w = low(texts[r.doc_id][0]) + [None]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held(r.doc_id), len(w), sum(x in c for x in w), n)
        want = sum(math.log10((c.get(x, 0) + 1) / (n + v + 1)) for x in w)
        assert abs(r.base_score - want) < 1e-6 * max(1, abs(want)) and r.score < 0


def test_lm_empty(empty, spark):
    assert lm.score(empty).count() == 0
    one = lm.score(spark.createDataFrame([(1, None, None, None, 0), (14, "a b", None, None, 0)], SCHEMA)).collect()
    assert all(np.isfinite(r.base_score) and np.isfinite(r.score) for r in one)


def toy_model(trained=True):
    rng = np.random.default_rng(0)
    tokens = [bytes([i % 256]) for i in range(300)]
    walk = lambda n: np.cumsum(np.concatenate([[rng.integers(50)], rng.choice([1, 2], n - 1, p=[0.9, 0.1])])) % 50
    windows = np.array([walk(attention.WINDOW + 1) for _ in range(256)])
    counts, flat = np.bincount(windows.reshape(-1), minlength=300), windows.reshape(-1)
    same = np.ones(len(flat) - 1, bool)
    same[attention.WINDOW :: attention.WINDOW + 1] = False
    model = attention.Model.fresh(tokens, counts, attention.neighbours(flat, same, *attention.buckets(counts)))
    state, losses = attention.Adam(model.p), []
    for _ in range(12 if trained else 0):
        losses += model.train(windows, 0.01, state)
    three = np.unique(attention.code(0, model.cls[windows[:, :-2]], windows[:, 1:-1], windows[:, 2:]), return_counts=True)
    two = np.unique(attention.code(0, 0, windows[:, :-1], windows[:, 1:]), return_counts=True)
    model.inside = attention.Inside(model.cls, model.share, two, three)
    return model.ready(), losses, walk


def test_ids_within_a_class_add_up():
    """After any two ids the probabilities of the ids of a class add up to 1, seen or not."""
    model, _, _ = toy_model()
    last = np.arange(300)
    for far, near in ((0, 3), (5, 20), (attention.CLASSES, 300), (2, 299)):
        p = np.exp(model.inside(np.full(300, far), np.full(300, near), last).astype(float))
        assert np.allclose(np.bincount(model.cls, p, attention.CLASSES)[np.unique(model.cls)], 1, atol=1e-4)
    table = attention.Table(np.arange(0, 70000, 7) << 20, np.arange(10000.0))
    values, found = table.get(np.arange(70000) << 20)
    assert (found == (np.arange(70000) % 7 == 0)).all() and (values[::7] == np.arange(10000)).all()


def test_lm_windows_and_layout(docs, rows):
    """Windows cover every training text, its start and end; scores do not depend on the layout."""
    use = subword.rank_ids(lm.VOCABULARY)
    table = lm.measured(docs, lm.frequent(docs.sparkSession.createDataFrame([], "word long, c long"), "word", 1), F.lit(False), lm.VOCABULARY)
    made = lm._matrix([bytes(r.ids) for r in lm.training_windows(table, use.size, use.end, use.dtype, 1).collect()])
    texts = [[use.size, *use.library.encode_ordinary(r[1] or ""), use.end] for r in rows]
    want = [x[a : a + 33] for x in texts for a in range(0, len(x) - 1, 32)]
    assert sorted([i for i in w if i != use.size + 1] for w in made.tolist()) == sorted(want)
    a = {str(r.doc_id) + str(r.n_tokens): r.score for r in lm.score(docs).collect()}
    b = {str(r.doc_id) + str(r.n_tokens): r.score for r in lm.score(docs.repartition(7)).collect()}
    assert a.keys() == b.keys() and all(abs(a[k] - b[k]) < 1e-4 * max(1, abs(a[k])) for k in a)


def test_lm_trains_on_every_window(docs, monkeypatch):
    """Each window of each training text is in one round."""
    use, seen = subword.rank_ids(lm.VOCABULARY), []
    table = lm.measured(docs, lm.frequent(docs.sparkSession.createDataFrame([], "word long, c long"), "word", 1), F.lit(False), lm.VOCABULARY)
    monkeypatch.setattr(lm, "_averaged", lambda model, windows, *_: seen.append(sorted(bytes(r.ids) for r in windows.collect())))
    lm.trained(table)
    made = lm.training_windows(table, use.size, use.end, use.dtype, 1)
    assert len(seen) == len(lm.RATES) and all(seen) and sorted(sum(seen, [])) == sorted(bytes(r.ids) for r in made.collect())


def test_attention_learns_and_is_causal():
    model, losses, walk = toy_model()
    assert np.mean(losses[-4:]) < 0.5 * losses[0]
    a = walk(100)
    b = a.copy()
    b[60:] = 7
    first = model._log_probs(np.append(model.start, model.kind[a[:31]])[None], model.cls[a[:32]][None], 0)
    kinds = np.append(model.start, model.kind[a[:31]])
    kinds[20:] = 3
    second = model._log_probs(kinds[None], model.cls[a[:32]][None], 0)
    assert np.allclose(first[0, :20], second[0, :20], atol=1e-5)
    assert abs(np.exp(model.share).sum() - attention.CLASSES) < attention.CLASSES  # shares of a class add up to 1
    for k in np.unique(model.cls):
        assert abs(np.exp(model.share[model.cls == k]).sum() - 1) < 1e-9


def test_attention_gradients():
    model, _, walk = toy_model(False)
    model.p = {k: x.astype(np.float64) for k, x in model.p.items()}
    ids = np.array([walk(attention.WINDOW + 1) for _ in range(3)])
    kinds, targets = model.kind[ids[:, :-1]], model.cls[ids[:, 1:]]
    _, g = model.step(kinds, targets)
    for name, x in model.p.items():
        at = np.unravel_index(np.abs(g[name]).argmax(), x.shape)
        old, h = x[at], 1e-4
        x[at] = old + h
        up = model.step(kinds, targets)[0]
        x[at] = old - h
        down = model.step(kinds, targets)[0]
        x[at] = old
        assert abs((up - down) / (2 * h) - g[name][at]) < 2e-3 * max(0.05, abs(g[name][at])), name


@pytest.mark.parametrize("far", [1, 100])
def test_attention_step_in_parts(far):
    """A step over more windows than are worked through at once, the last ones fewer, with places that do not count, gives
    the sums of its windows' own; also where scores are too large for exp()."""
    model, _, walk = toy_model(False)
    model.p = {k: x.astype(np.float64) * (far if k in "qw" else 1) for k, x in model.p.items()}
    ids = np.array([walk(attention.WINDOW + 1) for _ in range(2 * attention.TOGETHER + 5)])
    kinds, targets = model.kind[ids[:, :-1]], model.cls[ids[:, 1:]]
    real = np.arange(attention.WINDOW) < 1 + np.arange(len(ids))[:, None] % attention.WINDOW
    loss, g = model.step(kinds, targets, real)
    own = [model.step(kinds[i : i + 1], targets[i : i + 1], real[i : i + 1]) for i in range(len(ids))]
    share = real.sum(1) / real.sum()
    assert abs(loss - sum(s * one for s, (one, _) in zip(share, own))) < 1e-5 * abs(loss)
    for k in g:
        want = sum(s * one[k] for s, (_, one) in zip(share, own))
        assert np.abs(g[k] - want).max() < 1e-5 * np.abs(want).max(), k


def test_rows_summed_by_number():
    rng = np.random.default_rng(3)
    for row in (rng.integers(0, 9, 1000), np.minimum(rng.geometric(0.05, 1000), 98), np.zeros(0, int), np.full(15, 4), np.full(16, 4)):
        x, want = rng.standard_normal((len(row), 5)), np.zeros((99, 5))
        np.add.at(want, row, x)
        assert np.allclose(attention._by_row(x, row, 99), want)


def test_words_listed():
    """Distinct words, empty ones and ones beyond ASCII included, come out of one string in their order."""
    words = pa.array(["a", "", "\u00e9\u4e2d", "b\nc", ""])
    assert common.joined(words).split(b" ") == [w.encode() for w in words.to_pylist()]
    texts = [None, "", " A b\n", "\u00c9 a\x0bB", "a"]
    keys, codes, n = common.coded(pa.array(texts, pa.string()))
    want = [(t or "").encode().translate(common.LOWER).split() for t in texts]
    assert n.tolist() == [len(w) for w in want]
    assert keys[codes].tolist() == [int(np.uint64(xxhash.xxh64_intdigest(w)).astype(np.int64)) for ws in want for w in ws]


def test_windows_score_each_token_once():
    model, _, walk = toy_model()
    lengths = np.array([0, 1, 7, 8, 31, 32, 33, 56, 57, 200])
    texts = [walk(n) if n else np.zeros(0, int) for n in lengths]
    got = model.score(np.concatenate(texts).astype(np.int64), lengths, 299)
    for ids, score in zip(texts, got):
        seq, targets = np.append(model.start, model.kind[ids]).astype(int), np.append(ids, 299)
        total, over = 0.0, attention.WINDOW - attention.STRIDE
        for i, t in enumerate(targets):
            a = 0 if i < attention.WINDOW else ((i - over) // attention.STRIDE) * attention.STRIDE
            part = seq[a : i + 1]
            near, far = targets[i - 1] if i else 300, model.cls[targets[i - 2]] if i > 1 else attention.CLASSES
            total += model._log_probs(part[None], np.full((1, len(part)), model.cls[t]), len(part) - 1)[0, 0] + model.inside(np.array([far]), np.array([near]), np.array([t]))[0]
        assert abs(score - total / math.log(10)) < 1e-3


# ---------------------------------------------------------------- 5


def test_html():
    page = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body><header><h1>Site</h1></header>
    <nav><ul><li><a href="/a">one</a></li></ul></nav><div class="ad">buy it and the best of it all in one for you</div><article><h1>Head &amp; line</h1>
    <p>Short.</p><p>It is the&nbsp;one <b>of</b><br>them &lt;all&gt; and &#8364; more&amp<p>Plain words%%% only%%% here%%% with%%% no%%% common%%% ones%%% inside%%% this%%% long%%% block.%%%</p>
    <form><p>Name of the one that is</p><input></form><div id="comments"><p>I think that it is the best of all and so on and on for you and me.</p></div></article><aside>side of the page</aside><footer>&copy; foot</footer></body>"""
    assert html.main_text(page) == "Head & line\nShort.\nIt is the one of them <all> and € more&\nPlain words%%% only%%% here%%% with%%% no%%% common%%% ones%%% inside%%% this%%% long%%% block.%%%"
    good = "It is the one of all that has the most of it and is in the way of those who were with us when it was on for the best. " * 3
    loose = f"<div><a href=x>Home</a> <a href=y>About</a></div><h2>Title</h2><p>{good}</p><p>Short one.</p><p>{good}</p><div><a href=z>Next page of it</a></div>"
    assert html.main_text(loose) == f"Title\n{good.strip()}\nShort one.\n{good.strip()}"
    for odd in (None, "", "<", "<p", "<!--", "<a href='x", "<script>", "</div></p>", "&amp;&#x110000;&nosuch;"):
        html.main_text(odd)


def test_html_table(spark):
    pages = spark.createDataFrame([(1, "u", "<article><p>Hi there</article>", "x"), (1, "u", "<article><p>Hi there</article>", "x"), (2, None, None, "x"), (None, "u", "", "x")], "page_id long, url string, html string, text string")
    got = sorted(html.extract(pages).collect(), key=str)
    assert [r.n_chars for r in got if r.page_id == 1] == [8, 8] and [r.text for r in got if r.page_id == 2] == [""]
    assert html.extract(pages.limit(0)).count() == 0


# ---------------------------------------------------------------- 6


def test_langid(docs, rows, empty):
    held = lambda i: zlib.crc32(str(i).encode()) % 4 == 2
    model = langid.fit(docs.where(~langid.held_out()))
    got = by_id(langid.predict(clashing(docs), model))
    long = [r for r in rows if r[0] is not None and r[0] < 240 and held(r[0])]
    assert sum(got[i].lang_pred == lang for i, _, lang, *_ in long) >= 0.95 * len(long) > 20
    for i in (400, 401, 402, 403):
        assert got[i].lang_pred == "und" and got[i].score == 0 and got[i].rejected
    assert all(0 <= r.score <= 1 for r in got.values())
    kept = {r.doc_id for r in langid.keep(clashing(docs), model).collect()}
    assert kept >= set(range(240)) and not kept & {400, 401, 402, 403}
    foreign = ["Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw. Są oni obdarzeni rozumem i sumieniem.", "Bütün insanlar hür, haysiyet ve haklar bakımından eşit doğarlar. Akıl ve vicdana sahiptirler", base64.b64encode(random.Random(1).randbytes(300)).decode()]
    assert all(far for *_, far in model.predict(foreign))
    same(langid.predict(docs, model), langid.predict(docs, langid.fit(docs.repartition(5).where(~langid.held_out()))))
    assert langid.predict(empty, model).count() == 0
    assert {r.lang_pred for r in langid.predict(docs, langid.fit(empty)).collect()} == {"und"}
    assert [x[0] for x in model.predict(["½ ² ①", "١٢٣ _", None, "é"])][:3] == ["und"] * 3 and model.predict(["é"])[0][0] != "und"


def test_langid_many_languages(spark):
    """Every labelled language is learned, however many there are for the sample."""
    rows = [(i, f"word{i // 2} of language number {i // 2}", f"l{i // 2:03d}", "a", 0) for i in range(300)]
    model = langid.fit(spark.createDataFrame(rows, SCHEMA).repartition(3), sample=40)
    assert len(model.langs) == 150


def brute_langid(model, texts):
    """Cosines of sparse vectors made gram by gram."""
    out = []
    for t in texts:
        raw = b"  " + (t or "").lower().encode().translate(langid._KEEP) + b"  "
        tf = collections.Counter()
        for i in range(1, len(raw) - 1):
            if raw[i] != 32:
                gram = raw[i - 1] | raw[i] << 8 | raw[i + 1] << 16
                tf[(gram * 2654435761 & 0xFFFFFFFF) >> 20] += 1
        v = {k: math.log1p(n) * float(model.idf[k]) for k, n in tf.items()}
        norm = math.sqrt(sum(x * x for x in v.values())) or 1
        out.append([sum(x / norm * float(c[k]) for k, x in v.items()) for c in model.centroids])
    return out


def test_langid_brute(docs, rows):
    model = langid.fit(docs.where(~langid.held_out()))
    texts = [r[1] for r in rows if r[1] and r[0] is not None and r[0] < 100]
    for close, (lang, score, _) in zip(brute_langid(model, texts), model.predict(texts)):
        assert abs(max(close) - score) < 1e-4 and close[int(np.argmax(close))] - max(c for c, o in zip(close, model.owner) if model.langs[o] == lang) < 1e-4


# ---------------------------------------------------------------- 7


def brute_print(text, width=3):
    w = [x.decode() for x in (text or "").encode().lower().split()]
    shingles = [" ".join(w[i : i + width]) for i in range(max(1, len(w) - width + 1))] if w else []
    h = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(prints, distance):
    root = list(range(len(prints)))
    f = np.array(prints, np.uint64)
    for i in range(len(f)):
        for j in np.flatnonzero(np.bitwise_count(f ^ f[i]) <= distance):
            a, b = i, int(j)
            while root[a] != a:
                a = root[a]
            while root[b] != b:
                b = root[b]
            root[max(a, b)] = min(a, b)
    out = []
    for i in range(len(f)):
        while root[i] != root[root[i]]:
            root[i] = root[root[i]]
        out.append(root[i])
    return out


def test_simhash(docs, rows, empty):
    got = simhash.resolve(clashing(docs)).collect()
    prints = [brute_print(t) for _, t, *_ in rows]
    roots = brute_components(prints, 3)
    least = {}
    for (i, *_), r in zip(rows, roots):
        if i is not None:
            least[r] = min(i, least.get(r, i))
    want = sorted((str(i), p, least.get(r)) for (i, *_), p, r in zip(rows, prints, roots))
    assert sorted((str(r.doc_id), r.fp & (2**64 - 1), r.component_id) for r in got) == want
    assert simhash.resolve(empty).count() == 0


@pytest.mark.parametrize("block,distance", [(4096, 3), (8, 3), (8, 7)])
def test_simhash_links(spark, block, distance):
    """Chains, tight groups and random fingerprints; small blocks make every bucket a hot one."""
    rng = random.Random(block + distance)
    made = {rng.getrandbits(64) for _ in range(300)}
    for centre in list(made)[:6]:
        made |= {centre ^ sum(1 << b for b in rng.sample(range(64), rng.randint(1, 3))) for _ in range(60)}
        for _ in range(20):
            centre ^= sum(1 << b for b in rng.sample(range(64), distance))
            made.add(centre)
    values = sorted(made)
    df = common.written(spark.createDataFrame([(simhash._signed(v),) for v in values], "fp long"), "fps")
    found = simhash.components(simhash.links(df, len(values), distance, block))
    root = {r.node & (2**64 - 1): r.root for r in found.collect()}
    want = brute_components(values, distance)
    groups = collections.defaultdict(set)
    for v, r in zip(values, want):
        groups[r].add(v)
    mine = collections.defaultdict(set)
    for v in values:
        mine[root.get(v, v)].add(v)
    assert sorted(map(sorted, mine.values())) == sorted(map(sorted, groups.values()))


def test_simhash_plans():
    rng = np.random.default_rng(1)
    sample = rng.integers(0, 2**63, 500).astype(np.uint64)
    for distance in (3, 7):
        for n in (1000, 10**6, 10**9):
            plan = simhash.choose(sample, n, distance)
            assert sorted(b for p in plan.parts for b in p) == list(range(64))
            assert sum(t + 1 for t in plan.allowed) == distance + 1


# ---------------------------------------------------------------- 8


def test_tokenfile(docs, rows, empty):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(common.tokenizer_file(tokenfile.VOCABULARY))
    files = tokenfile.write_files(clashing(docs), tokens=20000, partitions=3)
    got = sorted(tokenfile.read_files(files).collect(), key=lambda r: r.start)
    ids = {i: library.encode(t or "", add_special_tokens=False).ids + [2] for i, t, *_ in rows}
    assert [r.doc_id for r in got] == sorted((r[0] for r in rows), key=lambda i: (i is None, i))
    start = 0
    for r in got:
        want = ids[r.doc_id]
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(want), zlib.crc32(np.array(want, "<u4").tobytes()))
        start += len(want)
    assert files.count() > 3 and tokenfile.read_files(tokenfile.write_files(empty)).count() == 0
    opened = tokenfile.TokenFile(bytes(files.orderBy("part", "file").first().payload))
    at = opened.starts[1]
    assert opened.matrix.access(np.arange(at, at + opened.lengths[1])).tolist() == ids[opened.doc_ids[1]]


@pytest.mark.parametrize("n,sigma", [(0, 1), (1, 1), (500, 1), (5000, 300), (3000, 2)])
def test_wavelet(n, sigma):
    a = np.random.default_rng(n).integers(0, sigma, n).astype(np.uint16) * 3
    w = tokenfile.WaveletMatrix.build(a)
    assert (w.sequence() == a).all() and (not n or (w.access(np.arange(n)) == a).all())
    for token in (0, 3, 30, 299 * 3, 7):
        where = np.flatnonzero(a == token)
        assert w.occurrences(token).tolist() == where.tolist() and w.count(token) == len(where)
        assert w.count(token, n // 3, n // 2) == ((where >= n // 3) & (where < n // 2)).sum()
        if len(where):
            assert w.select(token, len(where) // 2) == where[len(where) // 2]


def test_subwords_equal_library(monkeypatch):
    from tokenizers import Tokenizer

    use = subword.Subwords(common.tokenizer_file(tokenfile.VOCABULARY))
    fresh = Tokenizer.from_file(common.tokenizer_file(tokenfile.VOCABULARY))
    rng = random.Random(9)
    texts = ["".join(rng.choice("ab c\n\t'sé 1漢!   \r'll😀\x1c\x85　") for _ in range(rng.randrange(60))) for _ in range(800)] + ["", None, " ", "a", " a", "<|endoftext|> x", "hello <|endoftext|> world", "a  <|endoftext|><|endoftext|>", "<|endoftext"]
    want = [fresh.encode(t or "", add_special_tokens=False).ids for t in texts]
    assert want[texts.index("hello <|endoftext|> world")] == [31373, 220, 50256, 995]
    for memo, span in ((400_000, 1 << 20), (20, 4)):
        use.remembered, use.memo, use.old = memo, {}, {}
        monkeypatch.setattr(subword, "SPAN", span)
        assert [np.frombuffer(x, use.dtype).tolist() for x in use.encode_batch(texts)] == want
        assert [np.frombuffer(x, use.dtype).tolist() for x in use.encode_batch(texts[::-1])][::-1] == want
    assert b"".join(use.tokens()[i] for i in want[5]).decode() == texts[5]


@pytest.mark.parametrize("make", [lambda: subword.Subwords(common.tokenizer_file(tokenfile.VOCABULARY)), lambda: subword.RankIds(common.tokenizer_file(lm.VOCABULARY))])
def test_frequent_words_are_learned_once(make, monkeypatch):
    """Words met often stay known while many others, more than are remembered, come and go; ids stay those of the library."""
    use, learned = make(), collections.Counter()
    words = use.words
    monkeypatch.setattr(use, "words", lambda some: learned.update(some) or words(some))
    use.remembered, often = 2000, [f"often{i}" for i in range(100)]
    for k in range(9):
        some = [] if k % 3 else often * 20
        text = " ".join(["x", *some, *(f"once{k}n{i}" for i in range(1500))])
        (got,) = use.encode_batch([text])
        want = use.library.encode(text, add_special_tokens=False).ids if isinstance(use, subword.Subwords) else use.library.encode_ordinary(text)
        assert np.frombuffer(got, use.dtype).tolist() == want
    assert {learned[w] for w in often} == {1} and len(use.known) <= 2000


# ---------------------------------------------------------------- 9


def test_media(docs, rows, empty):
    for kind in ("ppm", "bmp"):
        stored = media.tiles(media.to_media(clashing(docs), kind=kind))
        got = by_id(media.features(stored))
        for i, text, *_ in rows:
            if i is not None:
                raw = (text or "").encode()
                full = raw + b" " * ((-len(raw)) % 192 or (0 if raw else 192))
                r = got[i]
                assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(full), hashlib.sha256(full).hexdigest(), zlib.crc32(full[-16:]))
    assert media.features(media.tiles(media.to_media(empty))).count() == 0
    assert len({r.feature for i, r in got.items() if i >= 300 and i < 340}) == 1
    texts = {r[0]: r[1] for r in rows}
    for tile in stored.collect():
        if tile.doc_id is None:
            continue
        # the tile and the hash from the pixels, without integral images
        image = np.frombuffer(media.payload(texts[tile.doc_id])[1], np.uint8).reshape(-1, 64, 3).astype(float)
        each = lambda h, w, x=image: np.repeat(np.repeat(x, h, 0), w, 1).reshape(h, x.shape[0], w, 64, 3).mean((1, 3))
        if image.shape[0] > 200:
            continue
        assert (np.load(io.BytesIO(bytes(tile.npy))) == np.rint(np.round(each(8, 8), 6))).all()
        grey = np.round(each(8, 9).mean(2), 6)
        assert tile.dhash == np.packbits(grey[:, :-1] < grey[:, 1:]).tobytes().hex()
        assert got[tile.doc_id].feature == f"{tile.dhash}:{zlib.crc32(bytes(tile.npy)):08x}" and got[tile.doc_id].media_sha256 == tile.media_sha256


def test_pictures():
    rng = np.random.default_rng(3)
    image = rng.integers(0, 256, (37, 23, 3), dtype=np.uint8)
    assert (media.decode(media.encode_netpbm(image.tobytes(), 23)) == image).all() and (media.decode(media.encode_bmp(image.tobytes(), 23)) == image).all()
    grey = image[:, :, :1]
    assert (media.decode(media.encode_netpbm(grey.tobytes(), 23, 1)) == grey).all()
    plain = b"P3 # x\n2 1\n255\n1 2 3\n4 5 6"
    assert media.decode(plain).reshape(-1).tolist() == [1, 2, 3, 4, 5, 6]
    assert media.decode(b"P1\n3 1\n1 0 1").reshape(-1).tolist() == [0, 255, 0]
    assert media.decode(b"P4\n3 1\n\xa0").reshape(-1).tolist() == [0, 255, 0]
    for bad in (b"", b"P7", b"P6\n2 2\n255\nxx", b"P6\n2 2\n65535\n" + b"x" * 24, b"BM"):
        with pytest.raises((ValueError, IndexError)):
            media.decode(bad)
    for h, w in ((5, 7), (37, 23), (60, 50), (1, 1)):
        fine = np.repeat(np.repeat(image.astype(float), h, 0), w, 1).reshape(h, 37, w, 23, 3).mean((1, 3))
        assert np.allclose(media.area_resize(image, h, w), fine)
    assert np.allclose(media._integral_at(image, np.array([0, 3.5, 37]), np.array([0.0, 23]), 4), media._integral_at(image, np.array([0, 3.5, 37]), np.array([0.0, 23])))


# ---------------------------------------------------------------- 10


def test_sharding(docs, rows, empty):
    got = sharding.shard(clashing(docs), [1.0] * 5, [1.0] * 6).collect()
    assert len(got) == len(rows)
    texts = collections.defaultdict(set)
    for i, text, *_ in rows:
        texts[i].add(text)
    slots = collections.defaultdict(list)
    for r in got:
        (text,) = texts[r.doc_id]
        assert r.size == len((text or "").encode()) + 16 and r.text_crc32 == zlib.crc32((text or "").encode()) and r.law == "key"
        assert r.grown_shard in (r.shard, 5)
        slots[r.shard].append(r.slot)
    for r in got:  # the winner, one shard after another
        if r.doc_id is not None:
            scores = []
            for i in range(6):
                h = xxhash.xxh64_intdigest(b"shard", 42)
                h = xxhash.xxh64_intdigest(i.to_bytes(4, "little"), h)
                h = xxhash.xxh64_intdigest(r.doc_id.to_bytes(8, "little"), h)
                scores.append(-1 / math.log(((h >> 12) + 0.5) / (1 << 52)))
            assert r.shard == int(np.argmax(scores[:5])) and r.grown_shard == int(np.argmax(scores))
    assert set(slots) == set(range(5)) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert sharding.shard(empty, [1.0]).count() == 0
    heavy = collections.Counter(r.shard for r in sharding.shard(docs.sparkSession.range(4000).selectExpr("id doc_id", "'x' text"), [3.0, 1.0, 0.0]).collect())
    assert 2800 < heavy[0] < 3200 and heavy[2] == 0


# ---------------------------------------------------------------- very long texts


def test_very_long_texts(spark, oracle):
    """A text of over 5 MB, beyond every slice: each operator handles it whole."""
    from tokenizers import Tokenizer

    rng = random.Random(11)
    stock = [f"{rng.choice('abcdefgh')}{rng.randrange(3000)}" for _ in range(4000)]
    text = " ".join(rng.choice(stock) for _ in range(1_100_000))
    assert len(text) > 5 << 20
    docs = spark.createDataFrame([(1, text, "en", "a", 0), (2, "a short one of it all", "en", "a", 0), (3, text + "é", "en", "b", 0)], SCHEMA).repartition(2)
    ids = oracle.encode_ordinary(text)
    trip = by_id(bpe.round_trip(docs))
    assert trip[1].n_tokens == len(ids) and trip[1].ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest() and trip[1].decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()
    judged = by_id(quality.judge(docs))
    assert judged[1].n_words == 1_100_000 and judged[1].word_chars == len(text) - 1_099_999
    prints = {r.doc_id: r for r in simhash.resolve(docs).collect()}
    assert prints[1].fp & (2**64 - 1) == brute_print(text) and prints[3].component_id == 1
    library = Tokenizer.from_file(common.tokenizer_file(tokenfile.VOCABULARY))
    want = library.encode(text, add_special_tokens=False).ids + [2]
    assert by_id(tokenfile.read_files(tokenfile.write_files(docs)))[1].ids_crc32 == zlib.crc32(np.array(want, "<u4").tobytes())
    assert by_id(media.features(media.tiles(media.to_media(docs))))[1].payload_sha256 == hashlib.sha256(media.payload(text)[1]).hexdigest()
    assert by_id(sharding.shard(docs, [1.0]))[1].text_crc32 == zlib.crc32(text.encode())
    assert {r.doc_id: r.size for r in mixing.mix(docs).collect()}[1] == 1_100_000
    model = langid.fit(docs)
    assert by_id(langid.predict(docs, model))[1].lang_pred == "en"
