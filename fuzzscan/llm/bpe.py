"""Byte-level BPE encoding and decoding with a two-tier lookup: a minimal perfect hash resolves whole pre-tokens that are
in the vocabulary; misses are merged with a heap over linked bytes."""

from __future__ import annotations

import base64
import hashlib
from array import array
from collections.abc import Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame, SparkSession

from . import common, subword

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
#: A Python worker remembers the ids of so many pre-tokens of words that hold several, and of as many older ones: about 250
#: bytes each. Words that are one pre-token are remembered with the other words alone.
PIECES = 80_000
#: Words that are split into pre-tokens at once: what lies between a word and its ids takes some 500 bytes a word.
BLOCK = 1 << 15


class PerfectHash:
    """Minimal perfect hash of distinct byte strings: levels of bits in which keys that fall alone are placed, the others
    go to the next level; a key's number is the rank of its bit. Unknown keys get -1 or the number of some key."""

    def __init__(self, keys: list[bytes], load: float = 2.0):
        hashes = np.array([xxhash.xxh64_intdigest(k) for k in keys], np.uint64)
        if len(np.unique(hashes)) != len(keys):
            raise ValueError("keys are not distinct")
        self.levels: list[tuple[int, int]] = []  # offset and number of bits
        bits, offset = [], 0
        while len(hashes):
            size = max(64, int(load * len(hashes)) // 64 * 64 + 64)
            at = self._place(hashes, len(self.levels), size)
            alone = np.bincount(at, minlength=size) == 1
            bits.append(alone)
            self.levels.append((offset, size))
            offset += size
            hashes = hashes[~alone[at]]
        flat = np.concatenate(bits) if bits else np.zeros(64, bool)
        self.words = np.packbits(flat, bitorder="little").view("<u8")
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)])[:-1]

    @staticmethod
    def _place(hashes: np.ndarray, level: int, size: int) -> np.ndarray:
        x = hashes + np.uint64((0x9E3779B97F4A7C15 * (level + 1)) & (2**64 - 1))
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return ((x ^ (x >> np.uint64(31))) % np.uint64(size)).astype(np.int64)

    def number(self, keys: list[bytes]) -> np.ndarray:
        hashes = np.array([xxhash.xxh64_intdigest(k) for k in keys], np.uint64)
        out, open_ = np.full(len(keys), -1, np.int64), np.arange(len(keys))
        for level, (offset, size) in enumerate(self.levels):
            if not len(open_):
                break
            at = offset + self._place(hashes[open_], level, size)
            word, bit = self.words[at >> 6], (at & 63).astype(np.uint64)
            hit = (word >> bit) & np.uint64(1) == 1
            under = word & ((np.uint64(1) << bit) - np.uint64(1))
            out[open_[hit]] = (self.before[at >> 6] + np.bitwise_count(under))[hit]
            open_ = open_[~hit]
        return out


class Codec(subword.WordEncoder):
    """Encodes and decodes with a rank file: a line for each token, its bytes in base 64 and its rank, which is its id."""

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.find = regex.compile(pattern).findall
        self.tokens = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.tokens[rank] = token
        self.decimal = [str(i) for i in range(len(self.tokens))]
        self.bytes = [ranks[bytes([i])] for i in range(256)]
        keys = list(ranks)
        self.hash = PerfectHash(keys)
        self.slots = np.zeros(len(keys), np.int64)
        self.slots[self.hash.number(keys)] = [ranks[k] for k in keys]
        # by left id: right id and the id of the two together
        none: dict[int, int] = {}
        self.pairs: list[dict[int, int]] = [none] * len(self.tokens)
        for token, rank in ranks.items():
            for i in range(1, len(token)):
                if (a := ranks.get(token[:i])) is not None and (b := ranks.get(token[i:])) is not None:
                    if self.pairs[a] is none:
                        self.pairs[a] = {}
                    self.pairs[a][b] = rank
        self.pieces: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        super().__init__(np.dtype("<u2" if len(self.tokens) <= 1 << 16 else "<u4"))

    def merged(self, piece: bytes) -> list[int]:
        """Merges the pair of least rank, the leftmost of equals, until none is left: a heap of rank and place over a
        doubly linked list. An entry counts only if the pair at its place still has its rank."""
        ids, pairs = [self.bytes[c] for c in piece], self.pairs
        n = len(ids)
        bits = n.bit_length()
        places = (1 << bits) - 1
        ranks = [pairs[a].get(b, -1) for a, b in zip(ids, ids[1:])]
        heap = [r << bits | i for i, r in enumerate(ranks) if r >= 0]
        if not heap:
            return ids
        ranks.append(-1)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heapify(heap)
        while heap:
            top = heappop(heap)
            i, rank = top & places, top >> bits
            if ranks[i] != rank:
                continue
            j = after[i]
            k = after[i] = after[j]
            ids[i], ids[j], ranks[j] = rank, -1, -1
            if k < n:
                before[k] = i
                r = ranks[i] = pairs[rank].get(ids[k], -1)
                if r >= 0:
                    heappush(heap, r << bits | i)
            else:
                ranks[i] = -1
            p = before[i]
            if p >= 0:
                r = ranks[p] = pairs[ids[p]].get(rank, -1)
                if r >= 0:
                    heappush(heap, r << bits | p)
        return [x for x in ids if x >= 0]

    def coded(self, pieces: list[str]) -> list[bytes]:
        """The ids of these pre-tokens: whole ones from the perfect hash, the others merged."""
        raw = [p.encode() for p in pieces]
        numbers = self.hash.number(raw)
        ids = np.where(numbers >= 0, self.slots[numbers], 0).tolist()
        tokens, item = self.tokens, self.dtype.itemsize
        code = "H" if item == 2 else "I"
        return [
            i.to_bytes(item, "little") if number >= 0 and tokens[i] == key else array(code, self.merged(key)).tobytes()
            for key, number, i in zip(raw, numbers.tolist(), ids)
        ]

    def _together(self, found: list[list[str]]) -> list[bytes]:
        """The ids of each list of pre-tokens, which are remembered."""
        known = self.pieces
        new = {p for pieces in found for p in pieces if p not in known}
        if len(known) + len(new) > PIECES:
            self.older, self.pieces = known, {}
            known, new = self.pieces, {p for pieces in found for p in pieces}
        older = self.older
        known.update([(p, older[p]) for p in new if p in older])
        unknown = [p for p in new if p not in known]
        known.update(zip(unknown, self.coded(unknown)))
        return [b"".join([known[p] for p in pieces]) for pieces in found]

    def whole(self, texts: list[str]) -> list[bytes]:
        return self._together(list(map(self.find, texts)))

    def words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        ids, sizes = [], []
        for at in range(0, len(words), BLOCK):
            found = [self.find(" " + w) for w in words[at : at + BLOCK]]
            one = self.coded([f[0] for f in found if len(f) == 1])
            several = self._together([f for f in found if len(f) != 1])
            a, b = iter(one), iter(several)
            made = [next(a) if len(f) == 1 else next(b) for f in found]
            ids.append(b"".join(made))
            sizes.append(np.fromiter(map(len, made), np.int64, len(made)) // self.dtype.itemsize)
        return np.frombuffer(b"".join(ids), self.dtype), np.concatenate(sizes)

    def decode(self, ids: list[int]) -> bytes:
        tokens = self.tokens
        return b"".join([tokens[i] for i in ids])

    def listed(self, ids: list[int]) -> bytes:
        decimal = self.decimal
        return ",".join([decimal[i] for i in ids]).encode()


@lru_cache(maxsize=2)
def codec(name: str = VOCABULARY) -> Codec:
    """One for each Python worker; the file is read from the installed package on that machine."""
    import public_tokenizers

    return Codec(common.tokenizer_file(name), public_tokenizers.PATTERN)


def _lists(ids: np.ndarray, lengths: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(lengths)]), pa.int32()), pa.array(ids.astype(np.int32)))


def encode(docs: DataFrame, name: str = VOCABULARY) -> DataFrame:
    """doc_id and ids (array of int) of every document. Null and empty texts have no ids; a very long text goes through in
    spans that end where no pre-token can; of pairs of equal rank the leftmost is merged; repeated rows each get a row;
    null ids are kept; an empty table gives none; other columns are ignored."""
    ddl = "doc_id long, ids array<int>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        use = codec(name)
        for batch in batches:
            for part in common.slices(batch, "text"):
                yield pa.RecordBatch.from_arrays([part.column(0), _lists(*use.encode_arrays(part.column(1)))], names=["doc_id", "ids"])

    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(run, ddl)


def decode(encoded: DataFrame, name: str = VOCABULARY) -> DataFrame:
    """doc_id and bytes of rows of doc_id and ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        use = codec(name)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([use.decode(x or []) for x in batch.column(1).to_pylist()], pa.binary())], names=["doc_id", "bytes"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, bytes binary")


def round_trip(docs: DataFrame, name: str = VOCABULARY) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every document: encoded, and decoded from the ids, in one pass
    without a shuffle. Cases as for encode()."""
    ddl = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"

    def digests(part: pa.RecordBatch) -> pa.RecordBatch:
        use, schema, digest = codec(name), common.arrow_schema(ddl), hashlib.sha256
        flat, lengths = use.encode_arrays(part.column(1))
        stops = np.cumsum(lengths)
        each = (flat[a:b].tolist() for a, b in zip((stops - lengths).tolist(), stops.tolist()))
        made = [(len(ids), digest(use.listed(ids)).hexdigest(), digest(use.decode(ids)).hexdigest()) for ids in each]
        return pa.RecordBatch.from_arrays([part.column(0), *(pa.array(c, f.type) for c, f in zip(zip(*made), list(schema)[1:]))], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.freed(batches):
            for part in common.slices(batch, "text"):
                made = digests(part)
                common.release()
                yield made

    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(run, ddl)


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded and decoded."""
    return round_trip(common.table(spark, sf_dir, "documents"))
