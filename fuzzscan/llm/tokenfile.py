"""Token ids in binary files: a wavelet matrix per shard, succinct bit-planes with rank and select for access, counting
and occurrence lookup from one compressed file."""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common, subword

VOCABULARY, END = "byte_bpe_50k.json", 2
MAGIC = b"WVM2"
#: Bits of a plane that are compressed together; a multiple of 64.
BLOCK = 1 << 16
#: Tokens of a file; a longer document has a file of its own.
FILE_TOKENS = 1 << 20
FILES = "part int, file int, n_docs long, n_tokens long, payload binary"


class Plane:
    """n bits in compressed blocks of BLOCK bits, with the number of ones before each block. A block is unpacked when a
    question first touches it."""

    def __init__(self, n: int, blocks: list[bytes], ones: np.ndarray):
        self.n, self.blocks = n, blocks
        self.before = np.concatenate([[0], np.cumsum(ones, dtype=np.int64)])
        self._open: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    @classmethod
    def of(cls, bits: np.ndarray) -> Plane:
        raw = np.packbits(bits, bitorder="little")
        raw = np.concatenate([raw, np.zeros(-len(raw) % 8, np.uint8)])
        size, press = BLOCK // 8, zstandard.ZstdCompressor(level=1).compress
        parts = [raw[i : i + size] for i in range(0, len(raw), size)]
        return cls(len(bits), [press(x.tobytes()) for x in parts], np.array([int(np.bitwise_count(x.view("<u8")).sum()) for x in parts], np.int64))

    def block(self, b: int) -> tuple[np.ndarray, np.ndarray]:
        """64-bit words of a block and the ones before each of them, from its begin on."""
        if b not in self._open:
            words = np.append(np.frombuffer(zstandard.ZstdDecompressor().decompress(self.blocks[b]), "<u8"), np.uint64(0)) if b < len(self.blocks) else np.zeros(1, np.uint64)
            self._open[b] = words, np.concatenate([[0], np.cumsum(np.bitwise_count(words), dtype=np.int64)])
        return self._open[b]

    def bits(self) -> np.ndarray:
        """All bits, as booleans."""
        open_ = zstandard.ZstdDecompressor().decompress
        return np.unpackbits(np.frombuffer(b"".join(map(open_, self.blocks)), np.uint8), count=self.n, bitorder="little").view(bool)

    def rank1(self, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ones before each position, and the bits there (0 behind the last)."""
        ones, bits = np.zeros(len(i), np.int64), np.zeros(len(i), bool)
        for b in np.unique(i // BLOCK).tolist():
            at = np.flatnonzero(i // BLOCK == b)
            words, before = self.block(b)
            inner = i[at] - b * BLOCK
            word, bit = words[inner >> 6], (inner & 63).astype(np.uint64)
            ones[at] = self.before[b] + before[inner >> 6] + np.bitwise_count(word & ((np.uint64(1) << bit) - np.uint64(1)))
            bits[at] = (word >> bit) & np.uint64(1) == 1
        return ones, bits

    def select(self, bit: bool, j: np.ndarray) -> np.ndarray:
        """Positions of the j-th (from 0) ones or zeros."""
        sums = self.before if bit else np.arange(len(self.before)) * BLOCK - self.before
        block = np.searchsorted(sums, j, "right") - 1
        out = np.zeros(len(j), np.int64)
        for b in np.unique(block).tolist():
            at = np.flatnonzero(block == b)
            words, before = self.block(b)
            counts, left = before if bit else np.arange(len(before)) * 64 - before, j[at] - sums[b]
            w = np.searchsorted(counts, left, "right") - 1
            each = np.unpackbits((words[w] if bit else ~words[w]).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            out[at] = b * BLOCK + w * 64 + (np.cumsum(each, 1) == (left - counts[w] + 1)[:, None]).argmax(1)
        return out


class WaveletMatrix:
    """A sequence over a dense alphabet (the sorted distinct ids), its codes' bits in planes from the highest down; each
    plane's order puts the zeros of the one above before its ones."""

    def __init__(self, n: int, alphabet: np.ndarray, zeros: list[int], planes: list[Plane]):
        self.n, self.alphabet, self.zeros, self.planes = n, alphabet, zeros, planes

    @classmethod
    def build(cls, ids: np.ndarray) -> WaveletMatrix:
        table = np.zeros(int(ids.max()) + 1 if len(ids) else 1, bool)
        table[ids] = True
        alphabet = np.flatnonzero(table)
        levels = max(1, int(len(alphabet) - 1).bit_length()) if len(alphabet) else 1
        code = np.zeros(len(table), np.uint16 if levels <= 16 else np.uint32)
        code[alphabet] = np.arange(len(alphabet))
        x, zeros, planes = code[ids], [], []
        for shift in range(levels - 1, -1, -1):
            bit = ((x >> shift) & 1).astype(bool)
            planes.append(Plane.of(bit))
            low = x[~bit]
            zeros.append(len(low))
            x = np.concatenate([low, x[bit]])
        return cls(len(ids), alphabet, zeros, planes)

    def sequence(self) -> np.ndarray:
        """All ids, by undoing the planes from the lowest up: each merges the zeros and the ones back."""
        levels = len(self.planes)
        x = np.zeros(self.n, np.uint16 if levels <= 16 else np.uint32)
        for k in range(levels - 1, -1, -1):
            bit = self.planes[k].bits()
            y = np.empty_like(x)
            y[~bit], y[bit] = x[: self.zeros[k]], x[self.zeros[k] :]
            y |= bit.astype(x.dtype) << x.dtype.type(levels - 1 - k)
            x = y
        return self.alphabet[x] if self.n else np.zeros(0, np.int64)

    def access(self, at: np.ndarray | int) -> np.ndarray:
        """The ids at these positions."""
        i = np.atleast_1d(np.asarray(at, np.int64)).copy()
        if len(i) and not (0 <= i.min() and i.max() < self.n):
            raise IndexError("position out of range")
        code = np.zeros(len(i), np.int64)
        for zeros, plane in zip(self.zeros, self.planes):
            ones, bit = plane.rank1(i)
            code = code * 2 + bit
            i = np.where(bit, zeros + ones, i - ones)
        return self.alphabet[code]

    def _range(self, token: int, a: int, b: int) -> tuple[int, int, list[bool]] | None:
        code = int(np.searchsorted(self.alphabet, token))
        if code >= len(self.alphabet) or self.alphabet[code] != token:
            return None
        bits = [bool(code >> (len(self.planes) - 1 - k) & 1) for k in range(len(self.planes))]
        for k, bit in enumerate(bits):
            (x, y), _ = self.planes[k].rank1(np.array([a, b], np.int64))
            a, b = (self.zeros[k] + int(x), self.zeros[k] + int(y)) if bit else (a - int(x), b - int(y))
        return a, b, bits

    def rank(self, token: int, i: int) -> int:
        """How often the token stands before position i."""
        return self.count(token, 0, i)

    def count(self, token: int, a: int = 0, b: int | None = None) -> int:
        """How often the token stands in [a, b)."""
        found = self._range(token, max(0, a), min(self.n, self.n if b is None else b))
        return max(0, found[1] - found[0]) if found else 0

    def _up(self, i: np.ndarray, bits: list[bool]) -> np.ndarray:
        """From positions below the last plane back to positions in the sequence."""
        for k in range(len(bits) - 1, -1, -1):
            i = self.planes[k].select(bits[k], i - self.zeros[k] if bits[k] else i)
        return i

    def occurrences(self, token: int, a: int = 0, b: int | None = None) -> np.ndarray:
        """All positions of the token in [a, b), ascending."""
        found = self._range(token, max(0, a), min(self.n, self.n if b is None else b))
        return self._up(np.arange(found[0], max(found[:2])), found[2]) if found else np.zeros(0, np.int64)

    def select(self, token: int, j: int) -> int:
        """Position of the token's occurrence number j, from 0."""
        found = self._range(token, 0, self.n)
        if not found or not 0 <= j < found[1] - found[0]:
            raise IndexError("no such occurrence")
        return int(self._up(np.array([found[0] + j]), found[2])[0])


def pack(doc_ids: list[int | None], lengths: np.ndarray, ids: np.ndarray) -> bytes:
    """The file: magic, length of a JSON header, header, then the sections it lists, each compressed (ids of the documents,
    which of them are null, their token counts, the alphabet, compressed sizes and ones of the planes' blocks, plane by
    plane), then those blocks."""
    matrix = WaveletMatrix.build(ids)
    press = zstandard.ZstdCompressor(level=1).compress
    sections = [np.array([x or 0 for x in doc_ids], "<i8"), np.array([x is None for x in doc_ids], bool), np.asarray(lengths, "<i8"), matrix.alphabet.astype("<u4")]
    sections.append(np.array([len(b) for p in matrix.planes for b in p.blocks], "<u4"))
    sections.append(np.concatenate([np.diff(p.before) for p in matrix.planes]).astype("<u4"))
    packed = [press(s.tobytes()) for s in sections]
    header = json.dumps({"tokens": matrix.n, "docs": len(doc_ids), "zeros": matrix.zeros, "sections": [len(p) for p in packed]}).encode()
    return b"".join([MAGIC, len(header).to_bytes(4, "little"), header, *packed, *(b for p in matrix.planes for b in p.blocks)])


class TokenFile:
    """One such file, from its bytes. Questions to `matrix` unpack the blocks they touch, no whole planes."""

    def __init__(self, data: bytes):
        if data[:4] != MAGIC:
            raise ValueError("not a token file")
        at = 8 + int.from_bytes(data[4:8], "little")
        header, parts = json.loads(data[8:at]), []
        open_ = zstandard.ZstdDecompressor().decompress
        for n in header["sections"]:
            parts.append(open_(data[at : at + n]))
            at += n
        null = np.frombuffer(parts[1], bool)
        self.doc_ids = [None if gone else i for i, gone in zip(np.frombuffer(parts[0], "<i8").tolist(), null.tolist())]
        self.lengths = np.frombuffer(parts[2], "<i8")
        self.starts = np.cumsum(self.lengths) - self.lengths
        stops = at + np.cumsum(np.frombuffer(parts[4], "<u4"), dtype=np.int64)
        blocks = [data[a:b] for a, b in zip([at, *stops[:-1].tolist()], stops.tolist())]
        ones, each = np.frombuffer(parts[5], "<u4"), len(blocks) // len(header["zeros"])
        planes = [Plane(header["tokens"], blocks[k : k + each], ones[k : k + each]) for k in range(0, len(blocks), each)] if each else [Plane(0, [], ones)]
        self.matrix = WaveletMatrix(header["tokens"], np.frombuffer(parts[3], "<u4"), header["zeros"], planes)


def encode(docs: DataFrame, name: str = VOCABULARY, end: int = END) -> DataFrame:
    """doc_id and ids (bytes of little-endian unsigned 16-bit, or 32-bit for a larger vocabulary) with the end id."""
    ddl = "doc_id long, ids binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        use = subword.subwords(name)
        for batch in batches:
            for part in common.slices(batch, "text", 16 << 20):
                yield pa.RecordBatch.from_arrays([part.column(0), use.encode_binary(part.column(1), end)], schema=common.arrow_schema(ddl))

    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(run, ddl)


def write_files(docs: DataFrame, name: str = VOCABULARY, end: int = END, tokens: int = FILE_TOKENS, partitions: int | None = None) -> DataFrame:
    """The documents in ascending doc_id order as token files, null ids last, repeated ids by their tokens. Each row of the
    table is a file: part (its range of ids), file (its number in the part), counts and payload. Files are rows of a
    table in the shared folder because executors share no local folders and a store may be open to Spark's writers only;
    Spark's commit keeps or drops a file as a whole when an executor is lost. `TokenFile(payload)` opens one.

    Null and empty texts are a document of the end id alone; a very long text is a file of its own; rows with equal ids are
    all kept, in the order of their tokens; an empty table gives no files; other columns are ignored."""
    width = "<u2" if subword.subwords(name).size <= 1 << 16 else "<u4"
    parts = partitions or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    encoded = common.written(encode(docs, name, end), "encoded")
    placed = encoded.repartitionByRange(parts, F.col("doc_id").asc_nulls_last()).sortWithinPartitions(F.col("doc_id").asc_nulls_last(), "ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number, keys, held, size = TaskContext.get().partitionId(), 0, [], [], 0
        item = np.dtype(width).itemsize

        def flush() -> pa.RecordBatch:
            lengths = np.array([len(x) // item for x in held], np.int64)
            made = [part, number, len(keys), int(lengths.sum()), pack(keys, lengths, np.frombuffer(b"".join(held), width))]
            return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(made, common.arrow_schema(FILES))], schema=common.arrow_schema(FILES))

        for batch in batches:
            for key, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if held and size + len(ids) // item > tokens:
                    yield flush()
                    number, keys, held, size = number + 1, [], [], 0
                keys.append(key)
                held.append(ids)
                size += len(ids) // item
        if held:
            yield flush()

    return common.written(placed.mapInArrow(run, FILES), "tokenfiles")


def read_files(files: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document, from the files. Starts are sums inside a file, of the
    files before it in its part and of the parts before; the driver sees one number for each part."""
    ddl = "part int, file int, doc_id long, at long, n_tokens long, ids_crc32 long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = common.arrow_schema(ddl)
        for batch in batches:
            for k in range(batch.num_rows):
                part, number, data = (batch.column(i)[k].as_py() for i in range(3))
                opened = TokenFile(data)
                raw = memoryview(opened.matrix.sequence().astype("<u4").tobytes())
                crc = [zlib.crc32(raw[4 * a : 4 * (a + n)]) for a, n in zip(opened.starts.tolist(), opened.lengths.tolist())]
                n = len(crc)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, part, np.int32)), pa.array(np.full(n, number, np.int32)), pa.array(opened.doc_ids, pa.int64()), pa.array(opened.starts), pa.array(opened.lengths), pa.array(crc, pa.int64())], schema=schema)

    offset, pairs = 0, []
    for part, n in sorted((r[0], r[1]) for r in files.groupBy("part").agg(F.sum("n_tokens")).collect()):
        pairs.append((part, offset))
        offset += n
    parts = files.sparkSession.createDataFrame(pairs, "part int, part_start long")
    ahead = Window.partitionBy("part").orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    starts = files.select("part", "file", F.coalesce(F.sum("n_tokens").over(ahead), F.lit(0)).alias("file_start"))
    starts = starts.join(parts, "part").select("part", "file", (F.col("file_start") + F.col("part_start")).alias("start"))
    found = files.select("part", "file", "payload").mapInArrow(run, ddl)
    return found.join(starts, ["part", "file"]).select("doc_id", (F.col("start") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def op8_tokenfile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's ids written as wavelet files in doc_id order and read back."""
    return read_files(write_files(common.table(spark, sf_dir, "documents")))
