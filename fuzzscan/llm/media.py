"""Media columns: Netpbm and BMP pictures decoded to numpy arrays, area-resized by integral images, written as NPY tiles
with difference hashes."""

from __future__ import annotations

import hashlib
import io
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Header of a Netpbm picture: kind, then fields between white space and comments.
_FIELD = re.compile(rb"(?:\s|#[^\n]*\n)*([0-9]+)")
MEDIA = "doc_id long, n_bytes long, media binary"
TILES = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, width int, height int, dhash string, npy binary"


def decode_netpbm(data: bytes) -> np.ndarray:
    """P1 to P6 to a (height, width, channels) uint8 array; bitmaps become 0 (ink) and 255. Samples must fit 8 bits."""
    kind, at, fields = data[:2], 2, []
    if not re.fullmatch(rb"P[1-6]", kind):
        raise ValueError("not a Netpbm picture")
    bitmap = kind in (b"P1", b"P4")
    while len(fields) < (2 if bitmap else 3):
        m = _FIELD.match(data, at)
        if not m:
            raise ValueError("broken Netpbm header")
        fields.append(int(m[1]))
        at = m.end()
    width, height, most = fields[0], fields[1], 1 if bitmap else fields[2]
    if not 0 < most < 256:
        raise ValueError("only 8-bit samples are supported")
    depth = 3 if kind in (b"P3", b"P6") else 1
    n = width * height * depth
    if kind in (b"P5", b"P6"):
        flat = np.frombuffer(data, np.uint8, n, at + 1)
    elif kind == b"P4":
        row = -(-width // 8)
        bits = np.unpackbits(np.frombuffer(data, np.uint8, row * height, at + 1).reshape(height, row), axis=1)
        flat = bits[:, :width].reshape(-1)
    elif kind == b"P1":
        digits = np.frombuffer(re.sub(rb"#[^\n]*\n", b"", data[at:]), np.uint8)
        flat = digits[(digits == 48) | (digits == 49)][:n] - 48
    else:
        flat = np.array(re.sub(rb"#[^\n]*\n", b"", data[at:]).split()[:n], np.int64).astype(np.uint8)
    if flat.size != n:
        raise ValueError("truncated Netpbm picture")
    if bitmap:
        flat = ((1 - flat) * 255).astype(np.uint8)
    return flat.reshape(height, width, depth)


def encode_netpbm(samples: bytes, width: int, depth: int = 3) -> bytes:
    """Binary P6 (depth 3) or P5 (depth 1) of 8-bit samples; their number must be a multiple of a row's."""
    height, rest = divmod(len(samples), width * depth)
    if rest:
        raise ValueError("samples do not fill the last row")
    return b"P%d\n%d %d\n255\n" % (6 if depth == 3 else 5, width, height) + samples


def decode_bmp(data: bytes) -> np.ndarray:
    """Uncompressed BMP of 8 (palette), 24 or 32 bits to a (height, width, 3) RGB array; either row order."""
    if data[:2] != b"BM":
        raise ValueError("not a BMP picture")
    word = lambda at, n, signed=False: int.from_bytes(data[at : at + n], "little", signed=signed)
    start, header = word(10, 4), word(14, 4)
    width, height, bits, packing = word(18, 4, True), word(22, 4, True), word(28, 2), word(30, 4)
    if packing not in (0, 3) or bits not in (8, 24, 32) or width <= 0:
        raise ValueError("unsupported BMP picture")
    row, rows = -(-width * bits // 32) * 4, abs(height)
    grid = np.frombuffer(data, np.uint8, row * rows, start).reshape(rows, row)[:, : width * bits // 8]
    if height > 0:
        grid = grid[::-1]
    if bits == 8:
        colours = (word(46, 4) or 256) if header >= 40 else 256
        palette = np.frombuffer(data, np.uint8, colours * 4, 14 + header).reshape(-1, 4)
        return palette[grid][:, :, 2::-1]
    return grid.reshape(rows, width, bits // 8)[:, :, 2::-1]


def encode_bmp(samples: bytes, width: int) -> bytes:
    """24-bit BMP, top row last, of RGB samples."""
    grid = np.frombuffer(samples, np.uint8).reshape(-1, width, 3)
    row = -(-width * 3 // 4) * 4
    body = np.zeros((grid.shape[0], row), np.uint8)
    body[:, : width * 3] = grid[::-1, :, ::-1].reshape(grid.shape[0], -1)
    numbers = lambda *x: b"".join(v.to_bytes(n, "little", signed=v < 0) for v, n in x)
    head = b"BM" + numbers((54 + body.size, 4), (0, 4), (54, 4), (40, 4), (width, 4), (grid.shape[0], 4), (1, 2), (24, 2), (0, 4), (body.size, 4), (2835, 4), (2835, 4), (0, 4), (0, 4))
    return head + body.tobytes()


def decode(data: bytes) -> np.ndarray:
    return decode_bmp(data) if data[:2] == b"BM" else decode_netpbm(data)


def _integral_at(image: np.ndarray, ys: np.ndarray, xs: np.ndarray, block: int = 4096) -> np.ndarray:
    """The integral image at fractional corners (ys x xs), in blocks of rows, so that memory does not grow with height.
    Between whole corners the integral of a picture of constant pixels is bilinear, so interpolation is exact."""
    height, width, depth = image.shape
    out, done = np.zeros((len(ys), width + 1, depth)), np.zeros((width, depth))
    whole = np.minimum(ys.astype(np.int64), height)
    for at in range(0, height, block):
        part = image[at : at + block]
        sums = np.concatenate([np.zeros((1, width, depth), np.int64), np.cumsum(part, 0, dtype=np.int64)])
        here = np.flatnonzero((whole >= at) & ((whole < at + block) | (at + block >= height)))
        k = whole[here] - at
        frac = (ys[here] - whole[here])[:, None, None]
        out[here, 1:] = done + sums[k] + frac * part[np.minimum(k, len(part) - 1)]
        done = done + sums[-1]
    table = np.cumsum(out, 1)
    left = np.minimum(xs.astype(np.int64), width)
    frac = (xs - left)[None, :, None]
    return table[:, left] * (1 - frac) + table[:, np.minimum(left + 1, width)] * frac


def area_resize(image: np.ndarray, height: int, width: int) -> np.ndarray:
    """Mean of the area that each output pixel covers, as floats (height, width, channels); also enlarges."""
    h, w = image.shape[:2]
    ys, xs = np.arange(height + 1) * (h / height), np.arange(width + 1) * (w / width)
    ys[-1], xs[-1] = h, w
    corners = _integral_at(image, ys, xs)
    total = corners[1:, 1:] - corners[:-1, 1:] - corners[1:, :-1] + corners[:-1, :-1]
    return total / ((h / height) * (w / width))


def difference_hash(image: np.ndarray) -> str:
    """64 bits in hex: whether each of 8 x 9 mean grey values is below its right neighbour. Means are rounded to 1e-6,
    so that equal areas compare equal."""
    grey = np.round(area_resize(image, 8, 9).mean(2), 6)
    return np.packbits(grey[:, :-1] < grey[:, 1:]).tobytes().hex()


def npy_tile(image: np.ndarray, side: int = 16) -> bytes:
    """The picture as a side x side uint8 tile in NPY format."""
    tile = np.clip(np.rint(np.round(area_resize(image, side, side), 6)), 0, 255).astype(np.uint8)
    out = io.BytesIO()
    np.save(out, tile, allow_pickle=False)
    return out.getvalue()


def payload(text: str | None) -> tuple[int, bytes]:
    """UTF-8 bytes of the text (null: none) and those bytes filled with spaces to a positive multiple of 192."""
    raw = (text or "").encode()
    return len(raw), raw + b" " * ((-len(raw)) % 192 if raw else 192)


def to_media(docs: DataFrame, width: int = 64, kind: str = "ppm") -> DataFrame:
    """doc_id and the text stored as a picture: column `media` holds the bytes of a PPM or BMP file.

    Null and empty texts give one row of spaces; a very long text is one tall picture, resized in blocks of its rows; equal
    texts give equal pictures; repeated rows and null ids are kept, one output row for each input row; an empty table gives none; columns other than doc_id and text are ignored, whatever their names."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = common.arrow_schema(MEDIA)
        for batch in batches:
            for part in common.slices(batch, "text"):
                made = [payload(t) for t in common.texts(part)]
                media = [encode_bmp(p, width) if kind == "bmp" else encode_netpbm(p, width) for _, p in made]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([n for n, _ in made], pa.int64()), pa.array(media, pa.binary())], schema=schema)

    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(run, MEDIA)


def tiles(media: DataFrame, tile_side: int = 8) -> DataFrame:
    """Decodes the stored pictures: payload, file, difference hash and the bytes of the picture's NPY tile."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = common.arrow_schema(TILES)
        for batch in common.freed(batches):
            for part in common.slices(batch, "media"):
                rows = []
                for key, n, data in zip(*(c.to_pylist() for c in part.columns)):
                    image = decode(data)
                    stored = image.tobytes()
                    rows.append((key, n, len(stored), hashlib.sha256(stored).hexdigest(), zlib.crc32(stored[-16:]), len(data), hashlib.sha256(data).hexdigest(), image.shape[1], image.shape[0], difference_hash(image), npy_tile(image, tile_side)))
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    return media.select("doc_id", "n_bytes", "media").mapInArrow(run, TILES)


def features(tiled: DataFrame) -> DataFrame:
    """The rows of a table of tiles; `feature` is the difference hash and the CRC-32 of the tile's file as it was stored."""
    crc = F.lower(F.lpad(F.hex(F.crc32("npy")), 8, "0"))
    named = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256"]
    return tiled.select(*named, F.concat_ws(":", "dhash", crc).alias("feature"), "width", "height", F.octet_length("npy").alias("tile_bytes"))


def op9_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's text stored as a PPM file in a table of the shared folder, read back and decoded; its NPY tile is
    stored there too, with its difference hash, and read back."""
    stored = common.written(to_media(common.table(spark, sf_dir, "documents")), "media")
    return features(common.written(tiles(stored), "tiles"))
