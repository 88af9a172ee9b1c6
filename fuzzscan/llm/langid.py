"""Language identification: normalised TF-IDF n-gram vectors against several clustered centroids of each language by
cosine, with rejection by distance."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Hash buckets of byte 3-grams.
DIMS = 4096
#: The classifier is fitted on at most about so many labelled documents, an equal number for each language; the
#: document frequencies are those of all labelled training documents.
SAMPLE = 2048
CENTROIDS = 4
#: Documents in a dense block of vectors.
BLOCK = 512
#: A document is rejected if its cosine is below MARGIN times the LOW quantile of those of sampled documents of its length
#: or more, so that a few odd ones among them don't move the limit. Below SHORT grams, where a cosine says little, the
#: limit falls in proportion to the length.
MARGIN, LOW, SHORT = 0.5, 0.01, 64
_LETTER = regex.compile(r"\p{L}")
#: Letters and bytes of longer characters stay; the rest becomes a space.
_KEEP = bytes(c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
RESULT = "doc_id long, lang_pred string, score double, rejected boolean"


def counts(texts: list[str | None]) -> np.ndarray:
    """Rows of 3-gram counts (float32, DIMS). Grams whose middle is a space are left out, so runs of other characters
    weigh nothing."""
    parts = [b"  " + (t or "").lower().encode().translate(_KEEP) + b"  " for t in texts]
    flat = np.frombuffer(b"".join(parts), np.uint8)
    owner = np.repeat(np.arange(len(parts), dtype=np.int64), [len(p) for p in parts])
    a = flat.astype(np.uint32)
    grams = a[:-2] | (a[1:-1] << np.uint32(8)) | (a[2:] << np.uint32(16))
    slot = (grams * np.uint32(2654435761)) >> np.uint32(20)
    keep = flat[1:-1] != 32
    key = owner[1:-1][keep] * DIMS + slot[keep]
    return np.bincount(key, minlength=len(parts) * DIMS).reshape(len(parts), DIMS).astype(np.float32)


def normalised(x: np.ndarray, idf: np.ndarray) -> np.ndarray:
    np.log1p(x, out=x)
    x *= idf
    norm = np.sqrt(np.einsum("ij,ij->i", x, x))
    x /= np.maximum(norm, 1e-12)[:, None]
    return x


def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[str | None]]]:
    for batch in batches:
        for at in range(0, batch.num_rows, BLOCK):
            for part in common.slices(batch.slice(at, BLOCK), "text", 1 << 20):
                yield part, common.texts(part)


@dataclass
class Model:
    """Centroids (rows of unit length), the language of each, weights, and the low cosine by log2 of gram counts."""

    langs: list[str]
    owner: np.ndarray
    centroids: np.ndarray
    idf: np.ndarray
    floor: np.ndarray

    def predict(self, texts: list[str | None]) -> list[tuple[str, float, bool]]:
        lettered = [t is not None and _LETTER.search(t) is not None for t in texts]
        if not self.langs:
            return [("und", 0.0, True) for _ in texts]
        x = counts(texts)
        grams = x.sum(1)
        size = np.log2(np.maximum(grams, 1)).astype(np.int64)
        close = normalised(x, self.idf) @ self.centroids.T
        best = close.argmax(1)
        score = np.clip(close[np.arange(len(texts)), best], 0, 1).astype(float)
        far = score < MARGIN * self.floor[np.minimum(size, len(self.floor) - 1)] * np.minimum(1, grams / SHORT)
        return [(self.langs[self.owner[b]], float(s), bool(f)) if ok else ("und", 0.0, True) for ok, b, s, f in zip(lettered, best, score, far)]


def cluster(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Spherical k-means from farthest-first seeds; rows of x have unit length. Deterministic."""
    seeds, near = [0], x @ x[0]
    while len(seeds) < min(k, len(x)):
        seeds.append(int(near.argmin()))
        near = np.maximum(near, x @ x[seeds[-1]])
    c = x[seeds].copy()
    for _ in range(rounds):
        own = (x @ c.T).argmax(1)
        for j in range(len(c)):
            if (own == j).any():
                c[j] = x[own == j].sum(0)
                c[j] /= max(np.linalg.norm(c[j]), 1e-12)
    return c


def fit(docs: DataFrame, sample: int = SAMPLE, centroids: int = CENTROIDS) -> Model:
    """Learns from the non-null texts and langs of docs (text, lang, doc_id). One pass counts the document frequencies
    of all rows, one vectorises the sample; what reaches the driver is DIMS sums, a count for each language and about
    `sample` vectors, but one for each language at least (8 KB there, and up to `centroids` times 16 KB in the model that
    every worker gets). Documents are sampled by a hash of id and text, so reruns agree."""
    known = docs.where("text is not null and lang is not null")

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(DIMS + 1, np.int64)
        for part, texts in blocks(batches):
            total[:DIMS] += (counts(texts) > 0).sum(0)
            total[DIMS] += len(texts)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(DIMS + 1), pa.int32()), pa.array(total)], schema=common.arrow_schema("slot int, n long"))

    seen = np.zeros(DIMS + 1)
    for r in known.select("text").mapInArrow(frequencies, "slot int, n long").groupBy("slot").agg(F.sum("n").alias("n")).collect():
        seen[r.slot] = r.n
    idf = (np.log((1 + seen[DIMS]) / (1 + seen[:DIMS])) + 1).astype(np.float32)
    place = F.pmod(F.xxhash64(F.lit("sample"), "doc_id", F.crc32(F.encode("text", "UTF-8"))), F.lit(1 << 40))
    per_lang = known.groupBy("lang").agg(F.count("*").alias("n"), F.min(place).alias("least")).collect()
    if not per_lang:
        return Model([], np.zeros(0, int), np.zeros((0, DIMS), np.float32), idf, np.zeros(1))
    share = max(1, sample // len(per_lang))
    # the row with the least hash is taken whatever the share, so no language is lost
    limits = docs.sparkSession.createDataFrame([(r.lang, max(int(min(1.0, share / r.n) * (1 << 40)), r.least + 1)) for r in per_lang], "lang string, __limit long")

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in blocks(batches):
            x = counts(texts)
            yield pa.RecordBatch.from_arrays([part.column(1), pa.array(x.sum(1).astype(np.int64)), pa.array([v.tobytes() for v in np.log1p(x).astype(np.float16)], pa.binary())], schema=common.arrow_schema("lang string, n long, v binary"))

    rows = sorted(known.join(F.broadcast(limits), "lang").where(place < F.col("__limit")).select("text", "lang").mapInArrow(vectors, "lang string, n long, v binary").collect(), key=lambda r: (r.lang, bytes(r.v)))
    x = np.array([np.frombuffer(r.v, np.float16) for r in rows]).astype(np.float32) * idf
    x /= np.maximum(np.linalg.norm(x, axis=1), 1e-12)[:, None]
    names = np.array([r.lang for r in rows])
    langs = sorted(set(names.tolist()))
    made = [cluster(x[names == k], centroids) for k in langs]
    c = np.concatenate(made)
    best = (x @ c.T).max(1)
    size = np.log2(np.maximum([r.n for r in rows], 1)).astype(np.int64)
    # by log2 of a document's grams, over sampled documents that are at least as long
    floor = np.array([np.quantile(best[size >= min(k, size.max())], LOW) for k in range(40)])
    return Model(langs, np.repeat(np.arange(len(langs)), [len(m) for m in made]), c, idf, floor)


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score (cosine of the best centroid) and rejected of every document, from its text alone.

    Null texts and texts without a letter are `und`, score 0, and rejected. A very long text is one vector, whole. Repeated
    rows each get a row; ties go to the first language by name; null ids are kept; an empty table gives none; other columns are ignored. Without any
    labelled document all are `und`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = common.arrow_schema(RESULT)
        for part, texts in blocks(batches):
            made = model.predict(texts)
            yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(c, f.type) for c, f in zip(zip(*made), list(schema)[1:]))], schema=schema)

    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(run, RESULT)


def keep(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of docs, with all columns, that are not rejected."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in blocks(batches):
            yield part.filter(pa.array([not far for _, _, far in model.predict(texts)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def held_out() -> Column:
    """True where crc32(doc_id as text) mod 4 is 2 (null ids: false)."""
    return F.coalesce(F.crc32(F.encode(F.col("doc_id").cast("string"), "UTF-8")) % 4 == 2, F.lit(False))


def op6_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learned from the documents that are not held out."""
    docs = common.table(spark, sf_dir, "documents")
    model = fit(docs.where(~held_out()))
    return predict(docs, model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "rejected")
