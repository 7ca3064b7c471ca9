"""Language identification by hyperdimensional profiles (operator 7).

Every letter has a random vector of +1 and -1.  A trigram's vector is the
product of its letters' vectors, the first rotated twice and the second once;
a text's vector is the sum over its trigrams, a language's prototype the sum of
its labelled texts' unit vectors.  A text gets the language of greatest cosine.

Scale.  Scoring is one narrow scan: a chunk's trigram counts times its trigram
vectors is one matrix product.  Prototypes come from at most
``max_docs_per_lang`` documents of each language, those of least hash: counts
by language give a bound of the hash that somewhat more than so many lie under,
and only those are ranked.  At most ``MAX_LANGUAGES`` languages, the most
frequent ones, have a prototype; only prototypes are broadcast (languages x
dimensions).

Defined cases: texts without a letter, NULL included, get language NULL and
cosine NULL; very long texts are used whole; a NULL declared language trains
nothing; ties go to the language first in the alphabet; rows that repeat each
get their own answer; an empty table gives no row; other columns are left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from quern.llm import kernels as K
from quern.llm.common import col, small_batches
from quern.session import cut

DIMENSIONS = 1024
MAX_DOCS_PER_LANG = 1500
MAX_LANGUAGES = 8192
SEED = 7
_BLOCK = 4096


def letter_vectors(points: np.ndarray, dimensions: int, seed: int = SEED) -> np.ndarray:
    """Rows of +1 and -1 for code points; the blank (0) has one too."""
    lanes = dimensions // 64
    keys = K.mix64(points.astype(np.uint64)[:, None] * np.uint64(0x9E3779B97F4A7C15) + K.mix64(np.arange(1, lanes + 1, dtype=np.uint64) + np.uint64(seed << 16))[None, :])
    bits = np.unpackbits(keys.view(np.uint8).reshape(len(points), -1), axis=1)
    return bits.astype(np.float32) * 2 - 1


def _letters(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(code points with 0 for anything but a letter, row) of a chunk; every row is closed by a blank."""
    lead = (data & 0xC0) != 0x80
    points = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[lead]
    letter = ((points >= 97) & (points <= 122)) | ((points >= 0xC0) & (points != 0xD7) & (points != 0xF7) & ~((points >= 0x2000) & (points <= 0x2FFF)) & (points != 0xFFFD))
    return np.where(letter, points, 0).astype(np.int64), row


def text_vectors(data: np.ndarray, offsets: np.ndarray, dimensions: int, seed: int = SEED) -> np.ndarray:
    """rows x dimensions sums of trigram vectors."""
    rows = len(offsets) - 1
    out = np.zeros((rows, dimensions), np.float32)
    points, row = _letters(data, offsets)
    if not len(points):
        return out
    edge = np.ones(len(points), bool)
    edge[1:] = row[1:] != row[:-1]
    keep = (points != 0) | edge  # a blank stays where it separates
    keep[1:] |= (points[1:] == 0) & (points[:-1] != 0)
    points, row = points[keep], row[keep]
    if len(points) < 3:
        return out
    alphabet = np.flatnonzero(np.bincount(points)) if points.max() < 1 << 21 else np.unique(points)
    code = np.searchsorted(alphabet, points)
    size = len(alphabet)
    tri = (code[:-2] * size + code[1:-1]) * size + code[2:]
    ok = (row[:-2] == row[2:]) & ~((points[:-2] == 0) & (points[1:-1] == 0)) & ~((points[1:-1] == 0) & (points[2:] == 0))
    tri, owner = tri[ok], row[:-2][ok]
    if not len(tri):
        return out
    if size <= 160:
        seen = np.flatnonzero(np.bincount(tri, minlength=size**3))
        lut = np.zeros(size**3, np.int32)
        lut[seen] = np.arange(len(seen))
        ident = lut[tri]
    else:
        seen, ident = np.unique(tri, return_inverse=True)
    base = letter_vectors(alphabet, dimensions, seed)
    once, twice = np.roll(base, 1, axis=1), np.roll(base, 2, axis=1)
    for lo in range(0, len(seen), _BLOCK):
        part = seen[lo : lo + _BLOCK]
        vectors = twice[part // (size * size)] * once[part // size % size]
        vectors *= base[part % size]
        mine = (ident >= lo) & (ident < lo + _BLOCK) if len(seen) > _BLOCK else slice(None)
        flat = owner[mine] * len(part) + (ident[mine] - lo)
        counts = np.bincount(flat, minlength=rows * len(part)).reshape(rows, len(part)).astype(np.float32)
        out += counts @ vectors
    return out


def _bundle(dimensions: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            langs = batch.column(0).to_pylist()
            data, off = K.utf8_view(batch.column(1))
            for lo, hi in K.chunks(off, K.CHUNK_BYTES // 2):
                v = text_vectors(data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo], dimensions, seed)
                v /= np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)
                for i, lang in enumerate(langs[lo:hi]):
                    sums[lang] = sums.get(lang, 0) + v[i].astype(np.float64)
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums)), pa.array([s.tolist() for s in sums.values()], pa.list_(pa.float64()))], ["lang", "v"])

    return run


def prototypes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", max_docs_per_lang: int = MAX_DOCS_PER_LANG, dimensions: int = DIMENSIONS, seed: int = SEED) -> dict[str, np.ndarray]:
    """Unit prototype of each declared language."""
    own = small_batches(docs).where(col(doc_id).isNotNull() & col(lang).isNotNull()).select(col(doc_id).alias("_id"), col(lang).cast("string").alias("lang"), F.lower(col(text).cast("string")).alias("text"))
    counts = own.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(MAX_LANGUAGES)
    most = max_docs_per_lang + 6 * max_docs_per_lang**0.5 + 6  # so that fewer than wanted lie under it once in a billion
    under = cut(counts.select("lang", F.least(F.lit(1.0), F.lit(most) / F.col("n")).alias("share")))  # at most MAX_LANGUAGES rows
    space = float(1 << 62)
    hashed = own.withColumn("_hash", F.shiftrightunsigned(F.xxhash64("_id"), 2))
    near = hashed.join(F.broadcast(under), "lang").where(F.col("_hash") < F.col("share") * space)
    rank = F.row_number().over(W.partitionBy("lang").orderBy("_hash", "_id"))
    sample = cut(near.withColumn("_rank", rank).where(F.col("_rank") <= max_docs_per_lang).select("lang", "text"))
    parts = sample.coalesce(8).mapInArrow(_bundle(dimensions, seed), "lang string, v array<double>").collect()
    sums: dict[str, np.ndarray] = {}
    for r in parts:
        sums[r["lang"]] = sums.get(r["lang"], 0) + np.array(r["v"])
    return {k: (v / max(np.linalg.norm(v), 1e-12)).astype(np.float32) for k, v in sorted(sums.items())}


def identify(docs: DataFrame, profiles: dict[str, np.ndarray], doc_id: str = "doc_id", text: str = "text", lang: str = "lang", seed: int = SEED) -> DataFrame:
    """(doc_id, lang, language, cosine, margin); margin is the lead over the second language."""
    names = list(profiles)
    matrix = np.stack([profiles[n] for n in names], axis=1) if names else np.zeros((DIMENSIONS, 0), np.float32)
    shared = docs.sparkSession.sparkContext.broadcast((names, matrix))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, matrix = shared.value
        dimensions = len(matrix)
        for batch in batches:
            data, off = K.utf8_view(batch.column(2))
            best, first, lead = np.full(batch.num_rows, -1), np.zeros(batch.num_rows), np.zeros(batch.num_rows)
            for lo, hi in K.chunks(off, K.CHUNK_BYTES // 2):
                if not names:
                    break
                v = text_vectors(data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo], dimensions, seed)
                norm = np.linalg.norm(v, axis=1)
                cos = v @ matrix / np.maximum(norm, 1e-12)[:, None]
                top = cos.argmax(axis=1)
                line = np.arange(hi - lo)
                best[lo:hi] = np.where(norm > 0, top, -1)
                first[lo:hi] = cos[line, top]
                cos[line, top] = -2
                lead[lo:hi] = first[lo:hi] - (cos.max(axis=1) if len(names) > 1 else 0)
            gone = best < 0
            language = pa.array([names[b] if b >= 0 else None for b in best.tolist()], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), language, pa.array(np.round(first, 4), mask=gone), pa.array(np.round(lead, 4), mask=gone)], ["doc_id", "lang", "language", "cosine", "margin"])

    own = docs.select(col(doc_id).alias("doc_id"), col(lang).cast("string").alias("lang"), F.lower(col(text).cast("string")).alias("text"))
    return own.mapInArrow(run, f"doc_id {own.schema['doc_id'].dataType.simpleString()}, lang string, language string, cosine double, margin double")


def language_id(docs: DataFrame, **names) -> DataFrame:
    return identify(docs, prototypes(docs, **names))
