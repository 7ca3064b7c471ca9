"""Substring dedup by paragraph MinHash banding (operator 2).

A paragraph is a line of at least ``min_words`` words, or all the shorter lines
between two such, so every word of a text lies in one; under ``min_words`` words
it is too little to be a passage (what stands in it is compared all the same,
across its lines, by ``passages``).  Equal paragraphs share a content hash.
Minwise values of their word triples form ``bands`` x ``rows`` keys, so that
paragraphs of similarity J collide with chance 1 - (1 - J**rows)**bands (0.967
at 0.6 and 0.997 at 0.7 as set).  Colliding paragraphs are compared by the exact
Jaccard similarity of their triples, breadth first within a bucket, which
connects what a comparison of all pairs would connect.  Connected components are
the clusters; the first occurrence stays, the others go.

Scale.  Band keys move as 16 bytes each, in one shuffle, packed many to a row
(``common.pack``) and sorted where they arrive; buckets with the same members
count once, so a near copy that collides in every band is compared once.
Triples are taken again from the text for colliding paragraphs only: executors
pack their hashes into 8 MB of bits, which go to the scan as a broadcast while
the hashes number at most ``MAX_BROADCAST_HASHES`` (what else shares a bit is
dropped by the join to the buckets); beyond it the triples are joined by
shuffle.  The hashes themselves never come to the driver.  A bucket of more than
``BUCKET`` members (a template's) is cut into parts, and each two parts are
compared in a place of their own, so no task holds it whole.  Occurrences are
taken from the texts once and kept in the shared folder, as the result reads
them three times.

Defined cases: NULL and empty texts and rows without an id have no paragraph;
an id's repeated rows count as repeats of each other; ties go to the least
(doc_id, paragraph); ids keep their type; very long texts are used whole; an
empty table gives no row; other columns are left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm import kernels as K
from quern.llm.common import PACKED, cells, col, gathered, has_bit, hash_bits, numbered, pack, small_batches, unpack
from quern.operators.components import connected_components
from quern.session import cut, drop_dead

MIN_WORDS = 20
SHINGLE = 3
SIMILAR = 0.6
BANDS = 14
ROWS = 3
SEED = 977
BUCKET = 4096
MAX_BROADCAST_HASHES = 8_000_000
HASH_BITS = 26


def _paragraphs(part: np.ndarray, offsets: np.ndarray, min_words: int):
    """(document row, number of the first line, words, word hashes, owner of each word) of the paragraphs with enough words."""
    breaks = np.flatnonzero(part == 10) + 1
    edges = np.union1d(offsets, breaks)
    doc = np.searchsorted(offsets, edges[:-1], side="right") - 1
    first = np.searchsorted(doc, np.arange(len(offsets) - 1))
    number = np.arange(len(doc)) - first[doc]
    start, end, row = K.words(part, edges)
    long = np.bincount(row, minlength=len(doc)) >= min_words
    head = long | (number == 0)
    head[1:] |= long[:-1]
    owner = np.cumsum(head) - 1  # lines that don't begin a paragraph go on with the one before
    doc, number, row = doc[head], number[head], owner[row]
    count = np.bincount(row, minlength=len(doc))
    keep = count >= min_words
    word = K.span_hashes(part, start, end)
    mine = keep[row]
    new = np.cumsum(keep) - 1
    return doc[keep], number[keep], count[keep], word[mine], new[row[mine]]


def _content(word: np.ndarray, row: np.ndarray, count: np.ndarray) -> np.ndarray:
    first = np.cumsum(count) - count
    at = np.arange(len(row)) - first[row]
    return K.mix64(np.add.reduceat(K.mix64(word + K.mix64(at.astype(np.uint64) + np.uint64(1))), first)) if len(count) else np.zeros(0, np.uint64)


def _each(batches: Iterator[pa.RecordBatch], min_words: int):
    for batch in batches:
        data, off = K.utf8_view(batch.column(1))
        for lo, hi in K.chunks(off):
            part, o = data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo]
            if not len(part):
                continue
            doc, number, count, word, row = _paragraphs(part, o, min_words)
            if len(doc):
                yield batch.column(0), lo + doc, number, count, word, row


def _occurrences(min_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, doc, number, count, word, row in _each(batches, min_words):
            content = _content(word, row, count)
            yield pa.RecordBatch.from_arrays([pa.array(content.view(np.int64)), ids.take(pa.array(doc)), pa.array(number.astype(np.int32)), pa.array(count.astype(np.int32))], ["content", "doc_id", "paragraph", "words"])

    return run


def _band_keys(min_words: int, shingle: int, bands: int, rows: int, seed: int, cells: int):
    def keys(batches: Iterator[pa.RecordBatch]):
        for _, doc, _, count, word, row in _each(batches, min_words):
            content, at = np.unique(_content(word, row, count), return_index=True)
            value, owner = K.shingles(word, row, len(doc), shingle)
            minima = K.minhash(value, owner, len(doc), bands * rows, seed)[at].astype(np.uint64)
            for b in range(bands):
                key = np.full(len(at), K.mix64(np.uint64(b + 1)), np.uint64)
                for r in range(rows):
                    key = K.mix64(key * np.uint64(0x9E3779B97F4A7C15) + minima[:, b * rows + r])
                yield key.view(np.int64), content.view(np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return pack(keys(batches), cells)

    return run


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(bucket, content) of the keys with two or more contents, cell by cell; a bucket is named by its members."""
    for k, c in unpack(batches, 2):
        order = np.lexsort((c, k))
        k, c = k[order], c[order]
        new = np.ones(len(k), bool)
        new[1:] = (k[1:] != k[:-1]) | (c[1:] != c[:-1])
        k, c = k[new], c[new]
        start = np.ones(len(k), bool)
        start[1:] = k[1:] != k[:-1]
        first = np.flatnonzero(start)
        size = np.diff(np.append(first, len(k)))
        name = np.add.reduceat(K.mix64(c.view(np.uint64)), first)
        keep = np.repeat(size > 1, size)
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(name, size)[keep].view(np.int64)), pa.array(c[keep])], ["bucket", "content"])


def _triples(min_words: int, shingle: int, wanted):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent: set[int] = set()
        only = wanted.value if wanted is not None else None
        for _, doc, _, count, word, row in _each(batches, min_words):
            content = _content(word, row, count).view(np.int64)
            ok = np.ones(len(content), bool)
            if only is not None:
                ok = has_bit(only, content)
            value, owner = K.shingles(word, row, len(doc), shingle)
            mine = ok[owner]
            value, owner = K.distinct_per_row((value[mine] & np.uint64(0xFFFFFFFF)).astype(np.uint32), owner[mine])
            size = np.bincount(owner, minlength=len(doc))
            ends = np.cumsum(size)
            ids, sets = [], []
            for i in np.flatnonzero(ok):
                if (c := int(content[i])) not in sent:
                    sent.add(c)
                    ids.append(c)
                    sets.append(value[ends[i] - size[i] : ends[i]].tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sets, pa.binary())], ["content", "triples"])

    return run


def pair_jaccard(values: np.ndarray, first: np.ndarray, size: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Exact Jaccard similarity of the pairs (x, y) of sets values[first : first + size]."""
    n = size[x] + size[y]
    side = np.stack((x, y), 1).reshape(-1)
    length = size[side]
    total = int(length.sum())
    pos = np.arange(total) - np.repeat(np.cumsum(length) - length, length) + np.repeat(first[side], length)
    key = (np.repeat(np.arange(len(side)) // 2, length).astype(np.uint64) << np.uint64(32)) | values[pos].astype(np.uint64)
    key.sort()
    same = key[1:][key[1:] == key[:-1]]
    both = np.bincount((same >> np.uint64(32)).astype(np.int64), minlength=len(x))
    return both / np.maximum(n - both, 1)


def _verify(similar: float):
    def edges(bucket, ids, sets):
        values = np.frombuffer(b"".join(sets), np.uint32)
        size = np.array([len(s) // 4 for s in sets], np.int64)
        first = np.cumsum(size) - size
        new = np.ones(len(bucket), bool)
        new[1:] = bucket[1:] != bucket[:-1]
        begin = np.flatnonzero(new)
        runs = np.diff(np.append(begin, len(bucket)))
        left, right = [ids[:0]], [ids[:0]]
        for n in range(2, 7):
            here = begin[runs == n]
            i, j = np.triu_indices(n, 1)
            x, y = (here[:, None] + i).reshape(-1), (here[:, None] + j).reshape(-1)
            for lo in range(0, len(x), 5000):
                a, b = x[lo : lo + 5000], y[lo : lo + 5000]
                ok = pair_jaccard(values, first, size, a, b) >= similar
                left.append(ids[a[ok]])
                right.append(ids[b[ok]])
        for f, n in zip(begin[runs > 6], runs[runs > 6], strict=True):
            rest, frontier = np.arange(f, f + n), []
            while len(rest):
                if frontier:
                    at = frontier.pop()
                else:
                    at, rest = rest[0], rest[1:]
                near = np.zeros(len(rest), bool)
                for lo in range(0, len(rest), 5000):
                    other = rest[lo : lo + 5000]
                    near[lo : lo + 5000] = pair_jaccard(values, first, size, np.full(len(other), at), other) >= similar
                hit, rest = rest[near], rest[~near]
                left.append(np.full(len(hit), ids[at]))
                right.append(ids[hit])
                frontier.extend(hit.tolist())
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(left)), pa.array(np.concatenate(right))], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        n = 0
        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                n += batch.num_rows
            if n >= 40_000:
                whole = pa.Table.from_batches(held).combine_chunks()
                bucket = whole.column(0).to_numpy()
                change = np.flatnonzero(bucket != bucket[-1])
                stop = int(change[-1]) + 1 if len(change) else 0
                if stop:
                    yield edges(bucket[:stop], whole.column(1).to_numpy()[:stop], whole.column(2)[:stop].to_pylist())
                held = whole.slice(stop).to_batches()
                n = whole.num_rows - stop if stop else 0
        if held:
            whole = pa.Table.from_batches(held)
            yield edges(whole.column(0).to_numpy(), whole.column(1).to_numpy(), whole.column(2).to_pylist())

    return run


def _parts(buckets: DataFrame, most: int) -> DataFrame:
    """(bucket, content): buckets above ``most`` members as all pairs of parts of about that many."""
    big = buckets.groupBy("bucket").agg(F.count("*").alias("n")).where(F.col("n") > most).select("bucket", F.ceil(F.col("n") / most).alias("parts"))
    marked = buckets.join(big, "bucket", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    mine = F.pmod(F.xxhash64("content"), F.col("parts"))
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))
    split = marked.select("bucket", "content", "parts", mine.alias("mine"), other.alias("other"))
    name = F.when(F.col("parts") == 1, F.col("bucket")).otherwise(F.xxhash64("bucket", F.least("mine", "other"), F.greatest("mine", "other")))
    return split.select(name.alias("bucket"), "content")


def repeated_paragraphs(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS, similar: float = SIMILAR, bands: int = BANDS, rows: int = ROWS, shingle: int = SHINGLE, seed: int = SEED, bucket: int = BUCKET) -> DataFrame:
    """(doc_id, paragraph, words, cluster_doc, cluster_paragraph, removed): every occurrence of a repeated paragraph.

    ``paragraph`` is the number of its first line.  A cluster is named by its first
    occurrence, which alone isn't removed.
    """
    own, names = numbered(small_batches(docs).where(col(doc_id).isNotNull()).select(col(doc_id).alias("doc_id"), F.lower(col(text).cast("string")).alias("text")), "doc_id", "id")
    own = own.select("id", "text")
    keys = own.mapInArrow(_band_keys(min_words, shingle, bands, rows, seed, cells(docs.sparkSession)), PACKED)
    buckets = cut(gathered(keys).mapInArrow(_runs, "bucket long, content long").distinct())
    drop_dead(docs.sparkSession)  # the band keys
    colliding = buckets.select("content").distinct()
    few = colliding.limit(MAX_BROADCAST_HASHES + 1).count() <= MAX_BROADCAST_HASHES
    wanted = None
    if few:
        wanted = docs.sparkSession.sparkContext.broadcast(hash_bits(colliding, HASH_BITS))
    triples = own.mapInArrow(_triples(min_words, shingle, wanted), "content long, triples binary")
    triples = triples.join(colliding, "content", "left_semi") if not few else triples
    triples = triples.dropDuplicates(["content"])
    ready = _parts(buckets, bucket).join(triples, "content").select("bucket", "content", "triples").repartition("bucket").sortWithinPartitions("bucket", "content")
    edges = ready.mapInArrow(_verify(similar), "a long, b long").distinct()
    clusters = connected_components(edges).select(F.col("id").alias("content"), "component")
    drop_dead(docs.sparkSession)  # the triples
    found = cut(own.mapInArrow(_occurrences(min_words), "content long, doc_id long, paragraph int, words int"))
    sizes = found.groupBy("content").agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "paragraph")).alias("first"))
    named = sizes.join(clusters, "content", "left").where("n > 1 OR component IS NOT NULL").select("content", F.coalesce("component", "content").alias("component"), "first")
    heads = named.groupBy("component").agg(F.min("first").alias("head"))
    named = named.join(heads, "component").select("content", "head")
    out = found.join(named, "content")
    at = F.struct("doc_id", "paragraph")
    out = out.select("doc_id", "paragraph", "words", F.col("head.doc_id").alias("cluster_doc"), F.col("head.paragraph").alias("cluster_paragraph"), (at != F.col("head")).alias("removed"))
    return named_again(out, names, docs.schema[doc_id].dataType.simpleString())


def named_again(out: DataFrame, names: DataFrame | None, kind: str) -> DataFrame:
    """``out`` with the ids behind the numbers in doc_id and cluster_doc."""
    for c in ("doc_id", "cluster_doc"):
        if names is None:
            out = out.withColumn(c, F.col(c).cast(kind))
        else:
            columns = out.columns
            back = names.select(F.col("id").alias("_number"), F.col("doc_id").alias("_name"))
            out = out.join(back, out[c] == back["_number"]).drop("_number", c).withColumnRenamed("_name", c).select(*columns)
    return out
