"""Repeated passages of whole texts, whatever their line breaks (operator 2, beside ``paragraphs``).

A passage is a stretch of words in which every window of ``min_words`` words
stands elsewhere too, word for word; lines play no part.  Of the runs of
``min_words`` - ``SPREAD`` words that start in a window, the one of least hash
is its seed, so equal windows have equal seeds, and about one word in six
begins one (winnowing).  Only windows whose seed occurs twice are gathered by
their hash.  The seeds are thus a filter without loss: every shared window is
found.  The first occurrence of a window stays; neighbouring windows of one
text that repeat neighbouring windows of another become one row.

Scale.  Seeds move once (8 bytes for one word in six), windows only where a
seed is shared, by their hash and then by their text.  Seeds and the second move
are packed many to a row (``common.pack``); the rows of one text are sorted where
they arrive.  Shared seeds go to the scan as 2 MB of broadcast bits while they
number at most ``MAX_BROADCAST_SEEDS``; beyond it each text is joined to its own.

Defined cases: NULL and empty texts and rows without an id have no passage; the
rows of one id count as one text, of which the same place is there once; ties go
to the least (doc_id, word); an empty table gives no row.  A passage that was
edited is found in the parts of ``min_words`` words that are left.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm import kernels as K
from quern.llm.common import PACKED, cells, col, gathered, has_bit, hash_bits, numbered, pack, small_batches, unpack
from quern.llm.paragraphs import named_again
from quern.session import cut

MIN_WORDS = 40
SPREAD = 10
MAX_BROADCAST_SEEDS = 8_000_000
FILTER_BITS = 24
_LOW = (1 << 32) - 1


def run_hashes(word: np.ndarray, row: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, first word) of every run of ``width`` words inside a row, from one prefix sum."""
    n = len(word)
    if n < width:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    up, down = K._powers(n)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(word * up[:n], dtype=np.uint64, out=sums[1:])
    at = np.flatnonzero(row[width - 1 :] == row[: n - width + 1])
    return K.mix64((sums[at + width] - sums[at]) * down[at]), at


def _least(values: np.ndarray, steps: int) -> np.ndarray:
    """Position of the least of ``steps`` values from each position on (the first of equal ones), by doubling."""
    at, size = np.arange(len(values)), 1
    while size < steps:
        shift = min(size, steps - size)
        left, right = at[:-shift], at[shift:]
        at = np.where(values[right] < values[left], right, left)
        size += shift
    return at


def _each(batches: Iterator[pa.RecordBatch], min_words: int):
    """(batch, row of each window, its number in the chunk's words, its seed's, hash of the runs that may be seeds, chunk) by chunks."""
    width = max(1, min_words - SPREAD)
    for batch in batches:
        data, off = K.utf8_view(batch.column(1))
        for lo, hi in K.chunks(off):
            part, o = data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo]
            if not len(part):
                continue
            start, end, row = K.words(part, o)
            if len(row) < min_words:
                continue
            word = K.span_hashes(part, start, end)
            at = np.flatnonzero(row[min_words - 1 :] == row[: len(row) - min_words + 1])
            short, first = run_hashes(word, row, width)
            seeds = np.zeros(len(word), np.uint64)
            seeds[first] = short
            where = _least(seeds, min_words - width + 1)[at]
            yield batch, lo, at, where, seeds, (part, o, start, row, word)


def _seeds(min_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, lo, _, where, seeds, (_, _, _, row, _) in _each(batches, min_words):
            at = where[np.diff(where, prepend=-1) > 0]  # it never falls
            yield pa.RecordBatch.from_arrays([pa.array(seeds[at].view(np.int64)), batch.column(0).take(pa.array(lo + row[at]))], ["seed", "doc_id"])

    return run


def _seed_cells(min_words: int, cells: int):
    """The seeds packed by cell, of each seed in a pack at most two, which is enough to be shared."""

    def twice(columns: list[np.ndarray]) -> list[np.ndarray]:
        seed = np.sort(columns[0])
        keep = np.ones(len(seed), bool)
        keep[2:] = seed[2:] != seed[:-2]
        return [seed[keep]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return pack(([b.column(0).to_numpy()] for b in _seeds(min_words)(batches)), cells, twice)

    return run


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The seeds that occur twice, cell by cell."""
    for (seed,) in unpack(batches, 1):
        seed = np.sort(seed)
        yield pa.RecordBatch.from_arrays([pa.array(np.unique(seed[1:][seed[1:] == seed[:-1]]))], ["seed"])


def _windows(min_words: int, wanted):
    """(window, doc_id, place) of the windows of shared seeds; place is line << 32 | word.

    Shared are those whose low bits ``wanted`` has, or those in the row's third column.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = wanted.value if wanted is not None else None
        for batch, lo, at, where, seeds, (part, o, start, row, word) in _each(batches, min_words):
            seed = seeds[where]
            if bits is not None:
                ok = has_bit(bits, seed)
            else:
                ok, mine = np.zeros(len(seed), bool), row[at]
                edges = np.flatnonzero(np.diff(mine, prepend=-1, append=-1))
                for a, b in zip(edges[:-1], edges[1:], strict=True):
                    ok[a:b] = np.isin(seed[a:b].view(np.int64), np.array(batch.column(2)[lo + int(mine[a])].as_py(), np.int64))
            if not ok.any():
                continue
            window = run_hashes(word, row, min_words)[0][ok]
            at = at[ok]
            first = np.searchsorted(row, np.arange(len(o) - 1))
            lines = np.flatnonzero(part == 10)
            line = np.searchsorted(lines, start[at]) - np.searchsorted(lines, o[:-1])[row[at]]
            place = (line << 32) | (at - first[row[at]])
            yield pa.RecordBatch.from_arrays([pa.array(window.view(np.int64)), batch.column(0).take(pa.array(lo + row[at])), pa.array(place)], ["window", "doc_id", "place"])

    return run


def _heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each occurrence of a window that stands in two places, with the first; rows come by (window, doc_id, place)."""
    held = None  # window, doc_id, place of the first occurrence; whether it is still the only one; the last row
    for batch in batches:
        w, d, p = (c.to_numpy() for c in batch.columns)
        if not len(w):
            continue
        new = np.ones(len(w), bool)
        new[1:] = (w[1:] != w[:-1]) | (d[1:] != d[:-1]) | (p[1:] != p[:-1])
        if held:
            new[0] = (w[0], d[0], p[0]) != held[4]
        last = (w[-1], d[-1], p[-1])
        w, d, p = w[new], d[new], p[new]
        if held:  # the open window goes on from its first occurrence
            w, d, p = (np.concatenate(([h], x)) for h, x in zip(held[:3], (w, d, p), strict=True))
        start = np.ones(len(w), bool)
        start[1:] = w[1:] != w[:-1]
        first = np.flatnonzero(start)
        size = np.diff(np.append(first, len(w)))
        head = np.repeat(first, size)
        keep = np.repeat(size > 1, size)
        if held and not held[3]:
            keep[0] = False  # it was given with an earlier batch
        only = bool(size[-1] == 1) and (len(first) > 1 or not held or held[3])
        held = (w[first[-1]], d[first[-1]], p[first[-1]], only, last)
        word = p & _LOW
        yield pa.RecordBatch.from_arrays([pa.array(x[keep]) for x in (d, d[head], word - word[head], p, p[head])], ["doc_id", "head", "shift", "place", "head_place"])


def _spans(min_words: int):
    """One row of neighbouring windows with neighbouring first occurrences; rows come by (doc_id, head, shift, place)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        names = ["doc_id", "paragraph", "words", "cluster_doc", "cluster_paragraph", "removed", "first_word", "cluster_first_word"]

        def rows(d, h, s, p, q, end):
            word = p & _LOW
            small = lambda x: pa.array(x.astype(np.int32))
            return pa.RecordBatch.from_arrays([pa.array(d), small(p >> 32), small(end - word + min_words), pa.array(h), small(q >> 32), pa.array((d != h) | (s != 0)), small(word), small(q & _LOW)], names)

        for batch in batches:
            cols = [c.to_numpy() for c in batch.columns]
            if not len(cols[0]):
                continue
            end = cols[3] & _LOW
            if held:
                cols = [np.concatenate((a, b)) for a, b in zip(held[0], cols, strict=True)]
                end = np.concatenate((held[1], end))
            word = cols[3] & _LOW
            new = np.ones(len(end), bool)
            new[1:] = (cols[0][1:] != cols[0][:-1]) | (cols[1][1:] != cols[1][:-1]) | (cols[2][1:] != cols[2][:-1]) | (word[1:] != end[:-1] + 1)
            first = np.flatnonzero(new)
            stop = end[np.append(first[1:], len(end)) - 1]
            cols = [c[first] for c in cols]
            held = [c[-1:] for c in cols], stop[-1:]
            yield rows(*(c[:-1] for c in cols), stop[:-1])
        if held:
            yield rows(*held[0], held[1])

    return run


def _head_cells(cells: int):
    """``_heads``, packed by the cell of their doc_id, without the shift, which their places give."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return pack(([b.column(i).to_numpy() for i in (0, 1, 3, 4)] for b in _heads(batches)), cells)

    return run


def _ordered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The packed heads in the order ``_spans`` reads them, a cell at a time."""
    for d, h, p, q in unpack(batches, 4):
        shift = (p & _LOW) - (q & _LOW)
        order = np.lexsort((p, shift, h, d))
        yield pa.RecordBatch.from_arrays([pa.array(x[order]) for x in (d, h, shift, p, q)], ["doc_id", "head", "shift", "place", "head_place"])


def repeated_passages(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """(doc_id, paragraph, words, cluster_doc, cluster_paragraph, removed, first_word, cluster_first_word).

    ``words`` words from number ``first_word`` on are those from ``cluster_first_word``
    on in ``cluster_doc``, the first text that has them; paragraphs are the lines where
    both begin.  A row that is its own first occurrence isn't removed.
    """
    own, names = numbered(small_batches(docs).where(col(doc_id).isNotNull()).select(col(doc_id).alias("doc_id"), F.lower(col(text).cast("string")).alias("text")), "doc_id", "id")
    own = own.select(F.col("id").alias("doc_id"), "text")
    most = cells(docs.sparkSession)
    shared = cut(gathered(own.mapInArrow(_seed_cells(min_words, most), PACKED)).mapInArrow(_shared, "seed long"))
    schema = "window long, doc_id long, place long"
    if shared.limit(MAX_BROADCAST_SEEDS + 1).count() <= MAX_BROADCAST_SEEDS:
        wanted = docs.sparkSession.sparkContext.broadcast(hash_bits(shared, FILTER_BITS))
        windows = own.mapInArrow(_windows(min_words, wanted), schema)
    else:
        seeds = own.mapInArrow(_seeds(min_words), "seed long, doc_id long")
        lists = seeds.join(shared, "seed").groupBy("doc_id").agg(F.collect_set("seed").alias("seeds"))
        windows = own.join(lists, "doc_id").select("doc_id", "text", "seeds").mapInArrow(_windows(min_words, None), schema)
    heads = windows.repartition("window").sortWithinPartitions("window", "doc_id", "place").mapInArrow(_head_cells(most), PACKED)
    spans = _spans(min_words)
    out = gathered(heads).mapInArrow(lambda batches: spans(_ordered(batches)), "doc_id long, paragraph int, words int, cluster_doc long, cluster_paragraph int, removed boolean, first_word int, cluster_first_word int")
    return named_again(out, names, docs.schema[doc_id].dataType.simpleString())
