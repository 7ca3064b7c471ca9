"""Best-fit packing with large-item matching (operator 1).

Lengths are whole words, so the plan depends only on how many pieces there are
of each length: a histogram of at most ``capacity`` numbers, however large the
corpus.  Pieces above a third of the capacity are matched greedily, the largest
with the largest partner that fits, at most two a bin; smaller pieces, longest
first, go into the fullest bin that still has room.  The plan is a list of runs
"the next n pieces of length L go into bins b.. at offset o"; pieces get their
rank among equals and look up their run.

Scale.  Texts are cut twice: for the lengths alone, which are written as a narrow
table that all counts come from, and for the pieces that move.  Ranks come from
a window over (length, salt) plus offsets from the counts; a length has as many
salts as its count asks for, so that the pieces of one length, such as full
ones, are never one partition's burden.  Text moves once; the offsets join where
the window already lies.  The plan's runs are bounded by the capacity, not by
the data, and only they are broadcast.

Defined cases: a text longer than the capacity is cut at word starts into full
pieces and a rest, whose concatenation is the text; NULL, empty and blank texts
have length 0 and come out once with a NULL bin; repeated rows are separate
items; NULL ids are carried along; other columns are dropped from the result;
an empty table gives no row.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from quern.llm import kernels as K
from quern.llm.common import col, small_batches
from quern.session import cut

CAPACITY = 2048
WORDS_A_SALT = 500_000


def plan(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Runs (length, first rank, pieces, first bin, pieces a bin, offset) that place every counted piece.

    A run's j-th piece goes into bin ``first bin + j // per``, at ``offset + length * (j % per)``.
    """
    left = {k: n for k, n in counts.items() if n > 0 and k > 0}
    used = dict.fromkeys(left, 0)
    runs: list[tuple[int, int, int, int, int, int]] = []
    gaps: dict[int, list[tuple[int, int]]] = {}  # room -> [(first bin, bins)]
    rooms: list[int] = []
    bins = 0

    def take(length: int, n: int, first_bin: int, per: int, offset: int) -> None:
        runs.append((length, used[length], n, first_bin, per, offset))
        used[length] += n
        left[length] -= n

    def open_gap(room: int, first_bin: int, n: int) -> None:
        if room > 0 and n > 0:
            if room not in gaps:
                gaps[room] = []
                insort(rooms, room)
            gaps[room].append((first_bin, n))

    large = sorted(k for k in left if 3 * k > capacity)
    while large:
        a = large[-1]
        if left[a] == 0:
            large.pop()
            continue
        at = bisect_left(large, min(a, capacity - a) + 1) - 1
        while at >= 0 and (left[large[at]] == 0 or (large[at] == a and left[a] < 2)):
            at -= 1
        if at < 0:
            n = left[a]
            take(a, n, bins, 1, 0)
            open_gap(capacity - a, bins, n)
        else:
            b = large[at]
            n = left[a] // 2 if a == b else min(left[a], left[b])
            take(a, n, bins, 1, 0)
            take(b, n, bins, 1, a)
            open_gap(capacity - a - b, bins, n)
        bins += n
    for s in sorted((k for k in left if 3 * k <= capacity), reverse=True):
        while left[s]:
            at = bisect_left(rooms, s)
            if at == len(rooms):
                per = capacity // s
                full, rest = divmod(left[s], per)
                if full:
                    take(s, full * per, bins, per, 0)
                    open_gap(capacity - per * s, bins, full)
                    bins += full
                if rest:
                    take(s, rest, bins, rest, 0)
                    open_gap(capacity - rest * s, bins, 1)
                    bins += 1
                break
            room = rooms[at]
            first_bin, n = gaps[room].pop()
            if not gaps[room]:
                del gaps[room]
                rooms.pop(at)
            per = room // s
            full = min(n, left[s] // per)
            if full:
                take(s, full * per, first_bin, per, capacity - room)
                open_gap(room - per * s, first_bin, full)
            if full < n:
                rest = min(left[s], per - 1) if left[s] < per else 0
                if rest:
                    take(s, rest, first_bin + full, rest, capacity - room)
                    open_gap(room - rest * s, first_bin + full, 1)
                open_gap(room, first_bin + full + bool(rest), n - full - bool(rest))
    return runs


def _pieces(capacity: int, texts: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, off = K.utf8_view(batch.column(1))
            for lo, hi in K.chunks(off, 4 * K.CHUNK_BYTES):
                part, o = data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo]
                start, _, row = K.words(part, o, ~K.IS_SPACE)
                n = np.bincount(row, minlength=hi - lo)
                many = np.maximum(-(-n // capacity), 1)
                doc = np.repeat(np.arange(hi - lo), many)
                piece = np.arange(len(doc)) - np.repeat(np.cumsum(many) - many, many)
                length = np.minimum(n[doc] - piece * capacity, capacity)
                own = [batch.column(0).slice(lo, hi - lo).take(pa.array(doc)), pa.array(piece.astype(np.int32)), pa.array(length.astype(np.int32))]
                if not texts:
                    yield pa.RecordBatch.from_arrays(own, ["doc_id", "piece", "words"])
                    continue
                if len(doc) == hi - lo:  # nothing to cut
                    text = batch.column(1).slice(lo, hi - lo)
                else:
                    first_word = np.cumsum(n) - n
                    begin = np.where(piece == 0, o[doc], start[np.minimum(first_word[doc] + piece * capacity, max(len(start) - 1, 0))] if len(start) else 0)
                    edges = np.append(begin, o[-1])
                    text = pa.Array.from_buffers(pa.large_string(), len(doc), [None, pa.py_buffer(edges.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(part))]).cast(pa.string())
                yield pa.RecordBatch.from_arrays([*own, text], ["doc_id", "piece", "words", "text"])

    return run


def pack(docs: DataFrame, capacity: int = CAPACITY, doc_id: str = "doc_id", text: str = "text", words_a_salt: int = WORDS_A_SALT) -> DataFrame:
    """(bin_id, bin_offset, doc_id, piece, words, text): one row a piece; offsets and lengths in words."""
    own = small_batches(docs).select(col(doc_id).alias("doc_id"), col(text).cast("string").alias("text"))
    kind = own.schema["doc_id"].dataType.simpleString()
    lengths = cut(own.mapInArrow(_pieces(capacity, False), f"doc_id {kind}, piece int, words int"))
    pieces = own.mapInArrow(_pieces(capacity, True), f"doc_id {kind}, piece int, words int, text string")
    spark = docs.sparkSession
    total = {r["words"]: r["count"] for r in lengths.groupBy("words").count().collect()}  # at most capacity rows
    runs: dict[int, list[tuple]] = {}
    for length, first, n, first_bin, per, offset in plan(total, capacity):
        runs.setdefault(length, []).append((first, n, first_bin, per, offset))
    many = [(w, -(-n * max(w, 1) // words_a_salt)) for w, n in total.items() if n * max(w, 1) > words_a_salt]
    salts = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for pair in many for x in pair]), F.col("words")), F.lit(1)) if many else F.lit(1)
    salt = F.pmod(F.xxhash64("doc_id", "piece"), salts).cast("int")
    sizes = lengths.withColumn("salt", salt).groupBy("words", "salt").count()
    before = W.partitionBy("words").orderBy("salt").rowsBetween(W.unboundedPreceding, -1)
    offsets = sizes.select("words", "salt", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("base"))
    by_run = spark.createDataFrame([(w, *r) for w, rs in runs.items() for r in rs], "of int, first long, n long, first_bin long, per long, offset int")
    w = W.partitionBy("words", "salt").orderBy(F.xxhash64("doc_id", "piece"), "doc_id", "piece")
    ranked = pieces.withColumn("salt", salt).withColumn("rank", F.row_number().over(w) - 1)
    ranked = ranked.join(offsets, ["words", "salt"]).withColumn("rank", F.col("rank") + F.col("base"))
    placed = ranked.join(F.broadcast(by_run), (F.col("words") == F.col("of")) & (F.col("rank") >= F.col("first")) & (F.col("rank") < F.col("first") + F.col("n")), "left")  # blank texts have no run
    at = F.col("rank") - F.col("first")
    return placed.select(
        (F.col("first_bin") + F.floor(at / F.col("per"))).cast("long").alias("bin_id"),
        (F.col("offset") + F.col("words") * F.pmod(at, F.col("per"))).cast("int").alias("bin_offset"),
        "doc_id", "piece", "words", "text",
    )
