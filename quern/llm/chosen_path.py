"""MinHash near-duplicates by chosen-path set similarity join (operator 9).

A document is the set of its lower-case word triples, held as 128 minwise
values.  Every tree starts with all documents in one node; a node picks two of
the 128 positions by a hash of its own name and sends each document to the
child named by (node, position, minwise value).  A pair of similarity J thus
stays together at a branch with chance 1 - (1 - J)**2.  Nodes of at most
``leaf`` documents are compared exhaustively; larger ones branch again, up to
``depth`` times, and what is then still together is compared exhaustively too.
As many independent trees are grown as ``trees_for`` finds enough for the target
recall of pairs at the similarity sought: a pair of J is together after n
branchings with chance p(n) = 1 - (1 - J p(n - 1))**2, p(0) = 1.

Inside a node comparisons run breadth first over what is not yet reached, which
gives the connections of all pairs and, in a node of near copies, costs one
pass.  Similarity is the share of equal minwise values (standard error at most
0.044).  Documents of equal word sequence are joined beforehand, so copies
don't fill the nodes.

Scale.  Documents move only as ids (16 bytes a node); 136-byte sketches follow
for nodes of two or more.  Node sizes come from a partial aggregation, so a
phrase that half the corpus shares is one counter, and such a node branches
until it is small.  Comparison tasks stream nodes in order.

Defined cases: NULL and empty texts, texts of nothing but white space and rows
without an id match nothing and stay; other texts without a word match their
exact copies; fewer than three words count as one shingle; rows that repeat an
id count as copies (one stays); ties go to the least id; ids keep their type; an
empty table gives an empty result.  Other columns are kept by ``deduplicate``.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from quern.llm import kernels as K
from quern.llm.common import col, free_name, numbered, small_batches
from quern.operators.components import connected_components
from quern.session import cut

SHINGLE = 3
SIZE = 128
SIMILAR = 0.5
RECALL = 0.98
LEVELS = 3  # branchings that a node of a large corpus goes through before it is a leaf, for the number of trees
LEAF = 64
DEPTH = 8
SEED = 20260

def trees_for(recall: float = RECALL, similar: float = SIMILAR, levels: int = LEVELS) -> int:
    """Trees that keep a pair of that similarity together in one of them with chance ``recall``."""
    p = 1.0
    for _ in range(levels):
        p = 1 - (1 - similar * p) ** 2
    return max(1, math.ceil(math.log(1 - recall) / math.log(1 - p))) if p < 1 else 1


_SKETCH_SCHEMA = "id long, content long, minima binary, sketch binary"


def _sketches(shingle: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, off = K.utf8_view(batch.column(1))
            for lo, hi in K.chunks(off):
                part, o = data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo]
                start, end, row = K.words(part, o)
                word = K.span_hashes(part, start, end)
                value, owner = K.shingles(word, row, hi - lo, shingle)
                minima = K.minhash(value, owner, hi - lo, SIZE, seed)
                count = np.bincount(row, minlength=hi - lo)
                at = np.arange(len(row)) - (np.cumsum(count) - count)[row]
                content = np.zeros(hi - lo, np.uint64)
                worded = np.flatnonzero(count)
                if len(worded):
                    mixed = K.mix64(word + K.mix64(at.astype(np.uint64) + np.uint64(1)))
                    content[worded] = K.mix64(np.add.reduceat(mixed, (np.cumsum(count) - count)[worded]))
                seen = np.zeros(len(part) + 1, np.int64)
                np.cumsum(~K.IS_SPACE[part], out=seen[1:])
                signs = np.flatnonzero((count == 0) & (seen[o[1:]] > seen[o[:-1]]))
                content[signs] = K.mix64(K.span_hashes(part, o[signs], o[signs + 1]) + np.uint64(1))
                live = np.flatnonzero((count > 0) | (seen[o[1:]] > seen[o[:-1]]))
                rows = pa.array(lo + live)
                small = (minima[live] & np.uint32(0xFF)).astype(np.uint8)
                pack = lambda m: pa.FixedSizeBinaryArray.from_buffers(pa.binary(m.shape[1] * m.itemsize), len(m), [None, pa.py_buffer(np.ascontiguousarray(m))]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column(0).take(rows), pa.array(content[live].view(np.int64)), pack(minima[live]), pack(small)], ["id", "content", "minima", "sketch"])

    return run


def sketches(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """(id, content, minima, sketch) of every document with an id and anything but white space; a document without a word has no minima but 2**32 - 1."""
    own = small_batches(docs).where(col(doc_id).isNotNull()).select(col(doc_id).cast("long").alias("id"), F.lower(col(text).cast("string")).alias("text"))
    return own.mapInArrow(_sketches(shingle, seed), _SKETCH_SCHEMA)


def _roots(trees: int, seed: int) -> np.ndarray:
    return K.mix64(np.arange(1, trees + 1, dtype=np.uint64) + np.uint64(seed))


def _matrix(column: pa.Array, dtype) -> np.ndarray:
    """Rows of a binary column of equal lengths as one matrix."""
    n = len(column)
    _, offsets, data = column.buffers()
    kind = np.int64 if pa.types.is_large_binary(column.type) else np.int32
    off = np.frombuffer(offsets, kind)[column.offset : column.offset + n + 1]
    return np.frombuffer(data, np.uint8)[off[0] : off[-1]].reshape(n, -1).view(dtype) if n else np.zeros((0, 1), dtype)


def _children(parents: np.ndarray, minima: np.ndarray) -> np.ndarray:
    """n x 2 names of the children of each (parent, document)."""
    pick = K.mix64(parents ^ np.uint64(0x5BD1E995))
    first = (pick % np.uint64(SIZE)).astype(np.int64)
    second = (first + 1 + ((pick >> np.uint64(32)) % np.uint64(SIZE - 1)).astype(np.int64)) % SIZE
    out = np.empty((len(parents), 2), np.uint64)
    line = np.arange(len(parents))
    for j, at in enumerate((first, second)):
        out[:, j] = K.mix64(parents + K.mix64((at.astype(np.uint64) << np.uint64(32)) | minima[line, at].astype(np.uint64)))
    return out


def _first_level(roots: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, minima = batch.column(0).to_numpy(), _matrix(batch.column(1), np.uint32)
            for root in roots:
                node = _children(np.full(len(ids), root), minima)
                yield pa.RecordBatch.from_arrays([pa.array(node.reshape(-1).view(np.int64)), pa.array(np.repeat(ids, 2))], ["node", "id"])

    return run


def _next_level(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        parents = batch.column(0).to_numpy().view(np.uint64)
        node = _children(parents, _matrix(batch.column(2), np.uint32))
        yield pa.RecordBatch.from_arrays([pa.array(node.reshape(-1).view(np.int64)), pa.array(np.repeat(batch.column(1).to_numpy(), 2))], ["node", "id"])


def _pairs_of_equal_runs(sizes: np.ndarray, first: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    here = first[sizes == size]
    i, j = np.triu_indices(size, 1)
    return (here[:, None] + i).reshape(-1), (here[:, None] + j).reshape(-1)


def compare_runs(node: np.ndarray, ids: np.ndarray, sketch: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Edges that connect, inside each run of equal ``node``, what a comparison of all pairs would connect."""
    if not len(node):
        return ids, ids
    new = np.ones(len(node), bool)
    new[1:] = node[1:] != node[:-1]
    first = np.flatnonzero(new)
    sizes = np.diff(np.append(first, len(node)))
    left, right = [], []
    for size in range(2, 9):
        a, b = _pairs_of_equal_runs(sizes, first, size)
        for lo in range(0, len(a), 50_000):
            x, y = a[lo : lo + 50_000], b[lo : lo + 50_000]
            ok = (sketch[x] == sketch[y]).mean(axis=1) >= least
            left.append(ids[x[ok]])
            right.append(ids[y[ok]])
    for f, n in zip(first[sizes > 8], sizes[sizes > 8], strict=True):
        rest = np.arange(f, f + n)
        frontier: list[int] = []
        while len(rest):
            if frontier:
                at = frontier.pop()
            else:
                at, rest = rest[0], rest[1:]
            if not len(rest):
                break
            near = np.concatenate([(sketch[rest[lo : lo + 20_000]] == sketch[at]).mean(axis=1) >= least for lo in range(0, len(rest), 20_000)])
            hit = rest[near]
            if len(hit):
                left.append(np.full(len(hit), ids[at]))
                right.append(ids[hit])
                frontier.extend(hit.tolist())
                rest = rest[~near]
    if not left:
        return ids[:0], ids[:0]
    return np.concatenate(left), np.concatenate(right)


def _compare(similar: float):
    least = similar + (1 - similar) / 256  # a byte is equal by chance once in 256

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def flush(last: bool):
            node, ids, sketch = (np.concatenate([h[k] for h in held]) for k in range(3))
            stop = len(node) if last else int(np.searchsorted(-(node != node[-1]).astype(np.int8), 0))
            held.clear()
            if stop < len(node):
                held.append((node[stop:], ids[stop:], sketch[stop:]))
            a, b = compare_runs(node[:stop], ids[:stop], sketch[:stop], least)
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

        pending = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append((batch.column(0).to_numpy(), batch.column(1).to_numpy(), _matrix(batch.column(2), np.uint8)))
            pending += batch.num_rows
            if pending >= 100_000:
                yield flush(False)
                pending = 0
        if held:
            yield flush(True)

    return run


def near_edges(points: DataFrame, similar: float = SIMILAR, recall: float = RECALL, leaf: int = LEAF, depth: int = DEPTH, seed: int = SEED) -> DataFrame:
    """(a, b): edges between near-duplicates of ``points`` (id, minima, sketch), over all trees."""
    trees = trees_for(recall, similar)
    rows = points.select("id", "minima").mapInArrow(_first_level(_roots(trees, seed)), "node long, id long")
    done = []
    for level in range(1, depth + 1):
        sizes = rows.groupBy("node").count().where("count > 1").select(F.col("node").alias("_n"), F.col("count").alias("_c"))
        shared = cut(rows.join(sizes, rows["node"] == sizes["_n"]).select("node", "id", (F.col("_c") > leaf).alias("big")))
        if level == depth:
            done.append(shared.select("node", "id"))
            break
        done.append(shared.where("NOT big").select("node", "id"))
        big = shared.where("big")
        if big.isEmpty():
            break
        rows = big.join(points.select("id", "minima"), "id").select("node", "id", "minima").mapInArrow(_next_level, "node long, id long").distinct()
    nodes = done[0]
    for more in done[1:]:
        nodes = nodes.unionByName(more)
    ready = nodes.join(points.select("id", "sketch"), "id").select("node", "id", "sketch").repartition("node").sortWithinPartitions("node", "id")
    return ready.mapInArrow(_compare(similar), "a long, b long").distinct()


def near_duplicate_groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", similar: float = SIMILAR, recall: float = RECALL, leaf: int = LEAF, depth: int = DEPTH, shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """(doc_id, group_id): every document of a group of two or more; the group is named by its least id."""
    own, names = numbered(docs.where(col(doc_id).isNotNull()).select(col(doc_id).alias("doc_id"), col(text).cast("string").alias("text")), "doc_id", "id")
    all_sketches = cut(sketches(own, "id", "text", shingle, seed))
    copies = all_sketches.groupBy("content").agg(F.min("id").alias("first"), F.count("*").alias("n"))
    alike = all_sketches.select("id", "content").join(copies.where("n > 1"), "content").where("id <> first").select(F.col("first").alias("a"), F.col("id").alias("b"))
    nothing = F.lit(b"\xff" * (4 * SIZE))
    points = all_sketches.where(F.col("minima") != nothing).join(copies.select(F.col("content").alias("_c"), F.col("first").alias("_f")), (F.col("content") == F.col("_c")) & (F.col("id") == F.col("_f"))).dropDuplicates(["id"])
    points = cut(points.select("id", "minima", "sketch"))
    edges = near_edges(points, similar, recall, leaf, depth, seed).unionByName(alike)
    groups = connected_components(edges).select(F.col("id").alias("doc_id"), F.col("component").alias("group_id"))
    if names is None:
        kind = docs.schema[doc_id].dataType.simpleString()
        return groups.select(F.col("doc_id").cast(kind).alias("doc_id"), F.col("group_id").cast(kind).alias("group_id"))
    back = lambda a, b: names.select(F.col("id").alias(a), F.col("doc_id").alias(b))
    return groups.join(back("doc_id", "_own"), "doc_id").join(back("group_id", "_head"), "group_id").select(F.col("_own").alias("doc_id"), F.col("_head").alias("group_id"))


def deduplicate(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **settings) -> DataFrame:
    """``docs`` with one document of each near-duplicate group, the one of least id."""
    groups = near_duplicate_groups(docs, doc_id, text, **settings).where("doc_id <> group_id")
    gone = free_name(docs, "_gone")
    kept = docs.join(groups.select(F.col("doc_id").alias(gone)), col(doc_id) == F.col(gone), "left_anti")
    again = cut(docs.where(col(doc_id).isNotNull()).groupBy(col(doc_id).alias(gone)).count().where("count > 1").select(gone))
    if again.isEmpty():
        return kept
    rank = free_name(docs, "_rank")
    single = kept.join(again, col(doc_id) == F.col(gone), "left_anti")
    several = kept.join(again, col(doc_id) == F.col(gone), "left_semi").withColumn(rank, F.row_number().over(W.partitionBy(col(doc_id)).orderBy(F.col(f"`{text}`").asc_nulls_last()))).where(F.col(rank) == 1).drop(rank)
    return single.unionByName(several)
