"""Helpers shared by the corpus operators."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm import kernels as K
from quern.session import cut

BLOCK_BITS = 19
PACK_ROWS = 1 << 19
PIECE_ROWS = 256
PACKED = "cell int, data binary"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def free_name(df: DataFrame, wanted: str, also: Iterable[str] = ()) -> str:
    """``wanted``, with underscores added until no column of ``df`` has that name in any case."""
    taken = {c.lower() for c in df.columns} | {c.lower() for c in also}
    while wanted.lower() in taken:
        wanted += "_"
    return wanted


def col(name: str) -> Column:
    """Column of exactly this name, dots and spaces included."""
    return F.col("`" + name.replace("`", "``") + "`")


def numbered(df: DataFrame, wanted: str, name: str) -> tuple[DataFrame, DataFrame | None]:
    """``df`` with a long ``name`` for its id ``wanted``, and (name, wanted) to go back, None where the id is an integer itself.

    Other ids are numbered in their order, so the least id has the least number.
    """
    if df.schema[wanted].dataType.typeName() in ("byte", "short", "integer", "long"):
        return df.withColumn(name, col(wanted).cast("long")), None
    names = cut(df.select(col(wanted)).where(col(wanted).isNotNull()).distinct().orderBy(col(wanted)).withColumn(name, F.monotonically_increasing_id()))
    return df.join(names, wanted, "left"), names


def small_batches(df: DataFrame, rows: int = 2000) -> DataFrame:
    """``df``, with at most ``rows`` rows in an Arrow batch of its session.

    Texts are long, and a batch is held on both sides of the pipe by every task.
    A smaller setting of the session stays.
    """
    conf, name = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(conf.get(name))
    if now <= 0 or now > rows:
        conf.set(name, str(rows))
    return df


def hash_bits(hashes: DataFrame, bits: int) -> np.ndarray:
    """``1 << bits`` bits as 64-bit words, set at the low bits of the one long column of ``hashes``.

    Executors make them, in blocks of 64 KB, so the driver gets some megabytes
    whatever the number of hashes.  Other hashes may share a bit, so what passes
    has to be joined to the hashes in the end.
    """
    block = min(bits, BLOCK_BITS)
    low = F.col(hashes.columns[0]).bitwiseAND(F.lit((1 << bits) - 1))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            at = batch.column(0).to_numpy()
            for b in np.unique(at >> block).tolist():
                held.setdefault(b, np.zeros(1 << block, bool))[at[at >> block == b] & ((1 << block) - 1)] = True
        for b, own in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([b], pa.int64()), pa.array([np.packbits(own, bitorder="little").tobytes()], pa.binary())], ["block", "bits"])

    rows = hashes.select(low.alias("low")).repartition(F.shiftright("low", block)).mapInArrow(pack, "block long, bits binary").collect()
    out = np.zeros((1 << bits) // 8, np.uint8)
    for r in rows:
        out[r["block"] << (block - 3) : (r["block"] + 1) << (block - 3)] = np.frombuffer(r["bits"], np.uint8)
    return out.view(np.uint64)


def has_bit(words: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Whether the bit of each 64-bit hash is set in the words of ``hash_bits``."""
    low = hashes.view(np.uint64) & np.uint64(len(words) * 64 - 1)
    return (words[(low >> np.uint64(6)).astype(np.int64)] >> (low & np.uint64(63))) & np.uint64(1) > 0


def cells(spark: SparkSession) -> int:
    """Cells for ``pack``: eight a shuffle partition, so a task holds an eighth of one."""
    return 8 * int(spark.conf.get("spark.sql.shuffle.partitions"))


def pack(parts: Iterable[Sequence[np.ndarray]], cells: int, thin: Callable[[list[np.ndarray]], list[np.ndarray]] = list) -> Iterator[pa.RecordBatch]:
    """Rows of 64-bit columns, gathered by the hash of the first: (cell, up to ``PIECE_ROWS`` rows in one binary).

    Spark then moves and sorts one row for many.  ``thin`` may leave out rows of each ``PACK_ROWS``.
    """
    held: list[Sequence[np.ndarray]] = []
    n = 0

    def out() -> pa.RecordBatch:
        columns = thin([np.concatenate(c) for c in zip(*held, strict=True)])
        cell = (K.mix64(columns[0].view(np.uint64)) % np.uint64(cells)).astype(np.int32)
        order = np.argsort(cell, kind="stable")
        rows, cell = np.stack([c[order] for c in columns], 1), cell[order]
        first = np.flatnonzero(np.diff(cell, prepend=-1))
        place = np.arange(len(cell)) - np.repeat(first, np.diff(np.append(first, len(cell))))
        begin = np.flatnonzero(place % PIECE_ROWS == 0)
        ends = (np.append(begin, len(cell)) * rows.itemsize * rows.shape[1]).astype(np.int32)
        data = pa.Array.from_buffers(pa.binary(), len(begin), [None, pa.py_buffer(ends), pa.py_buffer(rows)])
        return pa.RecordBatch.from_arrays([pa.array(cell[begin]), data], ["cell", "data"])

    for columns in parts:
        if len(columns[0]):
            held.append(columns)
            n += len(columns[0])
        if n >= PACK_ROWS:
            yield out()
            held, n = [], 0
    if held:
        yield out()


def gathered(packed: DataFrame) -> DataFrame:
    """``packed`` with each cell in one partition, its rows together."""
    return packed.repartition("cell").sortWithinPartitions("cell")


def unpack(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[list[np.ndarray]]:
    """The ``width`` columns of each cell, one cell at a time; rows come as ``gathered``."""
    held: list[bytes] = []
    now = None

    def columns() -> list[np.ndarray]:
        rows = np.frombuffer(b"".join(held), np.int64).reshape(-1, width)
        return [np.ascontiguousarray(rows[:, i]) for i in range(width)]

    for batch in batches:
        cell, data = batch.column(0).to_numpy(), batch.column(1).to_pylist()
        edges = [0, *(np.flatnonzero(cell[1:] != cell[:-1]) + 1).tolist(), len(cell)] if len(cell) else [0]
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            if held and cell[a] != now:
                yield columns()
                held = []
            now = cell[a]
            held += data[a:b]
    if held:
        yield columns()
