import numpy as np
import pyarrow as pa
import pytest
from conftest_paths import SF
from edge import docs
from test_duplicates import WORD
from test_passages import hidden

from quern.llm import common, paragraphs, passages, queries


def arrived(packs, size):
    """The packs in cell order, as batches of ``size`` rows."""
    whole = pa.Table.from_batches(list(packs)).sort_by("cell")
    return iter(whole.to_batches(max_chunksize=size)) if size else iter(whole.combine_chunks().to_batches())


@pytest.mark.parametrize("size", [1, 7, None])
def test_packed_rows_come_back_by_cell(monkeypatch, size):
    monkeypatch.setattr(common, "PACK_ROWS", 900)
    rng = np.random.default_rng(5)
    rows = rng.integers(-(2**63), 2**63 - 1, (4000, 3))
    rows[:1500, 0] = -7  # more than a piece and a pack hold
    rng.shuffle(rows)
    parts = [rows[:0].T, *(rows[i : i + 333].T for i in range(0, len(rows), 333))]
    packs = list(common.pack(parts, 16))
    assert max(len(x) for b in packs for x in b.column(1).to_pylist()) <= 24 * common.PIECE_ROWS
    cells = list(common.unpack(arrived(packs, size), 3))
    keys = [set(c[0].tolist()) for c in cells]
    assert len(cells) == 16 and sum(map(len, keys)) == len(set().union(*keys))
    assert sorted(np.concatenate([np.stack(c, 1) for c in cells]).tolist()) == sorted(rows.tolist())
    assert list(common.pack([], 16)) == [] and list(common.unpack(iter([]), 3)) == []


@pytest.mark.parametrize("pack_rows", [10, 10_000])
def test_shared_seeds_in_one_pack_or_two(monkeypatch, pack_rows):
    monkeypatch.setattr(common, "PACK_ROWS", pack_rows)
    text = lambda a, n: " ".join(f"{a}{i}" for i in range(n))
    texts = [text("a", 60), text("b", 60), text("a", 60), text("c", 50), text("a", 60)]
    batch = lambda t, i: pa.RecordBatch.from_arrays([pa.array([i], pa.int64()), pa.array([t])], ["doc_id", "text"])
    seed = lambda t: set(pa.Table.from_batches(list(passages._seeds(40)(iter([batch(t, 0)])))).column(0).to_pylist())
    packs = passages._seed_cells(40, 8)(batch(t, i) for i, t in enumerate(texts))
    found = [s for b in passages._shared(arrived(packs, 3)) for s in b.column(0).to_pylist()]
    assert sorted(found) == sorted(seed(texts[0]))


def test_occurrences_are_taken_from_the_texts_once(spark):
    plan = paragraphs.repeated_paragraphs(docs(spark, hidden()))._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" not in plan


def test_query_shuffles_few_rows(spark):
    def moved():
        sc = spark.sparkContext
        sc._jsc.sc().listenerBus().waitUntilEmpty()
        stages = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), None)
        return {stages.apply(i).stageId(): stages.apply(i).shuffleWriteRecords() for i in range(stages.size())}

    words = sum(len(WORD.findall(r["text"] or "")) for r in spark.read.parquet(f"{SF}/documents.parquet").collect())
    before = moved()
    assert queries.op2_repeated_paragraphs(spark, SF).count() > 0
    assert 0 < sum(n for k, n in moved().items() if k not in before) < words / 3
