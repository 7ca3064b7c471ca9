import random

import numpy as np
import pyarrow as pa
import pytest
from conftest_paths import SF
from edge import docs
from test_duplicates import WORD

from quern.llm import passages, queries


def brute(rows, least):
    """{(doc, first word of a window)} of the windows that stand in two places, and those that don't come first."""
    at = {}
    for k, t in rows:
        w = WORD.findall((t or "").lower())
        for i in range(len(w) - least + 1):
            at.setdefault(tuple(w[i : i + least]), []).append((k, i))
    several = [sorted(x) for x in at.values() if len(x) > 1]
    return {o for x in several for o in x}, {o for x in several for o in x[1:]}


def covered(found, least, gone=False):
    return {(r["doc_id"], i) for r in found if r["removed"] or not gone for i in range(r["first_word"], r["first_word"] + r["words"] - least + 1)}


def hidden(seed=1):
    """Passages of 50 words inside one differing line, over line breaks and wrapped into short lines; one of 39."""
    rng = random.Random(seed)
    fill = lambda n: [f"{rng.choice('abcdefgh')}{rng.randrange(10**6)}" for _ in range(n)]
    inside, broken, short = fill(50), fill(60), fill(39)
    wrap = lambda w, n: "\n".join(" ".join(w[i : i + n]) for i in range(0, len(w), n))
    texts = [fill(90) + inside + fill(80), fill(70) + inside + fill(20), fill(30) + broken, broken, fill(60) + short, short + fill(60)]
    rows = [(i, " ".join(t), "en", "s", 1) for i, t in enumerate(texts)]
    rows[3] = (3, wrap(texts[3], 7), "en", "s", 1)
    return [*rows, (None, rows[0][1], "en", "s", 1), (10, None, "en", "s", 1), (11, "", "en", "s", 1)]


@pytest.mark.parametrize("most", [8_000_000, 0])
def test_passages_inside_lines_and_over_breaks(spark, monkeypatch, most):
    monkeypatch.setattr(passages, "MAX_BROADCAST_SEEDS", most)
    got = {(r["doc_id"], r["first_word"], r["words"], r["cluster_doc"], r["cluster_first_word"], r["removed"]) for r in passages.repeated_passages(docs(spark, hidden())).collect()}
    assert got == {(0, 90, 50, 0, 90, False), (1, 70, 50, 0, 90, True), (2, 30, 60, 2, 30, False), (3, 0, 60, 2, 30, True)}


def test_query_has_them(spark, tmp_path):
    docs(spark, hidden(), extra=False).write.parquet(f"{tmp_path}/documents.parquet")
    rows = queries.op2_repeated_paragraphs(spark, str(tmp_path)).collect()
    assert {r["doc_id"] for r in rows if r["removed"]} == {1, 3}


def test_passages_equal_brute_force(spark):
    d = spark.read.parquet(f"{SF}/documents.parquet")
    want, gone = brute([(r["doc_id"], r["text"]) for r in d.collect()], passages.MIN_WORDS)
    found = passages.repeated_passages(d).collect()
    assert len(want) > 1000 and covered(found, passages.MIN_WORDS) == want and covered(found, passages.MIN_WORDS, True) == gone


def test_passage_edges(spark):
    assert passages.repeated_passages(docs(spark, [])).collect() == []
    text = " ".join(f"w{i}" for i in range(60))
    rows = passages.repeated_passages(docs(spark, [(1, text, "en", "s", 1), (1, text, "en", "s", 1)])).collect()
    assert rows == []


@pytest.mark.parametrize("size", [1, 2, 5, 1000])
def test_batches_dont_matter(size):
    rng = np.random.default_rng(size)
    rows = np.array(sorted({tuple(x) for x in rng.integers(0, 6, (150, 3)).tolist()}) * 2)
    rows = rows[np.lexsort(rows.T[::-1])]

    def run(n):
        parts = [pa.RecordBatch.from_arrays([pa.array(c) for c in rows[i : i + n].T], ["window", "doc_id", "place"]) for i in range(0, len(rows), n)]
        heads = pa.Table.from_batches(list(passages._heads(iter(parts)))).to_pylist()
        ordered = sorted(tuple(h.values()) for h in heads)
        back = [pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*ordered[i : i + n], strict=True)], ["doc_id", "head", "shift", "place", "head_place"]) for i in range(0, len(ordered), n)]
        return ordered, sorted(tuple(r.values()) for r in pa.Table.from_batches(list(passages._spans(1)(iter(back)))).to_pylist())

    heads, spans = run(size)
    first = {}
    for w, d, p in rows.tolist():
        first.setdefault(w, []).append((d, p))
    want = sorted((d, min(x)[0], p - min(x)[1], p, min(x)[1]) for x in first.values() if len(set(x)) > 1 for d, p in set(x))
    assert heads == want and (heads, spans) == run(10**6)
