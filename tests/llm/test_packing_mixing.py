import hashlib
import math
from collections import Counter

import numpy as np
import pytest
from edge import LONG, docs
from hypothesis import given, settings
from hypothesis import strategies as st

from quern.llm import mixing, packing


def fill(runs):
    bins, placed = {}, Counter()
    for length, first, n, first_bin, per, offset in runs:
        for j in range(n):
            b = first_bin + j // per
            bins.setdefault(b, []).append((offset + length * (j % per), length))
        placed[length] += n
    return bins, placed


def brute(lengths, capacity):
    """The same method piece by piece: number of bins."""
    large = sorted((x for x in lengths if 3 * x > capacity), reverse=True)
    rooms = []
    while large:
        a = large.pop(0)
        fit = [i for i, b in enumerate(large) if a + b <= capacity]
        b = large.pop(fit[0]) if fit else 0
        rooms.append(capacity - a - b)
    for s in sorted((x for x in lengths if 3 * x <= capacity), reverse=True):
        fit = [(r, i) for i, r in enumerate(rooms) if r >= s]
        if fit:
            rooms[min(fit)[1]] -= s
        else:
            rooms.append(capacity - s)
    return sorted(rooms)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(1, 30), max_size=80))
def test_plan_is_best_fit(lengths):
    bins, placed = fill(packing.plan(dict(Counter(lengths)), 30))
    assert placed == Counter(lengths)
    rooms = []
    for pieces in bins.values():
        pieces.sort()
        assert all(a + n == b for (a, n), (b, _) in zip(pieces, pieces[1:])) and pieces[0][0] == 0
        total = sum(n for _, n in pieces)
        assert total <= 30 and sum(3 * n > 30 for _, n in pieces) <= 2
        rooms.append(30 - total)
    assert sorted(bins) == list(range(len(bins)))
    assert sorted(rooms) == brute(lengths, 30)


def test_pack_round_trip_and_edges(spark):
    rows = packing.pack(docs(spark), capacity=64).collect()
    assert sum(r["words"] for r in rows if r["doc_id"] == 4) == len(LONG.split())
    assert "".join(r["text"] for r in sorted((r for r in rows if r["doc_id"] == 4), key=lambda r: r["piece"])) == LONG
    assert {r["doc_id"] for r in rows if r["bin_id"] is None} == {None, 1, 2, 3}
    assert sum(r["doc_id"] == 6 for r in rows) == 2
    bins = {}
    for r in rows:
        if r["bin_id"] is not None:
            bins.setdefault(r["bin_id"], []).append((r["bin_offset"], r["words"]))
    for pieces in bins.values():
        pieces.sort()
        assert pieces[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(pieces, pieces[1:])) and sum(n for _, n in pieces) <= 64
    assert packing.pack(docs(spark, []), capacity=64).collect() == []


def test_pack_needs_as_many_bins_as_piece_by_piece(spark):
    rng = np.random.default_rng(4)
    lengths = [int(x) for x in rng.integers(0, 90, 400)]
    rows = [(i, "w " * n, "en", "s", n) for i, n in enumerate(lengths)]
    for salt in (packing.WORDS_A_SALT, 200):  # many salts a length give the same bins
        got = packing.pack(docs(spark, rows), capacity=64, words_a_salt=salt).collect()
        pieces = [p for n in lengths for p in [64] * (n // 64) + [n % 64] if p]
        rooms = Counter()
        for r in got:
            if r["bin_id"] is not None:
                rooms[r["bin_id"]] += r["words"]
        assert sorted(64 - x for x in rooms.values()) == brute(pieces, 64)
        assert len(got) == len(pieces) + lengths.count(0)


def test_mix_means_and_edges(spark):
    rows = [(i, f"t{i}", "en", "big" if i % 10 else "small", 10) for i in range(4000)]
    weights = spark.createDataFrame([("big", 0.5), ("small", 0.5)], "source string, weight double")
    out = mixing.mix(docs(spark, rows, extra=False), weights, detail=True).toPandas()
    n = out.groupby("source").size()
    assert abs(n["big"] - 2000) < 200 and abs(n["small"] - 2000) < 250
    assert out.groupby("doc_id").replica.max().sum() == len(out)
    again = mixing.mix(docs(spark, rows, extra=False), weights, detail=True).toPandas()
    assert sorted(out.shuffle_key) == sorted(again.shuffle_key)
    d = docs(spark)
    e = mixing.mix(d)
    assert e.columns == d.columns
    assert mixing.mix(docs(spark, [])).collect() == []


def draws(keys, rate):
    """Copies of each draw key by inverting the distribution in plain Python."""
    out = []
    for key in keys:
        u, n, p = int(hashlib.md5(f"{mixing.SEED}:{key}".encode()).hexdigest()[:13], 16) / 2**52, 0, math.exp(-rate)
        total = p
        while total <= u:
            n += 1
            p *= rate / n
            total += p
        out.append(n)
    return out


def test_mix_equals_plain_python_and_edges(spark):
    """NULL id draws by its text, NULL size is 0, a source of size 0 or less keeps rate 1, repeated ids draw the same."""
    rows = [(None, "no id", "en", "a", 10), (1, "x", "en", "a", 30), (1, "y", "en", "a", None), (2, "z", "en", None, 10), (3, "w", "en", "zero", 0), (4, "v", "en", "minus", -5)] + [(10 + i, "t", "en", "b", 1) for i in range(40)]
    sizes = {"a": 40, None: 10, "zero": 0, "minus": -5, "b": 40}
    live = {k: v**0.5 for k, v in sizes.items() if v > 0}
    rate = {k: live[k] * sum(sizes.values()) / (sum(live.values()) * v) if v > 0 else 1.0 for k, v in sizes.items()}
    want = Counter()
    for i, t, _, src, _ in rows:
        want[(i, t)] += draws([hashlib.md5(t.encode()).hexdigest() if i is None else i], rate[src])[0]
    got = Counter((r["doc_id"], r["text"]) for r in mixing.mix(docs(spark, rows)).collect())
    assert got == +want


@pytest.mark.parametrize("rate", [0.1, 1.0, 7.5, 900.0])
def test_inverse_table_is_poisson(spark, rate):
    steps = np.array(mixing.inverse_tables(spark.createDataFrame([("s", rate)], "source string, rate double")).first()["steps"])
    mean = (1 - np.append(0, steps[:-1])).sum() - 1 + 0  # E X = sum over k of P(X > k)
    assert abs((1 - steps[:-1]).sum() - rate) < 1e-6 * max(1, rate) and abs(steps[-1] - 1) < 1e-9 and mean >= 0


def test_weights_unknown_source_gets_none(spark):
    d = docs(spark, [(i, "x", "en", "a" if i < 50 else None, 1) for i in range(100)], extra=False)
    w = spark.createDataFrame([("a", 1.0)], "source string, weight double")
    assert {r["source"] for r in mixing.mix(d, w).collect()} == {"a"}
