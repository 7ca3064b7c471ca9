import math
from collections import Counter
from pathlib import Path

import corpus_pipeline
import numpy as np
import pyarrow as pa
import pytest
from conftest_paths import SF
from edge import docs
from test_duplicates import brute_groups, triples
from test_packing_mixing import brute, draws
from test_pii_inside import plain_bootstrap

from quern.llm import kernels as K
from quern.llm import perplexity
from quern.llm.queries import ORACLE_SQL, QUERIES
from quern.session import ensure_checkpoint_dir


def test_every_operator_has_a_query():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 11))


def test_stages_over_edge_rows(spark, tmp_path):
    d = docs(spark)
    columns = d.columns
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, d, SF).write.parquet(f"{tmp_path}/{i}")
        d = spark.read.parquet(f"{tmp_path}/{i}")
        if i < len(corpus_pipeline.STAGES) - 1:
            assert d.columns == columns
    assert "bin_id" in d.columns


def test_run_and_effects(spark):
    rows = corpus_pipeline.run(spark, SF).collect()
    assert rows and not any("@mail" in (r["text"] or "") for r in rows)
    bins = {}
    for r in rows:
        bins[r["bin_id"]] = bins.get(r["bin_id"], 0) + r["words"]
    assert max(bins.values()) <= 2048


def test_oracles_over_small_tables(spark, duck):
    for name, sql in ORACLE_SQL.items():
        df = QUERIES[name](spark, SF)
        cur = duck.execute(sql)
        names = [c[0] for c in cur.description]
        assert sorted(names) == sorted(df.columns)
        want = sorted((repr(tuple(r[names.index(c)] for c in sorted(names))) for r in cur.fetchall()))
        got = sorted(repr(tuple(r[c] for c in sorted(names))) for r in df.collect())
        assert got == want


def brute_quality(spark, rows, labels):
    """(doc_id, text) that stay, from a model counted in numpy and bands by the definitions of ``perplexity``."""
    scorers, rate, size = {}, {}, {}
    for lang in {r["lang"] or "" for r in rows}:
        data, off = K.utf8_view(pa.array([r["text"] or "" for r in rows if (r["lang"] or "") == lang]))
        keys, counts = np.unique(K.ngram_keys(perplexity.fold(data), off, perplexity.ORDER), return_counts=True)
        scorers[lang] = perplexity.Scorer(perplexity.kneser_ney(keys, counts, perplexity.ORDER))
    for i, r in enumerate(rows):
        data, off = K.utf8_view(pa.array([r["text"] or ""]))
        size[i] = len((r["text"] or "").split())
        if size[i]:
            rate[i] = float(scorers[r["lang"] or ""].bits(K.ngram_keys(perplexity.fold(data), off, perplexity.ORDER)).astype(float).sum()) / size[i]
    good = {r["doc_id"] for r in labels if r["quality"] == 1}
    cls = {i: min(int(math.log2(n)), 20) for i, n in size.items() if n}
    known = [i for i in rate if rows[i]["doc_id"] in good]
    bands = {}
    for lang in {rows[i]["lang"] or "" for i in known} | {None}:
        mine = [i for i in known if lang in (None, rows[i]["lang"] or "")]
        for c in range(21):
            some = [rate[i] for i in mine if cls[i] == c]
            if len(some) >= perplexity.MIN_LABELS_IN_CLASS:
                bands[lang, c] = (np.quantile(some, perplexity.TAIL) - perplexity.SLACK_BITS, np.quantile(some, 1 - perplexity.TAIL) + perplexity.SLACK_BITS)
    mean = np.mean([rate[i] for i in known])
    x, gap = np.array([2.0 ** -cls[i] for i in known]), np.array([(rate[i] - mean) ** 2 for i in known])
    slope, base = np.polyfit(x, gap, 1)
    slope, base = max(slope, 0.0), max(base, 0.1 * gap.mean(), 0.01)

    def band(lang, c):
        if not any(rows[i]["lang"] == lang for i in known):
            lang = None
        if (lang, c) in bands or (None, c) in bands:
            return bands.get((lang, c)) or bands[None, c]
        wide = perplexity.DEVIATIONS * math.sqrt(base + slope * 2.0**-c) + perplexity.SLACK_BITS
        centre = np.mean([rate[i] for i in known if lang in (None, rows[i]["lang"] or "")])
        return centre - wide, centre + wide

    low_high = {i: band(rows[i]["lang"] or "", cls[i]) for i in rate}
    near = {i for i in rate if min(abs(rate[i] - x) for x in low_high[i]) < 1e-3}  # sums of float32 may fall to either side
    return [i for i in rate if low_high[i][0] <= rate[i] <= low_high[i][1]], near


def test_each_stage_equals_brute_force(spark, tmp_path):
    """Every stage over all that its predecessor kept of sf0.001, against plain Python on the same rows."""
    labels = spark.read.parquet(f"{SF}/labels.parquet").collect()
    d = spark.read.parquet(f"{SF}/documents.parquet")
    steps = []
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        before = d.collect()
        stage(spark, d, SF).write.parquet(f"{tmp_path}/{i}")
        d = spark.read.parquet(f"{tmp_path}/{i}")
        steps.append((before, d.collect()))
    # quality rules
    before, after = steps[0]
    want, near = brute_quality(spark, before, labels)
    ids = {before[i]["doc_id"] for i in want}
    assert {r["doc_id"] for r in after} ^ ids <= {before[i]["doc_id"] for i in near} and len(ids) < len(before)
    # near duplicates: one of each group stays
    before, after = steps[1]
    sets = {r["doc_id"]: triples(r["text"]) for r in before}
    kept = {r["doc_id"] for r in after}
    groups, pairs = brute_groups([(r["doc_id"], r["text"]) for r in before], 0.55)
    loose, _ = brute_groups([(r["doc_id"], r["text"]) for r in before], 0.4)
    assert len(after) == len(kept) and kept <= set(sets)
    for a, b in pairs:  # surely alike: at most one of the two
        assert len({a, b} & kept) < 2
    for k in set(sets) - kept:  # surely unlike: what goes has a like that stays
        assert any(loose.get(o) == loose[k] for o in kept)
    # personal data
    before, after = steps[2]
    spans, _ = plain_bootstrap([(r["doc_id"], r["text"] or "") for r in before])
    found = {}
    for k, a, b, kind, _ in spans:
        found.setdefault(k, []).append((a, b, kind))
    got = {r["doc_id"]: r for r in after}
    for r in before:
        out, edge = "", 0
        for a, b, kind in sorted(found.get(r["doc_id"], [])):
            out, edge = out + r["text"][edge:a] + f"[{kind.upper()}]", b
        assert got[r["doc_id"]]["text"] == out + r["text"][edge:] and got[r["doc_id"]]["n_chars"] == len(got[r["doc_id"]]["text"])
    assert len(after) == len(before)
    # mixing
    before, after = steps[3]
    size = Counter()
    for r in before:
        size[r["source"]] += r["n_chars"]
    root = {s: n**0.5 for s, n in size.items()}
    want = Counter()
    for r in before:
        want[r["doc_id"]] = draws([r["doc_id"]], root[r["source"]] * sum(size.values()) / (sum(root.values()) * size[r["source"]]))[0]
    assert Counter(r["doc_id"] for r in after) == +want
    # packing
    before, after = steps[4]
    lengths = [len(r["text"].split()) for r in before]
    pieces = [p for n in lengths for p in [2048] * (n // 2048) + [n % 2048] if p]
    rooms = Counter()
    for r in after:
        if r["bin_id"] is not None:
            rooms[r["bin_id"]] += r["words"]
    assert sorted(2048 - x for x in rooms.values()) == brute(pieces, 2048)
    assert Counter(w for r in after for w in r["text"].split()) == Counter(w for r in before for w in r["text"].split())


def test_run_without_labels_and_after_a_failure(spark, tmp_path, monkeypatch):
    import shutil

    data = tmp_path / "data"
    data.mkdir()
    shutil.copytree(f"{SF}/documents.parquet", data / "documents.parquet") if (Path(SF) / "documents.parquet").is_dir() else shutil.copy(f"{SF}/documents.parquet", data)
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{data}/labels.parquet")
    assert corpus_pipeline.run(spark, str(data)).count() > 0  # nothing is judged, the other stages work
    folder = ensure_checkpoint_dir(spark).removeprefix("file:")
    there = lambda: {p.name for p in Path(folder).glob("pipeline-*")}
    before = there()
    monkeypatch.setattr(corpus_pipeline, "STAGES", [*corpus_pipeline.STAGES[:1], ("broken", lambda *_: 1 / 0), *corpus_pipeline.STAGES[1:]])
    with pytest.raises(ZeroDivisionError):
        corpus_pipeline.run(spark, str(data))
    assert there() == before
