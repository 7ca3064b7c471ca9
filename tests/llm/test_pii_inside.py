import math
from collections import Counter

import pytest
from conftest_paths import SF
from edge import docs

from quern.llm import pii


def values(text):
    runs = next((r for _, r, _ in pii._marked_runs(pii.pa.array([text]))), [])
    return [(seed, value) for _, _, value, _, seed, _ in pii.candidates(text, runs) if seed not in ("", pii.NOT)]


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("write (jo@x.com) soon", [("email", "jo@x.com")]),
        ("at (192.168.1.1) or", [("ip", "192.168.1.1")]),
        ("to a@x.com,b@y.com and", [("email", "a@x.com"), ("email", "b@y.com")]),
        ("on 192.168.1.1:8080 and http://192.168.1.1/ too", [("ip", "192.168.1.1")] * 2),
        ("IP 192.168.10.12 443 open", [("ip", "192.168.10.12")]),
        ("call +1 (017) 555-7713 2024 now", [("phone", "+1 (017) 555-7713")]),
        ("card 4111111111111111 737 ok", [("card", "4111111111111111")]),
        ("card 4111 1111 1111 1111 737 ok", [("card", "4111 1111 1111 1111")]),
        ("iban DE89 3704 0044 0532 0130 00 due", [("iban", "DE89 3704 0044 0532 0130 00")]),
        ("iban GB82 WEST 1234 5698 7654 32.", [("iban", "GB82 WEST 1234 5698 7654 32")]),
        ("Number 10.0.0.300 and 1.2.3.4.5 and v1.2.3.4", []),
    ],
)
def test_identifiers_beside_others(text, want):
    assert values(text) == want


def test_both_paths_redact_them(spark, monkeypatch):
    d = docs(spark, [(1, "mail (jo@x.com), iban GB82 WEST 1234 5698 7654 32.", "en", "s", 1)])
    want = "mail ([EMAIL]), iban [IBAN]."
    assert pii.redact(d).first()["text"] == want
    monkeypatch.setattr(pii, "MAX_BROADCAST_PATTERNS", -1)
    assert pii.redact(d).first()["text"] == want


def plain_bootstrap(rows):
    """The bootstrap of ``pii`` with dictionaries: {(doc_id, start, end): (kind, how)}, and the accepted patterns."""
    found = []
    for k, t in rows:
        for runs in [r for _, r, _ in pii._marked_runs(pii.pa.array([t]))]:
            found += [(k, *c) for c in pii.candidates(t, runs)]
    marks, seeds = {}, {}
    for _, _, _, value, _, seed, patterns in found:
        for m in patterns:
            marks.setdefault(value, set()).add(m)
            seeds[value, m] = max(seeds.get((value, m), ""), seed)
    edges = sorted((v, m) for v, ms in marks.items() for m in ms)
    real = lambda s: s not in ("", pii.NOT)

    def most(pairs):  # pattern -> the kind that most of its instances have
        n = Counter(pairs)
        return {m: max((c, kind) for (mm, kind), c in n.items() if mm == m)[1] for m, _ in n}

    own = most((m, seeds[v, m]) for v, m in edges if real(seeds[v, m]))
    belief = {v: max(float(real(seeds[v, m])) for m in marks[v]) for v in marks}
    names = own
    for step in range(pii.ROUNDS):
        sums = {}
        for v, m in edges:
            b, n = sums.get(m, (0.0, 0))
            sums[m] = (b + belief[v], n + 1)
        scores = {m: (b / (n + 0.5), names[m]) for m, (b, n) in sums.items() if b / (n + 0.5) >= pii.MIN_CONFIDENCE and n >= pii.MIN_SUPPORT and m in names}
        if step == pii.ROUNDS - 1:
            break
        learned, after = [], {}
        for v, ms in marks.items():
            state = max(-1 if seeds[v, m] == pii.NOT else int(real(seeds[v, m])) for m in ms)
            hits = [scores[m] for m in ms if m in scores]
            given = 1 - math.prod(max(1 - c, 1e-9) for c, _ in hits)
            after[v] = 1.0 if state > 0 else 0.0 if state < 0 else given if given >= pii.MIN_BELIEF else 0.0
            if given >= pii.MIN_BELIEF and hits and state >= 0:
                learned += [(m, max(hits)[1]) for m in ms]
        belief, names = after, most(learned) | own
    out = []
    for k, a, b, _, _, seed, patterns in found:
        hits = [scores[m] for m in patterns if m in scores]
        given = 1 - math.prod(max(1 - c, 1e-9) for c, _ in hits)
        if seed != pii.NOT and (seed or hits and given >= pii.MIN_BELIEF):
            out.append((k, a, b, seed or max(hits)[1], "seed" if seed else "pattern"))
    return sorted(out), scores


def test_query_equals_plain_bootstrap(spark):
    rows = [(r["doc_id"], r["text"] or "") for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    digest = lambda i: f"{(i * 104729 + 7) * 2654435761 % 2**64:016x}a1b2"
    rows += [(10_000 + i, f"note please set password={digest(i)} and go on") for i in range(30)] + [(11_000 + i, f"credential={digest(1000 + i)} was lost") for i in range(5)]
    rows += [(12_000, rows[-1][1])] * 2  # repeated rows are found each
    d = docs(spark, [(k, t, "en", "s", 1) for k, t in rows], extra=False)
    want, scores = plain_bootstrap(rows)
    got = sorted((r["doc_id"], r["start"], r["end"], r["kind"], r["how"]) for r in pii.find(d).collect())
    assert got == want and any(x[4] == "pattern" for x in want)
    patterns = {r["pattern"]: (r["confidence"], r["kind"]) for r in pii.bootstrap(pii.find_candidates(d)).collect()}
    assert patterns.keys() == scores.keys() and all(patterns[m][1] == scores[m][1] and patterns[m][0] == pytest.approx(scores[m][0]) for m in scores)


def test_redaction_by_join_with_clashing_names(spark, monkeypatch):
    from pyspark.sql import functions as F

    d = docs(spark, [(1, "mail jo@x.com", "en", "s", 1)]).withColumn("_row", F.lit("r")).withColumn("_spans", F.lit("s"))
    monkeypatch.setattr(pii, "MAX_BROADCAST_PATTERNS", -1)
    row = pii.redact(d).first()
    assert (row["text"], row["_row"], row["_spans"]) == ("mail [EMAIL]", "r", "s")


def test_context_finds_unseen_shapes(spark):
    seen = [(i, f"for help please call +1 (953) 555-{6000 + 7 * i} at noon", "en", "s", 1) for i in range(30)]
    unseen = [(100, "please call 555-123-4567 at noon", "en", "s", 1), (101, "or call 017.555.7713 today", "en", "s", 1)]
    clean = [(200 + i, f"in version {i} of 20{i:02d} there were 3 of 4.0 and we call 3 of them", "en", "s", 1) for i in range(20)]
    rows = pii.find(docs(spark, seen + unseen + clean)).collect()
    assert {(r["doc_id"], r["kind"]) for r in rows if r["how"] == "pattern"} == {(100, "phone"), (101, "phone")}
    assert not {r["doc_id"] for r in rows} & {200 + i for i in range(20)}


def test_secrets_without_a_digit(spark):
    d = docs(spark, [(1, "set password=correcthorse now", "en", "s", 1), (2, "the api_key: AbCdEfGhIjKl is", "en", "s", 1), (3, "see https://example.com/about: all is well", "en", "s", 1)])
    assert [r["text"] for r in pii.redact(d).orderBy("doc_id").collect()] == ["set password=[SECRET] now", "the api_key: [SECRET] is", "see https://example.com/about: all is well"]
    assert {(r["doc_id"], r["kind"], r["how"]) for r in pii.find(d).collect()} == {(1, "secret", "seed"), (2, "secret", "seed")}
