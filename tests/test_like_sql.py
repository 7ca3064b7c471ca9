"""Queries against their SQL over made tables that the supplied ones of sf0.001 don't have."""

import duckdb
import pytest

from quern.plans.catalogue import ORACLE_SQL, QUERIES
from tests.test_oracles import rows_of


def check(spark, folder, name, **tables):
    """The query's rows, which are those of its SQL, over ``tables`` (table=(schema, rows))."""
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for table, (schema, rows) in tables.items():
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("overwrite").parquet(f"{folder}/{table}.parquet")
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{folder}/{table}.parquet/*.parquet')")
    df = QUERIES[name](spark, str(folder))
    want = con.execute(ORACLE_SQL[name]).df().astype(object).where(lambda x: x.notna(), None).to_dict("records")
    got = [r.asDict() for r in df.collect()]
    assert rows_of(sorted(df.columns), got) == rows_of(sorted(df.columns), want)
    return got


@pytest.mark.parametrize("price,size,want", [(900.0, 10, 9400), (900.0, 4, 14800), (900.0, 15, 14800), (900.0, 12, None), (900.0, 18, 14800)])
def test_depreciation_of_a_tie(spark, tmp_path, price, size, want):
    got = check(spark, tmp_path, "depreciation", part=("p_partkey long, p_size int, p_retailprice double", [(1, size, price)]))
    assert got[0]["price"] == want


def test_score_of_a_customer_without_orders(spark, tmp_path):
    orders = ("o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double", [(1, 1, "F", 1000.0), (2, 3, "O", None)])
    customers = ("c_custkey long, c_acctbal double", [(1, 500.0), (2, 7097.2), (3, -1.0), (4, None)])
    got = check(spark, tmp_path, "weighted_mean_renorm", customer=customers, orders=orders)
    assert {r["c_custkey"]: r["score"] for r in got}[2] == 86.805455


def test_normalised_texts_with_runs_of_every_kind(spark, tmp_path):
    said = ["1,5 a-b – c,d", " , lead", "trail ,- ", "a\t\nb", "x  y", "–", "", "1,2,3,4", "Ünï ß ’q’ 日本 z", "a,,b", "9 ,9", "\x00a\x00\x00", "a   b"]
    documents = ("doc_id long, text string, source string", [(n, t, "s" if n % 2 else None) for n, t in enumerate(said)])
    check(spark, tmp_path, "text_fingerprint", documents=documents)
    check(spark, tmp_path, "text_normalize", documents=documents)


def test_heavy_rows_of_one_file_are_spread(spark, tmp_path):
    for name in ("text_fingerprint", "text_normalize", "offer_identities"):
        assert QUERIES[name](spark, "/root/testdata/sf0.001").rdd.getNumPartitions() == spark.sparkContext.defaultParallelism, name
    plan = QUERIES["text_fingerprint"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("translate(") == 1, "the text is normalised once"


def test_repeated_texts_are_compared_once(spark, monkeypatch):
    import itertools

    import pandas as pd

    from quern.functions import text
    from quern.operators import comparables

    calls, ratio = [], text._ratio
    monkeypatch.setattr(text, "_ratio", lambda *a: calls.append(a) or ratio(*a))
    assert text._ratios(pd.Series(["a b c", "a b c", "d"]), pd.Series(["a b", "a b", "d"]), True).tolist() == [1.0, 1.0, 1.0] and len(calls) == 2
    identity = "generation string, model_year int, wheel_size string, frame_size string, trim string, bike_type string, electric boolean, audience string, brand string, model string"
    who = [("", 2020, "29", "", "Pro", "", None, "", "Trek", "Marlin"), ("Gen 2", None, "29", "", "pro", "", False, "", "TREK", "marlin"), ("-", 2021, "29", "", "", "", True, "", "trek", "Marlin")]
    rows = [(k, "abc"[k % 3], 100 if k % 7 else 0, who[k % len(who) if k % 2 else 0], "Trek Marlin", ["x y z", "x y z w", None][k % 5 % 3]) for k in range(60)]
    df = spark.createDataFrame(rows, f"key int, source string, price int, identity struct<{identity}>, title string, description string")
    got = {(r["a"], r["b"]): tuple(r)[2:] for r in comparables.duplicate_pairs(df).collect()}
    assert set(got) == {(a[0], b[0]) for a, b in itertools.combinations(rows, 2) if a[1] != b[1] and a[2] and b[2]}
    for a, b in itertools.combinations(rows, 2):
        if (a[0], b[0]) in got:
            whole = text._ratio(a[5] or "", b[5] or "", False)
            clash = any(x and y and str(x).lower() != str(y).lower() for x, y in zip(a[3][:8], b[3][:8], strict=True) if {x, y} & {2020, 2021}) or {a[3][0], b[3][0]} == {"Gen 2", "-"} or {a[3][6], b[3][6]} == {True, False}
            assert got[a[0], b[0]][2] == (0.0 if clash else whole)


@pytest.mark.parametrize("part", [1, 3, 1024])
def test_tiles_of_any_size_give_all_pairs(spark, part):
    import itertools

    from quern.operators import tiles
    from quern.operators.components import connected_components

    said = ["a b c d e f g", "a b c d e f x", "", "a b c d e f g", "q r s", " "]
    rows = [(n, f"s{n % 3}" if n % 11 else None, said[n % 7 % 6], n % 2 if n % 13 else None) for n in range(60)]
    df = spark.createDataFrame(rows, "id long, source string, t string, block int")
    words = [{w for w in r[2].split(" ") if w} for r in rows]
    want = {}
    for x, y in itertools.combinations(range(60), 2):
        if rows[x][1] and rows[y][1] and rows[x][1] != rows[y][1] and rows[x][3] is not None and rows[x][3] == rows[y][3]:
            least = min(len(words[x]), len(words[y]))
            want[x, y] = len(words[x] & words[y]) / least if least else 0.0
    got = tiles.overlap_pairs(df, ["block"], "id", "source", "t", part).collect()
    assert len(got) == len(want) and {(r["a"], r["b"]): r["s"] for r in got} == want
    edges = tiles.overlap_edges(df, ["block"], "id", "source", "t", 0.85, 0.95, part)
    near = spark.createDataFrame([k for k, s in want.items() if s >= 0.85], "a long, b long")
    parts = lambda e: {tuple(r) for r in connected_components(e).collect()}
    assert parts(edges) == parts(near)
    assert part < 1024 or edges.count() < len(rows) < near.count()


def test_ratio_is_difflibs():
    import difflib
    import random

    from quern.functions.text import matching_ratio

    pick = random.Random(5)
    for _ in range(600):
        a, b = ("".join(pick.choice("abcde xyz"[: pick.randint(1, 9)]) for _ in range(pick.choice([0, 1, 5, 30, 199, 200, 201, 260]))) for _ in "12")
        assert matching_ratio(a, b) == difflib.SequenceMatcher(None, a, b).ratio()


def test_pairs_of_unknown_texts_stay(spark, tmp_path):
    documents = [(n, "en", f"s{n % 2}", 5, [None, "", "a b c", "a b d"][n % 4]) for n in range(12)]
    spark.createDataFrame(documents, "doc_id long, lang string, source string, n_chars int, text string").write.parquet(f"{tmp_path}/documents.parquet")
    for name in ("seq_ratio_pairs", "dup_pairs_blocked"):
        rows = QUERIES[name](spark, str(tmp_path)).collect()
        assert len(rows) == 36 and {r["similarity"] == 0.0 for r in rows if documents[r[0]][4] is None} == {True}
