"""Every query with an SQL twin gives DuckDB's rows; the others give some."""

import datetime
import decimal

import pytest

from quern.plans.catalogue import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"


def plain(v):
    if isinstance(v, float):
        return "nan" if v != v else round(v, 6)
    if isinstance(v, decimal.Decimal):
        return ("decimal", str(v.normalize()))
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    return v


def rows_of(columns, rows):
    return sorted((tuple(plain(r[c]) for c in columns) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    got = [r.asDict() for r in df.collect()]
    if name not in ORACLE_SQL:
        assert df.columns
        return
    cur = duck.execute(ORACLE_SQL[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == sorted(df.columns)
    want = [dict(zip(names, r, strict=True)) for r in cur.fetchall()]
    assert rows_of(sorted(names), got) == rows_of(sorted(names), want)
