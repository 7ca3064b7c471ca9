"""Command line: ``python -m quern list``, ``run NAME FOLDER [--out DIR]``, ``explain NAME FOLDER``, ``check-config FILE``, ``check-record FILE`` (SUP-25)."""

from __future__ import annotations

import argparse

from quern.plans.catalogue import ORACLE_SQL, QUERIES
from quern.session import local_session


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="quern")
    sub = p.add_subparsers(dest="command", required=True)
    sub.add_parser("list")
    for name in ("run", "explain"):
        q = sub.add_parser(name)
        q.add_argument("query", choices=sorted(QUERIES))
        q.add_argument("folder")
        q.add_argument("--out")
    for name in ("check-config", "check-record"):
        sub.add_parser(name).add_argument("file")
    a = p.parse_args(argv)
    if a.command == "list":
        for name in sorted(QUERIES):
            print(name, "(SQL twin)" if name in ORACLE_SQL else "", (QUERIES[name].__doc__ or "").split("\n")[0])
        return 0
    if a.command == "check-config":
        from quern.sources.config import load

        c = load(a.file)
        print(f"{len(c.usable_sources())} of {len(c.sources)} sources usable")
        return 0
    if a.command == "check-record":
        from pyspark.sql import functions as F

        from quern.functions import text
        from quern.operators import comparables, identity
        from quern.sources.feeds import read_record

        one = identity.identify(read_record(local_session(), a.file), "title", "description", normalize=text.normalize_text_exact)
        norm = text.normalize_text(F.coalesce("title", F.lit("")))
        print(one.select(F.to_json(F.struct("identity", comparables.prefilter(norm, F.col("identity.audience"), F.col("price_czk"), F.lit(False)).alias("prefilter")))).first()[0])
        return 0
    df = QUERIES[a.query](local_session(), a.folder)
    if a.command == "explain":
        df.explain("formatted")
    elif a.out:
        from quern.sources.sinks import write_report

        write_report(df, a.out)
    else:
        df.show(50, truncate=80)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
