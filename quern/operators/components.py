"""Connected components of an edge table (AG-18) and group identifiers (AG-19).

Edges are contracted inside each partition first (a union-find per partition
replaces any local subgraph by a star), then by alternating large-star and
small-star rounds, which need a logarithmic number of rounds and never hold a
component in one place.  Each round is cut to the shared checkpoint folder.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.session import cut


def _stars(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    root: dict = {}

    def find(x):
        top = x
        while (up := root.get(top, top)) != top:
            top = up
        while x != top:
            root[x], x = top, root.get(x, x)
        return top

    for f in frames:
        for a, b in zip(f["a"].tolist(), f["b"].tolist(), strict=True):
            a, b = find(a), find(b)
            if a != b:
                low, high = (a, b) if a < b else (b, a)
                root[high] = low
                root.setdefault(low, low)
    ids = [x for x in root if find(x) != x]
    if ids:
        yield pd.DataFrame({"a": ids, "b": [find(x) for x in ids]})


def _large_star(e: DataFrame) -> DataFrame:
    both = e.select("a", "b").unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    return both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(e: DataFrame) -> DataFrame:
    low = e.groupBy("a").agg(F.min("b").alias("m"))
    rest = e.join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return rest.unionByName(low.select("a", F.col("m").alias("b"))).distinct()


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """(id, component) for every node of an edge; the component is its least id.

    NULL ends and loops are ignored; repeated edges do no harm; no edges give no rows.
    """
    clean = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a IS NOT NULL AND b IS NOT NULL AND a <> b")
    nodes = clean.schema["a"].dataType.simpleString()
    star = cut(clean.mapInPandas(_stars, f"a {nodes}, b {nodes}"))
    seen = None
    for _ in range(max_rounds):
        mark = star.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")).first()
        if (mark["n"], mark["s"]) == seen or mark["n"] == 0:
            break
        seen = (mark["n"], mark["s"])
        star = cut(_small_star(_large_star(star)))
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = star.select(F.col("b").alias("id")).distinct()
    return star.select(F.col("a").alias("id"), F.col("b").alias("component")).unionByName(roots.select("id", F.col("id").alias("component")))


def group_id(keys: Column) -> Column:
    """'dup-' and 20 hex digits of the SHA-256 of the sorted keys joined by '|'."""
    return F.concat(F.lit("dup-"), F.substring(F.sha2(F.array_join(F.array_sort(keys), "|"), 256), 1, 20))
