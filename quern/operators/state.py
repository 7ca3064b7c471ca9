"""Keyed state on Parquet without MERGE (SNK-01..15, FIL-13): every function maps tables to tables.

``Snapshots`` writes numbered versions and reads the highest whole one, so a reader
sees the old state or the new one, and a failed write leaves the old one in place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def upsert(state: DataFrame, batch: DataFrame, keys: list[str], refresh: list[str], new_only: bool = False) -> DataFrame:
    """Insert if new, else take the ``refresh`` columns of the batch (SNK-01); ``new_only`` gives just the new rows."""
    if new_only:
        return batch.join(state, keys, "left_anti")
    old = state.select(*keys, *(F.col(c).alias(f"_old_{c}") for c in state.columns if c not in keys), F.lit(True).alias("_was"))
    new = batch.select(*keys, *(F.col(c).alias(f"_new_{c}") for c in batch.columns if c not in keys), F.lit(True).alias("_is"))
    both = old.join(new, keys, "full")

    def pick(c: str) -> Column:
        if c not in batch.columns:
            return F.col(f"_old_{c}")
        fresh = F.col("_is") if c in refresh else F.col("_was").isNull()
        return F.when(fresh, F.col(f"_new_{c}")).otherwise(F.col(f"_old_{c}"))

    return both.select(*(F.col(c) if c in keys else pick(c).alias(c) for c in state.columns))


def append_new(state: DataFrame, batch: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of the batch whose key the table doesn't have, the least of each key (SNK-04, SNK-08)."""
    rest = [c for c in batch.columns if c not in keys]
    one = batch.groupBy(*keys).agg(F.min(F.struct(*rest)).alias("_r")).select(*keys, "_r.*") if rest else batch.distinct()
    return one.select(*batch.columns).join(state.select(*keys), keys, "left_anti")


def dedup_nullable(df: DataFrame, key: str) -> DataFrame:
    """The least row of each key, but every row whose key is NULL (SNK-06)."""
    rest = [c for c in df.columns if c != key]
    one = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.min(F.struct(*rest)).alias("_r")).select(key, "_r.*").select(*df.columns)
    return one.unionByName(df.where(F.col(key).isNull()))


def latest(df: DataFrame, keys: list[str], at: str) -> DataFrame:
    """Latest row of each key (SNK-02, SNK-05, SNK-07, SNK-09)."""
    rest = [c for c in df.columns if c not in keys]
    best = F.max_by(F.struct(*rest), F.struct(at, *(c for c in rest if c != at))).alias("_r")
    return df.groupBy(*keys).agg(best).select(*keys, "_r.*").select(*df.columns)


def unexpired(cache: DataFrame, now: Column, expires: str = "expires_at") -> DataFrame:
    """FIL-13."""
    return cache.where(F.col(expires) > now)


def expires_at(at: Column, status: Column, hours: dict[str, int], default: int) -> Column:
    """Lifetime by status (SNK-05, SUP-07)."""
    table = F.create_map(*[F.lit(x) for pair in hours.items() for x in pair])
    return at + F.make_dt_interval(hours=F.coalesce(F.try_element_at(table, status), F.lit(default)))


def replace_children(children: DataFrame, fresh: DataFrame, parent: list[str]) -> DataFrame:
    """Children of the parents in ``fresh`` deleted and replaced (SNK-03)."""
    return children.join(fresh.select(*parent).distinct(), parent, "left_anti").unionByName(fresh)


def migrate(df: DataFrame, added: dict[str, Column], backfill: dict[str, Column]) -> DataFrame:
    """Additive migration: missing columns added, then filled where NULL (SNK-14)."""
    for name, default in added.items():
        if name not in df.columns:
            df = df.withColumn(name, default)
    for name, value in backfill.items():
        df = df.withColumn(name, F.coalesce(F.col(name), value))
    return df


class Snapshots:
    """Versions of one table under a folder, numbered; the highest whole one is current.

    A version is whole once Spark has put its _SUCCESS file there, so a reader sees
    the version before or the new one, never none, and a write that fails leaves
    the table as it was.  Older versions stay until ``prune``.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        jvm = spark._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.folder).getFileSystem(spark._jsc.hadoopConfiguration())

    def _versions(self) -> list[tuple[int, bool]]:
        """(number, whole) of every version folder, ascending."""
        if not self._fs.exists(self._path(self.folder)):
            return []
        names = [f.getPath().getName() for f in self._fs.listStatus(self._path(self.folder))]
        numbers = sorted(int(n[2:].split("-")[0]) for n in names if n.startswith("v-"))
        by = {int(n[2:].split("-")[0]): n for n in names if n.startswith("v-")}
        return [(n, self._fs.exists(self._path(f"{self.folder}/{by[n]}/_SUCCESS"))) for n in numbers]

    def version(self) -> str | None:
        whole = [n for n, ok in self._versions() if ok]
        return f"v-{whole[-1]:012d}" if whole else None

    def read(self) -> DataFrame | None:
        v = self.version()
        return None if v is None else self.spark.read.parquet(f"{self.folder}/{v}")

    def write(self, df: DataFrame) -> str:
        """The next version; of two writers at once one fails, as the folder is there already."""
        last = max((n for n, _ in self._versions()), default=0)
        v = f"v-{last + 1:012d}"
        df.write.mode("error").parquet(f"{self.folder}/{v}")
        return v

    def prune(self, keep: int = 2) -> None:
        """Deletes all but the newest ``keep`` whole versions, and what failed before them."""
        whole = [n for n, ok in self._versions() if ok]
        for n, _ in self._versions():
            if len(whole) > keep and n < whole[-keep]:
                self._fs.delete(self._path(f"{self.folder}/v-{n:012d}"), True)
