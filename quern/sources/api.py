"""Paged JSON API as a Python data source with filter pushdown (SRC-15, SRC-16).

``spark.read.format("paged_json").option("pages", folder)`` reads recorded
response pages from a folder that driver and executors share; comparisons on
price and time are pushed into the reader, which passes them on as request
parameters (here: it skips what they exclude).  Transient errors are tried again.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator
from pathlib import Path

from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual

SCHEMA = "id string, title string, price long, currency string, created long, url string"
TRANSIENT = frozenset({408, 425, 429, 500, 502, 503, 504})


def with_retries(call: Callable[[], object], status_of: Callable[[Exception], int | None], attempts: int = 3, sleep: Callable[[float], None] = time.sleep):
    """Result of ``call``; transient statuses are tried again after min(8, 2**n) seconds, others raise at once."""
    for n in range(attempts):
        try:
            return call()
        except Exception as e:
            if n + 1 == attempts or status_of(e) not in TRANSIENT:
                raise
            sleep(min(8.0, 2.0**n))
    raise AssertionError("attempts must be positive")


def _status(error: Exception) -> int | None:
    """Transient I/O errors of a shared folder count as an unavailable service; a missing or unreadable page doesn't."""
    return None if isinstance(error, (FileNotFoundError, PermissionError, ValueError)) else 503 if isinstance(error, OSError) else getattr(error, "status", None)


class _Page(InputPartition):
    def __init__(self, path: str):
        super().__init__(path)
        self.path = path


class PagedReader(DataSourceReader):
    def __init__(self, options: dict):
        self.folder, self.bounds = options["pages"], []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        kinds = {EqualTo: "eq", GreaterThan: "gt", GreaterThanOrEqual: "ge", LessThan: "lt", LessThanOrEqual: "le"}
        for f in filters:
            if type(f) in kinds and f.attribute in (("price",), ("created",), ("currency",)):
                self.bounds.append((f.attribute[0], kinds[type(f)], f.value))
            else:
                yield f  # Spark applies what the source can't

    def partitions(self) -> list[_Page]:
        return [_Page(str(p)) for p in sorted(Path(self.folder).glob("*.json"))]

    def _passes(self, row: dict) -> bool:
        tests = {"eq": lambda a, b: a == b, "gt": lambda a, b: a > b, "ge": lambda a, b: a >= b, "lt": lambda a, b: a < b, "le": lambda a, b: a <= b}
        return all(row.get(c) is not None and tests[op](row[c], v) for c, op, v in self.bounds)

    def read(self, partition: _Page) -> Iterator[tuple]:
        page = with_retries(lambda: json.loads(Path(partition.path).read_text()), _status)
        for row in page.get("listings", []):
            if self._passes(row):
                yield tuple(row.get(c) for c in ("id", "title", "price", "currency", "created", "url"))


class PagedJson(DataSource):
    @classmethod
    def name(cls) -> str:
        return "paged_json"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> PagedReader:
        return PagedReader(self.options)
