"""Extension points: sources, parsers, token counters, evaluators, stores."""

from __future__ import annotations

from collections.abc import Callable
from typing import Protocol

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


class Source(Protocol):
    """What a scan reads: items with versions, and their documents."""

    def items(self, spark: SparkSession) -> DataFrame: ...

    def documents(self, spark: SparkSession) -> DataFrame: ...


class Parser(Protocol):
    def parse(self, data: bytes, name: str) -> dict: ...


class Store(Protocol):
    """History kept as Parquet or any table format."""

    def load(self, spark: SparkSession, name: str) -> DataFrame: ...

    def append(self, name: str, rows: DataFrame) -> None: ...


TokenCounter = Callable[[Column], Column]
Evaluator = Callable[[DataFrame], DataFrame]


class PagedSource(DataSource):
    """Documents of a paged service as a Spark source; one partition a page range.

    Options: ``pages`` (number of pages), ``fetcher`` (import path of a callable page -> list of
    (id, title, content)). The callable runs on executors, so it brings its own client.
    """

    @classmethod
    def name(cls) -> str:
        return "corpusgauge_paged"

    def schema(self) -> str:
        return "id string, title string, content string"

    def reader(self, schema) -> DataSourceReader:
        return _PagedReader(self.options)


class _PagedReader(DataSourceReader):
    def __init__(self, options):
        self.pages = int(options.get("pages", "1"))
        self.fetcher = options["fetcher"]

    def partitions(self):
        return [InputPartition(i) for i in range(self.pages)]

    def read(self, partition):
        import importlib

        module, _, function = self.fetcher.rpartition(".")
        for row in getattr(importlib.import_module(module), function)(partition.value):
            yield tuple(row)
