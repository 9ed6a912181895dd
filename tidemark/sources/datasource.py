"""Git history as a Spark data source: spark.read.format("git_changes").option("path", repository)."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThanOrEqual, InputPartition

from . import git_history

SCHEMA = "revision string, contributor string, ts long, path string, previous_path string, added long, deleted long"


class GitReader(DataSourceReader):
    """One log process. A lower bound on ts is pushed into git; git may still return more, so Spark filters again."""

    def __init__(self, options: dict):
        self.path, self.since = options["path"], None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if isinstance(f, (GreaterThanOrEqual, EqualTo)) and f.attribute == ("ts",):
                self.since = f.value if self.since is None else max(self.since, f.value)
            yield f

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(0)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        for c in git_history.parse(git_history.log(self.path, self.since)):
            for path, old, added, deleted in c.changes:
                yield c.revision, c.contributor, c.ts, path, old, added, deleted


class GitChanges(DataSource):
    @classmethod
    def name(cls) -> str:
        return "git_changes"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> GitReader:
        return GitReader(self.options)


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(GitChanges)
