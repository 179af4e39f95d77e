"""Source trees as a Spark data source.

Spark's own file readers hide names that begin with a dot or an underscore, so the tree is walked here:
one partition for each top-level entry of each tree.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from custodia.rules.files import IGNORED_DIRECTORIES


class _Entry(InputPartition):
    def __init__(self, repo_id: str, root: str, name: str):
        self.repo_id, self.root, self.name = repo_id, root, name


class TreeSource(DataSource):
    """Option ``trees`` holds ``id=path`` entries, one a line; ``pruned`` leaves out ignored directories; ``content`` reads texts."""

    @classmethod
    def name(cls) -> str:
        return "custodia-tree"

    def schema(self) -> str:
        return "repo_id string, file_path string, size_bytes long, last_modified timestamp, content string"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(dict(self.options))


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.pruned, self.content = options.get("pruned", "true") == "true", options.get("content", "true") == "true"
        self.trees = [x.split("=", 1) for x in options["trees"].split("\n") if x]

    def partitions(self):
        return [_Entry(key, root, name) for key, root in self.trees for name in sorted(os.listdir(root))]

    def read(self, partition) -> Iterator[tuple]:
        yield from self._walk(partition.repo_id, partition.root, partition.name)

    def _walk(self, repo_id: str, root: str, path: str) -> Iterator[tuple]:
        full = os.path.join(root, path)
        try:
            if os.path.islink(full):
                return
            if os.path.isdir(full):
                if not (self.pruned and os.path.basename(path) in IGNORED_DIRECTORIES):
                    for name in sorted(os.listdir(full)):
                        yield from self._walk(repo_id, root, f"{path}/{name}")
                return
            held = os.stat(full)
            text = None
            if self.content:
                with open(full, encoding="utf-8", errors="replace") as file:
                    text = file.read()
        except OSError:
            return
        yield repo_id, path, held.st_size, datetime.fromtimestamp(int(held.st_mtime), timezone.utc), text


def read_trees(spark: SparkSession, trees: dict[str, str], pruned: bool = True, content: bool = True) -> DataFrame:
    spark.dataSource.register(TreeSource)
    return spark.read.format("custodia-tree").option("trees", "\n".join(f"{k}={v}" for k, v in trees.items())).option("pruned", str(pruned).lower()).option("content", str(content).lower()).load()
