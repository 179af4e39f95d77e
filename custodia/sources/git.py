"""Git repositories as Spark data sources, one partition for each repository."""

from __future__ import annotations

import subprocess
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from custodia.operators.history import commit_headers, line_stats, name_status

_RECORD, _UNIT = "\x1e", "\x1f"


def run_git(repository: str, *arguments: str) -> str:
    """What git prints, with paths unquoted; an error is raised, not hidden."""
    done = subprocess.run(["git", "-c", "core.quotepath=off", "-C", repository, *arguments], capture_output=True, check=True)
    return done.stdout.decode("utf-8", "replace")


class _Repository(InputPartition):
    def __init__(self, repo_id: str, path: str):
        self.repo_id, self.path = repo_id, path


class GitSource(DataSource):
    """Option ``repositories`` holds ``id=path`` entries, one a line; ``kind`` is log, authors, blame or branches."""

    @classmethod
    def name(cls) -> str:
        return "custodia-git"

    def schema(self) -> str:
        return {
            "log": "repo_id string, commit_seq long, record string, status_lines array<string>, stat_lines array<string>",
            "authors": "repo_id string, name string, email string, commit_count long",
            "blame": "repo_id string, file_path string, line_no int, author_name string, author_email string, text string",
            "branches": "repo_id string, branch string, current boolean, head string",
        }[self.options.get("kind", "log")]

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)


class _Reader(DataSourceReader):
    def __init__(self, options):
        self.options = dict(options)

    def partitions(self):
        lines = [x for x in self.options["repositories"].split("\n") if x]
        return [_Repository(*x.split("=", 1)) for x in lines]

    def read(self, partition) -> Iterator[tuple]:
        return {"log": self._log, "authors": self._authors, "blame": self._blame, "branches": self._branches}[self.options.get("kind", "log")](partition)

    def _log(self, part) -> Iterator[tuple]:
        window = [f"--{k}={self.options[k]}" for k in ("since", "until") if self.options.get(k)]
        form = f"--pretty={_RECORD}%H{_UNIT}%h{_UNIT}%aN{_UNIT}%aE{_UNIT}%ad{_UNIT}%s"
        both = [run_git(part.path, "log", "--date=short", "--find-renames", form, kind, *window).split(_RECORD)[1:] for kind in ("--name-status", "--numstat")]
        stats = {x.split(_UNIT, 1)[0]: x.split("\n")[1:] for x in both[1]}
        for place, record in enumerate(both[0]):
            head, *lines = record.split("\n")
            yield part.repo_id, len(both[0]) - place, head, [x for x in lines if x], [x for x in stats.get(head.split(_UNIT, 1)[0], []) if x]

    def _authors(self, part) -> Iterator[tuple]:
        counts: dict[tuple[str, str], int] = {}
        for line in run_git(part.path, "log", "--all", f"--pretty=%aN{_UNIT}%aE").split("\n"):
            if _UNIT in line:
                key = tuple(line.split(_UNIT, 1))
                counts[key] = counts.get(key, 0) + 1
        for (name, email), count in counts.items():
            if email:
                yield part.repo_id, name, email, count

    def _blame(self, part) -> Iterator[tuple]:
        for path in (self.options.get("paths") or run_git(part.path, "ls-files")).split("\n"):
            if not path:
                continue
            author, email, number = "", "", 0
            for line in run_git(part.path, "blame", "--line-porcelain", "--", path).split("\n"):
                if line.startswith("author "):
                    author = line[7:]
                elif line.startswith("author-mail "):
                    email = line[12:].strip("<>")
                elif line.startswith("\t"):
                    number += 1
                    yield part.repo_id, path, number, author, email, line[1:]

    def _branches(self, part) -> Iterator[tuple]:
        head = run_git(part.path, "rev-parse", "--abbrev-ref", "HEAD").strip()
        for line in run_git(part.path, "for-each-ref", "--format=%(refname:short)%09%(objectname:short)", "refs/heads", "refs/remotes").split("\n"):
            if line:
                name, short = line.split("\t")
                yield part.repo_id, name, name == head, short


def read_git(spark: SparkSession, repositories: dict[str, str], kind: str = "log", **options: str) -> DataFrame:
    spark.dataSource.register(GitSource)
    reader = spark.read.format("custodia-git").option("repositories", "\n".join(f"{k}={v}" for k, v in repositories.items())).option("kind", kind)
    for key, value in options.items():
        reader = reader.option(key, value)
    return reader.load()


def commits_and_changes(log: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Commits, file changes and line counts of a log."""
    commits = commit_headers(log, "record", ("repo_id", "commit_seq"))
    keyed = log.withColumn("hash", F.split("record", _UNIT)[0])
    changes = name_status(keyed.select("repo_id", "hash", F.posexplode("status_lines").alias("change_idx", "value"))).drop("value")
    stats = line_stats(keyed.select("repo_id", "hash", F.posexplode("stat_lines").alias("stat_idx", "value"))).drop("value").withColumnRenamed("file_path", "stat_path")
    return commits, changes, stats


def lines_of_author(blame: DataFrame, target: str) -> DataFrame:
    """Each file's text in which lines of others are empty, so that places stay."""
    wanted = target.strip().strip("<>").lower()
    own = (F.lower("author_name") == wanted) | (F.lower("author_email") == wanted)
    lines = blame.groupBy("repo_id", "file_path").agg(F.array_sort(F.collect_list(F.struct("line_no", F.when(own, F.col("text")).otherwise("").alias("t")))).alias("l"))
    return lines.select("repo_id", "file_path", F.array_join(F.transform("l", lambda x: x["t"]), "\n").alias("text"))
