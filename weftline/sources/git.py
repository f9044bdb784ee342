"""Change feeds of a git work tree as a Python data source: spark.read.format("gitfeed").option("root", ...).option("feed", ...)."""

from __future__ import annotations

import subprocess
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


def _git(root: str, *args: str) -> list[str]:
    done = subprocess.run(["git", "-C", root, "-c", "core.quotepath=off", *args], capture_output=True, text=True, check=False)
    if done.returncode not in (0, 1):
        raise RuntimeError(done.stderr.strip()[:300])
    return [x for x in done.stdout.split("\0" if "-z" in args else "\n") if x]


def changes(root: str, *args: str) -> list[tuple[str, str | None, str | None]]:
    """(status, old, new) from a name-status diff; a rename has both, a deletion only old, others only new."""
    parts, out = iter(_git(root, "diff", "--name-status", "-z", "-M", *args)), []
    for status in parts:
        if status[0] in "RC":
            out.append((status[0], next(parts), next(parts)))
        else:
            path = next(parts)
            out.append((status[0], path, None) if status[0] == "D" else (status[0], None, path))
    return out


class GitFeed(DataSource):
    """Feeds: tracked (S08), changes against ``base`` (S09), changes and untracked files as additions (S10, S11), show at a ref."""

    @classmethod
    def name(cls) -> str:
        return "gitfeed"

    def schema(self) -> str:
        return "status string, old string, new string, content string"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(dict(self.options))


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.options = options

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(0)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        root, feed, base = self.options["root"], self.options.get("feed", "tracked"), self.options.get("base", "HEAD")
        if feed == "tracked":
            for p in sorted(_git(root, "ls-files", "-z")):
                yield "T", None, p, None
        elif feed == "show":
            path = self.options["path"]
            done = subprocess.run(["git", "-C", root, "show", f"{base}:{path}"], capture_output=True, text=True, check=False)
            yield "S", None, path, done.stdout if done.returncode == 0 else None
        else:
            staged = ["--cached"] if self.options.get("staged") == "true" else []
            for row in changes(root, *staged, base):
                yield *row, None
            if feed == "worktree":
                for p in sorted(_git(root, "ls-files", "--others", "--exclude-standard", "-z")):
                    yield "A", None, p, None


def feed(spark: SparkSession, root: str, kind: str = "tracked", **options: str) -> DataFrame:
    """Read a feed; the data source is registered on the way."""
    spark.dataSource.register(GitFeed)
    return spark.read.format("gitfeed").options(root=root, feed=kind, **options).load()
