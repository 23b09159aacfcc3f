"""Metadata files below a root as a data source of Spark: folders are listed and files read by tasks, and filters of folders and
paths reach the reader, so that nothing else is listed or opened."""

from __future__ import annotations

import os
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition, StringStartsWith

NAME = "stage_metadata"
SUFFIX = ".dvc"
SCHEMA = "folder string, path string, text string, error string"
#: Folders that are not looked into.
CLOSED = (SUFFIX, ".git")
#: Listing goes down from the root until there are as many folders as these, for as many tasks.
TASKS = 64


@dataclass
class Folders(InputPartition):
    """Folders relative to the root, whose files are to be read; with all below them if ``deep``."""

    names: list[str]
    deep: bool


def _inside(root: str, folder: str) -> tuple[list[str], list[str]]:
    """Folders and metadata files in a folder, relative to the root; none where there is no such folder."""
    try:
        with os.scandir(os.path.join(root, folder)) as found:
            entries = sorted(found, key=lambda e: e.name)
    except (FileNotFoundError, NotADirectoryError):
        return [], []
    name = lambda e: f"{folder}/{e.name}" if folder else e.name
    folders = [name(e) for e in entries if e.name not in CLOSED and e.is_dir(follow_symlinks=False)]
    return folders, [name(e) for e in entries if e.name.endswith(SUFFIX) and e.name != SUFFIX and e.is_file()]


class MetadataReader(DataSourceReader):
    def __init__(self, root: str):
        self.root = root
        self.folders: set[str] | None = None  # None: all
        self.paths: set[str] | None = None
        self.prefixes: list[str] = []  # of paths; all must fit

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        both = lambda old, new: set(new) if old is None else old & set(new)
        for f in filters:
            values = f.value if isinstance(f, In) else (f.value,) if isinstance(f, EqualTo) else None
            if values is not None and f.attribute == ("folder",):
                self.folders = both(self.folders, values)
            elif values is not None and f.attribute == ("path",):
                self.paths = both(self.paths, values)
            elif isinstance(f, StringStartsWith) and f.attribute == ("path",):
                self.prefixes.append(f.value)
            else:
                yield f

    def _wanted(self, path: str) -> bool:
        return (self.paths is None or path in self.paths) and all(path.startswith(p) for p in self.prefixes)

    def partitions(self) -> list[Folders]:
        folders = self.folders
        if self.paths is not None:
            own = {os.path.dirname(p) for p in self.paths}
            folders = own if folders is None else folders & own
        if folders is not None:
            names = sorted(f for f in folders if not f.startswith("/") and not {*CLOSED, "..", "."} & set(f.split("/")))
            size = max(1, -(-len(names) // TASKS))
            return [Folders(names[i : i + size], False) for i in range(0, len(names), size)] or [Folders([], False)]
        top = os.path.dirname(max(self.prefixes, key=len)) if self.prefixes else ""
        seen, front = [], [top]
        while front and len(front) < TASKS:  # the last level is walked by tasks
            below = [b for f in front for b in _inside(self.root, f)[0]]
            seen += front
            front = below
        return [Folders(seen, False), *(Folders([f], True) for f in front)]

    def read(self, partition: Folders) -> Iterator[tuple]:
        left = list(reversed(partition.names))
        while left:
            folder = left.pop()
            below, files = _inside(self.root, folder)
            if partition.deep:
                left += reversed(below)
            for path in filter(self._wanted, files):
                text = error = None
                try:
                    with open(os.path.join(self.root, path), encoding="utf-8") as f:
                        text = f.read()
                except (OSError, UnicodeDecodeError) as e:
                    error = f"{type(e).__name__}: {e}"
                yield folder, path, text, error


class MetadataSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> MetadataReader:
        return MetadataReader(self.options["path"])


def files(spark: SparkSession, root: str, *rules: Column) -> DataFrame:
    """``(folder, path, text, error)`` of the metadata files below a root that fit a filter. The root's own folder is ``""``; what
    cannot be read has an error."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(MetadataSource)
    found = spark.read.format(NAME).load(os.path.abspath(root))
    for rule in rules:
        found = found.where(rule)
    return found


def in_folders(folders: list[str]) -> Column:
    return F.col("folder").isin(folders)


def below(folder: str) -> Column:
    return F.col("path").startswith(f"{folder}/")
