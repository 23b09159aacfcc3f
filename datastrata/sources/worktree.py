"""Files as they are: signatures and hashes by tasks, a stored memo of hashes, and files brought back from a store."""

from __future__ import annotations

import hashlib
import os
import shutil
import time
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from datastrata.functions.hashing import directory_hashes, hash_file
from datastrata.operators.freshness import remember, reuse_hashes
from datastrata.runtime import cut
from datastrata.sources.metadata import write_atomic
from datastrata.sources.store import Store

SEEN = "path string, relpath string, mtime double, size long, is_dir boolean"
MEMO = "path string, mtime double, size long, nfiles int, md5 string, updated_at double"
RESTORED = "path string, state string, error string"
#: The signature's number of files of what is a file itself.
ALONE = -1
ROWS = 10_000


def walked(root: str, names: DataFrame) -> DataFrame:
    """``names(path)`` that exist -> a row of ``SEEN`` for each file, with its path within a folder; an empty folder has one row without a file."""

    def below(path: str) -> Iterator[tuple]:
        full = os.path.join(root, path)
        if not os.path.isdir(full):
            if os.path.exists(full):
                s = os.stat(full)
                yield path, None, s.st_mtime, s.st_size, False
            return
        empty = True
        for folder, _, files in os.walk(full):
            for name in files:
                file = os.path.join(folder, name)
                try:
                    s = os.stat(file)
                except OSError:  # gone, or a link to nowhere: hashing tells
                    yield path, os.path.relpath(file, full).replace(os.sep, "/"), 0.0, 0, True
                else:
                    yield path, os.path.relpath(file, full).replace(os.sep, "/"), s.st_mtime, s.st_size, True
                empty = False
        if empty:
            yield path, None, 0.0, 0, True

    def run(batches: Iterator) -> Iterator:
        import pandas as pd

        columns, rows = [c.split()[0] for c in SEEN.split(", ")], []
        for pdf in batches:
            for path in pdf["path"]:
                for row in below(path):
                    rows.append(row)
                    if len(rows) == ROWS:
                        yield pd.DataFrame(rows, columns=columns)
                        rows = []
        yield pd.DataFrame(rows, columns=columns)

    return names.select("path").mapInPandas(run, SEEN)


def signatures(seen: DataFrame) -> DataFrame:
    """``(path, mtime, size, nfiles)``: newest time, all bytes, and the number of files, which shows a removed one."""
    n = F.when(F.max("is_dir"), F.count("relpath")).otherwise(ALONE).cast("int")
    return seen.groupBy("path").agg(F.max("mtime").alias("mtime"), F.sum("size").alias("size"), n.alias("nfiles"))


class Memo:
    """Hashes by path and signature, a Parquet table a version; ``current`` names the newest and is replaced in one step."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def _current(self) -> str | None:
        try:
            with open(os.path.join(self.folder, "current"), encoding="utf-8") as f:
                return f.read().strip()
        except FileNotFoundError:
            return None

    def read(self) -> DataFrame:
        name = self._current()
        if name is None or not os.path.isdir(os.path.join(self.folder, name)):
            return self.spark.createDataFrame([], MEMO)
        return self.spark.read.schema(MEMO).parquet(os.path.join(self.folder, name))

    def save(self, entries: DataFrame, gone: DataFrame | None = None) -> None:
        """New entries in place of old ones of their paths. Of two writers the last one's version counts; what it lacks is hashed again."""
        before, name = self._current(), f"v-{uuid.uuid4().hex}"
        remember(self.read(), entries, gone).write.parquet(os.path.join(self.folder, name))
        write_atomic(os.path.join(self.folder, "current"), name)
        for old in os.listdir(self.folder):  # the version before stays, for who reads it now
            if old.startswith("v-") and old not in (before, name):
                shutil.rmtree(os.path.join(self.folder, old), ignore_errors=True)

    def clear(self) -> None:
        if os.path.isdir(self.folder):
            shutil.rmtree(self.folder)


def _hashed(root: str, seen: DataFrame) -> DataFrame:
    """Rows of ``SEEN`` that are files, with ``md5`` and ``error``; the files of one folder are dealt over all tasks."""

    def run(batches: Iterator) -> Iterator:
        for pdf in batches:
            md5, errors = [], []
            for path, rel in zip(pdf["path"], pdf["relpath"]):
                try:
                    md5.append(hash_file(os.path.join(root, path, rel) if rel is not None else os.path.join(root, path)))
                    errors.append(None)
                except OSError as e:
                    md5.append(None)
                    errors.append(str(e))
            yield pdf.assign(md5=md5, error=errors)

    files = seen.where("NOT is_dir OR relpath IS NOT NULL")
    return files.repartition(F.xxhash64("path", "relpath")).mapInPandas(run, f"{SEEN}, md5 string, error string")


def hashes(root: str, names: DataFrame, memo: Memo | None = None) -> tuple[DataFrame, int]:
    """``names(path)`` that exist -> ``(path, md5, error)``, and how many files were read: those of paths whose signature the memo does not know."""
    spark = names.sparkSession
    seen = cut(walked(root, names.distinct()))
    signed = signatures(seen)
    old = memo.read() if memo is not None else spark.createDataFrame([], MEMO)
    known, _ = reuse_hashes(signed, old)
    matched = cut(signed.join(known.select("path", "md5"), "path", "left"))
    same = matched.where("md5 IS NOT NULL").select("path", "md5", F.lit(None).cast("string").alias("error"))
    todo = matched.where("md5 IS NULL").drop("md5")
    if todo.isEmpty():
        return same, 0
    files = cut(_hashed(root, seen.join(todo.select("path"), "path", "left_semi")))
    alone = files.where("NOT is_dir").select("path", "md5", "error")
    failed = files.where("is_dir AND error IS NOT NULL").groupBy("path").agg(F.lit(None).cast("string").alias("md5"), F.min("error").alias("error"))
    listed = directory_hashes(files.where("is_dir AND error IS NULL"), ["path"]).join(failed.select("path"), "path", "left_anti").select("path", "md5", F.lit(None).cast("string").alias("error"))
    empty = todo.where("nfiles = 0").select("path", F.lit(hashlib.md5(b"[]").hexdigest()).alias("md5"), F.lit(None).cast("string").alias("error"))
    fresh = cut(alone.unionAll(failed).unionAll(listed).unionAll(empty))
    if memo is not None:
        memo.save(todo.join(fresh.where("error IS NULL").select("path", "md5"), "path").select("path", "mtime", "size", "nfiles", "md5", F.lit(time.time()).alias("updated_at")))
    return same.unionAll(fresh), files.count()


def restored(root: str, outs: DataFrame, entries: DataFrame, store: Store, overwrite: bool = False, clear: bool = False) -> DataFrame:
    """``outs(path, md5, is_dir)`` as they are in a store -> a row of ``RESTORED`` for each file: same, restored, removed, or missing in the store.

    A folder loses the files that its listing, ``entries(dir_md5, relpath, md5)``, has not. What no listing of the store would bring
    back, because the store has not its content, is kept, unless a file's changes are to be overwritten, or a folder cleared."""
    dirs = outs.where("is_dir").select(F.col("path").alias("top"), F.col("md5").alias("dir_md5")).join(entries, "dir_md5")
    inside = dirs.select(F.concat("top", F.lit("/"), "relpath").alias("path"), "md5")
    wanted = outs.where("NOT is_dir").select("path", "md5").unionAll(inside)
    there = walked(root, dirs.select(F.col("top").alias("path")).distinct()).where("relpath IS NOT NULL")
    extra = there.select(F.concat("path", F.lit("/"), "relpath").alias("path")).join(wanted.select("path"), "path", "left_anti")
    work = wanted.unionAll(extra.select("path", F.lit(None).cast("string").alias("md5")))

    def one(path: str, md5: str | None) -> tuple[str, str | None]:
        full = os.path.join(root, path)
        now = hash_file(full) if os.path.exists(full) else None
        if md5 is not None and now == md5:
            return "same", None
        if now is not None and not (clear if md5 is None else overwrite) and not store.has(now):
            return "kept", None
        if md5 is None:
            os.unlink(full)
            return "removed", None
        if not store.has(md5):
            return "missing", None
        os.makedirs(os.path.dirname(full), exist_ok=True)
        beside = f"{full}.part-{uuid.uuid4().hex}"
        shutil.copyfile(store.location(md5), beside)
        os.replace(beside, full)
        return "restored", None

    def run(batches: Iterator) -> Iterator:
        import pandas as pd

        for pdf in batches:
            rows = []
            for path, md5 in zip(pdf["path"], pdf["md5"]):
                try:
                    rows.append((path, *one(path, md5)))
                except OSError as e:
                    rows.append((path, "error", str(e)))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in RESTORED.split(", ")])

    return cut(work.repartition(F.xxhash64("path")).mapInPandas(run, RESTORED))
