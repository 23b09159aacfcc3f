"""A content-addressed store of files: ``files/md5/ab/cdef...``, directories as listings with ``.dir``."""

from __future__ import annotations

import hashlib
import json
import os
import shutil
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from datastrata.functions.hashing import hash_file
from datastrata.schema import BLOB


def listing(folder: str) -> list[tuple[str, str, int]]:
    """``(relpath, md5, size)`` of every file below a folder, in order of relpath."""
    out = []
    for where, _, names in os.walk(folder):
        for name in names:
            path = os.path.join(where, name)
            out.append((os.path.relpath(path, folder).replace(os.sep, "/"), hash_file(path), os.path.getsize(path)))
    return sorted(out)


def manifest_text(entries: list[tuple[str, str, int]]) -> str:
    return json.dumps([{"md5": m, "relpath": r} for r, m, _ in entries], separators=(", ", ": "))


def hash_path(path: str) -> tuple[str, int, int | None]:
    """``(md5, size, nfiles)``; nfiles is None for a file."""
    if os.path.isdir(path):
        entries = listing(path)
        return hashlib.md5(manifest_text(entries).encode()).hexdigest(), sum(e[2] for e in entries), len(entries)
    return hash_file(path), os.path.getsize(path), None


class Store:
    def __init__(self, root: str):
        self.root = root

    def location(self, md5: str, is_dir: bool = False) -> str:
        return os.path.join(self.root, "files", "md5", md5[:2], md5[2:] + (".dir" if is_dir else ""))

    def has(self, md5: str, is_dir: bool = False) -> bool:
        return os.path.exists(self.location(md5, is_dir))

    def _put(self, md5: str, is_dir: bool, write) -> bool:
        """Written beside its place and moved there, so nobody sees a part; False if it was there."""
        place = self.location(md5, is_dir)
        if os.path.exists(place):
            return False
        os.makedirs(os.path.dirname(place), exist_ok=True)
        handle, temp = tempfile.mkstemp(dir=os.path.dirname(place))
        os.close(handle)
        try:
            write(temp)
            os.replace(temp, place)
        finally:
            if os.path.exists(temp):
                os.unlink(temp)
        return True

    def add(self, path: str) -> tuple[str, int, int | None]:
        """Put a file or directory into the store; ``(md5, size, nfiles)``."""
        md5, size, nfiles = hash_path(path)
        if nfiles is None:
            self._put(md5, False, lambda t: shutil.copyfile(path, t))
        else:
            entries = listing(path)
            text = manifest_text(entries)
            if hashlib.md5(text.encode()).hexdigest() != md5:
                raise RuntimeError(f"{path} changed while it was added")
            for rel, inner, _ in entries:
                self._put(inner, False, lambda t, rel=rel: shutil.copyfile(os.path.join(path, rel), t))
            self._put(md5, True, lambda t: open(t, "w").write(text))
        return md5, size, nfiles

    def manifest(self, md5: str) -> dict[str, str]:
        try:
            with open(self.location(md5.removesuffix(".dir"), True), encoding="utf-8") as f:
                return {e["relpath"]: e["md5"] for e in json.load(f)}
        except (OSError, ValueError, KeyError, TypeError):
            return {}

    def restore(self, md5: str, path: str, is_dir: bool = False) -> None:
        """Bring a stored file or directory back to ``path``."""
        os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
        if not is_dir:
            shutil.copyfile(self.location(md5), path)
            return
        for rel, inner in self.manifest(md5).items():
            self.restore(inner, os.path.join(path, rel))

    def blobs(self) -> list[tuple[str, bool, int, str]]:
        out = []
        for folder, _, names in os.walk(os.path.join(self.root, "files", "md5")):
            for n in names:
                place, md5 = os.path.join(folder, n), os.path.basename(folder) + n.removesuffix(".dir")
                out.append((md5, n.endswith(".dir"), os.path.getsize(place), place))
        return sorted(out)

    def delete(self, md5: str, is_dir: bool = False) -> int:
        """Bytes freed; an empty folder goes too."""
        place = self.location(md5, is_dir)
        if not os.path.exists(place):
            return 0
        size = os.path.getsize(place)
        os.unlink(place)
        if not os.listdir(os.path.dirname(place)):
            os.rmdir(os.path.dirname(place))
        return size


def relation(spark: SparkSession, store: Store) -> DataFrame:
    """The store's blobs, listed by Spark; no content is read."""
    top = os.path.join(store.root, "files", "md5")
    if "://" not in top and not os.path.isdir(top):
        return spark.createDataFrame([], BLOB)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(top)
    parts = F.regexp_extract("path", r"/([0-9a-f]{2})/([0-9a-f]{30})(\.dir)?$", 0)
    found = files.select(F.split(parts, "/").alias("_p"), F.col("length").alias("size"), F.regexp_replace("path", "^file:/+", "/").alias("location")).where(parts != "")
    name = F.get("_p", 2)
    return found.select(
        F.concat(F.get("_p", 1), F.regexp_replace(name, r"\.dir$", "")).alias("md5"), name.endswith(".dir").alias("is_dir"), "size", "location"
    )


def copy(hashes: list[tuple[str, bool]], source: Store, target: Store, spark: SparkSession | None = None) -> list[tuple[str, str]]:
    """Copy some blobs, directories with their files; ``(md5, state)``: copied, there, missing or error. Nothing is raised."""
    from datastrata.sources import transport

    if not hashes:
        return []
    spark = spark or SparkSession.getActiveSession() or SparkSession.builder.getOrCreate()
    wanted = spark.createDataFrame(hashes, "md5 string, is_dir boolean")
    return [(r.md5, r.state) for r in transport.transfer(spark, wanted, source, target).select("md5", "state").collect()]
