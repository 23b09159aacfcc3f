"""Copies of blobs between stores by Spark tasks.

What is needed is a fixed point: the wanted blobs, what the listings among them name, and so on. A join with both stores' listings
says what to copy; tasks copy it through the file systems that Arrow knows (local, HDFS, S3, GCS) in blocks, beside its place and then by a
rename, so an attempt that is lost or made twice leaves nothing that is seen. Files come before the listings that name them.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from datastrata.operators.transfer import closure, movement
from datastrata.runtime import cut
from datastrata.sources.store import Store, relation

BLOCK = 1 << 20
COPIED = "md5 string, is_dir boolean, state string, size long, error string"
ENTRY = "dir_md5 string, relpath string, md5 string, is_dir boolean"


def file_system(root: str):
    """The file system of a store's root, a path or a URI, and the path within it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(root) if "://" in root else (fs.LocalFileSystem(), root)


def place(top: str, md5: str, is_dir: bool) -> str:
    return f"{top}/files/md5/{md5[:2]}/{md5[2:]}{'.dir' if is_dir else ''}"


def _is_file(system, path: str) -> bool:
    return system.get_file_info(path).is_file


def copy_one(source: str, target: str, md5: str, is_dir: bool) -> tuple[str, int | None, str | None]:
    """``(state, size, error)``: copied, there, missing, or an error, which is not raised."""
    (from_, a), (to, b) = file_system(source), file_system(target)
    old, new = place(a, md5, is_dir), place(b, md5, is_dir)
    beside = f"{new}.part-{uuid.uuid4().hex}"
    try:
        if _is_file(to, new):
            return "there", to.get_file_info(new).size, None
        if not _is_file(from_, old):
            return "missing", None, None
        to.create_dir(new.rsplit("/", 1)[0], recursive=True)
        size = 0
        with from_.open_input_stream(old) as i, to.open_output_stream(beside) as o:
            while block := i.read(BLOCK):
                o.write(block)
                size += len(block)
        try:
            to.move(beside, new)
        except OSError:  # another attempt was sooner, where a rename does not replace
            if not _is_file(to, new):
                raise
        return "copied", size, None
    except OSError as e:
        return "error", None, str(e)
    finally:
        try:
            if _is_file(to, beside):
                to.delete_file(beside)
        except OSError:  # a part beside its place is in no listing
            pass


def copied(blobs: DataFrame, source: Store, target: Store) -> DataFrame:
    """``blobs(md5, is_dir)`` copied, a row of status each."""
    a, b = source.root, target.root

    def run(batches: Iterator) -> Iterator:
        import pandas as pd

        for pdf in batches:
            for m, d in zip(pdf["md5"], pdf["is_dir"]):  # a row as soon as it is there
                yield pd.DataFrame([(m, d, *copy_one(a, b, m, bool(d)))], columns=[c.split()[0] for c in COPIED.split(", ")]).astype({"size": "Int64"})

    return cut(blobs.select("md5", "is_dir").repartition(F.xxhash64("md5")).mapInPandas(run, COPIED))


def entries(dirs: DataFrame, stores: list[Store]) -> DataFrame:
    """What listings name, ``dirs(md5)`` -> ``(dir_md5, relpath, md5, is_dir)``, read from the first store that has them; one that cannot be read names nothing."""
    roots = [s.root for s in stores]

    def read(md5: str) -> list:
        for system, top in map(file_system, roots):
            path = place(top, md5, True)
            if _is_file(system, path):
                try:
                    with system.open_input_stream(path) as f:
                        return [(md5, e["relpath"], e["md5"].removesuffix(".dir"), e["md5"].endswith(".dir")) for e in json.loads(f.read())]
                except (OSError, ValueError, KeyError, TypeError):
                    continue
        return []

    def run(batches: Iterator) -> Iterator:
        import pandas as pd

        for pdf in batches:
            for md5 in pdf["md5"]:
                yield pd.DataFrame(read(md5), columns=[c.split()[0] for c in ENTRY.split(", ")])

    return dirs.select("md5").mapInPandas(run, ENTRY)


def plan(spark: SparkSession, wanted: DataFrame, source: Store, target: Store) -> DataFrame:
    """``wanted(md5, is_dir)`` -> ``(md5, is_dir, state)`` of all that they need: there, to copy, or missing in both."""
    needed = closure(wanted.select("md5", "is_dir"), lambda front: entries(front, [source, target]))
    return movement(needed, relation(spark, source), relation(spark, target))


def transfer(spark: SparkSession, wanted: DataFrame, source: Store, target: Store) -> DataFrame:
    """Copies what the target lacks of the wanted blobs and all that they need; a row of ``COPIED`` for each."""
    planned = cut(plan(spark, wanted, source, target))
    todo = planned.where("state = 'copy'")
    files = copied(todo.where("NOT is_dir"), source, target)
    dirs = copied(todo.where("is_dir"), source, target)
    rest = planned.where("state <> 'copy'").select("md5", "is_dir", "state", F.lit(None).cast("long").alias("size"), F.lit(None).cast("string").alias("error"))
    return files.unionAll(dirs).unionAll(rest)
