"""Content hashes: of column values, of files, and the ordered hash of a directory."""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CHUNK = 1 << 20


def content_hash(content: Column) -> Column:
    return F.md5(content)


def git_blob_sha(content: Column) -> Column:
    """What git calls a file of this content: the SHA-1 of a header and the bytes."""
    raw = content.cast("binary")
    head = F.concat(F.lit("blob "), F.octet_length(raw).cast("string"))
    return F.sha1(F.concat(head.cast("binary"), F.unhex(F.lit("00")), raw))


def json_text(text: Column) -> Column:
    """A string as JSON with all but ASCII escaped, quotes included."""

    def unit(n: Column) -> Column:
        return F.concat(F.lit("\\u"), F.lpad(F.lower(F.hex(n)), 4, "0"))

    def escape(c: Column) -> Column:
        n = F.ascii(c).cast("long")
        low = n - 0x10000
        pair = F.concat(unit(F.floor(low / 1024) + 0xD800), unit(low % 1024 + 0xDC00))
        out = F.when(c == '"', F.lit('\\"')).when(c == "\\", F.lit("\\\\"))
        for raw, name in (("\n", "n"), ("\r", "r"), ("\t", "t"), ("\b", "b"), ("\f", "f")):
            out = out.when(c == raw, F.lit("\\" + name))
        return out.when((n >= 32) & (n < 127), c).when(n < 0x10000, unit(n)).otherwise(pair)

    plain = text.rlike(r'^[ !#-\[\]-~]*$')
    slow = F.array_join(F.transform(F.split(text, ""), lambda c: F.when(c == "", c).otherwise(escape(c))), "")
    return F.concat(F.lit('"'), F.when(plain, text).otherwise(slow), F.lit('"'))


def manifest_item(relpath: Column, md5: Column) -> Column:
    return F.concat(F.lit('{"md5": '), json_text(md5), F.lit(', "relpath": '), json_text(relpath), F.lit("}"))


def directory_hashes(files: DataFrame, by: list[str]) -> DataFrame:
    """``(*by, relpath, md5, size)`` -> ``(*by, md5, nfiles, size)``.

    A directory's hash is that of its listing in order. Rows are sorted by directory and relpath within partitions, with Spark's
    spilling sort, and a task carries the state of one digest over them, so a listing of any length takes the memory of a batch. A file
    without name or hash is counted, but not in the listing.
    """
    item = manifest_item(F.col("relpath"), F.col("md5"))
    rows = files.select(*by, F.col("relpath").alias("_r"), item.alias("_i"), F.col("size").cast("long").alias("_s"))
    keys = rows.select(*by).schema
    ordered = rows.repartition(*by).sortWithinPartitions(*by, "_r", "_i").drop("_r")
    names, width = [*by, "md5", "nfiles", "size"], len(by)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        types, at, digest, some, n, total = None, None, None, False, 0, None

        def row() -> tuple:
            digest.update(b"]")
            return (*at, digest.hexdigest(), n, total)

        def made(done: list[tuple]):
            return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*done), types)], names=names)

        for batch in batches:
            types = [*(batch.schema.field(k).type for k in range(width)), pa.string(), pa.int64(), pa.int64()]
            key_rows = list(zip(*(batch.column(k).to_pylist() for k in range(width)))) if width else [()] * batch.num_rows
            items, sizes = batch.column(width).to_pylist(), batch.column(width + 1).to_pylist()
            ends, done = [k for k in range(1, len(items)) if key_rows[k] != key_rows[k - 1]], []
            for low, high in zip([0, *ends], [*ends, len(items)] if items else []):
                if digest is None or at != key_rows[low]:
                    if digest is not None:
                        done.append(row())
                    at, digest, some, n, total = key_rows[low], hashlib.md5(b"["), False, 0, None
                if named := [i for i in items[low:high] if i is not None]:
                    digest.update(((", " if some else "") + ", ".join(named)).encode())
                    some = True
                n += high - low
                if known := [s for s in sizes[low:high] if s is not None]:
                    total = (total or 0) + sum(known)
            if done:
                yield made(done)
        if digest is not None:
            yield made([row()])

    from pyspark.sql.types import LongType, StringType, StructType

    schema = StructType(list(keys)).add("md5", StringType()).add("nfiles", LongType()).add("size", LongType())
    return ordered.mapInArrow(run, schema)


def hash_file(path: str) -> str:
    digest = hashlib.md5()
    with open(path, "rb") as f:
        while block := f.read(CHUNK):
            digest.update(block)
    return digest.hexdigest()


def hash_paths(paths: DataFrame) -> DataFrame:
    """``(path)`` -> ``(path, md5, size, error)``, reading files in blocks, not whole.

    Every file counts, also empty, dot- and underscore-named ones; what cannot be read has an error.
    """

    def run(batches: Iterator) -> Iterator:
        import pandas as pd

        for pdf in batches:
            rows = []
            for p in pdf["path"]:
                try:
                    rows.append((p, hash_file(p), os.path.getsize(p), None))
                except OSError as e:
                    rows.append((p, None, None, str(e)))
            yield pd.DataFrame(rows, columns=["path", "md5", "size", "error"]).astype({"size": "Int64"})

    return paths.select("path").mapInPandas(run, "path string, md5 string, size long, error string")
