"""What to move between stores: listings and joins instead of a request per object."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from datastrata.runtime import cut


def missing(needed: DataFrame, store: DataFrame) -> DataFrame:
    return needed.join(store.select("md5").distinct(), "md5", "left_anti")


def transfer_status(outs: DataFrame, store: DataFrame, stages: DataFrame | None = None) -> DataFrame:
    """``(path, md5, size)`` with ``state``: cached, missing, or error where there is no hash. Outputs of git-tracked ``stages`` are
    not in any store and left out."""
    if stages is not None:
        outs = outs.join(stages.where("git_tracked").select(F.col("path").alias("stage")), "stage", "left_anti")
    has = store.select("md5").distinct().withColumn("_has", F.lit(True))
    state = F.when(F.col("md5").isNull(), "error").when(F.col("_has"), "cached").otherwise("missing")
    return outs.join(has, "md5", "left").select("path", "md5", "size", state.alias("state"))


def totals(status: DataFrame) -> DataFrame:
    return status.groupBy("state").agg(F.count("*").alias("n"), F.coalesce(F.sum("size"), F.lit(0)).cast("long").alias("bytes"))


def explode_manifests(directories: DataFrame) -> DataFrame:
    """``(dir_md5, manifest)``, the manifest as JSON text -> ``(dir_md5, relpath, md5)``; bad JSON has no entry."""
    entries = F.from_json("manifest", "array<struct<md5: string, relpath: string>>")
    return directories.select("dir_md5", F.explode(entries).alias("e")).select("dir_md5", "e.relpath", "e.md5").where("md5 IS NOT NULL")


def gap_fill(entries: DataFrame, remote: DataFrame, local: DataFrame) -> DataFrame:
    """Inner blobs that the remote lacks: ``upload`` where the local store has them, else ``unfillable``."""
    gaps = missing(entries.select("md5").distinct(), remote)
    has = local.select("md5").distinct().withColumn("_has", F.lit(True))
    return gaps.join(has, "md5", "left").select("md5", F.when(F.col("_has"), "upload").otherwise("unfillable").alias("action"))


def closure(wanted: DataFrame, entries_of: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``wanted(md5, is_dir)`` and all that their listings name, at any depth: a round for each depth, and each listing is read once."""
    seen = front = cut(wanted.where("md5 IS NOT NULL").groupBy("md5").agg(F.max("is_dir").alias("is_dir")))
    while True:
        found = entries_of(front.where("is_dir").select("md5")).groupBy("md5").agg(F.max("is_dir").alias("is_dir"))
        front = cut(found.join(seen.select("md5"), "md5", "left_anti"))
        if front.isEmpty():
            return seen
        seen = seen.unionAll(front)


def movement(needed: DataFrame, source: DataFrame, target: DataFrame) -> DataFrame:
    """``needed(md5, is_dir)`` against both listings: ``there``, to ``copy``, or ``missing``."""
    has = lambda side, name: side.select("md5").distinct().withColumn(name, F.lit(True))
    joined = needed.join(has(target, "_there"), "md5", "left").join(has(source, "_here"), "md5", "left")
    return joined.select("md5", "is_dir", F.when(F.col("_there"), "there").when(F.col("_here"), "copy").otherwise("missing").alias("state"))


def folder_totals(files: DataFrame) -> DataFrame:
    """``files(path, state, size)`` -> ``(folder, state, n, bytes)`` for every folder at any depth, '' the top.

    Files are added up by their own folder first, so only folders are exploded into their ancestors."""
    own = files.groupBy(F.regexp_extract("path", "^(.*)/[^/]*$", 1).alias("_in"), "state").agg(F.count("*").alias("n"), F.sum("size").alias("bytes"))
    parts = F.split("_in", "/")
    above = F.when(F.col("_in") == "", F.array(F.lit(""))).otherwise(
        F.concat(F.array(F.lit("")), F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, 1, k), "/")))
    )
    spread = own.select(F.explode(above).alias("folder"), "state", "n", "bytes")
    return spread.groupBy("folder", "state").agg(F.sum("n").alias("n"), F.coalesce(F.sum("bytes"), F.lit(0)).cast("long").alias("bytes"))


def parent_directory(files: DataFrame, tracked: DataFrame) -> DataFrame:
    """Each file's nearest tracked ancestor: ``(path, dir_path, relpath)``. Ancestors are exploded and
    joined by equality, so there is no nested loop over prefixes."""
    from datastrata.functions.paths import ancestors

    wide = files.select("path", F.posexplode(ancestors(F.col("path"))).alias("depth", "dir_path"))
    hit = wide.join(tracked.select("dir_path").distinct(), "dir_path")
    nearest = hit.groupBy("path").agg(F.max_by("dir_path", "depth").alias("dir_path"))
    return nearest.withColumn("relpath", F.substring("path", F.length("dir_path") + 2, F.lit(1 << 30)))


def file_hash(files: DataFrame, outs: DataFrame, entries: DataFrame) -> DataFrame:
    """A file's hash: its own metadata, else its entry in the nearest tracked directory."""
    direct = outs.select("path", F.col("md5").alias("_own"))
    dirs = outs.where("is_dir").select(F.col("path").alias("dir_path"), F.col("md5").alias("dir_md5"))
    inside = parent_directory(files, dirs).join(dirs, "dir_path").join(entries.withColumnRenamed("md5", "_inner"), ["dir_md5", "relpath"])
    return files.join(direct, "path", "left").join(inside.select("path", "_inner"), "path", "left").select("path", F.coalesce("_own", "_inner").alias("md5"))


def stage_policy(stages: DataFrame, config: DataFrame, commit: str = "auto", push: str = "never") -> DataFrame:
    """Commit and push policy of each stage: its override, with or without suffix, else the default."""
    c = config.select(F.regexp_replace("path", r"\.dvc$", "").alias("_k"), F.col("commit").alias("_c"), F.col("push").alias("_p"))
    # The configuration is a hand-written file; Spark broadcasts it by its size.
    return stages.join(c, F.regexp_replace("stage", r"\.dvc$", "") == F.col("_k"), "left").select(
        "stage", F.coalesce("_c", F.lit(commit)).alias("commit"), F.coalesce("_p", F.lit(push)).alias("push")
    )


def co_outputs(outs: DataFrame) -> DataFrame:
    """Outputs of one command, as one unit of work."""
    return outs.where("cmd IS NOT NULL").groupBy("cmd").agg(F.min("path").alias("first_path"), F.count("*").alias("n_outs"))
