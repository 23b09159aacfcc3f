"""Which blobs to keep and which to delete."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def ranked(versions: DataFrame, by: list[str], tie: str = "md5") -> DataFrame:
    """Newest first within each artifact (each output of a stage is one)."""
    return versions.withColumn("rn", F.row_number().over(W.partitionBy(*by).orderBy(F.col("at").desc(), F.col(tie))))


def keep_set(versions: DataFrame, by: list[str], keep: int | None = None, newer_than: Column | None = None, tie: str = "md5") -> DataFrame:
    """Versions that a policy keeps: among the newest ``keep``, or not older than a time; either is enough."""
    rule = F.lit(False)
    if keep is not None:
        versions = ranked(versions, by, tie)
        rule = rule | (F.col("rn") <= keep)
    if newer_than is not None:
        rule = rule | (F.col("at") >= newer_than)
    return versions.where(rule)


def plan(blobs: DataFrame, kept: DataFrame, referenced: DataFrame, manifests: DataFrame | None = None, candidates: DataFrame | None = None) -> DataFrame:
    """Blobs to delete. Kept and referenced hashes stay, and so do the files inside kept directories;
    with ``candidates`` (the hashes of targeted artifacts) nothing else is touched."""
    keep = kept.select("md5").unionAll(referenced.select("md5")).distinct()
    if manifests is not None:
        inner = manifests.join(keep.select(F.col("md5").alias("dir_md5")), "dir_md5", "left_semi").select("md5")
        keep = keep.unionAll(inner).distinct()
    gone = blobs.join(keep, "md5", "left_anti")
    if candidates is not None:
        wide = candidates.select("md5")
        if manifests is not None:
            wide = wide.unionAll(manifests.join(wide.withColumnRenamed("md5", "dir_md5"), "dir_md5", "left_semi").select("md5"))
        gone = gone.join(wide.distinct(), "md5", "left_semi")
    return gone


def unsafe(plan_: DataFrame, remote: DataFrame) -> DataFrame:
    """What a safe run refuses to delete: not in the remote."""
    return plan_.join(remote.select("md5").distinct(), "md5", "left_anti")


def referenced(trees: DataFrame, refs: DataFrame, suffix: str = ".dvc") -> DataFrame:
    """Hashes that metadata files name at some refs: ``trees(ref, path, text)`` and ``refs(ref)`` -> distinct ``md5``."""
    files = trees.join(refs.select("ref").distinct(), "ref", "left_semi").where(F.col("path").endswith(suffix) & ~F.col("path").contains(".dvc/"))
    return files.select(F.explode(F.regexp_extract_all("text", F.lit(r"md5:\s*([0-9a-f]{32})"), 1)).alias("md5")).distinct()


def plan_at_refs(
    blobs: DataFrame, trees: DataFrame, refs: DataFrame, versions: DataFrame | None = None, by: list[str] | None = None, keep: int | None = None,
    newer_than: Column | None = None, manifests: DataFrame | None = None, candidates: DataFrame | None = None,
) -> DataFrame:
    """Blobs to delete given the metadata at some refs and a policy over the versions of artifacts."""
    kept = blobs.select("md5").limit(0)
    if versions is not None and (keep is not None or newer_than is not None):
        kept = keep_set(versions, by or ["path"], keep, newer_than).select("md5")
    return plan(blobs, kept, referenced(trees, refs), manifests, candidates)


def by_size(plan_: DataFrame) -> DataFrame:
    """The listing of a plan, largest first: a range-partitioned sort."""
    return plan_.orderBy(F.col("size").desc_nulls_last(), "md5")
