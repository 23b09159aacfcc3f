"""What the paths that a user names stand for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from datastrata.functions.paths import ancestors, output_path
from datastrata.functions.scalars import glob_regex


def _named(targets: DataFrame) -> DataFrame:
    clean = F.regexp_replace("target", "(?<=.)/+$", "")
    return targets.select("target", output_path(clean).alias("_name"), clean.endswith(".dvc").alias("_exact"))


def _below(stages: DataFrame) -> DataFrame:
    """``(dir, stage)``: every folder above a stage, as rows to join by equality."""
    folders = stages.select("stage", F.explode(F.array_union(ancestors(F.col("stage")), F.array(F.lit(".")))).alias("_dir"))
    return folders.where(~F.col("stage").startswith("/")).select("_dir", F.col("stage").alias("_in"))


def expand(targets: DataFrame, stages: DataFrame, files: DataFrame) -> DataFrame:
    """``(target, path, kind)`` for status: a metadata file is its stage; a name with metadata its stage; any other folder
    all stages below it; any other file that exists a ``file``, perhaps in a tracked folder; the rest is ``unknown``.

    ``stages(stage)``, ``files(path)``."""
    own = stages.select(F.col("stage").alias("_own")).distinct()
    found = _named(targets).join(own, F.col("_name") == F.col("_own"), "left")
    direct = found.where(F.col("_exact") | F.col("_own").isNotNull()).select("target", F.col("_name").alias("path"), F.when(F.col("_own").isNotNull(), "stage").otherwise("unknown").alias("kind"))
    rest = found.where(~F.col("_exact") & F.col("_own").isNull()).select("target", "_name")
    inside = rest.join(_below(stages), F.col("_name") == F.col("_dir")).select("target", F.col("_in").alias("path"), F.lit("stage").alias("kind"))
    lone = rest.join(inside.select("target").distinct(), "target", "left_anti")
    there = lone.join(files.select(F.col("path").alias("_file")).distinct(), F.col("_name") == F.col("_file"), "left")
    alone = there.select("target", F.col("_name").alias("path"), F.when(F.col("_file").isNotNull(), "file").otherwise("unknown").alias("kind"))
    return direct.unionAll(inside).unionAll(alone)


def for_transfer(targets: DataFrame, stages: DataFrame) -> DataFrame:
    """``(target, path)`` for transfers: a folder with stages below it stands for those, else a name for its own stage; a name that
    stands for nothing has a null path."""
    named = _named(targets)
    inside = named.where(~F.col("_exact")).join(_below(stages), F.col("_name") == F.col("_dir")).select("target", F.col("_in").alias("path"))
    rest = named.join(inside.select("target").distinct(), "target", "left_anti")
    own = stages.select(F.col("stage").alias("_own")).distinct()
    single = rest.join(own, F.col("_name") == F.col("_own"), "left").select("target", F.when(F.col("_exact"), F.col("_name")).otherwise(F.col("_own")).alias("path"))
    return inside.unionAll(single)


def by_pattern(paths: DataFrame, patterns: list[str], column: str = "path") -> DataFrame:
    """The paths that some shell pattern matches."""
    rule: Column = F.col(column).rlike(glob_regex(patterns)) if patterns else F.lit(False)
    return paths.where(rule)
