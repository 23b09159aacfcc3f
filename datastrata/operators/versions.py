"""Version history: first appearances, change points, state at a ref."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def first_seen(history: DataFrame, by: list[str]) -> DataFrame:
    """``(*by, md5, sha, at)`` -> each hash with its earliest commit."""
    return history.groupBy(*by, "md5").agg(F.min("at").alias("first_at"), F.min_by("sha", F.struct("at", "sha")).alias("first_sha"))


def change_points(history: DataFrame, by: list[str]) -> DataFrame:
    """Commits whose hash differs from the one before; the first one counts."""
    w = W.partitionBy(*by).orderBy("at", "sha")
    marked = history.withColumn("_before", F.lag("md5").over(w)).withColumn("_n", F.row_number().over(w))
    return marked.where((F.col("_n") == 1) | ~F.col("md5").eqNullSafe(F.col("_before"))).drop("_before", "_n")


def hash_commit(history: DataFrame, wanted: DataFrame, by: list[str]) -> DataFrame:
    """The newest commit that brought or removed each wanted ``(*by, md5)``."""
    w = W.partitionBy(*by).orderBy("at", "sha")
    h = history.withColumn("_before", F.lag("md5").over(w))
    came = h.where(~F.col("md5").eqNullSafe(F.col("_before"))).select(*by, "md5", "sha", "at")
    went = h.where(F.col("_before").isNotNull() & ~F.col("md5").eqNullSafe(F.col("_before"))).select(*by, F.col("_before").alias("md5"), "sha", "at")
    return came.unionAll(went).join(wanted, [*by, "md5"], "left_semi").groupBy(*by, "md5").agg(F.max_by("sha", F.struct("at", "sha")).alias("sha"))


def state_at(history: DataFrame, by: list[str], when: Column) -> DataFrame:
    """The last version of each at or before a time."""
    return history.where(F.col("at") <= when).groupBy(*by).agg(F.max_by(F.struct("md5", "sha", "at"), F.struct("at", "sha")).alias("v")).select(*by, "v.*")


def state_at_refs(history: DataFrame, by: list[str], refs: DataFrame) -> DataFrame:
    """``history(*by, md5, sha, at)`` and ``refs(ref, at)`` -> ``(*by, ref, md5, sha, at)``: the last version of each at or before every ref's time.

    A version can only be the last one of the refs from the first that is not before it, so versions are added up by that ref's place:
    what is left is a row for each artifact and ref at most, whose last one is carried on. A long history is never one task's."""
    times = refs.agg(F.array_sort(F.collect_list(F.struct("at", "ref"))).alias("_refs"))  # one row, as long as there are refs
    place = F.size(F.filter("_refs", lambda r: r["at"] < F.col("at")))
    dated = history.crossJoin(times).withColumn("_k", place).where(F.col("_k") < F.size("_refs"))
    last = dated.groupBy(*by, "_k").agg(F.max_by(F.struct("md5", "sha", "at"), F.struct("at", "sha")).alias("v"))
    following = F.lead("_k").over(W.partitionBy(*by).orderBy("_k"))
    spans = last.crossJoin(times).withColumn("_next", F.coalesce(following, F.size("_refs")))
    carried = spans.withColumn("_at", F.explode(F.sequence("_k", F.col("_next") - 1)))
    return carried.select(*by, F.col("_refs")[F.col("_at")]["ref"].alias("ref"), "v.md5", "v.sha", "v.at")


def changed_since(old: DataFrame, new: DataFrame, targets: DataFrame) -> DataFrame:
    """Tri-state: null where either side lacks the path."""
    a, b = old.select("path", F.col("sha").alias("_a")), new.select("path", F.col("sha").alias("_b"))
    return targets.join(a, "path", "left").join(b, "path", "left").select("path", (F.col("_a") != F.col("_b")).alias("changed"))


def at_ref(tree: DataFrame, ref: str, targets: list[str] | None = None, suffix: str = ".dvc") -> DataFrame:
    """Metadata files at a ref: all, or those that a target names exactly or as a folder."""
    found = tree.where((F.col("ref") == ref) & F.col("path").endswith(suffix) & ~F.col("path").rlike(r"(^|/)\.dvc/"))
    if not targets:
        return found
    clean = [t.rstrip("/") for t in targets]
    exact = [t if t.endswith(suffix) else t + suffix for t in clean]
    keep = F.col("path").isin(exact)
    for t in clean:
        keep = keep | F.col("path").startswith(t + "/")
    return found.where(keep)


def transfer_at(history: DataFrame, by: list[str], when: Column, store: DataFrame, targets: DataFrame | None = None) -> DataFrame:
    """Transfer status of what was tracked at a time: ``history(*by, md5, size, sha, at)`` -> ``(*by, md5, size, state)``."""
    newest = history.where(F.col("at") <= when).groupBy(*by).agg(F.max_by(F.struct("md5", "size"), F.struct("at", "sha")).alias("v")).select(*by, "v.*")
    if targets is not None:
        newest = newest.join(targets, by, "left_semi")
    has = store.select("md5").distinct().withColumn("_has", F.lit(True))
    state = F.when(F.col("md5").isNull(), "error").when(F.col("_has"), "cached").otherwise("missing")
    return newest.join(has, "md5", "left").select(*by, "md5", "size", state.alias("state"))
