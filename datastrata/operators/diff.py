"""Differences between two versions: manifests, schemas, rows and lines."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

OK, NOT_TRACKED, CACHE_MISSING = "OK", "NOT_TRACKED", "CACHE_MISSING"


def manifest_diff(before: DataFrame, after: DataFrame, key: str = "relpath") -> DataFrame:
    """``(key, md5, size)`` twice -> a row per changed entry: added, removed or modified."""
    a = before.select(F.col(key).alias("_a"), F.col("md5").alias("old_md5"), F.col("size").alias("old_size"))
    b = after.select(F.col(key).alias("_b"), F.col("md5").alias("new_md5"), F.col("size").alias("new_size"))
    status = (
        F.when(F.col("_a").isNull(), "added")
        .when(F.col("_b").isNull(), "removed")
        .when(~F.col("old_md5").eqNullSafe(F.col("new_md5")), "modified")
    )
    joined = a.join(b, F.col("_a") == F.col("_b"), "full_outer").withColumn("status", status).where("status IS NOT NULL")
    return joined.select(F.coalesce("_a", "_b").alias(key), "status", "old_md5", "new_md5", "old_size", "new_size")


def version_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """Added, deleted, modified and renamed outputs: a rename is a removed and an added path of one hash."""
    d = manifest_diff(before, after, "path")
    gone = d.where("status = 'removed'").groupBy(F.col("old_md5").alias("md5")).agg(F.min("path").alias("from_path"))
    new = d.where("status = 'added'").groupBy(F.col("new_md5").alias("md5")).agg(F.min("path").alias("to_path"))
    moved = gone.join(new, "md5")
    left = d.join(moved, F.col("path").isin(F.col("from_path"), F.col("to_path")) & (F.coalesce("old_md5", "new_md5") == F.col("md5")), "left_anti")
    return left.select("path", F.lit(None).cast("string").alias("to_path"), F.when(F.col("status") == "removed", "deleted").otherwise(F.col("status")).alias("status")).unionAll(
        moved.select(F.col("from_path").alias("path"), "to_path", F.lit("renamed").alias("status"))
    )


def resolve_side(targets: DataFrame, versions: DataFrame, blobs: DataFrame) -> DataFrame:
    """``(path)`` -> ``(path, status, md5)``: what each path is in a version, and whether the store has it."""
    found = targets.join(versions.select("path", "md5"), "path", "left").join(
        blobs.select("md5").distinct().withColumn("_has", F.lit(True)), "md5", "left"
    )
    status = F.when(F.col("md5").isNull(), NOT_TRACKED).when(F.col("_has").isNull(), CACHE_MISSING).otherwise(OK)
    return found.select("path", status.alias("status"), "md5")


def schema_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """Columns that differ by name or type; a driver-side table of as many rows as columns."""
    a, b = dict(before.dtypes), dict(after.dtypes)
    rows = [
        (c, "added" if c not in a else "removed" if c not in b else "modified", a.get(c), b.get(c))
        for c in sorted(a.keys() | b.keys())
        if a.get(c) != b.get(c)
    ]
    return before.sparkSession.createDataFrame(rows, "column_name string, status string, old_type string, new_type string")


def row_count_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    counts = before.agg(F.count("*").alias("old_rows")).crossJoin(after.agg(F.count("*").alias("new_rows")))  # one row each
    return counts.withColumn("change", F.col("new_rows") - F.col("old_rows"))


def keyed_row_diff(before: DataFrame, after: DataFrame, keys: list[str]) -> DataFrame:
    """Changed rows by key, with the names of the columns that differ."""
    values = [c for c in before.columns if c in after.columns and c not in keys]
    a = before.select(*[F.col(k).alias(f"_a_{k}") for k in keys], F.struct(*values).alias("old"), F.lit(1).alias("_in_a"))
    b = after.select(*[F.col(k).alias(f"_b_{k}") for k in keys], F.struct(*values).alias("new"), F.lit(1).alias("_in_b"))
    on = [F.col(f"_a_{k}") == F.col(f"_b_{k}") for k in keys]
    differ = F.array_compact(F.array(*[F.when(~F.col(f"old.{c}").eqNullSafe(F.col(f"new.{c}")), F.lit(c)) for c in values]))
    status = F.when(F.col("_in_a").isNull(), "added").when(F.col("_in_b").isNull(), "removed").when(F.size(differ) > 0, "modified")
    joined = a.join(b, on, "full_outer").withColumn("status", status).where("status IS NOT NULL")
    changed = F.when(F.col("status") == "modified", F.array_join(differ, ",")).otherwise(F.lit(""))
    return joined.select(*[F.coalesce(f"_a_{k}", f"_b_{k}").alias(k) for k in keys], "status", changed.alias("changed"))


def multiset_row_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """Rows that one side has more often, with the surplus; one aggregation, no join."""
    cols = before.columns
    both = before.select(*cols, F.lit(-1).alias("_n")).unionAll(after.select(*cols, F.lit(1).alias("_n")))
    net = both.groupBy(*cols).agg(F.sum("_n").alias("n")).where("n <> 0")
    return net.select(F.when(F.col("n") > 0, "+").otherwise("-").alias("side"), *cols, F.abs("n").alias("copies"))


def sorted_unique_diff(before: DataFrame, after: DataFrame, column: str) -> DataFrame:
    a, b = before.select(column).distinct(), after.select(column).distinct()
    return a.join(b, column, "left_anti").select(F.lit("-").alias("side"), column).unionAll(
        b.join(a, column, "left_anti").select(F.lit("+").alias("side"), column)
    )


def head_diff(before: DataFrame, after: DataFrame, order: list[str], n: int) -> DataFrame:
    top = lambda d: d.orderBy(*order).limit(n)  # noqa: E731  the first rows are what is compared
    return multiset_row_diff(top(before), top(after))


def transformed_diff(before: DataFrame, after: DataFrame, steps: list[Callable[[DataFrame], DataFrame]], diff: Callable) -> DataFrame:
    """Run a pipeline on both sides, then compare."""
    for step in steps:
        before, after = before.transform(step), after.transform(step)
    return diff(before, after)


def positional_lines(docs: DataFrame, key: str, text: Column) -> DataFrame:
    return docs.select(key, F.posexplode(F.split(text, "\n")).alias("line_no", "line"))


def positional_line_diff(before: DataFrame, after: DataFrame, key: str, text: str = "text") -> DataFrame:
    """Lines that differ at one place of one document."""
    a = positional_lines(before, key, F.col(text)).withColumnsRenamed({"line": "old_line"})
    b = positional_lines(after, key, F.col(text)).withColumnsRenamed({"line": "new_line"})
    joined = a.join(b, [key, "line_no"], "full_outer")
    return joined.where(~F.col("old_line").eqNullSafe(F.col("new_line")))


def line_diff(pairs: DataFrame, key: str, ignore_space: bool = False, context: int = 3) -> DataFrame:
    """``(key, old, new)`` -> ``(key, diff)``: the hunks of an alignment with the fewest changed lines; empty where equal, null sides are empty.

    Equal texts, most of two snapshots, never go to Python."""
    from datastrata.functions.alignment import hunks

    def run(batches: Iterator) -> Iterator:
        for pdf in batches:
            pdf["diff"] = [hunks(a, b, context, ignore_space) for a, b in zip(pdf["old"], pdf["new"])]
            yield pdf[[key, "diff"]]

    schema = T.StructType([pairs.schema[key], T.StructField("diff", T.StringType())])
    differs = ~F.coalesce("old", F.lit("")).eqNullSafe(F.coalesce("new", F.lit("")))
    equal = pairs.where(~differs).select(key, F.lit("").alias("diff"))
    return pairs.where(differs).select(key, "old", "new").mapInPandas(run, schema).unionAll(equal)


def parse_refspec(refspec: str | None, ref: str | None) -> tuple[str, str | None]:
    """``a..b``, one ref against the worktree (None), or ``ref`` for its parent against it."""
    if refspec and ref:
        raise ValueError("give a range or a ref, not both")
    if ref:
        return f"{ref}^", ref
    if refspec and ".." in refspec:
        a, b = refspec.split("..", 1)
        return a or "HEAD", b or "HEAD"
    return refspec or "HEAD", None
