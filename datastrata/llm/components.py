"""Connected components of a link table, by alternating large-star and small-star.

Every round hangs neighbours on smaller ids with a partial-aggregated minimum per node
and one join, so a hub with a third of all links is one row of the minimum table and its
links are split by AQE's skew join. No group is gathered. Before every round, a task makes stars of the
edges that it reads, so many at a time, whatever their components; what fits one task is done by that. Rounds are written
to the shared folder.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from datastrata.llm.common import free, written


#: Edges that a task joins at once. A table of no more is done by one task, in one step.
EDGES = 1_000_000


def stars(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges -> for each id but the least of its component, an edge to that."""
    ids, ends = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = ends[: len(u)], ends[len(u) :]
    root = np.arange(len(ids))
    while True:
        x, y = root[a], root[b]
        apart = x != y
        if not apart.any():
            break
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))  # roots hang on lesser ids
        while (root[root] != root).any():
            root = root[root]
    hung = root != np.arange(len(ids))
    return ids[hung], ids[root[hung]]


def _contracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges (u, v) -> fewer ones of the same components: those of each ``EDGES`` rows of a partition as stars."""
    held: list[pa.RecordBatch] = []

    def flush() -> pa.RecordBatch:
        u, v = stars(*(np.concatenate([b.column(k).to_numpy(zero_copy_only=False) for b in held]) for k in (0, 1)))
        return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])

    for batch in batches:
        if batch.num_rows:
            held.append(batch)
        if sum(b.num_rows for b in held) >= EDGES:
            yield flush()
            held = []
    if held:
        yield flush()


def _least(edges: DataFrame, tasks: int) -> DataFrame:
    return edges.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m")).coalesce(tasks)


def _large_star(edges: DataFrame, tasks: int) -> DataFrame:
    both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    hung = both.join(_least(both, tasks), "u").where(F.col("v") > F.col("u"))
    return hung.select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame, tasks: int) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m")).coalesce(tasks)
    hung = down.join(least, "u").where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return hung.unionAll(least.select("u", F.col("m").alias("v")))


def components(links: DataFrame, name: str = "components") -> DataFrame:
    """``(a, b)`` links -> ``(id, root)`` for every id that has a link to another; the
    root is the smallest id of the component, and not listed under itself."""
    edges = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v")
    sums = {"n": F.count(F.lit(1)), "mark": F.bit_xor(F.xxhash64("u", "v"))}
    edges = written(edges.distinct(), name, **sums)
    while edges.measured["n"]:  # every round but the last lowers the ends of some edge
        before, tasks = edges, -(-edges.measured["n"] // EDGES)
        step = edges.coalesce(tasks).mapInArrow(_contracted, "u long, v long")
        if tasks > 1:
            step = _small_star(_large_star(step, tasks), tasks).where("u <> v").distinct().coalesce(tasks)
        edges = written(step, name, **sums)
        free(before)
        if tasks == 1 or edges.measured == before.measured:
            break
    return edges.select(F.col("u").alias("id"), F.col("v").alias("root"))


def extended(roots: DataFrame, links: DataFrame, name: str = "components") -> DataFrame:
    """Components of what ``roots`` are the components of, with some more links: only the roots are joined anew."""
    of = lambda c: roots.select(F.col("id").alias(c), F.col("root").alias(f"{c}_root"))
    between = links.join(of("a"), "a", "left").join(of("b"), "b", "left")
    between = between.select(F.coalesce("a_root", "a").alias("a"), F.coalesce("b_root", "b").alias("b"))
    top = components(between, name)
    moved = roots.join(top.select(F.col("id").alias("_id"), F.col("root").alias("_root")), F.col("root") == F.col("_id"), "left")
    return written(moved.select("id", F.coalesce("_root", "root").alias("root")).unionAll(top), name)
