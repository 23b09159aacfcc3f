"""Dependency graphs as edge tables ``(src, dst)``: ``dst`` depends on ``src``.

Reachability goes round by round: a frontier join, distinct, and an
anti-join with what has been seen. Levels contract chains by doubling pointers. Each round's result is checkpointed, so plans
stay short and lost executors cost one round. Nodes of high degree are rows on the
streamed side of a join keyed by the frontier.
"""

from __future__ import annotations

from itertools import count

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from datastrata.operators.transfer import parent_directory
from datastrata.runtime import cut


class CycleError(ValueError):
    pass


def edges_of(deps: DataFrame, kinds: tuple[str, ...] = ("dep",)) -> DataFrame:
    """``stage_dep(stage, kind, dep_path)`` -> edges; a ``kind`` column tells data from git dependencies."""
    return deps.where(F.col("kind").isin(*kinds)).select(F.col("dep_path").alias("src"), F.col("stage").alias("dst"), "kind")


def attach_producers(edges: DataFrame, outs: DataFrame) -> DataFrame:
    """Edges on files rewritten to the stages that make them: by output path, then by nearest tracked folder."""
    direct = outs.select(F.col("path").alias("src"), F.col("stage").alias("_by"))
    folders = outs.select(F.col("path").alias("dir_path"), F.col("stage").alias("_of"))
    lone = edges.select("src").distinct().join(direct.select("src"), "src", "left_anti").withColumnRenamed("src", "path")
    inside = parent_directory(lone, folders).join(folders, "dir_path").select(F.col("path").alias("src"), "_of")
    joined = edges.join(direct, "src", "left").join(inside, "src", "left")
    return joined.withColumn("src", F.coalesce("_by", F.when(F.col("_of") != F.col("dst"), F.col("_of")), "src")).drop("_by", "_of")


def reach(edges: DataFrame, seeds: DataFrame, stop: DataFrame | None = None) -> DataFrame:
    """``seeds(id, root)`` -> ``(root, id, distance)`` of all that follows them along ``src -> dst``; nothing is followed
    from the nodes ``stop(id)``."""
    step = edges.select(F.col("src").alias("id"), F.col("dst").alias("_next")).distinct()
    if stop is not None:
        step = step.join(stop.select("id"), "id", "left_anti")
    seen = cut(seeds.select("root", "id", F.lit(0).alias("distance")).distinct())
    front = seen
    for k in count(1):  # a node is seen once for each root, so this ends
        new = front.join(step, "id").select("root", F.col("_next").alias("id")).distinct()
        front = cut(new.join(seen.select("root", "id"), ["root", "id"], "left_anti").withColumn("distance", F.lit(k)))
        if front.isEmpty():
            return seen.where("distance > 0")
        seen = seen.unionAll(front)


def walk_upstream(edges: DataFrame, targets: DataFrame, fresh: DataFrame | None = None) -> DataFrame:
    """``targets(id)`` and all that they depend on, ``(root, id, distance)``; what is behind ``fresh(id)`` nodes cannot
    matter and is left out."""
    flipped = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    seeds = targets.select("id", F.col("id").alias("root")).distinct()
    return seeds.select("root", "id", F.lit(0).alias("distance")).unionAll(reach(flipped, seeds, fresh))


def descendants(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    return reach(edges, nodes.select(F.col("id"), F.col("id").alias("root")))


def ancestors(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    flipped = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    return reach(flipped, nodes.select(F.col("id"), F.col("id").alias("root")))


def order(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``(id, level, place)``: a total order in which dependencies come first, by level, then by id. Places are counted within each level
    and added up over the table of levels, which has a row each."""
    placed = levels(nodes, edges)
    sizes = placed.groupBy("level").agg(F.count("*").alias("_n"))
    starts = sizes.select("level", F.coalesce(F.sum("_n").over(W.orderBy("level").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_start"))
    return placed.join(starts, "level").select("id", "level", (F.col("_start") + F.row_number().over(W.partitionBy("level").orderBy("id")) - 1).alias("place"))


def roots(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    return nodes.join(edges.select(F.col("dst").alias("id")), "id", "left_anti")


def leaves(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    return nodes.join(edges.select(F.col("src").alias("id")), "id", "left_anti")


def levels(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``(id, level)``: 0 without dependencies among the nodes, else one above the highest dependency.

    A node with one dependency has a level of the form max(base, level(to) + steps), and so has the chain of two such nodes; pointers
    that double contract chains of any length in logarithmic rounds. What is left are nodes with several dependencies, whose edges now
    start at the ends of the chains; edges from known levels go into their nodes' bases, which leaves fewer dependencies and so
    new chains. Nodes on a contracted chain get their levels at the end, from the ends of their chains. A chain longer than
    there are nodes is a cycle, which is an error, as is a round that nothing is known after.
    """
    some = nodes.select("id").distinct()
    inner = edges.select("src", "dst").join(some.select(F.col("id").alias("src")), "src", "left_semi").join(some.select(F.col("id").alias("dst")), "dst", "left_semi")
    left = cut(some.withColumn("base", F.lit(0)))
    inner = cut(inner.distinct().withColumn("steps", F.lit(1)))
    n_nodes, known, chains = left.count(), None, []
    while True:
        degrees = inner.groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("n"), F.min("src").alias("to"), F.max("steps").alias("steps"))
        state = cut(left.join(degrees, "id", "left"))
        ready = state.where("n IS NULL").select("id", F.col("base").alias("level"))
        known = ready if known is None else known.unionAll(ready)
        pointers = _contracted(state.where("n = 1").select("id", "to", "steps", "base"), n_nodes)
        chains.append(pointers)
        many = state.where("n > 1").select("id", "base")
        ends = pointers.select(F.col("id").alias("src"), "to", F.col("steps").alias("_more"), F.col("base").alias("_base"))
        into = inner.join(many.select(F.col("id").alias("dst")), "dst", "left_semi").join(ends, "src", "left").select(
            F.coalesce("to", "src").alias("src"), "dst", (F.col("steps") + F.coalesce("_more", F.lit(0))).alias("steps"), (F.col("_base") + F.col("steps")).alias("low")
        )
        met = cut(into.join(ready.withColumnRenamed("id", "src"), "src", "left"))
        lows = met.groupBy(F.col("dst").alias("id")).agg(F.max(F.greatest("low", F.col("level") + F.col("steps"))).alias("low"))
        before, left = state, cut(many.join(lows, "id", "left").select("id", F.greatest("base", "low").alias("base")))
        if left.isEmpty():
            break
        if ready.isEmpty():
            _cycle(before)
        inner = cut(met.where("level IS NULL").groupBy("src", "dst").agg(F.max("steps").alias("steps")))
    for pointers in reversed(chains):
        ended = pointers.join(known.select(F.col("id").alias("to"), "level"), "to")
        known = cut(known.unionAll(ended.select("id", F.greatest("base", F.col("level") + F.col("steps")).alias("level"))))
    if known.count() < n_nodes:
        _cycle(some.join(known, "id", "left_anti"))
    return known


def _contracted(pointers: DataFrame, n_nodes: int) -> DataFrame:
    """``(id, to, steps, base)``, a pointer a node, each followed to the first node that has none."""
    pointers = cut(pointers)
    for _ in range(max(n_nodes, 2).bit_length() + 1):
        far = pointers.select(F.col("id").alias("to"), F.col("to").alias("_to"), F.col("steps").alias("_steps"), F.col("base").alias("_base"))
        more = cut(pointers.join(far, "to", "left"))
        moved = not more.where("_to IS NOT NULL").isEmpty()
        if not moved:
            return pointers
        pointers = more.select(
            "id",
            F.coalesce("_to", "to").alias("to"),
            F.least(F.col("steps") + F.coalesce("_steps", F.lit(0)), F.lit(n_nodes)).alias("steps"),
            F.greatest("base", F.col("_base") + F.col("steps")).alias("base"),
        )
    _cycle(pointers.join(pointers.select(F.col("id").alias("to")), "to", "left_semi"))


def _cycle(nodes: DataFrame) -> None:
    raise CycleError(f"circular dependency among {[r['id'] for r in nodes.select('id').orderBy('id').limit(10).collect()]}")


def classes(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``(id, class)``: a root depends on nothing; any other is a leaf if nothing depends on it, else in the middle."""
    has = edges.groupBy(F.col("dst").alias("id")).agg(F.lit(1).alias("_in"))
    feeds = edges.groupBy(F.col("src").alias("id")).agg(F.lit(1).alias("_out"))
    kind = F.when(F.col("_in").isNull(), "root").when(F.col("_out").isNull(), "leaf").otherwise("middle")
    return nodes.select("id").join(has, "id", "left").join(feeds, "id", "left").select("id", kind.alias("class"))


def view(nodes: DataFrame, edges: DataFrame, text: str | None = None) -> tuple[DataFrame, DataFrame]:
    """The part of a graph to look at: nodes whose id contains a text, in any case, the edges at them, and their neighbours."""
    if not text:
        return nodes, edges
    chosen = nodes.where(F.lower("id").contains(text.lower())).select("id")
    mark = lambda c: chosen.select(F.col("id").alias(c), F.lit(True).alias(f"_{c}"))
    seen = edges.join(mark("src"), "src", "left").join(mark("dst"), "dst", "left").where("_src OR _dst").select("src", "dst")
    ends = seen.select(F.col("src").alias("id")).unionAll(seen.select(F.col("dst").alias("id"))).unionAll(chosen).distinct()
    return nodes.join(ends, "id", "left_semi"), seen


def neighbours(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """``(id, other, side)``: what each of ``ids(id)`` depends on, and what depends on it."""
    needs = edges.join(ids.select(F.col("id").alias("dst")), "dst", "left_semi").select(F.col("dst").alias("id"), F.col("src").alias("other"), F.lit("needs").alias("side"))
    feeds = edges.join(ids.select(F.col("id").alias("src")), "src", "left_semi").select(F.col("src").alias("id"), F.col("dst").alias("other"), F.lit("feeds").alias("side"))
    return needs.unionAll(feeds)


def stats(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: nodes, edges, roots, leaves and nodes with a command."""
    has = edges.groupBy(F.col("dst").alias("id")).agg(F.lit(1).alias("_in"))
    feeds = edges.groupBy(F.col("src").alias("id")).agg(F.lit(1).alias("_out"))
    flagged = nodes.join(has, "id", "left").join(feeds, "id", "left")
    n_edges = edges.agg(F.count("*").alias("edges"))
    counts = flagged.agg(
        F.count("*").alias("nodes"),
        F.count_if(F.col("_in").isNull()).alias("roots"),
        F.count_if(F.col("_out").isNull()).alias("leaves"),
        F.count_if(F.col("cmd").isNotNull()).alias("with_cmd"),
    )
    return counts.crossJoin(n_edges)  # one row each


def transitive_status(status: DataFrame, edges: DataFrame) -> DataFrame:
    """``(id, status, reason)`` -> the same, where fresh nodes behind stale or missing ones are transitive.

    The reason names the predecessor through which the staleness comes first: least
    distance, then least id. Errors neither spread nor change.
    """
    seeds = status.where(F.col("status").isin("stale", "missing")).select("id")
    seen = cut(seeds.select("id", F.lit(None).cast(status.schema["id"].dataType).alias("via")))
    front = seen
    step = edges.select(F.col("src").alias("id"), F.col("dst").alias("_next"))
    while True:
        new = front.join(step, "id").groupBy(F.col("_next").alias("id2")).agg(F.min("id").alias("via"))
        front = cut(new.withColumnRenamed("id2", "id").join(seen.select("id"), "id", "left_anti"))
        if front.isEmpty():
            break
        seen = seen.unionAll(front)
    hit = (F.col("status") == "fresh") & F.col("via").isNotNull()
    joined = status.join(seen, "id", "left")
    return joined.select(
        "id",
        F.when(hit, "transitive").otherwise(F.col("status")).alias("status"),
        F.when(hit, F.concat(F.lit("upstream stale: "), F.col("via").cast("string"))).otherwise(F.col("reason")).alias("reason"),
    )
