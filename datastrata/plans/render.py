"""Pictures of a dependency graph. Lines are made as rows; only texts for people are collected."""

from __future__ import annotations

import html
import json

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from datastrata.runtime import cut


def mermaid_lines(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Node and edge lines of a flowchart, ``(kind, a, b, line)``; ids by the order of paths.

    Paths are range-partitioned, numbered in their partition, and the partitions' sizes added up: no task holds all nodes."""
    ranged = cut(nodes.select("id").repartitionByRange("id").withColumn("_p", F.spark_partition_id()))
    sizes = ranged.groupBy("_p").agg(F.count("*").alias("_n"))
    starts = sizes.select("_p", F.coalesce(F.sum("_n").over(W.orderBy("_p").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_start"))
    at = F.row_number().over(W.partitionBy("_p").orderBy("id")) - 1
    numbered = ranged.withColumn("_at", at).join(starts, "_p").select("id", (F.col("_start") + F.col("_at")).alias("k"))
    label = F.regexp_replace("id", '"', "'")
    node = numbered.select(F.lit("node").alias("kind"), F.col("id").alias("a"), F.lit(None).cast("string").alias("b"), F.concat(F.lit("  n"), F.col("k").cast("string"), F.lit('["'), label, F.lit('"]')).alias("line"))
    x, y = numbered.select(F.col("id").alias("src"), F.col("k").alias("x")), numbered.select(F.col("id").alias("dst"), F.col("k").alias("y"))
    edge = edges.join(x, "src").join(y, "dst")
    line = F.concat(F.lit("  n"), F.col("x").cast("string"), F.lit(" --> n"), F.col("y").cast("string"))
    return node.unionAll(edge.select(F.lit("edge").alias("kind"), F.col("src").alias("a"), F.col("dst").alias("b"), line.alias("line")))


def json_edges(edges: DataFrame) -> DataFrame:
    """Edges as lines of JSON, ``(src, dst, line)``."""
    return edges.select("src", "dst", F.to_json(F.struct(F.col("src").alias("from"), F.col("dst").alias("to"))).alias("line"))


def _rows(nodes: DataFrame, edges: DataFrame) -> tuple[list[dict], list[tuple[str, str]]]:
    """A graph small enough to look at, on the driver."""
    return [r.asDict() for r in nodes.orderBy("id").collect()], [tuple(r) for r in edges.select("src", "dst").distinct().orderBy("dst", "src").collect()]


def mermaid(nodes: DataFrame, edges: DataFrame) -> str:
    lines = mermaid_lines(nodes, edges).orderBy(F.col("kind").desc(), F.coalesce("b", "a"), "a").collect()
    return "\n".join(["flowchart TD", *[r["line"] for r in lines if r["kind"] == "node"], "", *[r["line"] for r in lines if r["kind"] == "edge"]])


def ascii_tree(nodes: DataFrame, edges: DataFrame) -> str:
    """Stages by folder, with the start of the hash and the number of dependencies."""
    found, links = _rows(nodes, edges)
    deps: dict[str, int] = {}
    for _, dst in links:
        deps[dst] = deps.get(dst, 0) + 1
    out, folder = [], None
    for n in sorted(found, key=lambda n: (n["id"].rpartition("/")[0], n["id"])):
        here = n["id"].rpartition("/")[0] or "."
        if here != folder:
            folder = here
            out.append(f"{here}/")
        md5 = f" {n['md5'][:8]}..." if n.get("md5") else ""
        count = f" ({deps[n['id']]} deps)" if n["id"] in deps else ""
        out.append(f"  {n['id'].rpartition('/')[2]}{md5}{count}")
    return "\n".join(out)


def dot(nodes: DataFrame, edges: DataFrame, members: DataFrame | None = None) -> str:
    """Graphviz: folders with known members as clusters, dependencies without metadata dashed."""
    found, links = _rows(nodes, edges)
    quote = lambda s: '"' + s.replace('"', '\\"') + '"'
    inside: dict[str, list[str]] = {}
    for r in members.orderBy("dir_path", "relpath").collect() if members is not None else []:
        inside.setdefault(r["dir_path"], []).append(r["relpath"])
    known = {n["id"] for n in found}
    files = {f"{d}/{r}" for d, rs in inside.items() for r in rs}
    out = ["digraph stages {", "  rankdir=TB;", "  node [shape=box];", "  compound=true;"]
    for k, (d, rs) in enumerate(inside.items()):
        out += [f"  subgraph cluster_{k} {{", f"    label={quote(d + '/')};", *[f"    {quote(f'{d}/{r}')} [label={quote(r)}];" for r in rs], "  }"]
    for n in found:
        if n["id"] not in inside:
            fill = ", style=filled, fillcolor=lightblue" if n.get("cmd") else ""
            out.append(f"  {quote(n['id'])} [label={quote(n['id'])}{fill}];")
    for d in sorted({s for s, _ in links} - known - files):
        out.append(f"  {quote(d)} [style=dashed, color=gray];")
    first = lambda p: f"{p}/{inside[p][0]}" if p in inside else p
    for k, (s, t) in enumerate(links):
        ends = [f"ltail=cluster_{list(inside).index(s)}"] if s in inside else []
        ends += [f"lhead=cluster_{list(inside).index(t)}"] if t in inside else []
        out.append(f"  {quote(first(s))} -> {quote(first(t))}{f' [{', '.join(ends)}]' if ends else ''};")
    return "\n".join([*out, "}"])


def graph_json(nodes: DataFrame, edges: DataFrame) -> str:
    found, links = _rows(nodes, edges)
    return json.dumps({"nodes": {n.pop("id"): n for n in found}, "edges": [{"from": s, "to": t} for s, t in sorted(links)]}, indent=2)


def html_page(nodes: DataFrame, edges: DataFrame) -> str:
    """A page with the graph as data and as a list; no script is needed to read it."""
    text = ascii_tree(nodes, edges)
    return f"<!DOCTYPE html><meta charset='utf-8'><title>Stages</title><pre>{html.escape(text)}</pre><script type='application/json'>{graph_json(nodes, edges).replace('</', '<\\/')}</script>"
