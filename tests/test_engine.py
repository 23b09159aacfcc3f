"""Literal cases of the engine's rules, and a catalog from end to end."""

import datetime as dt
import hashlib
import json
import os
import random
import re
import subprocess

import pytest
from pyspark.sql import functions as F

from datastrata.catalog import Catalog
from datastrata.functions import hashing, paths, scalars
from datastrata.operators import diff, freshness, graph, retention, transfer, versions
from datastrata.plans import artifacts, render, runner
from datastrata.sources import config, metadata, urls
from datastrata.sources import git as repo
from datastrata.sources.store import Store, copy, hash_path


def one(spark, *columns):
    return tuple(spark.range(1).select(*columns).first())


@pytest.mark.parametrize(
    "folder, dep, wanted",
    [
        ("njsp/data", "crashes.parquet", "njsp/data/crashes.parquet"),
        ("www/public", "/njsp/data/crashes.parquet", "njsp/data/crashes.parquet"),
        ("njsp/data", "njsp/data/crashes.parquet", "njsp/data/crashes.parquet"),
        (".", "data.txt", "data.txt"),
        ("a/b", "../../c", "c"),
        ("a", "../../c", "../c"),
    ],
)
def test_resolve(spark, folder, dep, wanted):
    assert one(spark, paths.resolve(F.lit(folder), F.lit(dep))) == (wanted,)
    assert metadata.resolve(folder, dep) == wanted


@pytest.mark.parametrize(
    "folder, dep, wanted",
    [("njsp/data", "njsp/data/crashes.parquet", "crashes.parquet"), ("njsp/data", "www/index.html", "/www/index.html"), (".", "a/b", "a/b")],
)
def test_relativize(spark, folder, dep, wanted):
    assert one(spark, paths.relativize(F.lit(folder), F.lit(dep))) == (wanted,)
    assert metadata.relativize(folder, dep) == wanted


def test_path_parts(spark):
    assert one(spark, paths.ancestors(F.lit("a/b/c.txt")), paths.metadata_path(F.lit("x")), paths.output_path(F.lit("x.dvc")), paths.parent(F.lit("a/b"))) == (["a", "a/b"], "x.dvc", "x", "a")
    assert one(spark, paths.blob_path("c", F.lit("abcdef")), paths.default_out(F.lit("http://h/a/b%20c.txt?x=1")), paths.default_out(F.lit("http://h/a/"))) == ("c/files/md5/ab/cdef", "b c.txt", None)


@pytest.mark.parametrize("n, text", [(100, "100 B"), (1024, "1.0 KB"), (1048576, "1.0 MB"), (1073741824, "1.0 GB"), (None, "?"), (0, "0 B"), (3 * 1024**5, "3.0 PB"), (1280, "1.2 KB"), (1408, "1.4 KB"), (1331, "1.3 KB"), (1048575, "1024.0 KB"), (-1536, "-1.5 KB")])
def test_format_size(spark, n, text):
    assert one(spark, scalars.format_size(F.lit(n).cast("long"))) == (text,)


@pytest.mark.parametrize("n, text", [(3599999 * 1000003, "3352.8 GB"), (1024**4, "1024.0 GB"), (1024**4 - 1, "1024.0 GB"), (1024**2, "1.0 MB"), (100, "100 B"), (None, "?")])
def test_format_size_up_to_a_unit(spark, n, text):
    assert one(spark, scalars.format_size(F.lit(n).cast("long"), "GB")) == (text,)


def test_format_size_query_of_large_keys(spark, tmp_path):
    """Part keys of sixty times the largest test tables: sizes beyond a terabyte."""
    duckdb = pytest.importorskip("duckdb")
    from datastrata.queries import ORACLE_SQL, QUERIES

    keys = "SELECT range AS l_orderkey, range * 7919 % 1200000 AS l_partkey, CAST(1 + range % 7 AS INTEGER) AS l_linenumber FROM range(7000)"
    duckdb.sql(f"COPY ({keys}) TO '{tmp_path}/lineitem.parquet' (FORMAT parquet)")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{tmp_path}/lineitem.parquet'")
    wanted = sorted(con.execute(ORACLE_SQL["format_size"]).fetchall())
    assert any(float(label[:-3]) >= 1024 for *_, label in wanted if label.endswith(" GB"))
    assert sorted(map(tuple, QUERIES["format_size"](spark, str(tmp_path)).collect())) == wanted


def test_durations():
    assert scalars.parse_duration("7d") == dt.timedelta(days=7) and scalars.parse_duration("24h") == dt.timedelta(hours=24)
    assert scalars.parse_duration("1w") == dt.timedelta(weeks=1)
    for bad in ("abc", "30m", ""):
        with pytest.raises(ValueError):
            scalars.parse_duration(bad)


@pytest.mark.parametrize(
    "schedule, last, now, due",
    [
        ("daily", None, "2026-04-08T00:00:00Z", True),
        ("manual", None, "2026-04-08T00:00:00Z", False),
        ("daily", "2026-04-07T12:00:00Z", "2026-04-08T11:00:00Z", False),
        ("daily", "2026-04-07T12:00:00Z", "2026-04-08T13:00:00Z", True),
        ("hourly", "2026-04-07T12:00:00Z", "2026-04-07T12:30:00Z", False),
        ("hourly", "2026-04-07T12:00:00Z", "2026-04-07T13:01:00Z", True),
        ("weekly", "2026-04-01T12:00:00Z", "2026-04-07T12:00:00Z", False),
        ("weekly", "2026-04-01T12:00:00Z", "2026-04-09T12:00:00Z", True),
        ("daily", "2026-04-07T12:00:00", "2026-04-08T13:00:00Z", True),
        ("0 6 * * *", "2026-04-07T12:00:00Z", "2026-04-08T05:59:00Z", False),
        ("0 6 * * *", "2026-04-07T12:00:00Z", "2026-04-08T06:00:00Z", True),
        ("0 6 * * *", None, "2026-04-08T06:00:00Z", True),
        ("sometimes", "2026-04-07T12:00:00Z", "2026-04-08T06:00:00Z", None),
    ],
)
def test_schedule(spark, schedule, last, now, due):
    column = scalars.fetch_due(F.lit(schedule), scalars.from_iso(F.lit(last).cast("string")), scalars.from_iso(F.lit(now)))
    assert one(spark, column) == (due,)


def test_cron():
    at = dt.datetime(2026, 4, 7, 12, 0)  # a Tuesday
    assert scalars.cron_next("0 6 * * *", at) == dt.datetime(2026, 4, 8, 6)
    assert scalars.cron_next("*/15 * * * *", at) == dt.datetime(2026, 4, 7, 12, 15)
    assert scalars.cron_next("0 0 * * 1", at) == dt.datetime(2026, 4, 13)
    assert scalars.cron_next("30 1 29 2 *", at) == dt.datetime(2028, 2, 29, 1, 30)
    assert scalars.cron_next("0 0 29 2 *", dt.datetime(2096, 3, 1)) == dt.datetime(2104, 2, 29)
    with pytest.raises(ValueError):
        scalars.cron_next("61 * * * *", at)


def test_times_and_patterns(spark):
    assert one(spark, scalars.from_http_date(F.lit("Tue, 07 Apr 2026 12:00:00 GMT")).cast("string")) == ("2026-04-07 12:00:00",)
    assert one(spark, scalars.matches(F.lit("a/b/c.txt"), ["a/*.txt"]), scalars.matches(F.lit("a.md"), ["?.tx", "b*"]), scalars.matches(F.lit("a"), [])) == (True, False, False)
    assert one(spark, scalars.is_md5(F.lit("D41D8CD98F00B204E9800998ECF8427E")), scalars.is_md5(F.lit("d41d8cd98f00b204e9800998ecf8427e.dir")), scalars.is_md5(F.lit("xyz"))) == (True, True, False)


def test_status_names():
    assert scalars.status_names("s,m") == ["stale", "missing"] and scalars.status_names("") is None
    for bad in ("q", "s,,m"):
        with pytest.raises(ValueError):
            scalars.status_names(bad)


def test_hashes(spark, tmp_path):
    assert one(spark, hashing.content_hash(F.lit("test data\n"))) == ("39a870a194a787550b6b5d1f49629236",)
    assert one(spark, hashing.git_blob_sha(F.lit("hello\n"))) == ("ce013625030ba8dba906f756967f9e9ca394464a",)
    for name in (".hidden", "_under", "empty", "plain"):
        (tmp_path / name).write_text("" if name == "empty" else name)
    found = {os.path.basename(r.path): (r.md5, r.size, r.error) for r in hashing.hash_paths(spark.createDataFrame([(str(tmp_path / n),) for n in (".hidden", "_under", "empty", "gone")], "path string")).collect()}
    assert found["empty"] == ("d41d8cd98f00b204e9800998ecf8427e", 0, None) and found[".hidden"][1] == 7 and found["gone"][2]


def test_directory_hash_is_that_of_its_json(spark, tmp_path):
    for name in ("b.txt", "é\"q\\.txt", "😀.txt", "sub/a.txt", "tab\tx"):
        p = tmp_path / "d" / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(name)
    md5, size, nfiles = hash_path(str(tmp_path / "d"))
    rows = [("x", r, m, s) for r, m, s in __import__("datastrata.sources.store", fromlist=["listing"]).listing(str(tmp_path / "d"))]
    got = hashing.directory_hashes(spark.createDataFrame(rows, "dir string, relpath string, md5 string, size long"), ["dir"]).first()
    assert (got.md5, got["size"], got.nfiles) == (md5, size, nfiles)
    assert md5 == hashlib.md5(json.dumps([{"md5": m, "relpath": r} for _, r, m, _ in rows]).encode()).hexdigest()


def test_metadata_round_trip(spark):
    stage = metadata.Stage(
        "www/out", [metadata.Out("www/out", "a" * 32, 5, True, 2), metadata.Out("www/b.txt", "b" * 32, 1)], "make",
        {"njsp/x": "c" * 32, "www/y": "d" * 32}, {"src/m.py": "e" * 40}, None, "daily", "2026-01-01T00:00:00Z", False, "s",
    )
    assert metadata.parse("www/out.dvc", metadata.render(stage)) == stage
    planned = metadata.Stage("p", [metadata.Out("p")], "make")
    assert metadata.parse("p.dvc", metadata.render(planned)) == planned and not planned.is_side_effect
    texts = [("a.dvc", "outs:\n- path: a\n  md5: abc.dir\n  nfiles: 2\n  size: 10\n"), ("b.dvc", "meta: {computation: {cmd: x, deps: {a: abc.dir}}}"), ("c.dvc", "nothing: 1"), ("d.dvc", "a: [")]
    stages, outs, deps = metadata.relations(spark.createDataFrame(texts, "path string, text string"))
    by = {r.path: r for r in stages.collect()}
    assert by["b"].side_effect and not by["a"].side_effect and by["c"].error and by["d"].error
    assert [tuple(r) for r in outs.collect()] == [("a", 0, "a", "abc", 10, True, 2)]
    assert [tuple(r) for r in deps.collect()] == [("b", 0, "dep", "a", "abc")]


def test_metadata_of_a_fetched_stage():
    """As files in use have it: the schedule is the computation's."""
    text = "outs:\n- md5: abc\n  path: a\nmeta:\n  computation:\n    cmd: get\n    fetch:\n      schedule: daily\n      last_run: '2026-01-01T00:00:00Z'\n"
    stage = metadata.parse("a.dvc", text)
    assert (stage.fetch_schedule, stage.fetch_last_run) == ("daily", "2026-01-01T00:00:00Z")
    assert metadata.parse("a.dvc", metadata.render(stage)) == stage


def history(spark, rows):
    return spark.createDataFrame([(p, m, s, dt.datetime(2026, 1, d)) for p, m, s, d in rows], "path string, md5 string, sha string, at timestamp")


def test_retention(spark):
    h = history(spark, [("data.txt", "v1", "c1", 1), ("data.txt", "v2", "c2", 2), ("data.txt", "v3", "c3", 3)])
    blobs, head = h.select("md5"), h.where("md5 = 'v3'")
    gone = lambda kept: sorted(r.md5 for r in retention.plan(blobs, kept, head).collect())
    day = lambda d: F.lit(dt.datetime(2026, 1, d))
    assert gone(retention.keep_set(h, ["path"], keep=2)) == ["v1"]
    assert gone(retention.keep_set(h, ["path"])) == ["v1", "v2"]
    assert gone(retention.keep_set(h, ["path"], newer_than=day(1))) == []
    assert gone(retention.keep_set(h, ["path"], keep=1, newer_than=day(2))) == ["v1"]


def test_versions(spark):
    h = history(spark, [("p", "a", "c1", 1), ("p", "a", "c2", 2), ("p", "b", "c3", 3), ("p", "a", "c4", 4)])
    assert [(r.md5, r.first_sha) for r in versions.first_seen(h, ["path"]).orderBy("md5").collect()] == [("a", "c1"), ("b", "c3")]
    assert [r.sha for r in versions.change_points(h, ["path"]).orderBy("at").collect()] == ["c1", "c3", "c4"]
    assert [r.md5 for r in versions.state_at(h, ["path"], F.lit(dt.datetime(2026, 1, 3))).collect()] == ["b"]
    assert versions.hash_commit(h, spark.createDataFrame([("p", "b")], "path string, md5 string"), ["path"]).first().sha == "c4"
    tree = spark.createDataFrame([("r", "d/a.dvc"), ("r", "d.dvc"), ("r", ".dvc/tmp/x.dvc"), ("r", "dd.dvc"), ("q", "d/z.dvc")], "ref string, path string")
    assert sorted(r.path for r in versions.at_ref(tree, "r", ["d/"]).collect()) == ["d.dvc", "d/a.dvc"]


def test_graph(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "d"), ("a", "c"), ("c", "d")], "src string, dst string")
    nodes = spark.createDataFrame([(x, None if x == "a" else "make") for x in "abcde"], "id string, cmd string")
    assert {r.id: r.level for r in graph.levels(nodes, edges).collect()} == {"a": 0, "e": 0, "b": 1, "c": 1, "d": 2}
    assert {(r.id, r.distance) for r in graph.ancestors(edges, nodes.where("id = 'd'")).collect()} == {("b", 1), ("c", 1), ("a", 2)}
    assert {r.id for r in graph.descendants(edges, nodes.where("id = 'a'")).collect()} == {"b", "c", "d"}
    assert {r.id for r in graph.leaves(nodes, edges).collect()} == {"d", "e"} and {r.id for r in graph.roots(nodes, edges).collect()} == {"a", "e"}
    assert graph.stats(nodes, edges).first().asDict() == {"nodes": 5, "roots": 2, "leaves": 2, "with_cmd": 4, "edges": 4}
    with pytest.raises(graph.CycleError):
        graph.levels(nodes, edges.unionAll(spark.createDataFrame([("d", "b")], edges.schema)))
    status = spark.createDataFrame([("a", "stale", "x"), ("b", "fresh", "y"), ("c", "error", "z"), ("d", "fresh", "y")], "id string, status string, reason string")
    got = {r.id: (r.status, r.reason) for r in graph.transitive_status(status, edges).collect()}
    assert got == {"a": ("stale", "x"), "b": ("transitive", "upstream stale: a"), "c": ("error", "z"), "d": ("transitive", "upstream stale: b")}
    text = render.mermaid(nodes, edges)
    assert text.startswith('flowchart TD\n  n0["a"]') and "  n0 --> n1" in text
    assert '"a" -> "b"' in render.dot(nodes, edges) and json.loads(render.graph_json(nodes, edges))["edges"][0] == {"from": "a", "to": "b"}
    assert "(2 deps)" in render.ascii_tree(nodes, edges) and "<pre>" in render.html_page(nodes, edges)


def test_diffs(spark):
    m = lambda rows: spark.createDataFrame(rows, "relpath string, md5 string, size long")
    got = {r.relpath: r.status for r in diff.manifest_diff(m([("a", "1", 1), ("b", "2", 1), ("c", "3", 1)]), m([("a", "1", 1), ("b", "9", 1), ("d", "4", 1)])).collect()}
    assert got == {"b": "modified", "c": "removed", "d": "added"}
    pair = spark.createDataFrame([(1, "line A\nline B\n", "line A\nline C\n"), (2, "x", "x"), (3, None, "new")], "k int, old string, new string")
    text = {r.k: r["diff"] for r in diff.line_diff(pair, "k").collect()}
    assert "-line B" in text[1] and "+line C" in text[1] and text[2] == "" and "+new" in text[3]
    assert diff.parse_refspec("a..b", None) == ("a", "b") and diff.parse_refspec(None, "r") == ("r^", "r") and diff.parse_refspec(None, None) == ("HEAD", None)
    with pytest.raises(ValueError):
        diff.parse_refspec("a..b", "r")


def test_outputs_of_many_and_side_effects(spark):
    stages = spark.createDataFrame([("m", "make", None, False), ("s", "send", None, True), ("n", "x", None, None)], "path string, cmd string, md5 string, side_effect boolean")
    stages = stages.withColumn("fetch_schedule", F.lit(None).cast("string")).withColumn("fetch_last_run", F.lit(None).cast("timestamp"))
    outs = spark.createDataFrame([("m", 0, "ytd.parquet", "1" * 32), ("m", 1, "monthly.parquet", "2" * 32)], "stage string, ord int, path string, md5 string")
    deps = spark.createDataFrame([("s", 0, "ytd.parquet", "0" * 32, "dep"), ("n", 0, "raw", "5" * 32, "dep"), ("n", 1, "gone", "x", "git_dep")], "stage string, ord int, dep_path string, recorded string, kind string")
    files = spark.createDataFrame([("ytd.parquet", "1" * 32, None), ("raw", None, "denied")], "path string, md5 string, error string")
    git = spark.createDataFrame([], "path string, sha string")
    got = {r.stage: (r.status, r.reason) for r in freshness.freshness(stages, outs, deps, files, git).collect()}
    assert got == {"m": ("missing", "output missing: monthly.parquet"), "s": ("stale", "dep changed: ytd.parquet"), "n": ("error", "dep hash error: raw: denied")}


def test_transfer(spark):
    entries = transfer.explode_manifests(spark.createDataFrame([("d", '[{"md5": "1", "relpath": "a"}, {"md5": "2", "relpath": "b"}]'), ("e", "not json")], "dir_md5 string, manifest string"))
    store = lambda *m: spark.createDataFrame([(x,) for x in m], "md5 string")
    assert {(r.md5, r.action) for r in transfer.gap_fill(entries, store("1"), store("2")).collect()} == {("2", "upload")}
    files = spark.createDataFrame([("data/sub/file2.txt",), ("else/x",)], "path string")
    got = [tuple(r) for r in transfer.parent_directory(files, spark.createDataFrame([("data",), ("data/su",)], "dir_path string")).collect()]
    assert got == [("data/sub/file2.txt", "data", "sub/file2.txt")]


def test_config(tmp_path):
    assert config.load(str(tmp_path)).of("x") == {"commit": "auto", "push": "never"}
    (tmp_path / "run.yml").write_text("run:\n  commit: always\n  push: end\n  stages:\n    deploy.dvc: {push: each}\n    import: {commit: never}\n")
    c = config.load(str(tmp_path))
    assert c.of("deploy") == {"commit": "always", "push": "each"} and c.of("import.dvc") == {"commit": "never", "push": "end"}


def test_urls(tmp_path):
    served = {"etag": '"1"', "last-modified": "Tue, 07 Apr 2026 12:00:00 GMT"}
    client = lambda method, url, agent: (dict(served), b"body" if method == "GET" else b"")
    out = str(tmp_path / urls.file_name("http://h/a/f%20x.csv"))
    record, md5 = urls.fetch("http://h/a/f%20x.csv", out, client)
    assert md5 == hashlib.md5(b"body").hexdigest() and record.size == 4 and out.endswith("f x.csv")
    assert urls.fetch("http://h/a/f%20x.csv", out, client, old=record)[1] is None
    served["etag"] = '"2"'
    assert urls.fetch("http://h/a/f%20x.csv", out, client, old=record)[1] == md5


def test_store(tmp_path):
    (tmp_path / "d" / "sub").mkdir(parents=True)
    (tmp_path / "d" / "a").write_text("a")
    (tmp_path / "d" / "sub" / "b").write_text("b")
    local, remote = Store(str(tmp_path / "s")), Store(str(tmp_path / "r"))
    md5, size, nfiles = local.add(str(tmp_path / "d"))
    assert (size, nfiles) == (2, 2) and set(local.manifest(md5)) == {"a", "sub/b"} and local.manifest("0" * 32) == {}
    assert {s for _, s in copy([(md5, True)], local, remote)} == {"copied"}
    remote.delete(local.manifest(md5)["a"])
    assert sorted(s for _, s in copy([(md5, True), ("f" * 32, False)], local, remote)) == ["copied", "missing", "there", "there"]
    remote.restore(md5, str(tmp_path / "back"), True)
    assert hash_path(str(tmp_path / "back"))[0] == md5


def test_runner(tmp_path):
    (tmp_path / "raw.txt").write_text("1\n")
    write = lambda s: metadata.write_atomic(str(tmp_path / f"{s.path}.dvc"), metadata.render(s))
    write(metadata.Stage("b.txt", [metadata.Out("b.txt")], "cat a.txt a.txt > b.txt; echo run >> log", {"a.txt": "0"}))
    write(metadata.Stage("a.txt", [metadata.Out("a.txt")], "cat raw.txt > a.txt; cat raw.txt > a2.txt; echo run >> log", {"raw.txt": "0"}))
    write(metadata.Stage("a2.txt", [metadata.Out("a2.txt")], "cat raw.txt > a.txt; cat raw.txt > a2.txt; echo run >> log", {"raw.txt": "0"}))
    root = str(tmp_path)
    assert {r.path: r.skipped for r in runner.run(root, options=runner.Options(dry_run=True))} == {"a.txt": True, "a2.txt": True, "b.txt": True} and not (tmp_path / "log").exists()
    assert all(r.success and not r.skipped for r in runner.run(root))
    assert (tmp_path / "log").read_text().count("run") == 2  # one run for two outputs
    assert all(r.skipped and r.reason == "up-to-date" for r in runner.run(root))
    (tmp_path / "raw.txt").write_text("2\n")
    got = {r.path: r.reason for r in runner.run(root, ["b.txt"], runner.Options(prune=False))}
    assert got["a.txt"] == "dep changed: raw.txt" and (tmp_path / "b.txt").read_text() == "2\n2\n"
    write(metadata.Stage("bad", [metadata.Out("bad")], "echo oops >&2; exit 3"))
    (bad,) = [r for r in runner.run(root) if r.path == "bad"]
    assert not bad.success and "oops" in bad.reason


def test_runner_looks_in_the_remote_first(tmp_path):
    store, remote = Store(str(tmp_path / "cache")), Store(str(tmp_path / "remote"))
    root = tmp_path / "work"
    root.mkdir()
    stage = metadata.Stage("a.txt", [metadata.Out("a.txt")], "echo made > a.txt; echo run >> log")
    metadata.write_atomic(str(root / "a.txt.dvc"), metadata.render(stage))
    run = lambda **o: [(r.path, r.skipped, r.reason) for r in runner.run(str(root), options=runner.Options(**o), store=store, remote=remote)]
    assert run() == [("a.txt", False, "output missing")]
    copy([(hash_path(str(root / "a.txt"))[0], False)], store, remote)
    (root / "a.txt").unlink()
    assert run() == [("a.txt", True, "fetched (up-to-date)")] and (root / "a.txt").read_text() == "made\n" and (root / "log").read_text() == "run\n"
    (root / "a.txt").unlink()
    assert run(pull=False) == [("a.txt", False, "output missing")] and (root / "log").read_text() == "run\nrun\n"


def test_runner_schedules_git_deps_and_pruning(tmp_path):
    root = str(tmp_path)
    write = lambda s: metadata.write_atomic(str(tmp_path / f"{s.path}.dvc"), metadata.render(s))
    (tmp_path / "code.py").write_text("1")
    write(metadata.Stage("a", [metadata.Out("a")], "date +%N > a", {}, {"code.py": "0" * 40}, fetch_schedule="daily"))
    write(metadata.Stage("b", [metadata.Out("b")], "cat a > b", {"a": "0"}))
    at = lambda day: runner.Options(now=dt.datetime(2026, 1, day))
    reasons = lambda results: {r.path: (r.skipped, r.reason) for r in results}
    first = runner.run(root, options=at(1))
    assert runner.summary(first) == {"executed": 2, "skipped": 0, "failed": 0} and reasons(first)["a"] == (False, "fetch schedule due")
    assert metadata.parse("a.dvc", (tmp_path / "a.dvc").read_text()).fetch_last_run == "2026-01-01T00:00:00Z"
    assert set(reasons(runner.run(root, options=at(1))).values()) == {(True, "up-to-date")}
    (tmp_path / "code.py").write_text("2")
    assert reasons(runner.run(root, ["b"], options=at(1))) == {"b": (True, "up-to-date")}  # pruned: what is behind b cannot matter
    got = reasons(runner.run(root, ["b"], options=runner.Options(now=dt.datetime(2026, 1, 1), prune=False)))
    assert got["a"] == (False, "git dep changed: code.py") and got["b"][1] == "dep changed: a"
    assert reasons(runner.run(root, options=at(3)))["a"] == (False, "fetch schedule due")


def test_runner_commits_and_pushes_as_the_stage_says(tmp_path):
    root, store, remote = tmp_path / "work", Store(str(tmp_path / "cache")), Store(str(tmp_path / "remote"))
    root.mkdir()
    git = lambda *a: subprocess.run(["git", "-C", str(root), *a], check=True, capture_output=True, text=True).stdout
    git("init", "-q")
    git("config", "user.email", "a@example.org")
    git("config", "user.name", "a")
    write = lambda s: metadata.write_atomic(str(root / f"{s.path}.dvc"), metadata.render(s))
    write(metadata.Stage("a", [metadata.Out("a")], f'echo 1 > a; echo "made a" > "${runner.MESSAGE}"; echo short > "${runner.SUMMARY}"; echo true > "${runner.PUSH}"'))
    write(metadata.Stage("b", [metadata.Out("b")], "echo 2 > b"))
    write(metadata.Stage("c", [metadata.Out("c")], "echo 3 > c"))
    policy = config.RunConfig(stages={"b": {"commit": "always", "push": "end"}})
    got = {r.path: r for r in runner.run(str(root), options=runner.Options(config=policy), store=store, remote=remote)}
    assert sorted(git("log", "--format=%s").split("\n")[:-1]) == ["Run b", "made a"] and got["a"].summary == "short\n"
    assert {p: r.pushed for p, r in got.items()} == {"a": 1, "b": 1, "c": 0}


def test_git_relations(spark, tmp_path):
    run = lambda *a: subprocess.run(["git", "-C", str(tmp_path), *a], check=True, capture_output=True, text=True).stdout.strip()
    run("init", "-q", "-b", "main")
    run("config", "user.email", "a@example.org")
    run("config", "user.name", "a")
    for text in ("one", "two"):
        (tmp_path / "a.txt.dvc").write_text(f"outs:\n- md5: {hashlib.md5(text.encode()).hexdigest()}\n  path: a.txt\n")
        run("add", ".")
        run("commit", "-q", "-m", text)
    assert repo.branches(str(tmp_path)) == ["main"] and repo.head(str(tmp_path)) == run("rev-parse", "HEAD")
    (row,) = repo.tree(spark, str(tmp_path)).collect()
    assert (row.path, row.kind, row.sha) == ("a.txt.dvc", "blob", run("rev-parse", "HEAD:a.txt.dvc"))
    seen = repo.file_history(spark, str(tmp_path), ["a.txt.dvc"])
    assert [r.md5 for r in retention.referenced(seen.withColumn("ref", F.lit("HEAD")), spark.createDataFrame([("HEAD",)], "ref string")).orderBy("md5").collect()] == sorted(hashlib.md5(t.encode()).hexdigest() for t in ("one", "two"))
    texts = repo.texts_at(spark, str(tmp_path), ["HEAD", "HEAD~1"]).collect()
    assert {(r.ref, hashlib.md5(b"two").hexdigest() in r.text) for r in texts} == {("HEAD", True), ("HEAD~1", False)}
    assert repo.head(str(tmp_path / "nowhere")) is None


def test_unified_line_diffs_lead_from_the_old_to_the_new(spark):
    rnd = random.Random(3)
    lines = lambda n: [rnd.choice("abcdefg") * rnd.randint(0, 3) for _ in range(n)]
    rows = []
    for k in range(60):
        old = lines(rnd.randint(0, 20))
        new = [x for x in old if rnd.random() > 0.2] + lines(rnd.randint(0, 3))
        rows.append((k, "\n".join(old), "\n".join(new)))
    rows += [(100, None, "x"), (101, "same", "same"), (102, None, None)]
    for r in diff.line_diff(spark.createDataFrame(rows, "k int, old string, new string"), "k").collect():
        old, new = next(((o or "").splitlines(), (n or "").splitlines()) for k, o, n in rows if k == r.k)
        out, at = [], 0
        for line in r.diff.split("\n") if r.diff else []:
            if m := re.match(r"@@ -(\d+)(?:,(\d+))? \+", line):
                start = int(m[1]) - (m[2] != "0")
                out, at = out + old[at:start], start
            elif line[:1] == "+":
                out.append(line[1:])
            else:
                assert old[at] == line[1:]
                out, at = out + [old[at]] * (line[:1] == " "), at + 1
        assert out + old[at:] == new and bool(r.diff) == (old != new)


def test_catalog(spark, tmp_path):
    c = Catalog.create(spark, str(tmp_path / "repo"), remote=Store(str(tmp_path / "remote")))
    root = tmp_path / "repo"
    (root / "a.txt").write_text("a")
    (root / "dir").mkdir()
    (root / "dir" / "x").write_text("x")
    (root / "b.txt").write_text("aa")
    c.track("a.txt")
    c.track("dir")
    c.track("b.txt", "cat a.txt a.txt > b.txt", ["a.txt"])
    assert {r.path: r.status for r in c.status().collect()} == {"a.txt": "fresh", "dir": "fresh", "b.txt": "fresh"}
    assert {s for _, s in c.push()} == {"copied"} and {r.state for r in c.transfer_status("push").collect()} == {"cached"}
    (root / "a.txt").write_text("changed")
    (root / "dir" / "x").unlink()
    (root / "dir").rmdir()
    got = {r.path: (r.status, r.reason) for r in c.status().collect()}
    assert got["a.txt"][0] == "stale" and got["dir"] == ("missing", "output missing") and got["b.txt"] == ("transitive", "upstream stale: a.txt")
    c.pull()
    assert (root / "dir" / "x").read_text() == "x" and (root / "a.txt").read_text() == "a"
    (root / "a.txt").write_text("new")
    c.track("a.txt")
    gone, freed = c.collect_garbage(confirm=True, safe=True)
    assert gone == [hashlib.md5(b"a").hexdigest()] and freed == 1 and c.collect_garbage()[0] == []
    nodes, edges = c.graph()
    assert [tuple(r) for r in edges.collect()] == [("a.txt", "b.txt")] and nodes.count() == 3


def test_catalog_targets_versions_and_names(spark, tmp_path):
    root = tmp_path / "repo"
    c = Catalog.create(spark, str(root), remote=Store(str(tmp_path / "remote")))
    git = lambda *a: subprocess.run(["git", "-C", str(root), *a], check=True, capture_output=True)
    git("init", "-q", "-b", "main")
    git("config", "user.email", "a@example.org")
    git("config", "user.name", "a")
    (root / "sub/dir").mkdir(parents=True)
    for name, text in (("sub/a", "1"), ("sub/dir/x", "x"), ("sub/dir/y", "y"), ("top", "t")):
        (root / name).write_text(text)
    for name in ("sub/a", "sub/dir", "top"):
        c.track(name)
    (root / "bad.dvc").write_text("a: [")
    git("add", "*.dvc")
    git("commit", "-q", "-m", "one")
    (root / "sub/a").write_text("22")
    c.track("sub/a")
    (root / "sub/dir/y").write_text("changed")
    got = {r.path: (r.status, r.reason) for r in c.status(only=["sub", "sub/dir/x", "sub/dir/y", "nope", "bad.dvc"]).collect()}
    assert {p: s for p, (s, _) in got.items()} == {"sub/a": "fresh", "sub/dir": "stale", "sub/dir/x": "fresh", "sub/dir/y": "stale", "nope": "error", "bad": "error"}
    assert got["sub/dir/y"][1] == "hash mismatch (inside tracked dir dir/)" and "top" not in got
    assert c.read("sub/a") == b"22" and c.read("sub/a", "HEAD") == b"1" and c.read("sub/dir/x") == b"x" and c.locate("sub/dir/z") is None
    assert [(r.path, r.status) for r in c.diff("HEAD").collect()] == [("sub/a", "modified")]
    assert {s for _, s in c.push(["sub/a"], dry_run=True)} == {"copied"} and not c.remote.blobs()
    c.push(["sub"])
    assert {r.path: r.state for r in c.transfer_status("push").collect()} == {"sub/a": "cached", "sub/dir": "cached", "top": "missing"}
    assert {r.path: r.state for r in c.transfer_status_at("HEAD", ["sub"]).collect()} == {"sub/a": "cached", "sub/dir": "cached"}
    with pytest.raises(ValueError):
        c.push(["nope"])
    one = hashlib.md5(b"1").hexdigest()
    assert [r.md5 for r in c.garbage(refs=[]).collect()] == [one] and c.garbage().collect() == [] and c.garbage(refs=["HEAD"]).collect() == []
    git("commit", "-q", "-a", "-m", "two")
    assert [r.md5 for r in c.garbage(refs=["HEAD"]).collect()] == [one] and c.garbage(refs=["HEAD"], keep=2).collect() == []
    assert [r.md5 for r in c.garbage(refs=["HEAD"], only=["sub/a"]).collect()] == [one] and c.garbage(refs=["HEAD"], only=["top"]).collect() == []
    c.move("top", "new/top")
    assert (root / "new/top").read_text() == "t" and c.read("new/top") == b"t" and not (root / "top.dvc").exists()
    c.remove("new/top", outputs=True)
    assert not (root / "new/top").exists() and not (root / "new/top.dvc").exists()


def test_artifacts(tmp_path):
    root = str(tmp_path)
    (tmp_path / "raw.txt").write_text("1\n")

    @artifacts.delayed
    def doubled(name):
        return artifacts.Artifact(f"{name}2", f"cat {name} {name} > {name}2", [artifacts.Artifact.from_path(root, name)])

    four = artifacts.Artifact("four", "cat raw.txt2 raw.txt2 > four", [doubled("raw.txt")])
    other = artifacts.Artifact("other", "cp raw.txt2 other", [doubled("raw.txt"), "raw.txt"])
    assert doubled("raw.txt") is doubled("raw.txt") and [a.path for a in four.walk()] == ["raw.txt", "raw.txt2", "four"]
    assert [a.path for a in four.walk(stop=lambda a: a.path == "raw.txt2")] == ["raw.txt2", "four"]
    assert artifacts.write_all(root, [four, other]) == ["raw.txt", "raw.txt2", "four", "other"]
    planned = artifacts.Artifact.from_metadata(root, "four")
    assert not planned.is_computed and not planned.exists(root) and planned.upstream()[0].path == "raw.txt2"
    got = artifacts.materialize(root, [four, other], store=Store(str(tmp_path / "cache")))
    assert all(r.success for r in got) and (tmp_path / "four").read_text() == "1\n" * 4 and (tmp_path / "other").read_text() == "1\n" * 2
    assert artifacts.Artifact.from_metadata(root, "four").is_computed and artifacts.Artifact.from_metadata(root, "nowhere") is None
    assert all(r.skipped for r in artifacts.materialize(root, [four, other]))
    four.deps.append(four)
    with pytest.raises(ValueError):
        four.walk()
    with pytest.raises(FileNotFoundError):
        artifacts.Artifact.from_path(root, "nowhere")


def test_artifact_in_a_tracked_folder(tmp_path):
    store = Store(str(tmp_path / "cache"))
    (tmp_path / "dir/sub").mkdir(parents=True)
    (tmp_path / "dir/sub/x").write_text("x")
    md5, size, nfiles = store.add(str(tmp_path / "dir"))
    metadata.write_atomic(str(tmp_path / "dir.dvc"), metadata.render(metadata.Stage("dir", [metadata.Out("dir", md5, size, True, nfiles)])))
    assert artifacts.Artifact.from_metadata(str(tmp_path), "dir/sub/x", store).md5 == hashlib.md5(b"x").hexdigest()
    assert artifacts.Artifact.from_metadata(str(tmp_path), "dir/sub/y", store) is None


def test_catalog_imports(spark, tmp_path):
    root = tmp_path / "repo"
    c = Catalog.create(spark, str(root))
    bodies, asked = [b"one"], []

    def client(method, url, user_agent=None):
        asked.append((method, user_agent))
        return {"etag": f"v{len(bodies)}", "last-modified": "Tue, 07 Apr 2026 12:00:00 GMT", "content-length": str(len(bodies[-1]))}, bodies[-1] if method == "GET" else b""

    (root / "in").mkdir()
    (root / "in/.gitignore").write_text("/f.txt\n")
    stage = c.import_url("http://host/f.txt", "in/f.txt", user_agent="me", client=client)
    assert (root / "in/f.txt").read_text() == "one" and not (root / "in/.gitignore").exists()
    text = (root / "in/f.txt.dvc").read_text()
    assert metadata.parse("in/f.txt.dvc", text) == stage and "git_tracked: true" in text
    assert [tuple(r) for r in c.imports().collect()] == [("in/f.txt", "http://host/f.txt", "v1", 3, "2026-04-07T12:00:00+00:00", "me")]
    assert not c.update("in/f.txt", client=client) and asked[-1] == ("HEAD", "me")
    bodies.append(b"three")
    assert c.update("in/f.txt.dvc", client=client) and (root / "in/f.txt").read_text() == "three" and not c.update("in/f.txt", download=False, client=client)
    c.import_url("http://host/g.txt", download=False, client=client)
    assert not (root / "g.txt").exists() and {(r.path, r.status) for r in c.status().collect()} == {("in/f.txt", "fresh"), ("g.txt", "missing")}
    assert c.transfer_status().collect() == []  # git has them, no store does
    (root / "own").write_text("x")
    c.track("own")
    c.track("own")
    assert (root / ".gitignore").read_text() == "/own\n"
    with pytest.raises(FileNotFoundError):
        c.track("own", "make", ["nowhere"])
    with pytest.raises(ValueError):
        c.update("own", client=client)


def test_arrivals(spark, tmp_path):
    from datastrata.streaming.arrivals import watch

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "f").write_text("test data\n")
    for _ in range(2):
        watch(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination(60)
    assert [r.md5 for r in spark.read.parquet(str(tmp_path / "out")).collect()] == ["39a870a194a787550b6b5d1f49629236"]


def test_graph_finds_the_folder_of_a_dependency(spark, tmp_path):
    root = tmp_path / "folders"
    c = Catalog.create(spark, str(root))
    for f in ("data/a.txt", "data/sub/b.txt", "out.txt", "free.txt"):
        os.makedirs(os.path.dirname(root / f), exist_ok=True)
        (root / f).write_text(f)
    c.track("data")
    c.track("data/sub")
    c.track("out.txt", cmd="make", deps=["data/a.txt", "data/sub/b.txt", "free.txt"])
    _, edges = c.graph()
    assert {tuple(r) for r in edges.collect()} == {("data", "out.txt"), ("data/sub", "out.txt"), ("free.txt", "out.txt")}
    (root / "data/new.txt").write_text("more")  # no file that out.txt names
    got = {r.path: r.status for r in c.status().collect()}
    assert got["data"] == "stale" and got["out.txt"] == "transitive"
