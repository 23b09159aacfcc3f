"""The data source of metadata files: what it reads, and what filters keep it from listing and opening."""

import builtins
import os

import pytest
from pyspark.sql.datasource import EqualTo, In, StringStartsWith

from datastrata.catalog import Catalog
from datastrata.sources import metadata, metadata_source
from datastrata.sources.metadata_source import MetadataReader


@pytest.fixture
def tree(tmp_path):
    """a/x.dvc, a/b/y.dvc, c/z.dvc, top.dvc; what is in .dvc and .git is nobody's."""
    for name in ("a/x", "a/b/y", "c/z", "top", ".git/n", ".dvc/n"):
        os.makedirs(tmp_path / os.path.dirname(name), exist_ok=True)
        (tmp_path / f"{name}.dvc").write_text(f"meta:\n  computation:\n    cmd: make {name}\n")
    return str(tmp_path)


def opened(root, *filters, monkeypatch):
    """Paths the reader gives, the files it opens and the filters it leaves to Spark."""
    reader, seen, real = MetadataReader(root), [], builtins.open
    left = list(reader.pushFilters(list(filters)))
    monkeypatch.setattr(builtins, "open", lambda f, *a, **k: (seen.append(os.path.relpath(f, root)), real(f, *a, **k))[1])
    rows = [r for p in reader.partitions() for r in reader.read(p)]
    monkeypatch.undo()
    assert sorted(seen) == sorted(r[1] for r in rows) and all(os.path.dirname(r[1]) == r[0] for r in rows)
    return sorted(seen), left


def test_only_what_filters_ask_for_is_opened(tree, monkeypatch):
    ask = lambda *f: opened(tree, *f, monkeypatch=monkeypatch)
    assert ask() == (["a/b/y.dvc", "a/x.dvc", "c/z.dvc", "top.dvc"], [])
    assert ask(In(("folder",), ("a", "nowhere", ".git", "..", "/"))) == (["a/x.dvc"], [])
    assert ask(EqualTo(("folder",), "")) == (["top.dvc"], [])
    assert ask(StringStartsWith(("path",), "a/")) == (["a/b/y.dvc", "a/x.dvc"], [])
    assert ask(EqualTo(("path",), "c/z.dvc"), In(("folder",), ("a", "c"))) == (["c/z.dvc"], [])
    other = EqualTo(("text",), "x")
    assert ask(In(("path",), ("top.dvc",)), other) == (["top.dvc"], [other])


def test_plan_errors_and_empty_roots(spark, tree, tmp_path):
    (tmp_path / "c" / "bad.dvc").write_bytes(b"\xff\xfe")
    df = metadata_source.files(spark, tree, metadata_source.in_folders(["a", "c"]))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "BatchScan stage_metadata" in plan and "Filter " not in plan  # all of it is the reader's
    assert "Filter " in df.where("text LIKE '%x%'")._jdf.queryExecution().executedPlan().toString()
    assert {r.path: r.error is None for r in df.collect()} == {"a/x.dvc": True, "c/z.dvc": True, "c/bad.dvc": False}
    stages = {r.path: r.error for r in metadata.relations(df)[0].collect()}
    assert stages["a/x"] is None and stages["c/bad"].startswith("UnicodeDecodeError")
    os.makedirs(tmp_path / "empty")
    assert metadata_source.files(spark, str(tmp_path / "empty")).collect() == []
    many = metadata_source.files(spark, tree, metadata_source.in_folders([f"n{i}" for i in range(300)] + ["a"]))
    assert [r.path for r in many.collect()] == ["a/x.dvc"]


def test_status_of_targets_reads_only_what_is_upstream(spark, tmp_path):
    c = Catalog.create(spark, str(tmp_path))
    for name in ("raw/in", "raw/other", "work/mid", "out/end", "away/far"):
        os.makedirs(tmp_path / os.path.dirname(name), exist_ok=True)
        (tmp_path / name).write_text(name)
    c.track("raw/in"), c.track("raw/other"), c.track("away/far")
    c.track("work/mid", "make mid", ["raw/in"])
    c.track("out/end", "make end", ["work/mid"])
    (tmp_path / "raw" / "in").write_text("changed")
    every = {r.path: (r.status, r.reason) for r in c.status().collect()}
    assert every["raw/in"][0] == "stale" and every["out/end"][0] == "transitive" and every["away/far"][0] == "fresh"
    for only in (["out"], ["work", "raw/other"], ["out/end.dvc", "away"]):
        got = {r.path: (r.status, r.reason) for r in c.status(only=only).collect()}
        assert got and got == {p: every[p] for p in got}, only
    (stages, _, _), upstream = c.relations_for(["out/end"])
    assert {r.stage for r in upstream.collect()} == {"out/end", "work/mid", "raw/in"}
    assert {r.path for r in stages.collect()} == {"out/end", "work/mid", "raw/in", "raw/other"}  # no file of the folder away
