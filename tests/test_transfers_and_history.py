"""Copies between stores, garbage by policy, levels of long chains, listings of any length, and git history in ranges."""

import hashlib
import json
import os
import random
import subprocess
import time

import pytest

from datastrata.catalog import Catalog
from datastrata.functions import hashing
from datastrata.operators import graph
from datastrata.sources import git, store, transport


def md5(data: bytes) -> str:
    return hashlib.md5(data).hexdigest()


@pytest.fixture
def stores(tmp_path):
    return store.Store(str(tmp_path / "a")), store.Store(str(tmp_path / "b"))


def put(s, data: bytes, is_dir=False) -> str:
    name = md5(data)
    os.makedirs(os.path.dirname(s.location(name, is_dir)), exist_ok=True)
    with open(s.location(name, is_dir), "wb") as f:
        f.write(data)
    return name


def listing(*names) -> bytes:
    return json.dumps([{"md5": n, "relpath": f"f{k}"} for k, n in enumerate(names)]).encode()


def moved(spark, wanted, a, b):
    found = transport.transfer(spark, spark.createDataFrame(wanted, "md5 string, is_dir boolean"), a, b).collect()
    return {r.md5: r.state for r in found}


def test_transfer_until_no_listing_names_a_missing_blob(spark, stores):
    a, b = stores
    files = [put(a, f"file {k}".encode()) for k in range(30)]
    lost, there = md5(b"lost"), put(b, b"there")
    inner = put(a, listing(*files[10:], lost), True)
    top = put(a, listing(*files[:10], there, inner + ".dir"), True)
    got = moved(spark, [(top, True), (files[0], False), (None, False)], a, b)
    assert got == {**{f: "copied" for f in files}, top: "copied", inner: "copied", lost: "missing", there: "there"}
    assert all(open(b.location(f), "rb").read() == f"file {k}".encode() for k, f in enumerate(files))
    assert set(moved(spark, [(top, True)], a, b).values()) == {"there", "missing"}
    # a listing that is there, but not its files
    os.unlink(b.location(files[20]))
    assert {m for m, s in moved(spark, [(top, True)], a, b).items() if s == "copied"} == {files[20]}


def test_lost_attempts_leave_nothing_that_is_seen(spark, stores, monkeypatch):
    a, b = stores
    name = put(a, b"x" * 3_000_000)
    part = b.location(name) + ".part-0"
    os.makedirs(os.path.dirname(part))
    open(part, "wb").write(b"half")  # an attempt that was killed
    assert store.relation(spark, b).count() == 0
    assert moved(spark, [(name, False)], a, b) == {name: "copied"} and md5(open(b.location(name), "rb").read()) == name
    assert transport.copy_one(a.root, b.root, name, False)[0] == "there"  # another attempt
    os.chmod(os.path.dirname(part), 0o755)
    blocked = put(a, b"blocked")
    os.makedirs(os.path.dirname(os.path.dirname(b.location(blocked))), exist_ok=True)
    open(os.path.dirname(b.location(blocked)), "w").close()  # a file where a folder should be
    state, _, error = transport.copy_one(a.root, b.root, blocked, False)
    assert state == "error" and error


def test_no_wanted_blobs(spark, stores):
    assert moved(spark, [], *stores) == {}


# -- garbage ----------------------------------------------------------------


@pytest.fixture
def versioned(spark, tmp_path):
    root = tmp_path / "repo"
    root.mkdir()
    run = lambda *a, **k: subprocess.run(["git", "-C", str(root), *a], check=True, capture_output=True, **k)
    run("init", "-q", "-b", "main")
    run("config", "user.email", "a@b.c")
    run("config", "user.name", "a")
    c = Catalog.create(spark, str(root), remote=store.Store(str(tmp_path / "remote")))
    for k, text in enumerate(("1", "2", "3")):
        for name in ("a.txt", "b.txt"):
            (root / name).write_text(name + text)
            c.track(name)
        run("add", "*.dvc")
        run("commit", "-q", "-m", text, env={**os.environ, "GIT_COMMITTER_DATE": f"2024-01-0{k + 1}T00:00:00Z", "GIT_AUTHOR_DATE": f"2024-01-0{k + 1}T00:00:00Z"})
    return c


def names(df):
    return {r.md5 for r in df.collect()}


def test_garbage_holds_to_policy_and_targets(versioned):
    c, blob = versioned, lambda name, k: md5(f"{name}.txt{k}".encode())
    old = {blob(n, k) for n in "ab" for k in (1, 2)}
    assert names(c.garbage()) == old
    assert names(c.garbage(only=["a.txt"])) == {blob("a", 1), blob("a", 2)}
    assert names(c.garbage(keep=5)) == set() and names(c.garbage(keep=2)) == {blob("a", 1), blob("b", 1)}
    assert names(c.garbage(keep=2, only=["b.txt"])) == {blob("b", 1)}
    assert names(c.garbage(newer_than="100000w")) == set() and names(c.garbage(newer_than="1h")) == old
    gone, freed = c.collect_garbage(keep=[(blob("a", 1), False)], only=["a.txt"], confirm=True)
    assert gone == [blob("a", 2)] and freed == 6 and c.store.has(blob("b", 1))


def test_policy_without_versions_is_refused(spark, tmp_path):
    c = Catalog.create(spark, str(tmp_path / "plain"))
    (tmp_path / "plain/x").write_text("x")
    c.track("x")
    assert names(c.garbage(only=["x"])) == set()
    with pytest.raises(ValueError):
        c.garbage(keep=1)


def test_push_and_fetch_at_refs_and_by_pattern(versioned):
    c, blob = versioned, lambda name, k: md5(f"{name}.txt{k}".encode())
    assert dict(c.push(["a*"])) == {blob("a", 3): "copied"}
    assert dict(c.push(ref="HEAD~1")) == {blob("a", 2): "copied", blob("b", 2): "copied"}
    assert dict(c.push(dry_run=True)) == {blob("a", 3): "there", blob("b", 3): "copied"}
    c.store.delete(blob("b", 2))
    assert dict(c.fetch(["b.txt"], ref="HEAD~1")) == {blob("b", 2): "copied"} and c.store.has(blob("b", 2))


# -- listings ---------------------------------------------------------------


@pytest.mark.parametrize("batch", ["2", "1000"])
def test_directory_hashes_over_batches(spark, batch):
    rnd = random.Random(1)
    rows = [(rnd.choice(["x", "y", None, "é"]), f"p/{rnd.randrange(10**9)}é\"\n", md5(str(k).encode()), rnd.choice([None, 5])) for k in range(300)]
    rows += [("lone", "one", "m", None)]
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, batch)
    try:
        got = {r.d: (r.md5, r.nfiles, r.size) for r in hashing.directory_hashes(spark.createDataFrame(rows, "d string, relpath string, md5 string, size long").repartition(7), ["d"]).collect()}
    finally:
        spark.conf.set(key, before)
    assert len(got) == 5
    for d, found in got.items():
        mine = sorted((r, m) for k, r, m, _ in rows if k == d)
        sizes = [s for k, *_, s in rows if k == d and s is not None]
        assert found == (md5(json.dumps([{"md5": m, "relpath": r} for r, m in mine]).encode()), len(mine), sum(sizes) if sizes else None)


def test_directory_hashes_of_nothing_and_of_two_keys(spark):
    schema = "d string, e int, relpath string, md5 string, size long"
    assert hashing.directory_hashes(spark.createDataFrame([], schema), ["d", "e"]).collect() == []
    (r,) = hashing.directory_hashes(spark.createDataFrame([("a", 1, "f", "m", 3)], schema), ["d", "e"]).collect()
    assert tuple(r) == ("a", 1, md5(b'[{"md5": "m", "relpath": "f"}]'), 1, 3)


# -- levels -----------------------------------------------------------------


def brute_levels(n, edges):
    level = [0] * n
    for a, b in sorted(edges):  # every edge goes up
        level[b] = max(level[b], level[a] + 1)
    return dict(enumerate(level))


@pytest.mark.parametrize("seed", range(3))
def test_levels_of_random_graphs(spark, seed):
    rnd = random.Random(seed)
    n, edges = 40, []
    for b in range(1, n):
        for _ in range(rnd.choice([0, 1, 1, 1, 2, 4][seed:])):
            edges.append((rnd.randrange(max(0, b - 8), b), b))
    frame = spark.createDataFrame([*edges, *edges[:3], (-1, 5), (7, 999)], "src long, dst long")  # repeats, and ends that are no nodes
    got = {r.id: r.level for r in graph.levels(spark.range(n), frame).collect()}
    assert got == brute_levels(n, edges)


def test_levels_of_a_long_chain(spark):
    n, began = 10_000, time.time()
    ids = spark.range(n)
    got = {r.id: r.level for r in graph.levels(ids, ids.selectExpr("id AS src", "id + 1 AS dst")).collect()}
    assert got == {k: k for k in range(n)} and time.time() - began < 120


@pytest.mark.parametrize("edges", [[(0, 1), (1, 0)], [(0, 0)], [(0, 1), (1, 2), (2, 3), (3, 1)], [(0, 1), (2, 1), (1, 3), (3, 2)]])
def test_levels_refuse_cycles(spark, edges):
    with pytest.raises(graph.CycleError):
        graph.levels(spark.range(5), spark.createDataFrame(edges, "src long, dst long"))


def test_levels_of_nothing(spark):
    none = spark.createDataFrame([], "src long, dst long")
    assert graph.levels(spark.range(0), none).collect() == [] and {r.level for r in graph.levels(spark.range(3), none).collect()} == {0}


# -- git --------------------------------------------------------------------


@pytest.fixture(scope="module")
def history(tmp_path_factory):
    root = tmp_path_factory.mktemp("history")
    run = lambda *a: subprocess.run(["git", "-C", str(root), "-c", "user.email=a@b.c", "-c", "user.name=a", *a], check=True, capture_output=True)
    run("init", "-q", "-b", "main")
    (root / "d").mkdir()
    for k in range(1000):
        (root / f"d/{k} é.dvc").write_text(f"one {k}")
    run("add", ".")
    run("commit", "-q", "-m", "one")
    run("checkout", "-q", "-b", "side")
    (root / "d/1 é.dvc").write_text("side")
    run("commit", "-q", "-a", "-m", "side")
    run("checkout", "-q", "main")
    (root / "d/2 é.dvc").unlink()
    (root / "other").write_text("x")
    run("add", "-A")
    run("commit", "-q", "-m", "two")
    run("merge", "-q", "--no-edit", "side")
    return str(root)


@pytest.mark.parametrize("size", [1, 2000])
def test_history_in_ranges(spark, history, size, monkeypatch):
    monkeypatch.setattr(git, "COMMITS", size)
    found = git.file_history(spark, history).collect()
    by = {}
    for r in found:
        by.setdefault(r.path, []).append(r.text)
    assert len(by) == 1000 and len(found) == 1002
    assert set(by["d/1 é.dvc"]) == {"one 1", "side"} and set(by["d/2 é.dvc"]) == {"one 2", None} and by["d/3 é.dvc"] == ["one 3"]
    assert {r.path for r in git.file_history(spark, history, ["other"]).collect()} == {"other"}
    assert git.file_history(spark, history, refs=["HEAD~5"] if False else ["side"]).count() == 1001


def test_lookups_at_refs(spark, history):
    asked = [("main", "d/1 é.dvc"), ("side", "d/1 é.dvc"), ("main~1", "d/1 é.dvc"), ("main", "d/"), ("main", "d/2 é.dvc"), ("side", "other")]
    lookups = spark.createDataFrame(asked, "ref string, path string")
    got = {(r.ref, r.path): (r.kind, r.sha) for r in git.object_shas(git.trees(spark, history, ["main", "side", "main~1"]), lookups).collect()}
    sha = lambda name: subprocess.run(["git", "-C", history, "rev-parse", "--verify", "-q", name], capture_output=True, text=True).stdout.strip() or None
    assert got == {(r, p): (None if sha(f"{r}:{p}") is None else "tree" if p == "d/" else "blob", sha(f"{r}:{p}")) for r, p in asked}
