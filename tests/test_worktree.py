"""The memo of hashes, and files brought back from a store."""

import os

import pytest

from datastrata.catalog import Catalog
from datastrata.sources import worktree


@pytest.fixture
def catalog(spark, tmp_path):
    root = tmp_path / "repo"
    (root / "d/.hidden").mkdir(parents=True)
    for name, text in (("d/a", "1"), ("d/.hidden/b", "2"), ("d/_c", ""), ("lone", "3"), ("other", "4")):
        (root / name).write_text(text)
    (root / "none").mkdir()
    c = Catalog.create(spark, str(root))
    for name in ("d", "lone", "other", "none"):
        c.track(name)
    return c


def state(c, **options):
    return {r.path: r.status for r in c.status(**options).collect()}


def test_status_reads_only_what_changed(catalog):
    c, root = catalog, catalog.root
    every = dict.fromkeys(("d", "lone", "other", "none"), "fresh")
    assert state(c, transitive=False) == every and c.files_read == 5
    before = os.stat(f"{root}/lone")
    with open(f"{root}/lone", "w") as f:
        f.write("x")
    os.utime(f"{root}/lone", ns=(before.st_atime_ns, before.st_mtime_ns))
    assert state(c, transitive=False) == every and c.files_read == 0  # the same signature: not read
    os.utime(f"{root}/lone", (1, 1))
    os.unlink(f"{root}/d/_c")
    assert state(c) == every | {"lone": "stale", "d": "stale"} and c.files_read == 3
    with open(f"{root}/d/a", "w") as f:
        f.write("11")
    assert state(c, transitive=False) == every | {"lone": "stale", "d": "stale"} and c.files_read == 2
    assert len([n for n in os.listdir(c.memo.folder) if n.startswith("v-")]) == 2
    c.memo.clear()
    assert c.memo.read().count() == 0


def test_memo_without_its_table_is_an_empty_one(catalog):
    catalog.status().collect()
    with open(f"{catalog.memo.folder}/current", "w") as f:
        f.write("v-gone")
    assert catalog.memo.read().count() == 0 and set(state(catalog).values()) == {"fresh"} and catalog.files_read == 5


def test_unreadable_files_are_errors(spark, catalog):
    os.symlink("/nowhere", f"{catalog.root}/d/link")
    found, n = worktree.hashes(catalog.root, spark.createDataFrame([("d",), ("lone",), ("gone",)], "path string"))
    got = {r.path: (r.md5, r.error) for r in found.collect()}
    assert set(got) == {"d", "lone"} and got["d"][0] is None and "nowhere" in got["d"][1] or "No such file" in got["d"][1]
    assert got["lone"][1] is None and n == 5


def test_checkout_makes_folders_equal_and_keeps_what_no_store_has(catalog):
    c, root = catalog, catalog.root
    for name, text in (("d/a", "3"), ("d/extra", "4"), ("d/new", "unsaved"), ("other", "unsaved too")):
        with open(f"{root}/{name}", "w") as f:
            f.write(text)
    os.unlink(f"{root}/d/.hidden/b")
    os.rmdir(f"{root}/none")
    found = c.checkout()
    assert found == [("d/.hidden/b", "restored"), ("d/a", "restored"), ("d/extra", "removed"), ("d/new", "kept"), ("other", "kept")]
    assert open(f"{root}/d/a").read() == "1" and os.path.isdir(f"{root}/none") and state(c)["d"] == "stale"
    assert c.checkout(overwrite=True) == [("d/new", "kept"), ("other", "restored")] and c.checkout(clear=True) == [("d/new", "removed")]
    assert set(state(c).values()) == {"fresh"} and c.checkout() == []
    c.store.delete("c4ca4238a0b923820dcc509a6f75849b")
    os.unlink(f"{root}/d/a")
    assert c.checkout(["d"]) == [("d/a", "missing")]
