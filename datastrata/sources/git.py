"""Objects and history of a git repository as relations; contents come from one git process, whatever their number."""

from __future__ import annotations

import subprocess
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TREE = "ref string, path string, kind string, sha string"


def git(root: str, *args: str) -> str:
    return subprocess.run(["git", "-C", root, *args], capture_output=True, check=True).stdout.decode("utf-8", "replace")


def tree(spark: SparkSession, root: str, ref: str = "HEAD") -> DataFrame:
    """All blobs and trees of a ref."""
    rows = []
    for entry in git(root, "ls-tree", "-r", "-t", "-z", ref).split("\0"):
        if entry:
            head, path = entry.split("\t", 1)
            _, kind, sha = head.split()
            rows.append((ref, path, kind, sha))
    return spark.createDataFrame(rows, TREE)


def texts_at(spark: SparkSession, root: str, refs: list[str], suffix: str = ".dvc") -> DataFrame:
    """``(ref, path, sha, text)`` of the metadata files at some refs: a listing for each ref, and one process for all contents."""
    found = []
    for ref in refs:
        for entry in git(root, "ls-tree", "-r", "-z", ref).split("\0"):
            if entry:
                head_, path = entry.split("\t", 1)
                if path.endswith(suffix) and f"{suffix}/" not in path:
                    found.append((ref, path, head_.split()[2]))
    texts = _contents(root, {sha for *_, sha in found})
    return spark.createDataFrame([(*f, texts[f[2]]) for f in found], "ref string, path string, sha string, text string")


def _contents(root: str, objects: set[str]) -> dict[str, str]:
    """Texts of blobs by their hash or ``ref:path``, all from one process."""
    names = sorted(objects)
    out = subprocess.run(["git", "-C", root, "cat-file", "--batch"], input="".join(f"{n}\n" for n in names).encode(), capture_output=True, check=True).stdout
    found, at = {}, 0
    for name in names:
        end = out.index(b"\n", at)
        head_ = out[at:end].split()
        if head_[-1] == b"missing":
            at = end + 1
            continue
        size = int(head_[2])
        found[name] = out[end + 1 : end + 1 + size].decode("utf-8", "replace")
        at = end + size + 2
    return found


def head(root: str) -> str | None:
    try:
        return git(root, "rev-parse", "HEAD").strip()
    except subprocess.CalledProcessError:
        return None


def branches(root: str) -> list[str]:
    return git(root, "for-each-ref", "--format=%(refname:short)", "refs/heads").split()


def content(root: str, ref: str, path: str) -> bytes:
    return subprocess.run(["git", "-C", root, "show", f"{ref}:{path}"], capture_output=True, check=True).stdout


#: Commits and blobs that one git process is asked for.
COMMITS, BLOBS = 2_000, 5_000
CHANGE = "sha string, at long, path string, blob string"
_ABSENT = "0" * 40


def commits(spark: SparkSession, root: str, refs: list[str] | None = None) -> DataFrame:
    """``(n, sha, at)`` of what is reachable from the refs, oldest first: names and times alone come from one process."""
    lines = git(root, "rev-list", "--reverse", "--topo-order", "--timestamp", *(refs or ["HEAD"])).splitlines()
    rows = [(n, sha, int(at)) for n, (at, sha) in enumerate(line.split() for line in lines)]
    return spark.createDataFrame(rows, "n long, sha string, at long")


def _ranges(rows: DataFrame, by: Column, size: int) -> DataFrame:
    """Rows dealt in runs of so many, a task each at most."""
    return rows.withColumn("_range", F.floor(by / size)).repartition(F.col("_range"))


def changes(spark: SparkSession, root: str, refs: list[str] | None = None, suffix: str = "") -> DataFrame:
    """``(sha, at, path, blob)``: what each commit made of each path that it changed, null where it removed it. Commits are walked
    in ranges, a git process each; a merge counts where it differs from all its parents."""
    walked = _ranges(commits(spark, root, refs), F.col("n"), COMMITS).select("sha", "at")

    def run(batches: Iterator) -> Iterator:
        import pandas as pd

        for pdf in batches:
            at = dict(zip(pdf["sha"], pdf["at"]))
            asked = "".join(f"{sha}\n" for sha in at).encode()
            out = subprocess.run(["git", "-C", root, "diff-tree", "--stdin", "--root", "-r", "-c", "--raw", "--no-renames", "--no-abbrev", "-z"], input=asked, capture_output=True, check=True).stdout
            rows, sha, fields = [], None, iter(out.decode("utf-8", "replace").split("\0"))
            for field in fields:
                if not field.startswith(":"):
                    sha = field.strip() or sha
                    continue
                parents = len(field) - len(field.lstrip(":"))
                blob, path = field.split()[2 * parents + 1], next(fields)
                if path.endswith(suffix):
                    rows.append((sha, at[sha], path, None if blob == _ABSENT else blob))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in CHANGE.split(", ")]).astype({"at": "int64"})

    return walked.mapInPandas(run, CHANGE)


def contents(root: str, blobs: DataFrame) -> DataFrame:
    """``blobs(blob)`` -> ``(blob, text)``, a git process for some thousands of them."""
    dealt = blobs.select("blob").where("blob IS NOT NULL").distinct()

    def run(batches: Iterator) -> Iterator:
        import pandas as pd

        for pdf in batches:
            for k in range(0, len(pdf), BLOBS):
                found = _contents(root, set(pdf["blob"][k : k + BLOBS]))
                yield pd.DataFrame(list(found.items()), columns=["blob", "text"])

    return dealt.mapInPandas(run, "blob string, text string")


def file_history(spark: SparkSession, root: str, paths: list[str] | None = None, refs: list[str] | None = None, suffix: str = ".dvc") -> DataFrame:
    """``(path, sha, at, text)``: each commit's version of the files, or of all with a suffix, for ``metadata.relations`` and ``versions``;
    a null text where a commit removed the file."""
    found = changes(spark, root, refs, "" if paths is not None else suffix)
    if paths is not None:
        found = found.join(spark.createDataFrame([(p,) for p in paths], "path string").distinct(), "path", "left_semi")
    else:
        found = found.where(~F.col("path").contains(f"{suffix}/"))
    return found.join(contents(root, found), "blob", "left").select("path", "sha", "at", "text")


def trees(spark: SparkSession, root: str, refs: list[str]) -> DataFrame:
    """``(ref, path, kind, sha)`` of all blobs and trees at some refs, each listed by a task."""
    names = spark.createDataFrame([(r,) for r in dict.fromkeys(refs)], "ref string").repartition(max(len(refs), 1))

    def run(batches: Iterator) -> Iterator:
        import pandas as pd

        for pdf in batches:
            for ref in pdf["ref"]:
                out = subprocess.run(["git", "-C", root, "ls-tree", "-r", "-t", "-z", ref], capture_output=True, check=True).stdout.decode("utf-8", "replace")
                rows = [(ref, path, *head_.split()[1:3]) for head_, path in (e.split("\t", 1) for e in out.split("\0") if e)]
                yield pd.DataFrame(rows, columns=["ref", "path", "kind", "sha"])

    return names.mapInPandas(run, TREE)


def object_shas(found: DataFrame, lookups: DataFrame) -> DataFrame:
    """``lookups(ref, path)`` in ``trees``: the hash of the file or folder, null where the ref has none; a trailing slash does not matter."""
    clean = lookups.withColumn("_path", F.regexp_replace("path", "/+$", ""))
    there = found.select("ref", F.col("path").alias("_path"), "kind", "sha")
    return clean.join(there, ["ref", "_path"], "left").select("ref", "path", "kind", "sha")
