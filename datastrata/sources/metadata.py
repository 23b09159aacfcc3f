"""Stage metadata: one YAML file per stage, read into relations and written back.

Shapes: with outputs; without outputs but with a command (a side effect); neither (invalid: an
error, not an exception); an import tracked by git. Unknown keys are ignored.
"""

from __future__ import annotations

import os
import posixpath
import tempfile
from collections.abc import Iterator
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from datastrata.runtime import cut
from datastrata.schema import IMPORT_DEP, STAGE, STAGE_DEP, STAGE_OUT
from datastrata.sources.metadata_source import SUFFIX, files
from datastrata.sources.urls import Provenance

#: The keys of an import's source.
ORIGIN = ("path", "checksum", "size", "mtime", "user_agent")


@dataclass
class Out:
    path: str
    md5: str | None = None
    size: int | None = None
    is_dir: bool = False
    nfiles: int | None = None


@dataclass
class Stage:
    path: str
    outs: list[Out] = field(default_factory=list)
    cmd: str | None = None
    deps: dict[str, str] = field(default_factory=dict)
    git_deps: dict[str, str] = field(default_factory=dict)
    side_effect: bool | None = None
    fetch_schedule: str | None = None
    fetch_last_run: str | None = None
    git_tracked: bool = False
    stage: str | None = None
    origin: Provenance | None = None
    fetched: str | None = None

    @property
    def is_side_effect(self) -> bool:
        return self.side_effect if self.side_effect is not None else not self.outs and self.cmd is not None


def _yaml():
    import yaml

    return yaml, getattr(yaml, "CSafeLoader", yaml.SafeLoader)


def resolve(folder: str, dep: str) -> str:
    if folder in ("", ".") or folder.startswith("/"):
        return dep
    if dep.startswith("/"):
        return dep[1:]
    return dep if dep.startswith(folder + "/") else posixpath.normpath(posixpath.join(folder, dep))


def relativize(folder: str, dep: str) -> str:
    if folder in ("", ".") or folder.startswith("/"):
        return dep
    return dep[len(folder) + 1 :] if dep.startswith(folder + "/") else "/" + dep


def parse(path: str, text: str) -> Stage | None:
    """The stage that a metadata file at ``path`` describes; None if it describes none."""
    yaml, loader = _yaml()
    data = yaml.load(text, Loader=loader)
    if not isinstance(data, dict):
        return None
    folder, stem = posixpath.dirname(path), path.removesuffix(SUFFIX)
    meta = data.get("meta") or {}
    work = meta.get("computation") or data.get("computation") or {}
    fetch = work.get("fetch") or {}
    outs = []
    for o in data.get("outs") or []:
        md5 = o.get("md5")
        is_dir = bool(md5 and md5.endswith(".dir")) or o.get("nfiles") is not None
        name = posixpath.normpath(posixpath.join(folder, o["path"])) if folder else o["path"]
        outs.append(Out(name, md5.removesuffix(".dir") if md5 else None, o.get("size"), is_dir, o.get("nfiles")))
    cmd = work.get("cmd")
    if not outs and cmd is None:
        return None
    first = (data.get("deps") or [{}])[0]
    origin = Provenance(*(first.get(k) for k in ORIGIN)) if first.get("path") else None
    fetched = (meta.get("import") or {}).get("fetched")
    strip = lambda d: {resolve(folder, k): v.removesuffix(".dir") if isinstance(v, str) else v for k, v in (d or {}).items()}
    return Stage(
        stem, outs, cmd, strip(work.get("deps")), strip(work.get("git_deps")), work.get("side_effect"), fetch.get("schedule"),
        str(fetch["last_run"]) if fetch.get("last_run") else None, bool(meta.get("git_tracked")), meta.get("stage"),
        origin, str(fetched) if fetched else None,
    )


def render(stage: Stage) -> str:
    """The metadata file's text; the kind of a stage is explicit, so a planned output stays one."""
    yaml, _ = _yaml()
    folder = posixpath.dirname(stage.path)
    data: dict = {}
    if stage.origin is not None:
        values = (stage.origin.url, stage.origin.checksum, stage.origin.size, stage.origin.mtime, stage.origin.user_agent)
        data["deps"] = [{k: v for k, v in zip(ORIGIN, values) if v}]
    if stage.outs:
        data["outs"] = []
        for o in stage.outs:
            entry: dict = {}
            if o.md5:
                entry["md5"] = o.md5 + (".dir" if o.is_dir else "")
            if o.size is not None:
                entry["size"] = o.size
            if o.nfiles is not None:
                entry["nfiles"] = o.nfiles
            data["outs"].append(entry | {"hash": "md5", "path": posixpath.relpath(o.path, folder) if folder else o.path})
    work: dict = {}
    if stage.cmd is not None:
        work["cmd"] = stage.cmd
    for name, deps in (("deps", stage.deps), ("git_deps", stage.git_deps)):
        if deps:
            work[name] = {relativize(folder, k): v for k, v in deps.items()}
    if stage.side_effect is not None:
        work["side_effect"] = stage.side_effect
    if stage.fetch_schedule:
        work["fetch"] = {"schedule": stage.fetch_schedule} | ({"last_run": stage.fetch_last_run} if stage.fetch_last_run else {})
    meta: dict = {"computation": work} if work else {}
    if stage.git_tracked:
        meta["git_tracked"] = True
    if stage.fetched:
        meta["import"] = {"fetched": stage.fetched}
    if stage.stage:
        meta["stage"] = stage.stage
    if meta:
        data["meta"] = meta
    return yaml.safe_dump(data, sort_keys=False)


def write_atomic(path: str, text: str) -> None:
    """A reader sees the old file or the new one."""
    handle, temp = tempfile.mkstemp(dir=os.path.dirname(path) or ".")
    with os.fdopen(handle, "w", encoding="utf-8") as f:
        f.write(text)
    os.replace(temp, path)


def discover(root: str) -> list[str]:
    """Metadata files below a root, relative and sorted; the tool's own folder is not looked into."""
    found = []
    for folder, names, files in os.walk(root):
        names[:] = [n for n in names if n not in (SUFFIX, ".git")]
        found += [os.path.relpath(os.path.join(folder, f), root).replace(os.sep, "/") for f in files if f.endswith(SUFFIX) and f != SUFFIX]
    return sorted(found)


def relations(texts: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``(path, text)`` of metadata files -> ``(stage, stage_out, stage_dep)``.

    Each text is parsed once, on the executors; a file that cannot be read, by its ``error`` if there is such a column, has an error.
    """
    out = "array<struct<ord: int, path: string, md5: string, size: bigint, is_dir: boolean, nfiles: int>>"
    dep = "array<struct<ord: int, kind: string, dep_path: string, recorded: string>>"

    def run(batches: Iterator) -> Iterator:
        import pandas as pd

        for pdf in batches:
            rows = []
            for path, text, unread in zip(pdf["path"], pdf["text"], pdf["error"]):
                stem, error, s = path.removesuffix(SUFFIX), unread, None
                try:
                    s = None if unread else parse(path, text or "")
                except Exception as e:  # any malformed text is data here
                    error = f"{type(e).__name__}: {e}"
                if s is None:
                    rows.append((stem, None, None, None, None, None, None, None, error or "no outputs and no command", [], []))
                    continue
                deps = [("dep", k, v) for k, v in s.deps.items()] + [("git_dep", k, v) for k, v in s.git_deps.items()]
                rows.append((
                    stem, s.cmd, s.outs[0].md5 if s.outs else None, s.is_side_effect, s.fetch_schedule, s.fetch_last_run, s.git_tracked, s.stage, None,
                    [(i, o.path, o.md5, o.size, o.is_dir, o.nfiles) for i, o in enumerate(s.outs)],
                    [(i, kind, k, v) for i, (kind, k, v) in enumerate(deps)],
                ))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in STAGE.split(", ")] + ["outs", "deps"])

    unread = F.col("error") if "error" in texts.columns else F.lit(None).cast("string")
    parsed = cut(texts.select("path", "text", unread.alias("error")).mapInPandas(run, f"{STAGE}, outs {out}, deps {dep}"))  # three relations of it
    stages = parsed.drop("outs", "deps")
    outs = parsed.select(F.col("path").alias("stage"), F.explode("outs").alias("o")).select("stage", "o.*")
    deps = parsed.select(F.col("path").alias("stage"), F.explode("deps").alias("d")).select("stage", "d.*")
    return stages, outs.to(_schema(STAGE_OUT)), deps.to(_schema(STAGE_DEP))


def imports(texts: DataFrame) -> DataFrame:
    """``(path, text)`` of metadata files -> ``import_dep``: where imported stages come from."""

    def run(batches: Iterator) -> Iterator:
        import pandas as pd

        for pdf in batches:
            rows = []
            for path, text in zip(pdf["path"], pdf["text"]):
                try:
                    s = parse(path, text or "")
                except Exception:  # reported by ``relations``
                    continue
                if s is not None and s.origin is not None:
                    rows.append((s.path, s.origin.url, s.origin.checksum, s.origin.size, s.origin.mtime, s.origin.user_agent))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in IMPORT_DEP.split(", ")]).astype({"size": "Int64"})

    return texts.select("path", "text").mapInPandas(run, IMPORT_DEP)


def _schema(ddl: str):
    from pyspark.sql.types import StructType

    return StructType.fromDDL(ddl)


def scan(spark: SparkSession, root: str) -> DataFrame:
    """``(path, text, error)`` of all metadata files below a root, listed and read by tasks."""
    return files(spark, root).select("path", "text", "error")
