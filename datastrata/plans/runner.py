"""Running stages level by level on the driver.

Commands and their side effects run here only: a Spark task may be tried twice, a command must not. Outputs of one
command are one unit, so nothing waits for a sibling. A failing level stops the run.

A stage that is stale only because its output is not here is first looked for in the remote. A command finds the
names of three files in its environment (``MESSAGE``, ``SUMMARY``, ``PUSH``): what it writes there is the message of a commit of the
stage's metadata, a summary for the result, and ``true`` to have its outputs pushed.
"""

from __future__ import annotations

import datetime as dt
import fnmatch
import hashlib
import os
import subprocess
import tempfile
import time
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

from datastrata.functions.scalars import INTERVALS, cron_next
from datastrata.operators.graph import CycleError
from datastrata.sources import metadata
from datastrata.sources.config import RunConfig
from datastrata.sources.store import Store, copy, hash_path

MESSAGE, SUMMARY, PUSH = "STAGE_COMMIT_MESSAGE_FILE", "STAGE_SUMMARY_FILE", "STAGE_PUSH_FILE"


@dataclass
class Options:
    force: list[str] | bool = False
    cached: list[str] = field(default_factory=list)
    jobs: int | None = None
    dry_run: bool = False
    prune: bool = True
    cache: bool = True
    record: bool = True
    pull: bool = True
    now: dt.datetime | None = None
    config: RunConfig | None = None  # None: nothing is committed or pushed


@dataclass
class Result:
    path: str
    success: bool
    skipped: bool
    reason: str
    duration: float = 0.0
    summary: str = ""
    pushed: int = 0


def levels_of(stages: dict[str, metadata.Stage]) -> list[list[str]]:
    """Stages by level; edges go by output path, then by tracked parent folder, then by stage name."""
    made = {o.path: s.path for s in stages.values() for o in s.outs} | {p: p for p in stages}

    def producer(dep: str) -> str | None:
        while dep:
            if dep in made:
                return made[dep]
            dep = os.path.dirname(dep)
        return None

    needs = {p: {q for d in [*s.deps, *s.git_deps] if (q := producer(d)) and q != p} for p, s in stages.items()}
    out, done = [], set()
    while len(done) < len(needs):
        ready = sorted(p for p, n in needs.items() if p not in done and n <= done)
        if not ready:
            raise CycleError(f"circular dependency among {sorted(set(needs) - done)[:10]}")
        out.append(ready)
        done |= set(ready)
    return out


def due(schedule: str | None, last_run: str | None, now: dt.datetime) -> bool:
    """The rule of ``scalars.fetch_due`` for one stage; times without zone are UTC."""
    if schedule is None or schedule == "manual":
        return False
    if last_run is None:
        return True
    last = dt.datetime.fromisoformat(last_run.replace("Z", "+00:00"))
    last = last.astimezone(dt.timezone.utc).replace(tzinfo=None) if last.tzinfo else last
    if schedule in INTERVALS:
        return now >= last + dt.timedelta(seconds=INTERVALS[schedule])
    return now >= cron_next(schedule, last)


def git_sha(root: str, path: str) -> str | None:
    """A file's blob hash as it is, a folder's tree hash at HEAD."""
    full = os.path.join(root, path)
    if os.path.isfile(full):
        with open(full, "rb") as f:
            data = f.read()
        return hashlib.sha1(b"blob %d\0" % len(data) + data).hexdigest()
    found = subprocess.run(["git", "-C", root, "rev-parse", f"HEAD:{path}"], capture_output=True, text=True)
    return found.stdout.strip() if found.returncode == 0 and os.path.isdir(full) else None


def fresh(root: str, stage: metadata.Stage, declared: dict[str, str | None], now: dt.datetime | None = None) -> tuple[bool, str]:
    """The order of checks is that of ``operators.freshness``: schedule, outputs, dependencies, git dependencies."""
    now = now or dt.datetime.now(dt.timezone.utc).replace(tzinfo=None)
    if due(stage.fetch_schedule, stage.fetch_last_run, now):
        return False, "fetch schedule due"
    if not stage.is_side_effect:
        for o in stage.outs:
            path = os.path.join(root, o.path)
            label = f": {o.path}" if len(stage.outs) > 1 else ""
            if not os.path.exists(path):
                return False, f"output missing{label}"
            if (md5 := hash_path(path)[0]) != o.md5:
                return False, f"data changed{label} ({(o.md5 or '')[:8]}... vs {md5[:8]}...)"
    for dep, recorded in stage.deps.items():
        if dep in declared:
            actual = declared[dep]
        elif not os.path.exists(os.path.join(root, dep)):
            return False, f"dep missing: {dep}"
        else:
            actual = hash_path(os.path.join(root, dep))[0]
        if actual != recorded:
            return False, f"dep changed: {dep}"
    for dep, recorded in stage.git_deps.items():
        sha = git_sha(root, dep)
        if sha != recorded:
            return False, f"git dep {'missing' if sha is None else 'changed'}: {dep}"
    return True, "up-to-date"


def fetch(root: str, stage: metadata.Stage, store: Store, remote: Store) -> bool:
    """Bring a stage's recorded outputs from the remote to their places; whether all are there."""
    for o in stage.outs:
        full = os.path.join(root, o.path)
        if os.path.exists(full):
            continue
        if not o.md5 or any(state == "missing" for _, state in copy([(o.md5, o.is_dir)], remote, store)):
            return False
        store.restore(o.md5, full, o.is_dir)
    return True


def run(root: str, targets: list[str] | None = None, options: Options | None = None, store: Store | None = None, callables: dict[str, Callable[[str], None]] | None = None, remote: Store | None = None) -> list[Result]:
    """Bring the stages below a root up to date; metadata is rewritten for those that ran."""
    options = options or Options()
    now = options.now or dt.datetime.now(dt.timezone.utc).replace(tzinfo=None)
    stages: dict[str, metadata.Stage] = {}
    for name in metadata.discover(root):
        with open(os.path.join(root, name), encoding="utf-8") as f:
            if (s := metadata.parse(name, f.read())) is not None:
                stages[s.path] = s
    order = levels_of(stages)
    named = {t.removesuffix(".dvc") for t in targets} if targets else set(stages)
    declared = {o.path: o.md5 for s in stages.values() for o in s.outs}
    # What is behind a fresh stage cannot matter, unless what to force is still to be found there.
    stop = (lambda s: s.cmd is not None and fresh(root, s, declared, now)[0]) if options.prune and targets and not options.force else None
    wanted = _upstream(stages, named, stop)
    matches = lambda path, patterns: any(fnmatch.fnmatch(path, p) for p in patterns)
    results: list[Result] = []
    for level in order:
        declared = {o.path: o.md5 for s in stages.values() for o in s.outs}
        groups: dict[tuple[str, str], list[metadata.Stage]] = {}
        for path in level:
            s = stages[path]
            if path not in wanted or s.cmd is None:
                continue
            if matches(path, options.cached):
                results.append(Result(path, True, True, "cached"))
                continue
            ok, why = fresh(root, s, declared, now)
            if why.startswith("output missing") and options.pull and store and remote and not options.dry_run and fetch(root, s, store, remote):
                ok, why = fresh(root, s, declared, now)
                why = f"fetched ({why})" if ok else why
            forced = options.force is True or (options.force and matches(path, options.force))
            if ok and not forced:
                results.append(Result(path, True, True, why))
            else:
                groups.setdefault((os.path.dirname(path), s.cmd), []).append(s)
                if ok:
                    why = "forced"
                results.append(Result(path, True, options.dry_run, why))
        if options.dry_run or not groups:
            continue
        with ThreadPoolExecutor(options.jobs) as pool:
            failures = dict(pool.map(lambda g: (g[0], _execute(root, g[0], g[1], declared, options, store, callables or {}, now)), groups.items()))
        by_path = {r.path: r for r in results}
        for key, group in groups.items():
            error, took, said = failures[key]
            if not error and options.config is not None:
                _after(root, group, options.config, said, store, remote, by_path)
            for s in group:
                by_path[s.path].duration, by_path[s.path].summary = took, said.get(SUMMARY, "")
                if error:
                    by_path[s.path].success, by_path[s.path].reason = False, error
        if any(e for e, *_ in failures.values()):
            break
    if options.config is not None and store and remote:
        done = [stages[r.path] for r in results if r.success and not r.skipped and options.config.of(r.path)["push"] == "end"]
        moved = dict(copy([(o.md5, o.is_dir) for s in done for o in s.outs if o.md5], store, remote))
        for r in results:
            if stages[r.path] in done:
                r.pushed += sum(moved.get(o.md5) == "copied" for o in stages[r.path].outs)
    return results


def summary(results: list[Result]) -> dict[str, int]:
    return {
        "executed": sum(r.success and not r.skipped for r in results),
        "skipped": sum(r.success and r.skipped for r in results),
        "failed": sum(not r.success for r in results),
    }


def _after(root: str, group: list[metadata.Stage], config: RunConfig, said: dict[str, str], store: Store | None, remote: Store | None, results: dict[str, Result]) -> None:
    """Commit the metadata and push the outputs of what one command made, as the policy and the command say."""
    for s in group:
        policy = config.of(s.path)
        message = said.get(MESSAGE, "").strip()
        if policy["commit"] == "always" or (policy["commit"] == "auto" and message):
            name = s.path + metadata.SUFFIX
            subprocess.run(["git", "-C", root, "add", name], check=True, capture_output=True)
            if subprocess.run(["git", "-C", root, "diff", "--cached", "--quiet", "--", name]).returncode:
                subprocess.run(["git", "-C", root, "commit", "-q", "-m", message or f"Run {s.path}", "--", name], check=True, capture_output=True)
        if store and remote and (policy["push"] == "each" or said.get(PUSH, "").strip().lower() == "true"):
            results[s.path].pushed = sum(state == "copied" for _, state in copy([(o.md5, o.is_dir) for o in s.outs if o.md5], store, remote))


def _upstream(stages: dict[str, metadata.Stage], targets: set[str], stop: Callable[[metadata.Stage], bool] | None = None) -> set[str]:
    made = {o.path: s.path for s in stages.values() for o in s.outs}
    seen, todo = set(), [made.get(t, t) for t in targets]
    while todo:
        p = todo.pop()
        if p in stages and p not in seen:
            seen.add(p)
            if stop is None or not stop(stages[p]):
                todo += [made.get(d, d) for d in [*stages[p].deps, *stages[p].git_deps]]
    return seen


def _execute(
    root: str, key: tuple[str, str], group: list[metadata.Stage], declared: dict[str, str | None], options: Options, store: Store | None,
    callables: dict[str, Callable[[str], None]], now: dt.datetime,
) -> tuple[str | None, float, dict[str, str]]:
    folder, cmd = key
    began = time.time()
    where = os.path.join(root, folder)
    said: dict[str, str] = {}
    if cmd in callables:
        try:
            callables[cmd](where)
        except Exception as e:  # the stage's own failure is a result
            return f"{type(e).__name__}: {e}", time.time() - began, said
    else:
        with tempfile.TemporaryDirectory() as notes:
            names = {k: os.path.join(notes, k) for k in (MESSAGE, SUMMARY, PUSH)}
            done = subprocess.run(cmd, shell=True, cwd=where, capture_output=True, text=True, env=os.environ | names)
            for k, name in names.items():
                if os.path.exists(name):
                    with open(name, encoding="utf-8") as f:
                        said[k] = f.read()
        if done.returncode:
            return "\n".join([f"exit code {done.returncode}", *done.stderr.splitlines()[-20:]]), time.time() - began, said
    for s in group:
        for o in s.outs:
            path = os.path.join(root, o.path)
            if not os.path.exists(path):
                return f"output missing: {o.path}", time.time() - began, said
            o.md5, o.size, o.nfiles = store.add(path) if store and options.cache else hash_path(path)
            o.is_dir = o.nfiles is not None
        if options.record:
            for dep in s.deps:
                actual = declared[dep] if dep in declared else hash_path(os.path.join(root, dep))[0]
                s.deps[dep] = actual or s.deps[dep]
            for dep in s.git_deps:
                s.git_deps[dep] = git_sha(root, dep) or s.git_deps[dep]
            if s.fetch_schedule:
                s.fetch_last_run = now.strftime("%Y-%m-%dT%H:%M:%SZ")
        metadata.write_atomic(os.path.join(root, s.path + metadata.SUFFIX), metadata.render(s))
    return None, time.time() - began, said
