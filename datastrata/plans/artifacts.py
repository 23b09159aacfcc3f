"""Stages declared in Python: artifacts with the command and the inputs that make them.

Declaring is cheap; ``write_all`` writes the metadata of an artifact and all that it needs, and ``materialize`` runs what is stale.
"""

from __future__ import annotations

import functools
import os
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field

from datastrata.plans import runner
from datastrata.sources import metadata
from datastrata.sources.store import Store, hash_path


@dataclass
class Artifact:
    path: str
    cmd: str | None = None
    deps: list[Artifact | str] = field(default_factory=list)
    git_deps: list[str] = field(default_factory=list)
    md5: str | None = None
    size: int | None = None
    nfiles: int | None = None
    side_effect: bool | None = None
    schedule: str | None = None

    @classmethod
    def from_path(cls, root: str, path: str) -> Artifact:
        """What is there, hashed."""
        full = os.path.join(root, path)
        if not os.path.exists(full):
            raise FileNotFoundError(path)
        return cls(path, None, [], [], *hash_path(full))

    @classmethod
    def from_metadata(cls, root: str, path: str, store: Store | None = None) -> Artifact | None:
        """What the metadata beside a path says, or, for a file in a tracked folder, the folder's listing; None if neither does."""
        file = os.path.join(root, path + metadata.SUFFIX)
        if os.path.exists(file):
            with open(file, encoding="utf-8") as f:
                s = metadata.parse(path + metadata.SUFFIX, f.read())
            if s is None:
                return None
            out = s.outs[0] if s.outs else metadata.Out(path)
            return cls(path, s.cmd, [cls(p, md5=m) for p, m in s.deps.items()], list(s.git_deps), out.md5, out.size, out.nfiles, s.side_effect, s.fetch_schedule)
        top = os.path.dirname(path)
        while top and store is not None:
            if (folder := cls.from_metadata(root, top)) is not None and folder.md5:
                md5 = store.manifest(folder.md5).get(path[len(top) + 1 :])
                return cls(path, md5=md5) if md5 else None
            top = os.path.dirname(top)
        return None

    @property
    def is_computed(self) -> bool:
        return bool(self.md5)

    def exists(self, root: str) -> bool:
        return os.path.exists(os.path.join(root, self.path))

    def upstream(self) -> list[Artifact]:
        return [d for d in self.deps if isinstance(d, Artifact)]

    def walk(self, stop: Callable[[Artifact], bool] | None = None) -> list[Artifact]:
        """This artifact and all that it needs, inputs first, each once; nothing is looked for behind those that ``stop`` holds for."""
        found: dict[str, Artifact] = {}
        path: list[str] = []

        def visit(a: Artifact) -> None:
            if a.path in path:
                raise ValueError(f"circular dependency: {' -> '.join([*path, a.path])}")
            if a.path in found:
                return
            path.append(a.path)
            if not (stop and a.cmd is not None and stop(a)):
                for d in a.upstream():
                    visit(d)
            path.pop()
            found[a.path] = a

        visit(self)
        return list(found.values())

    def stage(self, root: str) -> metadata.Stage:
        """The stage to write: hashes of what is there, else as recorded; an output that is not there yet has none."""
        now = lambda p: hash_path(os.path.join(root, p)) if os.path.exists(os.path.join(root, p)) else None
        deps = {}
        for d in self.deps:
            path = d.path if isinstance(d, Artifact) else d
            md5 = (d.md5 if isinstance(d, Artifact) else None) or (now(path) or (None,))[0]
            deps[path] = md5 or ""
        git = {d: runner.git_sha(root, d) or "" for d in self.git_deps}
        outs = []
        if not self.side_effect:
            md5, size, nfiles = (self.md5, self.size, self.nfiles) if self.md5 else now(self.path) or (None, None, None)
            outs = [metadata.Out(self.path, md5, size, nfiles is not None, nfiles)]
        return metadata.Stage(self.path, outs, self.cmd, deps, git, self.side_effect, self.schedule)


def delayed(make: Callable[..., Artifact]) -> Callable[..., Artifact]:
    """A function that declares an artifact, called once for each set of arguments: equal calls share the artifact."""
    return functools.lru_cache(maxsize=None)(make)


def write_all(root: str, artifacts: Iterable[Artifact]) -> list[str]:
    """Metadata of the artifacts and all that they need, inputs first; of plain inputs only if they exist."""
    written: dict[str, None] = {}
    for top in artifacts:
        for a in top.walk():
            if a.path in written or (a.cmd is None and not a.exists(root)):
                continue
            file = os.path.join(root, a.path + metadata.SUFFIX)
            os.makedirs(os.path.dirname(file), exist_ok=True)
            metadata.write_atomic(file, metadata.render(a.stage(root)))
            written[a.path] = None
    return list(written)


def materialize(root: str, artifacts: Iterable[Artifact], options: runner.Options | None = None, store: Store | None = None, remote: Store | None = None) -> list[runner.Result]:
    """Write the metadata that is not there yet and bring the artifacts up to date."""
    artifacts = list(artifacts)
    known = [a for top in artifacts for a in top.walk()]
    write_all(root, [a for a in known if not os.path.exists(os.path.join(root, a.path + metadata.SUFFIX))])
    return runner.run(root, [a.path for a in artifacts], options, store, remote=remote)
