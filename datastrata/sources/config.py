"""Run configuration: commit and push policy, with overrides for single stages."""

from __future__ import annotations

import os
from dataclasses import dataclass, field

COMMIT = ("auto", "always", "never")
PUSH = ("never", "each", "end")


@dataclass
class RunConfig:
    commit: str = "auto"
    push: str = "never"
    stages: dict[str, dict[str, str]] = field(default_factory=dict)

    def of(self, path: str) -> dict[str, str]:
        stem = path.removesuffix(".dvc")
        found = self.stages.get(stem) or self.stages.get(f"{stem}.dvc") or {}
        return {"commit": self.commit, "push": self.push} | found


#: Where a configuration is looked for; pass other names to read existing repositories.
NAMES = (".datastrata/config.yml", "run.yml")


def load(root: str, names: tuple[str, ...] = NAMES) -> RunConfig:
    """The first configuration that exists; else the defaults."""
    for name in names:
        path = os.path.join(root, name)
        if os.path.exists(path):
            import yaml

            with open(path, encoding="utf-8") as f:
                data = (yaml.safe_load(f) or {}).get("run") or {}
            config = RunConfig(data.get("commit", "auto"), data.get("push", "never"), data.get("stages") or {})
            for c in [config.of(""), *map(config.of, config.stages)]:
                if c["commit"] not in COMMIT or c["push"] not in PUSH:
                    raise ValueError(f"not a policy: {c}")
            return config
    return RunConfig()
