"""Git's ignore files: what is in a store is not in git as well."""

from __future__ import annotations

import os


def _parts(path: str) -> tuple[str, str, list[str]]:
    file = os.path.join(os.path.dirname(path), ".gitignore")
    lines = []
    if os.path.exists(file):
        with open(file, encoding="utf-8") as f:
            lines = f.read().splitlines()
    return file, f"/{os.path.basename(path)}", lines


def add(path: str) -> None:
    """Name a path in the ignore file beside it, once."""
    file, entry, lines = _parts(path)
    if entry not in (x.strip() for x in lines):
        with open(file, "w", encoding="utf-8") as f:
            f.write("\n".join([*lines, entry]) + "\n")


def remove(path: str) -> None:
    """Take a path out of the ignore file beside it; an ignore file without entries goes."""
    file, entry, lines = _parts(path)
    left = [x for x in lines if x.strip() != entry]
    if len(left) == len(lines):
        return
    if not any(x.strip() for x in left):
        os.unlink(file)
        return
    with open(file, "w", encoding="utf-8") as f:
        f.write("\n".join(left) + "\n")
