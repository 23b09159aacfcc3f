"""Imports from URLs: provenance records and whether they are due for an update."""

from __future__ import annotations

import email.utils
import hashlib
import os
import urllib.parse
import urllib.request
from collections.abc import Callable
from dataclasses import dataclass


@dataclass
class Provenance:
    url: str
    checksum: str | None
    size: int | None
    mtime: str | None
    user_agent: str | None = None


Client = Callable[[str, str, str | None], tuple[dict[str, str], bytes]]


def http(method: str, url: str, user_agent: str | None = None) -> tuple[dict[str, str], bytes]:
    """The default client; anything with this signature will do."""
    request = urllib.request.Request(url, method=method, headers={"User-Agent": user_agent} if user_agent else {})
    with urllib.request.urlopen(request) as r:
        return {k.lower(): v for k, v in r.headers.items()}, r.read()


def file_name(url: str) -> str:
    name = urllib.parse.unquote(urllib.parse.urlparse(url).path.rpartition("/")[2])
    if not name:
        raise ValueError(f"no file name in {url!r}")
    return name


def provenance(url: str, headers: dict[str, str], user_agent: str | None = None) -> Provenance:
    modified = headers.get("last-modified")
    length = headers.get("content-length")
    when = email.utils.parsedate_to_datetime(modified).isoformat() if modified else None
    return Provenance(url, headers.get("etag"), int(length) if length else None, when, user_agent)


def changed(old: Provenance, new: Provenance) -> bool:
    """By checksum where both have one, else by time; unknown counts as changed."""
    if old.checksum and new.checksum:
        return old.checksum != new.checksum
    if old.mtime and new.mtime:
        return old.mtime != new.mtime
    return True


def fetch(url: str, out: str, client: Client = http, user_agent: str | None = None, old: Provenance | None = None) -> tuple[Provenance, str | None]:
    """Download unless unchanged since ``old``; the record and the content's md5, None if not downloaded."""
    if old is not None:
        headers, _ = client("HEAD", url, user_agent)
        new = provenance(url, headers, user_agent)
        if not changed(old, new) and os.path.exists(out):
            return new, None
    headers, body = client("GET", url, user_agent)
    with open(f"{out}.part", "wb") as f:
        f.write(body)
    os.replace(f"{out}.part", out)
    return provenance(url, headers | {"content-length": str(len(body))}, user_agent), hashlib.md5(body).hexdigest()
