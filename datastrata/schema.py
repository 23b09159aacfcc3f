"""Schemas of the relations that describe stages and their history."""

from __future__ import annotations

STAGE = (
    "path string, cmd string, md5 string, side_effect boolean, fetch_schedule string, fetch_last_run string, "
    "git_tracked boolean, legacy_stage string, error string"
)
STAGE_OUT = "stage string, ord int, path string, md5 string, size long, is_dir boolean, nfiles int"
STAGE_DEP = "stage string, ord int, kind string, dep_path string, recorded string"
IMPORT_DEP = "stage string, url string, checksum string, size long, mtime string, user_agent string"
BLOB = "md5 string, is_dir boolean, size long, location string"
RUN_RESULT = "path string, success boolean, skipped boolean, reason string, duration double"
