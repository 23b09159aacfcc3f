"""Scalar functions: sizes, durations, times, schedules, patterns."""

from __future__ import annotations

import datetime as dt
import fnmatch
import re
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

UNITS = ("B", "KB", "MB", "GB", "TB", "PB")
#: The named schedules, in seconds.
INTERVALS = {"hourly": 3600, "daily": 86400, "weekly": 7 * 86400}
EPOCH = dt.datetime(1970, 1, 1)
#: A 29 February may be eight years away; 40 hold every date on every weekday.
DAYS = 366 * 40
STATUSES = ("stale", "missing", "transitive", "error", "fresh")


def format_size(size: Column, largest: str = UNITS[-1]) -> Column:
    """Bytes for people: whole below 1024, one decimal above, ties to the even one, ``?`` for null; no unit above ``largest``."""
    size = size.cast("long")
    n = F.abs(size)
    sign = F.when(size < 0, "-").otherwise("")
    text = F.when(size.isNull(), F.lit("?")).when(n < 1024, F.concat(size.cast("string"), F.lit(" B")))
    last = UNITS.index(largest)
    # A branch a unit, by constants, so the expression stays small. In integers, so ties are ties: half a unit is added, less one where the tenth is even.
    for k, unit in enumerate(UNITS[1 : last + 1], 1):
        tenth = n.bitwiseAND(F.lit(1024**k - 1)) * 10
        odd = F.shiftright(tenth, 10 * k).bitwiseAND(F.lit(1))
        tenths = F.shiftright(n, 10 * k) * 10 + F.shiftright(tenth + odd + (1024**k // 2 - 1), 10 * k)
        label = F.concat(sign, F.call_function("div", tenths, F.lit(10)).cast("string"), F.lit("."), (tenths % 10).cast("string"), F.lit(f" {unit}"))
        text = text.otherwise(label) if k == last else text.when(n < 1024 ** (k + 1), label)
    return text


def parse_duration(text: str) -> dt.timedelta:
    m = re.fullmatch(r"(\d+)([dhw])", text.strip())
    if not m:
        raise ValueError(f"not a duration: {text!r}")
    return int(m[1]) * {"d": dt.timedelta(days=1), "h": dt.timedelta(hours=1), "w": dt.timedelta(weeks=1)}[m[2]]


def is_md5(value: Column) -> Column:
    return F.lower(value).rlike(r"^[a-f0-9]{32}(\.dir)?$")


def strip_dir(md5: Column) -> Column:
    return F.regexp_replace(md5, r"\.dir$", "")


def from_iso(text: Column) -> Column:
    """ISO-8601 to a UTC timestamp; a time without zone is UTC."""
    zoned = text.rlike(r"(Z|[+-]\d\d:?\d\d)$")
    return F.to_timestamp(F.when(zoned, text).otherwise(F.concat(text, F.lit("Z"))))


def from_http_date(text: Column) -> Column:
    """RFC-2822 dates such as ``Tue, 07 Apr 2026 12:00:00 GMT``."""
    return F.to_timestamp(F.substring(text, 6, 1 << 30), "dd MMM yyyy HH:mm:ss z")


def named_due(schedule: Column, last_run: Column, now: Column) -> Column:
    """Whether a named schedule is due; null for any other that has run."""
    seconds = F.lit(None).cast("long")
    for name, s in INTERVALS.items():
        seconds = F.when(schedule == name, F.lit(s)).otherwise(seconds)
    due = now >= last_run + F.make_dt_interval(secs=seconds)
    return F.when(schedule.isNull() | (schedule == "manual"), F.lit(False)).when(last_run.isNull(), F.lit(True)).otherwise(due)


def is_named(schedule: Column) -> Column:
    return schedule.isin("manual", *INTERVALS)


def fetch_due(schedule: Column, last_run: Column, now: Column) -> Column:
    """Whether a schedule, named or a cron expression, is due; null if it is neither."""
    return F.coalesce(named_due(schedule, last_run, now), cron_due(schedule, last_run, now))


def cron_due(schedule: Column, last_run: Column, now: Column) -> Column:
    """Whether a five-field cron expression names a time after ``last_run``, but not after ``now``; null if it is none.
    The fields are read in Python, once for each expression of a batch."""
    start = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    seconds = lambda t: F.timestamp_diff("SECOND", start, t.cast("timestamp_ntz"))

    @F.pandas_udf("boolean")
    def due(expression: pd.Series, last: pd.Series, until: pd.Series) -> pd.Series:
        out = []
        for e, a, b in zip(expression, last, until):
            try:
                fires = None if pd.isna(a) or pd.isna(b) else cron_next(e, EPOCH + dt.timedelta(seconds=int(a)))
                out.append(fires is not None and fires <= EPOCH + dt.timedelta(seconds=int(b)))
            except (ValueError, AttributeError):
                out.append(None)
        return pd.Series(out, dtype=object)

    return due(schedule, seconds(last_run), seconds(now))


@lru_cache(maxsize=10_000)
def _field(text: str, low: int, high: int) -> frozenset[int]:
    out: set[int] = set()
    for part in text.split(","):
        span, _, step = part.partition("/")
        if span == "*":
            a, b = low, high
        elif "-" in span:
            a, b = map(int, span.split("-"))
        else:
            a = int(span)
            b = high if step else a
        if not (low <= a <= b <= high):
            raise ValueError(f"cron field {text!r}")
        out |= set(range(a, b + 1, int(step or 1)))
    return frozenset(out)


def cron_next(expression: str, after: dt.datetime) -> dt.datetime:
    """The next minute after ``after`` that a five-field cron expression names."""
    fields = expression.split()
    if len(fields) != 5:
        raise ValueError(f"not a cron expression: {expression!r}")
    minutes, hours, days, months = (_field(f, a, b) for f, (a, b) in zip(fields, ((0, 59), (0, 23), (1, 31), (1, 12))))
    weekdays = {d % 7 for d in _field(fields[4], 0, 7)}
    either = fields[2] != "*" and fields[4] != "*"
    t = after.replace(second=0, microsecond=0) + dt.timedelta(minutes=1)
    for _ in range(DAYS):
        in_month, on_day, on_week = t.month in months, t.day in days, (t.weekday() + 1) % 7 in weekdays
        if in_month and ((on_day or on_week) if either else (on_day and on_week)):
            for h in sorted(hours):
                for m in sorted(minutes):
                    at = t.replace(hour=h, minute=m)
                    if at >= t:
                        return at
        t = (t + dt.timedelta(days=1)).replace(hour=0, minute=0)
    raise ValueError(f"never fires: {expression!r}")


def glob_regex(patterns: list[str]) -> str:
    """One regular expression for shell patterns, where ``*`` crosses slashes."""
    bodies = [re.fullmatch(r"\(\?s:(.*)\)\\[zZ]", fnmatch.translate(p), re.S)[1] for p in patterns]
    return "(?s)^(?:" + "|".join(bodies) + ")$"


def matches(path: Column, patterns: list[str]) -> Column:
    return path.rlike(glob_regex(patterns)) if patterns else F.lit(False)


def status_names(text: str | None) -> list[str] | None:
    """A comma list of unique status prefixes, in full."""
    if not text:
        return None
    out = []
    for part in text.split(","):
        found = [s for s in STATUSES if s.startswith(part.strip().lower())] if part.strip() else []
        if len(found) != 1:
            raise ValueError(f"{'ambiguous' if found else 'unknown'} status: {part!r}")
        out += found
    return out
