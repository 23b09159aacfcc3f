"""Freshness of stages as one relation of checks.

Every check that fails is a row ``(stage, phase, ord, code, reason)``; the first by phase and
order is the stage's reason. Phases: 0 no metadata, 1 schedule, 2 outputs, 3 dependencies,
4 git dependencies. What stages claim of paths meets what is known of them in one join; hashing is done
before, by whoever makes ``files``, and only for what the memo does not know.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from datastrata.functions.scalars import STATUSES, fetch_due, is_named, named_due
from datastrata.operators.transfer import parent_directory


def is_side_effect() -> Column:
    return F.coalesce(F.col("side_effect"), F.col("md5").isNull() & F.col("cmd").isNotNull())


def _short(md5: Column) -> Column:
    return F.concat(F.substring(F.coalesce(md5, F.lit("")), 1, 8), F.lit("..."))


def resolve_deps(deps: DataFrame, outs: DataFrame, files: DataFrame) -> DataFrame:
    """``deps(stage, ord, dep_path, recorded)`` with ``actual``: the producer's declared hash, else the file's."""
    made = outs.select(F.col("path").alias("dep_path"), F.col("md5").alias("declared"), F.lit(True).alias("made"))
    raw = files.select(F.col("path").alias("dep_path"), F.col("md5").alias("found"), F.lit(True).alias("there"), "error")
    j = deps.join(made, "dep_path", "left").join(raw, "dep_path", "left")
    return j.select(
        "stage",
        "ord",
        "dep_path",
        "recorded",
        F.when(F.col("made"), F.col("declared")).otherwise(F.col("found")).alias("actual"),
        (F.coalesce("made", F.lit(False)) | F.coalesce("there", F.lit(False))).alias("known"),
        F.when(F.col("made").isNull(), F.col("error")).alias("error"),
    )


def schedule_checks(stages: DataFrame, now: Column) -> DataFrame:
    """Stages whose schedule is due, and, as errors, those whose schedule cannot be read: ``(stage, phase, ord, reason, code)``."""
    asked = stages.where("fetch_schedule IS NOT NULL")
    columns = F.col("fetch_schedule"), F.col("fetch_last_run"), now
    plain = asked.where(is_named(columns[0])).withColumn("_due", named_due(*columns))
    cron = asked.where(~is_named(columns[0])).withColumn("_due", fetch_due(*columns))  # only these go to Python
    due = plain.unionAll(cron).where("_due OR _due IS NULL")
    reason = F.when(F.col("_due"), "fetch schedule due").otherwise(F.concat(F.lit("invalid schedule: "), F.col("fetch_schedule")))
    return due.select(F.col("path").alias("stage"), F.lit(1).alias("phase"), F.lit(0).alias("ord"), reason.alias("reason"), F.when(F.col("_due"), "stale").otherwise("error").alias("code"))


def inner_files(files: DataFrame, outs: DataFrame, entries: DataFrame, found: DataFrame) -> DataFrame:
    """Status of files inside tracked folders: ``files(path)`` against the manifest entries of the nearest one and the hashes
    ``found(path, md5, error)``; files in no tracked folder are left out."""
    dirs = outs.where("is_dir").select(F.col("path").alias("dir_path"), F.col("md5").alias("dir_md5"))
    inside = parent_directory(files, dirs).join(dirs, "dir_path")
    listed = inside.join(entries.select("dir_md5", "relpath", F.col("md5").alias("expected")), ["dir_md5", "relpath"], "left")
    now = found.select("path", F.col("md5").alias("actual"), "error", F.lit(True).alias("there"))
    where = F.concat(F.regexp_extract("dir_path", "[^/]*$", 0), F.lit("/"))
    status = (
        F.when(F.col("expected").isNull(), "error")
        .when(F.col("there").isNull(), "missing")
        .when(F.col("error").isNotNull(), "error")
        .when(F.col("actual").eqNullSafe(F.col("expected")), "fresh")
        .otherwise("stale")
    )
    reason = (
        F.when(F.col("expected").isNull(), F.concat(F.lit("file not in manifest of tracked dir "), where))
        .when(F.col("there").isNull(), F.concat(F.lit("file missing (inside tracked dir "), where, F.lit(")")))
        .when(F.col("error").isNotNull(), F.concat(F.lit("hash error: "), F.col("error")))
        .when(status == "fresh", "up-to-date")
        .otherwise(F.concat(F.lit("hash mismatch (inside tracked dir "), where, F.lit(")")))
    )
    return listed.join(now, "path", "left").select("path", status.alias("status"), reason.alias("reason"))


def _claims(outs: DataFrame, deps: DataFrame) -> DataFrame:
    """What stages say of paths: ``(stage, git, path, expected, phase, ord)``."""
    made = outs.select("stage", F.lit(False).alias("git"), "path", F.col("md5").alias("expected"), F.lit(2).alias("phase"), F.col("ord").cast("int").alias("ord"))
    is_git = F.col("kind") == "git_dep" if "kind" in deps.columns else F.lit(False)
    needed = deps.select("stage", is_git.alias("git"), F.col("dep_path").alias("path"), F.col("recorded").alias("expected"), F.when(is_git, 4).otherwise(3).alias("phase"), F.col("ord").cast("int").alias("ord"))
    return made.unionAll(needed)


def _facts(outs: DataFrame, files: DataFrame, git: DataFrame | None) -> DataFrame:
    """What is known of each path: what its stage declares, and what is found there."""
    row = lambda df, git, declared, made, found, error: df.select(
        F.lit(git).alias("git"), "path", declared.cast("string").alias("declared"), F.lit(made).alias("made"), found.cast("string").alias("found"), F.lit(not made).alias("there"), error.cast("string").alias("error")
    )
    none = F.lit(None)
    rows = row(outs, False, F.col("md5"), True, none, none).unionAll(row(files, False, none, False, F.col("md5"), F.col("error")))
    if git is not None:
        rows = rows.unionAll(row(git.where("sha IS NOT NULL"), True, none, False, F.col("sha"), none))
    return rows.groupBy("git", "path").agg(*[f(c).alias(c) for f, c in ((F.min, "declared"), (F.max, "made"), (F.min, "found"), (F.max, "there"), (F.min, "error"))])


def path_checks(claims: DataFrame, facts: DataFrame, *keep: str) -> DataFrame:
    """``(stage, phase, ord, reason, code, alone)`` for each claim; code is null where it holds. ``alone`` is the reason of a stage's only output."""
    return judged(claims.join(facts, ["git", "path"], "left"), *keep)


def judged(j: DataFrame, *keep: str) -> DataFrame:
    """The checks of claims that have met what is known of their paths."""
    of_out, made, there = F.col("phase") == 2, F.coalesce("made", F.lit(False)), F.coalesce("there", F.lit(False))
    known = there | (~of_out & made)
    actual = F.when(~of_out & made, F.col("declared")).otherwise(F.col("found"))
    error = F.when(of_out | ~made, F.col("error"))
    code = F.when(~known, "missing").when(error.isNotNull(), "error").when(~actual.eqNullSafe(F.col("expected")), "stale")
    name = F.when(F.col("phase") == 4, "git dep").otherwise("dep")
    both = F.concat(F.lit(" ("), _short(F.col("expected")), F.lit(" vs "), _short(actual), F.lit(")"))
    out_reason = lambda path: (
        F.when(~known, F.concat(F.lit("output missing"), path)).when(error.isNotNull(), F.concat(F.lit("hash error: "), error)).otherwise(F.concat(F.lit("data changed"), path, both))
    )
    dep_reason = (
        F.when(~known, F.concat(name, F.lit(" missing: "), F.col("path")))
        .when(error.isNotNull(), F.concat(name, F.lit(" hash error: "), F.col("path"), F.lit(": "), error))
        .otherwise(F.concat(name, F.lit(" changed: "), F.col("path")))
    )
    reason = F.when(of_out, out_reason(F.concat(F.lit(": "), F.col("path")))).otherwise(dep_reason)
    return j.select("stage", "phase", "ord", *keep, reason.alias("reason"), code.alias("code"), F.when(of_out, out_reason(F.lit(""))).alias("alone"))


def freshness(
    stages: DataFrame, outs: DataFrame, deps: DataFrame, files: DataFrame, git: DataFrame | None = None, now: Column | None = None, wanted: DataFrame | None = None
) -> DataFrame:
    """``stages(path, cmd, md5, side_effect, fetch_schedule, fetch_last_run)`` and their parts -> a row per stage, and one per
    ``wanted(stage)`` without metadata.

    Claims and facts meet in one join by path, and everything about a stage in one aggregation. Outputs of side effects are not looked at."""
    checks = path_checks(_claims(outs, deps), _facts(outs, files, git)).where("phase = 2 OR code IS NOT NULL")
    if git is None:
        checks = checks.where("phase <> 4")
    parts = ["stage", "phase", "ord", "reason", "code", "alone"]
    if now is not None:
        checks = checks.unionAll(schedule_checks(stages, now).withColumn("alone", F.lit(None).cast("string")).select(*parts))
    bad = F.col("error") if "error" in stages.columns else F.lit(None).cast("string")
    quiet = F.coalesce(is_side_effect(), F.lit(False))
    rows = checks.select(*parts, F.lit(None).cast("boolean").alias("quiet"), F.lit(False).alias("there")).unionAll(
        stages.select(F.col("path"), F.lit(0), F.lit(0), bad, F.when(bad.isNotNull(), "error"), F.lit(None).cast("string"), quiet, F.lit(True))
    )
    lost = F.lit("dvc file not found or invalid")
    if wanted is not None:
        none = F.lit(None)
        rows = rows.unionAll(wanted.select("stage", F.lit(-1), F.lit(0), lost, F.lit("error"), none.cast("string"), none.cast("boolean"), F.lit(False)))
    failing = F.col("code").isNotNull()
    first = lambda some: F.min(F.when(failing & some, F.struct("phase", "ord", "reason", "code", "alone")))
    found = rows.groupBy("stage").agg(
        first(F.col("phase") == 2).alias("out"), first((F.col("phase") != 2) & (F.col("phase") >= 0)).alias("other"),
        F.max("there").alias("there"), F.max(F.col("phase") == -1).alias("wanted"), F.max("quiet").alias("quiet"), F.count_if(F.col("phase") == 2).alias("n_outs"),
    )
    least = F.when(F.col("quiet"), F.col("other")).otherwise(F.least("out", "other"))
    shown = found.where("there OR wanted").withColumn("_first", least)
    reason = F.when((F.col("_first.phase") == 2) & (F.col("n_outs") <= 1), F.col("_first.alone")).otherwise(F.col("_first.reason"))
    return shown.select(
        "stage",
        (F.col("there") & F.col("_first").isNull()).alias("fresh"),
        F.when(~F.col("there"), "error").otherwise(F.coalesce("_first.code", F.lit("fresh"))).alias("status"),
        F.when(~F.col("there"), lost).otherwise(F.coalesce(reason, F.lit("up-to-date"))).alias("reason"),
    )


def changed_deps(resolved: DataFrame) -> DataFrame:
    """All changed dependencies of each stage as ``map(path -> struct(expected, actual))``, and in order as text."""
    actual = F.when(~F.col("known"), "(missing)").when(F.col("error").isNotNull(), "(error)").otherwise(F.col("actual"))
    rows = resolved.withColumn("now", actual).where(~F.col("now").eqNullSafe(F.col("recorded")))
    entry = F.struct("ord", "dep_path", F.col("recorded").alias("expected"), F.col("now").alias("actual"))
    listed = rows.groupBy("stage").agg(F.array_sort(F.collect_list(entry)).alias("_l"))
    return listed.select(
        "stage",
        F.map_from_entries(F.transform("_l", lambda x: F.struct(x["dep_path"], F.struct(x["expected"].alias("expected"), x["actual"].alias("actual"))))).alias("changed"),
        F.array_join(F.transform("_l", lambda x: F.concat_ws("|", x["dep_path"], x["expected"], x["actual"])), ";").alias("listing"),
    )


def status_counts(status: DataFrame) -> DataFrame:
    """Stages per status, zeros kept."""
    names = status.sparkSession.createDataFrame([(s,) for s in STATUSES], "status string")
    return names.join(status.groupBy("status").agg(F.count("*").alias("n")), "status", "left").select("status", F.coalesce("n", F.lit(0)).alias("n"))


def visible(status: DataFrame, only: list[str] | None = None, verbose: bool = False, omit: list[str] | None = None) -> DataFrame:
    """The statuses to show: the named ones, else all but fresh; never the omitted."""
    shown = set(only) if only else set(STATUSES) - (set() if verbose else {"fresh"})
    return status.where(F.col("status").isin(sorted(shown - set(omit or []))))


def grouped_order(status: DataFrame) -> DataFrame:
    """In order of status, then path."""
    return status.withColumn("rank", F.array_position(F.array(*[F.lit(s) for s in STATUSES]), F.col("status"))).orderBy("rank", "stage")


def remember(memo: DataFrame, hashed: DataFrame, gone: DataFrame | None = None) -> DataFrame:
    """The memo with new entries in place of old ones of the same path, and without the paths ``gone(path)``: one entry a path."""
    both = memo.unionByName(hashed)
    if gone is not None:
        both = both.join(gone.select("path"), "path", "left_anti")
    rest = [c for c in memo.columns if c != "path"]
    newest = both.groupBy("path").agg(F.max_by(F.struct(*rest), F.struct("updated_at", *[c for c in rest if c != "updated_at"])).alias("m"))
    return newest.select(*[F.col("path") if c == "path" else F.col(f"m.{c}") for c in memo.columns])


def run_summary(results: DataFrame) -> DataFrame:
    """``(success, skipped)`` of a run's stages -> one row: how many were executed, skipped, failed."""
    return results.agg(
        F.count_if(F.col("success") & ~F.col("skipped")).alias("executed"),
        F.count_if(F.col("success") & F.col("skipped")).alias("skipped"),
        F.count_if(~F.col("success")).alias("failed"),
    )


def reuse_hashes(files: DataFrame, memo: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``files(path, mtime, size, nfiles)`` against the memo -> those with a known hash, and those to hash.

    The signature is newest time, total size and number of files, so a removed older file shows.
    """
    latest = memo.groupBy("path").agg(F.max_by(F.struct("mtime", "size", "nfiles", "md5"), "updated_at").alias("m"))
    known = files.join(latest, "path").where(
        (F.col("mtime") == F.col("m.mtime")) & (F.col("size") == F.col("m.size")) & (F.col("nfiles") == F.col("m.nfiles"))
    )
    known = known.select("path", "mtime", "size", "nfiles", F.col("m.md5").alias("md5"))
    return known, files.join(known.select("path"), "path", "left_anti")
