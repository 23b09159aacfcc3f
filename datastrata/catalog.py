"""A folder of tracked data as relations: the entry point for users."""

from __future__ import annotations

import datetime as dt
import os
import shutil

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from datastrata.functions.hashing import hash_paths
from datastrata.functions.paths import ancestors
from datastrata.functions.scalars import from_iso, parse_duration
from datastrata.operators import freshness, graph, retention, targets, transfer
from datastrata.operators.diff import version_diff
from datastrata.plans import runner
from datastrata.runtime import cut
from datastrata.sources import git as repo
from datastrata.sources import config, ignore, metadata, metadata_source, transport, urls, worktree
from datastrata.sources.store import Store, hash_path, relation


class Catalog:
    def __init__(self, spark: SparkSession, root: str, store: Store | None = None, remote: Store | None = None):
        self.spark, self.root = spark, os.path.abspath(root)
        self.store = store or Store(os.path.join(self.root, ".dvc", "cache"))
        self.remote = remote
        self.memo = worktree.Memo(spark, os.path.join(self.root, ".dvc", "memo"))
        self.files_read = 0

    @classmethod
    def create(cls, spark: SparkSession, root: str, **stores: Store) -> Catalog:
        os.makedirs(os.path.join(root, ".dvc", "cache"), exist_ok=True)
        return cls(spark, root, **stores)

    def track(self, path: str, cmd: str | None = None, deps: list[str] | None = None) -> metadata.Stage:
        """Store a file or folder and write its metadata."""
        full = os.path.join(self.root, path)
        if lost := [d for d in deps or [] if not os.path.exists(os.path.join(self.root, d))]:
            raise FileNotFoundError(f"dependencies: {lost[:10]}")
        md5, size, nfiles = self.store.add(full)
        ignore.add(full)
        known = {d: hash_path(os.path.join(self.root, d))[0] for d in deps or []}
        stage = metadata.Stage(path, [metadata.Out(path, md5, size, nfiles is not None, nfiles)], cmd, known)
        metadata.write_atomic(full + metadata.SUFFIX, metadata.render(stage))
        return stage

    def import_url(self, url: str, out: str | None = None, download: bool = True, user_agent: str | None = None, client: urls.Client = urls.http) -> metadata.Stage:
        """Track a URL's file in git, with where it comes from; without a download only what its headers say."""
        path = self._inside(out or urls.file_name(url))
        full = os.path.join(self.root, path)
        os.makedirs(os.path.dirname(full), exist_ok=True)
        if download:
            origin, md5 = urls.fetch(url, full, client, user_agent)
        else:
            origin, md5 = urls.provenance(url, client("HEAD", url, user_agent)[0], user_agent), None
        stage = metadata.Stage(path, [metadata.Out(path, md5, origin.size)], git_tracked=True, origin=origin, fetched=dt.date.today().isoformat())
        metadata.write_atomic(full + metadata.SUFFIX, metadata.render(stage))
        ignore.remove(full)
        return stage

    def update(self, path: str, download: bool = True, client: urls.Client = urls.http) -> bool:
        """Look again at where an import comes from; whether it changed."""
        name = self._inside(path).removesuffix(metadata.SUFFIX) + metadata.SUFFIX
        full = os.path.join(self.root, name)
        with open(full, encoding="utf-8") as f:
            stage = metadata.parse(name, f.read())
        if stage is None or stage.origin is None or not stage.git_tracked:
            raise ValueError(f"not an import: {path}")
        old = stage.origin
        if download:
            origin, md5 = urls.fetch(old.url, full.removesuffix(metadata.SUFFIX), client, old.user_agent, old if stage.outs[0].md5 else None)
            if md5 is None:
                return False
        else:
            origin, md5 = urls.provenance(old.url, client("HEAD", old.url, old.user_agent)[0], old.user_agent), stage.outs[0].md5
            if not urls.changed(old, origin):
                return False
        stage.origin, stage.outs[0].md5, stage.outs[0].size, stage.fetched = origin, md5, origin.size, dt.date.today().isoformat()
        metadata.write_atomic(full, metadata.render(stage))
        return True

    def imports(self) -> DataFrame:
        return metadata.imports(metadata.scan(self.spark, self.root))

    def relations(self) -> tuple[DataFrame, DataFrame, DataFrame]:
        return metadata.relations(metadata.scan(self.spark, self.root))

    def relations_for(self, only: list[str]) -> tuple[tuple[DataFrame, DataFrame, DataFrame], DataFrame]:
        """The relations of what some targets may stand for and of all that is upstream of it, and the ids ``(stage)`` of these; no other folder
        is listed. Files name outputs in or below their own folder, so a path's producer is in a folder above it."""
        names = {self._inside(t) for t in only}
        if "." in names:
            found = self.relations()
            return found, found[0].select(F.col("path").alias("stage"))
        trees = sorted(n for n in names if os.path.isdir(os.path.join(self.root, n)))
        trees = [t for t in trees if not any(t.startswith(o + "/") for o in trees)]
        above = lambda p: {p[:i] for i, c in enumerate(p) if c == "/"} | {""}
        whole = lambda f: any(f == t or f.startswith(t + "/") for t in trees)
        new = {f for n in names for f in above(n) if not whole(f)}
        texts = metadata_source.files(self.spark, self.root, metadata_source.in_folders(sorted(new)))
        for t in trees:
            texts = texts.unionAll(metadata_source.files(self.spark, self.root, metadata_source.below(t)))
        loaded, found = set(new), metadata.relations(texts)
        tree = F.lit(False)
        for t in trees:
            tree |= F.col("stage").startswith(t + "/")
        stem = [n.removesuffix(metadata.SUFFIX) for n in names]
        holders = [f for n in stem for f in above(n) if f]  # a file's tracked folder
        front = cut(found[0].select(F.col("path").alias("stage")).where(tree | F.col("stage").isin(stem + holders)))
        seen = front
        while True:
            deps = cut(found[2].join(front, "stage", "left_semi"))
            paths = deps.select(F.explode(F.array_append(ancestors(F.col("dep_path")), F.lit(""))).alias("folder")).distinct()
            new = {r.folder for r in paths.where(~F.col("folder").isin(sorted(loaded))).collect() if not whole(r.folder)}
            if new:
                loaded |= new
                more = metadata.relations(metadata_source.files(self.spark, self.root, metadata_source.in_folders(sorted(new))))
                found = tuple(a.unionAll(b) for a, b in zip(found, more))
            makers = graph.attach_producers(graph.edges_of(deps, ("dep", "git_dep")), found[1]).select(F.col("src").alias("stage")).distinct()
            front = cut(makers.join(found[0].select(F.col("path").alias("stage")), "stage", "left_semi").join(seen, "stage", "left_anti"))
            if front.isEmpty():
                return found, seen
            seen = seen.unionAll(front)

    def _files(self, outs: DataFrame, deps: DataFrame) -> DataFrame:
        """Hashes of what stages name, by tasks; what the memo knows is not read again."""
        names = outs.select("path").unionAll(deps.where("kind = 'dep'").select(F.col("dep_path").alias("path")))
        found, self.files_read = worktree.hashes(self.root, names, self.memo)
        return found

    def status(self, now: str | None = None, transitive: bool = True, only: list[str] | None = None) -> DataFrame:
        """``(path, status, reason)`` of all stages, those with unreadable metadata too, or of what ``only`` names: stages, folders of
        stages, files in tracked folders, and names that stand for nothing, as errors."""
        if only is None:
            stages, outs, deps = self.relations()
            needed = outs, deps
        else:
            (stages, outs, deps), upstream = self.relations_for(only)
            needed = outs.join(upstream, "stage", "left_semi"), deps.join(upstream, "stage", "left_semi")
        dated = stages.withColumn("fetch_last_run", from_iso(F.col("fetch_last_run")))
        when = F.lit(now).cast("timestamp") if now else F.current_timestamp()
        files = self._files(*needed)
        wanted = rest = None
        if only is not None:
            names = self.spark.createDataFrame([(self._inside(t),) for t in only], "target string")
            there = self.spark.createDataFrame([(t,) for (t,) in names.collect() if os.path.exists(os.path.join(self.root, t))], "path string")
            found = targets.expand(names, stages.select(F.col("path").alias("stage")), there)
            wanted = found.where("kind <> 'file'").select(F.col("path").alias("stage")).distinct()
            rest = self._inner_status(found.where("kind = 'file'").select("path").distinct(), outs)
        shas = [(d, sha) for (d,) in deps.where("kind = 'git_dep'").select("dep_path").distinct().collect() if (sha := runner.git_sha(self.root, d))]
        git = self.spark.createDataFrame(shas, "path string, sha string")
        found = freshness.freshness(dated, outs, deps, files, git, when, wanted).withColumnRenamed("stage", "id")
        if transitive:
            edges = graph.attach_producers(graph.edges_of(deps, ("dep", "git_dep")), outs)
            found = graph.transitive_status(found.select("id", "status", "reason"), edges.select("src", "dst"))
        found = found.withColumnRenamed("id", "path").select("path", "status", "reason")
        if only is not None:
            found = found.join(wanted.withColumnRenamed("stage", "path"), "path", "left_semi").unionAll(rest)
        return found.orderBy("path")

    def _inside(self, path: str) -> str:
        return os.path.relpath(os.path.join(self.root, path), self.root).replace(os.sep, "/")

    def _inner_status(self, files: DataFrame, outs: DataFrame) -> DataFrame:
        known = transport.entries(outs.where("is_dir AND md5 IS NOT NULL").select("md5").distinct(), [self.store]).select("dir_md5", "relpath", "md5")
        full = files.select(F.concat(F.lit(self.root + "/"), F.col("path")).alias("path"))
        found = hash_paths(full).select(F.substring("path", len(self.root) + 2, 1 << 30).alias("path"), "md5", "error")
        status = freshness.inner_files(files, outs, known, found)
        alone = files.join(status, "path", "left_anti").select("path", F.lit("error").alias("status"), F.lit("dvc file not found or invalid").alias("reason"))
        return status.unionAll(alone)

    def graph(self, git: bool = False) -> tuple[DataFrame, DataFrame]:
        stages, outs, deps = self.relations()
        edges = graph.attach_producers(graph.edges_of(deps, ("dep", "git_dep") if git else ("dep",)), outs)
        return stages.select(F.col("path").alias("id"), "cmd", "md5"), edges.select("src", "dst")

    def transfer_status(self, direction: str = "pull", only: list[str] | None = None) -> DataFrame:
        """What a transfer would move, ``(path, md5, size, state)``; git-tracked imports are in no store and left out."""
        stages, outs, _ = self.relations()
        if only is not None:
            outs = outs.join(self._chosen(only), "stage", "left_semi")
        side = self.remote if direction == "push" else self.store
        return transfer.transfer_status(outs, relation(self.spark, side), stages)

    def transfer_status_at(self, ref: str, only: list[str] | None = None) -> DataFrame:
        """The same for the metadata at a git ref, against the local store."""
        texts = repo.texts_at(self.spark, self.root, [ref])
        stages, outs, _ = metadata.relations(texts.select("path", "text"))
        if only is not None:
            outs = outs.join(self._chosen(only, stages), "stage", "left_semi")
        return transfer.transfer_status(outs, relation(self.spark, self.store), stages)

    def _chosen(self, only: list[str], stages: DataFrame | None = None) -> DataFrame:
        stages = self.relations()[0] if stages is None else stages
        names = self.spark.createDataFrame([(self._inside(t),) for t in only], "target string")
        found = targets.for_transfer(names, stages.select(F.col("path").alias("stage")))
        lost = [r.target for r in found.where("path IS NULL").collect()]
        if lost:
            raise ValueError(f"not tracked: {lost[:10]}")
        return found.select(F.col("path").alias("stage")).distinct()

    def push(self, only: list[str] | None = None, dry_run: bool = False, ref: str | None = None) -> list[tuple[str, str]]:
        """From the local store to the remote, as the metadata are or were at a ref: what it lacks of the outputs, and of the files in
        folders, also of those folders that it has."""
        return self._copy(self.store, self.remote, only, dry_run, ref)

    def fetch(self, only: list[str] | None = None, dry_run: bool = False, ref: str | None = None) -> list[tuple[str, str]]:
        """From the remote to the local store; the files themselves stay as they are."""
        return self._copy(self.remote, self.store, only, dry_run, ref)

    def pull(self, only: list[str] | None = None) -> list[tuple[str, str]]:
        """Fetch, and outputs as their metadata say, also where they were changed; files that were never tracked stay."""
        moved = self.fetch(only)
        self.checkout(only, overwrite=True)
        return moved

    def _stored(self, only: list[str] | None = None, ref: str | None = None) -> DataFrame:
        """Outputs that a store keeps; ``only`` are stages, folders of stages, or patterns."""
        texts = metadata.scan(self.spark, self.root) if ref is None else repo.texts_at(self.spark, self.root, [ref]).select("path", "text")
        stages, outs, _ = metadata.relations(texts)
        outs = outs.where("md5 IS NOT NULL").join(stages.where("git_tracked").select(F.col("path").alias("stage")), "stage", "left_anti")
        if only is None:
            return outs
        patterns = [self._inside(t) for t in only if set(t) & set("*?[")]
        plain = [t for t in only if not set(t) & set("*?[")]
        chosen = targets.by_pattern(stages.select("path"), patterns).select(F.col("path").alias("stage")) if patterns else None
        if plain or chosen is None:
            named = self._chosen(plain, stages)
            chosen = named if chosen is None else chosen.unionAll(named)
        return outs.join(chosen.distinct(), "stage", "left_semi")

    def _copy(self, source: Store, target: Store, only: list[str] | None = None, dry_run: bool = False, ref: str | None = None) -> list[tuple[str, str]]:
        wanted = self._stored(only, ref).select("md5", "is_dir").distinct()
        if dry_run:
            planned = transport.plan(self.spark, wanted, source, target).join(wanted.select("md5"), "md5", "left_semi")
            return [(r.md5, "copied" if r.state == "copy" else r.state) for r in planned.collect()]
        return [(r.md5, r.state) for r in transport.transfer(self.spark, wanted, source, target).select("md5", "state").collect()]

    def checkout(self, only: list[str] | None = None, overwrite: bool = False, clear: bool = False) -> list[tuple[str, str]]:
        """Outputs as their metadata say; ``(path, state)`` of all that was not so: restored, removed (no longer in its folder), missing in the
        store, or kept: changed, and not to be ``overwrite``-n, or a folder's file that is in no listing nor in the store, and the folder not
        to be ``clear``-ed."""
        outs = self._stored(only)
        entries = transport.entries(outs.where("is_dir").select("md5").distinct(), [self.store])
        empty = outs.where("is_dir AND nfiles = 0").select("path").collect()
        for r in empty:
            os.makedirs(os.path.join(self.root, r.path), exist_ok=True)
        found = worktree.restored(self.root, outs.select("path", "md5", "is_dir"), entries.select("dir_md5", "relpath", "md5"), self.store, overwrite, clear)
        return [(r.path, r.state) for r in found.where("state <> 'same'").orderBy("path").collect()]

    def locate(self, path: str, ref: str | None = None) -> str | None:
        """Where the store keeps a tracked file, or a file in a tracked folder, as it is now or was at a ref; None if nowhere."""
        inside = self._inside(path)
        texts = metadata.scan(self.spark, self.root) if ref is None else repo.texts_at(self.spark, self.root, [ref]).select("path", "text")
        _, outs, _ = metadata.relations(texts)
        by = {r.path: r for r in outs.where("md5 IS NOT NULL").collect()}
        if inside in by:
            place = self.store.location(by[inside].md5, by[inside].is_dir)
            return place if os.path.exists(place) else None
        top = os.path.dirname(inside)
        while top and top not in by:
            top = os.path.dirname(top)
        md5 = self.store.manifest(by[top].md5).get(inside[len(top) + 1 :]) if top else None
        place = self.store.location(md5) if md5 else None
        return place if place and os.path.exists(place) else None

    def read(self, path: str, ref: str | None = None) -> bytes:
        place = self.locate(path, ref)
        if place is None:
            raise FileNotFoundError(path)
        with open(place, "rb") as f:
            return f.read()

    def diff(self, before: str, after: str | None = None) -> DataFrame:
        """Added, deleted, modified and renamed outputs between two refs, or a ref and the metadata as it is."""
        old = repo.texts_at(self.spark, self.root, [before]).select("path", "text")
        new = metadata.scan(self.spark, self.root) if after is None else repo.texts_at(self.spark, self.root, [after]).select("path", "text")
        side = lambda texts: metadata.relations(texts)[1].select("path", "md5", "size")
        return version_diff(side(old), side(new))

    def remove(self, path: str, outputs: bool = False) -> None:
        """Track a path no more; its data go only if asked."""
        inside = self._inside(path).removesuffix(metadata.SUFFIX)
        full = os.path.join(self.root, inside)
        os.unlink(full + metadata.SUFFIX)
        if outputs and os.path.isdir(full):
            shutil.rmtree(full)
        elif outputs and os.path.exists(full):
            os.unlink(full)

    def move(self, path: str, to: str) -> metadata.Stage:
        """Rename a tracked path: its metadata, outputs and data."""
        old, new = self._inside(path), self._inside(to)
        with open(os.path.join(self.root, old + metadata.SUFFIX), encoding="utf-8") as f:
            stage = metadata.parse(old + metadata.SUFFIX, f.read())
        for o in stage.outs:
            o.path = new if o.path == old else o.path
        stage.path = new
        os.makedirs(os.path.dirname(os.path.join(self.root, new)), exist_ok=True)
        metadata.write_atomic(os.path.join(self.root, new + metadata.SUFFIX), metadata.render(stage))
        if os.path.exists(os.path.join(self.root, old)):
            os.replace(os.path.join(self.root, old), os.path.join(self.root, new))
        os.unlink(os.path.join(self.root, old + metadata.SUFFIX))
        return stage

    def garbage(self, refs: list[str] | None = None, keep: int | None = None, newer_than: str | None = None, only: list[str] | None = None) -> DataFrame:
        """Blobs to delete, largest first, ``(md5, is_dir, size, location)``. Kept are what the metadata, as it is and at the refs (HEAD, if none are
        given and there is one), names, what is inside kept folders, and what the policy keeps of the versions at these refs; ``only`` limits the rest to what some stages ever named."""
        if refs is None:
            refs = ["HEAD"] if repo.head(self.root) else []
        if not refs and (keep is not None or newer_than is not None):
            raise ValueError("a policy needs versions, and there is no ref that has any")
        now = metadata.scan(self.spark, self.root).select(F.lit("").alias("ref"), F.lit("").alias("sha"), "path", "text")
        trees = now.unionAll(repo.texts_at(self.spark, self.root, refs)) if refs else now
        named = metadata.relations(trees.select("path", "text"))[1]
        kept = named.select("md5")
        blobs = relation(self.spark, self.store)
        versions = candidates = None
        if only is not None:
            candidates = named.join(self._chosen(only), "stage", "left_semi").select("md5")
        if refs and (keep is not None or newer_than is not None or only is not None):
            history = repo.file_history(self.spark, self.root, None, refs).where("text IS NOT NULL")
            seen = history.withColumn("stage", F.regexp_replace("path", r"\.dvc$", "")).drop("path")
            hashes = F.explode(F.regexp_extract_all("text", F.lit(r"md5:\s*([0-9a-f]{32})"), 1))
            versions = seen.select("stage", "sha", F.timestamp_seconds("at").alias("at"), hashes.alias("md5")).groupBy("stage", "md5").agg(F.min("at").alias("at"))
            if only is not None:
                candidates = candidates.unionAll(versions.join(self._chosen(only), "stage", "left_semi").select("md5"))
        if versions is not None and (keep is not None or newer_than is not None):
            since = F.current_timestamp() - F.make_dt_interval(secs=F.lit(parse_duration(newer_than).total_seconds())) if newer_than else None
            kept = kept.unionAll(retention.keep_set(versions, ["stage"], keep, since).select("md5"))
        manifests = transport.entries(blobs.where("is_dir").select("md5"), [self.store]).select("dir_md5", "md5")
        return retention.by_size(retention.plan(blobs, kept.where("md5 IS NOT NULL"), kept.limit(0), manifests, candidates))

    def collect_garbage(self, keep: list[tuple[str, bool]] | None = None, safe: bool = False, confirm: bool = False, **policy) -> tuple[list[str], int]:
        """Blobs that ``garbage`` lists, but not those to ``keep``; deleted only on confirmation, and safely only if the remote has them."""
        held = {m for m, _ in keep or []} | {i for m, is_dir in keep or [] if is_dir for i in self.store.manifest(m).values()}
        gone = [(r.md5, r.is_dir) for r in self.garbage(**policy).collect() if r.md5 not in held]
        if safe and (missing := [m for m, d in gone if not self.remote.has(m, d)]):
            raise RuntimeError(f"not in the remote: {missing[:10]}")
        freed = sum(self.store.delete(m, d) for m, d in gone) if confirm else 0
        return [m for m, _ in gone], freed

    def run(self, only: list[str] | None = None, **options) -> list[runner.Result]:
        """Runs stages by the folder's configuration, where it has one and no other is given."""
        if "config" not in options and any(os.path.exists(os.path.join(self.root, name)) for name in config.NAMES):
            options["config"] = config.load(self.root)
        return runner.run(self.root, only, runner.Options(**options), self.store, remote=self.remote)
