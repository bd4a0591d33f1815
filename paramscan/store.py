"""Datasets under version control: staged state, commits, branches, checkout.

A dataset directory holds a store: snapshots of configuration and manifest by
commit, branch references, and file contents by digest. What changed, what is
missing and what must move is planned with DataFrames. Files are copied, moved
and hashed on the executors, which share the dataset's directory; a checkout
sets files aside before it installs others, and puts them back if it fails.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import shutil
import time

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import config as configuration
from .errors import CheckoutError, CloneError, DestinationExistsError, StoreError
from .functions.paths import checked_relative, within
from .functions.values import safe_text
from .plans.cut import checkpoint, discard
from .operators import diff, manifest
from .operators.frame import ParamFrame
from .plans.spec import FormatSpec
from .sources.inventory import file_digest, inventory, with_checksum
from .sources.tables import atomic_path, dump_yaml, load_yaml, read_tsv, write_tsv

PARTS = ("config.yml", "meta.yml", "data.tsv")
SHOWN_ERRORS = 5
CHUNK = 1 << 20


def branch_name(name: str) -> str:
    """A name by git's rules for references."""
    bad = not name or name.startswith(("-", "/", ".")) or name.endswith(("/", ".", ".lock")) or name == "@"
    if bad or re.search(r"\.\.|//|@\{|[\x00-\x20\x7f~^:?*\[\\]|/\.", name):
        raise ValueError(f"not a branch name: {name!r}")
    return name


def contained(root: str, path: str) -> str:
    """``root/path`` for a safe relative path without symbolic links on the way."""
    full = os.path.join(root, checked_relative(path))
    at = root
    for part in path.split("/"):
        at = os.path.join(at, part)
        if os.path.islink(at):
            raise ValueError(f"{path} leads through a symbolic link")
    return full


def copy_verified(source: str, target: str, sha1: str) -> None:
    """A copy that appears whole, with the content of that digest, or not at all."""
    if not os.path.isfile(source):
        raise FileNotFoundError(f"{source} is not there")
    os.makedirs(os.path.dirname(target), exist_ok=True)
    found = hashlib.sha1()
    with atomic_path(target) as temp:
        with open(source, "rb") as a, open(temp, "wb") as b:
            while piece := a.read(CHUNK):
                found.update(piece)
                b.write(piece)
        if found.hexdigest() != sha1.lower():
            raise StoreError(f"{source} does not have the digest {sha1}")


def transfer(rows: DataFrame) -> int:
    """Copy files ``(source, target, sha1)`` on the executors; how many. Targets that are there stay if ``sha1`` names them."""

    def run(batches):
        for pdf in batches:
            errors = []
            for source, target, sha1 in zip(pdf["source"], pdf["target"], pdf["sha1"]):
                try:
                    copy_verified(source, target, sha1)
                    errors.append(None)
                except (OSError, StoreError) as e:
                    errors.append(str(e))
            yield pd.DataFrame({"target": pdf["target"], "error": errors}, dtype=object)

    done = rows.mapInPandas(run, "target string, error string")
    outcome = done.agg(F.count("*").alias("n"), F.slice(F.array_sort(F.collect_list("error")), 1, SHOWN_ERRORS).alias("shown"), F.count("error").alias("failed")).first()
    if outcome.failed:
        raise StoreError(f"{outcome.failed} files could not be copied: " + "; ".join(outcome.shown))
    return outcome.n


def each(rows: DataFrame, act) -> None:
    """Run ``act`` on each ``path`` on the executors; errors are gathered and raised as one."""

    def run(batches):
        for pdf in batches:
            errors = []
            for path in pdf["path"]:
                try:
                    act(path)
                    errors.append(None)
                except (OSError, ValueError) as e:
                    errors.append(f"{path}: {e}")
            yield pd.DataFrame({"error": errors}, dtype=object)

    bad = rows.select("path").mapInPandas(run, "error string").agg(F.slice(F.array_sort(F.collect_list("error")), 1, SHOWN_ERRORS).alias("shown")).first().shown
    if bad:
        raise StoreError("; ".join(bad))


def _set_aside(path: str, backup: str) -> None:
    """Move a file to its backup; one that a task has moved before is there already."""
    if os.path.lexists(path) and not os.path.exists(backup):
        os.makedirs(os.path.dirname(backup), exist_ok=True)
        os.replace(path, backup)


def _put_back(path: str, backup: str, new: bool) -> None:
    """Undo: a backup takes its place again; without one, what is there goes if it can only be ``new``."""
    if os.path.lexists(backup):
        os.makedirs(os.path.dirname(path), exist_ok=True)
        os.replace(backup, path)
    elif new and os.path.isfile(path):
        os.unlink(path)


class Dataset:
    """A directory of files and its store (``DIR/.hm``; a path that ends in ``.hm`` is a store without files)."""

    def __init__(self, spark: SparkSession, path: str):
        if os.path.exists(path) and not os.path.isdir(path):
            raise NotADirectoryError(f"{path} is not a directory")
        self.spark, self.root = spark, None if path.endswith(".hm") else os.path.abspath(path)
        self.home = os.path.abspath(path) if self.root is None else os.path.join(self.root, ".hm")
        link = os.path.join(self.home, "store")
        self.store = open(link).read().strip() if os.path.isfile(link) else self.home
        if not os.path.isfile(os.path.join(self.store, "refs.json")):
            raise StoreError(f"no store at {path}")

    # --- making and copying

    @classmethod
    def init(cls, spark: SparkSession, path: str, branch: str = "main") -> Dataset:
        home = path if path.endswith(".hm") else os.path.join(path, ".hm")
        if os.path.exists(os.path.join(home, "refs.json")):
            raise DestinationExistsError(f"{home} is there already")
        os.makedirs(os.path.join(home, "objects"), exist_ok=True)
        with open(os.path.join(home, "refs.json"), "w") as f:
            json.dump({branch_name(branch): None}, f)
        with open(os.path.join(home, "HEAD"), "w") as f:
            f.write(branch)
        out = cls(spark, path)
        out._stage(configuration.TEMPLATE, {}, spark.createDataFrame([], "sha1 string"))
        out.commit("Initial commit", allow_empty=True)
        return out

    @classmethod
    def clone(cls, spark: SparkSession, source: str, path: str, fetch_data: bool = True, workers: int = 4, fetch=None) -> Dataset:
        """Copy a store and install its current branch; nothing is left behind on failure.

        Contents that the store lacks are downloaded from the configured remote;
        without ``fetch_data`` they are left out.
        """
        origin = cls(spark, source)
        if os.path.exists(path) and os.listdir(path):
            raise DestinationExistsError(f"{path} is there already")
        home = path if path.endswith(".hm") else os.path.join(path, ".hm")
        made = not os.path.exists(path)
        try:
            shutil.copytree(origin.store, home)
            out = cls(spark, path)
            for part in PARTS:
                if not os.path.isfile(os.path.join(home, "staged", part)):
                    raise CloneError(f"{source} has no {part}")
            if out.root:
                head = out.entries_at(out.revision(out.branch)).persist()
                here = out.objects()
                out._install(head.join(here, "sha1", "left_semi"))
                lost = head.join(here, "sha1", "left_anti")
                if fetch_data and not lost.isEmpty():
                    out._download(lost, workers, fetch)
                head.unpersist()
            return out
        except Exception as e:
            shutil.rmtree(path if made else home, ignore_errors=True)
            raise e if isinstance(e, CloneError) else CloneError(f"cannot copy {source}: {e}") from e

    # --- state

    @property
    def branch(self) -> str:
        with open(os.path.join(self.home, "HEAD")) as f:
            return f.read().strip()

    def refs(self) -> dict:
        with open(os.path.join(self.store, "refs.json")) as f:
            return json.load(f)

    def branches(self) -> dict:
        return {"current": self.branch, "names": sorted(self.refs())}

    def revision(self, branch: str) -> str | None:
        return self.refs().get(branch)

    def _folder(self, commit: str | None) -> str:
        return os.path.join(self.home, "staged") if commit is None else os.path.join(self.store, "snapshots", commit)

    def config(self, commit: str | None = None) -> dict:
        return load_yaml(os.path.join(self._folder(commit), "config.yml"))

    def meta(self, commit: str | None = None) -> dict:
        return load_yaml(os.path.join(self._folder(commit), "meta.yml"))

    def data(self, commit: str | None = None) -> DataFrame:
        """The manifest that is staged, or that of a commit."""
        return read_tsv(self.spark, "file://" + os.path.join(self._folder(commit), "data.tsv"))

    def entries_at(self, commit: str | None) -> DataFrame:
        """``(path, sha1)`` of a commit's manifest, or of the staged one."""
        entry = configuration.single_format(self.config(commit))
        data = self.data(commit)
        if entry is None or len(data.columns) < 2:
            return self.spark.createDataFrame([], "path string, sha1 string")
        return manifest.entries(data, entry["fmt"])

    def _stage(self, config: dict, meta: dict, data: DataFrame) -> None:
        # data may still read the file that it replaces: that is exchanged when all is written
        folder = self._folder(None)
        os.makedirs(folder, exist_ok=True)
        write_tsv(data, os.path.join(folder, "data.tsv"))
        dump_yaml(config, os.path.join(folder, "config.yml"))
        dump_yaml(meta, os.path.join(folder, "meta.yml"))

    def objects(self) -> DataFrame:
        """``(sha1)`` of every stored object."""
        files = inventory(self.spark, os.path.join(self.store, "objects"))
        return files.filter(F.col("path").rlike("^[0-9a-f]{2}/[0-9a-f]{38}$")).select(F.replace("path", F.lit("/"), F.lit("")).alias("sha1"))

    def _object(self, sha1: str) -> str:
        sha1 = sha1.strip().lower()
        if not re.fullmatch("[0-9a-f]{40}", sha1):
            raise ValueError(f"not a sha1: {sha1!r}")
        return os.path.join(self.store, "objects", sha1[:2], sha1[2:])

    def _object_path(self, sha1: Column) -> Column:
        return F.concat(F.lit(os.path.join(self.store, "objects") + "/"), F.substring(sha1, 1, 2), F.lit("/"), F.substring(sha1, 3, 38))

    def _keep(self, files: DataFrame) -> int:
        """Store contents of files ``(source, sha1)``, each digest once; a file must have its digest."""
        rows = files.select(F.col("source"), F.lower(F.trim("sha1")).alias("sha1")).groupBy("sha1").agg(F.min("source").alias("source"))
        return transfer(rows.join(self.objects(), "sha1", "left_anti").select("source", self._object_path(F.col("sha1")).alias("target"), "sha1"))

    def _install(self, entries: DataFrame) -> int:
        """Restore ``(path, sha1)`` into the directory, which must lead through no symbolic link."""
        for r in entries.select(F.regexp_extract("path", "(?s)^(.*)/[^/]*$", 1).alias("folder")).distinct().toLocalIterator():
            contained(self.root, f"{r.folder}/x" if r.folder else "x")
        rows = entries.select(F.lower(F.trim("sha1")).alias("sha1"), "path")
        return transfer(rows.select(self._object_path(F.col("sha1")).alias("source"), F.concat(F.lit(self.root + "/"), "path").alias("target"), "sha1"))

    def _download(self, entries: DataFrame, workers: int, fetch=None) -> None:
        from .operators.select import outcome_summary
        from .sources.remote import download

        rows = entries.select(F.xxhash64("path").alias("ord"), "path", F.lit("sha1").alias("algorithm"), F.col("sha1").alias("checksum"))
        done = outcome_summary(download(rows, configuration.remote_url(self.config()), self.root, workers, fetch)).first()
        if done.failed:
            raise StoreError(f"{done.failed} files could not be downloaded:\n{done.errors}")

    def _restore(self, sha1: str, path: str) -> None:
        source = self._object(sha1)
        if not os.path.exists(source):
            raise FileNotFoundError(f"object {sha1} is not in the store")
        copy_verified(source, path, sha1)

    def fetch_missing(self, origin: str, commit: str | None = None) -> int:
        """Copy objects that a commit (or the staged manifest) needs from another store on this machine; how many."""
        other = Dataset(self.spark, origin)
        lost = diff.missing_objects(self.entries_at(commit), self.objects())
        found = lost.join(other.objects(), "sha1", "left_semi")
        return self._keep(found.select(other._object_path(F.col("sha1")).alias("source"), "sha1"))

    # --- adding and committing

    def set_config(self, fmt: str | None = None, encoding: dict | None = None, remote=None, remote_name: str | None = None, remote_url: str | None = None) -> dict:
        """Set what is given: ``remote`` replaces all remotes, ``remote_name`` and ``remote_url`` change one."""
        config = configuration.with_format(self.config(), fmt, encoding, remote)
        if remote_name is not None or remote_url is not None:
            config = configuration.with_remote(config, remote_name, remote_url)
        self._stage(config, self.meta(), self.data())
        return config

    def add_paths(self, paths) -> None:
        """Single files can't be added: a manifest row is a digest and the fields of a format."""
        raise RuntimeError("explicit path add is not supported: a manifest holds digests and format fields only")

    def below(self) -> str:
        """The working directory relative to the dataset's, if it is inside of it; else the dataset's own."""
        if self.root is None:
            raise RuntimeError("a store without files has no directory to look into")
        here = os.path.relpath(os.path.realpath(os.getcwd()), os.path.realpath(self.root))
        return "" if here == "." or here.split(os.sep)[0] == ".." else here.replace(os.sep, "/")

    def add(self, fmt: str, encoding: bool = False, below: str = "") -> DataFrame:
        """Index the files of a format. ``"."`` scans again with the known format, below ``below``, and replaces; a format seen before upserts."""
        if self.root is None:
            raise StoreError("a store without files cannot add any")
        entry = configuration.single_format(self.config()) or {}
        again = fmt == "."
        fmt = entry.get("fmt") if again else fmt
        if not fmt:
            raise ValueError("no format is configured")
        encodings = [{"fmt": fmt, "encoding": entry["encoding"]}] if entry.get("encoding") else []
        found = ParamFrame.parse(self.spark, fmt, self.root, encodings, encoding and bool(encodings)).df
        if again:
            found = found.filter(within(F.col("path"), below))
        found = with_checksum(found, self.root)
        new = manifest.numbered(self._rows(found, fmt))
        config = configuration.with_format(self.config(), fmt)
        if again or entry.get("fmt") != fmt:
            data = manifest.normalised(new.orderBy("seq").drop("seq"))
        else:
            old = self.data()
            old = manifest.numbered(old.withColumn("path", FormatSpec.compile(fmt).render())) if len(old.columns) > 1 else old.withColumn("seq", F.lit(0).cast("bigint"))
            data = manifest.upsert(old.drop("path"), new.drop("path")).orderBy("seq").drop("seq")
        self._stage(config, self.meta(), data)
        return found.drop("sha1")

    @staticmethod
    def _rows(found: DataFrame, fmt: str) -> DataFrame:
        kinds = {f.name: f.dataType for f in found.schema}
        return found.select("path", "sha1", *[safe_text(F.col(c), kinds[c]).alias(c) for c in FormatSpec.compile(fmt).fields])

    def commit(self, message: str, allow_empty: bool = False) -> bool:
        """Store new contents and a snapshot; False if nothing is staged."""
        head = self.revision(self.branch)
        same = head is not None and all(self._bytes(None, p) == self._bytes(head, p) for p in PARTS)
        if same and not allow_empty:
            return False
        if self.root is not None:
            staged = self.entries_at(None)
            before = self.entries_at(head) if head else staged.limit(0)
            if head and configuration.single_format(self.config(head)) != configuration.single_format(self.config()):
                before = before.limit(0)
            changed = diff.files_to_store(staged, before, self.objects())
            self._keep(changed.select(F.concat(F.lit(self.root + "/"), "path").alias("source"), "sha1"))
        stamp = time.time()
        number = hashlib.sha1(b"\0".join([self._bytes(None, p) for p in PARTS] + [str(head).encode(), message.encode(), str(stamp).encode()])).hexdigest()
        shutil.copytree(self._folder(None), self._folder(number))
        with open(os.path.join(self.store, "log.jsonl"), "a") as f:
            f.write(json.dumps({"commit": number, "parent": head, "branch": self.branch, "time": stamp, "message": message}) + "\n")
        self._set_ref(self.branch, number)
        return True

    def _bytes(self, commit: str | None, part: str) -> bytes:
        with open(os.path.join(self._folder(commit), part), "rb") as f:
            return f.read()

    def _set_ref(self, branch: str, commit: str | None) -> None:
        refs = {**self.refs(), branch: commit}
        with atomic_path(os.path.join(self.store, "refs.json")) as temp, open(temp, "w") as f:
            json.dump(refs, f)

    def log(self) -> list[dict]:
        """Commits of the current branch, newest first."""
        with open(os.path.join(self.store, "log.jsonl")) as f:
            known = {c["commit"]: c for c in map(json.loads, f)}
        out, at = [], self.revision(self.branch)
        while at:
            out.append(known[at])
            at = known[at]["parent"]
        return out

    # --- comparing

    def status_frame(self) -> DataFrame:
        """``(section, label, path)``: staged, worktree and untracked differences."""
        head, staged = self.entries_at(self.revision(self.branch)), self.entries_at(None)
        parts = [diff.staged_changes(head, staged).select(F.lit("staged").alias("section"), "label", "path")]
        if self.root is not None:
            expected = staged.filter("path is not null")
            actual = with_checksum(expected.select("path"), self.root).filter("sha1 is not null")
            parts.append(diff.worktree_changes(expected, actual).select(F.lit("worktree").alias("section"), "label", "path"))
            files = inventory(self.spark, self.root)
            parts.append(diff.untracked(files, staged).select(F.lit("untracked").alias("section"), F.lit("untracked").alias("label"), "path"))
        out = parts[0]
        for p in parts[1:]:
            out = out.union(p)
        return out

    def status(self) -> dict:
        rows = self.status_frame().orderBy("section", "label", "path").collect()
        pick = lambda s, label: [r.path for r in rows if (r.section, r.label) == (s, label)]
        return {
            "branch": self.branch,
            "staged": {"state": self._changed_parts(), "added": pick("staged", "added"), "modified": pick("staged", "modified"), "deleted": pick("staged", "deleted")},
            "worktree": {"modified": pick("worktree", "modified"), "deleted": pick("worktree", "deleted")},
            "untracked": pick("untracked", "untracked"),
        }

    def _changed_parts(self) -> list[str]:
        head = self.revision(self.branch)
        return [p for p in PARTS if head is None or self._bytes(None, p) != self._bytes(head, p)]

    def ensure_clean(self) -> None:
        """An error that names some of the files or state that differ from the last commit, if any do."""
        rows = self.status_frame().filter("section = 'worktree'").orderBy("label", "path").limit(SHOWN_ERRORS).collect()
        dirty = self._changed_parts() + [r.path for r in rows]
        if dirty:
            raise CheckoutError("uncommitted changes: " + ", ".join(dirty[:SHOWN_ERRORS]))

    # --- switching

    def checkout(self, branch: str) -> None:
        """Install a branch's files, or start a new branch here. Any failure puts everything back."""
        branch_name(branch)
        self.ensure_clean()
        here = self.revision(self.branch)
        if branch not in self.refs():
            self._set_ref(branch, here)
            self._set_head(branch)
            return
        target = self.revision(branch)
        current, wanted = self.entries_at(here), self.entries_at(target)
        lost = [r.sha1 for r in diff.missing_objects(wanted, self.objects()).limit(SHOWN_ERRORS).collect()]
        if lost:
            raise CheckoutError("objects are not in the store: " + ", ".join(lost))
        if self.root is not None:
            new = wanted.join(current, "path", "left_anti").select("path")
            present = with_checksum(new, self.root).filter("sha1 is not null")
            plan = diff.checkout_plan(current, wanted, present)
            clash = [r.path for r in plan.filter("action = 'conflict'").orderBy("path").limit(SHOWN_ERRORS).collect()]
            if clash:
                raise CheckoutError("files would be overwritten: " + ", ".join(clash))
            self._move(plan)
        self._copy_stage(target)
        self._set_head(branch)

    def _set_head(self, branch: str) -> None:
        with atomic_path(os.path.join(self.home, "HEAD")) as temp, open(temp, "w") as f:
            f.write(branch)

    def _copy_stage(self, commit: str) -> None:
        for part in PARTS:
            with atomic_path(os.path.join(self._folder(None), part)) as temp:
                shutil.copyfile(os.path.join(self._folder(commit), part), temp)

    def _move(self, plan: DataFrame) -> None:
        """Back up every file of a plan, then install; both on the executors. Undone as a whole on failure.

        The plan is written first, since it was made from the files that now move.
        """
        backup = os.path.join(self.home, "backup")
        shutil.rmtree(backup, ignore_errors=True)
        plan = checkpoint(plan.select("path", "action", "sha1"))
        root, safe = self.root, False
        try:
            each(plan, lambda path: _set_aside(contained(root, path), os.path.join(backup, path)))
            safe = True
            self._install(plan.filter("action = 'install'"))
        except Exception as e:
            each(plan, lambda path: _put_back(os.path.join(root, path), os.path.join(backup, path), safe))
            shutil.rmtree(backup, ignore_errors=True)
            raise CheckoutError(f"checkout failed and was undone: {e}") from e
        shutil.rmtree(backup, ignore_errors=True)
        for r in plan.filter("action != 'install'").select(F.regexp_extract("path", "(?s)^(.*)/[^/]*$", 1).alias("folder")).distinct().toLocalIterator():
            folder = os.path.join(self.root, r.folder)
            while folder.rstrip("/") != self.root and os.path.isdir(folder) and not os.listdir(folder):
                os.rmdir(folder)
                folder = os.path.dirname(folder)
        discard(plan)

    def add_worktree(self, branch: str, path: str | None = None) -> Dataset:
        """A directory beside this one, linked to the store, with a branch installed."""
        base = os.path.dirname(self.root or self.home)
        path = path or os.path.join(base, branch_name(branch).replace("/", "-"))
        if os.path.exists(path):
            raise DestinationExistsError(f"{path} is there already")
        if branch not in self.refs():
            self._set_ref(branch, self.revision(self.branch))
        home = os.path.join(path, ".hm")
        try:
            os.makedirs(os.path.join(home, "staged"))
            for name, text in (("store", self.store), ("HEAD", branch)):
                with open(os.path.join(home, name), "w") as f:
                    f.write(text)
            out = Dataset(self.spark, path)
            out._copy_stage(out.revision(branch))
            out._install(out.entries_at(None))
            return out
        except Exception:
            shutil.rmtree(path, ignore_errors=True)
            raise
