"""The versioned corpus store of a project.

    <root>/<project>/current.version           the live version, replaced by rename
    <root>/<project>/versions/vN/corpus        Parquet: word, range-partitioned and sorted
    <root>/<project>/versions/vN/usage_hits    Parquet: prefix, hits
    <root>/<project>/versions/vN/surfaced      Parquet: word
    <root>/<project>/versions/vN/manifest.json
    <root>/<project>/versions/staging/...      what was staged and not yet applied
    <root>/<project>/blacklist, sources.json, pinned_prefixes.txt

Data is written before the pointer, so a reader sees a whole version or the one
before.  Pointers and manifests are small and written by the driver; the root may be on
any file system that Spark can use and the executors share.
"""

from __future__ import annotations

import json
import re
import tempfile
import zipfile
from dataclasses import asdict, dataclass, field
from datetime import datetime, timezone
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiduct.operators import corpus as C
from lexiduct.operators import setops, usage
from lexiduct.sources.tree import Tree

STAGING = "staging"
DEFAULT_PROJECT = "default"


@dataclass
class Manifest:
    version: str
    source_file: str
    word_count: int
    parent_version: str = ""
    mode: str = "bootstrap"
    created_at: str = field(default_factory=lambda: datetime.now(timezone.utc).isoformat())


@dataclass
class ApplyResult:
    new_version: str
    previous_version: str
    word_count: int
    mode: str
    usage_migrated: bool
    diff: dict | None = None


def valid_project(name: str) -> bool:
    """1 to 48 bytes of lower-case letters, digits and inner hyphens."""
    return 1 <= len(name.encode()) <= 48 and all(c.islower() or c.isdigit() or c == "-" for c in name) and name[0] != "-" and name[-1] != "-"


class Store:
    def __init__(self, spark: SparkSession, root: str, project: str = DEFAULT_PROJECT):
        if not valid_project(project):
            raise ValueError(f"bad project name: {project!r}")
        self.spark, self.root, self.project, self.tree = spark, str(root).rstrip("/"), project, Tree(spark)
        self.home = f"{self.root}/{project}"
        self.tree.make(f"{self.home}/versions")

    # -- versions ------------------------------------------------------------------------

    def version_dir(self, version: str) -> str:
        return f"{self.home}/versions/{version}"

    def has_version(self, version: str) -> bool:
        return self.tree.exists(self.version_dir(version))

    def versions(self) -> list[str]:
        """vN names in numeric order."""
        names = [n for n in self.tree.names(f"{self.home}/versions") if re.fullmatch(r"v\d+", n)]
        return sorted(names, key=lambda v: int(v[1:]))

    def next_version(self) -> str:
        return f"v{max([0, *(int(v[1:]) for v in self.versions())]) + 1}"

    def current(self) -> str | None:
        p = f"{self.home}/current.version"
        return self.tree.read(p).strip() or None if self.tree.exists(p) else None

    def set_current(self, version: str) -> None:
        self.tree.write(f"{self.home}/current.version", version + "\n")

    def manifest(self, version: str) -> Manifest:
        return Manifest(**json.loads(self.tree.read(f"{self.version_dir(version)}/manifest.json")))

    def manifests(self) -> DataFrame:
        rows = [asdict(self.manifest(v)) for v in self.versions()]
        return self.spark.createDataFrame([tuple(r.values()) for r in rows], "version string, source_file string, word_count long, parent_version string, mode string, created_at string")

    def words(self, version: str | None = None) -> DataFrame:
        version = version or self.current()
        if version is None:
            raise FileNotFoundError("the project has no corpus")
        return self.spark.read.schema("word string").parquet(f"{self.version_dir(version)}/corpus")

    def word_count(self, version: str | None = None) -> int:
        """From the manifest, without a scan."""
        version = version or self.current()
        return self.manifest(version).word_count if version else 0

    def write_version(self, words: DataFrame, version: str, source: str, mode: str, parent: str = "", stride: int = 0) -> Manifest:
        """Writes a sorted corpus, if asked its skip index, then its manifest.  The count comes
        from the written files."""
        home = self.version_dir(version)
        self.tree.delete(home)
        C.ordered(words.select("word")).write.parquet(f"{home}/corpus")
        written = self.spark.read.schema("word string").parquet(f"{home}/corpus")
        if stride:
            C.skip_index(written, stride).withColumn("stride", F.lit(stride)).write.parquet(f"{home}/skip_index")
        m = Manifest(version, source, written.count(), parent, mode)
        self.tree.write(f"{home}/manifest.json", json.dumps(asdict(m), indent=2))
        return m

    def ensure(self) -> str:
        """A fresh project gets an empty v1."""
        if self.current() is None:
            self.write_version(self.spark.createDataFrame([], "word string"), "v1", "", "bootstrap")
            self.set_current("v1")
        return self.current()

    def skip_index(self, version: str | None = None) -> DataFrame:
        """word, offset, stride: the anchors stored beside a version."""
        path = f"{self.version_dir(version or self.current())}/skip_index"
        if not self.tree.exists(path):
            raise FileNotFoundError(f"there is no {path}")
        return self.spark.read.schema("word string, offset long, stride int").parquet(path)

    def export_text(self, to: str, version: str | None = None) -> None:
        """The corpus as text files, a word a line, which read in the order of their names
        give it sorted."""
        C.ordered(self.words(version)).select("word").write.mode("overwrite").text(to, lineSep="\n")

    def bootstrap(self, values: DataFrame, source: str = "", version: str | None = None, parent: str | None = None, mode: str = "bootstrap", stride: int = 0) -> Manifest:
        """Builds a corpus of raw values as a new version; refuses to overwrite one, and
        makes it current only where nothing is.  Without a version the next one is taken,
        and its parent, unless given, is the current one."""
        parent = parent if parent is not None else "" if version else self.current() or ""
        version = version or self.next_version()
        if self.has_version(version):
            raise FileExistsError(f"{version} exists")
        m = self.write_version(C.build_corpus(values), version, source, mode, parent, stride)
        if self.current() is None:
            self.set_current(version)
        return m

    # -- staging and applying ------------------------------------------------------------

    def stage(self, values: DataFrame, source: str = "", blacklist: DataFrame | None = None) -> Manifest:
        m = self.write_version(C.build_corpus(values, blacklist), STAGING, source, "stage")
        return m

    def staged(self) -> DataFrame:
        if not self.tree.exists(f"{self.version_dir(STAGING)}/manifest.json"):
            raise FileNotFoundError("nothing is staged")
        return self.words(STAGING)

    def delete_staging(self) -> None:
        self.staged()
        self.tree.delete(self.version_dir(STAGING))

    def diff(self) -> DataFrame:
        return setops.diff(self.words(), self.staged())

    def apply(self, mode: str = "replace", depth: int = 3, max_hits: int = 0, migrate_usage: bool = True) -> ApplyResult:
        """replace, merge or prune into a new version, which becomes current last."""
        previous, new = self.current(), self.next_version()
        report = None
        if mode in ("replace", "", None):
            mode, words, source = "replace", self.staged(), self.manifest(STAGING).source_file
        elif mode == "merge":
            words, source = setops.merge(self.words(), self.staged()), self.manifest(STAGING).source_file
        elif mode == "prune":
            hits = self.usage_hits()
            if hits is None or setops.live_buckets(hits, max_hits).isEmpty():
                raise ValueError("no live usage: a prune would drop every word")
            words, source = setops.prune(self.words(), hits, depth, max_hits), self.manifest(previous).source_file
        else:
            raise ValueError(f"unknown mode: {mode}")
        m = self.write_version(words, new, source, mode, previous or "")
        if mode == "prune":
            report = setops.diff(self.words(previous), self.words(new)).first().asDict()
        moved = False
        if migrate_usage and previous and self.usage_hits(previous) is not None:
            self.write_usage(self.usage_hits(previous), usage.migrate(self.surfaced(previous), self.words(new)), new)
            moved = True
        self.set_current(new)
        if mode != "prune":
            self.tree.delete(self.version_dir(STAGING))
        return ApplyResult(new, previous or "", m.word_count, mode, moved, report)

    def rollback(self, version: str) -> tuple[str, str]:
        """Makes an older version current; returns (previous, current)."""
        if not all(self.tree.exists(f"{self.version_dir(version)}/{x}") for x in ("corpus", "manifest.json")):
            raise FileNotFoundError(f"{version} has no corpus")
        previous = self.current() or ""
        self.set_current(version)
        return previous, version

    def delete_version(self, version: str) -> None:
        if not version or any(c in version for c in "/\\.") or version == STAGING or version == self.current():
            raise ValueError(f"can't delete {version!r}")
        if not self.has_version(version):
            raise FileNotFoundError(version)
        self.tree.delete(self.version_dir(version))

    def retain(self, keep: int = 3) -> list[str]:
        """Deletes all but the newest versions, never the current one; returns those deleted."""
        old = [v for v in self.versions()[: -keep or None] if v != self.current()]
        for v in old:
            self.tree.delete(self.version_dir(v))
        return old

    # -- usage, blacklist, sources -------------------------------------------------------

    def write_usage(self, hits: DataFrame, seen: DataFrame, version: str | None = None) -> None:
        home = self.version_dir(version or self.current())
        for name, df in (("usage_hits", hits.select("prefix", "hits")), ("surfaced", seen.select("word"))):
            self._swap_in(df, f"{home}/{name}")

    def _swap_in(self, df: DataFrame, path: str) -> None:
        """Writes a table beside another one, which df may read, and puts it in its place."""
        df.write.mode("overwrite").parquet(f"{path}.new")
        self.tree.delete(path)
        self.tree.rename(f"{path}.new", path)

    def reset_usage(self) -> None:
        self.write_usage(self.spark.createDataFrame([], "prefix string, hits long"), self.spark.createDataFrame([], "word string"))

    def usage_hits(self, version: str | None = None) -> DataFrame | None:
        p = f"{self.version_dir(version or self.current() or 'v0')}/usage_hits"
        return self.spark.read.schema("prefix string, hits long").parquet(p) if self.tree.exists(p) else None

    def surfaced(self, version: str | None = None) -> DataFrame:
        return self.spark.read.schema("word string").parquet(f"{self.version_dir(version or self.current())}/surfaced")

    def blacklist(self) -> DataFrame:
        p = f"{self.home}/blacklist"
        return self.spark.read.schema("word string").parquet(p) if self.tree.exists(p) else self.spark.createDataFrame([], "word string")

    def add_to_blacklist(self, words: list[str], rebuild: bool = True) -> dict:
        """Records words and, if asked, rebuilds the corpus without them as a new version."""
        new = self.spark.createDataFrame([(w,) for w in words], "word string")
        listed, counts = setops.blacklist_add(self.blacklist(), new)
        out = counts.first().asDict()
        self._swap_in(listed, f"{self.home}/blacklist")
        if rebuild and self.current():
            previous, version = self.current(), self.next_version()
            before = self.word_count(previous)
            m = self.write_version(setops.without(self.words(), self.blacklist()), version, self.manifest(previous).source_file, "blacklist", previous)
            if self.usage_hits(previous) is not None:
                self.write_usage(self.usage_hits(previous), self.surfaced(previous), version)
            self.set_current(version)
            out |= {"version": version, "kept": m.word_count, "removed": before - m.word_count}
        return out

    def sources(self) -> list[dict]:
        """The import history, newest first."""
        p = f"{self.home}/sources.json"
        return sorted(json.loads(self.tree.read(p)) if self.tree.exists(p) else [], key=lambda r: r["imported_at"], reverse=True)

    def add_source(self, **row) -> None:
        row.setdefault("imported_at", datetime.now(timezone.utc).isoformat())
        self.tree.write(f"{self.home}/sources.json", json.dumps([*reversed(self.sources()), row], indent=2))

    def ingest_csv(self, path: str, column: str, mode: str = "merge", keep: int = 3) -> ApplyResult:
        """CSV column -> stage -> apply -> retention, with an entry in the import history."""
        from lexiduct.sources import readers

        blocked = self.blacklist()
        cells = readers.csv_terms(self.spark, path, column, blocked)
        n = cells.count()
        self.ensure()
        self.stage(cells, Path(path).name, blocked)
        out = self.apply(mode)
        self.retain(keep)
        self.add_source(name=Path(path).name, column=column, mode=out.mode, values_read=n, corpus_words=out.word_count, version=out.new_version)
        return out

    # -- backup --------------------------------------------------------------------------

    def backup(self, to: str) -> int:
        """Zips the project without staging and unfinished files into a local file; returns
        the files' number."""
        n = 0
        with zipfile.ZipFile(to, "w", zipfile.ZIP_DEFLATED) as z, tempfile.TemporaryDirectory() as local:
            for name in self.tree.files(self.home):
                parts = name.split("/")
                if STAGING not in parts and not any(x.endswith((".tmp", ".new")) or x == ".tmp" for x in parts):
                    self.tree.fetch(f"{self.home}/{name}", f"{local}/one")
                    z.write(f"{local}/one", name)
                    n += 1
        return n

    def restore(self, archive: str) -> str:
        """Replaces the project by a backup.  Names that leave the folder are refused, and a
        backup without a readable current version, or one that can't take its place, leaves
        all as it was."""
        new, old = f"{self.home}.restore", f"{self.home}.before"
        if self.tree.exists(old) and not self.tree.exists(self.home):
            self.tree.rename(old, self.home)  # an earlier restore was cut off between its renames
        for p in (new, old):
            self.tree.delete(p)
        try:
            with zipfile.ZipFile(archive) as z, tempfile.TemporaryDirectory() as local:
                for name in z.namelist():
                    if not (Path(local) / name).resolve().is_relative_to(Path(local).resolve()):
                        raise ValueError(f"unsafe name in the archive: {name}")
                z.extractall(f"{local}/x")
                self.tree.put(f"{local}/x", new)
            at = f"{new}/current.version"
            version = self.tree.read(at).strip() if self.tree.exists(at) else ""
            if not re.fullmatch(r"v\d+", version) or not self.tree.exists(f"{new}/versions/{version}/corpus"):
                raise ValueError("the archive has no current version")
        except BaseException:
            self.tree.delete(new)
            raise
        self.tree.rename(self.home, old)
        try:
            self.tree.rename(new, self.home)
            self.words(version).limit(1).collect()  # it can be read
        except BaseException:
            self.tree.delete(self.home)
            self.tree.rename(old, self.home)
            self.tree.delete(new)
            raise
        self.tree.delete(old)
        self.spark.catalog.refreshByPath(self.home)
        return version


class Projects:
    """The projects under one root; the default one can't be deleted."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root, self.tree = spark, str(root).rstrip("/"), Tree(spark)
        self.create(DEFAULT_PROJECT)

    def create(self, name: str, exists_ok: bool = True) -> Store:
        """A project's store; unless exists_ok, one that is there already raises."""
        if not exists_ok and valid_project(name) and self.tree.exists(f"{self.root}/{name}"):
            raise FileExistsError(f"the project {name!r} exists")
        return Store(self.spark, self.root, name)

    def get(self, name: str) -> Store:
        if name not in self.names():
            raise FileNotFoundError(f"no project {name!r}")
        return Store(self.spark, self.root, name)

    def names(self) -> list[str]:
        return [n for n in self.tree.names(self.root) if valid_project(n)]

    def delete(self, name: str) -> None:
        if name == DEFAULT_PROJECT or name not in self.names():
            raise ValueError(f"can't delete {name!r}")
        self.tree.delete(f"{self.root}/{name}")
