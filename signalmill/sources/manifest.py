"""Which batches a store consists of: numbered manifests, each put in place by one rename.

A manifest lists every committed batch with the folder that holds its rows. A
writer puts its files into a folder of its own, reads the newest manifest, and
renames a finished successor into place; the rename fails where another writer
was faster, and the change is made anew on that one's manifest. A reader takes
the newest manifest once and reads the folders it lists, so it sees a batch, a
reset or a compaction whole or not at all. Folders that no manifest lists any
more stay for readers that have begun, until ``vacuum``.

The rename has to refuse an existing target in one step, as HDFS does.
"""

from __future__ import annotations

import json
import re
import time
import uuid
from collections.abc import Callable, Iterable
from dataclasses import asdict, dataclass, field

from pyspark.sql import SparkSession

FOLDER = "_manifest"
KEPT = 20  # older manifests are removed by ``vacuum``


@dataclass(frozen=True)
class Entry:
    """One batch of one table. ``path`` and ``index`` are relative to the root.

    A compacted batch stands for those it was made of: ``folded`` has, for names that end in a number, the largest number by
    what precedes it, and ``names`` has all other names.
    """

    table: str
    batch: str
    path: str
    index: str | None = None
    rows: int | None = None
    folded: dict[str, int] = field(default_factory=dict)
    names: tuple[str, ...] = ()

    def stands_for(self, batch: str) -> bool:
        stem, number = split_name(batch)
        return batch in self.names or number is not None and self.folded.get(stem, -1) >= number


def split_name(batch: str) -> tuple[str, int | None]:
    found = re.fullmatch(r"(.*-)(\d+)", batch)
    return (found[1], int(found[2])) if found else (batch, None)


def fold_names(entries: Iterable[Entry]) -> tuple[dict[str, int], tuple[str, ...]]:
    folded: dict[str, int] = {}
    names: set[str] = set()
    for e in entries:
        parts = [*e.folded.items()]
        stem, number = split_name(e.batch)
        if number is None:
            names.add(e.batch)
        else:
            parts.append((stem, number))
        names.update(e.names)
        for stem, number in parts:
            folded[stem] = max(folded.get(stem, -1), number)
    return folded, tuple(sorted(names))


@dataclass(frozen=True)
class Snapshot:
    version: int
    entries: tuple[Entry, ...]

    def of(self, table: str) -> list[Entry]:
        return [e for e in self.entries if e.table == table]


class Files:
    """The few file operations that a manifest needs, on whatever file system the path is of."""

    def __init__(self, spark: SparkSession, root: str):
        self.jvm = spark._jvm
        self.conf = spark._jsc.hadoopConfiguration()
        self.root = self.path(root)
        self.fs = self.root.getFileSystem(self.conf)

    def path(self, text: str):
        return self.jvm.org.apache.hadoop.fs.Path(text)

    def below(self, relative: str):
        return self.jvm.org.apache.hadoop.fs.Path(self.root, relative)

    def names(self, relative: str) -> list[tuple[str, int]]:
        """Names in a folder, with the time of their last change in milliseconds; none where it does not exist."""
        folder = self.below(relative)
        if not self.fs.exists(folder):
            return []
        return [(s.getPath().getName(), s.getModificationTime()) for s in self.fs.listStatus(folder)]

    def read(self, relative: str) -> str:
        stream = self.fs.open(self.below(relative))
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def put(self, relative: str, text: str) -> bool:
        """Writes a file that does not exist yet; False where it does."""
        hidden = self.below(f"{relative}.{uuid.uuid4().hex}.tmp")
        target = self.below(relative)
        stream = self.fs.create(hidden, True)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()
        context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(hidden.toUri(), self.conf)
        try:
            context.rename(hidden, target, self._no_options())
            return True
        except Exception as e:
            self.fs.delete(hidden, False)
            if "FileAlreadyExistsException" in str(e):
                return False
            raise

    def _no_options(self):
        """A rename without options refuses an existing target."""
        kind = getattr(self.jvm.org.apache.hadoop.fs, "Options$Rename")
        return self.jvm.java.lang.reflect.Array.newInstance(kind.NONE.getClass(), 0)

    def delete(self, relative: str) -> None:
        self.fs.delete(self.below(relative), True)


def _versions(files: Files) -> list[int]:
    return sorted(int(n[2:-5]) for n, _ in files.names(FOLDER) if re.fullmatch(r"v-\d+\.json", n))


def _name(version: int) -> str:
    return f"{FOLDER}/v-{version:012d}.json"


def snapshot(spark: SparkSession, root: str) -> Snapshot | None:
    """The newest manifest; None for a store that has none."""
    files = Files(spark, root)
    versions = _versions(files)
    if not versions:
        return None
    entries = json.loads(files.read(_name(versions[-1])))["entries"]
    return Snapshot(versions[-1], tuple(Entry(**{**e, "names": tuple(e.get("names", ()))}) for e in entries))


def commit(spark: SparkSession, root: str, change: Callable[[list[Entry]], list[Entry] | None],
           first: Callable[[], list[Entry]] = list) -> Snapshot:
    """Puts a changed list of batches in place. ``change`` may run several times; None leaves everything as it is.

    ``first`` gives the batches of a store without a manifest.
    """
    files = Files(spark, root)
    while True:
        before = snapshot(spark, root) or Snapshot(-1, tuple(first()))
        after = change(list(before.entries))
        if after is None:
            return before
        version = before.version + 1
        if files.put(_name(version), json.dumps({"entries": [asdict(e) for e in after]}, indent=0)):
            return Snapshot(version, tuple(after))


def vacuum(spark: SparkSession, root: str, tables: Iterable[str], older_than_s: float = 7 * 86400) -> list[str]:
    """Removes folders that the newest manifest does not list and that have not changed for a while, and old manifests.

    Whatever a reader has begun, or a writer has not committed yet, has to be younger than ``older_than_s``.
    """
    files, now = Files(spark, root), snapshot(spark, root)
    if now is None:
        return []
    kept = {p for e in now.entries for p in (e.path, e.index) if p}
    before, gone = (time.time() - older_than_s) * 1000, []
    for table in tables:
        for folder in (table, f"_index/{table}"):
            for name, changed in files.names(folder):
                path = f"{folder}/{name}"
                if path not in kept and not name.startswith("_") and changed <= before:
                    files.delete(path)
                    gone.append(path)
    for version in _versions(files)[:-KEPT]:
        files.delete(_name(version))
    return gone
