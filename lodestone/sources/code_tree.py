"""Code trees as a Spark data source: format `code_tree`, one row a regular file, listed and read in tasks.

Options: `roots` (JSON, source id to folder; or load(folder), whose id is the option `source_id`), `include` and `exclude`
(JSON, source id to paths), `content` (false leaves the contents out), `partitions` (64), `pushdown` (false).

Partitions are folders. Planning opens folders, the widest level first, until there are enough of them; a folder opened
there is listed without its subfolders and, if it has many files, by several tasks that share them by name. All other
folders are walked by the task that has them. With pushdown, filters on source_id, path, name, suffix, language and size
decide before a file is opened, and those on path also keep the walk out of folders. Spark 4.1 keeps what the last filters of a
loaded frame left, so such a frame is for one filter: to branch on it, load it twice. code_tree(where=...) does a load a filter.

Links are left out, as are names and folders of the corpus rules and excluded paths, which are never entered. Folders that cannot be listed have no rows;
contents that cannot be read are null. Names that are not UTF-8 are left out.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from collections import deque
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import datasource as D

from .. import schema as S

PLAIN = "source_id string, path string, name string, suffix string, language string, size bigint"
KINDS = {"source_id": pa.string(), "path": pa.string(), "name": pa.string(), "suffix": pa.string(), "language": pa.string(), "size": pa.int64(), "content": pa.binary()}
SUFFIX = re.compile(r"\A\.*[^.].*(\.[^.]+)\Z", re.S)
ROWS, BYTES = 1000, 16 << 20  # of a batch
SHARE = 5000  # files of one folder that a task reads

TESTS = {
    D.EqualTo: lambda v, x: v == x, D.EqualNullSafe: lambda v, x: v == x, D.In: lambda v, x: v in x, D.GreaterThan: lambda v, x: v > x, D.GreaterThanOrEqual: lambda v, x: v >= x,
    D.LessThan: lambda v, x: v < x, D.LessThanOrEqual: lambda v, x: v <= x, D.StringStartsWith: lambda v, x: v.startswith(x), D.StringEndsWith: lambda v, x: v.endswith(x), D.StringContains: lambda v, x: x in v,
}


def suffix(name: str) -> str:
    m = SUFFIX.match(name.lower())
    return m.group(1) if m else ""


def language(name: str) -> str | None:
    return S.NAME_LANGUAGE.get(name.lower()) or S.SUFFIX_LANGUAGE.get(suffix(name))


def holds(f: D.Filter, value) -> bool:
    """Whether a pushed filter is true of a value; of null only IsNull and a null-safe comparison are."""
    if isinstance(f, D.Not):
        return value is not None and not holds(f.child, value)
    if isinstance(f, D.IsNull):
        return value is None
    if isinstance(f, D.IsNotNull):
        return value is not None
    if isinstance(f, D.EqualNullSafe):
        return value == f.value
    return value is not None and f.value is not None and TESTS[type(f)](value, f.value)


def pushable(f: D.Filter) -> bool:
    """Comparisons of one plain column with a constant; what holds() says of them is what Spark says."""
    if isinstance(f, D.Not):
        return type(f.child) in TESTS and not isinstance(f.child, D.EqualNullSafe) and pushable(f.child) and None not in (f.child.value if isinstance(f.child, D.In) else (f.child.value,))
    return isinstance(f, (D.IsNull, D.IsNotNull, *TESTS)) and len(f.attribute) == 1 and f.attribute[0] in KINDS and f.attribute[0] != "content"


def column(f: D.Filter) -> str:
    return (f.child if isinstance(f, D.Not) else f).attribute[0]


def may_hold(folder: str, filters: list[D.Filter]) -> bool:
    """Whether files below a folder can pass the filters on path."""
    for f in filters:
        if column(f) == "path":
            wanted = [f.value] if isinstance(f, (D.EqualTo, D.StringStartsWith)) else f.value if isinstance(f, D.In) else None
            if wanted is not None and not any(w.startswith(folder + "/") or isinstance(f, D.StringStartsWith) and f"{folder}/".startswith(w) for w in wanted):
                return False
    return True


@dataclass
class Folder(D.InputPartition):
    """Files of a folder: with those below it (deep), or its own whose name falls into one of `parts`."""

    source: str
    path: str
    deep: bool
    part: int = 0
    parts: int = 1

    def __post_init__(self):
        super().__init__(None)


@dataclass
class Tree:
    """Roots, inclusions and exclusions by source id, and the pushed filters."""

    roots: dict[str, str]
    include: dict[str, list[str]]
    exclude: dict[str, list[str]]
    filters: list[D.Filter]

    def taken(self, source: str, path: str, is_dir: bool) -> bool:
        """Exclusions win; no inclusions take all; folders above an inclusion are entered."""
        below = lambda x: path == x or path.startswith(x + "/")
        include = self.include.get(source)
        return not any(map(below, self.exclude.get(source, ()))) and (not include or any(below(x) or is_dir and x.startswith(path + "/") for x in include))

    def entries(self, source: str, folder: str) -> Iterator[tuple[str, str, os.DirEntry, bool]]:
        """path, name, entry and whether it is a folder to be entered; files only by name and path filters."""
        try:
            found = os.scandir(os.path.join(self.roots[source], folder))
        except OSError:
            return
        with found:
            for e in found:
                path = f"{folder}/{e.name}" if folder else e.name
                try:
                    path.encode()
                    is_dir = e.is_dir(follow_symlinks=False)
                    if not is_dir and not e.is_file(follow_symlinks=False):
                        continue
                except (OSError, UnicodeEncodeError):
                    continue
                low = e.name.casefold()
                left_out = low in S.PREP_FILES or is_dir and (low in S.PREP_DIRECTORIES or not may_hold(path, self.filters))
                if not left_out and self.taken(source, path, is_dir):
                    yield path, e.name, e, is_dir

    def files(self, at: Folder) -> Iterator[tuple[str, str, str, str | None, int]]:
        """path, name, suffix, language and size of a partition's files that pass the filters."""
        pending = [at.path]
        while pending:
            for path, name, e, is_dir in self.entries(at.source, pending.pop()):
                if is_dir:
                    if at.deep:
                        pending.append(path)
                    continue
                if at.parts > 1 and zlib.crc32(name.encode()) % at.parts != at.part:
                    continue
                row = self.named(at.source, path)
                if row is None:
                    continue
                try:
                    size = e.stat(follow_symlinks=False).st_size
                except OSError:
                    continue
                if self.sized(size):
                    yield *row, size

    def named(self, source: str, path: str) -> tuple[str, str, str, str | None] | None:
        """path, name, suffix and language of a file, if the filters on all but size hold."""
        name = path.rsplit("/", 1)[-1]
        row = {"source_id": source, "path": path, "name": name, "suffix": suffix(name), "language": language(name)}
        return tuple(row.values())[1:] if all(holds(f, row[column(f)]) for f in self.filters if column(f) != "size") else None

    def sized(self, size: int) -> bool:
        return all(holds(f, size) for f in self.filters if column(f) == "size")


class TreeReader(D.DataSourceReader):
    def __init__(self, tree: Tree, target: int, content: bool):
        self.tree, self.target, self.content = tree, target, content

    def partitions(self) -> list[Folder]:
        """Folders of all sources; no more than `target` are opened here."""
        t = self.tree
        todo = deque((s, "") for s in t.roots if all(holds(f, s) for f in t.filters if column(f) == "source_id"))
        out: list[Folder] = []
        while todo and len(todo) + len(out) < self.target:
            source, folder = todo.popleft()
            files = 0
            for path, _, _, is_dir in t.entries(source, folder):
                if is_dir:
                    todo.append((source, path))
                else:
                    files += 1
            parts = -(-files // SHARE)
            out += [Folder(source, folder, False, i, parts) for i in range(parts)]
        return out + [Folder(s, f, True) for s, f in todo] or [Folder("", "", False)]

    def read(self, partition: Folder) -> Iterator[pa.RecordBatch]:
        names = [k for k in KINDS if self.content or k != "content"]
        rows, held = [], 0
        found = self.tree.files(partition) if partition.source in self.tree.roots else ()
        for path, *rest in found:
            row = [partition.source, path, *rest]
            if self.content:
                data = read(os.path.join(self.tree.roots[partition.source], path))
                row.append(data)
                held += len(data or b"")
            rows.append(row)
            if len(rows) >= ROWS or held >= BYTES:
                yield batch(rows, names)
                rows, held = [], 0
        if rows:
            yield batch(rows, names)


class PushingReader(TreeReader):
    def pushFilters(self, filters: list[D.Filter]) -> Iterable[D.Filter]:
        for f in filters:
            if pushable(f):
                self.tree.filters.append(f)
            else:
                yield f


def read(path: str) -> bytes | None:
    try:
        with open(path, "rb") as f:
            return f.read()
    except OSError:
        return None


def batch(rows: list[list], names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, KINDS[n]) for c, n in zip(zip(*rows, strict=True), names, strict=True)], names)


class CodeTree(D.DataSource):
    """The data source `code_tree`."""

    READERS: tuple[type, type] = (TreeReader, PushingReader)

    @classmethod
    def name(cls) -> str:
        return "code_tree"

    def _content(self) -> bool:
        return str(self.options.get("content", "true")).lower() != "false"

    def schema(self) -> str:
        return PLAIN + (", content binary" if self._content() else "")

    def reader(self, schema) -> TreeReader:
        o = self.options
        roots = json.loads(o["roots"]) if "roots" in o else {o.get("source_id", "input"): o["path"]} if "path" in o else None
        if roots is None:
            raise ValueError("code_tree needs a path or the option roots")
        tree = Tree(roots, json.loads(o.get("include", "{}")), json.loads(o.get("exclude", "{}")), [])
        kind = self.READERS[str(o.get("pushdown", "false")).lower() == "true"]
        return kind(tree, int(o.get("partitions", "64")), self._content())


def register(spark: SparkSession) -> SparkSession:
    """Makes the format known to the session and lets filters reach Python sources."""
    from .archives import TarFiles

    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(CodeTree)
    spark.dataSource.register(TarFiles)
    return spark


def code_tree(spark: SparkSession, roots: dict[str, str], include: dict[str, list[str]] | None = None, exclude: dict[str, list[str]] | None = None, where: Column | str | None = None, content: bool = True, partitions: int | None = None, format: str = "code_tree") -> DataFrame:
    """All sources' files as one table; where is pushed into the listing. format tar_files: roots are archives."""
    r = register(spark).read.format(format).option("roots", json.dumps({k: str(v) for k, v in roots.items()})).option("content", str(content).lower())
    r = r.option("include", json.dumps(include or {})).option("exclude", json.dumps(exclude or {})).option("pushdown", str(where is not None).lower())
    df = r.option("partitions", str(partitions or max(64, 4 * spark.sparkContext.defaultParallelism))).load()
    return df if where is None else df.where(where)
