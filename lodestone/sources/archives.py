"""Members of tar archives as a Spark data source: format `tar_files`, read as a stream in tasks, nothing unpacked.

Rows, options and filters are those of code_tree; the roots are archives (any store that Arrow reads), each a task. Members
are judged at their headers: links, members that lead outside, left-out names and folders, excluded paths and members
that fail a pushed filter are passed over, in an archive that is not compressed without reading their bytes. A task
holds one batch of contents. An archive has one top folder, which paths leave out; another one is an error. A path that occurs twice
gives two rows.
"""

from __future__ import annotations

import os
import tarfile
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as fs

from .. import schema as S
from .code_tree import BYTES, KINDS, ROWS, CodeTree, Folder, PushingReader, TreeReader, batch, holds, column


def opened(uri: str) -> pa.NativeFile:
    store, path = fs.FileSystem.from_uri(uri if "://" in uri else os.path.abspath(uri))
    return store.open_input_file(path)


def members(file, name: str) -> Iterator[tuple[str, tarfile.TarInfo, tarfile.TarFile]]:
    """path without the top folder, header and archive of the regular files; their contents must be read before the next."""
    packed = name.lower().endswith((".gz", ".tgz", ".bz2", ".xz"))
    top = None
    with tarfile.open(fileobj=file, mode="r|*" if packed else "r:") as tar:
        for m in tar:
            tar.members = []  # headers are not kept
            root, _, path = m.name.partition("/")
            if root not in ("", ".", "pax_global_header"):
                if top not in (None, root):
                    raise ValueError(f"{name}: one top folder is expected, found {top} and {root}")
                top = root
            if m.isfile() and path and ".." not in path.split("/"):
                yield path, m, tar


class TarReader(TreeReader):
    def partitions(self) -> list[Folder]:
        t = self.tree
        return [Folder(s, "", True) for s in t.roots if all(holds(f, s) for f in t.filters if column(f) == "source_id")] or [Folder("", "", False)]

    def read(self, partition: Folder) -> Iterator[pa.RecordBatch]:
        t, source = self.tree, partition.source
        if source not in t.roots:
            return
        names = [k for k in KINDS if self.content or k != "content"]
        rows, held = [], 0
        with opened(t.roots[source]) as file:
            for path, m, tar in members(file, t.roots[source]):
                *folders, name = path.casefold().split("/")
                if name in S.PREP_FILES or any(x in S.PREP_DIRECTORIES or x in S.PREP_FILES for x in folders) or not t.taken(source, path, False):
                    continue
                row = t.named(source, path)
                if row is None or not t.sized(m.size):
                    continue
                row = [source, *row, m.size]
                if self.content:
                    with tar.extractfile(m) as f:
                        row.append(f.read())
                    held += m.size
                rows.append(row)
                if len(rows) >= ROWS or held >= BYTES:
                    yield batch(rows, names)
                    rows, held = [], 0
        if rows:
            yield batch(rows, names)


class PushingTarReader(TarReader, PushingReader):
    pass


class TarFiles(CodeTree):
    """The data source `tar_files`."""

    READERS = (TarReader, PushingTarReader)

    @classmethod
    def name(cls) -> str:
        return "tar_files"
