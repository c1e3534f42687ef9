"""Accessors of repositories, and a plain walk over one. Tables of trees: code_tree (checkouts) and frontier (accessors)."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator
from pathlib import Path
from typing import Protocol


class AccessError(Exception):
    """kind: invalid_path, invalid_repository, invalid_ref, not_found, permission_denied, io, utf8, http, metadata, or
    upstream, which has the host's status."""

    def __init__(self, kind: str, message: str, status: int | None = None):
        super().__init__(message)
        self.kind, self.status = kind, status


class Accessor(Protocol):
    def list_dir(self, path: str) -> list[dict]: ...
    def read_file(self, path: str, offset: int | None = None, limit: int | None = None) -> str: ...


def clean_path(path: str) -> str:
    parts = [p for p in path.split("/") if p not in ("", ".")]
    if path.startswith("/") or ".." in parts:
        raise AccessError("invalid_path", f"{path}: relative paths inside the repository only")
    return "/".join(parts)


class MapAccessor:
    """A repository in memory: path -> text."""

    def __init__(self, files: dict[str, str]):
        self.files = {clean_path(k): v for k, v in files.items()}

    def list_dir(self, path: str) -> list[dict]:
        at = clean_path(path)
        head = at + "/" if at else ""
        found: dict[str, dict] = {}
        for k, v in self.files.items():
            if k.startswith(head):
                name, _, below = k[len(head) :].partition("/")
                found[name] = {"name": name, "entry_type": "dir", "size": None} if below else {"name": name, "entry_type": "file", "size": len(v.encode())}
        if not found:
            raise AccessError("not_found", path)
        return [found[n] for n in sorted(found)]

    def read_file(self, path: str, offset: int | None = None, limit: int | None = None) -> str:
        text = self.files.get(clean_path(path))
        if text is None:
            raise AccessError("not_found", path)
        return text[offset or 0 :][:limit]


class DirectoryAccessor:
    """A directory tree whose links may not lead out of it; broken and escaping links are not listed."""

    def __init__(self, root: str | Path):
        self.root = Path(root).resolve(strict=True)

    def resolve(self, path: str) -> Path:
        try:
            p = (self.root / clean_path(path)).resolve(strict=True)
        except FileNotFoundError as e:
            raise AccessError("not_found", path) from e
        if p != self.root and self.root not in p.parents:
            raise AccessError("invalid_path", f"{path}: outside the repository")
        return p

    def list_dir(self, path: str) -> list[dict]:
        at, out = self.resolve(path), []
        try:
            names = sorted(os.listdir(at))
        except PermissionError as e:
            raise AccessError("permission_denied", path) from e
        for n in names:
            try:
                p = self.resolve(f"{clean_path(path) or '.'}/{n}")
            except AccessError:
                continue
            if p.is_dir():
                out.append({"name": n, "entry_type": "dir", "size": None})
            elif p.is_file():
                out.append({"name": n, "entry_type": "file", "size": p.stat().st_size})
        return out

    def read_file(self, path: str, offset: int | None = None, limit: int | None = None) -> str:
        p = self.resolve(path)
        try:
            if limit is None:
                return p.read_bytes().decode("utf-8")[offset or 0 :]
            with p.open(encoding="utf-8", newline="") as f:  # reads no more than it returns
                return f.read((offset or 0) + limit)[offset or 0 :]
        except UnicodeDecodeError as e:
            raise AccessError("utf8", path) from e
        except OSError as e:
            raise AccessError("io", str(e)) from e


def real_path(accessor: Accessor, path: str) -> str:
    """What a folder is, whatever links lead to it."""
    return str(accessor.resolve(path)) if isinstance(accessor, DirectoryAccessor) else path


def walk(accessor: Accessor, prune: Callable[[str], bool] | None = None) -> Iterator[tuple[str, bool, int | None, bool]]:
    """path, is_dir, size, errored of a tree, one level after the other; frontier.listed() in plain Python, for trees that
    one process may list."""
    level, seen = [(".", real_path(accessor, "."))], set()
    rows: dict[str, tuple[bool, int | None, bool]] = {}
    while level:
        below: dict[str, str] = {}
        seen.update(real for _, real in level)
        for at, _ in level:
            try:
                found = accessor.list_dir(at)
            except AccessError:
                if at == ".":
                    raise
                rows[at] = (True, None, True)
                continue
            for e in found:
                path, is_dir = e["name"] if at == "." else f"{at}/{e['name']}", e["entry_type"] == "dir"
                rows[path] = (is_dir, e["size"], False)
                real = real_path(accessor, path) if is_dir and not (prune and prune(e["name"])) else None
                if real is not None:
                    below[real] = min(path, below.get(real, path))
        level = sorted((path, real) for real, path in below.items() if real not in seen)
    yield from ((path, *v) for path, v in rows.items())
