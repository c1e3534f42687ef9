"""Getting a source's files to a folder: git checkouts, archives at a revision, and pinning of revisions.

Commands run through an injected function, archives come from an injected download, so all of it works and is
tested without a network."""

from __future__ import annotations

import os
import shutil
import subprocess
import tarfile
import tempfile
from collections.abc import Callable
from pathlib import Path

from ..functions.paths import member_kept, revision
from .manifest import ManifestError
from .remote import parse_address
from .tree import AccessError

#: (arguments, working folder) -> standard output; raises for a failed command.
Run = Callable[[list[str], Path | None], str]
MARKER = ".lodestone-revision"


def command(arguments: list[str], folder: Path | None = None) -> str:
    return subprocess.run(arguments, cwd=folder, check=True, capture_output=True, text=True).stdout


def checkout(source: dict, cache: Path, refresh: bool = False, run: Run = command) -> Path:
    """A git checkout of a source at its pinned revision: blobless, shallow, sparse where include_paths are given.

    A checkout that is there is used again unless refresh; a revision that it lacks is fetched; HEAD is verified."""
    target, include, pinned = Path(cache) / source["id"], source.get("include_paths"), source.get("revision")
    if refresh and target.exists():
        shutil.rmtree(target)
    git = lambda *a: run(["git", *a], target)
    if not target.exists():
        target.parent.mkdir(parents=True, exist_ok=True)
        run(["git", "clone", "--filter=blob:none", "--depth", "1", "--no-checkout", source["url"], str(target)], None)
        if include:
            git("sparse-checkout", "set", "--cone", *include)
    if pinned:
        try:
            git("checkout", "--detach", pinned)
        except subprocess.CalledProcessError:
            git("fetch", "--filter=blob:none", "--depth", "1", "origin", pinned)
            git("checkout", "--detach", pinned)
        if (head := git("rev-parse", "HEAD").strip()) != pinned:
            raise ManifestError(f"source {source['id']}: HEAD is {head}, not {pinned}")
    else:
        git("checkout")
    return target


def unpack(archive: Path, target: Path, include: list[str] | None = None, exclude: list[str] | None = None) -> Path:
    """The wanted members of an archive with one top folder, without that folder, as target; the old one is replaced
    at once when all is there. Links and members that lead outside are left out."""
    target = Path(target)
    target.parent.mkdir(parents=True, exist_ok=True)
    fresh = Path(tempfile.mkdtemp(prefix=f".{target.name}-", dir=target.parent))
    try:
        with tarfile.open(archive) as tar:
            roots = {m.name.split("/")[0] for m in tar if m.name.split("/")[0] not in ("", ".")}
            if len(roots) != 1:
                raise ManifestError(f"{archive}: one top folder is expected, found {len(roots)}")
            for m in tar.getmembers():
                path = m.name.partition("/")[2].rstrip("/")
                if path and (m.isfile() or m.isdir()) and ".." not in path.split("/") and member_kept(path, include or [], exclude or []):
                    at = fresh / path
                    if m.isdir():
                        at.mkdir(parents=True, exist_ok=True)
                    else:
                        at.parent.mkdir(parents=True, exist_ok=True)
                        with tar.extractfile(m) as f, at.open("wb") as g:
                            shutil.copyfileobj(f, g)
        if target.exists():
            shutil.rmtree(target)
        os.replace(fresh, target)
        return target
    except BaseException:
        shutil.rmtree(fresh, ignore_errors=True)
        raise


def archive(source: dict, cache: Path, download: Callable[[str, str, str, Path], None], refresh: bool = False) -> Path:
    """A hosted repository's files from its archive at the pinned revision, kept until the revision changes.

    download(owner, name, revision, file) writes the archive."""
    pinned = source.get("revision")
    if not pinned:
        raise ManifestError(f"source {source['id']}: an archive needs a revision")
    target = Path(cache) / source["id"]
    marker = target / MARKER
    if not refresh and marker.is_file() and marker.read_text() == pinned:
        return target
    owner, name = parse_address(source["url"])
    with tempfile.TemporaryDirectory() as d:
        file = Path(d) / "archive.tar.gz"
        download(owner, name, pinned, file)
        unpack(file, target, source.get("include_paths"), source.get("exclude_paths"))
    marker.write_text(pinned)
    return target


def fetched(source: dict, cache: Path, download: Callable | None = None, refresh: bool = False, run: Run = command) -> Path:
    """The folder of a source: samples are a path, a hosted repository comes as an archive, anything else by git."""
    if source.get("kind") == "samples":
        return Path(source["path"])
    if download is not None:
        try:
            parse_address(source["url"], bare=False)
        except AccessError:
            pass
        else:
            return archive(source, cache, download, refresh)
    return checkout(source, cache, refresh, run)


def pinned(url: str, ref: str | None = None, before: str | None = None, run: Run = command) -> str:
    """The revision of a remote's ref (its HEAD without one), or of the last first-parent commit before a date."""
    if before is None:
        return revision(run(["git", "ls-remote", url, ref or "HEAD"], None))
    with tempfile.TemporaryDirectory() as d:
        run(["git", "clone", "--bare", "--filter=blob:none", *(["--branch", ref] if ref else []), url, d], None)
        found = run(["git", "rev-list", "-1", "--first-parent", f"--before={before}", ref or "HEAD"], Path(d))
    return revision(found)
