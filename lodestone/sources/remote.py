"""A hosted repository through the contents interface of its host. The transport is a function, so nothing here needs a network."""

from __future__ import annotations

import json
import os
import re
from collections.abc import Callable, Mapping
from dataclasses import dataclass, field, replace
from urllib.parse import quote, urlencode, urlsplit

from .tree import AccessError, clean_path

#: (url, headers, timeout in seconds) -> (status, body); raises OSError where the host cannot be reached.
Transport = Callable[[str, Mapping[str, str], float], tuple[int, bytes]]
# The interface's address, media types and version.
API = "https://api.github.com"
JSON_TYPE, RAW_TYPE, VERSION = "application/vnd.github+json", "application/vnd.github.raw+json", "2022-11-28"
TOKENS = ("GITHUB_TOKEN", "GH_TOKEN")
TIMEOUT = 30.0
FILES = ("file", "symlink", "submodule")

SCP = re.compile(r"(?:[^/:@]*@)?([^/:@]+):([^/]+)/([^/]+)")


def parse_address(address: str, bare: bool = True) -> tuple[str, str]:
    """Owner and name of a repository: an https or ssh address, the scp form, or (bare) owner/name.

    The error's kind is invalid_repository, its message says what is wrong."""
    text = address.strip().rstrip("/")

    def bad(why: str) -> AccessError:
        return AccessError("invalid_repository", f"{address!r}: {why}")

    if not text:
        raise bad("empty")
    if "://" in text:
        u = urlsplit(text)
        if u.scheme.lower() not in ("http", "https", "ssh"):
            raise bad(f"scheme {u.scheme}")
        if (u.hostname or "").lower() != "github.com":
            raise bad("another host than github.com")
        parts = [p for p in u.path.split("/") if p]
    elif m := SCP.fullmatch(text):
        if m[1].lower() != "github.com":
            raise bad("another host than github.com")
        parts = [m[2], m[3]]
    elif bare:
        parts = text.split("/")
    else:
        raise bad("an address is expected, not owner/name")
    if len(parts) != 2:
        raise bad("owner and name are expected")
    return segments(*parts)


def segments(owner: str, name: str) -> tuple[str, str]:
    owner, name = owner.strip(), name.strip()
    name = name[:-4] if name.lower().endswith(".git") else name
    for s in (owner, name):
        if s in ("", ".", "..") or "/" in s:
            raise AccessError("invalid_repository", f"{owner}/{name}: owner and name must be path segments")
    return owner, name


def http(url: str, headers: Mapping[str, str], timeout: float) -> tuple[int, bytes]:
    """The standard library's client as a transport."""
    from urllib.error import HTTPError
    from urllib.request import Request, urlopen

    try:
        with urlopen(Request(url, headers=dict(headers)), timeout=timeout) as r:
            return r.status, r.read()
    except HTTPError as e:
        return e.code, e.read()


def environment_token(env: Mapping[str, str] | None = None) -> str | None:
    env = os.environ if env is None else env
    return next((env[k] for k in TOKENS if k in env), None)


@dataclass(frozen=True)
class RemoteAccessor:
    """list_dir and read_file of one repository at a ref (its default branch without one)."""

    owner: str
    name: str
    ref: str | None = None
    token: str | None = field(default_factory=environment_token, repr=False)
    api_url: str = API
    timeout: float = TIMEOUT
    transport: Transport = http

    def __post_init__(self):
        owner, name = segments(self.owner, self.name)
        object.__setattr__(self, "owner", owner)
        object.__setattr__(self, "name", name)
        if self.ref is not None and not self.ref:
            raise AccessError("invalid_ref", "a ref must not be empty")
        if self.timeout <= 0:
            raise AccessError("invalid_path", "the timeout must be positive")
        u = urlsplit(self.api_url)
        if not u.scheme or not u.netloc:
            raise AccessError("invalid_path", f"{self.api_url}: no base address")
        object.__setattr__(self, "api_url", f"{u.scheme}://{u.netloc}{u.path.rstrip('/')}")

    @classmethod
    def of(cls, address: str, **settings) -> RemoteAccessor:
        return cls(*parse_address(address), **settings)

    def changed(self, **settings) -> RemoteAccessor:
        """A copy with another ref, token (None: none), api_url, timeout or transport."""
        return replace(self, **settings)

    def contents_url(self, path: str = "") -> str:
        parts = ["repos", self.owner, self.name, "contents", *(path.split("/") if path else [])]
        return "/".join([self.api_url, *(quote(p, safe="") for p in parts)])

    def request(self, path: str, accept: str) -> bytes:
        headers = {"accept": accept, "user-agent": "lodestone", "x-github-api-version": VERSION} | ({"authorization": f"Bearer {self.token}"} if self.token else {})
        url = self.contents_url(path) + (f"?{urlencode({'ref': self.ref})}" if self.ref else "")
        try:
            status, body = self.transport(url, headers, self.timeout)
        except OSError as e:
            raise AccessError("http", str(e)) from e
        if 200 <= status < 300:
            return body
        try:
            message = json.loads(body)["message"]
        except (ValueError, KeyError, TypeError):
            message = None
        message = message if isinstance(message, str) else f"status {status}"
        if status == 404:
            raise AccessError("not_found", path or ".")
        if status in (401, 403):
            raise AccessError("permission_denied", f"{self.owner}/{self.name}: {message}")
        raise AccessError("upstream", message, status)

    def metadata(self, path: str) -> list | dict:
        try:
            data = json.loads(self.request(path, JSON_TYPE))
        except ValueError as e:
            raise AccessError("metadata", str(e)) from e
        if not isinstance(data, list | dict):
            raise AccessError("metadata", "neither a listing nor an entry")
        return data

    def list_dir(self, path: str) -> list[dict]:
        at = clean_path(path)
        data = self.metadata(at)
        if isinstance(data, dict):
            raise AccessError("invalid_path", f"{at or '.'}: " + ("not a directory" if data.get("type") in FILES else "unexpected metadata of a directory"))
        out = []
        for e in data:
            if isinstance(e, dict) and isinstance(e.get("name"), str):
                size = e.get("size")
                if e.get("type") == "dir":
                    out.append({"name": e["name"], "entry_type": "dir", "size": None})
                elif e.get("type") in FILES:
                    out.append({"name": e["name"], "entry_type": "file", "size": size if type(size) is int and size >= 0 else None})
        return sorted(out, key=lambda e: e["name"])

    def read_file(self, path: str, offset: int | None = None, limit: int | None = None) -> str:
        at = clean_path(path)
        data = self.metadata(at)
        if isinstance(data, list) or data.get("type") == "dir":
            raise AccessError("invalid_path", f"{at or '.'}: a directory")
        if data.get("type") not in FILES:
            raise AccessError("invalid_path", f"{at}: not a regular file")
        try:
            return self.request(at, RAW_TYPE).decode("utf-8")[offset or 0 :][:limit]
        except UnicodeDecodeError as e:
            raise AccessError("utf8", at) from e
