"""Paths, repository addresses and source ids as columns."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import schema as S
from .text import col


def literal_map(d: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for kv in d.items() for x in kv])


def file_name(path: Column | str) -> Column:
    return F.element_at(F.split(col(path), "/"), -1)


def suffix(name: Column) -> Column:
    """The last suffix with its dot, '' for none; a leading dot starts no suffix and a final dot ends none."""
    return F.regexp_extract(name, r"(?s)\A\.*[^.].*(\.[^.]+)\z", 1)


def language_of(path: Column | str) -> Column:
    name = F.lower(file_name(path))
    return F.coalesce(F.try_element_at(literal_map(S.NAME_LANGUAGE), name), F.try_element_at(literal_map(S.SUFFIX_LANGUAGE), suffix(name)))


def under(path: Column, prefixes: Column) -> Column:
    """Whether a path is one of the prefixes or below one, by whole components."""
    return F.exists(prefixes, lambda x: (path == x) | F.startswith(path, F.concat(x, F.lit("/"))))


def member_included(path: Column, include: Column, exclude: Column) -> Column:
    """Exclusions win; no inclusions take all; directories above an inclusion stay."""
    above = F.exists(include, lambda x: F.startswith(x, F.concat(path, F.lit("/"))))
    taken = F.coalesce(F.size(include) < 1, F.lit(True)) | under(path, include) | above
    return taken & ~F.coalesce(under(path, exclude), F.lit(False))


def member_kept(path: str, include: list[str], exclude: list[str]) -> bool:
    """member_included() of one path outside Spark."""
    below = lambda x: path == x or path.startswith(x + "/")
    return not any(map(below, exclude)) and (not include or any(below(x) or x.startswith(path + "/") for x in include))


def prep_selected(path: Column | str) -> Column:
    """A known language and no left-out file or directory name."""
    parts = F.split(F.lower(col(path)), "/")
    dirs = F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0)))
    names = F.array(*map(F.lit, S.PREP_FILES))
    return language_of(path).isNotNull() & ~F.arrays_overlap(parts, names) & ~F.arrays_overlap(dirs, F.array(*map(F.lit, S.PREP_DIRECTORIES)))


def directory_pruned(name: Column) -> Column:
    return F.startswith(name, F.lit(".")) | name.isin(*S.SCAN_DIRECTORIES)


def scan_reason(name: Column, size: Column, most: int = S.SCAN_FILE_BYTES) -> Column:
    """'extension', 'pattern', 'too_large' or 'candidate', tested in this order."""
    low = F.translate(name, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    ext = F.regexp_extract(low, r"(?s)^.+\.([^.]*)\z", 1)
    made = F.startswith(name, F.lit("."))
    for s in S.GENERATED_SUFFIXES:
        made = made | F.endswith(low, F.lit(s))
    return F.when(~ext.isin(*S.SCAN_EXTENSIONS), "extension").when(made, "pattern").when(F.coalesce(size > most, F.lit(False)), "too_large").otherwise("candidate")


def walk_key(path: Column, is_dir: Column) -> Column:
    """Sorts entries as a depth-first walk lists them: a directory's entries together by name, and of directories the last name first.

    A component's key is its UTF-8 in complemented hexadecimal with a final G, so later names and longer ones come first."""
    parts = F.split(path, "/")
    dirs = F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0)))
    turned = F.transform(dirs, lambda c: F.concat(F.translate(F.hex(F.encode(c, "UTF-8")), "0123456789ABCDEF", "FEDCBA9876543210"), F.lit("G")))
    return F.struct(turned.alias("directory"), F.element_at(parts, -1).alias("name"))


def source_slug(url: Column) -> Column:
    """A source id from an address: its last segment without .git, lower case, other characters to single dashes; null if nothing is left."""
    last = F.regexp_extract(F.regexp_replace(F.trim(url), "/+\\z", ""), r"([^/:]*)\z", 1)
    slug = F.btrim(F.regexp_replace(F.lower(F.regexp_replace(last, r"(?i)\.git\z", "")), "[^a-z0-9]+", "-"), F.lit("-"))
    return F.when(slug != "", slug)


def valid_source_id(s: Column) -> Column:
    return s.rlike(r"\A[a-z0-9]+(?:[._-][a-z0-9]+)*\z")


def revision_of(text: Column) -> Column:
    """The first line if it is a full hexadecimal revision, lower case; else null."""
    first = F.trim(F.split(text, "\n")[0])
    return F.when(first.rlike(r"\A[0-9A-Fa-f]{40,64}\z"), F.lower(first))


def revision(text: str) -> str:
    """revision_of() of one text outside Spark; the first word of the first line may be followed by more. ValueError for none."""
    first = (text.split("\n")[0].split() or [""])[0]
    if not re.fullmatch("[0-9A-Fa-f]{40,64}", first):
        raise ValueError(f"no revision: {first!r}")
    return first.lower()


HOST = "github.com"


def contents_url(api: Column, owner: Column, name: Column, path: Column) -> Column:
    """The address of a path in a host's contents interface, every segment percent-encoded; the empty path is the root."""
    segment = lambda x: F.replace(F.url_encode(x), F.lit("+"), F.lit("%20"))
    below = F.when(path == "", F.lit("")).otherwise(F.concat(F.lit("/"), F.array_join(F.transform(F.split(path, "/"), segment), "/")))
    return F.concat(F.rtrim(api, F.lit("/")), F.lit("/repos/"), segment(owner), F.lit("/"), segment(name), F.lit("/contents"), below)


def repository(address: Column, bare: bool = True) -> Column:
    """struct<owner, name> of host:owner/name, user@host:owner/name, a URL of the host or (bare) owner/name; null for others."""
    v = F.regexp_replace(F.btrim(address, F.lit(S.SCAN_STRIP)), "/+\\z", "")
    host = r"(?i:" + HOST.replace(".", r"\.") + ")"
    scp, web, short = rf"\A(?:[^/:]*@)?{host}:([^/]*)/([^/]*)\z", rf"\A(?i:[a-z][a-z0-9+.-]*)://(?:[^/@]*@)?{host}(?::[0-9]+)?/+([^/?#]+)/+([^/?#]+)/*(?:[?#].*)?\z", r"\A([^/]*)/([^/]*)\z"
    pattern = F.when(v.rlike(scp), F.lit(1)).when(v.rlike(web), F.lit(2)).when(F.lit(bare) & v.rlike(short) & ~F.contains(v, F.lit("://")), F.lit(3))
    part = lambda i: F.when(pattern == 1, F.regexp_extract(v, scp, i)).when(pattern == 2, F.regexp_extract(v, web, i)).when(pattern == 3, F.regexp_extract(v, short, i))
    owner, name = part(1), F.regexp_replace(part(2), r"(?i)\.git\z", "")
    bad = F.array(F.lit(""), F.lit("."), F.lit(".."))
    return F.when(pattern.isNotNull() & ~F.array_contains(bad, owner) & ~F.array_contains(bad, name), F.struct(owner.alias("owner"), name.alias("name")))


def address_problem(address: Column) -> Column:
    """What keeps an address from naming a repository: empty, host, segments; null for a good one."""
    v = F.regexp_replace(F.btrim(address, F.lit(S.SCAN_STRIP)), "/+\\z", "")
    other = (F.contains(v, F.lit("://")) | v.rlike(r"\A[^/]*:[^/]")) & ~v.rlike(r"\A(?:[A-Za-z][A-Za-z0-9+.-]*://)?(?:[^/@:]*@)?(?i:" + HOST.replace(".", r"\.") + r")(?:[:/]|\z)")
    return F.when(repository(address).isNotNull(), F.lit(None)).when(F.coalesce(v == "", F.lit(True)), "empty").when(other, "host").otherwise("segments")


def relative_path(path: Column) -> Column:
    """Without empty and '.' parts; null for absolute paths and those with '..'."""
    parts = F.split(path, "/")
    clean = F.array_join(F.filter(parts, lambda x: ~x.isin("", ".")), "/")
    return F.when(~F.startswith(path, F.lit("/")) & ~F.array_contains(parts, ".."), clean)
