"""Exact token counts at every prefix of a text, by dynamic programming over the byte-pair merges.

A byte sequence's encoding is the one chain of vocabulary entries whose neighbours all are "stable": the
merges applied to the two entries' bytes together give these two entries again. So the last token of a
prefix is the one entry ending there that is stable beside the last token of the prefix before it, and
count[j] = count[j - len(entry)] + 1. Pre-tokens are independent; a distinct pre-token is solved once in
each worker. The store holds, for each text, the change of the count at each character as signed bytes.

A prefix's count is what the library gives for that prefix alone (without special tokens; an added token
string counts as one token once it is whole). Null text counts as empty; repeated rows give repeated rows.
"""

from __future__ import annotations

import json
import zlib

import numpy as np
from pyspark.sql import DataFrame

from .common import map_rows, texts
from .tokens import CACHE_PIECES, PIECES, UNSAFE

LIMIT = 1024


def byte_letters() -> dict[str, int]:
    """The printable stand-in of each byte in byte-level vocabularies, by its public rule."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(rest)}


class Merges:
    """The merge table of a byte-level vocabulary file, and the prefix dynamic programme over it."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = byte_letters()
        raw = lambda s: bytes(letters[c] for c in s)
        self.added = [t["content"] for t in spec["added_tokens"]]
        special = {t["id"] for t in spec["added_tokens"]}
        self.ids = {raw(s): i for s, i in spec["model"]["vocab"].items() if i not in special}
        self.rank: dict[tuple[int, int], tuple[int, int]] = {}
        self.parts: dict[int, tuple[int, int]] = {}
        self.born: dict[int, int] = {i: -1 for i in self.ids.values()}
        for n, pair in enumerate(spec["model"]["merges"]):
            a, b = (raw(x) for x in (pair if isinstance(pair, list) else pair.split(" ")))
            u, v, w = self.ids[a], self.ids[b], self.ids[a + b]
            self.rank[u, v] = (n, w)
            if w not in self.parts:
                self.parts[w] = (u, v)
                self.born[w] = n
        # every ending of an entry: the entry's id, or -1 where it is none itself
        self.ends = {e[i:]: -1 for e in self.ids for i in range(1, len(e))} | self.ids
        self.known: dict[int, bool] = {}
        self.cache: dict[str, bytes] = {}
        from regex import compile as wide

        self.wide = wide(r"'(?:s|t|re|ve|m|ll|d)| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+")
        self.runs = wide(r"\p{White_Space}{2,}(?=\P{White_Space})")

    def stable(self, u: int, v: int) -> bool:
        """Whether the merges of u's and v's bytes end as u, v: no merge across the border comes before the ones that form the sides."""
        key = u << 32 | v
        found = self.known.get(key)
        if found is None:
            if len(self.known) > 1_000_000:
                self.known.clear()
            found = self.known[key] = self._stable(u, v)
        return found

    def _stable(self, u: int, v: int) -> bool:
        latest = float("inf")  # merges of this rank and later have been undone
        while True:
            across = self.rank.get((u, v))
            if across is not None and across[0] < latest:
                return False
            if self.born[u] > self.born[v]:
                # undo u: a merge across of the same rank lies to the right of it and would come later
                latest, u = self.born[u], self.parts[u][1]
            elif self.born[v] >= 0:
                # undo v: a merge across of the same rank lies to the left of it and would come first
                latest, v = self.born[v] + 1, self.parts[v][0]
            else:
                return True

    def solve(self, piece: bytes) -> list[int]:
        """count[j], the number of tokens of piece[:j], for every j from 0."""
        n, ends, stable, parts = len(piece), self.ends, self.stable, self.parts
        count, last = [0] * (n + 1), [-1] * (n + 1)
        for j in range(1, n + 1):
            for i in range(j - 1, -1, -1):
                t = ends.get(piece[i:j])
                if t is None:  # no entry ends with these bytes, nor with more of them
                    break
                if t >= 0 and (i == 0 or stable(last[i], t)) and (t not in parts or self.whole(t)):
                    count[j], last[j] = count[i] + 1, t
                    break
        return count

    def whole(self, t: int) -> bool:
        u, v = self.parts[t]
        return self.rank[u, v][1] == t

    def piece(self, p: str) -> bytes:
        """The count's change at each character of a pre-token, as signed bytes; prefixes are split anew."""
        out = self.cache.get(p)
        if out is None:
            if len(self.cache) >= CACHE_PIECES:
                self.cache.clear()
            raw = p.encode("utf-8", "surrogatepass")
            count = self.solve(raw)
            if p[0] == "'" and len(p) > 1 and p[1].isalpha():  # a contraction; before it is whole the quote stands alone
                at = [0, 1, *(1 + self.solve(p[1:k].encode())[-1] for k in range(2, len(p))), count[-1]]
            elif len(raw) == len(p):
                at = count
            else:
                at = [0]
                k = 0
                for c in p:
                    k += len(c.encode("utf-8", "surrogatepass"))
                    at.append(count[k])
            out = self.cache[p] = np.diff(np.array(at)).astype(np.int8).tobytes()
        return out

    def segment(self, text: str) -> bytes:
        if not text:
            return b""
        pieces = (self.wide if UNSAFE.search(text) else PIECES).findall(text)
        d = b"".join(map(self.piece, pieces))
        patches = [(m.start(), m.end()) for m in self.runs.finditer(text)]
        if patches:
            # a prefix that ends with white space keeps the run whole; the run gives up its last character only when another follows
            a = np.frombuffer(d, np.int8).copy()
            c = np.cumsum(a, dtype=np.int64)
            for s, e in patches:
                whole = (c[s - 1] if s else 0) + self.solve(text[s:e].encode())[-1]
                shift = whole - c[e - 1]
                a[e - 1] += shift
                a[e] -= shift
            d = a.tobytes()
        return d

    def changes(self, text: str) -> bytes:
        """The count's change at each character of a text, as signed bytes."""
        if not any(s in text for s in self.added):
            return self.segment(text)
        from regex import compile as wide

        out, i = [], 0
        for m in wide("|".join(map(_escaped, self.added))).finditer(text):
            before = self.segment(text[i : m.start()])
            token = m.group()
            # until it is whole, an added token's string is ordinary text after what stands before it
            open_ = [sum(np.frombuffer(self.segment(text[i : m.start() + k]), np.int8).tolist()) for k in range(len(token))]
            out.append(before + np.diff(np.array([*open_, open_[0] + 1])).astype(np.int8).tobytes())
            i = m.end()
        return b"".join(out) + self.segment(text[i:])


def _escaped(s: str) -> str:
    import re

    return re.escape(s)


_merges: dict[str, Merges] = {}


def merges(path: str) -> Merges:
    if path not in _merges:
        _merges[path] = Merges(path)
    return _merges[path]


def counts_of(store: bytes) -> np.ndarray:
    """The token count of every prefix, from the empty one, out of a stored value."""
    a = np.frombuffer(zlib.decompress(store), np.int8)
    return np.concatenate([[0], np.cumsum(a, dtype=np.int64)])


def fitting(store: bytes, budget: int) -> int:
    """Characters of the longest prefix of at most budget tokens (counts need not rise with the prefix)."""
    return int(np.flatnonzero(counts_of(store) <= budget)[-1])


def prefix_store(docs: DataFrame, path: str, limit: int = LIMIT, keep_store: bool = True) -> DataFrame:
    """doc_id, n_bytes, n_chars, n_tokens, over_limit, fit_chars (longest prefix within the limit) and the store.

    keep_store=False leaves the compressed store out, for callers that only ask these questions."""

    def make():
        m = merges(path)

        def step(x):
            out = {n: [] for n in ("doc_id", "n_bytes", "n_chars", "n_tokens", "over_limit", "fit_chars", "store")}
            for k, t in zip(x["doc_id"], x["text"], strict=True):
                d = m.changes(t)
                c = np.cumsum(np.frombuffer(d, np.int8), dtype=np.int64)
                n = int(c[-1]) if len(c) else 0
                fit = len(c) - int(np.argmax(c[::-1] <= limit)) if len(c) and c.min() <= limit else 0
                row = (k, len(t.encode("utf-8", "surrogatepass")), len(t), n, n > limit, fit, zlib.compress(d, 1) if keep_store else None)
                for name, v in zip(out, row, strict=True):
                    out[name].append(v)
            return out

        return step

    return map_rows(texts(docs, "doc_id"), "doc_id long, n_bytes long, n_chars long, n_tokens long, over_limit boolean, fit_chars long, store binary", make)


def answers(store: DataFrame, budgets: list[int]) -> DataFrame:
    """doc_id, budget, fit_chars: the truncation point of each stored text for each budget, without encoding."""

    def make():
        def step(x):
            out = {"doc_id": [], "budget": [], "fit_chars": []}
            for k, s in zip(x["doc_id"], x["store"], strict=True):
                c = counts_of(s)
                for b in budgets:
                    out["doc_id"].append(k)
                    out["budget"].append(b)
                    out["fit_chars"].append(int(np.flatnonzero(c <= b)[-1]))
            return out

        return step

    return map_rows(store.select("doc_id", "store"), "doc_id long, budget long, fit_chars long", make)
