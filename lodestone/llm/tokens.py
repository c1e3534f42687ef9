"""Token ids of whole texts through the tokenizers library, with a per-worker cache by pre-token.

The vocabulary file's pre-tokenizer splits a text into pieces that are encoded independently, so the
library's ids of a text are those of its pieces in turn. Pieces repeat; the library encodes each once.
Texts with a character outside SAFE, where two regex engines could split differently, and texts that hold
an added token are handed to the library whole.
"""

from __future__ import annotations

import re
import sys
from array import array

#: Pieces kept by one Python worker before the cache starts anew: about 250 MB.
CACHE_PIECES = 1_300_000
UNSAFE = re.compile("[^\t\n\x0b\x0c\r\x20-\x7e\xa1-\xa9\xab-\xb1\xb4\xb6-\xb8\xbb\xbf-ɏ]")
# Fixed value: the splitting pattern of byte-level vocabularies, for texts of SAFE characters.
PIECES = re.compile("'(?:s|t|re|ve|m|ll|d)| ?[A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\u024f]+| ?[0-9]+| ?[^A-Za-z0-9\xc0-\xd6\xd8-\xf6\xf8-\u024f\\s]+|\\s+(?!\\S)|\\s+")


def packed(ids: list[int]) -> bytes:
    a = array("I", ids)
    if sys.byteorder == "big":
        a.byteswap()
    return a.tobytes()


class Pieces(dict):
    """Ids by piece; a missing one is encoded at once."""

    def __init__(self, encode):
        super().__init__()
        self.encode = encode

    def __missing__(self, piece: str) -> bytes:
        out = self[piece] = self.encode(piece)
        return out


class Encoder:
    """ids(texts) gives the library's ids as little-endian unsigned 32-bit bytes, one value a text."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_padding()
        self.library.no_truncation()
        self.cache = Pieces(self.whole)
        added = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.added = re.compile("|".join(map(re.escape, added))) if added else None
        pre = self.library.pre_tokenizer
        self.split = type(pre).__name__ == "ByteLevel" and not pre.add_prefix_space and self.library.normalizer is None

    def whole(self, text: str) -> bytes:
        return packed(self.library.encode(text, add_special_tokens=False).ids)

    def ids(self, texts: list[str]) -> list[bytes]:
        whole, out = self.whole, []
        for t in texts:
            if not self.split or UNSAFE.search(t) or (self.added and self.added.search(t)):
                out.append(whole(t))
            else:
                if len(self.cache) > CACHE_PIECES:
                    self.cache.clear()
                out.append(b"".join(map(self.cache.__getitem__, PIECES.findall(t))))
        return out


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder in each Python worker; forked workers are reused, so its cache lasts."""
    import gc
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    gc.set_threshold(1_000_000, 50, 100)  # batches hold millions of strings and no cycles
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]
