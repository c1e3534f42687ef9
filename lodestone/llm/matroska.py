"""Matroska media columns: a muxer for 8-bit PCM and a demuxer that turns files into packet tables.

Only the public container specification (RFC 8794 EBML, RFC 9559 Matroska) is used. The demuxer reads
variable-length element ids and sizes (unknown sizes too), clusters, simple blocks and block groups,
all three lacings and the cue index. Payload bytes are found through the packet table's byte ranges.

Defined results: a null medium gives no packets and null features; any byte string that is not well-formed (empty,
foreign, cut short, a block outside a cluster, nested deeper than NESTED, integers beyond 64 bits) raises ValueError from demux(): packets() gives it no rows,
media_features() null features, media_errors() the error's text. Repeated rows count each; an empty table gives no
rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from .common import map_rows, texts

# Element ids of the container.
EBML, SEGMENT, INFO, SCALE, TRACKS, TRACK = 0x1A45DFA3, 0x18538067, 0x1549A966, 0x2AD7B1, 0x1654AE6B, 0xAE
TRACK_NUMBER, TRACK_UID, TRACK_TYPE, CODEC, AUDIO, RATE, CHANNELS, DEPTH = 0xD7, 0x73C5, 0x83, 0x86, 0xE1, 0xB5, 0x9F, 0x6264
CLUSTER, CLUSTER_TIME, SIMPLE_BLOCK, BLOCK_GROUP, BLOCK = 0x1F43B675, 0xE7, 0xA3, 0xA0, 0xA1
CUES, CUE_POINT, CUE_TIME, CUE_TRACKS, CUE_TRACK, CUE_AT = 0x1C53BB6B, 0xBB, 0xB3, 0xB7, 0xF7, 0xF1
TOP = {EBML, SEGMENT, INFO, TRACKS, CLUSTER, CUES, 0x114D9B74, 0x1941A469, 0x1043A770, 0x1254C367}  # and seek head, attachments, chapters, tags
MASTERS = {SEGMENT, INFO, TRACKS, TRACK, AUDIO, CLUSTER, BLOCK_GROUP, CUES, CUE_POINT, CUE_TRACKS}

UNIT = 64  # payload is padded to a positive multiple of this
NESTED = 32  # levels of elements; the specification needs eight
FRAME = 1024  # samples (bytes) in a frame: 128 ms at 8 kHz
LACED = 8  # frames in a block
BLOCKS = 8  # blocks in a cluster
HERTZ = 8000


def vint(n: int, width: int = 0) -> bytes:
    width = width or next(w for w in range(1, 9) if n < (1 << 7 * w) - 1)
    return (n | 1 << 7 * width).to_bytes(width, "big")


def element(eid: int, body: bytes) -> bytes:
    return eid.to_bytes((eid.bit_length() + 7) // 8, "big") + vint(len(body)) + body


def number(eid: int, n: int) -> bytes:
    return element(eid, n.to_bytes(max(1, (n.bit_length() + 7) // 8), "big"))


def lace_sizes(sizes: list[int]) -> bytes:
    """EBML lacing: the first size, then signed differences, the last frame's size left out."""
    out = vint(sizes[0])
    for a, b in zip(sizes, sizes[1:-1], strict=False):
        d = b - a
        w = next(w for w in range(1, 9) if abs(d) < 1 << (7 * w - 1))
        out += vint(d + (1 << 7 * w - 1) - 1, w)
    return out


def block(track: int, offset: int, frames: list[bytes], lacing: str = "auto") -> bytes:
    """A simple block; "auto" laces equal frames by fixed size and others by EBML sizes."""
    if lacing == "auto":
        lacing = "none" if len(frames) == 1 else "fixed" if len({len(f) for f in frames}) == 1 else "ebml"
    head = vint(track) + struct.pack(">h", offset) + bytes([0x80 | {"none": 0, "xiph": 2, "fixed": 4, "ebml": 6}[lacing]])
    if lacing != "none":
        head += bytes([len(frames) - 1])
    if lacing == "xiph":
        head += b"".join(b"\xff" * (len(f) // 255) + bytes([len(f) % 255]) for f in frames[:-1])
    elif lacing == "ebml":
        head += lace_sizes([len(f) for f in frames])
    return element(SIMPLE_BLOCK, head + b"".join(frames))


def mux(payload: bytes) -> bytes:
    """Stores payload losslessly as mono 8-bit PCM at 8 kHz: header, track, clusters of laced blocks, cues."""
    head = element(EBML, number(0x4286, 1) + number(0x42F7, 1) + number(0x42F2, 4) + number(0x42F3, 8) + element(0x4282, b"matroska") + number(0x4287, 4) + number(0x4285, 2))
    audio = element(AUDIO, element(RATE, struct.pack(">d", HERTZ)) + number(CHANNELS, 1) + number(DEPTH, 8))
    parts = [element(INFO, number(SCALE, 1_000_000)), element(TRACKS, element(TRACK, number(TRACK_NUMBER, 1) + number(TRACK_UID, 1) + number(TRACK_TYPE, 2) + element(CODEC, b"A_PCM/INT/LIT") + audio))]
    at, cues = sum(map(len, parts)), []
    frames = [payload[i : i + FRAME] for i in range(0, len(payload), FRAME)]
    per = LACED * BLOCKS
    for c in range(0, len(frames), per):
        start = c * FRAME * 1000 // HERTZ
        body = number(CLUSTER_TIME, start)
        for b in range(c, min(c + per, len(frames)), LACED):
            body += block(1, b * FRAME * 1000 // HERTZ - start, frames[b : min(b + LACED, c + per)])
        cues.append(element(CUE_POINT, number(CUE_TIME, start) + element(CUE_TRACKS, number(CUE_TRACK, 1) + number(CUE_AT, at))))
        parts.append(element(CLUSTER, body))
        at += len(parts[-1])
    if cues:
        parts.append(element(CUES, b"".join(cues)))
    return head + element(SEGMENT, b"".join(parts))


@dataclass
class Media:
    scale: int = 1_000_000
    tracks: dict[int, dict] = field(default_factory=dict)
    #: (track, cluster, block, lace, ms, key, start, size); start is a byte offset in the file
    packets: list[tuple[int, int, int, int, int, bool, int, int]] = field(default_factory=list)
    #: (ms, track, byte offset of the cluster in the file)
    cues: list[tuple[int, int, int]] = field(default_factory=list)
    clusters: list[tuple[int, int]] = field(default_factory=list)


def read_vint(b: bytes, i: int, keep: bool = False) -> tuple[int, int]:
    """Value and next index; an all-ones size gives -1 (unknown)."""
    if i >= len(b) or not b[i]:
        raise ValueError(f"no variable-length integer at byte {i}")
    w = 9 - b[i].bit_length()
    if i + w > len(b):
        raise ValueError(f"truncated integer at byte {i}")
    n = int.from_bytes(b[i : i + w], "big")
    if keep:
        return n, i + w
    n &= (1 << 7 * w) - 1
    return (-1 if n == (1 << 7 * w) - 1 else n), i + w


def unknown_end(b: bytes, eid: int, i: int, end: int) -> int:
    """Where an element of unknown size ends: at the first element that cannot be inside it (a segment: at the end)."""
    if eid != CLUSTER:
        return end
    while i < end:
        child, j = read_vint(b, i, True)
        if child in TOP:
            return i
        n, j = read_vint(b, j)
        if n < 0:
            raise ValueError(f"element {child:x} of unknown size in a cluster, at byte {i}")
        i = j + n
    return end


def elements(b: bytes, i: int, end: int):
    """(id, body start, body end, element start) of the elements in a range."""
    while i < end:
        start = i
        eid, i = read_vint(b, i, True)
        n, i = read_vint(b, i)
        stop = unknown_end(b, eid, i, end) if n < 0 else i + n
        if stop > end:
            raise ValueError(f"element {eid:x} at byte {start} ends beyond its parent")
        yield eid, i, stop, start
        i = stop


def frame_ranges(b: bytes, i: int, end: int, lacing: int) -> list[tuple[int, int]]:
    if not lacing:
        return [(i, end - i)]
    if i >= end:
        raise ValueError("a laced block without frame count")
    n, i, sizes = b[i] + 1, i + 1, []
    if lacing == 2:
        if (end - i) % n:
            raise ValueError("fixed lacing does not divide the block")
        sizes = [(end - i) // n] * n
    elif lacing == 1:
        for _ in range(n - 1):
            size = 0
            while True:
                if i >= end:
                    raise ValueError("lacing sizes exceed the block")
                size, last, i = size + b[i], b[i], i + 1
                if last < 255:
                    break
            sizes.append(size)
    elif n > 1:
        size, i = read_vint(b, i)
        sizes.append(size)
        for _ in range(n - 2):
            at = i
            d, i = read_vint(b, i)
            w = i - at
            d = (1 << 7 * w) - 1 if d < 0 else d
            sizes.append(sizes[-1] + d - ((1 << 7 * w - 1) - 1))
    if lacing != 2:
        sizes.append(end - i - sum(sizes))
    if min(sizes) < 0 or i > end:
        raise ValueError("lacing sizes exceed the block")
    out = []
    for s in sizes:
        out.append((i, s))
        i += s
    return out


def demux(b: bytes) -> Media:
    """Parses a whole file; ValueError where it is not well-formed."""
    if b[:4] != EBML.to_bytes(4, "big"):
        raise ValueError("no EBML header")
    media, rates = Media(), {}

    def integer(i: int, j: int) -> int:
        if j - i > 8:
            raise ValueError(f"integer of {j - i} bytes at byte {i}")
        return int.from_bytes(b[i:j], "big")

    def in_range(n: int, at: int) -> int:
        if not -(1 << 63) <= n < 1 << 63:
            raise ValueError(f"time or place beyond 64 bits at byte {at}")
        return n

    def take_block(i: int, j: int, cluster: int, nth: int, time: int, simple: bool) -> None:
        track, i = read_vint(b, i)
        if cluster < 0:
            raise ValueError(f"block outside a cluster at byte {i}")
        if i + 3 > j:
            raise ValueError(f"block cut short at byte {i}")
        offset, flags = struct.unpack(">hB", b[i : i + 3])
        ranges = frame_ranges(b, i + 3, j, flags >> 1 & 3)
        per = rates.get(track)
        for lace, (at, size) in enumerate(ranges):
            ms = (time + offset) * media.scale // 1_000_000
            ms += sum(s for _, s in ranges[:lace]) * 1000 // per if per else 0
            media.packets.append((track, cluster, nth, lace, in_range(ms, i), bool(flags & 0x80) or not simple, at, size))

    def walk(i: int, end: int, inside: dict, depth: int = 1) -> None:
        if depth > NESTED:
            raise ValueError(f"elements nested deeper than {NESTED} at byte {i}")
        for eid, s, e, at in elements(b, i, end):
            if eid == SEGMENT:
                walk(s, e, {"segment": s}, depth + 1)
            elif eid == CLUSTER:
                media.clusters.append((at, e))
                walk(s, e, {**inside, "cluster": len(media.clusters) - 1, "time": 0, "block": 0}, depth + 1)
            elif eid == TRACK:
                walk(s, e, t := {**inside, "track": {}}, depth + 1)
                t = t["track"]
                number_ = t.get("number", 0)
                media.tracks[number_] = t
                if t.get("codec") == "A_PCM/INT/LIT" and t.get("rate") and 0 < t["rate"] < 1e9:
                    rates[number_] = int(t["rate"]) * t.get("channels", 1) * max(1, t.get("depth", 8) // 8)
            elif eid == CUE_POINT:
                walk(s, e, c := {**inside, "cue": {}}, depth + 1)
                place = c["cue"].get("at", 0) + inside.get("segment", 0)
                media.cues.append((in_range(c["cue"].get("time", 0) * media.scale // 1_000_000, s), in_range(c["cue"].get("track", 0), s), in_range(place, s)))
            elif eid in MASTERS:
                walk(s, e, inside, depth + 1)
            elif eid == SCALE:
                media.scale = integer(s, e)
            elif eid == CLUSTER_TIME:
                inside["time"] = integer(s, e)
            elif eid in (SIMPLE_BLOCK, BLOCK):
                take_block(s, e, inside.get("cluster", -1), inside.get("block", 0), inside.get("time", 0), eid == SIMPLE_BLOCK)
                inside["block"] += 1
            elif "track" in inside and eid in (TRACK_NUMBER, TRACK_TYPE, CHANNELS, DEPTH):
                inside["track"][{TRACK_NUMBER: "number", TRACK_TYPE: "type", CHANNELS: "channels", DEPTH: "depth"}[eid]] = integer(s, e)
            elif "track" in inside and eid == CODEC:
                inside["track"]["codec"] = b[s:e].decode("ascii", "replace")
            elif "track" in inside and eid == RATE:
                if e - s not in (4, 8):
                    raise ValueError(f"float of {e - s} bytes at byte {s}")
                inside["track"]["rate"] = struct.unpack(">d" if e - s == 8 else ">f", b[s:e])[0]
            elif "cue" in inside and eid in (CUE_TIME, CUE_TRACK, CUE_AT):
                inside["cue"][{CUE_TIME: "time", CUE_TRACK: "track", CUE_AT: "at"}[eid]] = integer(s, e)

    walk(0, len(b), {})
    return media


def read_back(b: bytes, media: Media, track: int = 1) -> bytes:
    return b"".join(b[at : at + size] for t, *_, at, size in media.packets if t == track)


def padded(text: str) -> bytes:
    raw = text.encode("utf-8", "surrogatepass")
    return raw + bytes(-len(raw) % UNIT or (0 if raw else UNIT))


def feature(payload: bytes, media: Media) -> str:
    """Container and signal features of one stored payload, as ordered key=value text."""
    ones = payload.translate(ABOVE)
    level = sum(payload) / max(1, len(payload))
    found = {at for at, _ in media.clusters}
    good = all(at in found for *_, at in media.cues) and len(media.cues) == len(media.clusters)
    last = media.packets[-1] if media.packets else None
    return f"packets={len(media.packets)};blocks={len({p[1:3] for p in media.packets})};clusters={len(media.clusters)};cues_ok={int(good)};last_ms={last[4] if last else 0};mean={level:.4f};above_mid={ones.count(1)}"


ABOVE = bytes(int(i >= 128) for i in range(256))


def media_store(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, media: every whole text stored as a Matroska file. Null text counts as empty."""

    def make():
        def step(x):
            return {"doc_id": x["doc_id"], "n_bytes": [len(t.encode("utf-8", "surrogatepass")) for t in x["text"]], "media": [mux(padded(t)) for t in x["text"]]}

        return step

    return map_rows(texts(docs, "doc_id"), "doc_id long, n_bytes long, media binary", make)


def packets(df: DataFrame, media: str = "media", key: str = "doc_id") -> DataFrame:
    """The packet table: one row per frame with track, cluster, block, lace, ms, keyframe and byte range.

    Null media and media that do not parse give no rows (media_errors lists the latter)."""

    def make():
        def step(x):
            out = {n: [] for n in ("key", "track", "cluster", "block", "lace", "ms", "keyframe", "byte_start", "byte_size")}
            for k, b in zip(x["key"], x["media"], strict=True):
                try:
                    rows = demux(b).packets if b is not None else []
                except ValueError:
                    rows = []
                for p in rows:
                    for n, v in zip(out, (k, *p), strict=True):
                        out[n].append(v)
            return out

        return step

    return map_rows(df.selectExpr(f"{key} AS key", f"{media} AS media"), "key long, track long, cluster long, block long, lace long, ms long, keyframe boolean, byte_start long, byte_size long", make)


def media_errors(df: DataFrame, media: str = "media", key: str = "doc_id") -> DataFrame:
    """key, error of every medium that does not parse (null media are no errors)."""

    def make():
        def step(x):
            out = {"key": [], "error": []}
            for k, b in zip(x["key"], x["media"], strict=True):
                try:
                    if b is not None:
                        demux(b)
                except ValueError as e:
                    out["key"].append(k)
                    out["error"].append(str(e))
            return out

        return step

    return map_rows(df.selectExpr(f"{key} AS key", f"{media} AS media"), "key long, error string", make)


def media_features(stored: DataFrame) -> DataFrame:
    """Reads media (doc_id, n_bytes, media) back through their packet tables and digests what was read."""

    def make():
        def step(x):
            out = {n: [] for n in ("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")}
            for k, n, b in zip(x["doc_id"], x["n_bytes"], x["media"], strict=True):
                row = (k, n, *[None] * 6)
                try:
                    if b is not None:
                        m = demux(b)
                        p = read_back(b, m)
                        row = (k, n, len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-UNIT:]), len(b), hashlib.sha256(b).hexdigest(), feature(p, m))
                except ValueError:
                    pass
                for c, v in zip(out, row, strict=True):
                    out[c].append(v)
            return out

        return step

    return map_rows(stored.select("doc_id", "n_bytes", "media"), "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string", make)
