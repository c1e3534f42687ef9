"""Each operator against brute force on small tables, and its defined results on awkward rows."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lodestone.llm import anisotropic, cdc, dac, matroska, mixing, pow2_packing, prefix_counts, quality, queries, secrets, shingle_join
from tests.conftest import MEDIUM, SMALL

PATH = public_tokenizers.path("byte_bpe_50k.json")
# extra columns named like those that the operators use inside
CLASHES = "start node value _row n runs base found more _text kept row score _score spans _cut stays _stays nth _nth n_rows _rows _source source_name tokens _tokens chosen one block order _ends _n _copy".split()
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in CLASHES)
LONG = " ".join(f"word{i} lorem" for i in range(20000))


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and very long texts, ties, repeated rows and clashing extra columns."""
    one = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon"
    rows = [(1, one), (2, one), (2, one), (3, None), (4, ""), (5, " \n\t "), (6, LONG), (7, one + " omega"), (8, "a b"), (9, "A  b"), (None, "nobody's text"), (10, "password=abcdefghijkl <|endoftext|> é日本\x85 x"), (11, one.upper())]
    return spark.createDataFrame([(k, t, None, "s" if k and k % 2 else None, None, *CLASHES) for k, t in rows], SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def small(spark, name="documents"):
    return spark.read.parquet(f"{SMALL}/{name}.parquet")


def pairs(df):
    return [(r["doc_id"], r["text"] or "") for r in df.select("doc_id", "text").collect()]


# 1 ---------------------------------------------------------------------------------------------------
def test_media_round_trip(spark, odd, none):
    for docs in (small(spark), odd):
        got = sorted(map(tuple, matroska.media_features(matroska.media_store(docs)).select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32").collect()), key=str)
        want = []
        for k, t in pairs(docs):
            raw = t.encode()
            p = raw + bytes(64 if not raw else -len(raw) % 64)
            want.append((k, len(raw), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:])))
        assert got == sorted(want, key=str)
    assert matroska.media_features(matroska.media_store(none)).count() == 0


def plain_media(payload):
    """The stored form written byte by byte: an 8-bit PCM track, clusters of eight blocks of eight frames of 1024 bytes."""
    size = lambda n: next((n | 1 << 7 * w).to_bytes(w, "big") for w in range(1, 9) if n < (1 << 7 * w) - 1)
    el = lambda h, body: bytes.fromhex(h) + size(len(body)) + body
    num = lambda h, n: el(h, n.to_bytes(max(1, (n.bit_length() + 7) // 8), "big"))
    head = el("1a45dfa3", num("4286", 1) + num("42f7", 1) + num("42f2", 4) + num("42f3", 8) + el("4282", b"matroska") + num("4287", 4) + num("4285", 2))
    audio = el("e1", el("b5", bytes.fromhex("40bf400000000000")) + num("9f", 1) + num("6264", 8))
    body = el("1549a966", num("2ad7b1", 1000000)) + el("1654ae6b", el("ae", num("d7", 1) + num("73c5", 1) + num("83", 2) + el("86", b"A_PCM/INT/LIT") + audio))
    frames, cues, blocks = [payload[i : i + 1024] for i in range(0, len(payload), 1024)], b"", 0
    for c in range(0, len(frames), 64):
        cluster = num("e7", c * 128)
        for b in range(c, min(c + 64, len(frames)), 8):
            group = frames[b : b + 8]
            blocks += 1
            lace = 0 if len(group) == 1 else 4 if len({len(f) for f in group}) == 1 else 6
            sizes = b""
            if lace == 6:  # all frames but the last have 1024 bytes: the size, then differences of 0
                sizes = b"\x44\x00" + b"\xbf" * (len(group) - 2)
            cluster += el("a3", b"\x81" + ((b - c) * 128).to_bytes(2, "big") + bytes([128 | lace]) + (bytes([len(group) - 1]) if lace else b"") + sizes + b"".join(group))
        cues += el("bb", num("b3", c * 128) + el("b7", num("f7", 1) + num("f1", len(body))))
        body += el("1f43b675", cluster)
    count = len(range(0, len(frames), 64))
    text = f"packets={len(frames)};blocks={blocks};clusters={count};cues_ok=1;last_ms={(len(frames) - 1) * 128};mean={sum(payload) / len(payload):.4f};above_mid={sum(x >= 128 for x in payload)}"
    return head + el("18538067", body + el("1c53bb6b", cues)), text


def test_media_query_in_full(spark):
    got = {r["doc_id"]: r for r in queries.op1_matroska(spark, SMALL).collect()}
    assert len(got) == small(spark).count()
    for k, t in pairs(small(spark)):
        p = t.encode() + bytes(64 if not t else -len(t.encode()) % 64)
        b, text = plain_media(p)
        assert tuple(got[k]) == (k, len(t.encode()), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]), len(b), hashlib.sha256(b).hexdigest(), text)


def test_malformed_media(spark):
    good = matroska.mux(bytes(range(256)) * 40)
    simple = matroska.block(1, 0, [b"abc", b"defg"], "xiph")
    head, wrap = matroska.element(matroska.EBML, b""), lambda b: matroska.element(matroska.SEGMENT, b)
    rate = matroska.element(matroska.TRACKS, matroska.element(matroska.TRACK, matroska.element(matroska.AUDIO, matroska.element(matroska.RATE, b"\0\0"))))
    bad = [b"", b"junk", head + wrap(simple), head + wrap(rate), head + wrap(matroska.element(matroska.CLUSTER, matroska.element(matroska.SIMPLE_BLOCK, b"\x81\0")))]
    bad += [head + wrap(matroska.element(matroska.CLUSTER, matroska.element(matroska.SIMPLE_BLOCK, b"\x81\0\0\x02\x01\xff")))]
    deep = b""
    for _ in range(3000):
        deep = wrap(deep)
    later = head + wrap(matroska.element(matroska.CLUSTER, matroska.element(matroska.CLUSTER_TIME, b"\x7f" * 9) + simple))
    late = head + wrap(matroska.element(matroska.CLUSTER, matroska.element(matroska.CLUSTER_TIME, b"\xff" * 8) + simple))
    cue = head + wrap(matroska.element(matroska.CUES, matroska.element(matroska.CUE_POINT, matroska.element(matroska.CUE_TIME, b"\xff" * 8))))
    bad += [head + deep, head + (matroska.SEGMENT.to_bytes(4, "big") + b"\xff") * 3000, later, late, cue]
    rng = random.Random(4)
    for _ in range(400):
        b = bytearray(good[: rng.randrange(len(good))] if rng.random() < 0.5 else good)
        for _ in range(rng.randint(0, 3)):
            if b:
                b[rng.randrange(min(len(b), 300))] = rng.randrange(256)
        try:
            matroska.demux(bytes(b))
        except ValueError:
            pass
    for b in bad:
        with pytest.raises(ValueError):
            matroska.demux(b)
    df = spark.createDataFrame([(1, 3, bytearray(good)), (2, 3, None), *((10 + i, 3, bytearray(b)) for i, b in enumerate(bad))], "doc_id long, n_bytes long, media binary")
    assert matroska.media_errors(df).count() == len(bad) and matroska.packets(df).select("key").distinct().count() == 1
    assert {r["doc_id"]: r["payload_bytes"] for r in matroska.media_features(df).collect()} == {1: 10240, 2: None} | {10 + i: None for i in range(len(bad))}


def test_cluster_id_in_a_payload_ends_no_cluster():
    frames = [b"x" + matroska.CLUSTER.to_bytes(4, "big") * 9]
    unknown = matroska.CLUSTER.to_bytes(4, "big") + b"\x01" + b"\xff" * 7
    cluster = matroska.number(matroska.CLUSTER_TIME, 4) + matroska.block(1, 1, frames, "none")
    b = matroska.element(matroska.EBML, b"") + matroska.SEGMENT.to_bytes(4, "big") + b"\xff" + (unknown + cluster) * 2
    m = matroska.demux(b)
    assert len(m.clusters) == 2 and [b[p[6] : p[6] + p[7]] for p in m.packets] == frames * 2


def test_packet_table_and_cues(spark):
    payload = bytes(random.Random(3).randbytes(200_001))
    b = matroska.mux(payload)
    m = matroska.demux(b)
    assert matroska.read_back(b, m) == payload
    assert [at for *_, at in m.cues] == [s for s, _ in m.clusters] and len(m.clusters) == 4
    assert [p[4] for p in m.packets] == [i * 128 for i in range(len(m.packets))]
    df = spark.createDataFrame([(1, bytearray(b)), (2, None), (3, bytearray(b"junk"))], "doc_id long, media binary")
    assert matroska.packets(df).count() == len(m.packets)
    assert [tuple(r) for r in matroska.media_errors(df).collect()] == [(3, "no EBML header")]


@pytest.mark.parametrize("lacing", ["none", "xiph", "ebml", "fixed"])
def test_lacings_and_unknown_sizes(lacing):
    sizes = [5] if lacing == "none" else [300, 300, 300] if lacing == "fixed" else [700, 255, 3, 0, 40000, 12]
    frames = [bytes([i % 251]) * s for i, s in enumerate(sizes)]
    cluster = matroska.number(matroska.CLUSTER_TIME, 40) + matroska.block(1, 7, frames, lacing)
    unknown = matroska.CLUSTER.to_bytes(4, "big") + b"\x01" + b"\xff" * 7
    b = matroska.element(matroska.EBML, b"") + matroska.SEGMENT.to_bytes(4, "big") + b"\xff" + unknown + cluster + unknown + cluster
    m = matroska.demux(b)
    assert [b[p[6] : p[6] + p[7]] for p in m.packets] == frames * 2
    assert {p[4] for p in m.packets} == {47} and len(m.clusters) == 2


# 2 ---------------------------------------------------------------------------------------------------
def test_prefix_counts(spark, odd, none, library):
    for docs in (small(spark).limit(60), odd):
        for r in prefix_counts.prefix_store(docs, PATH).join(docs.select("doc_id", "text").distinct(), "doc_id").collect():
            t = r["text"] or ""
            assert r["n_tokens"] == len(library.encode(t, add_special_tokens=False).ids)
            c = prefix_counts.counts_of(r["store"])
            for k in random.Random(1).sample(range(len(t) + 1), min(len(t) + 1, 8)):
                if k < 5000:
                    assert c[k] == len(library.encode(t[:k], add_special_tokens=False).ids)
            assert r["fit_chars"] == prefix_counts.fitting(r["store"], 1024) and r["over_limit"] == (r["n_tokens"] > 1024)
    assert prefix_counts.prefix_store(none, PATH).count() == 0


def test_every_prefix_of_awkward_strings(library):
    m, rng = prefix_counts.merges(PATH), random.Random(5)
    parts = ["a", "th", "ing", " ", "  ", "\n", "'", "'re", "'s", "é", "日", "22", "!", "<|endoftext|>", "　", "😀", "\t", "²", "\x1c", "\x85"]
    for _ in range(300):
        t = "".join(rng.choice(parts) for _ in range(rng.randint(0, 12)))
        got = np.concatenate([[0], np.cumsum(np.frombuffer(m.changes(t), np.int8))]).tolist()
        assert got == [len(library.encode(t[:k], add_special_tokens=False).ids) for k in range(len(t) + 1)], t


def test_answers(spark):
    store = prefix_counts.prefix_store(small(spark).limit(20), PATH)
    for r in prefix_counts.answers(store, [0, 10]).collect():
        assert r["fit_chars"] == 0 if r["budget"] == 0 else r["fit_chars"] >= 1


# 3 ---------------------------------------------------------------------------------------------------
def brute_mix(rows, entropy=0.95, repeats=2.0, block=1 << 15, seed=17, steps=20):
    import math

    size = lambda t: max(1, len(re.findall(r"[^\x20\x09-\x0D]+", t)))
    by = defaultdict(list)
    for k, s, t in rows:
        by[s or ""].append((k, size(t or ""), hashlib.md5((t or "").encode()).hexdigest()))
    total = {s: sum(d[1] for d in docs) for s, docs in by.items()}
    whole = sum(total.values())
    p = {s: n / whole for s, n in total.items()}

    def aims(a):
        z = sum(x**a for x in p.values())
        h = math.log(z) - a * sum(x**a * math.log(x) for x in p.values()) / z
        return h <= entropy * math.log(len(p)) + 1e-12, min(p.values()) ** (a - 1) / z <= repeats + 1e-12, max(p.values()) ** (a - 1) / z <= repeats + 1e-12

    def halve(right, low, high):
        for _ in range(steps):
            mid = (low + high) / 2
            low, high = (low, mid) if right(mid) else (mid, high)
        return low, high

    met = lambda a: all(aims(a)[:2])
    a = 0.0 if met(0.0) else halve(met, 0.0, 16.0)[1] if met(16.0) else 16.0
    if a > 1 and not aims(a)[2]:
        a = halve(lambda x: not aims(x)[2], 1.0, a)[0]
    z = sum(float(n) ** a for n in total.values())
    out, blocks = [], max(1, -(-whole // block))
    for s, docs in by.items():
        quota, epoch = math.floor(float(total[s]) ** a / z * whole), 0
        while epoch * total[s] < quota:
            key = lambda k, d, e=epoch: hashlib.md5(f"{seed}:{e}:{'' if k is None else k}:{d}".encode()).hexdigest()
            at = epoch * total[s]
            peers = defaultdict(list)
            for k, n, d in docs:
                peers[key(k, d), n].append(k)
            for (_, n), ks in sorted(peers.items()):
                at += n * len(ks)
                if at <= quota:
                    starts = [at - n * (len(ks) - i) for i in range(len(ks))]
                    out += [(k, s, n, epoch, x, x * blocks // quota) for k, x in zip(ks, starts)]
            epoch += 1
    return a, out, aims(a)


def test_mixing(spark, odd, none):
    medium = spark.read.parquet(f"{MEDIUM}/documents.parquet")
    # flattening, sharpening, and a repeated document with many rows
    tables = ((medium.where("source IN ('src0', 'src1', 'src2') OR doc_id % 4 = 0"), 4096), (odd, 1 << 15), (small(spark), 512), (small(spark).unionByName(small(spark).where("doc_id < 20")), 512))
    exponents = []
    for docs, block in tables:
        a, want, (level, light, heavy) = brute_mix([(r["doc_id"], r["source"], r["text"]) for r in docs.collect()], block=block)
        got = mixing.mix(docs, block=block).collect()
        assert sorted(((r["doc_id"], r["source"], r["tokens"], r["epoch"], r["start"], r["block"]) for r in got), key=str) == sorted(want, key=str)
        assert (round(got[0]["exponent"], 9), got[0]["entropy_met"], got[0]["repeats_met"]) == (round(a, 9), level, light and heavy)
        exponents.append(a)
        places = defaultdict(list)
        for r in got:
            places[r["block"]].append(r["place"])
        assert all(sorted(v) == list(range(1, len(v) + 1)) for v in places.values())
        rows = mixing.mixed(docs)
        assert rows.columns == docs.columns and sorted(str(r["doc_id"]) for r in rows.collect()) == sorted(str(d[0]) for d in want)
    assert min(exponents) < 1 < max(exponents)
    assert mixing.mix(none).count() == 0 and mixing.mixed(none).count() == 0


def test_mixing_keeps_clashing_columns(odd):
    assert all([r[c] for c in CLASHES] == CLASHES for r in mixing.mixed(odd).collect())


def test_sharpening_stops_at_the_repetition_limit(spark):
    docs = spark.createDataFrame([(i, "w " * 10, f"s{i % 40}") for i in range(400)] + [(1000 + i, "w " * 11, "big") for i in range(44)], "doc_id long, text string, source string")
    sources = mixing.shares(mixing.sized(docs))
    a, level, limit = mixing.temperature(sources, entropy=0.5, repeats=2.0)
    assert a > 1 and not level and limit
    assert mixing.temperature(sources, entropy=0.5, repeats=1000.0)[1]


# 4 ---------------------------------------------------------------------------------------------------
def test_rolling_hash_is_local():
    raw = random.Random(1).randbytes(500)
    h, mask = cdc.rolling(raw), 0xFFFF
    for i in (0, 3, 15, 16, 200, 499):
        want = 0
        for j in range(max(0, i - 15), i + 1):
            want = (want * 2 + int(cdc.GEAR[raw[j]])) & mask
        assert h[i] == want
    shifted = cdc.cuts(b"inserted" + raw)
    assert set(cdc.cuts(raw)[2:]) <= set(shifted - 8)
    assert cdc.cuts(b"a" * 2000)[-1] == 2000 and np.diff(cdc.cuts(b"a" * 2000)).max() <= cdc.MOST


def test_repeats(spark, odd, none):
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(3, 9)))
    passage = " ".join(word() for _ in range(60))
    texts = {i: " ".join(word() for _ in range(80)) for i in range(60)}
    planted = {i for i in range(0, 60, 4)}
    for i in planted:
        texts[i] = texts[i][: 40 + i] + passage + texts[i][40 + i :]
    docs = spark.createDataFrame([(i, t) for i, t in texts.items()], "doc_id long, text string")
    got = cdc.repeats(docs).collect()
    assert {r["doc_id"] for r in got} == planted
    for r in got:
        at = texts[r["doc_id"]].index(passage)
        assert at - 1 <= r["start_byte"] and r["end_byte"] <= at + len(passage) + 1 + cdc.MOST
        assert (r["first_doc"], r["last_doc"], r["in_first"]) == (0, 56, r["doc_id"] == 0)
    cut = {r["doc_id"]: r["text"] for r in cdc.cut_repeats(docs).collect()}
    assert cut[0] == texts[0] and cut[1] == texts[1] and len(cut[4]) < len(texts[4]) - 112
    brute = defaultdict(set)
    for k, t in pairs(odd):
        raw = t.encode()
        ends = cdc.cuts(raw).tolist()
        for i, j in zip([0, *ends], ends, strict=False):
            brute[raw[i:j]].add(k)
    have = {k for v in brute.values() if len(v - {None}) > 1 for k in v - {None}}
    assert {r["doc_id"] for r in cdc.repeats(odd, least=1).collect()} == have
    assert cdc.repeats(none).count() == 0


def test_copies_that_share_a_phrase_or_a_passage_with_a_smaller_id(spark):
    rng = random.Random(12)
    prose = lambda n: " ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(3, 9))) for _ in range(n))
    phrase, passage, one, two = prose(12), prose(60), prose(100), prose(100)
    texts = {0: f"{prose(50)} {phrase} {prose(50)}", 1: f"{prose(50)} {passage} {prose(50)}"}
    texts |= dict.fromkeys((2, 5, 7), f"{one} {phrase} {two}") | dict.fromkeys((3, 6, 8), f"{one[::-1]} {passage} {two[::-1]}")
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = cdc.repeats(docs).collect()
    bytes_of = lambda i, keep: sum(r["end_byte"] - r["start_byte"] for r in got if r["doc_id"] == i and r["in_first"] == keep)
    assert bytes_of(2, True) == len(texts[2]) and bytes_of(2, False) == 0
    assert bytes_of(3, True) > len(one + two) - cdc.MOST and 112 <= bytes_of(3, False) <= len(passage) + 2
    for i in (5, 6, 7, 8):
        assert bytes_of(i, True) == 0 and bytes_of(i, False) == len(texts[i])
    cut = {r["doc_id"]: r["text"] for r in cdc.cut_repeats(docs).collect()}
    assert all(cut[i] == texts[i] for i in (0, 1, 2)) and all(cut[i] == "" for i in (5, 6, 7, 8))
    assert cut[3].startswith(one[::-1]) and cut[3].endswith(two[::-1]) and len(cut[3]) < len(texts[3]) - 112
    chunked = lambda t: {t[i:j] for i, j in zip([0, *cdc.cuts(t.encode())], cdc.cuts(t.encode()), strict=False)}
    assert all(any(c in t for t in cut.values()) for t in texts.values() for c in chunked(t))


def test_first_copy_keeps_overlaps(spark):
    """A passage whose parts have different first holders stays somewhere whole."""
    rng = random.Random(13)
    x = " ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(3, 9))) for _ in range(200))
    texts = {3: x[:600], 5: x, 9: x[500:]}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    cut = {r["doc_id"]: r["text"] for r in cdc.cut_repeats(docs).collect()}
    chunked = lambda t: {t[i:j] for i, j in zip([0, *cdc.cuts(t.encode())], cdc.cuts(t.encode()), strict=False)}
    assert all(any(c in t for t in cut.values()) for c in set().union(*map(chunked, texts.values())))


def brute_passages(rows, least=cdc.LEAST):
    """Chunks by dictionary, then runs and their parts chunk by chunk: (doc_id, start, end, chunks, first, last, in_first)."""
    holders = defaultdict(set)
    placed = {}
    for k, t in set(rows):
        raw, at = t.encode(), 0
        placed[k, t] = []
        for e in cdc.cuts(raw).tolist():
            placed[k, t].append((at, e, raw[at:e]))
            holders[raw[at:e]].add(k)
            at = e
    out = []
    for (k, _), parts in placed.items():
        runs, last_end = [], None
        for i, j, c in parts:
            h = holders[c] - {None}
            if k is None or len(h) < 2:
                continue
            piece = [i, j, 1, min(h), max(h), min(h) == k]
            if last_end == i and runs:
                runs[-1].append(piece)
            else:
                runs.append([piece])
            last_end = j
        for run in runs:
            for turn in (0, 1):
                merged = []
                for p in run:
                    if merged and merged[-1][5] == p[5]:
                        m = merged[-1]
                        merged[-1] = [m[0], p[1], m[2] + p[2], min(m[3], p[3]), max(m[4], p[4]), m[5]]
                    else:
                        merged.append(list(p))
                run = [[*p[:5], p[5] or p[1] - p[0] < least] for p in merged] if not turn else merged
            out += [(k, *p) for p in run if p[1] - p[0] >= least]
    return sorted(out)


def test_all_passages_of_documents(spark, odd):
    repeated = small(spark).select("doc_id", "text").unionByName(small(spark).select("doc_id", "text").where("doc_id % 3 = 0"))
    for docs in (small(spark), repeated, odd):
        assert sorted(map(tuple, cdc.repeats(docs).collect())) == brute_passages(pairs(docs))


def test_cut_repeats_keeps_rows_characters_and_columns(spark, odd):
    rng = random.Random(14)
    han = lambda n: "".join(chr(rng.randrange(0x4E00, 0x9000)) for _ in range(n))
    shared = han(120)
    rows = [(i, f"{han(80)}{shared}{han(80)}", "x", 1, "s") for i in range(30)] + [(7, "p", "x", 1, "s"), (7, "an unrelated text", "x", 1, "s"), (8, None, "x", 1, "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, row string, _cut int, Spans string")
    got = cdc.cut_repeats(docs)
    assert got.columns == docs.columns
    texts = defaultdict(list)
    for r in got.collect():
        texts[r["doc_id"]].append(r["text"])
    assert texts[0] == [rows[0][1]] and {"p", "an unrelated text"} <= set(texts[7]) and None in texts[8]
    for i in range(1, 30):
        longest = max((t or "" for t in texts[i]), key=len)
        assert len(longest) <= 280 - 60 and longest.startswith(rows[i][1][:60]) and longest.endswith(rows[i][1][-60:]) and set(longest) <= set(rows[i][1])
    assert sorted(map(str, cdc.cut_repeats(odd.where("doc_id < 2")).collect())) == sorted(map(str, odd.where("doc_id < 2").collect()))


# 5 ---------------------------------------------------------------------------------------------------
def test_quality_held_out(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    rows = quality.classify(docs, labels).join(labels, "doc_id").where("held_out").collect()
    assert {zlib.crc32(str(r["doc_id"]).encode()) % 4 for r in rows} == {2}
    good = [r["predicted"] for r in rows if r["quality"] == 1]
    bad = [r["predicted"] for r in rows if r["quality"] == 0]
    assert np.mean(good) > 0.98 and np.mean(bad) < 0.05


def test_quality_defined_results(spark, odd, none):
    labels = spark.createDataFrame([(1, 1, "x"), (2, None, "x"), (7, 2, "x")], "doc_id long, quality int, text string")
    got = quality.classify(odd, labels).collect()
    assert len(got) == odd.count() and all(0 <= r["score"] <= 1 for r in got)
    assert quality.classify(none, labels).count() == 0
    assert quality.keep_good(odd, labels.limit(0), 0.4).count() == odd.count()


def plain_statistics(t):
    """The fourteen statistics by loops over characters and words."""
    import math

    odds = lambda a, w: math.log((a + 0.5) / (max(w - a, 0) + 0.5))
    raw, words, lines = t.encode(), t.split(), [x for x in t.split("\n") if x]
    upper, digit = sum(65 <= b <= 90 for b in raw), sum(48 <= b <= 57 for b in raw)
    lower = sum(97 <= b <= 122 or b >= 128 for b in raw)
    mark = sum(chr(b) in ".,;:?'\"-()" for b in raw)
    symbol = sum(b > 32 and b < 128 and not chr(b).isalnum() and chr(b) not in ".,;:?'\"-()" for b in raw)
    sizes = [len(w) for w in words] or [0]
    mean = sum(sizes) / len(sizes)
    follow = list(zip(words, words[1:]))
    shares = [raw.count(bytes([b])) / len(raw) for b in set(raw)] or [1.0]
    return [
        math.log1p(len(t)), math.log1p(mean), math.log1p(math.sqrt(sum((x - mean) ** 2 for x in sizes) / len(sizes))), odds(upper, upper + lower), odds(digit, len(raw)), odds(mark, len(raw)), odds(symbol, len(raw)),
        odds(len(words) - len(set(words)), len(words)), odds(len(follow) - len(set(follow)), len(follow)), odds(max((words.count(w) for w in set(words)), default=0), len(words)), math.log1p(len(words) / max(1, len(lines))),
        odds(len(lines) - len(set(lines)), len(lines)), -sum(x * math.log2(x) for x in shares), odds(sum(not (w[-1].isalnum() or w[-1] in ".,") for w in words), len(words)),
    ]


def test_quality_in_full(spark):
    """Statistics, moments, shrinkage and scores again in plain form, on the whole query."""
    docs, labels = pairs(small(spark)), {r["doc_id"]: r["quality"] for r in small(spark, "labels").collect()}
    x = {k: np.array(plain_statistics(t)) for k, t in docs}
    out = lambda k: zlib.crc32(str(k).encode()) % 4 == 2
    taught = {c: np.array([x[k] for k in labels if labels[k] == c and not out(k) and k in x]) for c in (0, 1)}
    whole = np.concatenate([taught[0], taught[1]])
    mean, scale = whole.mean(0), np.sqrt(np.maximum(whole.var(0), 1e-9))
    z = {c: (v - mean) / scale for c, v in taught.items()}
    cov = {c: np.cov(v.T, bias=True) for c, v in z.items()}
    pooled = sum(len(z[c]) * cov[c] for c in z) / len(whole)
    d, log = len(mean), {}
    for c in (0, 1):
        m = 0.7 * cov[c] + 0.3 * pooled
        m = 0.95 * m + 0.05 * np.trace(m) / d * np.eye(d)
        inverse, size = np.linalg.inv(m), np.linalg.slogdet(m)[1]
        log[c] = {k: -0.5 * (((v - mean) / scale - z[c].mean(0)) @ inverse @ ((v - mean) / scale - z[c].mean(0)) + size) for k, v in x.items()}
    rows = queries.op5_quality(spark, SMALL).collect()
    assert len(rows) == len(docs)
    for r in rows:
        k = r["doc_id"]
        want = 1 / (1 + np.exp(-np.clip(4 / d * (log[1][k] - log[0][k]) + np.log(len(z[1]) / len(z[0])), -60, 60)))
        assert r["held_out"] == out(k) and abs(r["score"] - want) < 1e-6 and r["predicted"] == (r["score"] >= 0.7)


def test_keep_good_learns_as_classify_does(spark, odd, monkeypatch):
    docs, labels = small(spark), small(spark, "labels")
    want = {r["doc_id"] for r in quality.classify(docs, labels).collect() if r["score"] >= 0.7}
    assert {r["doc_id"] for r in quality.keep_good(docs, labels).collect()} == want
    joined = quality.join_small
    monkeypatch.setattr(quality, "join_small", lambda *a: joined(*a, most=0))
    assert {r["doc_id"] for r in quality.keep_good(docs, labels).collect()} == want
    kept = quality.keep_good(odd, labels.limit(0), 0.4)
    assert kept.columns == odd.columns and all([r[c] for c in CLASHES] == CLASHES for r in kept.collect())


def test_cached_factors_match_densities():
    rng = np.random.default_rng(1)
    d = len(quality.STATISTICS)
    x = {0: rng.normal(0, 1, (400, d)), 1: rng.normal(0.7, 1.5, (900, d))}
    m = quality.Discriminant({k: (float(len(v)), v.sum(0), v.T @ v) for k, v in x.items()}, pool=0.0, ridge=0.0, evidence=d)
    z = np.concatenate(list(x.values()))[::50]
    logs = {}
    for k, v in x.items():
        c, mu = np.cov(v.T, bias=True), v.mean(0)
        logs[k] = np.array([-0.5 * ((r - mu) @ np.linalg.solve(c, r - mu) + np.linalg.slogdet(c)[1]) for r in z])
    want = 1 / (1 + np.exp(-np.clip(logs[1] - logs[0] + np.log(900 / 400), -60, 60)))
    assert np.allclose(m.score(z), want, atol=1e-6)


# 6 ---------------------------------------------------------------------------------------------------
def brute_search(rows, depth=20):
    ids, v = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], float)
    out = {}
    for q in sorted({i for i in ids.tolist() if i % 20 == 0}):
        s = (v * v[ids == q][0]).sum(1)
        order = [i for i in np.lexsort((ids, -s)) if ids[i] != q][:depth]
        out[q] = [(int(ids[i]), float(s[i])) for i in order]
    return out


def test_search_recall(spark):
    table = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    want = brute_search([(r["vec_id"], r["embedding"]) for r in table.collect()])
    got = defaultdict(list)
    for r in anisotropic.search(table).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    assert got.keys() == want.keys() and {len(v) for v in got.values()} == {20}
    assert np.mean([len({i for i, _ in want[q]} & {i for i, _ in got[q]}) / 20 for q in want]) >= 0.9
    exact = {(q, i): s for q, rows in brute_search([(r["vec_id"], r["embedding"]) for r in table.collect()], 10**6).items() for i, s in rows}
    assert all(abs(exact[q, i] - s) < 1e-12 for q, rows in got.items() for i, s in rows)
    assert all(rows == sorted(rows, key=lambda x: (-x[1], x[0])) for rows in got.values())


def clustered(rng, n, d, k):
    """Vectors in clusters, of very different norms."""
    centres = rng.normal(size=(k, d)) * 3
    x = centres[rng.integers(0, k, n)] + rng.normal(size=(n, d)) * rng.choice([0.2, 0.5, 1.5], (n, 1))
    return x * np.exp(rng.normal(size=(n, 1)) * 0.4)


@pytest.mark.parametrize("kind", ["clustered", "flat"])
def test_search_of_many_vectors_by_default_settings(spark, kind, monkeypatch):
    """Codes are made and scanned, the mean recall is high and no query is lost."""
    rng = np.random.default_rng(11)
    n, d = 20000, 16
    x = clustered(rng, n, d, 80) if kind == "clustered" else rng.normal(size=(n, d))
    names, kept = [], anisotropic.stored
    monkeypatch.setattr(anisotropic, "stored", lambda df, name, **k: (names.append(name), kept(df, name, **k))[1])
    table = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<double>")
    got = defaultdict(list)
    for r in anisotropic.search(table, queries="vec_id % 100 = 0").collect():
        got[r["query_id"]].append(r["vec_id"])
    assert "codes" in names and "more" in names and len(got) == n // 100
    recall = []
    for q, found in got.items():
        s = x @ x[q]
        s[q] = -np.inf
        recall.append(len(set(found) & set(np.argsort(-s)[:20].tolist())) / 20)
    assert np.mean(recall) >= 0.95 and min(recall) >= 0.5


def test_many_dimensions(spark, monkeypatch):
    """More dimensions than one job takes, each by cells and codes."""
    monkeypatch.setattr(anisotropic, "TOGETHER", 40)
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(size=1 + i % 100).round(2).tolist()) for i in range(400)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = defaultdict(list)
    for r in anisotropic.search(df).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append(r["vec_id"])
    assert got == {q: [i for i, _ in found] for q, found in brute_ids(rows).items()} and len({len(v) for _, v in rows}) == 100


def test_search_awkward(spark):
    same = [1.0, 2.0, 0.0]
    rows = [(i, same) for i in range(100)] + [(200, [9.0, 9.0, 9.0]), (200, [9.0, 9.0, 9.0]), (201, None), (202, [0.0, 0.0, 0.0]), (203, [1.0, float("nan"), 0.0]), (204, [1.0]), (None, same), (205, [None, 1.0, 1.0])]
    df = spark.createDataFrame([(k, v, "extra") for k, v in rows], "vec_id long, embedding array<float>, label string")
    got = anisotropic.search(df).where("query_id = 0").orderBy("rank").collect()
    assert [r["vec_id"] for r in got] == [200, *range(1, 20)]
    assert anisotropic.search(df.limit(0)).count() == 0
    assert [(r["query_id"], r["vec_id"]) for r in anisotropic.search(df.where("vec_id = 0 OR vec_id = 204")).collect()] == []
    few = anisotropic.search(df.where("vec_id IN (0, 1)")).collect()
    assert [(r["query_id"], r["vec_id"], r["score"]) for r in few] == [(0, 1, 5.0)]


def brute_ids(rows, depth=20):
    """Nearness of two ids: the largest inner product of their vectors of the same dimension."""
    best = defaultdict(dict)
    for q, u in rows:
        if q % 20 == 0:
            for c, v in rows:
                if c != q and len(u) == len(v):
                    best[q][c] = max(best[q].get(c, -np.inf), float(np.dot(np.array(u, np.float32).astype(float), np.array(v, np.float32).astype(float))))
    return {q: sorted(b.items(), key=lambda x: (-x[1], x[0]))[:depth] for q, b in best.items()}


def test_search_of_mixed_dimensions_and_repeated_ids(spark, monkeypatch):
    """The first row's dimension decides nothing; ids with several vectors come once."""
    rng = np.random.default_rng(5)
    rows = [(0, [2.0]), (0, rng.normal(size=3).tolist()), (1, [3.0])]
    rows += [(i, rng.normal(size=3).round(2).tolist()) for i in range(1, 120)] + [(i, rng.normal(size=5).round(2).tolist()) for i in range(300, 400)]
    rows += [(20, [1.0, 0.5, 0.5]), (20, [-1.0, 0.5, 2.0]), (33, [4.0, 4.0, 4.0]), (33, [5.0, 5.0, 5.0]), (33, [5.0, 5.0, 5.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")

    def found(**k):
        got = defaultdict(list)
        for r in anisotropic.search(df, **k).orderBy("query_id", "rank").collect():
            assert r["rank"] == len(got[r["query_id"]]) + 1
            got[r["query_id"]].append((r["vec_id"], r["score"]))
        return got

    same = lambda got, want: got.keys() == want.keys() and all([i for i, _ in got[q]] == [i for i, _ in want[q]] and np.allclose([s for _, s in got[q]], [s for _, s in want[q]]) for q in want)
    assert same(found(), brute_ids(rows))
    monkeypatch.setattr(anisotropic, "BLOCK", 40)  # several cells; with all of them visited and reranked the answer is exact
    monkeypatch.setattr(anisotropic, "KAPPA", 10**6)
    assert same(found(rerank=10**6), brute_ids(rows))


def test_clustered_vectors_need_few_cells():
    rng = np.random.default_rng(6)
    centres = rng.normal(size=(64, 32)) * 4
    x = centres[rng.integers(0, 64, 8000)] + rng.normal(size=(8000, 32)) * 0.3
    m = anisotropic.Model(x, 64)
    m.calibrate(x, 0.97)
    assert m.first <= 12 and 0 < m.kappa <= 1
    flat = rng.normal(size=(8000, 32))
    flat /= np.linalg.norm(flat, axis=1, keepdims=True)
    m = anisotropic.Model(flat, 64)
    m.calibrate(flat, 0.97)
    assert m.first > 16


def test_anisotropic_codes_keep_parallel_error_small():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(3000, 16))
    m = anisotropic.Model(x, 20)
    c = m.cell(x)
    r, unit = x - m.centres[c], x / np.linalg.norm(x, axis=1, keepdims=True)
    near = np.concatenate([((r[:, None, i:j] - b[None]) ** 2).sum(2).argmin(1)[:, None] for (i, j), b in zip(m.cuts, m.books, strict=True)], 1)

    def parallel(codes):
        e = np.concatenate([r[:, i:j] - b[codes[:, k]] for k, ((i, j), b) in enumerate(zip(m.cuts, m.books, strict=True))], 1)
        return ((e * unit).sum(1) ** 2).mean()

    assert m.eta > 0.6 and parallel(m.codes(r, unit)) <= parallel(near) + 1e-12
    codes = m.codes(r, unit)
    assert (anisotropic.unpack_codes(anisotropic.pack_codes(codes), codes.shape[1]) == codes).all()


# 7 ---------------------------------------------------------------------------------------------------
def test_token_files(spark, odd, none, library, tmp_path):
    for n, docs in enumerate((small(spark), odd)):
        path = dac.write_token_files(docs, PATH, f"file://{tmp_path}/{n}")
        files = dac.read_token_files(spark, path)
        got = sorted(map(tuple, dac.document_index(files).collect()), key=lambda r: r[1])
        at, want, flat = 0, [], []
        for k, t in sorted(pairs(docs), key=lambda r: (-1 if r[0] is None else r[0], r[1])):
            ids = [*library.encode(t, add_special_tokens=False).ids, 2]
            want.append((k, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
            at += len(ids)
            flat += ids
        assert got == want
        spots = random.Random(2).sample(range(at), 50)
        hits = dac.token_at(files, spark.createDataFrame([(p,) for p in [*spots, spots[0], at, at + 10**9, -1, None]], "position long")).collect()
        assert sorted((r["position"], r["token"]) for r in hits) == sorted((p, flat[p]) for p in [*spots, spots[0]])
    assert dac.document_index(dac.read_token_files(spark, dac.write_token_files(none, PATH, f"file://{tmp_path}/none"))).count() == 0


def test_one_id_with_many_rows_is_parted(spark, library, tmp_path, monkeypatch):
    monkeypatch.setattr(dac, "REPEATED", 50)
    docs = spark.createDataFrame([(7, f"{chr(97 + i % 26)} text {i}") for i in range(400)] + [(1, "first"), (9, "last")], "doc_id long, text string")
    files = dac.read_token_files(spark, dac.write_token_files(docs, PATH, f"file://{tmp_path}/hot"))
    got = sorted(map(tuple, dac.document_index(files).collect()), key=lambda r: r[1])
    want, at = [], 0
    for k, t in sorted(pairs(docs)):
        ids = [*library.encode(t, add_special_tokens=False).ids, 2]
        want.append((k, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert got == want and files.select("part").distinct().count() > 3


def test_levels_random_access():
    ids = np.array([0, 255, 256, 65535, 65536, 2**32 - 1, 7] * 300, "<u4")
    s = dac.Shard(dac.encode_shard([1, None], [ids[:5].tobytes(), ids[5:].tobytes()]))
    assert (s.ids() == ids).all() and [s.token(i) for i in range(len(ids))] == ids.tolist() and s.keys == [1, None]
    assert len(dac.Shard(dac.encode_shard([4], [b""]))) == 0


# 8 ---------------------------------------------------------------------------------------------------
def test_packing(spark, odd, none, library):
    for docs in (small(spark), odd):
        rows = pow2_packing.pack(docs, PATH).collect()
        assert sorted(r["sequence_id"] for r in rows) == list(range(len(rows))) and {r["offset"] for r in rows} == {0}
        assert all(r["length"] & (r["length"] - 1) == 0 and r["length"] <= 1024 for r in rows)
        order = [r["length"] for r in sorted(rows, key=lambda r: r["sequence_id"])]
        assert order == sorted(order, reverse=True)
        got = sorted((str(r["doc_id"]), r["start"], r["length"], bytes(r["ids"]), r["doc_tokens"]) for r in rows)
        want = []
        for k, t in pairs(docs):
            ids, at = [*library.encode(t, add_special_tokens=False).ids, 0], 0
            for n in [1024] * (len(ids) // 1024) + [1 << b for b in reversed(range(10)) if len(ids) % 1024 >> b & 1]:
                want.append((str(k), at, n, np.array(ids[at : at + n], "<u4").tobytes(), len(ids)))
                at += n
        assert got == sorted(want)
    assert pow2_packing.pack(none, PATH).count() == 0


# 9 ---------------------------------------------------------------------------------------------------
BASE = (
    (re.compile(r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), lambda m: len(m.group(1)) >= 12),
    (re.compile(r"AKIA[A-Z0-9]+"), lambda m: len(m.group()) >= 18),
    (re.compile(r"[0-9a-f]+"), lambda m: len(m.group()) >= 16),
)


def brute_base(text):
    out = sorted((m.start(), kind, m.end()) for kind, (rx, ok) in enumerate(BASE) for m in rx.finditer(text) if ok(m))
    return [f"{('assign', 'access', 'hex')[k]}:{s}:{e}" for s, k, e in out]


def test_base_spans(spark, odd, none):
    rng = random.Random(4)
    bits = ["password", "=", ":", " ", "'", '"', "TOKEN", "api_key", "secret", "abcdefabcdef", "0123456789", "AKIA", "ABCDEFGHIJ1234", "é", "日", "x-y", "\n", "passwd", "apikey"]
    made = spark.createDataFrame([(i, "".join(rng.choice(bits) for _ in range(rng.randint(0, 14)))) for i in range(400)], "doc_id long, text string")
    for docs in (spark.read.parquet(f"{MEDIUM}/documents.parquet"), odd, made):
        got = secrets.scan(docs, "doc_id").select("doc_id", secrets.listing(F.col("base")).alias("b"), secrets.listing(F.col("found")).alias("f")).collect()
        assert sorted((str(r["doc_id"]), r["b"]) for r in got) == sorted((str(k), ",".join(brute_base(t))) for k, t in pairs(docs))
        assert all(set(r["b"].split(",")) - {""} <= set(r["f"].split(",")) for r in got)
    assert secrets.scan(none, "doc_id").count() == 0 and secrets.redact(none).count() == 0


def test_battery_against_plain_python(spark):
    rng = random.Random(8)
    values = ["".join(rng.choice(a) for _ in range(n)) for a in secrets.ALPHABETS.values() for n in (20, 33, 64)] + ["a" * 30, "internationalisationandmore", "abcdefghijklmnopqrstuvwxyz"]
    for r in secrets.battery(spark.createDataFrame([(v,) for v in values], "value string")).collect():
        a = secrets.ALPHABETS[r["encoding"]]
        x = np.array([a.index(c) + 1.0 for c in r["value"]])
        n, m = len(x), len(a)
        counts = np.array([r["value"].count(c) for c in a], float)
        assert abs(r["z_chi"] - (((counts - n / m) ** 2 / (n / m)).sum() - (m - 1)) / np.sqrt(2 * (m - 1) * (n - 1) / n)) < 1e-9
        d = x - x.mean()
        serial = (d[1:] * d[:-1]).sum() / (d**2).sum() * np.sqrt(n) if (d**2).sum() else np.sqrt(n)
        assert abs(r["z_serial"] - serial) < 1e-9
        hi = x > m / 2
        mix = 2 * hi.sum() * (~hi).sum()
        spread = mix * (mix - n) / (n * n * (n - 1))
        runs = 1 + (hi[1:] != hi[:-1]).sum()
        assert abs(r["z_runs"] - ((runs - 1 - mix / n) / np.sqrt(spread) if spread > 0 else -np.sqrt(n))) < 1e-9
        assert r["equal"] == (counts * (counts - 1)).sum() / 2


def test_random_strings_are_found_and_language_is_not(spark):
    rng = random.Random(21)
    base64 = secrets.ALPHABETS["base64"][:62]
    rows = [(i, f"key {''.join(rng.choice(base64) for _ in range(40))} end") for i in range(30)]
    rows += [(100 + i, " ".join(w * 3 for w in ("internationally", "responsibility", "thunderstorms"))) for i in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["f"] for r in secrets.scan(docs, "doc_id").select("doc_id", secrets.listing(F.col("found")).alias("f")).collect()}
    assert sum(got[i] == "random:4:44" for i in range(30)) >= 28 and not any(got[100 + i] for i in range(30))
    masked = {r["doc_id"]: r["text"] for r in secrets.redact(docs).collect()}
    assert sum(masked[i] == "key [SECRET] end" for i in range(30)) >= 28 and masked[100] == rows[30][1]


def test_random_strings_of_every_alphabet_are_found(spark):
    rng = random.Random(22)
    kinds = [(a, 64) for a in secrets.ALPHABETS] + [("HEX", 32), ("HEX", 40), ("HEX", 128)]
    rows = [(100 * k + i, f"key {''.join(rng.choice(secrets.ALPHABETS[a]) for _ in range(n))} end") for k, (a, n) in enumerate(kinds) for i in range(30)]
    rows += [(-1 - i, t) for i, t in enumerate(["DEADBEEFDEADBEEFCAFE FACADEDECADEFACADEDECADE", "ACCEDEDBEADEDDEFACEDFADED", "internationalresponsibility"])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["f"].split(",") for r in secrets.scan(docs, "doc_id").select("doc_id", secrets.listing(F.col("found")).alias("f")).collect()}
    found = {kind: sum(any(s.endswith(f":4:{4 + kind[1]}") for s in got[100 * k + i]) for i in range(30)) for k, kind in enumerate(kinds)}
    assert min(found.values()) >= 28 and not any(got[k] != [""] for k in (-1, -2, -3)), found


def test_redact_overlaps(spark, odd):
    t = "é password=0123456789abcdef0123 and 0123456789abcdef."
    docs = spark.createDataFrame([(1, t, "k"), (2, None, "k"), (3, "plain", None)], "doc_id long, text string, source string")
    assert {r["doc_id"]: r["text"] for r in secrets.redact(docs).collect()} == {1: "é [SECRET] and [SECRET].", 2: None, 3: "plain"}
    kept = secrets.redact(odd)
    assert kept.columns == odd.columns and kept.count() == odd.count() and all([r[c] for c in CLASHES] == CLASHES for r in kept.collect())


def brute_random(texts, shortest=20):
    """Every accepted random span: the battery, its deviates from language and the length-aware step-up, in plain Python."""
    import math

    def upper(z):
        return 0.5 * math.erfc(z / math.sqrt(2))

    spans, values = [], {}
    for k, t in texts:
        base = [tuple(map(int, s.split(":")[1:])) for s in brute_base(t)]
        for m in re.finditer(r"[A-Za-z0-9+/_=-]{%d,}" % shortest, t):
            if not any(a < m.end() and m.start() < b for a, b in base):
                spans.append((k, m.start(), m.end(), m.group()))
                values[m.group()] = None
    for v in values:
        w = v.rstrip("=")
        w = w if len(w) > 1 else v
        name, a = next(((k, a) for k, a in secrets.ALPHABETS.items() if k != "base64" and set(w) <= set(a)), ("base64", secrets.ALPHABETS["base64"]))
        n, m, x = len(w), len(a), [a.find(c) + 1.0 for c in w]
        square, mean = sum(w.count(c) ** 2 for c in a), sum(x) / n
        var, cov = sum((y - mean) ** 2 for y in x), sum((y - mean) * (z - mean) for y, z in zip(x, x[1:]))
        high = sum(y > m / 2 for y in x)
        mix = 2 * high * (n - high)
        spread = mix * (mix - n) / (n * n * max(n - 1, 1))
        turns = 1 + sum((y > m / 2) != (z > m / 2) for y, z in zip(x, x[1:]))
        chi = (m / n * square - n - (m - 1)) / math.sqrt(2 * (m - 1) * (n - 1) / n)
        runs = (turns - 1 - mix / n) / math.sqrt(spread) if spread > 0 else -math.sqrt(n)
        serial = cov / var * math.sqrt(n) if var > 0 else math.sqrt(n)
        p = min(1, 3 * min(upper(chi), 2 * upper(abs(runs)), 2 * upper(abs(serial))))
        values[v] = (name, n, m, n * (n - 1) / 2, (square - n) / 2, runs, serial, p)
    if not values:
        return {}
    lower = [v for v in values.values() if v[0] == "lower"]
    rate = max(0.065, sum(v[4] for v in lower) / sum(v[3] for v in lower)) if lower else 0.065
    drift = {}
    for name in {v[0] for v in values.values()}:
        bad = [v for v in values.values() if v[0] == name and v[7] < 0.001]
        drift[name] = [sum(max(-0.25, min(0.25, v[i] / math.sqrt(v[1]))) for v in bad) / len(bad) if bad else 0.0 for i in (5, 6)]
    size = sum(v[1] for v in values.values()) / len(values)
    steps = {}
    for s, (name, n, m, pairs_, equal, runs, serial, p) in values.items():
        r = max(rate, 0.26) if m == 16 else rate
        spread = math.sqrt(pairs_ * r * (1 - r))
        shifts = [max(0.0, pairs_ * (r - 1 / m) / spread), drift[name][0] * math.sqrt(n), drift[name][1] * math.sqrt(n)]
        away = [(pairs_ * r - equal) / spread, shifts[1] - runs, shifts[2] - serial]
        norm = math.sqrt(sum(w * w for w in shifts))
        z = sum(a * w for a, w in zip(away, shifts)) / norm if norm else 0.0
        q = max(upper(z), 1e-300) / (n / size)
        steps[s] = (min(30000, max(0, math.floor(-100 * math.log10(q)))), p)
    ranked = sorted((t for t, _ in steps.values()), reverse=True)
    best = min((t for t in ranked if 10 ** (-t / 100) <= 0.01 * sum(u >= t for u in ranked) / len(ranked)), default=None)
    out = defaultdict(list)
    for k, i, j, s in spans:
        if best is not None and steps[s][0] >= best and steps[s][1] >= 0.001:
            out[k].append(f"random:{i}:{j}")
    return out


def test_all_random_spans_against_plain_python(spark):
    rng = random.Random(31)
    names = list(secrets.ALPHABETS)
    made = [(i, " ".join(["key", "".join(rng.choice(secrets.ALPHABETS[names[i % 6]]) for _ in range(rng.randint(20, 60))), rng.choice(("internationally" * 2, "aaaaaaaaaaaaaaaaaaaaaaaaa", "x", "ab" * 15, "thequickbrownfoxjumpsoverthelazydog"))])) for i in range(120)]
    for docs in (spark.createDataFrame(made, "doc_id long, text string"), spark.read.parquet(f"{MEDIUM}/documents.parquet")):
        got = {r["doc_id"]: [s for s in r["f"].split(",") if s.startswith("random")] for r in secrets.scan(docs, "doc_id").select("doc_id", secrets.listing(F.col("found")).alias("f")).collect()}
        want = brute_random(pairs(docs))
        assert {k: v for k, v in got.items() if v} == dict(want)


# 10 --------------------------------------------------------------------------------------------------
def brute_sets(rows):
    out = {}
    for n, (k, t) in enumerate(rows):
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), t))
        out[n] = (k, frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset())
    return out


def brute_components(rows, percent=75):
    sets = brute_sets(rows)
    parent = {k: k for k, _ in sets.values()}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    holders = defaultdict(list)
    for n, (_, s) in sets.items():
        for g in s:
            holders[g].append(n)
    seen = defaultdict(int)
    for h in holders.values():
        for i, a in enumerate(h):
            for b in h[i + 1 :]:
                seen[a, b] += 1
    for (a, b), i in seen.items():
        if 100 * i >= percent * (len(sets[a][1]) + len(sets[b][1]) - i):
            x, y = find(sets[a][0]), find(sets[b][0])
            parent[max(x, y)] = min(x, y)
    return sorted((k, len(s), find(k)) for k, s in sets.values())


def near_copies(seed, n=400):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(3000)]
    bases = [[rng.choice(vocabulary) for _ in range(rng.choice((1, 3, 5, 7, 9, 20, 60, 200)))] for _ in range(12)]
    common = [rng.choice(vocabulary) for _ in range(30)]
    rows = []
    for i in range(n):
        w = list(rng.choice(bases))
        for _ in range(rng.choice((0, 0, 1, 1, 2, 3, len(w) // 20))):
            w[rng.randrange(len(w))] = rng.choice(vocabulary)
        if rng.random() < 0.3:
            w = common + w
        rows.append((i, " ".join(w)))
    return rows


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_components_of_near_copies(spark, seed, monkeypatch):
    monkeypatch.setattr(shingle_join, "RARE", 4 if seed > 1 else 32)
    rows = near_copies(seed)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, shingle_join.components(docs).collect())) == brute_components(rows)


def test_components_of_documents(spark, odd, none):
    docs = spark.read.parquet(f"{MEDIUM}/documents.parquet")
    assert sorted(map(tuple, shingle_join.components(docs).collect())) == brute_components(pairs(docs))
    known = odd.where("doc_id IS NOT NULL")
    assert sorted(map(tuple, shingle_join.components(known).collect())) == brute_components(pairs(known))
    assert shingle_join.components(odd).count() == odd.count() and shingle_join.components(none).count() == 0
    kept = shingle_join.keep_one(odd)
    assert kept.columns == odd.columns
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(["1", "3", "4", "5", "6", "8", "10", "None"])


def test_other_similarities(spark):
    rows = [(0, "a b c d e f"), (1, "a b c d e f g"), (2, "z a b c d e f g"), (3, "q r s t u"), (4, "q r s t u v"), (5, "only these")] + near_copies(4, 120)[6:]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for percent in (50, 60, 90):
        assert sorted(map(tuple, shingle_join.components(docs, percent).collect())) == brute_components(rows, percent)


def test_nameless_rows_connect(spark):
    w = [f"w{i}" for i in range(60)]
    change = lambda *at: " ".join("x" if i in at else x for i, x in enumerate(w))
    rows = [(1, change()), (None, change(0, 59)), (3, change(0, 1, 2, 3, 58, 59)), (None, "no name and no link at all"), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    named = {n: r for n, r in enumerate(rows)}
    want = brute_components([(n, t or "") for n, (_, t) in named.items()])
    assert want[2][2] == want[1][2] == 0  # 1 and 3 meet through the row without an id
    got = sorted(((r["doc_id"], r["component_id"]) for r in shingle_join.components(docs).collect()), key=str)
    assert got == [(1, 1), (3, 1), (None, 1), (None, None), (None, None)]


def test_keep_one_by_a_shuffled_join(spark, odd, monkeypatch):
    want = sorted(map(str, shingle_join.keep_one(odd).collect()))
    joined = shingle_join.join_small
    monkeypatch.setattr(shingle_join, "join_small", lambda *a: joined(*a, most=0))
    assert sorted(map(str, shingle_join.keep_one(odd).collect())) == want


def test_the_join_shuffles_no_texts_and_counts_by_itself(spark, monkeypatch):
    """With no broadcast, as on large tables: bytes of shuffle files of the step that makes sets, and of the index's steps."""
    import os

    rng = random.Random(5)
    rows = [(i, " ".join(f"w{rng.randrange(10**6)}" for _ in range(300))) for i in range(600)]
    rows += [(1000 + i, rows[i][1].upper() + " more") for i in range(30)] + [(None, rows[40][1] + " more"), (None, rows[40][1] + " more"), (0, rows[0][1]), (0, "another text of the id")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    blocks = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def written(run):
        files = lambda: set(re.findall(r"/[^ ,()]*shuffle_\d+_\d+_\d+\.data", blocks.getAllFiles().mkString(" ")))
        before = files()
        run()
        return sum(os.path.getsize(f) for f in files() - before)

    steps, stored = {}, shingle_join.stored

    def measured(df, name):
        steps[name] = written(lambda: df.write.format("noop").mode("overwrite").save())
        return stored(df, name)

    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        docs = stored(docs, "docs")
        kept = stored(shingle_join.alive(docs, stored(shingle_join.members(docs), "members")), "alive")
        for size in (shingle_join.SLOTS, 64):  # few bits let nearly all through; the join drops it
            got = {r["node"]: r["tokens"] for r in shingle_join.sets_of(docs, kept, size).collect()}
            want = {shingle_join.node_of(t): t.view(np.int64).tolist() for t in (shingle_join.shingles(t) for _, t in rows)}
            assert got == {k: want[k] for k in (r["node"] for r in kept.collect())} and len(got) >= 62
        made = written(lambda: shingle_join.sets_of(docs, kept).write.format("noop").mode("overwrite").save())
        assert made < 0.3 * sum(len(t) for _, t in rows)
        sets = stored(shingle_join.sets_of(docs, kept), "sets")
        monkeypatch.setattr(shingle_join, "stored", measured)
        shingle_join.indexed(sets).count()
        assert max(steps.values()) < 0.85 * sum(steps.values()), steps
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_signatures_share_whenever_sets_link():
    rng = random.Random(9)
    for _ in range(4000):
        n = rng.randint(3, 60)
        x = rng.sample(range(1000), n)
        y = x[: n - rng.randint(0, n // 4)] + [2000 + i for i in range(rng.randint(0, n // 4))]
        i, u = len(set(x) & set(y)), len(set(x) | set(y))
        if 100 * i < 75 * u:
            continue
        rare = lambda t: t % 3 == 0 or t >= 2000
        found = []
        for s in (x, y):
            r, f = sorted(t << 20 for t in s if rare(t)), sorted(t << 20 for t in s if not rare(t))
            found.append({g for level in shingle_join.levels(len(s)) for g in shingle_join.signatures(0, r, f, len(s), level)})
        assert found[0] & found[1], (x, y)


def test_entry_lists_all():
    assert {re.match(r"op\d+", k).group() for k in queries.queries()} == {f"op{i}" for i in range(1, 14)}


# common ----------------------------------------------------------------------------------------------
def test_stored_folders_go_unless_kept(spark):
    from lodestone.llm import common

    with common.scratch(spark) as keep:
        one, two = common.stored(spark.range(5), "one"), common.stored(spark.range(7), "two")
        keep.append(two.where("id > 2"))
    assert two.count() == 7 and len(common.folders(two)) == 1
    with pytest.raises(Exception):
        spark.read.parquet(*one.inputFiles()).count()
    common.drop_stored(two)
    assert common.fresh(spark.createDataFrame([(1, 2)], "A int, _a int"), "a", "b") == ["__a", "b"]
    wide = spark.createDataFrame([(1, "é" * 50, [1, 2, 3]), (None, None, None)], "k long, s string, a array<long>")
    assert common.size_bound(wide) >= 8 * 3 + 100 and common.size_bound(wide.limit(0)) == 0


def test_stored_leaves_no_shuffle_files(spark):
    import time

    from lodestone.llm import common

    blocks = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    held = lambda: set(re.findall(r"shuffle_\d+_\d+_\d+\.data", blocks.getAllFiles().mkString(" ")))
    before, setting = held(), spark.conf.get(key := "spark.sql.classic.shuffleDependency.fileCleanup.enabled", None)
    out = common.stored(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count(), "counts")
    end = time.time() + 20
    while held() - before and time.time() < end:
        time.sleep(0.2)
    assert not held() - before and out.count() == 7
    assert spark.conf.get(key, None) == setting


# pipeline --------------------------------------------------------------------------------------------
def test_pipeline_against_brute_force(spark):
    """Every stage on its own input, at sf0.001: decisions and texts from plain Python."""
    import corpus_pipeline

    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    stage = dict(corpus_pipeline.STAGES)
    labels = spark.read.parquet(f"{SMALL}/labels.parquet")
    good = stage["quality"](spark, docs, SMALL).cache()
    scores = {r["doc_id"]: r["score"] for r in quality.classify(docs, labels).collect()}
    assert {r["doc_id"] for r in good.collect()} == {k for k, s in scores.items() if s >= 0.7}
    single = stage["near_duplicates"](spark, good, SMALL).cache()
    assert sorted(r["doc_id"] for r in single.collect()) == sorted({c for _, _, c in brute_components(pairs(good))})
    masked = stage["secrets"](spark, single, SMALL).cache()
    before, after = dict(pairs(single)), dict(pairs(masked))
    assert before.keys() == after.keys()
    for k, t in before.items():
        cut = [(int(s.split(":")[1]), int(s.split(":")[2])) for s in brute_base(t)]
        assert (after[k] == t) if not cut else ("[SECRET]" in after[k] and all(t[s:e] not in after[k] for s, e in cut))
    mixed = stage["mixing"](spark, masked, SMALL).cache()
    _, drawn, _ = brute_mix([(r["doc_id"], r["source"], r["text"]) for r in masked.collect()])
    assert sorted(r["doc_id"] for r in mixed.collect()) == sorted(d[0] for d in drawn)
    for s in (good, single, masked, mixed):
        assert s.columns == docs.columns
    library = Tokenizer.from_file(PATH)
    rows = stage["packing"](spark, mixed, SMALL).collect()
    want = sorted((k, len(library.encode(t, add_special_tokens=False).ids) + 1) for k, t in pairs(mixed))
    assert sorted((r["doc_id"], r["doc_tokens"]) for r in rows if r["start"] == 0) == want
    assert sum(r["length"] for r in rows) == sum(n for _, n in want)
    assert corpus_pipeline.run(spark, SMALL).count() == len(rows)


def test_stages_take_awkward_rows(spark, odd, none):
    import corpus_pipeline

    for docs in (odd, none):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, SMALL)
            if name == "packing":
                assert out.where("start = 0").count() == docs.count()
            else:
                assert out.columns == docs.columns and all([r[c] for c in CLASHES] == CLASHES for r in out.collect())
