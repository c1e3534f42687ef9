"""Exact dedup, phrase collocations and the filter audit against plain Python."""

import hashlib
import random
import re
from collections import Counter, defaultdict
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.llm import collocations, exact_dedup, filter_audit
from lodestone.llm.common import tune
from tests.conftest import SMALL
from tests.llm.test_operators import none, odd  # noqa: F401  (fixtures)

LOWER = {c: c + 32 for c in range(65, 91)}


def made(spark, rows):
    tune(spark)
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")


def listed(df, *cols):
    return sorted((tuple(r) for r in df.select(*cols).collect()), key=str)


# 11 --------------------------------------------------------------------------------------------------
def plain_dedup(rows):
    by = defaultdict(list)
    for k, t in rows:
        by[(t or "").translate(LOWER)].append(k)
    out = []
    for t, ks in by.items():
        keep, left = max((k for k in ks if k is not None), default=None), 1
        for k in ks:
            out.append((k, keep, len(ks), k == keep and left > 0, hashlib.sha256(t.encode()).hexdigest()))
            left -= k == keep
    return sorted(out, key=str)


COLUMNS = ("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def test_perfect_hash_is_minimal():
    rng = np.random.default_rng(3)
    for n in (0, 1, 2, 63, 64, 5000):
        keys = rng.integers(0, 1 << 63, (n, 4), np.int64).astype(np.uint64)
        h = exact_dedup.PerfectHash.build(keys)
        assert sorted(h.slots(keys).tolist()) == list(range(n)) and (n < 1000 or 64 * len(h.bits) < 4.2 * n)
        other = h.slots(rng.integers(0, 1 << 63, (100, 4), np.int64).astype(np.uint64))
        assert ((other >= -1) & (other < max(n, 1))).all()
    close = np.array([[1, 2, 3, k] for k in range(500)], np.uint64)  # keys that differ in one word only
    assert sorted(exact_dedup.PerfectHash.build(close).slots(close).tolist()) == list(range(500))
    with pytest.raises(ValueError):
        exact_dedup.PerfectHash.build(np.array([[1, 2, 3, 4]] * 2, np.uint64))


@pytest.mark.parametrize("earlier", [None, "false", "true", "doc_id % 3 = 1"])
def test_dedup_of_awkward_rows(spark, odd, none, earlier):  # noqa: F811
    tune(spark)
    past = None if earlier is None else F.expr(earlier)
    assert listed(exact_dedup.dedup(odd, past), *COLUMNS) == plain_dedup([(r["doc_id"], r["text"]) for r in odd.collect()])
    assert exact_dedup.dedup(none, past).count() == 0


def test_dedup_with_many_shards_replicas_and_a_hot_text(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup, "SLOTS", 16)
    monkeypatch.setattr(exact_dedup, "LOOKUPS", 1)
    monkeypatch.setattr(exact_dedup, "HOT", 50)
    rng = random.Random(1)
    rows = [(k, "hot" if k % 3 == 0 else f"É{'ab'[k % 2]}{rng.randrange(300)}", None, None) for k in range(900)] + [(None, "hot", None, None), (None, "nameless", None, None)]
    df = made(spark, rows).repartition(7)
    assert listed(exact_dedup.dedup(df, F.col("doc_id") < 60), *COLUMNS) == plain_dedup([r[:2] for r in rows])


def test_members_are_checked_byte_for_byte(spark):
    rows = lambda lo, hi: exact_dedup.groups(exact_dedup.digested(made(spark, [(k, f"t{k}", None, None) for k in range(lo, hi)])))
    got = exact_dedup.merge(exact_dedup.build_index(rows(0, 400)), rows(350, 800)).collect()
    assert sum(r["known"] for r in got) == 400 and sorted(r["doc_id"] for r in got) == list(range(800)) and {r["n"] for r in got} == {1, 2}


# 12 --------------------------------------------------------------------------------------------------
def plain_collocations(rows, least, top):
    f, n, out = defaultdict(Counter), Counter(), []
    for t, lang in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (t or "").translate(LOWER)):
            ws = re.findall(r"[^\x20\x09]+", piece)
            n[lang or ("und" if lang is None else lang)] += len(ws)
            for size in range(1, 5):
                f["und" if lang is None else lang].update(tuple(ws[i : i + size]) for i in range(len(ws) - size + 1))
    for lang, c in f.items():
        often = {p: a for p, a in c.items() if a >= least}
        covered = {p[i : i + s] for p, a in often.items() for s in range(2, len(p)) for i in range(len(p) - s + 1) if 100 * a >= 80 * often[p[i : i + s]]}
        found = []
        for p, a in often.items():
            if len(p) > 1 and p not in covered:
                score, k = min((2000000 * a // (c[p[:k]] + c[p[k:]]), k) for k in range(1, len(p)))
                found.append((-score, -a, " ".join(p).encode(), c[p[:k]], c[p[k:]]))
        out += [(lang, i, t.decode(), -a, lo, r, n[lang], -s) for i, (s, a, t, lo, r) in enumerate(sorted(found)[:top], 1)]
    return sorted(out, key=str)


PHRASES = ("lang", "rank", "phrase", "a", "l", "r", "n", "score")


@pytest.mark.parametrize("block", [40, 300, collocations.BLOCK])
def test_collocations_against_plain_python(spark, block):
    """Small blocks cut texts in parts; words hold the bytes 0 to 2, and one text holds most rows' words."""
    rng = random.Random(block)
    words = ["a", "b", "A", "é", "日本", "\x00", "\x01", "a\x01", "a\x00b", "\x02", "b\x1c", "the", "of", "#x"]
    text = lambda m: "".join(rng.choice(words) + rng.choice([" ", " ", " ", "\t", "  ", ". ", "\n", ",", "!"]) for _ in range(m))
    rows = [(i, text(rng.randrange(40)), rng.choice(["en", "de", None, "", "e\x00n"]), None) for i in range(120)]
    rows += [(200, text(3000).replace(".", " "), "en", None), (201, None, "en", None), (202, "", None, None), (203, " . ,", "zz", None), *[(204, "of the a b", "en", None)] * 40]
    for least, top in ((4, 25), (3, 10**6)):
        got = listed(collocations.collocations(made(spark, rows).repartition(5), least, top, block), *PHRASES)
        assert got == plain_collocations([(t, lang) for _, t, lang, _ in rows], least, top) and len(got) > 40


def test_collocations_of_awkward_tables(spark, odd, none):  # noqa: F811
    tune(spark)
    got = listed(collocations.collocations(odd, 2), *PHRASES)
    assert got == plain_collocations([(r["text"], r["lang"]) for r in odd.collect()], 2, 2000) and got
    assert collocations.collocations(none).count() == 0


def test_bitmap_misses_nothing_when_full(spark):
    rows = [(i, f"w{i % 90} x{i % 70} y{i % 50} z.", "en", None) for i in range(3000)]
    got = listed(collocations.collocations(made(spark, rows), bits=64), *PHRASES)
    assert got == plain_collocations([(t, lang) for _, t, lang, _ in rows], 30, 2000)


# 13 --------------------------------------------------------------------------------------------------
def plain_audit(rows, labels):
    first, cells = {}, defaultdict(Counter)
    for k, t, _ in rows:
        if k is not None:
            first[t or ""] = min(k, first.get(t or "", k))
    masks = defaultdict(list)
    for k, t, s in rows:
        t = t or ""
        ws = re.findall(r"[^\x20\x09-\x0D]+", t)
        bad = [len(ws) < 200, 100 * len(set(ws)) < 50 * len(ws), 100 * sum("A" <= c <= "Z" for c in t) > 2 * len(t), bool(re.search("[#$%&*|]", t)), k is not None and k > first[t]]
        mine = [x for x in labels if k is not None and x[0] == k]
        masks[s or ""].append(({x for x, b in zip("ABCDE", bad, strict=True) if b}, any(x[1] == 1 for x in mine), any(x[2] == 1 for x in mine)))
    out = []
    for part, ms in masks.items():
        cells = {}
        for order in map("".join, permutations("ABCDE")):
            for step, f in enumerate(order, 1):
                prior = set(order[: step - 1])
                here = [m for m in ms if f in m[0] and not m[0] & prior]
                cells[order, step] = (sum(not m[0] & (prior | {f}) for m in ms), len(here), sum(f in m[0] and bool(m[0] & prior) for m in ms), sum(m[0] == {f} for m in ms), sum(m[1] for m in here), sum(m[2] for m in here))
        share = Counter()
        for (order, step), c in cells.items():
            share[order[step - 1]] += c[1]
        out += [(part, order, step, *c, share[order[step - 1]]) for (order, step), c in cells.items()]
    return sorted(out, key=str)


AUDIT = ("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def test_audit_of_awkward_rows(spark, odd, none):  # noqa: F811
    tune(spark)
    labels = [(1, 1, 0), (2, 0, 1), (2, 1, None), (None, 1, 1), (6, None, 1), (7, 1, 1), (99, 1, 1)]
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = listed(filter_audit.audit(odd, marks), *AUDIT)
    assert got == plain_audit([(r["doc_id"], r["text"], r["source"]) for r in odd.collect()], labels)
    assert filter_audit.audit(none, marks).count() == 0
    assert listed(filter_audit.audit(odd, marks.limit(0)), "kept") == listed(filter_audit.audit(odd, marks), "kept")


@pytest.fixture
def uncoalesced(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_runs_that_cross_partitions(spark, uncoalesced):
    """A text with most rows lies in several ranges: only its smallest doc_id is no copy."""
    rows = [(k, "same text" if k % 4 else f"own {k % 60}", None, "s") for k in range(1, 2000)] + [(1, "same text", None, "s"), (None, "same text", None, "s")]
    df = made(spark, rows).repartition(6)
    masked = filter_audit.masks(df, filter_audit.conditions())
    late = Counter((r["doc_id"]) for r in masked.collect() if r["mask"] & 16)
    smallest = {}
    for k, t, *_ in rows:
        if k is not None:
            smallest[t] = min(k, smallest.get(t, k))
    assert late == Counter(k for k, t, *_ in rows if k is not None and k > smallest[t])
    scanned = filter_audit.scanned(df, filter_audit.conditions())
    same = hashlib.sha256(b"same text").digest()
    assert scanned.where("part IS NULL").where(scanned["fingerprint"] == same).count() > 1  # the run does cross a boundary


def test_audit_of_documents(spark):
    docs, labels = (spark.read.parquet(f"{SMALL}/{t}.parquet") for t in ("documents", "labels"))
    got = listed(filter_audit.audit(docs, labels), *AUDIT)
    assert got == plain_audit([(r["doc_id"], r["text"], r["source"]) for r in docs.collect()], [(r["doc_id"], r["quality"], r["toxic"]) for r in labels.collect()])
