"""The engine's own operators: goldens, plain-Python folds and determinism."""

import json
import math
import random
import threading
import time

import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from lodestone import schema as S
from lodestone.functions import paths as P
from lodestone.functions import scores as K
from lodestone.functions import text as T
from lodestone.operators import corpus as C
from lodestone.operators import estimate as E
from lodestone.operators import metrics as M
from lodestone.operators import sampling, selection
from lodestone.operators import windows as W
from lodestone.plans import prepare, scan, score, service
from lodestone.sources import frontier, jsonl, manifest, tree


def column(spark, values, f, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r["o"] for r in rows.select("i", f(F.col("v")).alias("o")).orderBy("i").collect()]


def normalize(spark, values):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, text string")
    return [r["text"] for r in T.normalized(rows).orderBy("i").collect()]


# --- text ---------------------------------------------------------------------------------------------
def test_normalize(spark):
    assert normalize(spark, ["﻿\r\n  café  \r\n next\t\r\n\r\n", "  \n\t", "x\0", "", "a b \r c", None, "﻿﻿x"]) == ["  café\n next\n", "", None, "", "a b\n c\n", None, "﻿x\n"]


def test_generated(spark):
    got = column(spark, ["// Code generated by protoc-gen-go. DO NOT EDIT.\nx", "/* @generated */\n", "x" * 8192, "fn main() {\n}\n" * 500, "const A = 1;"], T.looks_generated)
    assert got == [True, True, True, False, False]


def plain_chunks(text, most):
    """The cutting rule line by line: whole lines together, longer ones at fixed widths on their own."""
    if len(text) <= most:
        return [text]
    out, open_ = [], ""
    for line in text.splitlines(keepends=True) if T.BREAKS.search(text) else text.replace("\n", "\n\x00").split("\x00"):
        if len(line) > most or len(open_) + len(line) > most:
            out += [open_] if open_ else []
            open_ = ""
        if len(line) > most:
            out += [line[i : i + most] for i in range(0, len(line), most)]
        else:
            open_ += line
    return out + ([open_] if open_ else [])


def test_chunks(spark):
    rng = random.Random(3)
    texts = ["", "abc", "a" * 25 + "\nb", "abcdefghij\nx", "line one\nline two\nthree\x0bfour is long", "\n\n\n" * 9] + ["".join(rng.choice("ab\n") for _ in range(rng.randint(0, 80))) for _ in range(300)]
    for t in texts:
        assert T.cut_text(t, 10) == plain_chunks(t, 10), t
        assert "".join(T.cut_text(t, 10)) == t
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
    got = {}
    for r in T.chunked(df, 10).orderBy("i", "chunk_index").collect():
        got.setdefault(r["i"], []).append(r["text"])
    assert got == {i: plain_chunks(t, 10) for i, t in enumerate(texts)}
    with pytest.raises(ValueError):
        T.chunked(df, 0)
    with pytest.raises(ValueError):
        T.cut_text("abc", 0)


def test_windows(spark):
    def plain(ids, size, overlap):
        out, at = [], 0
        while ids:
            out.append(ids[at : at + size])
            if at + size >= len(ids):
                break
            at += size - overlap
        return out

    for size, overlap in ((4, 1), (3, 0), (7, 6), (1, 0)):
        got = column(spark, [list(range(n)) for n in range(25)], lambda v, s=size, o=overlap: T.token_windows(v, s, o), "array<int>")
        assert [g or [] for g in got] == [plain(list(range(n)), size, overlap) for n in range(25)]
    assert T.window_capacity(10, 2) == 8
    for bad in (lambda: T.token_windows("x", 4, 4), lambda: T.window_capacity(2, 2)):
        with pytest.raises(ValueError):
            bad()


def test_weights_and_scores(spark):
    w = spark.createDataFrame([("a", 0), ("b", 0), ("b", 1), ("b", 2)], "record_id string, window_index int")
    got = {r["record_id"]: r["sample_weight"] for r in W.window_weights(w).collect()}
    assert got == {"a": 2.0, "b": pytest.approx(2 / 3)}
    assert spark.range(1).select(K.softmax_ai(F.lit(1001.0), F.lit(1000.0)).alias("p")).first()["p"] == pytest.approx(0.26894143, abs=1e-6)


# --- corpus -------------------------------------------------------------------------------------------
def fold_dedup(rows):
    """Record by record: (kept ids, duplicates, conflicts)."""
    first, bad, dup, conflict = {}, set(), 0, 0
    for i, h, label in rows:
        if h in bad:
            conflict += 1
        elif h not in first:
            first[h] = (i, label)
        elif first[h][1] == label:
            dup += 1
        else:
            conflict += 1
            bad.add(h)
    return sorted(i for h, (i, _) in first.items() if h not in bad), dup - 0, conflict


def records(spark, rows):
    made = [(i, f"h{h}", label, ("train", "validation", "test")[i * 3 // max(1, len(rows))], 0, f"p/{i:05d}", 0, str(i), "l") for i, h, label in rows]
    return spark.createDataFrame(made, "n int, text_sha256 string, label int, split string, source_ord int, path string, chunk_index int, id string, language string")


def test_dedup_against_fold(spark):
    rng = random.Random(7)
    for size in (0, 1, 5, 400):
        rows = [(i, rng.randint(0, max(1, size // 4)), int(rng.random() < 0.2)) for i in range(size)]
        df = records(spark, rows)
        kept, dup, conflict = fold_dedup(rows)
        # groups of one label count n - 1 duplicates; with disagreement at p they count p - 2
        assert sorted(r["n"] for r in C.deduplicated(df).collect()) == kept
        s = C.dedup_stats(df).first()
        groups = {}
        for _, h, label in rows:
            groups.setdefault(h, []).append(label)
        d = c = 0
        for g in groups.values():
            p = next((k for k, x in enumerate(g, 1) if x != g[0]), None)
            d, c = (d + len(g) - 1, c) if p is None else (d + p - 2, c + len(g) - p + 1)
        assert (s["duplicate_count"], s["conflict_count"], s["kept"]) == (d, c, len(kept)) and (dup, conflict) == (d, c)


def test_train_wins_and_component_order(spark):
    rows = [("test", "a/x"), ("train", "a-b/x"), ("train", "a/x")]
    df = spark.createDataFrame([(s, "h", 1, 0, p, 0) for s, p in rows], "split string, text_sha256 string, label int, source_ord int, path string, chunk_index int")
    got = C.deduplicated(df).collect()
    assert [(r["split"], r["path"]) for r in got] == [("train", "a/x")]


def test_balance(spark):
    import hashlib

    rng = random.Random(5)
    rows = [(str(i), rng.choice(("train", "test")), rng.choice("abc"), int(rng.random() < 0.3)) for i in range(300)] + [("only", "train", "z", 1)]
    df = spark.createDataFrame(rows, "id string, split string, language string, label int")
    sha = lambda *p: hashlib.sha256("\0".join(p).encode()).hexdigest()
    want = []
    for s in ("train", "test"):
        for lang in "abcz":
            g = [[r[0] for r in rows if r[1:] == (s, lang, k)] for k in (0, 1)]
            n = min(map(len, g))
            for ids in g:
                want += sorted(ids, key=lambda i, s=s, lang=lang: sha(f"seed-{s}", lang, i))[:n]
    for parts in (1, 40):
        got = C.balanced(df.repartition(parts), "seed")
        assert sorted(r["id"] for r in got.collect()) == sorted(want)
    assert {r["id"]: r["output_key"] for r in got.collect()}[want[0]] in {sha(f"seed-{s}", "output", want[0]) for s in ("train", "test")}
    with pytest.raises(ValueError):
        C.check_balance(df.where("split = 'train' AND label = 1"))


def test_pairs(spark):
    rows = [(i, lang, label) for i, (lang, label) in enumerate([("a", 0), ("b", 1), ("a", 0), ("b", 0), ("a", 1), ("c", 1), ("a", 1), ("b", 1)])]
    df = spark.createDataFrame(rows, "position long, language string, label int")
    assert sorted(r["position"] for r in C.truncated_pairs(df, 5).collect()) == [0, 1, 3, 4]
    assert sorted(r["position"] for r in C.truncated_pairs(df, 99, per=2).collect()) == [0, 1, 2, 3, 4, 6]
    with pytest.raises(ValueError):
        C.truncated_pairs(df, 1)
    assert C.only_language(df, "A").count() == 4
    with pytest.raises(ValueError, match="a, b, c"):
        C.only_language(df, "zig")


# --- metrics ------------------------------------------------------------------------------------------
def test_metrics(spark):
    rng = random.Random(2)
    for n in (1, 7, 200):
        rows = [(int(rng.random() < 0.4), rng.randint(0, 20) / 20) for _ in range(n)] + [(1, 0.5), (0, 0.5)]
        df = spark.createDataFrame(rows, "label int, score double")
        pos, neg = [s for k, s in rows if k], [s for k, s in rows if not k]
        auc = sum((p > q) + (p == q) / 2 for p in pos for q in neg) / (len(pos) * len(neg))
        ap = sum(sum(s == t for s in pos) * sum(s >= t for s in pos) / sum(s >= t for _, s in rows) for t in set(s for _, s in rows)) / len(pos)
        assert M.auroc(df).first()[0] == pytest.approx(auc) and M.average_precision(df).first()[0] == pytest.approx(ap)
        c = M.confusion(df).first()
        assert c["tp"] == sum(s >= 0.5 for s in pos) and c["accuracy"] == pytest.approx(sum((s >= 0.5) == bool(k) for k, s in rows) / len(rows))
    one = spark.createDataFrame([(0, 0.5)], "label int, score double")
    assert math.isnan(M.auroc(one).first()[0]) and math.isnan(M.average_precision(one).first()[0])


# --- paths --------------------------------------------------------------------------------------------
def test_paths(spark):
    assert column(spark, ["https://github.com/octocat/Hello-World", "https://github.com/octocat/Hello-World.git/", "git@github.com:octocat/Hello-World.git", "octocat/Hello-World", "https://example.com/a/b", "a/..", "a/b/c", ""], P.repository) == [("octocat", "Hello-World")] * 4 + [None] * 4
    assert column(spark, ["./src//lib.rs", "../x", "/a", "a/./b/"], P.relative_path) == ["src/lib.rs", None, None, "a/b"]
    assert column(spark, ["a/b.py", ".py", "x.tar.GZ", "Dockerfile", "d/MAKEFILE", "b.", "k.KT"], P.language_of) == ["python", None, None, "dockerfile", "makefile", None, "kotlin"]
    assert column(spark, ["a.git", "git@h:o/My_Repo.GIT", "https://h/o/--x--/", "///"], P.source_slug) == ["a", "my-repo", "x", None]
    assert column(spark, ["a-b.c", "A", "a\n", "-a"], P.valid_source_id) == [True, False, False, False]
    assert column(spark, ["AB" * 20 + "\nx", "zz"], P.revision_of) == ["ab" * 20, None]
    assert column(spark, ["src/a.py", "__init__.py", "tests/a.py", "a/uv.lock", "x.bin"], P.prep_selected) == [True, True, False, False, False]


def test_stored_tables_have_their_sizes():
    assert (len(S.SUFFIX_LANGUAGE), len(S.NAME_LANGUAGE), len(S.SCAN_EXTENSIONS), len(S.PREP_DIRECTORIES), len(S.SCAN_DIRECTORIES), len(S.GENERATED_SUFFIXES), len(S.STRIP)) == (47, 3, 59, 21, 18, 19, 29)


# --- selection and estimate ---------------------------------------------------------------------------
def made_tree(seed, n=150):
    """Random paths over names that every rule of the walk decides about."""
    rng = random.Random(seed)
    folders = ["core", "net", ".ci", "obj", "Obj", "third_party", "docs", "ünits"]
    names = ["one.rs", "Two.PY", "x.min.js", "table_pb2.py", ".rc.ts", "notes.txt", "big.sql", "k.kt", ".go", "run.d.ts", "noext"]
    out = {}
    for i in range(n):
        path = "/".join([*(rng.choice(folders) for _ in range(rng.randint(0, 3))), f"{i % 7}-{rng.choice(names)}" if rng.random() < 0.6 else rng.choice(names)])
        out[path] = "v" * rng.choice((3, 40, 90))
    return out


def plain_walk(files, most_bytes, most_files):
    """A depth-first walk that takes the last listed folder first, and the counters of what it meets before the cap."""
    acc, found, c, pending = tree.MapAccessor(files), [], dict.fromkeys(("files_seen", "files_selected", "files_skipped_extension", "files_skipped_pattern", "files_skipped_too_large", "directories_pruned"), 0), ["."]
    while pending:
        at = pending.pop()
        for x in acc.list_dir(at):
            n, p = x["name"], x["name"] if at == "." else f"{at}/{x['name']}"
            if x["entry_type"] == "dir":
                if n.startswith(".") or n in S.SCAN_DIRECTORIES:
                    c["directories_pruned"] += 1
                else:
                    pending.append(p)
                continue
            c["files_seen"] += 1
            stem, dot, ext = n.rpartition(".")
            if not (stem and dot) or ext.lower() not in S.SCAN_EXTENSIONS:
                c["files_skipped_extension"] += 1
            elif n.startswith(".") or n.lower().endswith(tuple(S.GENERATED_SUFFIXES)):
                c["files_skipped_pattern"] += 1
            elif x["size"] > most_bytes:
                c["files_skipped_too_large"] += 1
            else:
                c["files_selected"] += 1
                found.append(p)
                if len(found) == most_files:
                    return found, c | {"directories_errored": 0, "truncated": True}
    return found, c | {"directories_errored": 0, "truncated": False}


@pytest.mark.parametrize(("seed", "most"), [(1, 10_000), (2, 9), (3, 1)])
def test_selection_against_a_plain_walk(spark, seed, most):
    files = made_tree(seed)
    e = frontier.entries(spark, tree.MapAccessor(files))
    paths, counters = plain_walk(files, 50, most)
    assert [r["path"] for r in selection.candidates(e, max_bytes=50, max_files=most).orderBy("candidate_index").collect()] == paths
    assert selection.selection_stats(e, 50, most).drop("repo").first().asDict() == counters
    assert selection.candidates(e, max_files=0).count() == 1
    steps = {r["path"]: r["step"] for r in sampling.sampled(selection.candidates(e, max_bytes=50, max_files=most), 5).collect()}
    assert [steps[paths[i]] for i in sampling.permutation(len(paths), 5)] == list(range(1, len(paths) + 1))


class Locked(tree.MapAccessor):
    """Folders called 'shut' cannot be listed, files called 'lost.py' not be read."""

    def list_dir(self, path):
        if path.endswith("shut"):
            raise tree.AccessError("permission_denied", path)
        return super().list_dir(path)

    def read_file(self, path, offset=None, limit=None):
        if path.endswith("lost.py"):
            raise tree.AccessError("io", path)
        return super().read_file(path, offset, limit)


def test_folders_that_cannot_be_listed_count(spark):
    acc = Locked({"a.py": "human\n", "shut/b.py": "ai\n", "deep/shut/c.py": "ai\n", "lost.py": "ai\n"})
    e = frontier.entries(spark, acc)
    assert selection.selection_stats(e).first()["directories_errored"] == 2
    r = scan.analyze(spark, acc)
    assert (r["directories_errored"], r["files_selected"], r["files_errored"], r["files_scanned"], r["population"]) == (2, 2, 1, 1, 1)


def test_walk_order(spark):
    rng = random.Random(6)
    for _ in range(4):
        files = {"/".join(rng.choice(["a", "b", "ab", "a-b", "é", "z"]) for _ in range(rng.randint(0, 3))).strip("/") + f"/{i}.py": "x" for i in range(60)}
        acc = tree.MapAccessor({k.strip("/"): v for k, v in files.items()})
        want, pending = [], ["."]
        while pending:
            at = pending.pop()
            for x in acc.list_dir(at):
                p = x["name"] if at == "." else f"{at}/{x['name']}"
                pending.append(p) if x["entry_type"] == "dir" else want.append(p)
        got = selection.candidates(frontier.entries(spark, acc).repartition(7)).orderBy("candidate_index").collect()
        assert [r["path"] for r in got] == want


def test_draws():
    assert [f"{sampling.draw(0, k):016x}" for k in (1, 2, 3)] == ["e220a8397b1dcdaf", "6e789e6aa1b965f4", "06c45d188009454f"]
    assert sampling.permutation(10, 0) == [4, 9, 2, 5, 1, 7, 6, 0, 3, 8] and sampling.permutation(10, 7) == [9, 5, 8, 6, 1, 2, 4, 7, 0, 3]
    assert sampling.permutation(10, 8) == [2, 7, 4, 9, 1, 0, 3, 8, 5, 6] and sampling.permutation(3, 0) == [1, 0, 2]


def clusters(spark, population, sizes):
    rows = [("r", i + 1, "scanned", m, a, 0.0, False, population) for i, (m, a) in enumerate(sizes)]
    return E.trajectory(spark.createDataFrame(rows, "repo string, step int, status string, chunks long, ai_chunks long, probability_sum double, is_ai boolean, _n int")).orderBy(F.desc("step")).first()


def plain_estimate(population, sizes):
    """The ratio of cluster totals and its half width, from the definition: residuals of a ratio estimate, corrected for
    the finite population."""
    n, m, a = len(sizes), sum(x for x, _ in sizes), sum(y for _, y in sizes)
    if not m or (n < population and n < 2):
        return None, None
    if n >= population:
        return a / m, 0.0
    residual = sum((y - a / m * x) ** 2 for x, y in sizes) / (n - 1)
    return a / m, S.Z_99 * math.sqrt(max(0.0, (1 - n / population) * n * residual)) / m


def test_estimator(spark):
    rng = random.Random(17)
    cases = [(7, [(6, 1), (12, 9), (3, 3)]), (3, [(6, 1), (12, 9), (3, 3)]), (9, [(4, 4)]), (50, [(5, 1)] * 8), (8, [(0, 0)] * 3), (1, [(3, 2)])]
    cases += [(rng.randint(k, 3 * k), [(m, rng.randint(0, m)) for m in (rng.randint(1, 30) for _ in range(k))]) for k in (2, 5, 20)]
    for population, sizes in cases:
        r, (share, width) = clusters(spark, population, sizes), plain_estimate(population, sizes)
        assert r["fraction"] == pytest.approx(share) and r["half_width"] == pytest.approx(width, abs=1e-9)
        assert (r["low"], r["high"]) == ((None, None) if share is None else (pytest.approx(max(0, share - width)), pytest.approx(min(1, share + width))))


def lines(*words):
    return "".join(w + "\n" for w in words)


def plain_scan(files, config, seed=0):
    """File by file in the shuffled order: lines are chunks, those with 'ai' count 0.9, others 0.1."""
    paths, _ = plain_walk(files, S.SCAN_FILE_BYTES, S.SCAN_MAX_FILES)
    population, sizes, labels, total, generated, errored, history = len(paths), [], [], 0.0, 0, 0, []
    for i in sampling.permutation(len(paths), seed):
        chunks = [x for x in files[paths[i]].split("\n") if x.strip()]
        if "@generated" in files[paths[i]]:
            generated, population = generated + 1, population - 1
        elif not chunks:
            errored, population = errored + 1, population - 1
        else:
            ai = sum(x.strip() == "ai" for x in chunks)
            sizes.append((len(chunks), ai))
            p = 0.9 * ai + 0.1 * (len(chunks) - ai)
            labels.append(p / len(chunks) >= 0.5)
            total += p
        share, width = plain_estimate(population, sizes)
        history.append((len(sizes), share, width))
        if width is not None and len(sizes) >= config.min_files and width <= config.target:
            stop = "precision_reached"
        elif sum(m for m, _ in sizes) >= config.max_chunks:
            stop = "chunk_budget_exhausted"
        else:
            continue
        break
    else:
        stop = "all_files_scanned"
    m, a = sum(x for x, _ in sizes), sum(y for _, y in sizes)
    return history, {"stop_reason": stop, "files_scanned": len(sizes), "files_generated": generated, "files_errored": errored, "files_ai": sum(labels), "files_human": len(labels) - sum(labels), "chunks_scanned": m, "chunks_ai": a, "chunks_human": m - a, "fraction": share, "half_width": width, "mean_probability": total / m if m else None}


def test_scan_against_a_plain_loop(spark):
    rng = random.Random(23)
    word = lambda: rng.choice(("plain", "ai", "  "))
    files = {f"m{i % 5}/f{i}.rs": ("// @generated\n" if i % 13 == 0 else "") + lines(*(word() for _ in range(rng.randint(1, 6)))) for i in range(70)}
    for config, seed in ((E.Sampling(), 0), (E.Sampling(target=0.2, min_files=5), 3), (E.Sampling(max_chunks=40, min_files=10**9), 1), (E.Sampling(min_files=10**9), 2)):
        seen = []
        r = scan.analyze(spark, tree.MapAccessor(files), config, seed, on_progress=seen.append, block=8)
        history, want = plain_scan(files, config, seed)
        assert {k: pytest.approx(r[k], abs=1e-6) if isinstance(v, float) else r[k] for k, v in want.items()} == want
        # once after the selection, once after each file
        assert [(s["files_scanned"], s["fraction"]) for s in seen] == [(0, None), *((n, pytest.approx(f)) for n, f, _ in history)]
        assert seen[-1]["stop_reason"] == want["stop_reason"]


class Slow(tree.MapAccessor):
    def read_file(self, path, offset=None, limit=None):
        time.sleep(1.5)
        return super().read_file(path, offset, limit)


def test_a_cancel_ends_running_work(spark):
    """A block of 80 files would take 15 seconds; a cancel ends it about as fast as a file is read."""
    files, at, flag = {f"f{i}.rs": lines("ai", "human") for i in range(80)}, [], threading.Event()

    def told(stats):
        if not at:  # after the selection; the one block begins now
            at.append(time.time() + 3)
            threading.Timer(3, flag.set).start()

    r = scan.analyze(spark, Slow(files), E.Sampling(min_files=99), on_progress=told, block=10**6, cancelled=flag.is_set)
    assert r["stop_reason"] == "cancelled" and r["files_selected"] == 80 and r["files_scanned"] == 0 and time.time() - at[0] < 3
    quick = scan.analyze(spark, tree.MapAccessor(files), E.Sampling(min_files=99), cancelled=lambda: False)
    assert quick["files_scanned"] == 80
    with pytest.raises(tree.AccessError):  # errors are not taken for cancels
        scan.analyze(spark, tree.MapAccessor({}), cancelled=lambda: False)


def test_scan_cancels_after_any_file(spark):
    files = {f"f{i}.rs": lines("ai", "human") * (1 + i % 3) for i in range(40)}
    for stop_at in (0, 1, 7):
        seen = []
        r = scan.analyze(spark, tree.MapAccessor(files), E.Sampling(min_files=99), on_progress=lambda s, k=stop_at, seen=seen: (seen.append(1), len(seen) <= k)[1], block=16)
        assert (r["stop_reason"], r["files_scanned"], len(seen)) == ("cancelled", stop_at, stop_at + 1)
    empty = scan.analyze(spark, tree.MapAccessor({"notes.txt": "x"}))
    assert (empty["stop_reason"], empty["files_scanned"], empty["fraction"]) == ("all_files_scanned", 0, None)
    with pytest.raises(tree.AccessError):
        scan.analyze(spark, tree.MapAccessor({}))


def test_scan_with_a_model(spark):
    """A model over token windows drives the scan: windows are chunks, the file's label is the model's own decision."""
    make = lambda: lambda ws: [(0.0, 1.0 if len(w) == 4 else -1.0) for w in ws]
    files = {"a.py": "a b c d e f g h i j", "b.py": "a b", "c.py": " \n"}
    r = scan.analyze(spark, tree.MapAccessor(files), E.Sampling(min_files=9), score=scan.model_steps(W.words, make, length=4, overlap=1, file_threshold=0.6))
    assert (r["files_scanned"], r["files_errored"], r["chunks_scanned"], r["chunks_ai"], r["files_ai"]) == (2, 1, 4, 3, 1)


def test_stepwise_equals_all_at_once(spark):
    rng = random.Random(4)
    rows = [(f"r{k}", i + 1, "scanned" if rng.random() < 0.9 else "errored", rng.randint(1, 9), 0, 0.5, True) for k in range(3) for i in range(120)]
    rows = [(*r[:4], rng.randint(0, r[3]), *r[5:]) for r in rows]
    steps = spark.createDataFrame(rows, "repo string, step int, status string, chunks long, ai_chunks long, probability_sum double, is_ai boolean")
    config = E.Sampling(target=0.2, min_files=5)
    reads = []
    part = E.stepwise(lambda c: (reads.append(1), steps.join(c, ["repo", "step"]))[1], steps.select("repo", "step"), config, block=16)
    same = lambda df: sorted(map(str, E.repo_stats(df, config).drop("_n").collect()))
    assert same(part) == same(steps) and part.count() < steps.count()


def test_progress_stream(spark, tmp_path):
    from lodestone.streaming import progress

    rng = random.Random(1)
    rows = [("r", 40, i + 1, "scanned", 5, rng.randint(0, 5), 2.5, True) for i in range(40)]
    df = spark.createDataFrame(rows, progress.STEP)
    for n in range(3):
        df.where(F.col("step") % 3 == n).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    seen = []
    q = progress.events(spark.readStream.schema(progress.STEP).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in"), lambda kind, data: seen.append((kind, data)), E.Sampling(target=0.0, min_files=5))
    q.processAllAvailable()
    q.stop()
    batch = E.repo_stats(df.drop("population"), E.Sampling(target=0.0, min_files=5)).first()
    kind, last = seen[-1]
    assert kind == "complete" and last["step"] == batch["step"] and last["stop_reason"] == batch["stop_reason"]
    assert last["fraction"] == pytest.approx(batch["fraction"]) and last["half_width"] == pytest.approx(batch["half_width"])


# --- sources and services -----------------------------------------------------------------------------
def source(i, label=0, **more):
    return {"id": i, "kind": "git", "label": label, "label_name": "ai" if label else "human", "url": f"u/{i}", "revision": None, "provenance_note": "", **more}


def test_manifests(spark, tmp_path):
    p = tmp_path / "m.json"
    manifest.add_source(p, source("a"))
    manifest.add_source(p, source("b", 1))
    with pytest.raises(manifest.ManifestError):
        manifest.add_source(p, source("a"))
    m = manifest.load(p)
    assert manifest.sources(spark, {"train": m}).count() == 2
    for bad in ({"train": m, "test": m}, {"train": {"sources": [source("a"), source("a")]}}, {"train": {"sources": [source("A b")]}}, {"train": {"sources": [source("a", kind="svn")]}}):
        with pytest.raises(manifest.ManifestError):
            manifest.validate(bad)
    p.write_text("[]")
    for bad in (p, tmp_path / "none"):
        with pytest.raises(manifest.ManifestError):
            manifest.load(bad)


def test_directory_accessor(tmp_path):
    home = tmp_path / "home"
    (home / "kit" / "inner").mkdir(parents=True)
    (home / "kit" / "über.txt").write_text("zwölf Wörter")
    (tmp_path / "outside.txt").write_text("not yours")
    (home / "kit" / "leak").symlink_to(tmp_path / "outside.txt")
    (home / "kit" / "dangling").symlink_to(home / "nowhere")
    (home / "alias").symlink_to(home / "kit" / "inner")
    (home / "raw.bin").write_bytes(b"\xff\xfe")
    a = tree.DirectoryAccessor(home)
    assert [(e["name"], e["entry_type"], e["size"]) for e in a.list_dir("kit")] == [("inner", "dir", None), ("über.txt", "file", 14)]
    assert [e["name"] for e in a.list_dir("./")] == ["alias", "kit", "raw.bin"]
    text = "zwölf Wörter"
    for offset, limit in ((None, None), (0, 3), (4, 5), (11, 9), (40, 2), (None, 0)):
        assert a.read_file("kit/über.txt", offset, limit) == text[offset or 0 :][:limit]
    for path, kind in (("kit/../../outside.txt", "invalid_path"), ("/etc/hosts", "invalid_path"), ("kit/leak", "invalid_path"), ("kit/none", "not_found"), ("raw.bin", "utf8"), ("kit", "io")):
        with pytest.raises(tree.AccessError) as e:
            a.read_file(path)
        assert e.value.kind == kind


def test_prepare(spark, tmp_path):
    human, ai = tmp_path / "h", tmp_path / "a"
    for root, word in ((human, "human"), (ai, "machine")):
        (root / "pkg" / "tests").mkdir(parents=True)
        for i in range(4):
            (root / "pkg" / f"__init{i}__.py").write_text(f"# {word} file number {i}\n" + "value = 1\n" * 20)
        (root / "pkg" / "tests" / "t.py").write_text("x = 1\n" * 50)
        (root / "same.py").write_text("shared = True\n" * 20)
        (root / "bad.py").write_bytes(b"\xff\xfe" * 40)
    (human / "pkg" / "extra.py").write_text("more = 2\n" * 20)
    final, summary = prepare.prepare(spark, {"train": {"sources": [source("h"), source("a", 1)]}}, {"h": str(human), "a": str(ai)}, str(tmp_path / "out"))
    assert list(summary) == list(S.SUMMARY)
    assert summary["source_counts_before_deduplication"] == {"a": 5, "h": 6} and summary["split_counts"] == {"train": {"human": 4, "ai": 4}}
    assert (summary["records_after_deduplication"], summary["same_label_duplicates_removed"], summary["cross_label_conflicts_removed"], summary["balanced"]) == (9, 0, 1, True)
    back = jsonl.read(spark, f"{tmp_path}/out/train.jsonl")
    assert back.count() == 8 and json.loads((tmp_path / "out" / "summary.json").read_text()) == summary
    assert sorted(p.name for p in (tmp_path / "out").iterdir() if not p.name.startswith(".")) == ["summary.json", "train.jsonl"]
    line = (tmp_path / "out" / "train.jsonl").read_text(encoding="utf-8").splitlines()[0]
    assert list(json.loads(line)) == list(S.CHUNK_COLUMNS) and json.loads(line)["revision"] is None
    assert jsonl.quarantine(back.withColumn("label", F.lit(3))).count() == 8
    assert final.count() == 8


def test_order_without_balance(spark, tmp_path):
    """Records come by source, path components and chunk number: chunk 10 after chunk 2, a/x before a-b/x."""
    root = tmp_path / "h"
    for folder in ("a", "a-b"):
        (root / folder).mkdir(parents=True)
        (root / folder / "x.py").write_text("".join(f"value_{folder[-1]}_{i} = {i} + 100000000000000000000000000\n" for i in range(120)))
    prepare.prepare(spark, {"train": {"sources": [source("h")]}}, {"h": str(root)}, f"file:{tmp_path}/out", balance=False, max_chars=200)
    one = tmp_path / "out" / "train.jsonl"
    rows = [json.loads(x) for x in one.read_text(encoding="utf-8").splitlines()]
    assert one.is_file() and [(r["path"], r["chunk_index"]) for r in rows] == [(p, i) for p in ("a/x.py", "a-b/x.py") for i in range(len(rows) // 2)] and len(rows) > 40


def test_one_file_a_split(spark, tmp_path):
    """In order over many parts, by any URI; a write that fails leaves the files as they were."""
    columns = {c: F.lit(None).cast("string") for c in S.CHUNK_COLUMNS} | {"split": F.when(F.col("id") % 3 == 0, "test").otherwise("train"), "chunk_index": F.col("id")}
    df = spark.range(5000).repartition(7).select("id", *[c.alias(n) for n, c in columns.items() if n != "id"])
    for out in (str(tmp_path / "a"), f"file:{tmp_path}/b", f"file://{tmp_path}/c"):
        seen = Observation()
        jsonl.write(df, out, ["chunk_index"], ("train", "test", "validation"), seen, n=F.count("*"), low=F.min("chunk_index"))
        folder = tmp_path / out[-1]
        ids = {s: [json.loads(x)["chunk_index"] for x in (folder / f"{s}.jsonl").read_text().splitlines()] for s in S.SPLITS}
        assert ids == {"train": [i for i in range(5000) if i % 3], "test": list(range(0, 5000, 3)), "validation": []} and seen.get == {"n": 5000, "low": 0}
        jsonl.write_summary(spark, {"é": 1}, f"{out}/summary.json")
        assert json.loads((folder / "summary.json").read_text(encoding="utf-8")) == {"é": 1}
    broken = df.withColumn("text", F.when(F.col("id") == 4000, F.raise_error(F.lit("lost"))).otherwise(F.lit("x")).cast("string"))
    with pytest.raises(Exception, match="lost"):
        jsonl.write(broken, str(tmp_path / "a"), ["chunk_index"])
    assert sorted(p.name for p in (tmp_path / "a").iterdir() if not p.name.startswith(".")) == ["summary.json", "test.jsonl", "train.jsonl", "validation.jsonl"]
    assert len((tmp_path / "a/train.jsonl").read_text().splitlines()) == len([i for i in range(5000) if i % 3])


def test_bad_lines_are_located(spark, tmp_path):
    good = json.dumps({"text": "t", "label": 0, "language": "c"})
    bad = ["{", json.dumps({"text": "t", "label": 2, "language": "c"}), json.dumps({"text": "t", "label": 1, "language": ""}), json.dumps({"label": 1, "language": "c"})]
    p = tmp_path / "r.jsonl"
    p.write_text("\n".join([good, "", good, bad[0], good, bad[1], bad[2], "", bad[3], good]) + "\n")
    got = sorted((r["line"], r["problem"]) for r in jsonl.problems(spark, str(p)).collect())
    assert got == [(4, "not JSON"), (6, "label"), (7, "language"), (9, "text")]
    assert sorted(r["line"] for r in jsonl.problems(spark, str(p), full=False).collect()) == [4, 6, 7]


def test_merged_breakdowns(spark):
    a = spark.createDataFrame([("c", 0), ("c", 1), ("go", 1)], "language string, label int")
    b = spark.createDataFrame([("go", 0), ("zig", 0)], "language string, label int")
    got = {tuple(r) for r in C.merged(C.breakdown(a), C.breakdown(b), C.breakdown(a.limit(0))).collect()}
    assert got == {("c", 1, 1, 2), ("go", 1, 1, 2), ("zig", 1, 0, 1), ("TOTAL", 3, 2, 5)}


def test_scores_must_fit_their_windows(spark):
    rows = spark.createDataFrame([("a", 0.5, 2), ("a", 0.7, 2), ("b", 0.1, 1)], "record_id string, score double, n_windows long")
    assert {r["record_id"]: r["score"] for r in W.record_scores(rows).collect()} == {"a": pytest.approx(0.6), "b": 0.1}
    with pytest.raises(Exception, match="not one a window"):
        W.record_scores(rows.where("score != 0.7")).collect()


def test_leaks_against_sets(spark):
    rng = random.Random(9)
    items = {i: {rng.randint(0, 12) for _ in range(4)} | {99} for i in range(8)}
    docs = {d: {rng.randint(0, 40) for _ in range(3)} | ({99} if d % 2 else set()) for d in range(200)}
    frame = lambda x, k: spark.createDataFrame([(n, str(h)) for n, hs in x.items() for h in hs], f"{k} long, h string")
    got = {tuple(r) for r in C.leaks(frame(items, "item_id"), frame(docs, "doc_id")).collect()}
    assert got == {(i, min(d for d in docs if docs[d] & hs), sum(bool(docs[d] & hs) for d in docs)) for i, hs in items.items()}


def test_classify(spark):
    texts = spark.createDataFrame([(1, "a b c d e"), (2, " \n"), (3, "x\0")], "file_id int, text string")
    make = lambda: lambda ws: [(0.0, float(len(w))) for w in ws]
    got = {r["file_id"]: r for r in score.classify(texts, W.words, make, length=4, overlap=1).collect()}
    one = [1 / (1 + math.exp(-4)), 1 / (1 + math.exp(-2))]
    assert got[1]["window_probabilities"] == pytest.approx(one, abs=1e-6) and got[1]["ai_probability"] == pytest.approx(sum(one) / 2, abs=1e-6) and got[1]["prediction"] == "ai"
    assert got[2]["status"] == got[3]["status"] == "empty_input" and got[2]["n_windows"] == 0
    assert score.padded_length([3, 9]) == 16
