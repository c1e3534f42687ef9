"""Trees as tables: the code_tree source and the frontier listing against plain walks."""

import io
import os
import random
import tarfile

import pytest
from pyspark.sql import datasource as D
from pyspark.sql import functions as F

from lodestone import schema as S
from lodestone.functions import paths as P
from lodestone.sources import archives, code_tree, frontier, ingest, tree


def grown(root, seed, links=False, n=60):
    """A random tree with hidden, underscored and left-out names, and links to files and folders."""
    rng = random.Random(seed)
    folders, names = [""], ["__init__.py", "_x.rs", ".rc.ts", "a.py", "B.PY", "Makefile", "notes", "ü.go", "big.c", "Cargo.lock", ".hidden"]
    os.makedirs(root, exist_ok=True)
    for i in range(n):
        at = rng.choice(folders)
        if rng.random() < 0.25:
            name = rng.choice(["src", "lib", ".git", "Node_Modules", "_p", "é", "vendor", "deep"])
            path = f"{at}/{name}" if at else name
            os.makedirs(os.path.join(root, path), exist_ok=True)
            folders.append(path)
        elif links and rng.random() < 0.3:
            here = os.path.join(root, at, f"link{i}")
            there = rng.choice([*folders, "nowhere", "../.."])
            os.symlink(os.path.join(root, there), here)
        else:
            with open(os.path.join(root, at, rng.choice(names)), "wb") as f:
                f.write(rng.choice([b"", b"x = 1\n", b"\xff\x00", b"y" * 500]))
    return str(root)


def plain_files(root, include=(), exclude=()):
    out = {}
    below = lambda p, x: p == x or p.startswith(x + "/")
    for base, dirs, names in os.walk(root):
        dirs[:] = [d for d in dirs if d.casefold() not in (*S.PREP_DIRECTORIES, *S.PREP_FILES) and not os.path.islink(os.path.join(base, d))]
        for n in names:
            p = os.path.relpath(os.path.join(base, n), root)
            if n.casefold() in S.PREP_FILES or os.path.islink(os.path.join(base, n)) or any(below(p, x) for x in exclude) or include and not any(below(p, x) for x in include):
                continue
            with open(os.path.join(base, n), "rb") as f:
                out[p] = f.read()
    return out


def explained(df):
    return df._jdf.queryExecution().explainString(df._sc._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))


@pytest.mark.parametrize("partitions", [1, 5, 500])
def test_code_tree_equals_a_plain_walk(spark, tmp_path, partitions):
    roots = {f"s{i}": grown(tmp_path / str(i), i, links=True, n=120) for i in range(4)}
    include, exclude = {"s1": ["src", "lib/deep"]}, {"s0": ["src"], "s2": ["a.py", "lib"]}
    df = code_tree.code_tree(spark, roots, include, exclude, partitions=partitions)
    got = {(r["source_id"], r["path"]): bytes(r["content"]) for r in df.collect()}
    want = {(s, p): c for s, r in roots.items() for p, c in plain_files(r, include.get(s, ()), exclude.get(s, ())).items()}
    assert got == want and len(want) > 60 and all(r["size"] == len(want[r["source_id"], r["path"]]) for r in df.collect())
    kept = df.where(P.language_of("path").eqNullSafe(F.col("language"))).count()
    assert kept == len(want)  # the source's language is the column's


def test_pushed_filters(spark, tmp_path):
    roots = {f"s{i}": grown(tmp_path / str(i), i + 10, n=100) for i in range(3)}
    every = code_tree.code_tree(spark, roots).cache()
    for where in ("language IS NOT NULL AND size <= 100", "name = 'a.py'", "path LIKE 'src/%' AND suffix IN ('.py', '.go')", "source_id = 's1' AND NOT name = 'a.py'", "size > 5 AND size < 500 AND name LIKE '%.PY'", "language IS NULL", "path IN ('a.py', 'lib/a.py')", "path LIKE 'src/de%'"):
        df = code_tree.code_tree(spark, roots, where=where)
        plan = explained(df)
        assert "PushedFilters: [" in plan and "PushedFilters: []" not in plan
        rows = lambda x: sorted((r["source_id"], r["path"], r["size"]) for r in x.collect())
        assert rows(df) == rows(every.where(where)), where
        assert df.where("size = 0").count() == every.where(where).where("size = 0").count() and rows(df) == rows(every.where(where))
    every.unpersist()


def test_filters_decide_before_files_are_opened(tmp_path, monkeypatch):
    for folder in ("src", ".git", "Node_Modules/deep", "src/skip", "other"):
        (tmp_path / folder).mkdir(parents=True)
        (tmp_path / folder / "a.py").write_text("x")
    (tmp_path / "src" / "big.py").write_text("x" * 99)
    t = code_tree.Tree({"s": str(tmp_path)}, {}, {"s": ["src/skip"]}, [])
    reader = code_tree.PushingReader(t, 1, True)
    odd = D.EqualTo(("content",), b"x")
    assert list(reader.pushFilters([D.StringStartsWith(("path",), "src/"), odd, D.LessThan(("size",), 50)])) == [odd]
    entered, opened, scan, read = [], [], os.scandir, code_tree.read
    monkeypatch.setattr(code_tree.os, "scandir", lambda p: (entered.append(os.path.relpath(p, tmp_path)), scan(p))[1])
    monkeypatch.setattr(code_tree, "read", lambda p: (opened.append(os.path.relpath(p, tmp_path)), read(p))[1])
    rows = [r for p in reader.partitions() for b in reader.read(p) for r in b.to_pylist()]
    assert [r["path"] for r in rows] == opened == ["src/a.py"] and sorted(entered) == [".", "src"]


def test_a_folder_with_many_files_is_shared(spark, tmp_path):
    for i in range(2 * code_tree.SHARE + 10):
        (tmp_path / f"{i}.py").touch()
    reader = code_tree.TreeReader(code_tree.Tree({"s": str(tmp_path)}, {}, {}, []), 64, False)
    assert [(p.deep, p.parts) for p in reader.partitions()] == [(False, 3)] * 3
    df = code_tree.code_tree(spark, {"s": str(tmp_path)}, content=False)
    assert df.columns == code_tree.PLAIN.replace(" string", "").replace(" bigint", "").split(", ")
    assert df.count() == df.select("path").distinct().count() == 2 * code_tree.SHARE + 10


def test_plain_load_and_empty_trees(spark, tmp_path):
    (tmp_path / "one.py").write_text("1")
    code_tree.register(spark)
    df = spark.read.format("code_tree").option("source_id", "me").load(str(tmp_path))
    assert [(r["source_id"], r["path"], bytes(r["content"])) for r in df.where("language = 'python'").collect()] == [("me", "one.py", b"1")]
    assert df.where("name = 'two.py'").count() == 0 and df.count() == 1  # without pushdown a frame takes any filters
    assert code_tree.code_tree(spark, {"s": str(tmp_path / "gone")}).count() == 0 and code_tree.code_tree(spark, {}).count() == 0
    with pytest.raises(Exception, match="path or the option roots"):
        spark.read.format("code_tree").load().count()


# --- frontier ------------------------------------------------------------------------------------------
class Shut(tree.DirectoryAccessor):
    """Folders called 'vendor' cannot be listed."""

    def list_dir(self, path):
        if path.split("/")[-1] == "vendor":
            raise tree.AccessError("permission_denied", path)
        return super().list_dir(path)


def test_frontier_equals_a_plain_walk(spark, tmp_path):
    """200 trees with cycles of links and folders that cannot be listed, listed together."""
    accessors = {f"r{i}": Shut(grown(tmp_path / str(i), i, links=True, n=10 + i % 50)) for i in range(200)}
    prune = lambda n: n.startswith(".")
    got = sorted(map(tuple, frontier.listed(spark, accessors, prune).collect()), key=str)
    want = sorted(((r, *x) for r, a in accessors.items() for x in tree.walk(a, prune)), key=str)
    assert got == want and sum(x[4] for x in want) > 20
    cycles = sum(1 for r, a in accessors.items() for _, is_dir, _, _ in [x[1:] if len(x) == 5 else x for x in tree.walk(a)] if is_dir)
    assert cycles > 200


def test_a_linked_folder_is_entered_once_by_its_shortest_path(spark, tmp_path):
    (tmp_path / "a/b/c").mkdir(parents=True)
    (tmp_path / "a/b/c/x.py").touch()
    os.symlink(tmp_path / "a/b/c", tmp_path / "short")
    os.symlink(tmp_path, tmp_path / "a/round")
    rows = {r["path"]: r["is_dir"] for r in frontier.entries(spark, tree.DirectoryAccessor(tmp_path)).collect()}
    assert rows == {"a": True, "short": True, "a/b": True, "a/round": True, "a/b/c": True, "short/x.py": False}


def test_a_root_that_cannot_be_listed_is_an_error(spark, tmp_path):
    (tmp_path / "vendor").mkdir()
    with pytest.raises(tree.AccessError):
        frontier.listed(spark, {"a": tree.MapAccessor({"x": "y"}), "b": tree.MapAccessor({})})


# --- archives ------------------------------------------------------------------------------------------
def packed(folder, archive, mode, top="top-1"):
    with tarfile.open(archive, mode) as tar:
        tar.add(folder, arcname=top)
    return str(archive)


@pytest.mark.parametrize(("suffix", "mode"), [("tar.gz", "w:gz"), ("tar", "w"), ("tar.xz", "w:xz")])
def test_archives_equal_unpacking_and_listing(spark, tmp_path, suffix, mode):
    include, exclude, files, folders = {"s1": ["src", "lib"]}, {"s0": ["src"], "s1": ["src/a.py"]}, {}, {}
    for i in range(3):
        root = grown(tmp_path / f"t{i}", 30 + i, links=True, n=90)
        files[f"s{i}"] = packed(root, tmp_path / f"{i}.{suffix}", mode)
        folders[f"s{i}"] = str(ingest.unpack(files[f"s{i}"], tmp_path / f"out{i}", include.get(f"s{i}"), exclude.get(f"s{i}")))
    rows = lambda df: sorted((r["source_id"], r["path"], r["language"], r["size"], bytes(r["content"])) for r in df.collect())
    want = code_tree.code_tree(spark, folders)
    got = code_tree.code_tree(spark, files, include, exclude, format="tar_files")
    assert rows(got) == rows(want) and want.count() > 40
    where = "language IS NOT NULL AND size <= 100"
    small = code_tree.code_tree(spark, files, include, exclude, where, format="tar_files")
    assert rows(small) == rows(want.where(where)) and "LessThanOrEqual(size,100)" in explained(small)
    assert code_tree.code_tree(spark, {k: "file://" + v for k, v in files.items()}, content=False, format="tar_files").where("source_id = 's2'").count() == sum(r["source_id"] == "s2" for r in want.collect())


def test_bodies_that_are_left_out_are_not_read(tmp_path):
    (tmp_path / "t/node_modules").mkdir(parents=True)
    for name in ("node_modules/x.js", "big.py"):
        (tmp_path / "t" / name).write_bytes(b"z" * 3_000_000)
    (tmp_path / "t/a.py").write_bytes(b"x = 1")
    path = packed(tmp_path / "t", tmp_path / "a.tar", "w")

    class Counted(io.FileIO):
        taken = 0

        def read(self, n=-1):
            got = super().read(n)
            Counted.taken += len(got)
            return got

        def readinto(self, b):
            got = super().readinto(b)
            Counted.taken += got
            return got

    reader = archives.PushingTarReader(code_tree.Tree({"s": path}, {}, {}, [D.LessThan(("size",), 100)]), 1, True)
    kept, archives.opened = archives.opened, lambda uri: Counted(uri)
    try:
        rows = [r for p in reader.partitions() for b in reader.read(p) for r in b.to_pylist()]
    finally:
        archives.opened = kept
    assert [(r["path"], r["content"]) for r in rows] == [("a.py", b"x = 1")] and Counted.taken < 50_000


def test_archives_that_are_not_as_expected(spark, tmp_path):
    with tarfile.open(tmp_path / "two.tar", "w") as tar:
        for name in ("a/x.py", "b/y.py"):
            tar.addfile(tarfile.TarInfo(name))
    with tarfile.open(tmp_path / "odd.tar", "w") as tar:
        for name in ("top/../../etc.py", "top/ok.py"):
            tar.addfile(tarfile.TarInfo(name))
        link = tarfile.TarInfo("top/link.py")
        link.type, link.linkname = tarfile.SYMTYPE, "ok.py"
        tar.addfile(link)
    with pytest.raises(Exception, match="one top folder"):
        code_tree.code_tree(spark, {"s": str(tmp_path / "two.tar")}, format="tar_files").collect()
    assert [(r["path"], bytes(r["content"])) for r in code_tree.code_tree(spark, {"s": str(tmp_path / "odd.tar")}, format="tar_files").collect()] == [("ok.py", b"")]
