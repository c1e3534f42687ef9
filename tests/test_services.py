"""Remote repositories, ingestion, the service and model artifacts, all without a network."""

import io
import json
import subprocess
import tarfile
import threading
from urllib.parse import unquote

import pytest

from lodestone.operators import estimate as E
from lodestone.plans import scan, score, service
from lodestone.sources import ingest, inputs, manifest, remote, tree

SHA = "0123456789abcdef0123456789abcdef01234567"


class Host:
    """A host with a few paths; keeps what it was asked."""

    def __init__(self, files, status=None, body=b"{}"):
        self.files, self.asked, self.status, self.body = files, [], status, body

    def __call__(self, url, headers, timeout):
        self.asked.append((url, dict(headers), timeout))
        if self.status:
            return self.status, self.body
        path = unquote(url.split("/contents", 1)[1].split("?")[0]).strip("/")
        if path in self.files:
            if headers["accept"] == remote.RAW_TYPE:
                return 200, self.files[path]
            return 200, json.dumps({"type": "file", "name": path.split("/")[-1]}).encode()
        names = {}
        for f, raw in self.files.items():
            if not path or f.startswith(path + "/"):
                name, _, more = f[len(path) :].strip("/").partition("/")
                names[name] = {"name": name, "type": "dir" if more else "file", "size": 0 if more else len(raw)}
        return (200, json.dumps([*names.values(), {"name": "odd", "type": "device"}, {"type": "file"}]).encode()) if names else (404, b"")


def hosted(files, **more):
    return remote.RemoteAccessor.of("Team/Tool.git", token=None, transport=Host(files), **more)


def test_remote_listing_and_reading():
    a = hosted({"b.py": "größe".encode(), "a dir/c.py": b"x", "bad": b"\xff"}, ref="v 1")
    assert [(e["name"], e["entry_type"], e["size"]) for e in a.list_dir(".")] == [("a dir", "dir", None), ("b.py", "file", 7), ("bad", "file", 1)]
    assert a.read_file("b.py", 1, 3) == "röß"
    url, headers, timeout = a.transport.asked[-1]
    assert url == "https://api.github.com/repos/Team/Tool/contents/b.py?ref=v+1" and "authorization" not in headers and timeout == 30
    assert a.contents_url("a dir/c.py").endswith("/contents/a%20dir/c.py")
    for call, kind in ((lambda: a.read_file("a dir"), "invalid_path"), (lambda: a.list_dir("b.py"), "invalid_path"), (lambda: a.read_file("../b.py"), "invalid_path"), (lambda: a.read_file("none"), "not_found"), (lambda: a.read_file("bad"), "utf8")):
        with pytest.raises(tree.AccessError) as e:
            call()
        assert e.value.kind == kind


@pytest.mark.parametrize(("status", "kind"), [(404, "not_found"), (401, "permission_denied"), (403, "permission_denied"), (429, "upstream"), (500, "upstream")])
def test_remote_statuses(status, kind):
    a = hosted({}).changed(transport=Host({}, status, b'{"message": "slow down"}'), token="t")
    with pytest.raises(tree.AccessError) as e:
        a.list_dir(".")
    assert e.value.kind == kind and a.transport.asked[0][1]["authorization"] == "Bearer t"
    assert kind != "upstream" or (e.value.status == status and "slow down" in str(e.value))


def test_remote_settings():
    assert remote.environment_token({"GH_TOKEN": "b", "GITHUB_TOKEN": "a"}) == "a" and remote.environment_token({"GH_TOKEN": "b"}) == "b" and remote.environment_token({}) is None
    assert hosted({}, api_url="https://host/api/v3/?q=1#x").contents_url() == "https://host/api/v3/repos/Team/Tool/contents"
    for bad in ({"ref": ""}, {"timeout": 0}, {"api_url": "nothing"}):
        with pytest.raises(tree.AccessError):
            hosted({}, **bad)
    for body, kind in ((b"[", "metadata"), (b"3", "metadata")):
        with pytest.raises(tree.AccessError) as e:
            hosted({}).changed(transport=Host({}, 200, body)).list_dir(".")
        assert e.value.kind == kind

    def gone(*_):
        raise OSError("no route")

    with pytest.raises(tree.AccessError) as e:
        hosted({}).changed(transport=gone).list_dir(".")
    assert e.value.kind == "http"


def test_addresses():
    for a in ("me/thing", "https://github.com/me/thing.git/", "git@github.com:me/thing.GIT", "ssh://git@github.com/me/thing", "http://user@GitHub.com/me/thing"):
        assert remote.parse_address(a) == ("me", "thing")
    for a in ("", "me", "me/..", "a/b/c", "https://elsewhere.org/me/thing", "git@elsewhere.org:me/thing", "ftp://github.com/me/thing"):
        with pytest.raises(tree.AccessError):
            remote.parse_address(a)
    with pytest.raises(tree.AccessError):
        remote.parse_address("me/thing", bare=False)


def test_remote_scan(spark):
    class Plain:  # a transport that tasks can take along
        def __call__(self, url, headers, timeout):
            return Host({"a.py": b"ai\nai\n", "pkg/b.py": b"human\n"})(url, headers, timeout)

    r = scan.analyze(spark, hosted({}).changed(transport=Plain()), E.Sampling(min_files=9))
    assert (r["files_scanned"], r["chunks_ai"], r["chunks_human"], r["stop_reason"]) == (2, 2, 1, "all_files_scanned")


# --- ingestion ----------------------------------------------------------------------------------------
def source(**more):
    return {"id": "tool", "kind": "git", "label": 0, "label_name": "human", "url": "https://github.com/team/tool", "revision": SHA, **more}


def test_checkout(tmp_path):
    ran, known = [], set()

    def run(args, folder):
        ran.append(args[1:])
        if args[1] == "clone":
            (tmp_path / "tool").mkdir()
        if args[1] == "fetch":
            known.add(SHA)
        if args[1] == "checkout" and SHA not in known:
            raise subprocess.CalledProcessError(1, args)
        return SHA + "\n" if args[1] == "rev-parse" else ""

    assert ingest.checkout(source(include_paths=["src"]), tmp_path, run=run) == tmp_path / "tool"
    assert [a[0] for a in ran] == ["clone", "sparse-checkout", "checkout", "fetch", "checkout", "rev-parse"]
    ran.clear()
    ingest.checkout(source(), tmp_path, run=run)
    assert [a[0] for a in ran] == ["checkout", "rev-parse"]
    with pytest.raises(manifest.ManifestError):
        ingest.checkout(source(), tmp_path, run=lambda a, f: "f" * 40)


def packed(path, names):
    with tarfile.open(path, "w:gz") as t:
        for n in names:
            info = tarfile.TarInfo(n)
            info.size = 3
            t.addfile(info, io.BytesIO(b"abc"))


def test_archives(tmp_path):
    loads = []

    def download(owner, name, revision, file):
        loads.append((owner, name, revision))
        packed(file, ["top-1/src/a.py", "top-1/src/gen/b.py", "top-1/doc/c.md", "top-1/../up.py"])

    s = source(include_paths=["src"], exclude_paths=["src/gen"])
    folder = ingest.fetched(s, tmp_path, download)
    assert [str(p.relative_to(folder)) for p in sorted(folder.rglob("*")) if p.is_file()] == [ingest.MARKER, "src/a.py"]
    ingest.fetched(s, tmp_path, download)
    assert loads == [("team", "tool", SHA)]
    ingest.fetched({**s, "revision": "f" * 40}, tmp_path, download)
    assert len(loads) == 2 and (folder / ingest.MARKER).read_text() == "f" * 40
    with pytest.raises(manifest.ManifestError):
        packed(tmp_path / "two.tgz", ["one/a", "two/b"])
        ingest.unpack(tmp_path / "two.tgz", tmp_path / "two")
    assert (folder / "src/a.py").exists() and not (tmp_path / "two").exists()
    assert ingest.fetched({"id": "s", "kind": "samples", "path": "here"}, tmp_path) == ingest.Path("here")


def test_pinning():
    seen = []
    run = lambda a, f: (seen.append(a[1]), SHA.upper() + "\trefs/heads/x\n")[1]
    assert ingest.pinned("u", "x", run=run) == SHA and ingest.pinned("u", before="2020-01-01", run=run) == SHA and seen == ["ls-remote", "clone", "rev-list"]
    with pytest.raises(ValueError):
        ingest.pinned("u", run=lambda a, f: "")


def test_entries_from_addresses():
    assert manifest.source_of("https://github.com/a/My.Tool.git", 1)["id"] == "my-tool"
    assert [manifest.source_of(u, 0)["kind"] for u in ("git@github.com:a/b", "https://other.org/a/b", "a/b")] == ["github", "git", "git"]
    with pytest.raises(manifest.ManifestError):
        manifest.source_of("https://x/---", 0)


# --- inputs and output --------------------------------------------------------------------------------
def test_inputs(spark, tmp_path):
    (tmp_path / "pkg" / "tests").mkdir(parents=True)
    (tmp_path / "pkg" / "b.py").write_text("b = 1  \r\n")
    (tmp_path / "pkg" / "a.rs").write_text("fn a() {}")
    (tmp_path / "pkg" / "tests" / "t.py").write_text("no")
    (tmp_path / "free.txt").write_text("any text")
    got = inputs.collected(spark, [str(tmp_path / "pkg"), "-", str(tmp_path / "free.txt")], stdin=io.BytesIO(b"piped")).orderBy("position").collect()
    assert [(r["file_id"].split("/")[-1], r["text"]) for r in got] == [("a.rs", "fn a() {}\n"), ("b.py", "b = 1\n"), ("<stdin>", "piped\n"), ("free.txt", "any text\n")]
    assert inputs.collected(spark, code="x").first()["file_id"] == "<argument>"
    (tmp_path / "zero").write_bytes(b"a\0b")
    (tmp_path / "none").mkdir()
    for paths, code, pipe in ((["-", "-"], None, b"x"), ([str(tmp_path / "zero")], None, b""), ([str(tmp_path / "lost")], None, b""), ([str(tmp_path / "none")], None, b""), ([], " \n", b""), ([], None, b"")):
        with pytest.raises(inputs.InputError):
            inputs.collected(spark, paths, code, io.BytesIO(pipe))
    assert inputs.shown(tmp_path / "pkg" / "a.rs", tmp_path) == "pkg/a.rs" and inputs.shown("/elsewhere/x", tmp_path) == "/elsewhere/x"


def test_rendering():
    row = {"file_id": "f", "prediction": "ai", "ai_probability": 0.75, "human_probability": 0.25, "n_windows": 2, "window_probabilities": [0.5, 1.0]}
    one = score.results([row], ["f"], chunks=True)
    assert score.rendered(one) == "Input: f\nPrediction: ai\nAI probability: 75.00%\nHuman probability: 25.00%\nChunks: 2 (mean)\nChunk AI probabilities: 50.00%, 100.00%"
    assert json.loads(score.rendered(one, True))["chunks"] == 2 and len(json.loads(score.rendered(one * 2, True))) == 2 and "\n\nInput" in score.rendered(one * 2)


# --- artifacts ----------------------------------------------------------------------------------------
class Session:
    """Stands in for a runtime: the second logit is the number of real tokens."""

    def __init__(self, path):
        assert path.endswith("model.onnx")

    def run(self, _, feed):
        assert feed["input_ids"].shape[1] % 8 == 0
        return [[[0.0, float(n)] for n in feed["attention_mask"].sum(1)]]


def test_artifact(spark, tmp_path):
    from tokenizers import Tokenizer, models, pre_tokenizers, processors

    t = Tokenizer(models.WordLevel({"[U]": 0, "[S]": 1, "[E]": 2, "a": 3}, unk_token="[U]"))
    t.pre_tokenizer = pre_tokenizers.Whitespace()
    t.post_processor = processors.TemplateProcessing(single="[S] $A [E]", special_tokens=[("[S]", 1), ("[E]", 2)])
    t.save(str(tmp_path / "tokenizer.json"))
    (tmp_path / "model.onnx").write_bytes(b"")
    (tmp_path / score.ARTIFACT).write_text(json.dumps({"pad_token_id": 0, "max_length": 6, "stride": 1, "batch_size": 2}))
    a = score.Artifact.of_folder(tmp_path).changed(session=Session)
    assert (a.max_length, a.threshold, a.special(), a.marks()) == (6, 0.5, 2, ([1], [2]))
    got = {r["file_id"]: r for r in a.build()(spark.createDataFrame([("x", "a a a a a a"), ("y", " ")], "file_id string, text string")).collect()}
    assert got["x"]["n_windows"] == 2 and got["x"]["prediction"] == "ai" and got["y"]["status"] == "empty_input"
    for bad in ({"batch_size": 0}, {"threshold": 2.0}, {"stride": 4}, {"max_length": 1}, {"aggregation": "sum"}, {"model_file": "none"}, {"pad_token_id": None}, {"tokenizer_file": "none"}):
        with pytest.raises(ValueError):
            a.changed(**bad).build()
    for text in ("[", "{}", '{"pad_token_id": "x"}'):
        (tmp_path / score.ARTIFACT).write_text(text)
        with pytest.raises(ValueError):
            score.Artifact.of_folder(tmp_path)


def test_window_settings(tmp_path):
    for text, want in ((None, (1024, 128)), ('{"max_length": 200}', (200, 50)), ('{"max_length": 1}', (1024, 128)), ('{"max_length": 300, "stride": 7}', (300, 7)), ('{"stride": -1}', (1024, 128)), ("[", (1024, 128)), ('{"max_length": "x"}', (1024, 128)), ("[1]", (1024, 128))):
        if text is not None:
            (tmp_path / score.RUN_CONFIG).write_text(text)
        assert score.window_settings(tmp_path) == want


# --- service ------------------------------------------------------------------------------------------
def ask(method, path, body=b"", estimate=None):
    return service.respond(method, path, body, lambda code: {"prediction": "human"} if code.strip() else None, estimate or (lambda repo, ref: {"repo": repo, "ref": ref}))


def test_routes():
    assert ask("GET", "/health") == (200, {"status": "ok"}) and ask("POST", "/code", b'{"code": "y"}') == (200, {"prediction": "human"})
    assert ask("POST", "/github", b'{"repository": "p/q", "ref": "r"}') == (200, {"repo": "p/q", "ref": "r"})
    for method, path, body, status in (("POST", "/code", b'{"code": ""}', 400), ("POST", "/code", b'{"code": "y", "more": 1}', 422), ("POST", "/code", b"{}", 422), ("POST", "/code", b"nope", 400), ("GET", "/else", b"", 404), ("PUT", "/health", b"", 405), ("POST", "/github", b'{"repository": "p/q", "ref": " "}', 400), ("POST", "/github", b'{"repository": "p/q", "ref": 3}', 422), ("POST", "/code", b" " * (2 << 20) + b" ", 413)):
        assert ask(method, path, body)[0] == status

    def fails(error):
        def estimate(*_):
            raise error

        return ask("POST", "/github", b'{"repository": "p/q"}', estimate)

    assert fails(tree.AccessError("upstream", "m", 429)) == (429, {"error": {"code": "github_request_failed", "message": "m"}})
    assert fails(tree.AccessError("not_found", "m"))[0] == 404 and fails(RuntimeError("m"))[1]["error"]["code"] == "repository_analysis_failed"
    assert service.failure("classifier", "m")[0] == 500


def parsed(frames):
    return [(f.split("\n")[0][7:], json.loads(f.split("data: ")[1])) for f in frames if not f.startswith(":")]


def test_streamed_events(spark):
    files = {f"f{i}.py": "ai\nhuman\n" for i in range(4)}
    run = lambda acc, told: scan.analyze(spark, acc, E.Sampling(min_files=9), on_progress=told)
    status, events = service.streamed(b'{"repository": "a/b"}', lambda r, f: tree.MapAccessor(files), run)
    got = parsed(events)
    assert status == 200 and [k for k, _ in got] == ["progress"] * 5 + ["complete"] and [d["files_scanned"] for _, d in got] == [0, 1, 2, 3, 4, 4]

    def broken(acc, told):
        told({"files_scanned": 0})
        raise tree.AccessError("not_found", "x")

    assert [k for k, _ in parsed(service.streamed(b'{"repository": "a/b"}', lambda r, f: None, broken)[1])] == ["progress", "error"]

    def refused(r, f):
        raise tree.AccessError("invalid_repository", r)

    assert service.streamed(b'{"repository": "-"}', refused, broken)[0] == 400 and service.streamed(b"{}", refused, broken)[0] == 422


def test_slow_readers_miss_no_end_and_closing_cancels():
    def many(acc, told):
        for i in range(100):
            told({"n": i})
        return {"n": "all"}

    got = parsed(service.streamed(b'{"repository": "a/b"}', lambda r, f: None, many)[1])
    assert got[-1] == ("complete", {"n": "all"}) and sum(k == "complete" for k, _ in got) == 1
    stopped, release = threading.Event(), threading.Event()

    def endless(acc, told):
        while told({"n": 1}):
            release.wait(0.01)
        stopped.set()
        return {}

    events = service.streamed(b'{"repository": "a/b"}', lambda r, f: None, endless)[1]
    next(events)
    events.close()
    assert stopped.wait(5)
    idle = service.streamed(b'{"repository": "a/b"}', lambda r, f: None, lambda acc, told: (release.wait(0.2), {})[1], idle=0.02)[1]
    assert next(idle) == ": keep-alive\n\n" and parsed(idle)[-1][0] == "complete"


def test_settings():
    assert service.address({"LODESTONE_BIND": "x:1", "PORT": "2"}) == "x:1" and service.address({"HOST": "h", "LODESTONE_PORT": "3", "PORT": "2"}) == "h:3" and service.address({}) == "0.0.0.0:5000"
    assert service.model_folder({"LODESTONE_MODEL_DIR": "m"}) == "m"


def test_tools():
    a = tree.MapAccessor({"notes/plan.md": "straße 9", "run.sh": "echo"})
    assert json.loads(service.call_tool(a, "tool_list_directory", {"relative_path": "notes"})) == [{"name": "plan.md", "entry_type": "file", "size": 9}]
    assert json.loads(service.call_tool(a, "tool_read_file", {"relative_path": "notes/plan.md", "offset": 4, "limit": 4})) == "ße 9"
    for name, arguments in (("tool_move", {}), ("tool_read_file", {}), ("tool_read_file", {"relative_path": "run.sh", "limit": -2}), ("tool_read_file", {"relative_path": "run.sh", "limit": True}), ("tool_list_directory", {"relative_path": ".", "x": 1}), ("tool_read_file", {"relative_path": "gone"})):
        assert set(json.loads(service.call_tool(a, name, arguments))) == {"error"}
    assert {t["name"] for t in service.tool_schemas()} == set(service.TOOLS)


def test_judging():
    a = tree.MapAccessor({"run.sh": "echo"})
    calls = [{"content": "", "tool_calls": [{"name": "tool_read_file", "arguments": {"relative_path": "run.sh"}}]}] * 60
    end = {"content": json.dumps({"is_ai": False, "is_human": True, "key_files": ["run.sh"], "comments": "short"})}
    replies = iter([*calls, end])
    assert service.judge(a, lambda m: next(replies), "look")["is_human"]
    for bad in ({"is_ai": 1, "is_human": True, "key_files": [], "comments": ""}, {"is_ai": True}, {"is_ai": True, "is_human": False, "key_files": [1], "comments": ""}):
        with pytest.raises(ValueError):
            service.judge(a, lambda m, bad=bad: {"content": json.dumps(bad)}, "look")
