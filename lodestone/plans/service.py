"""A thin façade: JSON answers and errors of the service, and the tools of a judging model."""

from __future__ import annotations

import contextlib
import json
import queue
import threading
from collections.abc import Callable, Iterator, Mapping

from ..sources.tree import Accessor, AccessError

BODY_LIMIT = 2 * 1024 * 1024
# Status and code of each kind of error.
ERRORS = {
    "empty_input": (400, "invalid_code"),
    "invalid_path": (400, "invalid_repository"),
    "invalid_repository": (400, "invalid_repository"),
    "invalid_ref": (400, "invalid_ref"),
    "permission_denied": (403, "github_permission_denied"),
    "not_found": (404, "repository_not_found"),
    "http": (502, "github_unavailable"),
    "metadata": (502, "github_unavailable"),
    "io": (500, "repository_access_failed"),
    "utf8": (500, "repository_access_failed"),
    "classifier": (500, "classification_failed"),
    "pipeline": (500, "repository_analysis_failed"),
}
QUEUE = 16  # progress events that may wait for a slow reader
KEEP_ALIVE = 15.0  # seconds without an event after which a comment is sent


def failure(kind: str, message: str, upstream: int | None = None) -> tuple[int, dict]:
    """upstream: the status that a repository's host gave, which is passed on."""
    status, code = (upstream or 502, "github_request_failed") if kind == "upstream" else ERRORS.get(kind, (500, "internal_error"))
    return status, {"error": {"code": code, "message": message}}


def failed(e: Exception, fallback: str) -> tuple[int, dict]:
    return failure(e.kind, str(e), e.status) if isinstance(e, AccessError) else failure(fallback, str(e))


def request(method: str, path: str, body: bytes) -> dict | tuple[int, dict]:
    """The checked fields of a request, or the answer that refuses it. Routes: GET /health, POST /code {code}, POST /github
    and POST /github-stream {repository, ref?}; other fields are refused."""
    routes = {"/health": ("GET", ()), "/code": ("POST", ("code",)), "/github": ("POST", ("repository", "ref")), "/github-stream": ("POST", ("repository", "ref"))}
    if path not in routes:
        return 404, {"error": {"code": "not_found", "message": path}}
    want, fields = routes[path]
    if method != want:
        return 405, {"error": {"code": "method_not_allowed", "message": method}}
    if path == "/health":
        return {}
    if len(body) > BODY_LIMIT:
        return 413, {"error": {"code": "body_too_large", "message": "at most 2 MiB"}}
    try:
        data = json.loads(body)
    except ValueError:
        return 400, {"error": {"code": "invalid_json", "message": "the body is not JSON"}}
    if not isinstance(data, dict) or set(data) - set(fields) or not isinstance(data.get(fields[0]), str) or not isinstance(data.get("ref"), str | None):
        return 422, {"error": {"code": "invalid_json", "message": f"fields: {', '.join(fields)}"}}
    if data.get("ref") is not None and not data["ref"].strip():
        return failure("invalid_ref", "ref must not be empty")
    return data


def respond(method: str, path: str, body: bytes, classify: Callable[[str], dict | None], estimate: Callable[[str, str | None], dict]) -> tuple[int, dict]:
    """The status and JSON of a request with one answer; /github-stream has streamed()."""
    data = request(method, path, body)
    if isinstance(data, tuple):
        return data
    if path == "/health":
        return 200, {"status": "ok"}
    try:
        if path == "/code":
            result = classify(data["code"])
            return failure("empty_input", "no code") if result is None else (200, result)
        return 200, estimate(data["repository"], data.get("ref"))
    except Exception as e:
        return failed(e, "classifier" if path == "/code" else "pipeline")


def frame(kind: str, data: dict) -> str:
    """One server-sent event."""
    return f"event: {kind}\ndata: {json.dumps(data, ensure_ascii=False)}\n\n"


def streamed(body: bytes, open_: Callable[[str, str | None], Accessor], estimate: Callable[[Accessor, Callable[[dict], bool]], dict], idle: float = KEEP_ALIVE) -> tuple[int, dict | Iterator[str]]:
    """POST /github-stream: an error answer, or 200 and server-sent events: progress after the selection and each file (some
    may be left out for a slow reader, never the newest), then one complete or one error; comments while nothing happens.

    open_ makes the accessor, whose errors still have a status; estimate(accessor, on_progress) runs beside the reader and
    is cancelled (on_progress gives False, on_progress.cancelled() True) once the reader closes the events."""
    data = request("POST", "/github-stream", body)
    if isinstance(data, tuple):
        return data
    try:
        accessor = open_(data["repository"], data.get("ref"))
    except Exception as e:
        return failed(e, "pipeline")

    def events() -> Iterator[str]:
        waiting: queue.Queue = queue.Queue(QUEUE)
        closed = threading.Event()

        def told(stats: dict) -> bool:
            try:
                waiting.put_nowait(("progress", stats))
            except queue.Full:  # the oldest gives way, so that the newest is never lost
                with contextlib.suppress(queue.Empty):
                    waiting.get_nowait()
                waiting.put(("progress", stats))
            return not closed.is_set()

        told.cancelled = closed.is_set

        def work() -> None:
            try:
                last = ("complete", estimate(accessor, told))
            except Exception as e:
                last = ("error", failed(e, "pipeline")[1]["error"])
            while not closed.is_set():
                with contextlib.suppress(queue.Full):
                    return waiting.put(last, timeout=0.1)

        threading.Thread(target=work, daemon=True).start()
        try:
            while True:
                try:
                    kind, stats = waiting.get(timeout=idle)
                except queue.Empty:
                    yield ": keep-alive\n\n"
                    continue
                yield frame(kind, stats)
                if kind != "progress":
                    return
        finally:
            closed.set()

    return 200, events()


def address(env: Mapping[str, str]) -> str:
    """host:port to listen on: LODESTONE_BIND whole, else LODESTONE_HOST or HOST, and LODESTONE_PORT or PORT."""
    if "LODESTONE_BIND" in env:
        return env["LODESTONE_BIND"]
    return f"{env.get('LODESTONE_HOST', env.get('HOST', '0.0.0.0'))}:{env.get('LODESTONE_PORT', env.get('PORT', '5000'))}"


def model_folder(env: Mapping[str, str]) -> str:
    return env.get("LODESTONE_MODEL_DIR", "detector-onnx")


# Names and arguments of the judging model's tools, and the fields of its verdict.
TOOLS = {"tool_read_file": {"relative_path": str, "offset": int, "limit": int}, "tool_list_directory": {"relative_path": str}}
VERDICT = {"is_ai": bool, "is_human": bool, "key_files": list, "comments": str}


def tool_schemas() -> list[dict]:
    """The tools as JSON schemas for a chat interface."""
    kinds = {str: {"type": "string"}, int: {"type": "integer", "minimum": 0}}
    return [{"name": n, "schema": {"type": "object", "properties": {k: kinds[t] for k, t in fields.items()}, "required": ["relative_path"]}} for n, fields in TOOLS.items()]


def call_tool(accessor: Accessor, name: str, arguments: dict) -> str:
    """Runs one of TOOLS; what it gives, and any error, comes as JSON."""
    compact = lambda x: json.dumps(x, ensure_ascii=False, separators=(",", ":"))
    if name not in TOOLS:
        return compact({"error": f"unknown tool: {name}"})
    fields = TOOLS[name]
    wrong = [k for k in arguments if k not in fields] + [k for k, t in fields.items() if (k == "relative_path" or arguments.get(k) is not None) and (type(arguments.get(k)) is not t or (t is int and arguments[k] < 0))]
    if wrong:
        return compact({"error": f"invalid tool arguments: {', '.join(wrong)}"})
    try:
        if name == "tool_list_directory":
            return compact(accessor.list_dir(arguments["relative_path"]))
        return compact(accessor.read_file(arguments["relative_path"], arguments.get("offset"), arguments.get("limit")))
    except AccessError as e:
        return compact({"error": str(e)})


def judge(accessor: Accessor, chat: Callable[[list[dict]], dict], task: str) -> dict:
    """Runs chat until it calls no more tools and parses its verdict. chat is injected; nothing here reaches a network."""
    messages = [{"role": "user", "content": task}]
    while True:
        reply = chat(messages)
        messages.append({"role": "assistant", **reply})
        if not reply.get("tool_calls"):
            out = json.loads(reply["content"])
            if not isinstance(out, dict) or set(out) != set(VERDICT) or any(type(out[k]) is not t for k, t in VERDICT.items()) or any(type(f) is not str for f in out["key_files"]):
                raise ValueError("a verdict has is_ai, is_human, key_files and comments")
            return out
        messages += [{"role": "tool", "content": call_tool(accessor, t["name"], t["arguments"])} for t in reply["tool_calls"]]
