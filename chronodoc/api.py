"""The service by HTTP routes and by JSON-RPC tools: one table of each, no logic beyond finding and checking the call."""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from threading import Lock
from typing import Any
from urllib.parse import parse_qs, unquote, urlsplit

from chronodoc.model import InvalidRequest, StoreError, UniqueViolation, UnknownIndex, UnknownSnapshot
from chronodoc.service import AdminService, problem


class Refused(Exception):
    """A request that is answered by a problem document."""

    def __init__(self, status: int, title: str, detail: str | None = None):
        super().__init__(title)
        self.status, self.title, self.detail = status, title, detail


def _known(s: AdminService, name: str) -> str:
    if name not in s.store.list_collections():
        raise Refused(404, "not found")
    return name


def _create(s: AdminService, body: dict) -> dict:
    if body["name"] in s.store.list_collections():
        raise Refused(409, "conflict", "the collection is there already")
    return s.create_collection(body["name"]) | {"recordsApprox": 0}


def _define(s: AdminService, c: str, body: dict) -> dict:
    if body["name"] in s.list_index_names(_known(s, c)):
        raise Refused(409, "conflict", "the index is there already")
    return s.define_index(c, body)


def _put(s: AdminService, c: str, i: str, body: dict) -> tuple[int, dict]:
    if body.get("id", i) != i:
        raise Refused(400, "invalid body", "the body names another id than the path")
    before = s.get_record(c, i)
    return (200 if before else 201), s.put_record(c, body | {"id": i})


def _found(x: Any) -> Any:
    if not x:
        raise Refused(404, "not found")
    return x


def _delete(s: AdminService, c: str, i: str) -> None:
    _found(s.get_record(c, i))
    s.delete_record(c, i)


def _compact(s: AdminService, body: dict) -> None:
    if body["mode"] not in ("tick", "full"):
        raise Refused(400, "invalid body", "mode is tick or full")
    s.compaction_run()


def _page(q: dict) -> tuple[int, str | None]:
    return int(q.get("pageSize", 0)), q.get("pageToken")


#: (method, path pattern) to (status, function of service, path parts, query, body); a function may give its own status.
ROUTES: list[tuple[str, str, int, Callable]] = [
    ("GET", "/health", 200, lambda s, p, q, b: s.health()),
    ("GET", "/status", 200, lambda s, p, q, b: s.status() | {"collectionsCount": len(s.store.list_collections()), "compaction": s.compaction_status()}),
    ("GET", "/metrics", 200, lambda s, p, q, b: s.metrics(q.get("format") == "prometheus")),
    ("GET", "/collections", 200, lambda s, p, q, b: s.list_collections(*_page(q))),
    ("POST", "/collections", 201, lambda s, p, q, b: _create(s, b)),
    ("GET", "/collections/*", 200, lambda s, p, q, b: {"name": _known(s, p[0]), "version": None, "indexes": s.list_index_definitions(p[0])["items"]}),
    ("DELETE", "/collections/*", 204, lambda s, p, q, b: s.drop_collection(_known(s, p[0])) and None),
    ("GET", "/collections/*/indexes", 200, lambda s, p, q, b: s.list_index_definitions(_known(s, p[0]), *_page(q))),
    ("POST", "/collections/*/indexes", 201, lambda s, p, q, b: _define(s, p[0], b)),
    ("GET", "/collections/*/records/*", 200, lambda s, p, q, b: _found(s.get_record(p[0], p[1], q.get("snapshot")))),
    ("PUT", "/collections/*/records/*", 200, lambda s, p, q, b: _put(s, p[0], p[1], b)),
    ("DELETE", "/collections/*/records/*", 204, lambda s, p, q, b: _delete(s, *p)),
    ("POST", "/collections/*/query", 200, lambda s, p, q, b: s.query(p[0], b.get("query", b), b.get("snapshotId"))),
    ("GET", "/backups", 200, lambda s, p, q, b: s.list_backups(*_page(q))),
    ("POST", "/backups", 201, lambda s, p, q, b: s.create_backup(b.get("note"))),
    ("POST", "/backups/*/restore", 202, lambda s, p, q, b: s.restore_backup(p[0])),
    ("POST", "/snapshots", 201, lambda s, p, q, b: s.create_snapshot()),
    ("DELETE", "/snapshots/*", 204, lambda s, p, q, b: _found(s.release_snapshot(p[0])) and None),
    ("GET", "/compaction/status", 200, lambda s, p, q, b: s.compaction_status()),
    ("POST", "/compaction/run", 202, lambda s, p, q, b: _compact(s, b)),
    ("POST", "/transactions", 200, lambda s, p, q, b: s.commit_transaction(b)),
]
COMPILED = [(m, re.compile(re.escape(path).replace(r"\*", "([^/]+)") + "/?"), status, f) for m, path, status, f in ROUTES]


def allowed(headers: dict[str, str], key: str | None) -> bool:
    """Without a key everything is; else it must come as ``x-api-key`` or as a bearer token."""
    if not key:
        return True
    h = {k.lower(): v for k, v in headers.items()}
    given = h.get("x-api-key")
    if given is None and h.get("authorization", "").lower().startswith("bearer "):
        given = h["authorization"][7:]
    return given == key


def handle(service: AdminService, method: str, url: str, body: bytes = b"", headers: dict[str, str] | None = None, key: str | None = None) -> tuple[int, Any]:
    """(status, answer) of a request; the answer is None, a text, or a dictionary (a problem document from 400 on)."""
    try:
        if not allowed(headers or {}, key):
            raise Refused(401, "unauthorized")
        parts = urlsplit(url)
        for m, path, status, f in COMPILED:
            hit = path.fullmatch(parts.path)
            if hit and m == method:
                try:
                    given = json.loads(body) if body else {}
                    if not isinstance(given, dict):
                        raise ValueError
                except ValueError:
                    raise Refused(400, "invalid body") from None
                query = {k: v[-1] for k, v in parse_qs(parts.query).items()}
                out = f(service, [unquote(x) for x in hit.groups()], query, given)
                return out if isinstance(out, tuple) else (status, out)
        raise Refused(404, "not found")
    except Refused as e:
        return e.status, problem(e.title, e.status, e.detail)
    except UniqueViolation as e:
        return 409, problem("unique constraint", 409, f"key {e.key} of index {e.index} is taken")
    except (UnknownSnapshot, UnknownIndex) as e:
        return 404, problem("not found", 404, str(e))
    except (InvalidRequest, KeyError, TypeError, ValueError) as e:
        return 400, problem("invalid request", 400, str(e))
    except StoreError as e:
        return 500, problem("failed", 500, str(e))


def serve(service: AdminService, port: int, key: str | None = None, host: str = "127.0.0.1") -> ThreadingHTTPServer:
    """A server for the routes; call ``serve_forever`` on it. One request works on the store at a time."""
    lock = Lock()

    class Handler(BaseHTTPRequestHandler):
        def answer(self) -> None:
            body = self.rfile.read(int(self.headers.get("content-length") or 0))
            with lock:
                status, out = handle(service, self.command, self.path, body, dict(self.headers), key)
            data = b"" if out is None else out.encode() if isinstance(out, str) else json.dumps(out, ensure_ascii=False).encode()
            self.send_response(status)
            kind = "text/plain" if isinstance(out, str) else "application/problem+json" if status >= 400 else "application/json"
            self.send_header("content-type", kind)
            self.send_header("content-length", str(len(data)))
            self.end_headers()
            self.wfile.write(data)

        do_GET = do_POST = do_PUT = do_DELETE = answer

        def log_message(self, *args) -> None:
            pass

    return ThreadingHTTPServer((host, port), Handler)


#: tool to (required arguments, function of service and arguments)
TOOLS: dict[str, tuple[list[str], Callable]] = {
    "health": ([], lambda s, a: s.health()),
    "status": ([], lambda s, a: s.status()),
    "metrics": ([], lambda s, a: s.metrics()),
    "collections.list": ([], lambda s, a: s.list_collections()),
    "collections.create": (["name"], lambda s, a: s.create_collection(a["name"])),
    "collections.drop": (["name"], lambda s, a: s.drop_collection(a["name"])),
    "indexes.list": (["collection"], lambda s, a: {"items": s.list_index_names(a["collection"])}),
    "indexes.definitions": (["collection"], lambda s, a: s.list_index_definitions(a["collection"])),
    "indexes.define": (["collection", "definition"], lambda s, a: s.define_index(a["collection"], a["definition"])),
    "indexes.rebuild": ([], lambda s, a: {"rebuilt": s.rebuild_dynamic_indexes()}),
    "record.put": (["collection", "id", "data"], lambda s, a: s.put_record(a["collection"], {k: a.get(k) for k in ("id", "data", "version")})),
    "record.get": (["collection", "id"], lambda s, a: {k: v for k, v in (s.get_record(a["collection"], a["id"], a.get("snapshotId")) or {}).items() if k in ("id", "data", "version")} or None),
    "record.getMeta": (["collection", "id"], lambda s, a: s.get_record(a["collection"], a["id"], a.get("snapshotId"))),
    "record.delete": (["collection", "id"], lambda s, a: s.delete_record(a["collection"], a["id"])),
    "query": (["collection", "query"], lambda s, a: s.query(a["collection"], a["query"], a.get("snapshotId"))),
    "transaction.commit": (["transaction"], lambda s, a: s.commit_transaction(a["transaction"])),
    "snapshot.create": ([], lambda s, a: s.create_snapshot()),
    "snapshot.release": (["snapshotId"], lambda s, a: {"released": s.release_snapshot(a["snapshotId"])}),
    "compaction.status": ([], lambda s, a: s.compaction_status()),
    "compaction.tick": ([], lambda s, a: s.compaction_run()),
}


def rpc(service: AdminService, request: dict) -> dict | None:
    """The answer to a JSON-RPC request (``initialize``, ``tools/list``, ``tools/call``); None to a notification."""
    if "id" not in request:
        return None
    answer = {"jsonrpc": "2.0", "id": request["id"]}
    params = request.get("params") or {}
    if request.get("method") == "initialize":
        return answer | {"result": {"serverInfo": {"name": "chronodoc"}, "capabilities": {"tools": {}}}}
    if request.get("method") == "tools/list":
        schema = lambda need: {"type": "object", "required": need, "properties": {n: {} for n in need}}
        return answer | {"result": {"tools": [{"name": f"chronodoc.{n}", "inputSchema": schema(need)} for n, (need, _) in TOOLS.items()]}}
    if request.get("method") != "tools/call":
        return answer | {"error": {"code": -32601, "message": "no such method"}}
    need, call = TOOLS.get(str(params.get("name", "")).removeprefix("chronodoc."), ([], None))
    given = params.get("arguments") or {}
    missing = [n for n in need if n not in given]
    if call is None or missing:
        return answer | {"error": {"code": -32602, "message": f"missing: {', '.join(missing)}" if call else "no such tool"}}
    try:
        return answer | {"result": call(service, given)}
    except (StoreError, KeyError, TypeError) as e:
        return answer | {"error": {"code": -32000, "message": str(e)}}


def rpc_stream(service: AdminService, source, sink) -> None:
    """Serve JSON-RPC messages framed by ``Content-Length`` headers from one binary stream to another until it ends."""
    while True:
        length = None
        while (line := source.readline()).strip():
            name, _, value = line.partition(b":")
            if name.strip().lower() == b"content-length":
                length = int(value)
        if length is None:
            return
        reply = rpc(service, json.loads(source.read(length)))
        if reply is not None:
            data = json.dumps(reply, ensure_ascii=False).encode()
            sink.write(b"Content-Length: %d\r\n\r\n" % len(data) + data)
            sink.flush()
