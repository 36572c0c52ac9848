"""Routes and tools over a store."""

import io
import json
import threading
import urllib.request

import pytest

from chronodoc import api
from chronodoc.service import AdminService
from chronodoc.sources.store import Store


@pytest.fixture
def service(spark, tmp_path):
    return AdminService(Store(spark, f"file://{tmp_path}/s"))


def test_routes(service):
    def call(method, url, body=None, **kw):
        return api.handle(service, method, url, b"" if body is None else json.dumps(body).encode(), **kw)

    assert call("POST", "/collections", {"name": "things"})[0] == 201
    assert call("POST", "/collections", {"name": "things"})[0] == 409 and call("POST", "/collections", {"name": "no spaces"})[0] == 400
    assert call("POST", "/collections", {})[0] == 400 and api.handle(service, "POST", "/collections", b"{torn")[0] == 400
    assert call("POST", "/collections/things/indexes", {"name": "byTag", "kind": "multi", "keyPath": ".tags[]"})[0] == 201
    assert call("POST", "/collections/things/indexes", {"name": "byTag", "kind": "multi"})[0] == 409
    assert call("GET", "/collections/things")[1]["indexes"][0]["keyPath"] == ".tags[]" and call("GET", "/collections/none")[0] == 404
    assert call("PUT", "/collections/things/records/a", {"data": {"tags": ["x"]}}) == (201, {"id": "a", "data": {"tags": ["x"]}, "version": None, "sequence": 1, "deleted": False})
    assert call("PUT", "/collections/things/records/a", {"id": "b", "data": {}})[0] == 400
    snapshot = call("POST", "/snapshots")[1]["id"]
    assert call("PUT", "/collections/things/records/a", {"data": {"tags": ["y"]}})[0] == 200
    assert call("GET", f"/collections/things/records/a?snapshot={snapshot}")[1]["data"] == {"tags": ["x"]}
    q = {"query": {"type": "indexEquals", "index": "byTag", "key": "y"}}
    assert [i["id"] for i in call("POST", "/collections/things/query", q)[1]["items"]] == ["a"]
    assert call("POST", "/collections/things/query", {"query": {"type": "what"}})[0] == 400
    tx = {"operations": [{"op": "put", "collection": "things", "record": {"id": "b", "data": {"tags": []}}}]}
    assert call("POST", "/transactions", tx)[1]["committedSequence"] == 3
    backup = call("POST", "/backups", {"note": "n"})[1]
    assert call("GET", "/backups?pageSize=1")[1]["items"][0]["id"] == backup["id"]
    assert call("DELETE", "/collections/things/records/a") == (204, None) and call("DELETE", "/collections/things/records/a")[0] == 404
    assert call("POST", f"/backups/{backup['id']}/restore")[0] == 202 and call("GET", "/collections/things/records/a")[0] == 200
    assert call("GET", "/status")[1]["collectionsCount"] == 1 and call("GET", "/health")[1]["status"] == "ok"
    assert "chronodoc_puts_total" in call("GET", "/metrics?format=prometheus")[1]
    assert call("POST", "/compaction/run", {"mode": "tick"})[0] == 202 and call("POST", "/compaction/run", {"mode": "x"})[0] == 400
    assert call("GET", "/compaction/status")[1]["running"] is False
    assert call("DELETE", f"/snapshots/{snapshot}")[0] == 204 and call("DELETE", f"/snapshots/{snapshot}")[0] == 404
    assert call("DELETE", "/collections/things")[0] == 204 and call("GET", "/collections")[1]["items"] == []
    assert call("GET", "/nothing")[0] == 404


def test_keys(service):
    for headers, status in (({}, 401), ({"X-Api-Key": "k"}, 200), ({"Authorization": "Bearer k"}, 200), ({"Authorization": "Bearer x"}, 401)):
        assert api.handle(service, "GET", "/health", b"", headers, "k")[0] == status


def test_server(service):
    server = api.serve(service, 0, "k")
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        request = urllib.request.Request(f"http://127.0.0.1:{server.server_port}/health", headers={"x-api-key": "k"})
        with urllib.request.urlopen(request, timeout=60) as r:
            assert r.status == 200 and json.load(r)["status"] == "ok"
    finally:
        server.shutdown()
        server.server_close()


def test_tools(service):
    def call(tool, /, **arguments):
        return api.rpc(service, {"jsonrpc": "2.0", "id": 1, "method": "tools/call", "params": {"name": f"chronodoc.{tool}", "arguments": arguments}})

    assert len(api.rpc(service, {"id": 1, "method": "tools/list"})["result"]["tools"]) == 20
    assert call("collections.create", name="c")["result"] == {"name": "c"} and call("collections.list")["result"]["items"] == ["c"]
    assert call("record.put", collection="c", id="1", data={"v": 1})["result"]["sequence"] == 1
    assert call("record.get", collection="c", id="1")["result"] == {"id": "1", "data": {"v": 1}, "version": None}
    assert call("record.getMeta", collection="c", id="1")["result"]["sequence"] == 1
    assert call("record.put", collection="c")["error"]["code"] == -32602 and call("what")["error"]["code"] == -32602
    assert call("collections.create", name="no spaces")["error"]["code"] == -32000
    assert api.rpc(service, {"id": 2, "method": "what"})["error"]["code"] == -32601 and api.rpc(service, {"method": "initialized"}) is None
    frame = lambda d: b"Content-Length: %d\r\n\r\n" % len(d) + d
    out = io.BytesIO()
    messages = [{"id": 1, "method": "initialize"}, {"method": "initialized"}, {"id": 2, "method": "tools/call", "params": {"name": "chronodoc.health"}}]
    api.rpc_stream(service, io.BytesIO(b"".join(frame(json.dumps(m).encode()) for m in messages)), out)
    assert out.getvalue().count(b"Content-Length") == 2 and b'"sequence": 1' in out.getvalue()
