"""The HTTP routes."""

import json
import threading
from urllib.error import HTTPError
from urllib.parse import quote
from urllib.request import Request, urlopen

import pytest

from lodestone.service import server
from lodestone.store import DocumentStore


@pytest.fixture
def call(spark, tmp_path):
    serving = server(DocumentStore(spark, str(tmp_path)), 0)
    threading.Thread(target=serving.serve_forever, daemon=True).start()

    def call(method, path, body=None):
        data = body if isinstance(body, bytes) or body is None else json.dumps(body).encode()
        try:
            with urlopen(Request(f"http://127.0.0.1:{serving.server_port}{path}", data, method=method)) as r:
                return r.status, json.load(r)
        except HTTPError as e:
            return e.code, json.load(e)

    yield call
    serving.shutdown()
    serving.server_close()


def test_routes(call):
    body = {"title": "Hello", "content": "World", "tags": ["greeting"]}
    name = "/documents/" + quote("a b/ü", safe="")
    assert call("POST", name, body)[1]["result"] == "created"
    assert call("GET", name) == (200, body)
    status, found = call("GET", "/search?q=hello")
    assert status == 200 and [{k: v for k, v in d.items() if k != "_score"} for d in found] == [body] and found[0]["_score"] > 0
    assert call("GET", "/search?q=hello&size=0") == (200, [])
    assert call("DELETE", name) == (200, {"deleted": "a b/ü"})
    for method in ("GET", "DELETE"):
        assert call(method, name) == (404, {"detail": "Document not found"})
    assert call("GET", "/search?q=") == (200, [])


def test_requests_that_do_not_fit(call):
    assert call("GET", "/search")[0] == 422 and call("GET", "/search?q=a&size=x")[0] == 422
    assert call("GET", "/search?q=a&size=-1")[0] == 400
    assert call("POST", "/documents/a", b"[1]")[0] == 422 and call("POST", "/documents/a", b"{")[0] == 422
    assert call("POST", "/documents/a", {"title": {"x": 1}})[0] == 400
    assert call("GET", "/nowhere")[0] == 404


def test_health_and_description(call):
    assert call("GET", "/health") == (200, {"status": "ok", "ready": True})
    status, said = call("GET", "/openapi.json")
    assert status == 200 and said["paths"].keys() == {"/documents/{doc_id}", "/search", "/health"}
    assert [p["name"] for p in said["paths"]["/search"]["get"]["parameters"]] == ["q", "size"]
