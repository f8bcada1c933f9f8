"""The store over HTTP: JSON in and out, from the standard library alone.

``POST /documents/{id}`` puts a document, ``GET`` reads and ``DELETE`` deletes
it; ``GET /search?q=...&size=10`` searches.  404 for what isn't there, 422 for
requests that don't fit, 400 for bodies that can't be indexed.  ``GET /health``
answers when Spark does, ``GET /openapi.json`` describes the routes.

    python -m lodestone.service FOLDER [PORT]
"""

from __future__ import annotations

import json
import logging
import sys
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from threading import Lock
from urllib.parse import parse_qs, unquote, urlsplit

from lodestone.errors import DocumentNotFound, InvalidDocument, InvalidQuery, InvalidSize
from lodestone.schema import DEFAULT_SIZE
from lodestone.session import connect
from lodestone.store import DocumentStore

log = logging.getLogger("lodestone")
PORT = 3000


def description() -> dict:
    """The routes as OpenAPI has them."""

    def parameter(name: str, place: str, kind: str, **more: object) -> dict:
        return {"name": name, "in": place, "required": place == "path" or name == "q", "schema": {"type": kind, **more}}

    def answers(**by_status: str) -> dict:
        return {"200": {"description": "Done"}} | {s[1:]: {"description": text} for s, text in by_status.items()}

    body = {"required": True, "content": {"application/json": {"schema": {"type": "object"}}}}
    one = [parameter("doc_id", "path", "string")]
    missing = "Document not found"
    return {
        "openapi": "3.1.0",
        "info": {"title": "lodestone", "version": "1"},
        "paths": {
            "/documents/{doc_id}": {
                "post": {"summary": "Put a document", "parameters": one, "requestBody": body, "responses": answers(_400="Not indexable", _422="Not a JSON object")},
                "get": {"summary": "Read a document", "parameters": one, "responses": answers(_404=missing)},
                "delete": {"summary": "Delete a document", "parameters": one, "responses": answers(_404=missing)},
            },
            "/search": {"get": {"summary": "Search", "parameters": [parameter("q", "query", "string"), parameter("size", "query", "integer", default=DEFAULT_SIZE)], "responses": answers(_400="No such size", _422="No q")}},
            "/health": {"get": {"summary": "Whether Spark answers", "responses": answers()}},
        },
    }


class Problem(Exception):
    def __init__(self, status: int, detail: str):
        super().__init__(detail)
        self.status, self.detail = status, detail


class Handler(BaseHTTPRequestHandler):
    """One request; writes are made one after the other, as each takes the next number."""

    store: DocumentStore
    writing: Lock

    def answer(self, run) -> None:
        try:
            status, body = 200, run()
        except Problem as e:
            status, body = e.status, {"detail": e.detail}
        except DocumentNotFound as e:
            status, body = 404, {"detail": str(e)}
        except (InvalidDocument, InvalidQuery, InvalidSize) as e:
            status, body = 400, {"detail": str(e)}
        except Exception:
            log.exception("%s %s", self.command, self.path)
            status, body = 500, {"detail": "Internal Server Error"}
        data = json.dumps(body, ensure_ascii=False).encode()
        self.send_response(status)
        self.send_header("Content-Type", "application/json")
        self.send_header("Content-Length", str(len(data)))
        self.end_headers()
        self.wfile.write(data)

    def document_id(self) -> str:
        parts = urlsplit(self.path).path.split("/")
        if len(parts) != 3 or parts[1] != "documents" or not parts[2]:
            raise Problem(404, "Not Found")
        return unquote(parts[2])

    def put(self) -> dict:
        name = self.document_id()
        text = self.rfile.read(int(self.headers.get("Content-Length") or 0)).decode("utf-8", "replace")
        try:
            body = json.loads(text)
        except ValueError:
            raise Problem(422, "The body is not JSON") from None
        if not isinstance(body, dict):
            raise Problem(422, "The body is not an object")
        with self.writing:
            return self.store.index(name, text)

    def remove(self) -> dict:
        with self.writing:
            return self.store.delete(self.document_id())

    def read(self) -> object:
        url = urlsplit(self.path)
        if url.path == "/health":
            return {"status": "ok", "ready": self.store.spark.range(1).count() == 1}
        if url.path == "/openapi.json":
            return description()
        if url.path != "/search":
            return self.store.get(self.document_id())
        asked = parse_qs(url.query, keep_blank_values=True)
        if "q" not in asked:
            raise Problem(422, "q is required")
        try:
            size = int(asked.get("size", [DEFAULT_SIZE])[-1])
        except ValueError:
            raise Problem(422, "size is not an integer") from None
        return self.store.search(asked["q"][-1], size)

    def do_POST(self) -> None:
        self.answer(self.put)

    def do_DELETE(self) -> None:
        self.answer(self.remove)

    def do_GET(self) -> None:
        self.answer(self.read)

    def log_message(self, form: str, *args: object) -> None:
        log.info(form, *args)


def server(store: DocumentStore, port: int = PORT, host: str = "127.0.0.1") -> ThreadingHTTPServer:
    """A server for a store, the collection made if it is missing."""
    store.create_index_if_needed()
    return ThreadingHTTPServer((host, port), type("StoreHandler", (Handler,), {"store": store, "writing": Lock()}))


if __name__ == "__main__":
    logging.basicConfig(level=logging.INFO)
    server(DocumentStore(connect(), sys.argv[1]), int(sys.argv[2]) if len(sys.argv) > 2 else PORT).serve_forever()
