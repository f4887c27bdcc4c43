"""An HTTP front end: reports below a folder, and /search over a path index."""

from __future__ import annotations

import json
import os
from http.server import SimpleHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, urlsplit

from fathom.operators.search import PathIndex

MOST_LIMIT = 1_000_000


def search_answer(index: PathIndex | None, query: str) -> tuple[int, dict]:
    """(status, body) for a query string q=...&skip=...&limit=..."""
    q = parse_qs(query, keep_blank_values=True)
    term = (q.get("q", [""])[0]).strip()
    if len(term) < 3:
        return 400, {"error": "the term must have 3 characters at least"}
    try:
        skip, limit = int(q.get("skip", ["0"])[0]), int(q.get("limit", ["50"])[0])
    except ValueError:
        return 400, {"error": "skip and limit must be numbers"}
    if skip < 0 or not 1 <= limit <= MOST_LIMIT:
        return 400, {"error": "skip must not be negative, limit 1 to 1000000"}
    if index is None:
        return 404, {"error": "no index"}
    try:
        return 200, json.loads(index.answer(term, skip, limit))
    except Exception as e:
        return 502, {"error": str(e)[:200]}


def handler(root: str, index: PathIndex | None):
    root = os.path.realpath(root)

    class Handler(SimpleHTTPRequestHandler):
        def __init__(self, *a, **k):
            super().__init__(*a, directory=root, **k)

        def do_GET(self):
            parts = urlsplit(self.path)
            if parts.path.rstrip("/").endswith("/search"):
                status, body = search_answer(index, parts.query)
                data = json.dumps(body).encode()
                self.send_response(status)
                self.send_header("Content-Type", "application/json")
                self.send_header("Content-Length", str(len(data)))
                self.end_headers()
                self.wfile.write(data)
            elif not (os.path.realpath(self.translate_path(self.path)) + "/").startswith(root + "/"):
                self.send_error(403)
            else:
                super().do_GET()

    return Handler


def serve(root: str, index: PathIndex | None, bind: str = "127.0.0.1", port: int = 8000) -> ThreadingHTTPServer:
    return ThreadingHTTPServer((bind, port), handler(root, index))
