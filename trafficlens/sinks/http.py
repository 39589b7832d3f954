"""The HTTP face of a process: health, readiness, metrics, queries, and for gateways snapshots and nodes."""

from __future__ import annotations

import json
import threading
from collections.abc import Callable
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

MOST_BODY = 64 << 20
Route = Callable[[], tuple[int, str, str]]


def serve(routes: dict[str, Route], snapshots: Callable[[bytes], tuple[int, dict]] | None = None, host: str = "127.0.0.1", port: int = 0) -> ThreadingHTTPServer:
    """Serves ``routes`` (path to status, type and body) from a thread; ``snapshots`` takes POST /v1/snapshots."""

    class Handler(BaseHTTPRequestHandler):
        def _answer(self, status: int, kind: str, body: str) -> None:
            data = body.encode()
            self.send_response(status)
            self.send_header("Content-Type", kind)
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            self.wfile.write(data)

        def do_GET(self) -> None:
            path = self.path.split("?")[0]
            if path in routes:
                self._answer(*routes[path]())
            else:
                self._answer(404, "text/plain", "not found\n")

        def do_POST(self) -> None:
            size = int(self.headers.get("Content-Length") or 0)
            if snapshots is None or self.path != "/v1/snapshots":
                self._answer(404, "text/plain", "not found\n")
            elif size > MOST_BODY:
                self._answer(413, "text/plain", "too large\n")
            else:
                status, answer = snapshots(self.rfile.read(size))
                self._answer(status, "application/json", json.dumps(answer))

        def log_message(self, *args: object) -> None:
            pass

    server = ThreadingHTTPServer((host, port), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    return server


def agent_routes(ready: Callable[[], bool], metrics: Callable[[], str], queries: Callable[[], list]) -> dict[str, Route]:
    return {
        "/healthz": lambda: (200, "text/plain", "ok\n"),
        "/readyz": lambda: (200, "text/plain", "ready\n") if ready() else (503, "text/plain", "not ready\n"),
        "/metrics": lambda: (200, "text/plain; version=0.0.4", metrics()),
        "/v1/queries": lambda: (200, "application/json", json.dumps(queries())),
    }


def gateway_routes(ready: Callable[[], bool], metrics: Callable[[], str], queries: Callable[[], list], nodes: Callable[[], list]) -> dict[str, Route]:
    return agent_routes(ready, metrics, queries) | {"/v1/nodes": lambda: (200, "application/json", json.dumps(nodes()))}
