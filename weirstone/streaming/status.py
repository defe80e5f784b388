"""A small page over HTTP for a driver loop: /health, /ready, /metrics (Prometheus text) and /status (JSON)."""

from __future__ import annotations

import json
import threading
from collections.abc import Callable
from dataclasses import asdict
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

from weirstone.streaming.runner import Counters


class StatusPage:
    """Serves the counters of a loop until closed. Ready means that a run has ended well."""

    def __init__(self, counters: Counters, name: str = "", bind: str = "127.0.0.1:0", more: Callable[[], dict] | None = None):
        host, _, port = bind.rpartition(":")
        page = self
        self.counters, self.name, self.more = counters, name, more

        class Handler(BaseHTTPRequestHandler):
            def do_GET(self) -> None:
                code, kind, body = page.answer(self.path)
                self.send_response(code)
                self.send_header("Content-Type", kind)
                self.end_headers()
                self.wfile.write(body.encode())

            def log_message(self, *args: object) -> None:
                """Quiet."""

        self.server = ThreadingHTTPServer((host, int(port)), Handler)
        self.address = self.server.server_address[:2]
        threading.Thread(target=self.server.serve_forever, daemon=True).start()

    def answer(self, path: str) -> tuple[int, str, str]:
        numbers = {k: v for k, v in asdict(self.counters).items() if isinstance(v, int)}
        if path == "/health":
            return 200, "text/plain", "ok"
        if path == "/ready":
            return (200, "text/plain", "ready") if self.counters.runs else (503, "text/plain", "no run yet")
        if path == "/metrics":
            return 200, "text/plain; version=0.0.4", "".join(f"# TYPE weirstone_{k} counter\nweirstone_{k} {v}\n" for k, v in numbers.items())
        if path == "/status":
            return 200, "application/json", json.dumps({"name": self.name, **asdict(self.counters), **(self.more() if self.more else {})})
        return 404, "text/plain", "nothing here"

    def close(self) -> None:
        self.server.shutdown()
        self.server.server_close()
