"""Request and response: one request a connection, one line in, the answer out.  A front to a function on the driver, for demonstrations and small loads."""

from __future__ import annotations

import socketserver
import threading
from collections.abc import Callable


class Server:
    """Answers each connection's first line with `answer(line)`, until it is closed; use as a context."""

    def __init__(self, answer: Callable[[str], str], host: str = "127.0.0.1", port: int = 0, longest: int = 1 << 20):
        class Handler(socketserver.StreamRequestHandler):
            def handle(self):
                line = self.rfile.readline(longest).decode("utf-8", "replace").rstrip("\r\n")
                try:
                    out = answer(line)
                except Exception as e:  # the answer to a request that fails is the failure; the server goes on
                    out = f"ERROR {e}"
                self.wfile.write(out.encode())

        self._server = socketserver.ThreadingTCPServer((host, port), Handler)
        self._server.daemon_threads = True
        self.port = self._server.server_address[1]

    def __enter__(self) -> Server:
        threading.Thread(target=self._server.serve_forever, daemon=True).start()
        return self

    def __exit__(self, *_) -> None:
        self._server.shutdown()
        self._server.server_close()
