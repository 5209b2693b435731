"""Transports for requests: a pair of text streams, or connections to a Unix or TCP socket.

A message is a line of JSON either way. All connections share one index and one
Spark session, so their queries share its executors.
"""

from __future__ import annotations

import contextlib
import json
import os
import socketserver
import sys
import threading
from typing import TextIO

from quillon.rpc import Server

BUSY = -32004


def stdio(server: Server, incoming: TextIO | None = None, outgoing: TextIO | None = None) -> None:
    """Answers each line of the one stream on the other, until the first ends."""
    outgoing = outgoing or sys.stdout
    for reply in server.serve(incoming or sys.stdin):
        outgoing.write(reply + "\n")
        outgoing.flush()


def parse_address(address: str) -> str | tuple[str, int]:
    """The path of unix:PATH, or the host and port of tcp:HOST:PORT."""
    kind, _, rest = address.partition(":")
    if kind == "unix" and rest:
        return rest
    host, _, port = rest.rpartition(":")
    if kind == "tcp" and host and port.isdigit() and int(port) < 1 << 16:
        return host.strip("[]"), int(port)
    raise ValueError(f"neither unix:PATH nor tcp:HOST:PORT: {address}")


class Listener:
    """A listening socket with a thread for each connection, up to max_conns at once (0: any number).

    A connection above that gets one error line, which says that it may try again, and is closed.
    Use as a context manager, or call run().
    """

    def __init__(self, server: Server, address: str, max_conns: int = 0):
        place = parse_address(address)
        free = threading.BoundedSemaphore(max_conns) if max_conns else None

        class Connection(socketserver.StreamRequestHandler):
            def answer(self, line: str) -> None:
                self.wfile.write(line.encode() + b"\n")

            def handle(self) -> None:
                if free is not None and not free.acquire(blocking=False):
                    message = f"server at capacity (max_conns={max_conns}); retry after current requests complete"
                    self.answer(json.dumps({"jsonrpc": "2.0", "id": None, "error": {"code": BUSY, "message": message, "data": {"max_conns": max_conns, "retryable": True}}}))
                    return
                try:
                    for line in self.rfile:
                        for reply in server.serve([line.decode("utf-8", "replace")]):
                            self.answer(reply)
                except ConnectionError:
                    pass  # the client left before its answer
                finally:
                    if free is not None:
                        free.release()

        if isinstance(place, str):
            with contextlib.suppress(FileNotFoundError):
                os.unlink(place)  # a socket that an earlier process left
            self._sockets = socketserver.ThreadingUnixStreamServer(place, Connection)
        else:
            kind = type("Tcp", (socketserver.ThreadingTCPServer,), {"allow_reuse_address": True})
            self._sockets = kind(place, Connection)
        self._sockets.daemon_threads = True
        self.address, self._path = self._sockets.server_address, place if isinstance(place, str) else None

    def run(self) -> None:
        try:
            self._sockets.serve_forever()
        finally:
            self.close()

    def close(self) -> None:
        self._sockets.server_close()
        if self._path:
            with contextlib.suppress(FileNotFoundError):
                os.unlink(self._path)

    def __enter__(self) -> Listener:
        self._thread = threading.Thread(target=self._sockets.serve_forever, daemon=True)
        self._thread.start()
        return self

    def __exit__(self, *_: object) -> None:
        self._sockets.shutdown()
        self._thread.join()
        self.close()
