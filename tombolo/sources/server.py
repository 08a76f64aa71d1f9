"""Command lines over TCP: every connection is a session, and all share one store.

Lines get their ``seq`` in the order in which they arrive, under one lock. What
has arrived since the last run is executed as one script, so that clients who
type at once share a run; replies go out once its changes are committed. The
front is one process, as any listener is; the runs are Spark's.
"""

from __future__ import annotations

import socketserver
import threading

from pyspark.sql import SparkSession

from tombolo.schema import LINE


def address_of(spark: SparkSession) -> tuple[str, int]:
    """The address and port that the session's settings name; an error where one is missing."""
    found = [spark.conf.get(f"tombolo.{name}", None) for name in ("address", "port")]
    if None in found:
        raise ValueError("tombolo.address and tombolo.port have to be set")
    return found[0], int(found[1])


class LineServer:
    """Listens from ``start`` to ``stop``; ``step`` executes what has arrived."""

    def __init__(self, store, address: tuple[str, int]):
        self.store, self._lock, self._waiting, self._seq = store, threading.Lock(), [], 0
        self._ends: dict[str, object] = {}
        outer = self

        class Session(socketserver.StreamRequestHandler):
            def handle(self):
                name = f"{self.client_address[0]}:{self.client_address[1]}"
                outer._ends[name] = self
                self.done = threading.Event()
                for raw in self.rfile:
                    outer._arrived(name, raw.decode("utf-8", "replace").rstrip("\r\n"))
                    if self.done.is_set():
                        break
                outer._arrived(name, None)
                self.done.wait()

        self._server = socketserver.ThreadingTCPServer(address, Session, bind_and_activate=False)
        self._server.daemon_threads = self._server.allow_reuse_address = True

    @property
    def address(self) -> tuple[str, int]:
        return self._server.server_address[:2]

    def _arrived(self, session: str, line: str | None) -> None:
        with self._lock:
            self._waiting.append((session, self._seq, line))
            self._seq += 1

    def start(self) -> None:
        self._server.server_bind()
        self._server.server_activate()
        threading.Thread(target=self._server.serve_forever, daemon=True).start()

    def stop(self) -> None:
        self._server.shutdown()
        self._server.server_close()

    def step(self) -> int:
        """Execute the lines that have arrived, send their replies in order, and close the sessions that ended; returns how many lines there were.

        What reaches the driver is the replies to lines that came through it.
        """
        with self._lock:
            taken, self._waiting = self._waiting, []
        lines = [(s, n, line) for s, n, line in taken if line is not None and s in self._ends]
        replies = self.store.execute(self.store.spark.createDataFrame(lines, LINE)).orderBy("seq").collect() if lines else []
        ended = [s for s, _, line in taken if line is None]
        for r in replies:
            if r["op"] == "quit":
                ended.append(r["session"])
            else:
                self._send(r["session"], r["response"])
        for s in ended:
            end = self._ends.pop(s, None)
            if end:
                end.done.set()
                self._close(end)
        return len(lines)

    def _send(self, session: str, text: str) -> None:
        try:
            self._ends[session].wfile.write(f"{text}\n".encode())
        except OSError:  # the client has gone; what it did stays
            pass

    @staticmethod
    def _close(end) -> None:
        try:
            end.connection.shutdown(2)
        except OSError:
            pass
