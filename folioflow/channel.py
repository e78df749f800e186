"""Lines from tasks to the driver while the tasks run.

The driver listens on a port; a worker connects when it has its first line to tell, says the
run's token, and then sends line by line. A line longer than ``MOST`` bytes comes in pieces. The
driver reads no faster than it writes, and what it hasn't read waits with the worker, so neither
side holds more than a few lines. Telling is best effort: without a connection lines are lost,
and the command that said them runs on.
"""

from __future__ import annotations

import secrets
import socket
import threading
from collections.abc import Callable
from contextlib import suppress
from typing import NamedTuple

MOST = 1 << 16
_CONNECT_SECONDS = 5.0


class Address(NamedTuple):
    host: str
    port: int
    token: str


class Channel:
    """The driver's end; ``told`` gets each line, one at a time."""

    def __init__(self, host: str, told: Callable[[str], None]):
        self._told, self._lock = told, threading.Lock()
        self._server = socket.create_server(("", 0))
        self.address = Address(host, self._server.getsockname()[1], secrets.token_hex(16))
        threading.Thread(target=self._accept, daemon=True).start()

    def _accept(self) -> None:
        with suppress(OSError):  # closed
            while True:
                there, _ = self._server.accept()
                threading.Thread(target=self._read, args=(there,), daemon=True).start()

    def _read(self, there: socket.socket) -> None:
        with suppress(OSError, ValueError), there, there.makefile("rb") as lines:
            there.settimeout(_CONNECT_SECONDS)
            if not secrets.compare_digest(lines.readline(MOST).strip(), self.address.token.encode()):
                return
            there.settimeout(None)
            while line := lines.readline(MOST):
                with self._lock:
                    self._told(line.rstrip(b"\r\n").decode("utf-8", "replace"))

    def close(self) -> None:
        self._server.close()


_open: dict[Address, socket.socket] = {}
_sending = threading.Lock()


def tell(address: Address, line: bytes) -> None:
    """Send a line from a worker."""
    with _sending:
        try:
            if address not in _open:
                _open[address] = socket.create_connection(address[:2], _CONNECT_SECONDS)
                _open[address].settimeout(None)
                _open[address].sendall(address.token.encode() + b"\n")
            _open[address].sendall(line + b"\n")
        except OSError:
            lost = _open.pop(address, None)
            if lost:
                lost.close()
