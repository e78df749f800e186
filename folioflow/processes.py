"""Commands that end with the worker that runs them.

A command runs in a session of its own, so that it can be stopped with all that it has started.
If the worker itself is killed, as when a job is cancelled or an executor is lost, nobody is
left to stop it; so each command has a guard, a shell that reads from a pipe which only the
worker holds open. The pipe closes with the worker, however it ends, and the guard then kills
the command's process group.
"""

from __future__ import annotations

import os
import signal
import subprocess
from collections.abc import Iterator, Sequence
from contextlib import contextmanager, suppress


def kill_group(pid: int) -> None:
    """Kill the process group that ``pid`` leads; nothing happens if it is gone."""
    with suppress(ProcessLookupError, PermissionError):
        os.killpg(pid, signal.SIGKILL)


@contextmanager
def guarded(argv: Sequence[str], **options) -> Iterator[subprocess.Popen]:
    """A process, as ``Popen`` starts it, in a group of its own that is killed when the block is
    left while it runs, and when this process ends in whatever way."""
    reading, held = os.pipe()
    guard = process = None
    try:
        process = subprocess.Popen(argv, start_new_session=True, **options)
        guard = subprocess.Popen(["/bin/sh", "-c", 'read -r _; kill -9 "-$0" 2>/dev/null', str(process.pid)], stdin=reading, stdout=subprocess.DEVNULL, stderr=subprocess.DEVNULL, start_new_session=True)
        os.close(reading)
        reading = -1
        yield process
    finally:
        if process is not None and process.poll() is None:
            kill_group(process.pid)
            process.wait()
        if guard is not None:
            guard.kill()
            guard.wait()
        for end in (reading, held):
            if end >= 0:
                os.close(end)
