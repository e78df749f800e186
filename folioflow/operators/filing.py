"""The sink: place documents in an archive folder, verified, without overwriting.

Names are decided by ``operators.claim`` before anything is written. Writing is idempotent: a
file is copied under a temporary name, hashed while it is written, flushed, compared with the
digest of the plan, and only then linked to its name, which fails if the name is taken. If the
task runs again, it finds its own bytes there and goes on.
"""

from __future__ import annotations

import errno
import hashlib
import io
import os
import secrets
import shutil
import stat
from collections.abc import Iterator
from contextlib import contextmanager, suppress
from pathlib import Path
from typing import BinaryIO

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .claim import folder_of, names_tried

_FOLDER = os.O_RDONLY | os.O_DIRECTORY | os.O_CLOEXEC
#: Fixed value: bytes copied at a time.
CHUNK = 512 << 10


class FilingError(Exception):
    pass


class Archive:
    """A folder that exists already. Every step of a name is opened from the folder before it, and
    none through a link, so that nothing outside is read or written whatever happens meanwhile.

    Files are written in ``staging``, a hidden folder of the archive, and get their names from
    there, so that whatever a killed task leaves unfinished is in one place."""

    def __init__(self, root: str | Path, staging: str = ".folioflow-staging"):
        self.root, self.staging = Path(root).resolve(strict=True), staging
        self._own = secrets.token_hex(4)  # tasks don't wait for each other's changes of one folder
        if not self.root.is_dir():
            raise FilingError(f"{root} is not a folder")

    def cleared(self) -> None:
        """Remove the staging folder and what is left in it."""
        with self._inside([]) as handle, suppress(FileNotFoundError):
            shutil.rmtree(self.staging, dir_fd=handle)

    @staticmethod
    def parts_of(name: str) -> list[str]:
        parts = name.split("/")
        if any(p in ("", ".", "..") for p in parts) or "\\" in name or "\0" in name:
            raise FilingError(f"{name!r} does not stay in the archive")
        return parts

    @contextmanager
    def _inside(self, folders: list[str], make: bool = False) -> Iterator[int]:
        """A handle of the folder that ``folders`` lead to."""
        handle = os.open(self.root, _FOLDER)
        try:
            for part in folders:
                if make:
                    with suppress(FileExistsError):
                        os.mkdir(part, 0o755, dir_fd=handle)
                try:
                    inner = os.open(part, _FOLDER | os.O_NOFOLLOW, dir_fd=handle)
                except OSError as e:
                    if e.errno in (errno.ELOOP, errno.ENOTDIR):
                        raise FilingError(f"{'/'.join(folders)!r} leads through a link or a file") from e
                    raise
                os.close(handle)
                handle = inner
            yield handle
        finally:
            os.close(handle)

    @contextmanager
    def _new_file(self) -> Iterator[tuple[int, str, BinaryIO]]:
        """The staging folder's handle and in it a file of a name that nobody else has; gone at
        the end unless it was renamed."""
        part = secrets.token_hex(8)
        with self._inside([self.staging, self._own], make=True) as folder:
            try:
                with os.fdopen(os.open(part, os.O_WRONLY | os.O_CREAT | os.O_EXCL | os.O_NOFOLLOW, 0o666, dir_fd=folder), "wb") as out:
                    yield folder, part, out
            finally:
                with suppress(FileNotFoundError):
                    os.unlink(part, dir_fd=folder)

    def place(self, source: str | Path | bytes, size: int, digest: str, name: str, remove: bool = False) -> str:
        """File one source, a path or bytes, under ``name``; 'filed', or 'duplicate' if its bytes
        are there already."""
        *folders, leaf = self.parts_of(name)
        with self._inside(folders, make=True) as folder:
            there = self._status(folder, leaf)
            if there and not isinstance(source, bytes) and os.path.exists(source) and os.path.samestat(there, os.stat(source)):
                return "duplicate"  # the source is the archived file itself; never remove it
            if there:
                done = self._settle(folder, leaf, size, digest, name)
            else:
                with self._new_file() as (staging, part, out):
                    self._copy(source, out, size, digest)
                    try:
                        os.link(part, leaf, src_dir_fd=staging, dst_dir_fd=folder, follow_symlinks=False)
                        done = "filed"
                    except FileExistsError:
                        done = self._settle(folder, leaf, size, digest, name)
        if remove and not isinstance(source, bytes):
            Path(source).unlink(missing_ok=True)
        return done

    @staticmethod
    def _status(folder: int, leaf: str) -> os.stat_result | None:
        try:
            return os.stat(leaf, dir_fd=folder, follow_symlinks=False)
        except FileNotFoundError:
            return None

    def _settle(self, folder: int, leaf: str, size: int, digest: str, name: str) -> str:
        if size > 0 and self._content(folder, leaf) == (size, digest):
            return "duplicate"
        raise FilingError(f"{name}: other content took the name")

    def _content(self, folder: int, leaf: str) -> tuple[int, str] | None:
        """Size and digest of a plain file, None of anything else."""
        there = self._status(folder, leaf)
        if not there or not stat.S_ISREG(there.st_mode):
            return None
        with os.fdopen(os.open(leaf, os.O_RDONLY | os.O_NOFOLLOW, dir_fd=folder), "rb") as f:
            return os.fstat(f.fileno()).st_size, hashlib.file_digest(f, "sha256").hexdigest()

    @staticmethod
    def _copy(source: str | Path | bytes, out: BinaryIO, size: int, digest: str) -> None:
        seen, hashed = 0, hashlib.sha256()
        with io.BytesIO(source) if isinstance(source, bytes) else open(source, "rb") as f:
            while piece := f.read(CHUNK):
                out.write(piece)
                hashed.update(piece)
                seen += len(piece)
        out.flush()
        os.fsync(out.fileno())
        if seen != size or hashed.hexdigest() != digest:
            raise FilingError(f"{'the content' if isinstance(source, bytes) else source} changed while it was copied")

    def write_atomic(self, name: str, body: bytes) -> None:
        """Write a small file whole or not at all, in place of an earlier one."""
        *folders, leaf = self.parts_of(name)
        with self._inside(folders, make=True) as folder, self._new_file() as (staging, part, out):
            out.write(body)
            out.flush()
            os.fsync(out.fileno())
            os.replace(part, leaf, src_dir_fd=staging, dst_dir_fd=folder)

    def read(self, name: str) -> bytes | None:
        """A file's bytes, None if there is none."""
        *folders, leaf = self.parts_of(name)
        try:
            with self._inside(folders) as folder, os.fdopen(os.open(leaf, os.O_RDONLY | os.O_NOFOLLOW, dir_fd=folder), "rb") as f:
                return f.read()
        except FileNotFoundError:
            return None

    def content(self, name: str) -> tuple[int, str] | None:
        """(size, digest) of a plain file, None of anything else or nothing."""
        *folders, leaf = self.parts_of(name)
        try:
            with self._inside(folders) as folder:
                return self._content(folder, leaf)
        except FileNotFoundError:
            return None

    def names_in(self, folder: str) -> list[str]:
        """What a folder of the archive holds, names from the root; none if there is no such folder."""
        try:
            with self._inside(self.parts_of(folder) if folder else []) as handle:
                return [f"{folder}/{leaf}" if folder else leaf for leaf in os.listdir(handle)]
        except FileNotFoundError:
            return []

    def relative(self, path: str | Path) -> str | None:
        """A path's name inside the archive, None if it is outside."""
        try:
            inside = Path(os.path.abspath(path)).relative_to(self.root).as_posix()
        except ValueError:
            return None
        return None if inside == "." else inside


def names_held(claims: DataFrame, root: str) -> DataFrame:
    """(path, size, digest) of what the archive holds under the names that ``claims`` (dest) may
    try: the names themselves and their suffixed forms. Executors list the folders that are
    filed into, and read only the files that bear such a name."""
    dests = claims.where("dest IS NOT NULL").select("dest").distinct()
    folders = dests.select(folder_of(F.col("dest")).alias("folder")).distinct()

    def listed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        archive = Archive(root)
        for pdf in batches:
            for folder in pdf["folder"]:
                yield pd.DataFrame({"path": archive.names_in(folder)}, dtype=object)

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        archive = Archive(root)
        for pdf in batches:
            # something that is no plain file holds its name all the same
            told = [(path, *(archive.content(path) or (-1, ""))) for path in pdf["path"]]
            yield pd.DataFrame(told, columns=["path", "size", "digest"])

    names = folders.mapInPandas(listed, "path string")
    tried = names_tried(names, "path").join(dests, "dest", "left_semi").select("path").distinct()
    return tried.mapInPandas(read, "path string, size long, digest string")
