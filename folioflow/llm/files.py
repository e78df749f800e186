"""Binary files in shared folders, written and range-read by workers."""

from __future__ import annotations

import json
import uuid
from contextlib import contextmanager

from pyspark.sql import SparkSession

from .common import hadoop_path


def qualified(spark: SparkSession, path: str) -> str:
    """``path`` with the scheme that Spark resolves it to, so that workers open the same place."""
    fs, where = hadoop_path(spark, path)
    return fs.makeQualified(where).toString()


def opened(uri: str):
    """(file system, path) of a URI, for local folders, HDFS and the object stores of pyarrow."""
    from pyarrow import fs

    scheme, _, rest = uri.partition(":")
    if scheme == "file":
        return fs.LocalFileSystem(), "/" + rest.lstrip("/")
    return fs.FileSystem.from_uri(f"s3:{rest}" if scheme in ("s3a", "s3n") else uri)


@contextmanager
def replaced(fs, path: str):
    """A stream to a new file that takes the name ``path`` only once it is whole. Attempts of
    the same task write under names of their own; the last to end stays, with equal bytes."""
    part = f"{path}.{uuid.uuid4().hex}.part"
    fs.create_dir(path.rpartition("/")[0], recursive=True)
    try:
        with fs.open_output_stream(part) as out:
            yield out
        fs.move(part, path)
    except BaseException:
        try:
            fs.delete_file(part)
        except OSError:
            pass
        raise


def read_manifest(uri: str):
    fs, path = opened(uri)
    with fs.open_input_stream(path) as f:
        return json.loads(f.read())
