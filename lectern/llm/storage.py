"""Files in folders that driver and executors share, opened by URI, for formats that Spark has no writer for."""

from __future__ import annotations

from urllib.parse import urlparse


def opened(uri: str):
    """(file system, path in it) of a URI or an absolute path."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri) if urlparse(uri).scheme else (fs.LocalFileSystem(), uri)


def attempt_name() -> str:
    """A name that no other attempt at this task has, so that a repeated task never touches an earlier one's files."""
    import uuid

    from pyspark import TaskContext

    return f"{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex[:12]}"
