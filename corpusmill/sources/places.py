"""File systems by path, for tasks and the driver alike."""

from __future__ import annotations


def file_system(path: str):
    """(file system, path in it) of a plain path or an address such as hdfs://host/folder."""
    from pyarrow import fs

    if path.startswith("file:"):
        path = "/" + path.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)
