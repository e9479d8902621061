"""Binary files in the folder that all executors share, written and read inside Spark tasks.

A path may be a plain one or a URI of any store pyarrow knows. A task writes under a name of its own attempt and
tells it in the rows it returns, so of attempts that are repeated after a loss only the one that counts is ever read.
"""

from __future__ import annotations

import uuid

from pyarrow import fs


def store_of(path: str) -> tuple[fs.FileSystem, str]:
    if "://" in path or path.startswith("file:"):
        if path.startswith("file:") and not path.startswith("file://"):
            path = "file://" + path[len("file:") :]
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), path


def new_file(folder: str, suffix: str) -> tuple[str, fs.FileSystem, str]:
    """(path to tell others, store, path inside the store) of a file that does not exist yet."""
    path = f"{folder}/{uuid.uuid4().hex}{suffix}"
    store, inside = store_of(path)
    store.create_dir(inside.rsplit("/", 1)[0], recursive=True)
    return path, store, inside
