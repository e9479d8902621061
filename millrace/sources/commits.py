"""Files that only the first writer of a name gets to write: the compare-and-swap that the registry's log rests on."""

from __future__ import annotations

import os
import uuid
from urllib.parse import unquote, urlparse

from pyspark.sql import SparkSession


def _local(path: str) -> str | None:
    """The path on this machine, or None if another store holds it."""
    parts = urlparse(path)
    return unquote(parts.path) if parts.scheme == "file" else path if not parts.scheme else None


def put_if_absent(spark: SparkSession, path: str, content: str) -> bool:
    """Write a new file, whole or not at all; False if there is one of that name already.

    On a file system the finished file is linked to its name, which fails if the name is taken. Other stores are asked
    through Hadoop to create the file only if it is absent, which is atomic wherever the store's creation is.
    """
    local = _local(path)
    if local is not None:
        os.makedirs(os.path.dirname(local), exist_ok=True)
        draft = f"{os.path.dirname(local)}/_{uuid.uuid4().hex}"  # a name that Spark's readers pass over
        with open(draft, "w", encoding="utf-8") as file:
            file.write(content)
        try:
            os.link(draft, local)
        except FileExistsError:
            return False
        finally:
            os.unlink(draft)
        return True
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    store = place.getFileSystem(spark._jsc.hadoopConfiguration())
    try:
        stream = store.create(place, False)
    except Exception:
        if store.exists(place):
            return False
        raise
    stream.write(bytearray(content, "utf-8"))
    stream.close()
    return True


def exists(spark: SparkSession, path: str) -> bool:
    local = _local(path)
    if local is not None:
        return os.path.exists(local)
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)
